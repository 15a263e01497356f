"""Inputs derived from the given tables, in expressions both engines read alike.

Each view is a dict of output column to expression. ``spark_*`` builds it as a
DataFrame, ``CTE`` holds the same view as SQL text.
"""

from pyspark.sql import functions as F

from leadloom.session import deal_out

RAW_LEADS = {
    "lead_seq": "c_custkey",
    "source": "CASE c_custkey % 7 WHEN 0 THEN 'google_maps' WHEN 1 THEN 'justdial' WHEN 2 THEN 'indiamart' WHEN 3 THEN 'yellowpages' WHEN 4 THEN 'clutch' WHEN 5 THEN 'Google_Maps' ELSE 'unlisted' END",
    "business_name": "concat('  Biz ', cast(c_custkey - c_custkey % 3 as string), '   ', CASE (c_custkey - c_custkey % 3) % 5 WHEN 0 THEN 'Digital Marketing Agency' WHEN 1 THEN 'Home Tutor' WHEN 2 THEN 'Global Consulting Group Pvt Ltd' WHEN 3 THEN 'International Technology Software Finance Legal Management Partners Inc' ELSE 'Bakery' END, ' ')",
    "phone": "CASE c_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN concat('Phone: +91 22-', cast(1000 + c_custkey as string)) WHEN 2 THEN concat('(213) 555-', cast(1000 + c_custkey % 9000 as string)) ELSE '' END",
    "address": "CASE c_custkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN concat(cast(100 + c_custkey as string), ' Main St  Los Angeles, CA 9000', cast(c_custkey % 10 as string)) WHEN 2 THEN 'Los Angeles, CA' WHEN 3 THEN n_name ELSE 'Address: Downtown' END",
    "website": "CASE c_custkey % 3 WHEN 0 THEN concat('https://site', cast(c_custkey % 50 as string), '.example.com/path?x=1') WHEN 1 THEN concat('http://site', cast(c_custkey % 50 as string), '.example.com') ELSE 'N/A' END",
    "rating": "CASE c_custkey % 6 WHEN 0 THEN '4.5' WHEN 1 THEN '4,2' WHEN 2 THEN 'N/A' WHEN 3 THEN '3.9 (120)' WHEN 4 THEN '' ELSE ' 5 ' END",
    "category": "CASE c_custkey % 11 WHEN 0 THEN 'N/A' ELSE concat(c_mktsegment, ' Services') END",
    "email": "CASE WHEN c_custkey % 8 < 3 THEN concat('info@site', cast(c_custkey % 60 as string), '.example.com') ELSE 'N/A' END",
}
LEAD_COLUMNS = list(RAW_LEADS)

CONTACTS = {
    "domain": "concat('site', cast(s_suppkey % 40 as string), '.example.com')",
    "lookup_seq": "s_suppkey",
    "value": "CASE WHEN s_suppkey % 9 = 1 THEN NULL ELSE concat('c', cast(s_suppkey as string), '@site', cast(s_suppkey % 40 as string), '.example.com') END",
    "confidence": "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 2 THEN 40 ELSE cast(s_suppkey % 3 * 40 as int) END",
}
# A lookup of every thirteenth supplier finds nothing, of every seventeenth is no JSON.
NO_CONTACT = "s_suppkey % 13 = 5 OR s_suppkey % 17 = 3"
PAYLOADS = {
    "domain": CONTACTS["domain"],
    "lookup_seq": "s_suppkey",
    "payload": "CASE WHEN s_suppkey % 13 = 5 THEN '{\"data\":{\"emails\":[]}}' WHEN s_suppkey % 17 = 3 THEN 'Too many requests' "
    "ELSE concat('{\"data\":{\"emails\":[{\"type\":\"generic\"', "
    "CASE WHEN s_suppkey % 9 = 1 THEN '' ELSE concat(',\"value\":\"c', cast(s_suppkey as string), '@site', cast(s_suppkey % 40 as string), '.example.com\"') END, "
    "CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 3 = 2 THEN ',\"confidence\":40' ELSE concat(',\"confidence\":', cast(s_suppkey % 3 * 40 as string)) END, "
    "'},{\"value\":\"z@z.example.com\",\"confidence\":10}]}}') END",
}
SENT_LOG = {
    "sent_at": "cast(o_orderdate as timestamp)",
    "to_email": "concat(CASE WHEN o_custkey % 60 < 20 THEN 'info' ELSE 'sales' END, '@site', cast(o_custkey % 60 as string), '.example.com')",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'dry_run' ELSE 'failed' END",
}
FEEDBACK = {"lead_seq": "doc_id", "label": "quality"}
RESPONSES = {
    "lead_seq": "c_custkey",
    "response": "CASE c_custkey % 7 WHEN 0 THEN concat('```json{\"subject\":\"Hello ', cast(c_custkey as string), '\",\"body\":\"Text\"}```') "
    "WHEN 1 THEN '{\"body\":\"only body\"}' WHEN 2 THEN 'not json' WHEN 3 THEN '[1,2]' WHEN 4 THEN '{\"subject\":\"a\"} trailing' "
    "WHEN 5 THEN '  {\"subject\": null, \"body\": \"x\"} ' ELSE '{}' END",
}
# Suppliers answer for the leads that share their number, so most leads have no response.
SOME_RESPONSES = {"lead_seq": "s_suppkey", "response": RESPONSES["response"].replace("c_custkey", "s_suppkey")}
# Up to four candidates per field, NULL where a selector found nothing.
CARD_CANDIDATES = {
    "names": ["CASE WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN concat(' ', c_name, ' ') END", "CASE WHEN c_custkey % 3 = 0 THEN concat('Shop ', c_mktsegment) END"],
    "phones": ["CASE c_custkey % 5 WHEN 0 THEN 'Phone: ' WHEN 1 THEN 'abc' WHEN 2 THEN concat('Phone: (213) 555-', cast(c_custkey as string)) END", "CASE WHEN c_custkey % 2 = 0 THEN concat('phone:tel:+1 ', cast(c_custkey as string)) END"],
    "addresses": ["CASE WHEN c_custkey % 3 = 0 THEN concat('Address: ', c_mktsegment, ', Address: CA ') WHEN c_custkey % 3 = 1 THEN '' END"],
    "websites": ["CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN concat('https://shop', cast(c_custkey as string), '.example.com/') END", "CASE WHEN c_custkey % 5 = 0 THEN 'https://later.example.com' END"],
    "ratings": ["CASE WHEN c_custkey % 3 = 0 THEN 'New' WHEN c_custkey % 3 = 1 THEN '4.5 stars' END", "CASE WHEN c_custkey % 2 = 0 THEN concat('(', cast(c_custkey as string), ')') END"],
    "categories": ["CASE c_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '  ' WHEN 2 THEN concat(c_mktsegment, '  shop') END"],
}


def _select(exprs, rest):
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + " " + rest


CTE = {
    "raw_leads": _select(RAW_LEADS, "FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "contacts": _select(CONTACTS, f"FROM supplier WHERE NOT ({NO_CONTACT})")
    + " UNION ALL SELECT " + CONTACTS["domain"] + f", s_suppkey, 'z@z.example.com', 10 FROM supplier WHERE NOT ({NO_CONTACT})",
    "sent_log": _select(SENT_LOG, "FROM orders"),
    "feedback": _select(FEEDBACK, "FROM labels"),
    "responses": _select(RESPONSES, "FROM customer"),
    "some_responses": _select(SOME_RESPONSES, "FROM supplier"),
}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, sf_dir):
    """Customers in many tasks: each stands for a lead, a page or a card, which are costly to read."""
    return deal_out(table(spark, sf_dir, "customer"))


def _exprs(view):
    return [f"{e} AS {n}" for n, e in view.items()]


def spark_raw_leads(spark, sf_dir):
    customer, nation = customers(spark, sf_dir), table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(*_exprs(RAW_LEADS))


def spark_payloads(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(*_exprs(PAYLOADS))


def spark_sent_log(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*_exprs(SENT_LOG))


def spark_feedback(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr(*_exprs(FEEDBACK))


def spark_responses(spark, sf_dir):
    return customers(spark, sf_dir).selectExpr(*_exprs(RESPONSES))


def spark_some_responses(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(*_exprs(SOME_RESPONSES))


def spark_raw_cards(spark, sf_dir):
    arrays = [f"array_compact(array({', '.join(es)})) AS {n}" for n, es in CARD_CANDIDATES.items()]
    return customers(spark, sf_dir).selectExpr("c_custkey AS page_id", "0 AS card_pos", "c_mktsegment AS query", *arrays)


def duck_raw_cards():
    arrays = [f"[x FOR x IN [{', '.join(es)}] IF x IS NOT NULL] AS {n}" for n, es in CARD_CANDIDATES.items()]
    return f"SELECT c_custkey AS page_id, c_mktsegment AS query, {', '.join(arrays)} FROM customer"


# Harvested pages. A page holds twenty customers' cards; a customer has zero to two cards.
CARDS_PER_PAGE = 20
_CARD_NAME = "concat('Firm &amp; Co ', cast(c_custkey - c_custkey % 4 as string))"
_CARD_PHONE = "concat('+1 (213) ', cast(c_custkey as string))"
_CARD_PLACE = "concat(cast(c_custkey as string), ' Main St, CA')"

LISTING_HTML = f"""CASE c_custkey % 6
 WHEN 0 THEN concat('<li class="cntanr big"><span class="lng_cont_name"> ', {_CARD_NAME}, ' </span><p class="contact-info">', {_CARD_PHONE}, '</p><span class="cont_fl_addr">', {_CARD_PLACE}, '</span><span class="green-box">4.1</span></li>')
 WHEN 1 THEN concat('<div class="resultbox_info"><h2><a href="/x">', {_CARD_NAME}, '</a></h2><b class="my_contact_box">', {_CARD_PHONE}, '<br> <i>ext</i></b><p class="jd_address">', {_CARD_PLACE}, '</p></div>')
 WHEN 2 THEN concat('<li class="x store-cards-y cntanr"><a class="store-name">', {_CARD_NAME}, '<p class="jd_address">', {_CARD_PLACE}, '<em class="big_rating_x"> 3.9 </em></li>')
 WHEN 3 THEN concat('<li class="cntanr"><div class="resultbox_info"><u class="resultbox_title_anchor">', {_CARD_NAME}, '</u></div><span class="green-box">2.5</span></li>')
 WHEN 4 THEN '<li class="cntanr"><p class="contact-info">000</p><!-- <span class="lng_cont_name">no</span> --></li>'
 ELSE concat('<li class="cntanr"><span class="lng_cont_name"> </span><p class="contact-info">', {_CARD_PHONE}, '</p></li>') END"""

SUPPLIER_HTML = f"""CASE c_custkey % 5
 WHEN 0 THEN concat('<div class="card"><h2><a>', {_CARD_NAME}, '</a></h2><p class="phone">', {_CARD_PHONE}, '</p><p class="company-address">', {_CARD_PLACE}, '</p></div>')
 WHEN 1 THEN concat('<div class="prd-card"><p class="company-name"><a href="#">', {_CARD_NAME}, '</a></p><p class="my-phone-no">', {_CARD_PHONE}, '</p><span class="loc">', {_CARD_PLACE}, '</span></div>')
 WHEN 2 THEN concat('<div class="top-supplier-box"><a class="companyname">', {_CARD_NAME}, '</a><p class="contact">', {_CARD_PHONE}, '</p></div>')
 WHEN 3 THEN concat('<div class="cards"><h2><a>', {_CARD_NAME}, '</a></h2></div>')
 ELSE '<div class="company-listing"><a class="companyname">N/A</a></div>' END"""

# One detail page per customer, with the list it was opened from.
MAP_HTML = f"""concat('<html><body><div role="feed">', CASE WHEN c_custkey % 3 = 0 THEN concat('<a class="hfpxzc" href="/maps/place/', cast(c_custkey as string), '">x</a>') ELSE '' END,
 '<a href="/maps/place/near', cast(c_custkey as string), '">y</a><a href="/other">z</a></div>',
 CASE c_custkey % 4 WHEN 0 THEN concat('<h1>Results</h1><h1 class="DUwDvf">', {_CARD_NAME}, '</h1>') WHEN 1 THEN concat('<h1 class="x fontHeadlineLarge"> ', {_CARD_NAME}, '</h1>') WHEN 2 THEN '<h1>N/A</h1>' ELSE '' END,
 CASE c_custkey % 3 WHEN 0 THEN concat('<button data-item-id="phone:tel:', cast(c_custkey as string), '" aria-label="Phone: +1 ', cast(c_custkey as string), '">t</button>') WHEN 1 THEN concat('<button aria-label="Phone" data-item-id="x">n</button><span aria-label="Mobile PHONE ', cast(c_custkey as string), '"></span>') ELSE '' END,
 CASE c_custkey % 2 WHEN 0 THEN concat('<button data-item-id="address" aria-label="Address: ', {_CARD_PLACE}, ' ">t</button>') ELSE concat('<div data-item-id="x-address-y">', {_CARD_PLACE}, '</div>') END,
 CASE c_custkey % 5 WHEN 0 THEN '<a data-item-id="authority">t</a><a aria-label="Website" href="https://late.example.com">t</a>' WHEN 1 THEN concat('<a aria-label="Our WEBSITE" href="https://s', cast(c_custkey as string), '.example.com/?a=1&amp;b=2">t</a>') ELSE '' END,
 CASE c_custkey % 3 WHEN 0 THEN '<div class="F7nice"><span aria-hidden="true">New</span></div><span aria-label="Five STARS">4,5</span>' WHEN 1 THEN '<div class="F7nice"><p><span aria-hidden="true"> 4.8 </span></p></div>' ELSE '' END,
 CASE c_custkey % 3 WHEN 0 THEN '<button class="DkEaL">Shop</button>' WHEN 1 THEN '<span class="YhemCb"> </span>' ELSE '' END,
 '</body></html>')"""


def spark_card_pages(spark, sf_dir, html):
    """Pages ``(page_id, url, html)`` of twenty customers each, cards in key order."""
    cards = customers(spark, sf_dir).selectExpr(
        f"c_custkey div {CARDS_PER_PAGE} AS page_id", "c_custkey", f"{html} AS card"
    )
    listed = F.array_sort(F.collect_list(F.struct("c_custkey", "card")))
    joined = F.array_join(F.transform(listed, lambda x: x["card"]), "\n")
    return cards.groupBy("page_id").agg(joined.alias("cards")).select(
        "page_id",
        F.concat(F.lit("https://dir.example.com/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body><ul>"), "cards", F.lit("</ul></body></html>")).alias("html"),
    )


def spark_map_pages(spark, sf_dir):
    return customers(spark, sf_dir).selectExpr(
        "c_custkey AS page_id", "'https://maps.example.com' AS url", f"{MAP_HTML} AS html"
    )


# Fields each card should give; NULL: no element found, no row: no card.
_SEEN_NAME = "concat('Firm & Co ', cast(c_custkey - c_custkey % 4 as string))"
LISTING_SEEN = f"""SELECT c_custkey // {CARDS_PER_PAGE} AS page_id, c_custkey, part,
  CASE WHEN c_custkey % 6 IN (0, 1, 3) THEN {_SEEN_NAME}
       WHEN c_custkey % 6 = 2 THEN concat({_SEEN_NAME}, {_CARD_PLACE}, ' 3.9')
       WHEN c_custkey % 6 = 5 THEN '' END AS name,
  CASE WHEN c_custkey % 6 IN (0, 5) THEN {_CARD_PHONE} WHEN c_custkey % 6 = 1 THEN concat({_CARD_PHONE}, ' ext') WHEN c_custkey % 6 = 4 THEN '000' END AS phone,
  CASE WHEN c_custkey % 6 IN (0, 1) THEN {_CARD_PLACE} WHEN c_custkey % 6 = 2 THEN concat({_CARD_PLACE}, ' 3.9') END AS address,
  CASE WHEN c_custkey % 6 = 0 THEN '4.1' WHEN c_custkey % 6 = 2 THEN '3.9' WHEN c_custkey % 6 = 3 AND part = 0 THEN '2.5' END AS rating
 FROM customer, (VALUES (0), (1)) AS p(part) WHERE part = 0 OR c_custkey % 6 = 3"""
SUPPLIER_SEEN = f"""SELECT c_custkey // {CARDS_PER_PAGE} AS page_id, c_custkey, 0 AS part,
  CASE WHEN c_custkey % 5 = 4 THEN 'N/A' ELSE {_SEEN_NAME} END AS name,
  CASE WHEN c_custkey % 5 < 3 THEN {_CARD_PHONE} END AS phone,
  CASE WHEN c_custkey % 5 < 2 THEN {_CARD_PLACE} END AS address,
  CAST(NULL AS VARCHAR) AS rating
 FROM customer WHERE c_custkey % 5 <> 3"""
_POS = "CAST(row_number() OVER (PARTITION BY page_id ORDER BY c_custkey, part) - 1 AS INTEGER)"
LISTING_CARDS = f"SELECT page_id, {_POS} AS card_pos, name, phone, address, rating FROM ({LISTING_SEEN})"
SUPPLIER_CARDS = f"SELECT page_id, {_POS} AS card_pos, name, phone, address, rating FROM ({SUPPLIER_SEEN})"
MAP_CARDS = f"""SELECT c_custkey AS page_id, 0 AS card_pos,
  CASE c_custkey % 4 WHEN 0 THEN {_SEEN_NAME} WHEN 1 THEN concat(' ', {_SEEN_NAME}) ELSE 'N/A' END AS name,
  CASE c_custkey % 3 WHEN 0 THEN concat('+1 ', cast(c_custkey as string)) WHEN 1 THEN cast(c_custkey as string) ELSE 'N/A' END AS phone,
  {_CARD_PLACE} AS address,
  CASE c_custkey % 5 WHEN 1 THEN concat('https://s', cast(c_custkey as string), '.example.com/?a=1&b=2') ELSE 'N/A' END AS website,
  CASE c_custkey % 3 WHEN 0 THEN '4,5' WHEN 1 THEN ' 4.8 ' ELSE 'N/A' END AS rating,
  CASE c_custkey % 3 WHEN 0 THEN 'Shop' WHEN 1 THEN ' ' ELSE 'N/A' END AS category
 FROM customer"""
