"""Every operator as a query over the given tables, with the SQL it must agree with."""

from pyspark.sql import functions as F

from checks import derived as D
from checks import sql as S
from leadloom import fixed_values as V
from leadloom.functions import features as FE
from leadloom.functions import grading as G
from leadloom.functions import pickers as PK
from leadloom.functions import text as TX
from leadloom.operators import batches as BA
from leadloom.operators import campaign as CA
from leadloom.operators import collect as CO
from leadloom.operators import contacts as CN
from leadloom.operators import leads as LE
from leadloom.operators import ranking as RA
from leadloom.operators import report as RE
from leadloom.operators import scoring as SC
from leadloom.operators import sinks as SI
from leadloom.plans import runs as RU
from leadloom.session import scratch_path, shared_dir
from leadloom.sources import cards as CD
from leadloom.sources import readers as RD
from leadloom.sources import seeds as SE
from leadloom.streaming import live as LI

QUERIES = {}
ORACLES = {}

SENDER = {
    "name": "Sam Doe",
    "company": "Acme & Co",
    "service": "teams <grow> faster",
    "website": "https://acme.example.com",
}
ORDER = ["google_maps", "justdial", "indiamart", "yellowpages", "clutch"]
CAP = 40
LIMIT = 5
TREES = V.TREES
QUERY = "digital marketing agency"
LEAD_LIST = ", ".join(D.LEAD_COLUMNS)


def query(name, sql=None):
    """Register the decorated function as a query, with its SQL if there is any."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def raw(spark, sf):
    return D.spark_raw_leads(spark, sf)


def leads(spark, sf):
    return LE.clean_leads(raw(spark, sf))


def scored(spark, sf):
    return SC.rule_scored(leads(spark, sf))


def labelled(spark, sf):
    return SC.generate_labels(SC.extract_features(leads(spark, sf)))


def contacts(spark, sf):
    return RD.read_contacts(D.spark_payloads(spark, sf))


def log(spark, sf):
    return D.spark_sent_log(spark, sf)


def eligible(spark, sf):
    return CA.eligible_leads(scored(spark, sf))


# --- text and score expressions -------------------------------------------------

_TEXT = [c for c in D.LEAD_COLUMNS if c != "lead_seq"]


def expression(name, column, sql, source="raw_leads", keep=()):
    """One expression over the raw, cleaned or scored leads, keyed by lead."""
    frames = {"raw_leads": raw, "leads": leads, "scored": scored, "labelled": labelled}

    @query(name, S.with_views(source, f"SELECT lead_seq, {''.join(k + ', ' for k in keep)}{sql} AS value FROM {source}"))
    def build(spark, sf):
        return frames[source](spark, sf).select("lead_seq", *keep, column().alias("value"))


@query("F01_clean", S.with_views("leads", f"SELECT {LEAD_LIST} FROM leads"))
def _(spark, sf):
    return raw(spark, sf).select("lead_seq", *[TX.clean(c).alias(c) for c in _TEXT])


@query("F01_clean_documents", f"SELECT doc_id, md5({S.clean('text')}) AS text_md5, CAST(length({S.clean('text')}) AS INTEGER) AS n FROM documents")
def _(spark, sf):
    text = TX.clean("text")
    return D.table(spark, sf, "documents").select("doc_id", F.md5(text).alias("text_md5"), F.length(text).alias("n"))


@query(
    "F02_strip",
    S.with_views("raw_leads", f"SELECT lead_seq, {S.strip('business_name')} AS business_name, {S.strip('rating')} AS rating FROM raw_leads"),
)
def _(spark, sf):
    return raw(spark, sf).select("lead_seq", *[TX.strip(c).alias(c) for c in ("business_name", "rating")])


expression("F03_website_domain", lambda: TX.website_domain("website"), S.domain("website"))
expression("F05_rating_score", lambda: FE.rating_score("rating"), S.rating("rating"))
expression("F06_source_score", lambda: FE.source_score("source"), S.trust("source"))
expression("F07_name_length", lambda: FE.name_length("business_name"), S.name_length("business_name"))
expression("F08_name_word_count", lambda: FE.name_word_count("business_name"), S.word_count("business_name"))
expression("F09_category_score", lambda: FE.category_score("business_name", "category"), S.category("business_name", "category"))
expression("F10_address_completeness", lambda: FE.address_completeness("address"), S.address("address"))
expression("F13_rule_label", lambda: FE.rule_label("rule_score"), "CAST(rule_score > 45 AS INTEGER)", "labelled", ["rule_score"])
expression("F12_rule_score", lambda: FE.rule_score(), S._RULES, "labelled")
expression("F14_title_case", lambda: TX.title_case(F.concat(F.lit("b2b it's "), "category")), S.title("concat('b2b it''s ', category)"))
expression("F16_round1", lambda: G.round1("rule_score"), S.round1("rule_score"), "labelled")
expression("F17_grade", lambda: G.grade("ml_score"), S.grade("ml_score"), "scored", ["ml_score"])
expression("F18_recommend", lambda: G.recommend("ml_score"), "ml_score >= 50", "scored", ["ml_score"])
expression("F19_city_guess", lambda: TX.city_guess("address"), S.city("address"), "leads")
expression("F25_yes_no", lambda: TX.yes_no("ml_recommend"), f"CASE WHEN ml_recommend THEN {S.q(V.YES_TEXT)} ELSE {S.q(V.NO_TEXT)} END", "scored")


@query(
    "F04_has_value",
    S.with_views("raw_leads", "SELECT lead_seq, " + ", ".join(f"{S.has(c)} AS has_{c}" for c in ("email", "phone", "website", "address")) + " FROM raw_leads"),
)
def _(spark, sf):
    return raw(spark, sf).select("lead_seq", *[TX.has_value(c).alias(f"has_{c}") for c in ("email", "phone", "website", "address")])


@query("F11_data_completeness", S.with_views("features", "SELECT lead_seq, data_completeness FROM features"))
def _(spark, sf):
    flags = [TX.has_value(c) for c in ("email", "phone", "website", "address")]
    return leads(spark, sf).select("lead_seq", FE.data_completeness(*flags).alias("data_completeness"))


_SLUG = {
    "google_maps": "concat('https://www.google.com/maps/search/', replace(concat(query, ' in ', location), ' ', '+'))",
    "justdial": "concat('https://www.justdial.com/', replace(location, ' ', '-'), '/', " + S.title("replace(query, ' ', '-')") + ")",
    "indiamart": "concat('https://dir.indiamart.com/search.mp?ss=', replace(" + S.strip("concat(query, ' ', location)") + ", ' ', '+'))",
}
_SEARCHES = "SELECT DISTINCT concat(lower(c_mktsegment), ' b2b agency') AS query, n_name AS location FROM customer JOIN nation ON c_nationkey = n_nationkey"
_SEED_SQL = f"WITH searches AS ({_SEARCHES}) " + " UNION ALL ".join(
    f"SELECT query, location, '{s}' AS source, {e} AS url FROM searches" for s, e in _SLUG.items()
)


def searches(spark, sf):
    customer, nation = D.table(spark, sf, "customer"), D.table(spark, sf, "nation")
    pairs = customer.select("c_nationkey", "c_mktsegment").distinct()
    return pairs.join(nation, pairs.c_nationkey == nation.n_nationkey).select(
        F.concat(F.lower("c_mktsegment"), F.lit(" b2b agency")).alias("query"), F.col("n_name").alias("location")
    )


@query("S07_seed_urls", _SEED_SQL)
def _(spark, sf):
    return SE.seed_urls(searches(spark, sf))


@query("F15_seed_url", f"WITH searches AS ({_SEARCHES}) SELECT query, location, {_SLUG['justdial']} AS url FROM searches")
def _(spark, sf):
    return searches(spark, sf).select("query", "location", TX.seed_url(F.lit("justdial"), "query", "location").alias("url"))


@query("F20_preview", "SELECT doc_id, concat(substring(text, 1, 80), '...') AS preview FROM documents")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.preview("text").alias("preview"))


_TEMPLATE = f"{S.template_subject('business_name')} AS subject, {S.template_body('business_name', 'address', SENDER)} AS body"


@query("F21_template", S.with_views("leads", f"SELECT lead_seq, {_TEMPLATE} FROM leads"))
def _(spark, sf):
    message = TX.template("business_name", "address", SENDER)
    return leads(spark, sf).select("lead_seq", message.alias("m")).select("lead_seq", "m.subject", "m.body")


_PROMPT = S.filled(
    V.PROMPT_TEXT,
    **{c: c for c in ("business_name", "category", "address", "rating", "website", "ml_grade")},
    ml_score="CAST(ml_score AS VARCHAR)",
    sender=S.q(SENDER["name"]), company=S.q(SENDER["company"]), service=S.q(SENDER["service"]), site=S.q(SENDER["website"]),
)


@query("F22_prompt", S.with_views("scored", f"SELECT lead_seq, {_PROMPT} AS prompt FROM scored"))
def _(spark, sf):
    df = scored(spark, sf)
    return df.select("lead_seq", TX.prompt(df.columns, SENDER).alias("prompt"))


def _html_sql(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    return S.filled(V.HTML_MESSAGE, body=x)


@query("F23_html_body", f"SELECT doc_id, {_html_sql('text')} AS html FROM documents")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.html_body("text").alias("html"))


@query("F24_log_time", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS logged FROM orders")
def _(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", TX.log_time("o_orderdate").alias("logged"))


@query(
    "F26_zero_fill",
    f"SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN CASE WHEN isnan(z) THEN 0e0 ELSE z END ELSE s_acctbal END, 0e0) AS value FROM (SELECT *, CAST('NaN' AS DOUBLE) AS z FROM supplier)",
)
def _(spark, sf):
    gaps = F.when(F.col("s_suppkey") % 3 == 1, float("nan")).when(F.col("s_suppkey") % 3 == 2, F.col("s_acctbal"))
    return D.table(spark, sf, "supplier").select("s_suppkey", FE.zero_fill(gaps).alias("value"))


_T = S.strip("replace(replace(response, '```json', ''), '```', '')")
_USABLE = f"CASE WHEN json_valid({_T}) THEN json_type({_T}) = 'OBJECT' ELSE false END"
_PARSED = (
    f"CASE WHEN {_USABLE} THEN coalesce(json_extract_string({_T}, '$.subject'), concat('Quick question about ', business_name)) ELSE {S.template_subject('business_name')} END AS subject, "
    f"CASE WHEN {_USABLE} THEN coalesce(json_extract_string({_T}, '$.body'), '') ELSE {S.template_body('business_name', 'address', SENDER)} END AS body"
)


@query("F27_parse_message", S.with_views("leads", "responses", f"SELECT lead_seq, {_PARSED} FROM leads JOIN responses USING (lead_seq)"))
def _(spark, sf):
    both = leads(spark, sf).join(D.spark_responses(spark, sf), "lead_seq")
    fallback = TX.template("business_name", "address", SENDER)
    message = TX.parse_message("response", "business_name", fallback)
    return both.select("lead_seq", message.alias("m")).select("lead_seq", "m.subject", "m.body")


# --- sources ---------------------------------------------------------------------

_LEADS_AS_READ = "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in _TEXT) + " FROM raw_leads"


@query("S01_read_leads_csv", S.with_views("raw_leads", _LEADS_AS_READ))
def _(spark, sf):
    path = scratch_path(spark, "leads-csv")
    raw(spark, sf).select(*_TEXT).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return RD.read_leads_csv(spark, path).select(*_TEXT)


@query("S01_csv_keys", S.with_views("raw_leads", "SELECT row_number() OVER (ORDER BY lead_seq) - 1 AS lead_seq, nullif(business_name, '') AS business_name FROM raw_leads"))
def _(spark, sf):
    path = scratch_path(spark, "leads-csv")
    ordered = raw(spark, sf).repartitionByRange(5, "lead_seq").sortWithinPartitions("lead_seq")
    ordered.select(*_TEXT).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return RD.read_leads_csv(spark, path).select("lead_seq", "business_name")


@query("S03_read_pages", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def _(spark, sf):
    return RD.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.md5("html").alias("html_md5"))


@query("S04_read_contacts", S.with_views("contacts", "SELECT domain, lookup_seq, CAST(CASE WHEN value = 'z@z.example.com' THEN 1 ELSE 0 END AS INTEGER) AS pos, value, CAST(confidence AS DOUBLE) AS confidence FROM contacts"))
def _(spark, sf):
    return contacts(spark, sf)


_LOG_SQL = "SELECT strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS timestamp, to_email, 'Biz' AS business_name, 'Hello' AS subject, 50e0 AS ml_score, 'C' AS ml_grade, status FROM sent_log"


def full_log(spark, sf):
    return log(spark, sf).select(
        TX.log_time("sent_at").alias("timestamp"), "to_email", F.lit("Biz").alias("business_name"),
        F.lit("Hello").alias("subject"), F.lit(50.0).alias("ml_score"), F.lit("C").alias("ml_grade"), "status",
    )


@query("S05_read_log", S.with_views("sent_log", _LOG_SQL))
def _(spark, sf):
    path = scratch_path(spark, "log")
    missing = RD.read_log(spark, path)
    SI.append_log(full_log(spark, sf), path, "first")
    return missing.unionByName(RD.read_log(spark, path))


@query("S05_skip_batch_of_plain_log", S.with_views("sent_log", _LOG_SQL))
def _(spark, sf):
    path = scratch_path(spark, "log")
    full_log(spark, sf).write.parquet(path)
    SI.append_log(full_log(spark, sf), path, "again")
    return RD.read_log(spark, path, skip_batch="again")


@query("S06_read_responses", S.with_views("responses", "SELECT lead_seq, response FROM responses"))
def _(spark, sf):
    return RD.read_responses(D.spark_responses(spark, sf))


@query("S08_enabled_sources", S.with_views("raw_leads", "SELECT lead_seq, source FROM raw_leads WHERE source IN ('google_maps', 'indiamart')"))
def _(spark, sf):
    return RD.enabled_sources(raw(spark, sf), ["google_maps", "indiamart"]).select("lead_seq", "source")


# --- cards -----------------------------------------------------------------------

def _cards(spark, sf, site):
    html = D.LISTING_HTML if site is V.LISTING_SITE else D.SUPPLIER_HTML
    return CD.extract_cards(D.spark_card_pages(spark, sf, html), site, spark.sparkContext.defaultParallelism)


@query("E01_extract_cards", f"SELECT page_id, card_pos FROM ({D.LISTING_CARDS})")
def _(spark, sf):
    return _cards(spark, sf, V.LISTING_SITE).select("page_id", "card_pos")


@query("E01_supplier_cards", f"SELECT page_id, card_pos, name, phone, address FROM ({D.SUPPLIER_CARDS})")
def _(spark, sf):
    picks = {"name": "names", "phone": "phones", "address": "addresses"}
    return _cards(spark, sf, V.SUPPLIER_SITE).select(
        "page_id", "card_pos", *[TX.strip(F.get(a, F.lit(0))).alias(n) for n, a in picks.items()]
    )


@query("E01_listing_links", "SELECT c_custkey AS page_id, 0 AS link_pos, CASE WHEN c_custkey % 3 = 0 THEN concat('/maps/place/', CAST(c_custkey AS VARCHAR)) ELSE concat('/maps/place/near', CAST(c_custkey AS VARCHAR)) END AS href FROM customer")
def _(spark, sf):
    return CD.listing_links(D.spark_map_pages(spark, sf), V.MAP_SITE)


@query("E02_card_fields", f"SELECT page_id, card_pos, name, phone, address, rating FROM ({D.LISTING_CARDS})")
def _(spark, sf):
    picks = {"name": "names", "phone": "phones", "address": "addresses", "rating": "ratings"}
    return _cards(spark, sf, V.LISTING_SITE).select(
        "page_id", "card_pos", *[TX.strip(F.get(a, F.lit(0))).alias(n) for n, a in picks.items()]
    )


def picked(name, column, sql):
    @query(name, S.with_views("raw_cards", f"SELECT page_id, {sql} AS value FROM raw_cards"))
    def build(spark, sf):
        return D.spark_raw_cards(spark, sf).select("page_id", column().alias("value"))


_KEPT = "[trim(regexp_replace(x, '[^0-9+\\-\\s()]', '', 'g')) FOR x IN phones]"
picked("E03_first_hit", lambda: PK.first_hit("names"), f"coalesce({S.strip('names[1]')}, 'N/A')")
picked("E04_pick_phone", lambda: PK.pick_phone("phones"), f"coalesce(list_extract([y FOR y IN {_KEPT} IF y <> ''], 1), CASE WHEN len(phones) > 0 THEN '' ELSE 'N/A' END)")
picked("E05_pick_address", lambda: PK.pick_address("addresses"), "coalesce(trim(replace(addresses[1], 'Address: ', '')), 'N/A')")
picked("E06_pick_website", lambda: PK.pick_website("websites"), "coalesce(nullif(websites[1], ''), 'N/A')")
picked("E07_pick_rating", lambda: PK.pick_rating("ratings"), "coalesce(list_extract([x FOR x IN ratings IF regexp_matches(x, '[0-9]')], 1), 'N/A')")
picked(
    "E08_pick_category", lambda: PK.pick_category("categories", "query"),
    f"CASE WHEN coalesce(categories[1], 'N/A') = 'N/A' THEN query ELSE {S.clean('categories[1]')} END",
)

def _site_leads(site, cards, website="'N/A'", rating="'N/A'", category=S.q(QUERY)):
    first = ORDER.index(site) * 2**60
    return (
        f"SELECT {first} + page_id * 1048576 + card_pos AS lead_seq, '{site}' AS source, coalesce(name, 'N/A') AS business_name, 'N/A' AS email, "
        f"coalesce(phone, 'N/A') AS phone, coalesce(address, 'N/A') AS address, {website} AS website, "
        f"{category} AS category, {rating} AS rating FROM ({cards})"
    )


_MAP_LEADS = _site_leads(
    "google_maps", D.MAP_CARDS, "website", "rating",
    f"CASE WHEN category = 'N/A' THEN {S.q(QUERY)} ELSE {S.clean('category')} END",
)
_LISTING_LEADS = _site_leads("justdial", D.LISTING_CARDS, rating="coalesce(rating, 'N/A')")
_SUPPLIER_LEADS = _site_leads("indiamart", D.SUPPLIER_CARDS)


@query("E09_to_leads", f"{_MAP_LEADS} UNION ALL {_LISTING_LEADS} UNION ALL {_SUPPLIER_LEADS}")
def _(spark, sf):
    on_map = CD.extract_cards(D.spark_map_pages(spark, sf), V.MAP_SITE)
    frames = [(on_map, V.MAP_SITE), *[(_cards(spark, sf, s), s) for s in (V.LISTING_SITE, V.SUPPLIER_SITE)]]
    return LE.union_sources(*[LE.to_leads(c, s, QUERY) for c, s in frames])


def _inner(tag):
    return S.clean(f"regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1)")


_LINKS = "regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)"


@query(
    "E10_page_fields",
    f"SELECT page_id, {S.domain('url')} AS domain, {_inner('title')} AS title, {_inner('h1')} AS name, "
    f"CAST(len({_LINKS}) AS INTEGER) AS links, coalesce(nullif({_LINKS}[1], ''), 'N/A') AS website FROM pages",
)
def _(spark, sf):
    return CD.page_fields(RD.read_pages(spark, f"{sf}/pages.parquet"))


# --- filters and projections -------------------------------------------------------

@query("P01_clean_leads", S.with_views("leads", f"SELECT {LEAD_LIST} FROM leads"))
def _(spark, sf):
    return leads(spark, sf)


@query("P02_require_name", S.with_views("raw_cards", f"SELECT page_id, {S.clean('names[1]')} AS business_name FROM raw_cards WHERE coalesce({S.strip('names[1]')}, 'N/A') <> 'N/A'"))
def _(spark, sf):
    named = D.spark_raw_cards(spark, sf).select("page_id", PK.first_hit("names").alias("business_name"))
    return LE.clean_leads(LE.require_name(named))


@query("P03_with_website", S.with_views("leads", "SELECT lead_seq, website FROM leads WHERE website <> 'N/A'"))
def _(spark, sf):
    return LE.with_website(leads(spark, sf)).select("lead_seq", "website")


@query("P04_with_email", S.with_views("leads", "SELECT lead_seq, email FROM leads WHERE email <> 'N/A'"))
def _(spark, sf):
    return LE.with_email(leads(spark, sf)).select("lead_seq", "email")


@query("P05_min_grade", S.with_views("scored", "SELECT lead_seq, ml_grade, 'C' AS lowest FROM scored WHERE ml_grade IN ('A', 'B', 'C') UNION ALL SELECT lead_seq, ml_grade, 'unknown' FROM scored WHERE ml_grade IN ('A', 'B')"))
def _(spark, sf):
    shared_dir(spark)
    # Read by both requests.
    df = scored(spark, sf).select("lead_seq", "ml_grade").checkpoint()
    return CA.min_grade(df, "C").withColumn("lowest", F.lit("C")).unionByName(
        CA.min_grade(df, "unknown").withColumn("lowest", F.lit("unknown"))
    )


@query("P06_export_columns", S.with_views("leads", f"SELECT {', '.join(c for c in V.EXPORT_ORDER if c != 'rating')} FROM leads"))
def _(spark, sf):
    return LE.export_columns(leads(spark, sf).drop("rating"))


@query(
    "P07_presentation",
    S.with_views("scored", "SELECT " + ", ".join(
        (f"CASE WHEN ml_recommend THEN {S.q(V.YES_TEXT)} ELSE {S.q(V.NO_TEXT)} END" if c == "ml_recommend" else c) + f' AS "{V.SCORED_LABELS[c]}"'
        for c in V.SCORED_ORDER
    ) + " FROM scored"),
)
def _(spark, sf):
    return RE.presentation(scored(spark, sf))


@query("P07_plain_labels", S.with_views("leads", "SELECT " + ", ".join(f'{c} AS "{V.EXPORT_LABELS[c]}"' for c in V.EXPORT_ORDER) + " FROM leads"))
def _(spark, sf):
    return RE.labelled_export(leads(spark, sf))


@query("P08_recommended", S.with_views("scored", "SELECT lead_seq, ml_score FROM scored WHERE ml_recommend"))
def _(spark, sf):
    return SC.recommended(scored(spark, sf)).select("lead_seq", "ml_score")


# --- joins -------------------------------------------------------------------------

@query(
    "J01_enrich",
    S.with_views("leads", "best", f"SELECT lead_seq, website, CASE WHEN website <> 'N/A' AND b.domain IS NOT NULL THEN coalesce(best_email, 'N/A') ELSE email END AS email FROM leads LEFT JOIN best b ON b.domain = {S.domain('website')}"),
)
def _(spark, sf):
    return CN.enrich(leads(spark, sf), contacts(spark, sf)).select("lead_seq", "website", "email")


@query("J02_suppress", S.with_views("leads", "sent_log", "SELECT lead_seq, email FROM leads WHERE email <> 'N/A' AND email NOT IN (SELECT to_email FROM sent_log)"))
def _(spark, sf):
    return CA.suppress(LE.with_email(leads(spark, sf)), log(spark, sf)).select("lead_seq", "email")


@query("J03_unseen_names", S.with_views("leads", "SELECT lead_seq, business_name FROM leads WHERE source = 'justdial' AND business_name NOT IN (SELECT business_name FROM leads WHERE source = 'google_maps')"))
def _(spark, sf):
    df = leads(spark, sf).select("lead_seq", "source", "business_name")
    return CO.unseen_names(df.where("source = 'justdial'"), df.where("source = 'google_maps'")).select("lead_seq", "business_name")


_FED = "SELECT lead_seq, CAST(coalesce(v, label) AS INTEGER) AS label FROM labelled LEFT JOIN (SELECT lead_seq, min(label) AS v FROM feedback GROUP BY lead_seq) USING (lead_seq)"


@query("J04_apply_feedback", S.with_views("labelled", "feedback", _FED))
def _(spark, sf):
    return SC.apply_feedback(labelled(spark, sf), D.spark_feedback(spark, sf)).select("lead_seq", "label")


@query("J05_source_score", S.with_views("leads", f"SELECT DISTINCT source, {S.trust('source')} AS trust FROM leads"))
def _(spark, sf):
    return leads(spark, sf).select("source", FE.source_score("source").alias("trust")).distinct()


@query(
    "J06_attach_messages",
    S.with_views("leads", "some_responses", f"SELECT lead_seq, {_PARSED} FROM leads LEFT JOIN some_responses USING (lead_seq)"),
)
def _(spark, sf):
    return CA.attach_messages(leads(spark, sf), D.spark_some_responses(spark, sf), SENDER).select("lead_seq", "subject", "body")


# --- counts ------------------------------------------------------------------------

_SUMMARY = ", ".join(f"count(*) FILTER (ml_grade = '{g}') AS grade_{g.lower()}" for g in "ABCD")


@query("A01_grade_summary", S.with_views("scored", f"SELECT {_SUMMARY}, count(*) FILTER (ml_recommend) AS recommended FROM scored"))
def grade_summary(spark, sf):
    return SC.grade_summary(scored(spark, sf))


@query("A02_recommended_count", S.with_views("scored", "SELECT count(*) FILTER (ml_recommend) AS recommended FROM scored"))
def _(spark, sf):
    return SC.grade_summary(scored(spark, sf)).select("recommended")


@query("A03_label_balance", S.with_views("labelled", "SELECT count(*) FILTER (label = 1) AS good, count(*) FILTER (label = 0) AS low FROM labelled"))
def _(spark, sf):
    return SC.label_balance(labelled(spark, sf))


@query("A04_dedupe_leads", S.with_views("leads", f"SELECT {LEAD_LIST} FROM (SELECT *, row_number() OVER (PARTITION BY business_name, phone ORDER BY lead_seq) AS n FROM leads) WHERE n = 1"))
def _(spark, sf):
    return LE.dedupe_leads(leads(spark, sf))


@query("A05_dedupe_stats", S.with_views("leads", "SELECT count(*) AS before, count(DISTINCT (business_name, phone)) AS kept, count(*) - count(DISTINCT (business_name, phone)) AS removed FROM leads"))
def _(spark, sf):
    return LE.dedupe_stats(leads(spark, sf))


@query("A06_email_coverage", S.with_views("leads", "SELECT count(*) FILTER (email <> 'N/A') AS with_email FROM leads"))
def _(spark, sf):
    return LE.email_coverage(leads(spark, sf))


@query("A07_campaign_funnel", S.with_views("scored", "SELECT count(*) AS total, count(*) FILTER (ml_grade IN ('A','B')) AS graded, count(*) FILTER (ml_grade IN ('A','B') AND email <> 'N/A') AS with_email FROM scored"))
def _(spark, sf):
    return CA.campaign_funnel(scored(spark, sf))


_OUTCOME = "CASE WHEN lead_seq % 4 = 0 THEN 'failed' ELSE 'sent' END"
_SUCCESS = f"(fresh AND {_OUTCOME} <> 'failed')"
_TALLY = "SELECT count(*) FILTER (disposition = 'selected') AS sent, count(*) FILTER (disposition = 'skipped') AS skipped, count(*) FILTER (disposition = 'failed') AS failed"


@query("A08_campaign_tally", S.with_views("heads", f"{_TALLY} FROM ({S.dispositions(LIMIT, _SUCCESS)})"))
def _(spark, sf):
    df = eligible(spark, sf).withColumn("status", F.expr(_OUTCOME))
    return CA.campaign_tally(CA.select_campaign(df, log(spark, sf), LIMIT, "status"))


def _report_sql(pairs):
    def share(a, b):
        return f"CASE WHEN ({b}) = 0 THEN 0e0 ELSE ({a}) / CAST(({b}) AS DOUBLE) END"

    n = ", ".join(f"count(*) FILTER (label = {l} AND prediction = {p}) AS n{l}{p}" for l in (0, 1) for p in (0, 1))
    per = {
        l: {
            "precision": share(f"n{l}{l}", f"n{l}{l} + n{1 - l}{l}"),
            "recall": share(f"n{l}{l}", f"n{l}{l} + n{l}{1 - l}"),
            "f1": share(f"2 * n{l}{l}", f"2 * n{l}{l} + n{1 - l}{l} + n{l}{1 - l}"),
        }
        for l in (0, 1)
    }
    sup = {l: f"(n{l}0 + n{l}1)" for l in (0, 1)}
    total, rows = "(n00 + n01 + n10 + n11)", []
    for l, name in V.CLASS_NAMES.items():
        rows.append((name, per[l], sup[l]))
    accuracy = share("n00 + n11", total)
    rows.append(("accuracy", dict.fromkeys(per[0], accuracy), total))
    rows.append(("macro avg", {m: f"({per[0][m]} + {per[1][m]}) / 2e0" for m in per[0]}, total))
    rows.append(("weighted avg", {m: share(f"{per[0][m]} * {sup[0]} + {per[1][m]} * {sup[1]}", total) for m in per[0]}, total))
    body = " UNION ALL ".join(
        f"SELECT {S.q(name)} AS name, " + ", ".join(f"{e} AS {m}" for m, e in ms.items()) + f", {s} AS support FROM counts"
        for name, ms, s in rows
    )
    return f", counts AS (SELECT {n} FROM ({pairs})) {body}"


@query("A09_classification_report", S.with_views("scored", "labelled", "feedback", _report_sql(f"SELECT f.label, CAST(ml_recommend AS INTEGER) AS prediction FROM ({_FED}) f JOIN scored USING (lead_seq)")))
def _(spark, sf):
    truth = SC.apply_feedback(labelled(spark, sf), D.spark_feedback(spark, sf)).select("lead_seq", "label", "rule_score")
    guess = G.recommend(G.round1("rule_score")).cast("double").alias("prediction")
    return SC.classification_report(truth.select("label", guess))


def _width_sql(order, labels, cap):
    rows = []
    for c in order:
        top = min(50, cap) if c in V.WIDE_COLUMNS else 50
        rows.append(
            f"SELECT '{c}' AS name, CAST(least({top}, greatest(12, {len(labels[c]) + 4}, coalesce(max(length(CAST({c} AS VARCHAR))) + 2, 0))) AS INTEGER) AS width FROM shown"
        )
    return " UNION ALL ".join(rows)


@query("A10_width_profile", S.with_views("leads", f", shown AS (SELECT * FROM leads) {_width_sql(V.EXPORT_ORDER, V.EXPORT_LABELS, 45)}"))
def _(spark, sf):
    return RE.width_profile(leads(spark, sf))


@query("A10_scored_widths", S.with_views("scored", f", shown AS (SELECT * FROM scored) {_width_sql(V.SCORED_ORDER, V.SCORED_LABELS, 40)}"))
def _(spark, sf):
    return RE.width_profile(scored(spark, sf), V.SCORED_WIDE_CAP)


@query("A11_source_counts", S.with_views("leads", "SELECT source, count(*) AS collected FROM leads GROUP BY source"))
def _(spark, sf):
    return LE.source_counts(leads(spark, sf))


@query("A12_eligible_count", S.with_views("leads", "SELECT count(*) FILTER (website <> 'N/A') AS eligible FROM leads"))
def _(spark, sf):
    return LE.eligible_count(leads(spark, sf))


# --- order-dependent operators -------------------------------------------------------

@query("W01_first_occurrences", S.with_views("leads", "SELECT source, business_name, min(lead_seq) AS lead_seq FROM leads GROUP BY source, business_name"))
def _(spark, sf):
    return CO.first_occurrences(leads(spark, sf)).select("source", "business_name", "lead_seq")


def _collect_sql(order, cap, columns=LEAD_LIST):
    steps, body = S.collected(order, cap)
    return S.with_views("leads", f", {steps} SELECT {columns} FROM leads WHERE lead_seq IN ({body})")


@query("W02_collect", _collect_sql(ORDER, CAP))
def _(spark, sf):
    return CO.collect(leads(spark, sf), ORDER, CAP)


@query("O02_source_cap", _collect_sql(ORDER[:1], 7, "lead_seq, source, business_name"))
def _(spark, sf):
    return CO.collect(leads(spark, sf), ORDER[:1], 7).select("lead_seq", "source", "business_name")


@query("W02_collect_cap_2000", _collect_sql(ORDER, 2000, "lead_seq, source, business_name"))
def _(spark, sf):
    return CO.collect(leads(spark, sf), ORDER, 2000).select("lead_seq", "source", "business_name")


@query("W02_collect_large_cap", _collect_sql(ORDER, 10**6, "lead_seq, source, business_name"))
def _(spark, sf):
    return CO.collect(leads(spark, sf), ORDER, 10**6).select("lead_seq", "source", "business_name")


@query("W03_best_contact", S.with_views("best", "SELECT domain, best_email FROM best"))
def _(spark, sf):
    return CN.best_contact(contacts(spark, sf))


@query("W04_select_campaign", S.with_views("heads", f"SELECT lead_seq, email, ml_score, disposition FROM ({S.dispositions(LIMIT)})"))
def _(spark, sf):
    return CA.select_campaign(eligible(spark, sf), log(spark, sf), LIMIT).select("lead_seq", "email", "ml_score", "disposition")


# Scores that one decimal place does not tell apart.
_FINE = "ml_score + (lead_seq % 997) / 100000.0"


def _fine_sql(limit):
    fine = f"fine AS (SELECT * REPLACE ({_FINE} AS ml_score) FROM eligible)"
    heads = S.CTES["heads"].replace("FROM eligible", "FROM fine")
    return S.with_views("eligible", "sent_log", f", {fine}, heads AS ({heads}) SELECT lead_seq, disposition FROM ({S.dispositions(limit)})")


def _fine(spark, sf, limit, top_list=None):
    fine = eligible(spark, sf).withColumn("ml_score", F.expr(_FINE.replace("100000.0", "100000.0D")))
    return CA.select_campaign(fine, log(spark, sf), limit, top_list=top_list).select("lead_seq", "disposition")


@query("W04_fine_scores", _fine_sql(LIMIT))
def _(spark, sf):
    return _fine(spark, sf, LIMIT)


@query("W04_large_limit", _fine_sql(CA.SMALL_LIMIT + 1))
def _(spark, sf):
    return _fine(spark, sf, CA.SMALL_LIMIT + 1)


@query("W04_cut_by_counting", _fine_sql(3 * LIMIT))
def _(spark, sf):
    return _fine(spark, sf, 3 * LIMIT, top_list=0)


# Every lead twice, the second time a little worse, and all under seven numbers.
_TWICE = "SELECT * REPLACE (lead_seq % 7 AS lead_seq, {score} AS ml_score) FROM eligible UNION ALL SELECT * REPLACE (lead_seq % 7 AS lead_seq, {score} - 1e-6 AS ml_score) FROM eligible"


def _twice_sql():
    twice = f"twice AS ({_TWICE.format(score=_FINE)})"
    heads = (
        "SELECT *, row_number() OVER (PARTITION BY email ORDER BY ml_score DESC, lead_seq) = 1 "
        "AND email NOT IN (SELECT to_email FROM sent_log) AS fresh FROM twice"
    )
    return S.with_views("eligible", "sent_log", f", {twice}, heads AS ({heads}) SELECT lead_seq, email, disposition FROM ({S.dispositions(LIMIT)})")


@query("W04_repeated_numbers", _twice_sql())
def _(spark, sf):
    fine = eligible(spark, sf).withColumn("ml_score", F.expr(_FINE.replace("100000.0", "100000.0D")))
    alike = fine.withColumn("lead_seq", F.col("lead_seq") % 7)
    worse = alike.withColumn("ml_score", F.col("ml_score") - 1e-6)
    return CA.select_campaign(alike.unionByName(worse), log(spark, sf), LIMIT).select("lead_seq", "email", "disposition")


@query("W05_first_per_email", S.with_views("scored", "SELECT lead_seq, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ml_score DESC, lead_seq) AS n FROM scored WHERE email <> 'N/A') WHERE n = 1"))
def _(spark, sf):
    return CA.first_per_email(LE.with_email(scored(spark, sf))).select("lead_seq", "email")


@query("W06_with_rank", S.with_views("scored", "SELECT lead_seq, ml_score, row_number() OVER (ORDER BY ml_score DESC, lead_seq) - 1 AS rank FROM scored"))
def _(spark, sf):
    return RA.with_rank(scored(spark, sf).select("lead_seq", "ml_score"))


@query("W06_rank_with_missing_scores", S.with_views("scored", ", gaps AS (SELECT lead_seq, CASE WHEN lead_seq % 7 > 0 THEN ml_score END AS ml_score FROM scored) SELECT lead_seq, ml_score, row_number() OVER (ORDER BY ml_score DESC NULLS LAST, lead_seq) - 1 AS rank FROM gaps"))
def _(spark, sf):
    gaps = scored(spark, sf).select("lead_seq", F.when(F.col("lead_seq") % 7 > 0, F.col("ml_score")).alias("ml_score"))
    return RA.with_rank(gaps)


@query("O01_rank_leads", S.with_views("scored", "SELECT lead_seq, business_name, ml_score FROM scored ORDER BY ml_score DESC, lead_seq"))
def _(spark, sf):
    return RA.rank_leads(scored(spark, sf)).select("lead_seq", "business_name", "ml_score")


@query("O03_run_limit", S.with_views("eligible", "SELECT lead_seq, 'beyond_limit' AS disposition FROM eligible"))
def _(spark, sf):
    return CA.select_campaign(eligible(spark, sf), log(spark, sf), 0).select("lead_seq", "disposition")


@query("U01_union_sources", S.with_views("raw_leads", f"SELECT {LEAD_LIST} FROM raw_leads WHERE source = 'clutch' UNION ALL SELECT {LEAD_LIST} FROM raw_leads WHERE source <> 'justdial'"))
def _(spark, sf):
    df = raw(spark, sf)
    return LE.union_sources(df.where("source = 'clutch'"), df.where("source <> 'justdial'"))


# Subjects of generated messages where there is one that can be read.
_ENTRIES = f"""SELECT '2026-01-02 03:04:05' AS timestamp, email AS to_email, business_name, subject, ml_score, ml_grade, 'dry_run' AS status
 FROM (SELECT *, {_PARSED} FROM ({S.dispositions(LIMIT)}) LEFT JOIN responses USING (lead_seq)) WHERE disposition = 'selected'"""


def _entries(spark, sf):
    chosen = CA.select_campaign(eligible(spark, sf), log(spark, sf), LIMIT).where("disposition = 'selected'")
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    return CA.log_entries(CA.attach_messages(chosen, D.spark_responses(spark, sf), SENDER), at, "dry_run")


@query("U02_join_log", S.with_views("heads", "responses", f"{_LOG_SQL} UNION ALL {_ENTRIES}"))
def _(spark, sf):
    return CA.join_log(full_log(spark, sf), _entries(spark, sf))


# --- model -------------------------------------------------------------------------

@query("M01_extract_features", S.with_views("features", "SELECT * FROM features"))
def _(spark, sf):
    return SC.extract_features(leads(spark, sf))


@query("M02_generate_labels", S.with_views("labelled", "SELECT lead_seq, rule_score, label FROM labelled"))
def _(spark, sf):
    return labelled(spark, sf).select("lead_seq", "rule_score", "label")


@query(
    "M03_split",
    S.with_views("raw_leads", "SELECT lead_seq, row_number() OVER (ORDER BY md5(concat('42:', CAST(lead_seq AS VARCHAR))), lead_seq) <= ceil(0.2 * (SELECT count(*) FROM raw_leads)) AS in_test FROM raw_leads"),
)
def _(spark, sf):
    rest, test = SC.split(raw(spark, sf).select("lead_seq"))
    return rest.withColumn("in_test", F.lit(False)).unionByName(test.withColumn("in_test", F.lit(True)))


_MODELS = {}


def trained_model(spark, sf):
    """The model of the leads; fitted once per session and folder, since several queries look at it."""
    key = spark.sparkContext.applicationId, sf
    if key not in _MODELS:
        _MODELS[key] = SC.train(leads(spark, sf), TREES)
    return _MODELS[key]


@query("M04_train")
def _(spark, sf):
    trained = trained_model(spark, sf)
    weights = trained.model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w), trained.single_class) for n, w in zip(V.FEATURE_COLUMNS, weights)]
    return spark.createDataFrame(rows, "feature string, importance double, single_class boolean")


@query("M05_evaluate")
def _(spark, sf):
    return trained_model(spark, sf).report


_IN_TEST = "SELECT lead_seq, row_number() OVER (ORDER BY md5(concat('42:', CAST(lead_seq AS VARCHAR))), lead_seq) <= ceil(0.2 * (SELECT count(*) FROM raw_leads)) AS in_test FROM raw_leads"


@query(
    "M05_support",
    S.with_views("raw_leads", "labelled", f", parts AS ({_IN_TEST}) " + " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) FILTER (label = {label}) AS support FROM labelled JOIN parts USING (lead_seq) WHERE in_test"
        for label, name in V.CLASS_NAMES.items()
    )),
)
def _(spark, sf):
    return trained_model(spark, sf).report.where(F.col("name").isin(list(V.CLASS_NAMES.values()))).select("name", "support")


@query("M04_agreement", "SELECT true AS agrees")
def _(spark, sf):
    """A model of rule labels gives nearly all leads their rule label."""
    rows = labelled(spark, sf)
    share = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return trained_model(spark, sf).model.transform(rows).agg((share >= 0.95).alias("agrees"))


@query("M06_range", S.with_views("raw_leads", "SELECT count(*) AS leads, count(*) AS in_range FROM raw_leads"))
def _(spark, sf):
    found = SC.predict_proba(trained_model(spark, sf).model, leads(spark, sf))
    return found.agg(F.count("*").alias("leads"), F.count_if(F.col("probability_good").between(0, 1)).alias("in_range"))


@query("M07_consistent", S.with_views("raw_leads", "SELECT lead_seq, true AS grade_fits, true AS recommendation_fits FROM raw_leads"))
def _(spark, sf):
    found = SC.score(leads(spark, sf), trained_model(spark, sf).model, ordered=False)
    return found.select(
        "lead_seq",
        (F.col("ml_grade") == G.grade("ml_score")).alias("grade_fits"),
        (F.col("ml_recommend") == G.recommend("ml_score")).alias("recommendation_fits"),
    )


@query("M06_predict_proba")
def _(spark, sf):
    df = leads(spark, sf)
    return SC.predict_proba(trained_model(spark, sf).model, df).select("lead_seq", "probability_good")


@query("M07_score")
def _(spark, sf):
    return SC.score(leads(spark, sf), trained_model(spark, sf).model)


@query("M08_grade_leads", S.with_views("scored", f"SELECT lead_seq, ml_score, ml_grade, ml_recommend FROM scored"))
def _(spark, sf):
    return SC.grade_leads(labelled(spark, sf).select("lead_seq", "rule_score"), "rule_score").drop("rule_score")


_RETRAINED = {}


def retrained_model(spark, sf):
    """The model of the leads with feedback; fitted once per session and folder for the queries that look at it."""
    key = spark.sparkContext.applicationId, sf
    if key not in _RETRAINED:
        _RETRAINED[key] = SC.retrain(leads(spark, sf), D.spark_feedback(spark, sf), TREES)
    return _RETRAINED[key]


@query("M09_retrain")
def _(spark, sf):
    df = leads(spark, sf)
    _RETRAINED.pop((spark.sparkContext.applicationId, sf), None)
    return SC.grade_summary(SC.score(df, retrained_model(spark, sf).model, ordered=False))


_CHANGED = f"SELECT f.label, f.label <> l.label AS changed FROM ({_FED}) f JOIN labelled l USING (lead_seq)"


@query(
    "M09_learns_feedback",
    S.with_views("labelled", "feedback", " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS support, count(*) FILTER (changed) AS changed, true AS learnt FROM ({_CHANGED}) WHERE label = {label}"
        for label, name in V.CLASS_NAMES.items()
    )),
)
def _(spark, sf):
    """Labels after feedback by class, from the retrained model's report; of the leads that feedback
    changed, no class has fewer that follow it now than under the model without feedback, and both together have more."""
    rows = labelled(spark, sf)
    fed = SC.apply_feedback(rows, D.spark_feedback(spark, sf))
    new, old = (m.model.transform(fed).select("lead_seq", "label", "prediction") for m in (retrained_model(spark, sf), trained_model(spark, sf)))
    both = new.join(old.select("lead_seq", F.col("prediction").alias("before")), "lead_seq")
    both = both.join(rows.select("lead_seq", F.col("label").alias("rule")), "lead_seq").withColumn("changed", F.col("label") != F.col("rule"))
    follow = lambda column: F.count_if(F.col("changed") & (F.col(column) == F.col("label")))
    counted = both.groupBy("label").agg(F.count_if("changed").alias("changed"), follow("prediction").alias("now"), follow("before").alias("then"))
    total = counted.agg(F.sum("now").alias("all_now"), F.sum("then").alias("all_then"))
    names = F.create_map(*[F.lit(x) for pair in V.CLASS_NAMES.items() for x in pair])
    learnt = (F.col("now") >= F.col("then")) & (F.col("all_now") > F.col("all_then"))
    found = counted.join(total).select(F.element_at(names, F.col("label")).alias("name"), "changed", learnt.alias("learnt"))
    return SC.evaluate(retrained_model(spark, sf).model, fed).select("name", "support").join(found, "name").select("name", "support", "changed", "learnt")


@query("M10_save_and_load", S.with_views("raw_leads", "SELECT count(*) AS leads, count(*) AS same_score FROM raw_leads"))
def _(spark, sf):
    df, path = leads(spark, sf), scratch_path(spark, "model")
    kept = SC.load_or_train(df, path, TREES)
    again = SC.load_or_train(df, path, TREES)
    one = SC.predict_proba(kept, df).select("lead_seq", F.col("probability_good").alias("a"))
    two = SC.predict_proba(again, df).select("lead_seq", F.col("probability_good").alias("b"))
    return one.join(two, "lead_seq").agg(F.count("*").alias("leads"), F.count_if(F.col("a") == F.col("b")).alias("same_score"))


# --- sinks ---------------------------------------------------------------------------

_EXPORTED = ", ".join(V.EXPORT_ORDER)


@query("K01_write_leads", S.with_views("leads", f"SELECT {_EXPORTED} FROM (SELECT *, row_number() OVER (PARTITION BY business_name, phone ORDER BY lead_seq) AS n FROM leads) WHERE n = 1"))
def _(spark, sf):
    path = scratch_path(spark, "export")
    SI.write_leads(raw(spark, sf), path)
    return spark.read.csv(path, header=True, quote='"', escape='"')


@query("K02_write_scored", S.with_views("scored", f"SELECT {LEAD_LIST}, ml_score, ml_grade, ml_recommend FROM scored"))
def _(spark, sf):
    path = scratch_path(spark, "scored")
    SI.write_scored(scored(spark, sf), path, "parquet")
    return spark.read.parquet(path)


@query("K03_append_log", S.with_views("heads", "responses", f"{_LOG_SQL} UNION ALL {_ENTRIES}"))
def _(spark, sf):
    path = scratch_path(spark, "log")
    SI.append_log(full_log(spark, sf), path, "old")
    for _ in range(2):
        SI.append_log(_entries(spark, sf), path, "new")
    return RD.read_log(spark, path)


@query("K03_append_to_plain_log", S.with_views("heads", "responses", f"{_LOG_SQL} UNION ALL {_ENTRIES}"))
def _(spark, sf):
    path = scratch_path(spark, "log")
    full_log(spark, sf).write.parquet(path)
    SI.append_log(_entries(spark, sf), path, "new")
    return RD.read_log(spark, path)


@query("K03_staged_batch", S.with_views("sent_log", f"SELECT 'staged' AS step, * FROM ({_LOG_SQL}) UNION ALL SELECT 'committed', * FROM ({_LOG_SQL}) WHERE to_email < 'info@site3'"))
def _(spark, sf):
    """What a reader sees while a batch is being replaced, and after."""
    path = scratch_path(spark, "log")
    SI.append_log(full_log(spark, sf), path, "batch")
    attempt = BA.stage(full_log(spark, sf).where("to_email < 'info@site3'"), path, "batch")
    shared_dir(spark)
    before = RD.read_log(spark, path).select(F.lit("staged").alias("step"), "*").checkpoint()
    BA.commit(spark, path, "batch", attempt)
    return before.unionByName(RD.read_log(spark, path).select(F.lit("committed").alias("step"), "*"))


@query("K04_empty_writes_nothing", S.with_views("raw_leads", "SELECT false AS empty_written, true AS full_written, count(*) AS leads FROM raw_leads"))
def _(spark, sf):
    df = raw(spark, sf)
    empty = SI.write_scored(df.limit(0), scratch_path(spark, "none"))
    full = SI.write_scored(df, scratch_path(spark, "some"))
    return df.agg(F.lit(empty).alias("empty_written"), F.lit(full).alias("full_written"), F.count("*").alias("leads"))


# --- streams ---------------------------------------------------------------------------

def _arriving(spark, sf):
    """The raw leads as a stream of several files, one per micro-batch."""
    path = scratch_path(spark, "arriving")
    raw(spark, sf).repartition(3, "lead_seq").write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("T01_distinct_names", S.with_views("leads", "SELECT DISTINCT business_name FROM leads"))
def _(spark, sf):
    out = scratch_path(spark, "names")
    run = (
        LI.distinct_names(_arriving(spark, sf)).select("business_name").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", scratch_path(spark, "names-state"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("business_name string").parquet(out)


@query("T01_names_within_horizon", S.with_views("leads", "SELECT DISTINCT business_name FROM leads"))
def _(spark, sf):
    """All rows lie within the horizon, so each name still comes once."""
    out, stream = scratch_path(spark, "names"), _arriving(spark, sf).withColumn("at", F.timestamp_seconds(F.col("lead_seq")))
    run = (
        LI.distinct_names(stream, "at", "10000 days").select("business_name").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", scratch_path(spark, "names-state"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("business_name string").parquet(out)


@query("T02_outreach", S.with_views("eligible", "sent_log", "SELECT DISTINCT email AS to_email, 'dry_run' AS status FROM eligible WHERE email NOT IN (SELECT to_email FROM sent_log)"))
def _(spark, sf):
    """Leads arrive in several batches, then all of them again under other numbers; with a limit of a third
    of the addresses, each gets one message in the end."""
    path, arriving = scratch_path(spark, "stream-log"), scratch_path(spark, "arriving")
    SI.append_log(full_log(spark, sf), path, "before")
    limit = -(-CA.fresh_leads(eligible(spark, sf), log(spark, sf)).count() // 3)
    again = raw(spark, sf).withColumn("lead_seq", F.col("lead_seq") % 100)
    for rows, files in ((raw(spark, sf), 2), (again, 3)):
        rows.repartition(files, "business_name").write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(spark.read.parquet(arriving).schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    run = (
        LI.outreach(stream, SC.rule_scored, path, SENDER, limit=max(1, limit))
        .option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return RD.read_log(spark, path, skip_batch="before").select("to_email", "status")


# --- whole runs --------------------------------------------------------------------------

def _pages(spark, sf):
    return {
        "google_maps": D.spark_map_pages(spark, sf),
        "justdial": D.spark_card_pages(spark, sf, D.LISTING_HTML),
        "indiamart": D.spark_card_pages(spark, sf, D.SUPPLIER_HTML),
    }


def _run_sql(cap):
    steps, body = S.collected(ORDER[:3], cap)
    all_leads = f"{_MAP_LEADS} UNION ALL {_LISTING_LEADS} UNION ALL {_SUPPLIER_LEADS}"
    cleaned = ", ".join(f"{S.clean(c)} AS {c}" for c in V.EXPORT_ORDER)
    return (
        f"WITH found AS ({all_leads}), leads AS (SELECT lead_seq, {cleaned} FROM found WHERE business_name <> 'N/A'), {steps} "
        f"SELECT {', '.join(V.EXPORT_ORDER)} FROM leads WHERE lead_seq IN ({body})"
    )


@query("run_collect_from_pages", _run_sql(100))
def _(spark, sf):
    settings = RU.Settings(query=QUERY, max_results=100, sender=SENDER)
    return LE.export_columns(RU.collect_from_pages(_pages(spark, sf), settings))


@query("run_campaign", S.with_views("heads", f"SELECT lead_seq, disposition FROM ({S.dispositions(LIMIT)})"))
def _(spark, sf):
    path = scratch_path(spark, "run-log")
    SI.append_log(full_log(spark, sf), path, "before")
    settings = RU.Settings(query=QUERY, daily_limit=LIMIT, sender=SENDER)
    return RU.campaign_run(scored(spark, sf), path, D.spark_responses(spark, sf), settings).select("lead_seq", "disposition")
