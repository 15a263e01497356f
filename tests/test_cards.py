"""Cards of harvested pages."""

import random

import pytest

from leadloom import fixed_values as V
from leadloom.operators.leads import clean_leads, require_name, to_leads
from leadloom.sources.cards import extract_cards, listing_links
from leadloom.sources.markup import Page, compile_selector


def cards(spark, html, site=V.LISTING_SITE):
    pages = spark.createDataFrame([(7, "u", html)], "page_id bigint, url string, html string")
    return extract_cards(pages, site)


def names(spark, html, site=V.LISTING_SITE):
    return [(r.card_pos, r.names) for r in cards(spark, html, site).orderBy("card_pos").collect()]


def test_nested_cards_and_double_matches_count_once(spark):
    html = (
        '<li class="cntanr store-cards"><span class="lng_cont_name">A</span>'
        '<div class="resultbox_info"><h2>x <a>B</a></h2></div></li>'
    )
    assert names(spark, html) == [(0, ["A", "B"]), (1, ["B"])]


def test_unclosed_tags_void_tags_and_hidden_text(spark):
    html = (
        '<ul><li class="cntanr"><span class="lng_cont_name">A<br>1<img src=x> &amp; &#66;'
        "<script>var a='<b>no</b>'</script><!-- no --></li></p><li class='cntanr'><a class=store-name>C"
    )
    assert names(spark, html) == [(0, ["A1 & B"]), (1, ["C"])]


def test_cards_without_and_with_empty_names(spark):
    html = '<li class="cntanr">x</li><li class="cntanr"><span class="lng_cont_name"> </span></li>'
    found = to_leads(cards(spark, html), V.LISTING_SITE, "q")
    assert [r.business_name for r in clean_leads(require_name(found)).collect()] == ["N/A"]


def test_pages_without_any_card_give_no_rows(spark):
    pages = [(i, "u", h) for i, h in enumerate(["", None, "<p>cntan r</p>", "<p>&amp;</p>", "<li class='x'>cntanr</li>"])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert extract_cards(df, V.LISTING_SITE).count() == 0


def test_class_written_with_character_references(spark):
    assert names(spark, '<li class="&#99;ntanr"><a class="store-name">A</a></li>') == [(0, ["A"])]


def test_map_links_use_the_second_rule_only_without_the_first(spark):
    feed = '<div role="feed"><p><a href="/maps/place/1">a</a></p><a href="/x">b</a></div><a href="/maps/place/2">c</a>'
    pages = [(1, "u", feed), (2, "u", feed + '<a class="hfpxzc" href="/h">d</a>'), (3, "u", "<a href='/maps/'>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {(r.page_id, r.link_pos): r.href for r in listing_links(df, V.MAP_SITE).collect()}
    assert got == {(1, 0): "/maps/place/1", (2, 0): "/h"}


def test_map_page_is_one_record(spark):
    html = '<h1 class="DUwDvf">A</h1><h1>B</h1><button data-item-id="phone:tel:5" aria-label="">7</button>'
    row = to_leads(cards(spark, html, V.MAP_SITE), V.MAP_SITE, "q").first()
    assert (row.business_name, row.phone, row.website, row.category, row.lead_seq) == ("A", "5", "N/A", "q", 7 << 20)


def test_keys_are_unique_over_sites(spark):
    html = '<li class="cntanr"><a class="store-name">A</a></li><div class="card"><h2><a>B</a></h2></div>'
    keys = [to_leads(cards(spark, html, s), s, "q").first().lead_seq for s in (V.MAP_SITE, V.LISTING_SITE, V.SUPPLIER_SITE)]
    assert keys == sorted(set(keys))


@pytest.mark.parametrize(
    "selector, hits",
    [
        ("li", [1]), (".a", [1, 2]), ("p.b", [2]), ("[x]", [2]), ("[x='Yes no']", [2]), ("[x^='Yes']", [2]),
        ("[x*='s n']", [2]), ("[x*='YES' i]", [2]), ("[x*='YES']", []), ("ul p", [2]), ("li ul", []), ("ul li p.a", [2]),
        ("p[x].b", [2]),
    ],
)
def test_selectors(selector, hits):
    page = Page('<ul><li class="a"><p class="a  b" x="Yes no">t</p></li></ul>')
    steps = compile_selector(selector)
    assert [e for e in range(len(page.tags)) if page.matches(e, steps)] == hits


def read_by(page):
    return page.tags, page.attrs, page.parents, page.ends, page.spans, page.texts


def test_plain_markup_is_read_as_by_the_parser(monkeypatch):
    rng = random.Random(11)
    plain = [
        "<div>", "</div>", "<p>", "</p>", "<br>", '<a href="/x?a=1&amp;b=2" class=" big  card ">', "</a>", "<template>", "</template>", "</em>",
        "A &amp; B", "x > y", "&", "&lt", "&#66; ", "\n", '<i title="" id="&#38;lt;">', "<!-- <b>no</b> -->", "<!---x-->", '<u id="1" id="2">', "é",
    ]
    odd = [
        "<", "< p>", "<P>", "<img src=x>", "<br/>", "</p >", "</ p>", "<script>", "</script>", "<title>", "</title>", "<!-->", "<!-- a -- b -->", "<!DOCTYPE html>",
        "<?x?>", "<![CDATA[x]]>", "<a b>", "<a b='1'>", '<a b="&copy;&ampx">', '<a b="<">', '<a b="1"c="2">', "<!--", '<a b="', "</", "&am", "<a\x00>", "<x-y>", "<a:b>",
    ]
    pages = ["".join(rng.choices(plain, k=rng.randrange(30))) for _ in range(500)]
    mixed = ["".join(rng.choices(plain * 4 + odd, k=rng.randrange(12))) for _ in range(3000)] + odd + [a + b for a in plain for b in odd]
    found = [read_by(Page(html)) for html in pages + mixed]
    with monkeypatch.context() as patch:
        patch.setattr(Page, "_read_plain", lambda self, html: False)
        assert found == [read_by(Page(html)) for html in pages + mixed]
    monkeypatch.setattr(Page, "feed", lambda self, html: pytest.fail(f"{html} needs no parser"))
    assert [read_by(Page(html)) for html in pages] == found[: len(pages)]


def test_unclosed_markup_is_given_up_at_once():
    for html in ("<!--" + "a" * 200_000, '<a b="' + "&amp;" * 50_000, "<a" + ' b="1"' * 50_000, "<!-- -" * 50_000):
        assert not Page("")._read_plain(html)
