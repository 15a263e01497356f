"""One table per expression with its edge values."""

import pytest
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import features as FE
from leadloom.functions import grading as G
from leadloom.functions import pickers as PK
from leadloom.functions import text as TX

NBSP = "\xa0"


def apply(spark, expr, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr.alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def check(spark, expr, cases, kind="string"):
    assert apply(spark, expr, [a for a, _ in cases], kind) == [b for _, b in cases]


def test_spaces_are_all_unicode_spaces():
    assert set(TX.SPACES) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_clean(spark):
    cases = [
        (None, "N/A"), ("", "N/A"), (" N/A ", "N/A"), ("None", "N/A"), (f"{NBSP}None\n", "N/A"),
        ("nan", "nan"), ("a\n\tb", "a b"), (f"a{NBSP}{NBSP} b", "a b"), ("\x1ca\x1f\x1eb", "a b"),
        ("None N/A", "None N/A"), ("x None", "x None"), (" x　y ", "x y"), (" \t ", "N/A"),
    ]
    check(spark, TX.clean("x"), cases)
    once = [b for _, b in cases]
    assert apply(spark, TX.clean("x"), once) == once


def test_strip_and_collapse_know_every_space(spark):
    cases = [(f"{c}a{c}{c}b{c}", "a b") for c in TX.SPACES]
    check(spark, TX.clean("x"), cases)
    check(spark, TX.strip("x"), [(f"{c}a{c}b{c}", f"a{c}b") for c in TX.SPACES])


def test_has_value(spark):
    check(spark, TX.has_value("x"), [(None, 1), ("", 1), ("N/A", 0), (" N/A", 1), ("x", 1)])


def test_domain(spark):
    check(spark, TX.website_domain("x"), [
        ("https://www.a.com/x", "www.a.com"), ("https://x.com?u", "x.com?u"), ("HTTP://x/y", "HTTP:"),
        ("x.com:80/a", "x.com:80"), ("http://https://a/b", "a"), ("", ""),
    ])


def test_rating(spark):
    cases = [
        ("4.5", 0.9), ("4,5", 0.9), (".5", 0.1), ("5.", 1.0), ("+4", 0.8), ("-1", -0.2), ("10", 2.0),
        ("1e1", 2.0), (" 4.5 ", 0.9), (f"{NBSP}4.5", 0.9), ("4_5", 9.0),
        ("4.5d", 0.0), ("0x1p3", 0.0), ("nan", 0.0), ("inf", 0.0), ("1e999", 0.0), ("4.5★", 0.0),
        ("3.9 (120)", 0.0), ("1,234.5", 0.0), ("4__5", 0.0), ("", 0.0), ("N/A", 0.0), (None, 0.0),
    ]
    check(spark, FE.rating_score("x"), cases)


def test_source_score(spark):
    cases = [(s, t) for s, t in V.SOURCE_TRUST.items()]
    cases += [("Google_Maps", 0.9), ("YELP", 0.8), ("else", 0.5), ("", 0.5), (None, 0.5)]
    check(spark, FE.source_score("x"), cases)


def test_name_features(spark):
    cases = [(None, 0.05, 0.125), ("", 0.0, 0.0), ("a", 0.0125, 0.125), ("a b", 0.0375, 0.25),
             (f" a{NBSP}b\tc ", 0.0875, 0.375), ("é" * 81, 1.0, 0.125), ("w " * 12, 0.3, 1.0), ("😀", 0.0125, 0.125)]
    check(spark, FE.name_length("x"), [(name, length) for name, length, _ in cases])
    check(spark, FE.name_word_count("x"), [(name, words) for name, _, words in cases])


def test_category_worked_cases(spark):
    """0.5, raised by 0.08 for each high-value word up to 1, then lowered by 0.15 for each low-value word down to 0."""
    high, low = V.HIGH_VALUE_KEYWORDS, V.LOW_VALUE_KEYWORDS
    rows = [
        ("Bakery", None, 0.5),
        (None, None, 0.5),
        ("Corner", "shop x", 0.5),
        (" ".join(high), "", 1.0),
        ("", " ".join(low), 0.0),
        (" ".join(low), " ".join(low), 0.0),
    ]
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(rows)], "i int, n string, c string")
    got = {r.i: r.y for r in df.select("i", FE.category_score("n", "c").alias("y")).collect()}
    assert got == pytest.approx({i: y for i, (_, _, y) in enumerate(rows)})


def test_address(spark):
    check(spark, FE.address_completeness("x"), [
        (None, 0.0), ("", 0.0), ("N/A", 0.0), ("5", 0.4), ("a, b", 0.3), ("a, 5", 0.7), ("x" * 30, 0.0),
        ("x" * 31, 0.3), ("1, " + "x" * 30, 1.0), ("٣", 0.4), ("m²", 0.4), ("Downtown", 0.0),
    ])


def test_every_digit_counts(spark):
    digits = [chr(c) for c in range(0x110000) if chr(c).isdigit()]
    others = ["½", "Ⅷ", "十", "x", "〇"]
    df = spark.createDataFrame([(c,) for c in [*digits, *others]], "x string")
    got = {r.x: r.y for r in df.select("x", FE.address_completeness("x").alias("y")).collect()}
    assert len(digits) >= 808 and {c for c in digits if got[c] != 0.4} == set() and all(got[c] == 0.0 for c in others)


def test_completeness_and_rule_score(spark):
    row = dict(has_email=1, has_phone=0, has_website=1, has_address=1, rating_score=0.9,
               source_score=0.85, category_score=0.82, address_completeness=0.7)
    df = spark.createDataFrame([tuple(row.values())], list(row))
    done = df.select(
        FE.data_completeness("has_email", "has_phone", "has_website", "has_address").alias("d"),
        FE.rule_score().alias("r"),
    ).first()
    assert done.d == 1 * 0.35 + 0 * 0.25 + 1 * 0.20 + 1 * 0.20
    assert done.r == 35 + 0 + 15 + 0.9 * 10 + 0.85 * 8 + 0.82 * 7 + 0.7 * 5


def test_rule_scores_of_the_sample(spark):
    """category, address, rule score of eight sample leads with phone, website and address, no e-mail, source score 0.75."""
    golden = [(0.82, 1.0, 51.74), (0.90, 1.0, 52.30), (0.74, 1.0, 51.18), (0.74, 1.0, 51.18),
              (0.82, 0.7, 50.24), (0.82, 1.0, 51.74), (0.74, 1.0, 51.18), (0.82, 1.0, 51.74)]
    rows = [(i, 0, 1, 1, 1, 0.0, 0.75, c, a) for i, (c, a, _) in enumerate(golden)]
    columns = "i int, has_email int, has_phone int, has_website int, has_address int, rating_score double, source_score double, category_score double, address_completeness double"
    got = {r.i: r.y for r in spark.createDataFrame(rows, columns).select("i", FE.rule_score().alias("y")).collect()}
    assert got == pytest.approx({i: y for i, (_, _, y) in enumerate(golden)})


def test_label_threshold(spark):
    check(spark, FE.rule_label("x"), [(45.0, 0), (45.0000001, 1), (0.0, 0)], "double")


def test_title_case(spark):
    texts = ["b2b it's digital-marketing", "ÉCOLE été", "", "a", "x中y", "  two  spaces"]
    check(spark, TX.title_case("x"), [(t, t.title()) for t in texts])


def test_seed_urls(spark):
    row = spark.range(1).select(
        *[TX.seed_url(F.lit(s), F.lit("digital b2b agency"), F.lit("Los Angeles")).alias(s)
          for s in ("google_maps", "justdial", "indiamart", "other")],
        TX.seed_url(F.lit("indiamart"), F.lit("shop"), F.lit("")).alias("alone"),
    ).first()
    assert row.google_maps == "https://www.google.com/maps/search/digital+b2b+agency+in+Los+Angeles"
    assert row.justdial == "https://www.justdial.com/Los-Angeles/Digital-B2B-Agency"
    assert row.indiamart == "https://dir.indiamart.com/search.mp?ss=digital+b2b+agency+Los+Angeles"
    assert row.other is None and row.alone == "https://dir.indiamart.com/search.mp?ss=shop"


def test_rounding_and_grades(spark):
    check(spark, G.round1("x"), [(2.25, 2.2), (0.45, 0.4), (74.95, 75.0), (0.0, 0.0), (100.0, 100.0)], "double")
    check(spark, G.grade("x"), [
        (75.0, "A"), (74.9, "B"), (55.0, "B"), (54.9, "C"), (50.0, "C"), (35.0, "C"), (34.9, "D"), (0.0, "D"),
    ], "double")
    check(spark, G.recommend("x"), [(54.9, True), (50.0, True), (49.9, False)], "double")
    check(spark, G.score_from_probability("x"), [(0.0225, 2.2), (0.7495, 75.0), (1.0, 100.0)], "double")


def test_grade_ranks(spark):
    check(spark, G.grade_rank("x"), [("A", 0), ("D", 3), ("E", 99), (None, 99)])
    assert [G.min_grade_rank(g) for g in ("A", "C", "?")] == [0, 2, 1]


def test_city(spark):
    check(spark, TX.city_guess("x"), [
        ("Los Angeles, CA 90007", "CA 90007"), ("x,", "your area"), ("no comma", "no comma"), ("", "your area"),
    ])


def test_preview_keeps_whole_characters(spark):
    check(spark, TX.preview("x"), [("é" * 90, "é" * 80 + "..."), ("short", "short...")])


def test_html_escapes_markup(spark):
    (html,) = apply(spark, TX.html_body("x"), ["a <b> & c\nd"])
    assert "a &lt;b&gt; &amp; c<br>d" in html and html.strip().startswith("<html>")


SENDER = {"name": "Sam", "company": "Acme", "service": "teams grow", "website": "https://a.example.com"}


def test_template_and_prompt(spark):
    df = spark.createDataFrame([("Biz", "1 Main St, CA")], "business_name string, address string")
    row = df.select(TX.template("business_name", "address", SENDER).alias("m"), TX.prompt(df.columns, SENDER).alias("p")).first()
    assert row.m.subject == "Quick idea for Biz"
    assert row.m.body.startswith("Hi,\n\nI came across Biz and") and "yours in CA are" in row.m.body
    assert "Business Name : Biz\nCategory      : N/A\n" in row.p and '{\n  "subject"' in row.p


@pytest.mark.parametrize(
    "text, subject, body",
    [
        ('{"subject":"s","body":"b"}', "s", "b"),
        ('```json\n{"subject":"s","body":"b"}\n```', "s", "b"),
        ('{"body":"b"}', "Quick question about Biz", "b"),
        ('{"subject":"s"}', "s", ""),
        ("{}", "Quick question about Biz", ""),
        ('{"subject":null,"body":null}', "Quick question about Biz", ""),
        ('{"subject":"s"} trailing', "F", "f"),
        ('{"subject":"s"}{"subject":"t"}', "F", "f"),
        ('{"subject":"s"},{"subject":"t"}', "F", "f"),
        ("{'subject':'s'}", "F", "f"),
        ("[1,2]", "F", "f"),
        ('[{"subject":"s"}]', "F", "f"),
        ('"text"', "F", "f"),
        ("null", "F", "f"),
        ("not json", "F", "f"),
        ("", "F", "f"),
        (None, "F", "f"),
    ],
)
def test_parse_message(spark, text, subject, body):
    fallback = F.struct(F.lit("F").alias("subject"), F.lit("f").alias("body"))
    (got,) = apply(spark, TX.parse_message("x", F.lit("Biz"), fallback), [text])
    assert (got.subject, got.body) == (subject, body)


def test_pickers(spark):
    arrays = "array<string>"
    check(spark, PK.first_hit("x"), [([" a "], "a"), (["", "b"], ""), ([], "N/A")], arrays)
    check(spark, PK.pick_phone("x"), [
        (["Phone: ", "tel:+1 (2)"], "+1 (2)"), (["abc"], ""), ([], "N/A"), (["+1-2", "3"], "+1-2"),
    ], arrays)
    check(spark, PK.pick_address("x"), [(["Address: a Address: b "], "a b"), (["", "b"], ""), ([], "N/A")], arrays)
    check(spark, PK.pick_website("x"), [(["http://a"], "http://a"), (["", "http://b"], "N/A"), ([], "N/A")], arrays)
    check(spark, PK.pick_rating("x"), [(["New", "4,5"], "4,5"), (["New"], "N/A"), ([], "N/A")], arrays)
    check(spark, PK.pick_category("x", F.lit("q")), [(["Shop"], "Shop"), (["N/A"], "q"), ([" "], "N/A"), ([], "q")], arrays)
