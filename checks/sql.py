"""The expected results as DuckDB SQL: expression snippets and common table expressions."""

from checks.derived import CTE, LEAD_COLUMNS, duck_raw_cards
from leadloom import fixed_values as V

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text):
    return "'" + text.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def clean(x):
    return (
        f"CASE WHEN {x} IS NULL OR {strip(x)} IN ('', 'N/A', 'None') THEN 'N/A' "
        f"ELSE regexp_replace({strip(x)}, '[{_WS}]+', ' ', 'g') END"
    )


def has(x):
    return f"CAST({x} IS DISTINCT FROM 'N/A' AS INTEGER)"


def domain(x):
    return f"split_part(replace(replace({x}, 'https://', ''), 'http://', ''), '/', 1)"


def rating(x):
    t = strip(f"replace({x}, ',', '.')")
    number = f"CASE WHEN regexp_full_match({t}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast({t} AS DOUBLE) END"
    return f"coalesce(CASE WHEN NOT isinf({number}) THEN {number} / 5e0 END, 0e0)"


def trust(x):
    cases = " ".join(f"WHEN {q(k)} THEN {v}e0" for k, v in V.SOURCE_TRUST.items())
    return f"CASE lower({x}) {cases} ELSE 0.5e0 END"


def name_length(x):
    return f"least(length({x}), 80) / 80e0"


def word_count(x):
    return f"least(len(regexp_extract_all({x}, '[^{_WS}]+')), 8) / 8e0"


def category(name, cat):
    t = f"lower(concat({name}, ' ', {cat}))"
    score = "0.5e0"
    for w in V.HIGH_VALUE_KEYWORDS:
        score = f"least(1e0, {score} + CASE WHEN contains({t}, {q(w)}) THEN 0.08e0 ELSE 0e0 END)"
    for w in V.LOW_VALUE_KEYWORDS:
        score = f"greatest(0e0, {score} - CASE WHEN contains({t}, {q(w)}) THEN 0.15e0 ELSE 0e0 END)"
    return score


def address(x):
    return (
        f"CASE WHEN {x} IS NULL OR {x} IN ('N/A', '') THEN 0e0 ELSE least(1e0, "
        f"CASE WHEN regexp_matches({x}, '[0-9]') THEN 0.4e0 ELSE 0e0 END + "
        f"CASE WHEN contains({x}, ',') THEN 0.3e0 ELSE 0e0 END + "
        f"CASE WHEN length({x}) > 30 THEN 0.3e0 ELSE 0e0 END) END"
    )


def title(x):
    return (
        "array_to_string([concat(upper(w[1]), lower(w[2:])) FOR w IN "
        f"regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')], '')"
    )


def round1(x):
    return f"(round_even(({x}) * 10, 0) / 10e0)"


def grade(x):
    return f"CASE WHEN {x} >= 75 THEN 'A' WHEN {x} >= 55 THEN 'B' WHEN {x} >= 35 THEN 'C' ELSE 'D' END"


def city(x):
    return f"coalesce(nullif({strip(f'list_extract(string_split({x}, {q(chr(44))}), -1)')}, ''), 'your area')"


def filled(text, **values):
    """A text with its places filled, as one concatenation."""
    from string import Formatter

    parts = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            parts.append(q(literal))
        if name:
            parts.append(values[name])
    return f"concat({', '.join(parts)})"


def template_subject(name):
    return filled(V.TEMPLATE_SUBJECT, business_name=name)


def template_body(name, addr, sender):
    return filled(
        V.TEMPLATE_BODY, business_name=name, city=city(addr),
        company=q(sender["company"]), service=q(sender["service"]), sender=q(sender["name"]),
    )


_FEATURES = f"""SELECT lead_seq, {has('email')} AS has_email, {has('phone')} AS has_phone,
 {has('website')} AS has_website, {has('address')} AS has_address,
 {rating('rating')} AS rating_score, {trust('source')} AS source_score,
 {name_length('business_name')} AS name_length, {word_count('business_name')} AS name_word_count,
 {category('business_name', 'category')} AS category_score, {address('address')} AS address_completeness,
 {has('email')} * 0.35e0 + {has('phone')} * 0.25e0 + {has('website')} * 0.20e0 + {has('address')} * 0.20e0 AS data_completeness
 FROM leads"""
_RULES = " + ".join(f"{k} * {w}" for k, w in V.RULE_WEIGHTS.items())

CTES = {
    **CTE,
    "raw_cards": duck_raw_cards(),
    "leads": "SELECT lead_seq, "
    + ", ".join(f"{clean(c)} AS {c}" for c in LEAD_COLUMNS if c != "lead_seq")
    + " FROM raw_leads",
    "features": _FEATURES,
    "labelled": f"SELECT *, {_RULES} AS rule_score, CAST({_RULES} > 45 AS INTEGER) AS label FROM features",
    "scored": f"SELECT l.*, {round1('rule_score')} AS ml_score, {grade(round1('rule_score'))} AS ml_grade, "
    f"{round1('rule_score')} >= 50 AS ml_recommend FROM leads l JOIN labelled USING (lead_seq)",
    "best": "SELECT domain, value AS best_email FROM (SELECT *, row_number() OVER (PARTITION BY domain "
    "ORDER BY coalesce(confidence, 0) DESC, lookup_seq, value = 'z@z.example.com') AS n FROM contacts) WHERE n = 1",
    "eligible": "SELECT * FROM scored WHERE ml_grade IN ('A', 'B') AND email <> 'N/A'",
    "heads": "SELECT *, row_number() OVER (PARTITION BY email ORDER BY ml_score DESC, lead_seq) = 1 "
    "AND email NOT IN (SELECT to_email FROM sent_log) AS fresh FROM eligible",
}
_NEEDS = {
    "leads": ["raw_leads"], "features": ["leads"], "labelled": ["features"], "scored": ["leads", "labelled"],
    "best": ["contacts"], "eligible": ["scored"], "heads": ["eligible", "sent_log"],
}


def with_views(*names_then_body):
    """``WITH`` the named views and all they need, followed by the body."""
    *names, body = names_then_body
    ordered = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    views = ", ".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH {views} {body}" if views else body


def dispositions(limit, success="fresh"):
    """Walk of the campaign: a row counts while fewer than ``limit`` successes came before it."""
    return (
        f"SELECT *, CASE WHEN coalesce(sum(CAST({success} AS INTEGER)) OVER (ORDER BY ml_score DESC, lead_seq "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {limit} THEN 'beyond_limit' "
        f"WHEN fresh AND NOT ({success}) THEN 'failed' WHEN fresh THEN 'selected' ELSE 'skipped' END AS disposition FROM heads"
    )


def collected(order, n):
    """First ``n`` new names per source, source by source."""
    steps, taken = [], []
    for i, source in enumerate(order):
        seen = " UNION ALL ".join(f"SELECT business_name FROM t{j}" for j in taken) or "SELECT NULL WHERE false"
        steps.append(
            f"t{i} AS (SELECT business_name, min(lead_seq) AS lead_seq FROM leads WHERE source = {q(source)} "
            f"AND business_name NOT IN ({seen}) GROUP BY business_name ORDER BY 2 LIMIT {n})"
        )
        taken.append(i)
    body = " UNION ALL ".join(f"SELECT lead_seq FROM t{i}" for i in taken)
    return ", ".join(steps), body
