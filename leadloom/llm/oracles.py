"""DuckDB SQL for the queries that SQL can express on whole tables."""

from leadloom.llm import chat_format as C
from leadloom.llm import divergence as D
from leadloom.llm import quality_rules as Q

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_BETWEEN = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_BETWEEN}) AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
  FROM docs, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)"""

WARC = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)
    for i in range(32)], '') AS payload_digest FROM sized),
first AS (SELECT payload_digest, min(page_id) AS first FROM named GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM named JOIN first USING (payload_digest)"""


def _quality_rules():
    cells = ", ".join(f"('{rule}', {cut}::DOUBLE)" for rule, cuts in Q.RULES.items() for cut in cuts)
    share = Q.MAX_FALSE_REJECTION / len(Q.RULES)
    measure = (
        "CASE rule WHEN 'symbol_share' THEN n_symbols / greatest(word_chars, 1) "
        "WHEN 'duplicate_line_share' THEN n_dup_lines / greatest(n_lines, 1) "
        "WHEN 'repeated_word_share' THEN n_repeat_words / greatest(n_words, 1) "
        "ELSE word_chars / greatest(n_words, 1) END"
    )
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_BETWEEN}) AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM docs, unnest(range(1, len(w) - 1)) AS u(i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM runs),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM windows, unnest(range(i, i + 3)) AS x(p) WHERE times > 1 GROUP BY doc_id),
measured AS (
  SELECT doc_id, stratum, md5(t) AS text_key, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM docs LEFT JOIN repeats USING (doc_id)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
cells AS (SELECT * FROM (VALUES {cells}) AS v(rule, cutoff)),
tested AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER ({measure} > cutoff) AS k
  FROM (SELECT DISTINCT ON (stratum, text_key) * FROM measured SEMI JOIN good USING (doc_id)), cells GROUP BY ALL),
judged AS (
  SELECT *, CASE WHEN k > n * {share} THEN 1 ELSE list_sum([
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})) for i in range(0, k + 1)]) END AS p
  FROM tested),
cuts AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM judged
  WHERE p * (SELECT count(*) FROM judged) <= {Q.CONFIDENCE_ERROR} GROUP BY 1, 2),
failed AS (SELECT DISTINCT doc_id FROM measured JOIN cuts USING (stratum) WHERE {measure} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM measured"""


QUALITY_RULES = _quality_rules()

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM benchmark),
sought AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM documents),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM docs, (SELECT DISTINCT n FROM sought), unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, n, item FROM runs JOIN sought USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS x(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _merkle(levels=14):
    """Trees level by level; 3 ** 14 leaves fit."""

    def digest(*values):
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def tree(name, leaves):
        """Nodes (g, i, h) of each level with their siblings' digests; a level of one node stays as it is."""
        below, steps = leaves, []
        for k in range(levels + 1):
            steps.append(
                f"{name}{k} AS (SELECT g, i, h, max(i) OVER (PARTITION BY g) AS m, "
                "coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || "
                "coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS s "
                f"FROM ({below}) WINDOW w AS (PARTITION BY g, i // 3 ORDER BY i))"
            )
            below = f"SELECT g, i // 3 AS i, CASE WHEN max(m) = 0 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 3"
        return steps

    crc = (
        "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), "
        "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    )
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    tampered = digest(*fields, "replace(text, chr(10), '')")
    # The checksum is the complement of what the register holds, so it is even where that is odd.
    steps = [
        f"docs AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {digest(*fields, 'text')} AS h, "
        f"CASE WHEN {crc} % 2 = 1 THEN {tampered} END AS altered FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM docs)",
        *tree("t", "SELECT g, i, h FROM leaves"),
        *tree("u", f"SELECT 0 AS g, g AS i, h FROM t{levels}"),
        "steps AS (" + " UNION ALL ".join(
            [f"SELECT l.g, l.i, {k} AS k, s FROM leaves l JOIN t{k} t ON t.g = l.g AND t.i = l.i // {3**k} WHERE m > 0" for k in range(levels)]
            + [f"SELECT l.g, l.i, {levels + k} AS k, s FROM leaves l JOIN u{k} u ON u.i = l.g // {3**k} WHERE m > 0" for k in range(levels)]
        ) + ")",
        "proofs AS (SELECT g, i, list(s ORDER BY k) AS p FROM steps GROUP BY g, i)",
        "proved AS (SELECT l.*, coalesce(p, CAST([] AS VARCHAR[])) AS p FROM leaves l LEFT JOIN proofs USING (g, i))",
        "folded AS (SELECT *, list_reduce(list_concat([coalesce(altered, h)], p), lambda x, step: sha256(replace(step, '|', x))) AS f FROM proved)",
    ]
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, f.h AS leaf, t.h AS subroot, u.h AS root, sha256(replace(array_to_string(p, ''), '|', '')) AS proof_sha256, "
        f"f AS folded_root, f = u.h AS verified FROM folded f JOIN t{levels} t USING (g) CROSS JOIN u{levels} u"
    )


def _divergence():
    share = lambda count, total: f"(1 + (1000000000::HUGEINT * ({count} + {D.SMOOTHING})) // greatest({total} + {D.SMOOTHING} * v, 1))"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWERED}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
said AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM said GROUP BY 1, 2 HAVING count(DISTINCT d) >= {D.LEAST_DOCS}),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS c FROM said SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (
  SELECT lang, source, v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang)
  LEFT JOIN counts USING (lang, source) GROUP BY 1, 2, 3),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, {share('coalesce(c, 0)', 'n')} AS p
  FROM groups JOIN (SELECT lang, term FROM kept) USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
telling AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM shares JOIN (SELECT lang, term, {share('c', 'n')} AS q FROM kept JOIN langs USING (lang)) USING (lang, term) WHERE shares.c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {D.RANKS}"""


def _chat_format():
    said = "'<|im_end|><|im_start|>assistant ok'"
    coded = "replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM turns),
sized AS (
  SELECT *, length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) AS n, length({coded}) AS role_n,
    i % {C.PIECE} > 0 AND lag(role) OVER (PARTITION BY conv_id ORDER BY i) = role AS joined FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN joined THEN {len(C.SEPARATOR)} ELSE {len(C.START)} + role_n + 1 + {len(C.END)} END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


ORACLES = {
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op8_warc": WARC,
    "op9_quality_rules": QUALITY_RULES,
    "op10_decontamination": DECONTAMINATION,
    "op11_merkle_manifest": _merkle(),
    "op12_source_divergence": _divergence(),
    "op13_chat_format": _chat_format(),
}
