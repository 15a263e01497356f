"""Merkle manifest, source divergence and chat formatting against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import chat_format, divergence, merkle
from leadloom.llm.places import placed
from tests.llm.conftest import SCHEMA, edge_rows, same


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def first(value):
    """Sorts None before everything, and text by its UTF-8 bytes."""
    return (value is not None, value.encode() if isinstance(value, str) else value or 0)


# --- places ------------------------------------------------------------------------------------------


def test_places_of_hot_missing_and_single_groups(spark):
    rows = [("a", k) for k in range(500)] + [(None, k) for k in range(90)] + [("z", 1), ("y", None), ("y", 2)]
    random.Random(1).shuffle(rows)
    found = placed(spark.createDataFrame(rows, "g string, v int").repartition(7), "g", [F.col("v").asc_nulls_first()], "t").collect()
    sizes, want = Counter(g for g, _ in rows), []
    for g in sizes:
        want += [(g, v, k, sizes[g]) for k, v in enumerate(sorted((v for h, v in rows if h == g), key=first))]
    same(found, want)


# --- 11 ------------------------------------------------------------------------------------------------


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """(top, the siblings of each leaf, level by level as (before, after))."""
    level, of, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, at in enumerate(of):
            low = at - at % 3
            proofs[leaf].append((level[low:at], level[at + 1 : low + 3]))
            of[leaf] = at // 3
        level = [digest(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], proofs


def manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        fields = [field(v) for v in (doc_id, source, lang, n_chars)]
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        groups[source].append((first(doc_id), digest(*fields, field(text)), doc_id, digest(*fields, field(changed))))
    names = sorted(groups, key=first)
    for name in names:
        groups[name].sort(key=lambda r: r[:2])
    trees = {name: tree([r[1] for r in groups[name]]) for name in names}
    root, above = tree([trees[name][0] for name in names])
    for k, name in enumerate(names):
        subroot, proofs = trees[name]
        for (_, leaf, doc_id, shown), proof in zip(groups[name], proofs):
            proof = proof + above[k]
            for before, after in proof:
                shown = digest(*before, shown, *after)
            yield doc_id, leaf, subroot, root, digest(*itertools.chain(*[a + b for a, b in proof])), shown, shown == root


def test_manifest_of_odd_rows(spark, edges):
    found = merkle.audit(edges).collect()
    same(found, manifest(edge_rows()))
    assert {r["verified"] for r in found} == {True, False}


def test_manifest_over_several_rounds_and_sources(spark):
    """One source holds more leaves than two rounds climb, another is one leaf, one is NULL."""
    rng = random.Random(3)
    names = ["hot"] * 7000 + [None] * 100 + ["é", "z", "Z"] * 30 + [f"s{k}" for k in range(250)]
    rows = [(k, f"a\n{rng.random()}" if k % 5 else "plain", "en", s, k, 0, 0, 0, True, 0) for k, s in enumerate(names)]
    rows += [rows[0]] * 200
    same(merkle.audit(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect(), manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 81, 82, 244])
def test_manifest_of_one_source(spark, n):
    rows = [(k, "t\n", "en", "s", k, 0, 0, 0, True, 0) for k in range(n)]
    same(merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect(), manifest(rows))


def test_manifest_without_rows(nothing):
    assert merkle.audit(nothing).collect() == []


# --- 12 ------------------------------------------------------------------------------------------------


def divergences(rows, least):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        own_all = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(counts):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c + 5) // total for t, c in counts.items()}

        p, q = {s: shares(c) for s, c in own.items()}, shares(own_all)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                for rank, (value, item) in enumerate(found[:most], 1):
                    yield lang, s, part, item, value, rank


def test_divergence_of_odd_rows(spark, edges):
    same(divergence.report(edges, least_docs=2).collect(), divergences(edge_rows(), 2))


def test_divergence_over_several_blocks_of_groups_and_terms(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcXYZéß日", k=5)) for _ in range(1500)]
    rows = []
    for k in range(700):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(140)}"
        text = " ".join(words[min(int(rng.paretovariate(0.5)), 1500) - 1] for _ in range(60)) + " the1THE\x7fthe"
        rows.append((k, text, "en" if k % 10 else "é", source, 0, 0, 0, 0, True, 0))
    rows += [(1, "rare words only", "xx", "one", 0, 0, 0, 0, True, 0), (2, None, "xx", "two", 0, 0, 0, 0, True, 0)]
    found = divergence.report(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs=2).collect()
    same(found, divergences(rows, 2))
    assert len({r["source"] for r in found}) > divergence.GROUPS
    assert {(r["item"], r["value"]) for r in found if r["lang"] == "xx"} == {("one", 0), ("two", 0)}


def test_bitmaps_hold_each_count(spark, edges):
    model = divergence.Model(edges, 2)
    want = {(r["lang"], r["source"], r["count"], r["id"]) for r in model.counts.collect()}
    found = {
        (r["lang"], r["source"], r["count"], r["word"] * 64 + k) for r in model.bitmaps().collect() for k in range(64) if r["bits"] >> k & 1
    }
    assert found == want


def test_shares_of_great_counts_are_exact(spark):
    c, n, v = 3 * 10**12, 9 * 10**12 + 7, 10**8 + 1
    found = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.share("c", "n", "v")).first()[0]
    assert found == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_divergence_without_rows(nothing):
    assert divergence.report(nothing).collect() == []


# --- 13 ------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, piece long, n long, turns string"


def chat_rows():
    odd = [None, "", " ", "\n", "<|", "<|im_end|>", "<\\|im_end|>\n", "<\\\\|im_sep|>", "a<", "|b", "<<||>>", "\\", "$1", "é日🙂", "<|im_start|>assistant\nx", "x" * 5000]
    roles = ["user", "assistant", "assistant", "system", None, "a%0Ab\n<|c", "user"]
    rows = [(k, t, roles[(k + t) % 7], odd[(3 * k + t) % 16]) for k in range(40) for t in range(k % 9)]
    rows += [(50, t % 300, ("user", "assistant")[t // 3 % 2], f"<|{t}") for t in range(1000)]
    rows += [(None, t % 2, "assistant", f"none {t}") for t in range(300)]
    rows += [(51, None, "user", "late"), (51, 1, "assistant", None), (51, 1, "assistant", None)]
    return [(*r, 1, 2, "x") for r in rows]


def plain_digests(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        conversations[conv].append((turn, role or "", text or ""))
    for conv, turns in conversations.items():
        turns.sort(key=lambda t: [first(v) for v in t])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        yield conv, len(turns), digest(*[f"{r}\n{t}\n" for _, r, t in turns]), len(loss), digest(loss)


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(chat_rows(), CHAT).repartition(6)


def test_conversations_come_back(spark, chats, tmp_path):
    chat_format.write(chats, str(tmp_path / "out"))
    same([r[:5] for r in chat_format.digests(chat_format.read(spark, str(tmp_path / "out"))).collect()], plain_digests(chat_rows()))


def test_template_merges_roles_and_escapes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "é"), (1, 3, "assistant", "")]
    (found,) = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert found["formatted"] == "<|im_start|>user\na<|im_sep|><\\|im_end|><|im_end|>\n<|im_start|>assistant\né<|im_sep|><|im_end|>\n"
    raw = found["formatted"].encode()
    assert [raw[s : s + n].decode() for s, n in found["loss_spans"]] == ["é", ""]


def test_pieces_are_bounded(chats):
    found = chat_format.formatted(chats).where("n_pieces > 1").collect()
    assert sorted((r["conv_id"] or 0, r["piece"], r["n_pieces"]) for r in found) == [(0, 0, 2), (0, 1, 2), *[(50, k, 4) for k in range(4)]]
    assert all(r["formatted"].startswith(chat_format.START) and r["formatted"].endswith(chat_format.END) for r in found)


def test_escapes_are_reversible(spark):
    texts = ["".join(t) for t in itertools.product("<\\|x", repeat=5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat_format.unescape(F.col("e"))).collect():
        assert back == t and "<|" not in e


def test_formatting_uses_expressions_only(chats):
    plan = chat_format.formatted(chats)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_conversations(spark):
    assert chat_format.digests(chat_format.formatted(spark.createDataFrame([], CHAT))).collect() == []


def test_stored_tables_are_made_from_small_batches(spark):
    """Whatever the session allows: a batch of texts lies in memory twice for each core."""
    import pyarrow as pa

    from leadloom.llm.tables import BATCH_ROWS, stored

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for bound, most in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("70", 70)):
            spark.conf.set(name, bound)
            found = [r.n for r in stored(spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long"), "sizes", small=True).collect()]
            assert sum(found) == 2500 and max(found) == most
            assert spark.conf.get(name) == bound
    finally:
        spark.conf.set(name, before)
