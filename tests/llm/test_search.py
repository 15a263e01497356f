"""Near-duplicates, decontamination and WARC against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import decontaminate, near_dedup, warc
from leadloom.llm.components import components
from leadloom.llm.tables import row_key, table
from tests.llm.conftest import edge_rows, same

BETWEEN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def near_by_hand(rows, size):
    sets = []
    for _, text in rows:
        w = BETWEEN.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [r[0] for r, g in zip(rows, group) if g == group[k] and r[0] is not None] if sets[k] else [doc_id]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[k]), least, doc_id == least))
    return out


def test_near_duplicates_with_edge_cases(edges, nothing):
    rows = [(r[0], r[1]) for r in edge_rows()]
    same(near_dedup.near_duplicates(edges, size=4).collect(), near_by_hand(rows, 4))
    assert near_dedup.near_duplicates(nothing).collect() == []


def _copies(n):
    """A large group of near copies, a chain of them, and unrelated texts."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(90)], []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(90)] = word()
        rows.append(" ".join(w))
    for k in range(12):
        rows.append(" ".join([f"c{i}" for i in range(4 * k, 4 * k + 60)]))
    return list(enumerate([*rows, *(" ".join(word() for _ in range(30)) for _ in range(20))]))


def test_large_groups_over_several_blocks_lose_no_link(spark):
    rows = _copies(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(near_dedup.near_duplicates(docs, size=4, block=16).collect(), near_by_hand(rows, 4))


def test_one_of_each_keeps_columns_and_a_single_row(edges):
    left = near_dedup.one_of_each(edges)
    assert left.columns == edges.columns
    ids = [r["doc_id"] for r in left.collect()]
    by_hand = {i for i, _, least, kept in near_by_hand([(r[0], r[1]) for r in edge_rows()], 5) if kept}
    assert {i for i in ids if i is not None} == {i for i in by_hand if i is not None} and ids.count(7) <= 1


def test_one_of_each_decides_by_row(spark):
    """Rows that share an id, NULL too, are documents of their own."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcde")
    stay = [(None, a), (None, b), (3, c), (3, d), (None, ""), (None, ""), (5, e)]
    go = [(None, a), (None, a + " tail"), (5, c + " tail"), (None, c.upper()), (5, e), (6, d)]
    left = near_dedup.one_of_each(spark.createDataFrame(stay + go, "doc_id long, text string").repartition(3)).collect()
    least = [(None, min((a, a + " tail"), key=lambda t: near_key(spark, t)))]
    same(left, [*stay[1:], *least])


def near_key(spark, text):
    return spark.createDataFrame([(None, text)], "doc_id long, text string").select(row_key()).first()[0]


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(0)
    for overlap in (0.95, 0.85):
        errors = []
        for _ in range(40):
            n = 1000
            common = int(round(2 * n * overlap / (1 + overlap)))
            values = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = values[:n], values[n - common :]
            ones = np.bitwise_count(near_dedup.odd_sketch(near_dedup.min_hashes(a)) ^ near_dedup.odd_sketch(near_dedup.min_hashes(b))).sum()
            errors.append(near_dedup.estimate(ones) - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), *((100, k) for k in range(101, 140)), *((k, k + 1) for k in range(200, 230))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys((1, 3, 4, 5), 1), 8: 8, 9: 8, **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(200, 231), 200)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def hits_by_hand(rows, items, window=10):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    runs = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[a : a + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(r) for r in runs}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in runs:
                    hit.update(range(a, a + n))
                    found |= runs[tuple(w[a : a + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def _items():
    rows = edge_rows()
    part = lambda k, a, b: " ".join(rows[k][1].split()[a:b])
    return [(10, part(5, 0, 30)), (9, part(5, 10, 25)), (2, part(24, 5000, 5040)), (3, "one"), (4, None), (5, ""), (6, "the the the the the the the the the the the"), (7, "absent words " * 8), (None, part(6, 3, 20)), (10, part(7, 0, 12))]


@pytest.mark.parametrize("block_words, asked", [(1 << 19, 1 << 15), (40, 7)])
def test_decontamination_with_edge_cases(spark, edges, tmp_path, block_words, asked):
    items = spark.createDataFrame([(*r, 1) for r in _items()], "item_id long, text string, block long")
    decontaminate.build(edges, str(tmp_path / "i"), block_words)
    index = decontaminate.read(spark, str(tmp_path / "i"))
    got = decontaminate.contamination(index, items, asked=asked).collect()
    same(got, hits_by_hand([(r[0], r[1]) for r in edge_rows()], _items()))


def test_decontamination_of_nothing(spark, nothing, edges, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    decontaminate.build(nothing, str(tmp_path / "a"))
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(decontaminate.read(spark, str(tmp_path / "a")), some).collect() == []
    decontaminate.build(edges, str(tmp_path / "b"))
    assert not any(r["contaminated"] for r in decontaminate.contamination(decontaminate.read(spark, str(tmp_path / "b")), none).collect())


def test_nearby_words_in_any_order(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x a y b z c x"), (2, "c b a"), (3, "a q q q q q b q q q q c"), (4, "a b")], "doc_id long, text string")
    decontaminate.build(docs, str(tmp_path / "n"))
    index = decontaminate.read(spark, str(tmp_path / "n"))
    found = decontaminate.nearby(index, spark.createDataFrame([(7, "a b c")], "item_id long, text string"), span=5)
    names = decontaminate.indexed_documents(index)
    rows = found.join(names, ["block", "doc"]).select("doc_id", "item_id", "first", "last").collect()
    same(rows, [(1, "7", 1, 6), (2, "7", 0, 3)])


@pytest.mark.parametrize("numbers", [[], [0], [7, 3, 2**32 - 1, 0, 5], list(range(0, 9000, 3))])
def test_packed_numbers_come_back(numbers):
    assert decontaminate.unpacked(decontaminate.packed(np.array(numbers, np.int64))).tolist() == numbers


def near_by_words(docs, items, span):
    """Spans of words, cut at the ends of a text, that hold all words of an item; merged where they touch."""
    out = set()
    for doc_id, text in docs:
        w = text.split()
        for item, words in items:
            need, reached = Counter(words.split()), None
            for start in range(1 - span, len(w)):
                low, high = max(start, 0), min(start + span, len(w))
                if not need - Counter(w[low:high]):
                    reached = (low, high) if reached is None or low > reached[1] else (reached[0], high)
                elif reached is not None and max(start + 1, 0) > reached[1]:
                    out.add((doc_id, str(item), *reached))
                    reached = None
            if reached is not None:
                out.add((doc_id, str(item), *reached))
    return out


@pytest.mark.parametrize("block_words, asked", [(1 << 19, 1 << 15), (30, 2)])
def test_nearby_equals_brute_force(spark, tmp_path, block_words, asked):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("aaaaaabbbcdefgh") for _ in range(n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(40)]
    items = [(k, text(rng.randrange(1, 6))) for k in range(12)] + [(99, "a " * 20), (98, "absent a")]
    decontaminate.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), str(tmp_path / "n"), block_words)
    index = decontaminate.read(spark, str(tmp_path / "n"))
    found = decontaminate.nearby(index, spark.createDataFrame(items, "item_id long, text string"), 4, asked)
    rows = found.join(decontaminate.indexed_documents(index), ["block", "doc"]).select("doc_id", "item_id", "first", "last").collect()
    same(rows, sorted(near_by_words(docs, items, 4)))


def test_a_passage_of_many_items_and_documents_is_one_run(spark, tmp_path):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(f"x {passage} y").alias("text"))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    decontaminate.build(docs, str(tmp_path / "p"), 1000)
    index = decontaminate.read(spark, str(tmp_path / "p"))
    runs = decontaminate.runs_of(decontaminate.item_terms(items), 10).select("terms").distinct().withColumn("ask", F.monotonically_increasing_id())
    asked = decontaminate.asked_of_blocks(index, runs, 2)
    assert runs.count() == 3
    assert max(r["n"] for r in asked.select(F.size("asks").alias("n")).collect()) <= 3
    assert asked.select(F.sum(F.size("asks"))).first()[0] == 3 * index.count()
    got = decontaminate.contamination(index, items).collect()
    assert {tuple(r)[1:4] for r in got} == {(14, 12, 50)} and len(got) == 3000


HOSTILE = ["<p>x</p>", "WARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", "\r\n\r\n", "é日本",
           "Content-Length: 9999\r\n\r\n", "WARC/1.1\r\nContent-Length: 100000\r\n\r\n", "y" * 300, ""]


@pytest.mark.parametrize("split", ["2k", "128m"])
def test_warc_round_trip_with_version_lines_in_payloads(spark, tmp_path, split):
    rng = random.Random(1)
    html = lambda: rng.choice([None, "", "same", "".join(rng.choice(HOSTILE) for _ in range(rng.randrange(9)))])
    rows = [(i, f"http://x/{i}", html(), 1) for i in range(150)] + [(3, "u", "same", 1), (None, None, "same", None), (None, "a\r\nb", "q", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    least, copies = {}, {}
    for i, _, h, _ in rows:
        copies[h or ""] = copies.get(h or "", 0) + 1
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        h = h or ""
        first = least.get(h) if copies[h] > 1 and least.get(h, i) != i else None
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.append((i, len(h.encode()), digest, "response" if first is None else "revisit", first))
    folder, before = str(tmp_path / "w"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write(pages, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        same(warc.page_records(spark, folder).collect(), want)
        payloads = [bytes(r["value"]).decode() for r in warc.records(spark, folder).collect() if "WARC-Type: response" in r["header"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(payloads) == sorted(h or "" for (i, _, h, _), w in zip(rows, want) if w[3] == "response")


def test_warc_of_no_pages_and_small_payloads(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "none"))
    assert warc.page_records(spark, str(tmp_path / "none")).collect() == []
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "some"), min_bytes=3)
    got = {r["page_id"]: r["refers_to"] for r in warc.page_records(spark, str(tmp_path / "some")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_queries_equal_brute_force(spark, small):
    from leadloom.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    same(queries.op2_near_duplicates(spark, small).collect(), near_by_hand(docs, 4))
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    same(queries.op10_decontamination(spark, small).collect(), hits_by_hand(docs, items))


def test_describing_texts_takes_little_memory():
    """Several megabytes of texts in one batch: a worker needs memory for a piece of them, not for all."""
    import tracemalloc

    import numpy as np

    from leadloom.llm.quality_pu import describe
    from leadloom.llm.spans import BETWEEN_SPACES, hashes, slices, word_ranges

    text = np.frombuffer(b"some words of a text that is long enough " * 100, np.uint8)
    data, offsets = np.tile(text, 1000), np.arange(1001) * len(text)
    whole = hashes(data, *word_ranges(data, offsets, BETWEEN_SPACES)[:2])
    tracemalloc.start()
    try:
        parts = []
        for _, part, places in slices(data, offsets):
            assert len(describe(part, places)) == len(places) - 1
            parts.append(hashes(part, *word_ranges(part, places, BETWEEN_SPACES)[:2]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (np.concatenate(parts) == whole).all()
    assert most < 40 << 20
