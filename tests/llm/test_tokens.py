"""Tokenizers against the library, and the binary store against an exact round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import merge_count, prefix_bpe, token_store
from leadloom.llm.merge_count import merges
from leadloom.llm.vocabulary import place
from tests.llm.conftest import edge_rows, same


def library(name):
    return Tokenizer.from_file(place(name))


def test_merge_counts_equal_the_library(edges, nothing):
    tokens = library(merge_count.VOCABULARY)
    want = []
    for doc_id, text, *_ in edge_rows():
        n = len(tokens.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    same(merge_count.token_counts(edges).collect(), want)
    assert merge_count.token_counts(nothing).collect() == []


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    ranks = {1 << 32 | 1: 0, 2 << 32 | 1: 1}  # 11 -> 2, 21 -> 3
    assert merges([1, 1, 1, 1, 1], ranks, [2, 3]) == 3  # 2 2 1, then 2 3
    assert merges([], ranks, [2, 3]) == 0 and merges([1], ranks, [2, 3]) == 0


def test_prefix_encoding_equals_the_library(edges, nothing):
    tokens = library(prefix_bpe.VOCABULARY)
    want, full = [], []
    for doc_id, text, *_ in edge_rows():
        ids = tokens.encode(text or "", add_special_tokens=False).ids
        decoded = tokens.decode(ids, skip_special_tokens=False)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(decoded)))
        full.append((doc_id, len(ids), ids, decoded))
    same(prefix_bpe.digests(edges).collect(), want)
    same(prefix_bpe.encode(edges).collect(), full)
    assert prefix_bpe.encode(nothing).collect() == []


def merged_by_hand(symbols, ranks, made):
    """The symbols left when the pair of lowest rank, the leftmost first, has been merged again and again."""
    while True:
        pairs = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 32 | b in ranks]
        if not pairs:
            return symbols
        rank, i = min(pairs)
        symbols = [*symbols[:i], made[rank], *symbols[i + 2 :]]


def test_pairs_fit_exactly_when_encoding_leaves_them():
    code = prefix_bpe.encoder(prefix_bpe.VOCABULARY)
    inner = [t for t in code.spelled if ord(code.spelled[t][-1]) < 256]
    rng = random.Random(1)
    for _ in range(1500):
        left, right = rng.choice(inner), rng.choice(list(code.spelled))
        symbols = [code.symbol[c] for c in code.spelled[left] + code.spelled[right]]
        merged = merged_by_hand(symbols, code.vocabulary.ranks, code.vocabulary.made)
        if code._alone(left) and code._alone(right):
            assert code._fit(left, right) == (merged == [left, right])


@pytest.mark.parametrize("seed", range(4))
def test_random_pieces_equal_the_library(seed):
    rng = random.Random(seed)
    letters = "etaoinshrdlu'.é日 \n1"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    tokens, code = library(prefix_bpe.VOCABULARY), prefix_bpe.encoder(prefix_bpe.VOCABULARY)
    ids, bounds = code.encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tokens.encode(text, add_special_tokens=False).ids
    bytes_tokens, count = library(merge_count.VOCABULARY), merge_count.counter(merge_count.VOCABULARY)
    assert [count(t) for t in texts] == [len(bytes_tokens.encode(t).ids) for t in texts]


@pytest.mark.parametrize(
    "values",
    [[], [0], [0] * 500, [0] * 239 + [7], [1 << 63, 5, (1 << 60) - 1, 1 << 60, 0], list(range(300)), [1] * 61, [3, 1 << 59] * 9],
)
def test_packing_round_trip(values):
    data, n_raw = token_store.pack(np.array(values, np.uint64))
    assert token_store.unpack(data, n_raw).tolist() == values


def test_packing_chooses_wide_words():
    assert len(token_store.pack(np.zeros(240, np.uint64))[0]) == 8
    assert len(token_store.pack(np.full(60, 1, np.uint64))[0]) == 8
    assert len(token_store.pack(np.full(8, 1 << 14, np.uint64))[0]) == 16


def test_store_reads_back_what_the_library_gives(spark, edges, tmp_path):
    rows = [r for r in edge_rows()]
    folder = str(tmp_path / "store")
    token_store.write(edges, folder, block_ids=100)
    tokens = library(token_store.VOCABULARY)
    hashed = spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t) h")
    place = {r["t"]: r["h"] for r in hashed.collect()}
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], place[r[1] or ""]))
    want, lists, start = [], [], 0
    for doc_id, text, *_ in ordered:
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, token_store.END]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        lists.append((doc_id, ids))
        start += len(ids)
    blocks = token_store.read(spark, folder)
    same(token_store.digests(blocks).collect(), want)
    same(token_store.documents(blocks).collect(), lists)


def test_words_go_to_the_library_without_marks_between_them(monkeypatch):
    """Words that begin with a space follow each other; bytes that are no UTF-8 and words without a space keep their ids."""
    rng = random.Random(5)
    parts = ["a", "Zé", "7", "'s", "'ll", "&&", "ß", "漢字", "\x1c", "\ufffd", "\U0001f600", "|>", " ", "  ", "\n", "\t", "\r\n"]
    some = ["".join(rng.choices(parts, k=rng.randrange(40))).encode() for _ in range(400)]
    some += [b"x \xff\xc3 y\xe2\x82 z", b"\xc3", b" \xf0\x9f q", b" new words here", b"more new words", b""]
    data, offsets = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
    code, asked = token_store.Encoder(token_store.VOCABULARY), []
    plain = code.library
    monkeypatch.setattr(code, "library", lambda text: asked.append(text) or plain(text))
    for _ in range(2):  # the second time, most come from the table
        ids, sizes = code.encode(data, offsets)
        want = [plain(text.decode("utf-8", "replace")) for text in some]
        assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert any(" words" in text for text in asked) and not any("\n" + word in text for text in asked for word in (" new", " words", " here"))


def test_rows_that_share_an_id_are_dealt_out(spark, tmp_path):
    """Half of the rows have one id, half of these one text."""
    rows = [(k, f"t {k}") for k in range(2000)] + [(77, "copy")] * 1000 + [(77, f"hot {k}") for k in range(1000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "store"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    blocks = token_store.read(spark, str(tmp_path / "store"))
    sizes = [r["n"] for r in blocks.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]
    starts = [(r["start"], r["doc_id"]) for r in token_store.digests(blocks).collect()]
    assert [i for _, i in sorted(starts)] == sorted(i for i, _ in rows)


def test_empty_store(spark, nothing, tmp_path):
    token_store.write(nothing, str(tmp_path / "empty"))
    assert token_store.digests(token_store.read(spark, str(tmp_path / "empty"))).collect() == []
