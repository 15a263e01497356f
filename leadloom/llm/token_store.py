"""Token ids in a word-aligned binary format (Simple-8b), written and read as blocks.

A 64-bit word holds a 4-bit selector and 60 bits of ids, all of the width that the selector
names; the encoder takes the selector that packs most. A value of more than 60 bits is an
escape: its word holds a place in a list of raw values after the words. A block is a row

    part, block     place in the order of documents
    doc_ids, sizes  its documents, which lie in it whole, and their numbers of ids
    n_raw, data     number of raw values; words and then raw values, little-endian

so that blocks decode alone, each in a few array operations per selector. Documents ascend by id
over parts, blocks and within a block; ``starts`` has the number of ids before each block.

Tokens come from the tokenizers library. Texts are cut where no token can cross, and the ids of
recurring words are kept in a table of fixed size that is looked up with numpy.

Defined cases: a NULL or empty text has only its end id. A NULL id comes first; rows with the same
id follow each other ordered by a hash of their text. Other columns are not read. An empty table gives an empty store.
"""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.places import tie_breaker
from leadloom.llm.spans import BETWEEN_SPACES, hashes, slices, text_column
from leadloom.llm.tables import texts
from leadloom.llm.vocabulary import place

VOCABULARY = "byte_bpe_50k.json"
END = 0
BLOCK = 1 << 16  # ids after which a block ends
_U = np.uint64

#: Ids per word and their width, by selector; selector 1 is the escape.
COUNT = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, WIDEST = 1, 15
_STEP = COUNT.astype(np.uint8).tobytes()


def _runs(good, n):
    """At each place, whether the next n are all true; doubles the length looked at."""
    have = 1
    while have < n:
        step = min(have, n - have)
        good = good[: len(good) - step] & good[step:]
        have += step
    return good


def pack(ids):
    """(words and raw values as bytes, number of raw values) of an array of non-negative integers."""
    ids = np.asarray(ids)
    if not len(ids):
        return b"", 0
    if ids.dtype != np.uint32:
        ids = ids.astype(_U)
    largest = int(ids.max())
    choice = np.full(len(ids), WIDEST, np.uint8)
    for selector in [*range(WIDEST - 1, ESCAPE, -1), 0]:
        n = int(COUNT[selector])
        if n > len(ids):
            break
        limit = 1 << int(WIDTH[selector])
        fits = _runs(ids < ids.dtype.type(limit), n) if limit <= largest else np.ones(len(ids) - n + 1, bool)
        if not fits.any():
            break
        choice[: len(fits)][fits] = selector
    if largest >> 60:
        choice[ids >> _U(60) != 0] = ESCAPE
    steps, i, places = choice.tobytes(), 0, []
    add = places.append
    while i < len(ids):
        add(i)
        i += _STEP[steps[i]]
    places = np.array(places)
    chosen = choice[places]
    words = np.zeros(len(places), _U)
    raw = ids[places[chosen == ESCAPE]].astype(_U)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        value = np.zeros(len(rows), _U)
        if selector == ESCAPE:
            value = np.arange(len(rows), dtype=_U)
        elif WIDTH[selector]:
            for k in range(COUNT[selector]):
                value |= ids[places[rows] + k].astype(_U) << _U(k * WIDTH[selector])
        words[rows] = value | _U(int(selector) << 60)
    return words.tobytes() + raw.tobytes(), len(raw)


def unpack(data, n_raw=0):
    """The integers that ``pack`` was given."""
    words = np.frombuffer(data, _U)
    words, raw = words[: len(words) - n_raw], words[len(words) - n_raw :]
    selector = (words >> _U(60)).astype(np.int64)
    counts = COUNT[selector]
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1] if len(ends) else 0, _U)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        first, value = ends[rows] - counts[rows], words[rows] & _U((1 << 60) - 1)
        if s == ESCAPE:
            out[first] = raw[value.astype(np.int64)]
        elif WIDTH[s]:
            for k in range(COUNT[s]):
                out[first + k] = (value >> _U(k * WIDTH[s])) & _U((1 << int(WIDTH[s])) - 1)
    return out


class Encoder:
    """Ids of whole texts with the tokenizers library, asked once for each recurring word."""

    SLOTS, KEPT = 20, 1 << 23

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(place(path))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self.library("\n")
        if len(self.line_end) != 1:
            raise ValueError("a line end must be one token")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # A byte-level token is written with one character for each of its bytes.
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._reset()

    def _reset(self):
        size = 1 << self.SLOTS
        self.key, self.first = np.zeros(size, _U), np.zeros(size, _U)
        self.at, self.size = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def library(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, ids):
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(len(self.store), np.uint32)))
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _units(self, units):
        """(places, sizes) in the store of the ids of units. Those with words go to the library after each other as one
        text, where a space or a line end begins a token; the bytes of the tokens tell where each unit ends."""
        blank = np.array([unit.isspace() for unit in units], bool)
        words = np.flatnonzero(~blank)
        sizes = np.zeros(len(units), np.int64)
        found = []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            pieces = [units[i] for i in some]
            text = b"".join([unit if unit[:1] == b" " else b"\n" + unit for unit in pieces]).decode("utf-8", "replace")
            if "\ufffd" in text:  # stands for bytes that are no UTF-8, by others of another number
                pieces = [unit.decode("utf-8", "replace").encode() for unit in pieces]
            after_line_end = np.array([unit[:1] != b" " for unit in pieces])
            ends = np.cumsum(np.array([len(unit) for unit in pieces]) + after_line_end)
            ids = np.array(self.library(text), np.uint32)
            reached = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if cuts[-1] != len(ids) or (reached[cuts - 1] != ends).any():
                raise ValueError("a token crosses the end of a word")
            first = np.concatenate(([0], cuts[:-1]))
            line_ends = first[after_line_end]
            if (ids[line_ends] != self.line_end[0]).any():
                raise ValueError("a line end became part of a token")
            sizes[some] = cuts - first - after_line_end
            found.append(np.delete(ids, line_ends))
        for k in np.flatnonzero(blank):
            found.append(np.array(self.library(units[k].decode()), np.uint32))
            sizes[k] = len(found[-1])
        order = np.concatenate((words, np.flatnonzero(blank)))
        places = np.empty(len(units), np.int64)
        places[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self._add(np.concatenate(found))
        return places, sizes

    def _odd(self, data, offsets):
        """Texts that go to the library whole: with white space beyond ASCII, or special strings."""
        odd = np.zeros(len(offsets) - 1, bool)
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        white |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        white |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        white |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        white |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd[np.searchsorted(offsets, lead[white], "right") - 1] = True
        whole = data.tobytes()
        for special in self.special:
            at = whole.find(special)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = whole.find(special, at + 1)
        return odd

    def encode(self, data, offsets):
        """(ids, sizes) of texts that lie one after the other in ``data``."""
        if self.used > self.KEPT:
            self._reset()
        odd = self._odd(data, offsets)
        starts, ends = unit_ranges(data, offsets)
        text = np.searchsorted(offsets, starts, "right") - 1
        keep = ~odd[text]
        starts, ends, text = starts[keep], ends[keep], text[keep]
        h = hashes(data, starts, ends, lower=False)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        first = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))[starts]
        short = np.minimum(ends - starts, 8)
        first &= np.array([(1 << 8 * k) - 1 for k in range(9)], _U)[short]
        # A unit may be in either of two slots; one whose slots are taken displaces the first.
        slot = (h >> _U(64 - self.SLOTS)).astype(np.int64)
        other = (h & _U((1 << self.SLOTS) - 1)).astype(np.int64)
        slot = np.where(self.key[slot] == h, slot, np.where(self.key[other] == h, other, slot))
        known = (self.key[slot] == h) & (self.first[slot] == first) & (h != 0)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(~known)
        if len(missing):
            _, chosen, group = np.unique(h[missing], return_index=True, return_inverse=True)
            chosen = missing[chosen]
            whole = data.tobytes()
            places, sizes = self._units([whole[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())])
            at[missing], size[missing] = places[group], sizes[group]
            s = np.where(self.key[slot[chosen]] == 0, slot[chosen], other[chosen])
            s = np.where(self.key[s] == 0, s, slot[chosen])
            self.key[s], self.first[s], self.at[s], self.size[s] = h[chosen], first[chosen], places, sizes
        out_sizes = np.zeros(len(offsets) - 1, np.int64)
        np.add.at(out_sizes, text, size)
        out_ends = np.cumsum(size)
        ids = self.store[np.arange(out_ends[-1] if len(out_ends) else 0) + np.repeat(at - (out_ends - size), size)]
        if odd.any():
            pieces = np.split(ids, np.cumsum(out_sizes)[:-1])
            for k in np.flatnonzero(odd):
                found = self.library(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
                pieces[k], out_sizes[k] = np.array(found, np.uint32), len(found)
            ids = np.concatenate(pieces)
        return ids, out_sizes


def unit_ranges(data, offsets):
    """Byte ranges that cover all texts: words with the single space before them, and white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = BETWEEN_SPACES[data]
    begin = np.zeros(len(data), bool)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    end = np.zeros(len(data), bool)
    end[offsets[1:][np.diff(offsets) > 0] - 1] = True
    start = begin.copy()
    start[1:] |= ~word[1:] & word[:-1]
    start[1:-1] |= ~word[1:-1] & ~word[:-2] & word[2:] & ~end[1:-1]
    start[1:] |= word[1:] & ~word[:-1] & (data[:-1] != 0x20)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data))


@lru_cache(maxsize=None)
def encoder(path):
    return Encoder(path)


BLOCKS = "part int, block long, doc_ids array<long>, sizes array<long>, n_raw long, data binary"
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("n_raw", pa.int64()),
        ("data", pa.binary()),
    ]
)


def _encoded(path, end, block_ids):
    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        code = encoder(path)
        doc_ids, sizes, ids, held = [], [], [], 0

        def row():
            data, n_raw = pack(np.concatenate(ids).astype(np.uint32))
            columns = [[part], [block], [doc_ids], [sizes], [n_raw], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            data, offsets = text_column(batch.column("text"))
            for first, some, places in slices(data, offsets):
                found, counts = code.encode(some, places)
                for k, one in enumerate(np.split(found, np.cumsum(counts)[:-1])):
                    doc_ids.append(keys[first + k])
                    sizes.append(len(one) + 1)
                    ids += [one, [end]]
                    held += len(one) + 1
                    if held >= block_ids:
                        yield row()
                        doc_ids, sizes, ids, held, block = [], [], [], 0, block + 1
        if held:
            yield row()

    return run


def write(docs: DataFrame, folder: str, path=VOCABULARY, end=END, block_ids=BLOCK):
    """Encodes all documents, in ascending order of id, into a store at ``folder``."""
    # Rows that share an id, or are copies, are spread over parts as well.
    keys = ["doc_id", "hash", "tie"]
    keyed = texts(docs).withColumns({"hash": F.xxhash64("text"), "tie": tie_breaker()})
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ordered.mapInArrow(_encoded(path, end, block_ids), BLOCKS).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def starts(blocks: DataFrame) -> DataFrame:
    """``(part, block, first)``: the number of ids before each block."""
    counted = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, so a single task has few of them.
    parts = counted.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("before")
    )
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    return counted.join(parts, "part").select("part", "block", (F.col("before") + inside).alias("first"))


def _decoded(batches):
    """Per document: place, size, ids."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["data"], row["n_raw"]).astype(np.uint32)
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            yield row, ids, sizes, ends - sizes


def _digests(batches):
    for row, ids, sizes, first in _decoded(batches):
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([row["part"]] * len(crc), pa.int32()),
                "block": pa.array([row["block"]] * len(crc), pa.int64()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "inside": pa.array(first, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
        )


def _lists(batches):
    for row, ids, _, first in _decoded(batches):
        places = pa.array(np.append(first, len(ids)), pa.int32())
        lists = pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int64)))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": lists})


def documents(blocks: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` read back from a store."""
    return blocks.mapInArrow(_lists, "doc_id long, ids array<long>")


def digests(blocks: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from a store."""
    found = blocks.mapInArrow(_digests, "part int, block long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(starts(blocks), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
