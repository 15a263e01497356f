"""A distributed positional index of training tokens, searched for benchmark phrases.

``build`` turns documents into index blocks. A block holds whole documents with up to ``BLOCK``
words (or one longer document) and has a posting list for each of its terms: the ascending
positions of the term in the block. Blocks are made where the documents are read; a term that
every document has is spread over all blocks, and no list is ever gathered in one place.

``phrases`` finds each run of ``window`` words of the searched items (an item with fewer words is
one run). In every block the lists of a run's terms are shifted by the term's offset in the run and
intersected, beginning with the term that is rarest over the whole index, so most runs end with
one look-up. What is left are the exact places of the run. ``nearby`` finds the places where all
terms of an item lie within a span of words, in any order.

Items never visit the driver. Their distinct runs are rows; the sizes of posting lists, which are read without
the lists, give each run's rarest term, and a join by that term the blocks where the run can be. A
block meets its runs by a join on the block's number, at most about ``ASKED`` of them in a row, so blocks
without any are dropped and neither many items nor a frequent term meet in one place. Terms are
64-bit hashes of words.

Defined cases: a NULL or empty text has no words; an item without words is never found, a
document without words is clean. Items that share an id count as one item; a NULL item id is
written as an empty string. Repeated documents are reported row by row. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.spans import LETTERS_AND_DIGITS, hashes, slices, text_column, word_ranges
from leadloom.llm.tables import stored, texts

WINDOW = 10
BLOCK = 1 << 19  # words of a block
ASKED = 1 << 15  # runs that a block is searched for at a time, in expectation
_U = np.uint64

INDEX = "block long, doc_ids array<long>, doc_starts binary, terms binary, list_starts binary, positions binary"
_INDEX = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [(name, pa.binary()) for name in ("doc_starts", "terms", "list_starts", "positions")]
)


def term_runs(column):
    """(first text, terms, bounds) for runs of texts of an Arrow column."""
    data, offsets = text_column(column)
    for first, part, places in slices(data, offsets):
        starts, ends, bounds = word_ranges(part, places, LETTERS_AND_DIGITS)
        yield first, hashes(part, starts, ends), bounds


def packed(numbers):
    """The steps between 32-bit numbers (modulo 2^32), lowest bytes of all first: steps are mostly small, so the higher
    bytes are runs of zeros, which the codecs of files and shuffles shorten."""
    steps = np.diff(numbers.astype("<u4"), prepend=np.zeros(1, "<u4"))
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data):
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _block(number, doc_ids, sizes, terms):
    terms = np.concatenate(terms) if terms else np.zeros(0, _U)
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    columns = [
        [number],
        [doc_ids],
        [starts.tobytes()],
        [ranked[first].tobytes()],
        [packed(np.append(first, len(ranked)))],
        [packed(order)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)


def _indexed(block_words):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        doc_ids, sizes, terms, held = [], [], [], 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, found, bounds in term_runs(batch.column("text")):
                for k, n in enumerate(np.diff(bounds).tolist()):
                    if held and held + n > block_words:
                        yield _block(number, doc_ids, sizes, terms)
                        doc_ids, sizes, terms, held, number = [], [], [], 0, number + 1
                    doc_ids.append(keys[first + k])
                    sizes.append(n)
                    terms.append(found[bounds[k] : bounds[k + 1]])
                    held += n
        if doc_ids:
            yield _block(number, doc_ids, sizes, terms)

    return run


def build(docs: DataFrame, folder: str, block_words=BLOCK):
    """Writes the index of all documents to ``folder``."""
    blocks = texts(docs).mapInArrow(_indexed(block_words), INDEX)
    blocks.write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(folder)


class Block:
    """One row of the index."""

    def __init__(self, row):
        self.number = row["block"]
        self.doc_starts = np.frombuffer(row["doc_starts"], "<u8").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], _U)
        self.list_starts = unpacked(row["list_starts"])
        self.positions = unpacked(row["positions"])

    def lists(self, terms):
        """(begin, end) of the posting list of each term; empty where the block lacks it."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == terms
        return np.where(there, self.list_starts[at], 0).astype(np.int64), np.where(there, self.list_starts[at + 1], 0).astype(np.int64)

    def postings(self, begin, end):
        return self.positions[begin:end].astype(np.int64)

    def document(self, positions):
        return np.searchsorted(self.doc_starts, positions, "right") - 1


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id string, terms array<long>)``: the words of each item, as hashes."""

    def run(batches):
        for batch in batches:
            for first, found, bounds in term_runs(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, len(lists)), lists], ["item_id", "terms"])

    plain = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return plain.mapInArrow(run, "item_id string, terms array<long>").where(F.size("terms") > 0)


def runs_of(terms: DataFrame, window) -> DataFrame:
    """``(item_id, terms)``: the runs of ``window`` words of each item."""
    size = F.least(F.size("terms"), F.lit(window))
    first = F.sequence(F.lit(1), F.size("terms") - size + 1)
    return terms.select("item_id", F.explode(F.transform(first, lambda i: F.slice("terms", i, size))).alias("terms"))


def list_sizes(index: DataFrame, sought: DataFrame) -> DataFrame:
    """``(term, block, n)``: the sizes of the posting lists of the sought terms; the lists themselves are not read."""

    def run(batches):
        for batch in batches:
            for block, terms, starts in zip(*(batch.column(c) for c in ("block", "terms", "list_starts"))):
                found = np.frombuffer(terms.as_py(), np.int64)
                sizes = np.diff(unpacked(starts.as_py()).astype(np.int64))
                for k in range(0, len(found), 1 << 16):
                    s = slice(k, k + (1 << 16))
                    columns = {"term": found[s], "block": np.full(len(found[s]), block.as_py()), "n": sizes[s]}
                    yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})

    sizes = index.select("block", "terms", "list_starts").mapInArrow(run, "term long, block long, n long")
    return sizes.join(sought, "term", "left_semi")


def asked_of_blocks(index: DataFrame, runs: DataFrame, asked=ASKED) -> DataFrame:
    """``(block, asks array<struct<ask, terms, order>>)``: the runs ``(ask, terms)`` whose rarest term a block has; ``order``
    are the places in ``terms`` from the rarest term on. A run with a term that the index lacks is nowhere. A block
    has several rows where it has many runs."""
    words = runs.select("ask", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    sizes = stored(list_sizes(index, words.select("term").distinct()), "list-sizes")
    counts = sizes.groupBy("term").agg(F.sum("n").alias("n"))
    ranked = (
        words.join(counts, "term")
        .groupBy("ask", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("ranked"))  # at most a run's words
        .where(F.size("ranked") == F.col("size"))
        .select(
            "ask",
            F.transform(F.sort_array(F.transform("ranked", lambda r: F.struct(r["at"], r["term"]))), lambda r: r["term"]).alias("terms"),
            F.transform("ranked", lambda r: r["at"]).alias("order"),
            F.col("ranked")[0]["term"].alias("term"),
        )
    )
    ranked = stored(ranked, "ranked-runs")
    pieces = ranked.count() // asked + 1
    return (
        ranked.join(sizes.select("term", "block"), "term")
        .groupBy("block", F.pmod(F.xxhash64("ask"), F.lit(pieces)).alias("piece"))
        .agg(F.collect_list(F.struct("ask", "terms", "order")).alias("asks"))
        .select("block", "asks")
    )


def _asked(batches):
    """(block, [(ask, terms, order, begin, end)]) of each row: the runs all of whose terms the block has."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block({name: batch.column(name)[i].as_py() for name in ("block", "doc_starts", "terms", "list_starts", "positions")})
            asks = batch.column("asks")[i].values
            numbers = asks.field("ask").to_numpy()
            bounds = asks.field("terms").offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            terms = asks.field("terms").flatten().to_numpy().view(_U)
            order = asks.field("order").flatten().to_numpy()
            begin, end = block.lists(terms)
            there = np.flatnonzero(np.minimum.reduceat(end - begin, bounds[:-1]))
            parts = [slice(bounds[k], bounds[k + 1]) for k in there]
            yield block, [(ask, terms[s], order[s], begin[s], end[s]) for ask, s in zip(numbers[there].tolist(), parts)]


def places(block, begin, end, order):
    """Where a run begins in a block: its terms' lists, shifted and intersected in the given order."""
    left = None
    for offset in order:
        if begin[offset] == end[offset]:
            return np.zeros(0, np.int64)
        shifted = block.postings(begin[offset], end[offset])
        if left is None:
            left = shifted - offset
            continue
        at = np.searchsorted(shifted, left + offset)
        at[at == len(shifted)] = 0
        left = left[shifted[at] == left + offset]
        if not len(left):
            return left
    return left


MATCHES = "block long, doc long, ask long, first long, last long"


def _matches(block, found):
    """Rows of maximal stretches of words per document and run, from [(ask, first, last)] with ascending arrays."""
    rows = {name: [np.zeros(0, np.int64)] for name in ("block", "doc", "ask", "first", "last")}
    for ask, first, last in found:
        doc = block.document(first)
        new = np.concatenate(([True], (first[1:] > last[:-1]) | (doc[1:] != doc[:-1])))
        begin = np.flatnonzero(new)
        stop, doc = np.append(begin[1:], len(first)) - 1, doc[begin]
        rows["block"].append(np.full(len(begin), block.number))
        rows["doc"].append(doc)
        rows["ask"].append(np.full(len(begin), ask))
        rows["first"].append(first[begin] - block.doc_starts[doc])
        rows["last"].append(last[stop] - block.doc_starts[doc])
    return pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(parts)) for name, parts in rows.items()})


def _phrases(batches):
    for block, asks in _asked(batches):
        found = []
        for ask, terms, order, begin, end in asks:
            at = places(block, begin, end, order)
            # A run must not cross from one document into the next.
            at = at[block.document(at) == block.document(at + len(terms) - 1)] if len(at) else at
            if len(at):
                found.append((ask, at, at + len(terms)))
        yield _matches(block, found)


def _nearby(span):
    def run(batches):
        for block, asks in _asked(batches):
            found = []
            for ask, terms, order, begin, end in asks:
                lists = {}  # the list of each distinct term, and how many of it there must be
                for k in order:
                    p, n = lists.get(terms[k], (block.postings(begin[k], end[k]), 0))
                    lists[terms[k]] = p, n + 1
                # Every span with all terms begins or goes on at the rarest one.
                rarest = lists[terms[order[0]]][0]
                start = np.unique(np.concatenate([rarest - k for k in range(span)]))
                doc = block.document(np.maximum(start, 0))
                low, high = np.maximum(start, block.doc_starts[doc]), np.minimum(start + span, block.doc_starts[doc + 1])
                whole = np.ones(len(start), bool)
                for p, n in lists.values():
                    whole &= np.searchsorted(p, high) - np.searchsorted(p, low) >= n
                if whole.any():
                    found.append((ask, low[whole], high[whole]))
            yield _matches(block, found)

    return run


def _searched(index: DataFrame, wanted: DataFrame, search, asked) -> DataFrame:
    """``(block, doc, item_id, first, last)``: maximal stretches per document and item, from what ``search`` finds of each
    distinct run of ``wanted`` ``(item_id, terms)``. Equal runs are searched once and then given to all their items."""
    owners = stored(wanted.distinct(), "run-owners")
    runs = stored(owners.select("terms").distinct().withColumn("ask", F.monotonically_increasing_id()), "runs")
    asks = stored(asked_of_blocks(index, runs, asked), "asked-of-blocks")
    found = index.drop("doc_ids").join(asks, "block").mapInArrow(search, MATCHES)
    of_items = found.join(runs.join(owners, "terms").select("ask", "item_id"), "ask")
    here = Window.partitionBy("block", "doc", "item_id").orderBy("first", "last")
    reached = F.max("last").over(here.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0)
    stretch = F.sum("new").over(here.rowsBetween(Window.unboundedPreceding, 0))
    return (
        of_items.withColumn("new", new)
        .withColumn("stretch", stretch)
        .groupBy("block", "doc", "item_id", "stretch")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("stretch")
    )


def phrases(index: DataFrame, items: DataFrame, window=WINDOW, asked=ASKED) -> DataFrame:
    """``(block, doc, item_id, first, last)``: the words [first, last) of a document (the doc-th of
    its block) that lie in runs of an item."""
    return _searched(index, runs_of(item_terms(items), window), _phrases, asked)


def nearby(index: DataFrame, items: DataFrame, span: int, asked=ASKED) -> DataFrame:
    """As ``phrases``, for stretches of ``span`` words that hold all words of an item in any order, as often as the item has them."""
    short = item_terms(items).where(F.size("terms") <= span)  # no span holds more
    return _searched(index, short.select("item_id", F.sort_array("terms").alias("terms")), _nearby(span), asked)


def indexed_documents(index: DataFrame) -> DataFrame:
    """``(block, doc, doc_id, n_words)``: all documents of an index."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.diff(np.frombuffer(batch.column("doc_starts")[i].as_py(), "<u8").astype(np.int64))
                columns = {
                    "block": pa.array(np.full(len(sizes), batch.column("block")[i].as_py())),
                    "doc": pa.array(np.arange(len(sizes))),
                    "doc_id": batch.column("doc_ids")[i].values,
                    "n_words": pa.array(sizes),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return index.select("block", "doc_ids", "doc_starts").mapInArrow(run, "block long, doc long, doc_id long, n_words long")


def contamination(index: DataFrame, items: DataFrame, window=WINDOW, asked=ASKED) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each indexed row."""
    found = stored(phrases(index, items, window, asked), "phrases")
    here = Window.partitionBy("block", "doc").orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (
        found.withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), reached)))
        .groupBy("block", "doc")
        .agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    zero = F.lit(0).cast("long")
    return (
        indexed_documents(index)
        .join(hit, ["block", "doc"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.when(F.col("items").isNull(), zero).otherwise(F.size("items")).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        )
    )
