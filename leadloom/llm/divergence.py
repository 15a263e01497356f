"""How far the sources of a language differ in what they say, by bitmaps of terms for each count.

The terms of a language that are in enough of its documents are numbered. A group is a language and a source.
For each group and each count there is a bitmap over term numbers, of the terms that occur that often in the
group; it is stored as its 64-bit words that are not zero. For two sources, the AND of a bitmap of one and a bitmap of
the other, and its population count, give the number of terms with that pair of counts (a cell of their joint table). A
cell is multiplied by what such a pair of counts contributes, which is the same for all its terms. Terms that a
group has not are the complement of the union of its bitmaps.

Words of a language go to units of WIDTH words and two blocks of GROUPS groups, so a unit's size is bounded
whatever the vocabulary, the number of sources and the share of one of them. Terms are numbered by falling frequency,
so the words of rare terms, which are most, hold few distinct counts.

All arithmetic is on integers; shares of counts are computed as decimals of 38 digits.

Defined cases: a NULL text, language or source is empty text. A language with one source has no pairs. A group without kept
terms has the least share for all of them. Without kept terms all values are 0. Repeated rows are documents of their own.
Other columns are not read. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.places import placed
from leadloom.llm.spans import slices, text_column, word_ranges
from leadloom.llm.tables import stored
from leadloom.session import ship

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
RANKS = 50
WIDTH = 16  # words of 64 terms in a unit
GROUPS = 64  # groups in a block
PIECE = 1 << 23  # bytes of text whose terms are counted at once

_LETTERS = np.zeros(256, bool)
_LETTERS[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTED = "lang string, source string, term string, docs long, count long"


def terms(data, offsets):
    """(term of each occurrence as a dictionary array, document of each) of some texts."""
    starts, ends, bounds = word_ranges(data, offsets, _LETTERS)
    if not len(starts):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64)
    letters = _LOWER[data[_LETTERS[data]]]
    places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    return words.dictionary_encode(), np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))


def _counts(batches):
    """Counts of each term, and of its documents, in each group of a run of texts."""
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names, of = np.unique([f"{len(g['lang'])}:{g['lang']}{g['source']}" for g in group.to_pylist()], return_inverse=True)
        first = np.zeros(len(names), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        for at, piece, bounds in slices(data, offsets, PIECE):
            words, doc = terms(piece, bounds)
            if not len(doc):
                continue
            code, width = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            in_doc, times = np.unique(doc * width + code, return_counts=True)
            key, back = np.unique(of[at + in_doc // width] * width + in_doc % width, return_inverse=True)
            docs = np.bincount(back, minlength=len(key))
            counts = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
            rows = pa.array(first[key // width])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(rows), batch.column("source").take(rows), words.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(counts)],
                ["lang", "source", "term", "docs", "count"],
            )


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, docs, count)``: occurrences in the group, and documents of it that have the term."""
    ship(docs.sparkSession)
    counted = _named(docs).mapInArrow(_counts, _COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def share(count, total, n_terms):
    """The smoothed share of a term among ``total`` occurrences of ``n_terms`` terms, in parts of UNIT, from 1 up."""
    # Decimals hold every product of two of these numbers.
    return F.expr(f"1 + (cast({UNIT} as decimal(18,0)) * cast({count} + {SMOOTHING} as decimal(20,0))) div greatest(cast({total} + {SMOOTHING} * {n_terms} as decimal(20,0)), 1)")


class Model:
    """Kept terms, their counts by group, and the groups, stored."""

    def __init__(self, docs: DataFrame, least_docs=LEAST_DOCS):
        counts = stored(term_counts(docs), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= least_docs)
        numbered = placed(kept.drop("docs"), "lang", [F.desc("all"), F.col("term")], "kept-terms")
        self.terms = stored(numbered.select("lang", "term", "all", F.col("place").alias("id")), "term-numbers")
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("all").alias("lang_total"))
        self.counts = stored(counts.join(self.terms, ["lang", "term"]).select("lang", "source", "term", "id", "all", "count"), "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        groups = _named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "n_terms", "lang_total")])
        numbers = placed(groups, "lang", [F.col("source")], "groups")
        self.groups = stored(numbers.withColumnsRenamed({"place": "number", "n": "n_groups"}), "group-numbers")

    def bitmaps(self) -> DataFrame:
        """``(lang, source, count, word, bits)``: the words that are not zero of each group's and count's bitmap."""
        word = F.shiftright("id", 6).alias("word")
        bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
        return self.counts.groupBy("lang", "source", "count", word).agg(F.bit_or(bit).alias("bits"))


def _pairs(rows):
    """Sums over a unit's terms for each pair of its groups: the cells of their joint counts, each times its difference."""
    lang, low, high, chunk = (rows.column(c)[0].as_py() for c in ("lang", "low", "high", "chunk"))
    number, word, bits, p, sizes = (rows.column(c).to_numpy() for c in ("number", "word", "bits", "p", "n_terms"))
    head = word < 0
    groups, base = number[head], p[head]
    groups, base = np.sort(groups), base[np.argsort(groups)]
    n_terms, first = int(sizes[0]), chunk * WIDTH
    row, word, bits, p = np.searchsorted(groups, number[~head]), word[~head], bits[~head].view(np.uint64), p[~head]
    # Pairs within one block, or from the lower one to the higher.
    split = int(np.searchsorted(groups, high * GROUPS)) if low < high else 0
    sums = np.zeros((len(groups), len(groups)), np.int64)
    for w in range(first, min(first + WIDTH, -(-n_terms // 64))):
        here = word == w
        have = np.zeros(len(groups), np.uint64)
        np.bitwise_or.at(have, row[here], bits[here])
        mask = np.uint64((1 << min(64, n_terms - 64 * w)) - 1)
        # The complement is the bitmap of count 0.
        of = np.concatenate((np.arange(len(groups)), row[here]))
        order = np.argsort(of, kind="stable")
        bit, value = np.concatenate((~have & mask, bits[here]))[order], np.concatenate((base, p[here]))[order]
        starts = np.append(np.searchsorted(of[order], np.arange(len(groups))), len(order))
        for g in range(split or len(groups) - 1):
            to = max(split, g + 1)
            a, b = slice(starts[g], starts[g + 1]), slice(starts[to], None)
            cells = np.bitwise_count(bit[a, None] & bit[b])
            total = (cells * np.abs(value[a, None] - value[b])).sum(axis=0)
            sums[g, to:] += np.add.reduceat(total, starts[to:-1] - starts[to])
    one, other = np.triu_indices(len(groups), 1)
    if split:
        one, other = one[(one < split) & (other >= split)], other[(one < split) & (other >= split)]
    found = {"lang": pa.array([lang] * len(one), pa.string()), "one": groups[one], "other": groups[other], "value": sums[one, other]}
    return pa.table({c: pa.array(v) for c, v in found.items()})


def pair_values(model: Model) -> DataFrame:
    """``(lang, one, other, value)``: for the numbers of two groups, the lower first, the sum of their differences over all kept terms."""
    ship(model.groups.sparkSession)
    group = model.groups.select("lang", "source", "number", "n_groups", "n_terms", "total")
    bits = model.bitmaps().join(group, ["lang", "source"]).withColumn("p", share("count", "total", "n_terms"))
    bits = bits.withColumn("chunk", F.floor(F.col("word") / WIDTH).cast("long"))
    # Every group takes part in every unit of its language, also where it has no term.
    chunks = F.explode(F.expr(f"sequence(0L, greatest(n_terms - 1, 0L) div {64 * WIDTH})"))
    heads = group.withColumns({"p": share("0", "total", "n_terms"), "chunk": chunks, "word": F.lit(-1).cast("long"), "bits": F.lit(0).cast("long")})
    columns = ["lang", "number", "n_groups", "n_terms", "word", "bits", "p", "chunk"]
    rows = bits.select(columns).unionByName(heads.select(columns))
    rows = rows.withColumn("own", F.floor(F.col("number") / GROUPS).cast("long"))
    rows = rows.withColumn("with", F.explode(F.expr(f"sequence(0L, (n_groups - 1) div {GROUPS})")))
    rows = rows.withColumns({"low": F.least("own", "with"), "high": F.greatest("own", "with")}).drop("own", "with", "n_groups")
    found = rows.groupBy("lang", "chunk", "low", "high").applyInArrow(_pairs, "lang string, one long, other long, value long")
    return found.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def pairs(model: Model) -> DataFrame:
    """``(lang, source, item, value)``: the item is another source of the language."""
    sums = stored(pair_values(model), "pair-values")
    both = sums.unionAll(sums.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    name = lambda number, source: model.groups.select("lang", F.col("number").alias(number), F.col("source").alias(source))
    return both.join(name("one", "source"), ["lang", "one"]).join(name("other", "item"), ["lang", "other"]).select("lang", "source", "item", "value")


def telling_terms(model: Model) -> DataFrame:
    """``(lang, source, item, value)``: terms that have a greater share in the group than in its language."""
    group = model.groups.select("lang", "source", "total", "n_terms", "lang_total")
    rows = model.counts.join(group, ["lang", "source"])
    value = share("count", "total", "n_terms") - share("`all`", "lang_total", "n_terms")
    return rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def report(docs: DataFrame, least_docs=LEAST_DOCS, ranks=RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs, and the ``ranks`` most telling terms of each group."""
    model = Model(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, rows: rows.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    top = ranked("term", telling_terms(model)).where(F.col("rank") <= ranks)
    return ranked("pair", pairs(model)).select(columns).unionByName(top.select(columns))
