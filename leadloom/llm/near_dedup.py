"""Near-duplicate documents: banded MinHash finds candidates, odd sketches sift them, full sets decide.

A document's set holds its distinct shingles as 64-bit hashes. Documents with equal sets are one
class, so copies cost nothing beyond the first grouping.

1. MinHash gives ``BANDS`` bands of ``ROWS`` samples. Classes that agree in a band are candidates;
   each is joined to the smallest class of its bucket, and what hangs together is a cluster. At a
   similarity of 0.8 the chance that two classes share no band is 1e-7.
2. Clusters are compared in blocks of at most about ``BLOCK`` classes and ``BLOCK_SHINGLES``
   shingles. All samples are folded into an odd sketch: a bitmap in which each
   (sample number, value) flips one bit. The number of ones in the XOR of two sketches tells how
   many samples differ. Pairs that are estimated well below the threshold are dropped (the margin is
   six standard deviations), pairs already connected are skipped, and the others are
   confirmed on their full sets. Only links that connect something new are returned.
3. In a cluster of several blocks, blocks meet only as far as they may still connect something:
   every class outside the cluster's largest component is compared with all others.
4. Components of the confirmed links are the groups.

Defined cases: a NULL or empty text, or one without words, has an empty set and is linked with
nothing. Repeated rows have equal sets and are in one group. Rows that share an id are told apart by
their sets; a group's id is the smallest id in it, NULL only if all its ids are NULL. Other
columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.components import components
from leadloom.llm.spans import BETWEEN_SPACES, hashes, mix, shingles, slices, text_column, word_ranges
from leadloom.llm.tables import row_key, stored, texts, unused

PERCENT = 80
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
_U = np.uint64
_A = (mix(np.arange(1, SAMPLES + 1, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, SAMPLES + 1001, dtype=_U)).astype(np.uint32)


def shingle_sets(data, offsets, size):
    """The sorted distinct shingles of each text."""
    starts, ends, bounds = word_ranges(data, offsets, BETWEEN_SPACES)
    runs, run_bounds = shingles(hashes(data, starts, ends), bounds, size)
    return [np.unique(runs[a:b]) for a, b in zip(run_bounds[:-1].tolist(), run_bounds[1:].tolist())]


def min_hashes(found):
    """The least value of the set under each of ``SAMPLES`` permutations of 32-bit numbers."""
    values = (found >> _U(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 2048):
        part = values[k : k + 2048]
        np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out=least)
    return least


def bands(least):
    """One 64-bit key per band, in which the band's number takes part."""
    rows = least.reshape(BANDS, ROWS).astype(_U)
    key = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key ^ rows[:, k]) + _U(k)
    return key


def odd_sketch(least):
    """The samples' parity bitmap, as 64-bit words."""
    place = mix(least.astype(_U) ^ (np.arange(1, SAMPLES + 1, dtype=_U) << _U(32))) % _U(SKETCH_BITS)
    odd = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def estimate(ones):
    """The similarity that a number of ones in the XOR of two sketches stands for."""
    share = np.minimum(2 * ones / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS * np.log1p(-share) / (4 * SAMPLES)


def digest(found):
    """A set's identity as two 64-bit numbers."""
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()


def _described(size):
    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for first, part, places in slices(data, offsets):
                sets = shingle_sets(part, places, size)
                ids = [digest(s) for s in sets]
                keys = [bands(min_hashes(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                bounds = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, len(sets)),
                        "key": batch.column("key").slice(first, len(sets)),
                        "row": pa.array(np.arange(number, number + len(sets))),
                        "low": pa.array([a for a, _ in ids], pa.int64()),
                        "high": pa.array([b for _, b in ids], pa.int64()),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "bands": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(keys))),
                    }
                )
                number += len(sets)

    return run


def _sets(size):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for first, part, places in slices(data, offsets):
                sets = shingle_sets(part, places, size)
                ids = [digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "low": pa.array([a for a, _ in ids], pa.int64()),
                        "high": pa.array([b for _, b in ids], pa.int64()),
                        "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )

    return run


class Linker:
    """Finds links between sets, skipping pairs that are connected already."""

    def __init__(self, ids, sets, labels, percent):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.sizes = np.array([len(s) for s in sets])
        least = [min_hashes(s) for s in sets]
        self.sketches = np.array([odd_sketch(m) for m in least])
        # Six standard deviations of the estimate at the threshold, and the sketch's own spread.
        share = percent / 100
        self.floor = share - 6 * np.sqrt(share * (1 - share) / SAMPLES) - 0.04
        _, self.label = np.unique(labels, return_inverse=True)
        self.links = []

    def compare(self, i, others):
        """Confirms links of set i with the given others."""
        others = others[self.label[others] != self.label[i]]
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[100 * small >= self.percent * large]
        if not len(others):
            return
        ones = np.bitwise_count(self.sketches[others] ^ self.sketches[i]).sum(1)
        guess = estimate(ones)
        order = np.argsort(-guess, kind="stable")
        others = others[order[guess[order] >= self.floor]]
        # The likeliest first, then more at a time; connected ones drop out.
        width = 1
        while len(others):
            some, others = others[:width], others[width:]
            flat, n = np.concatenate([self.sets[j] for j in some]), self.sizes[some]
            at = np.searchsorted(self.sets[i], flat)
            at[at == self.sizes[i]] = 0
            common = np.add.reduceat((self.sets[i][at] == flat).astype(np.int64), np.cumsum(n) - n)
            for j in some[100 * common >= self.percent * (self.sizes[i] + n - common)]:
                if self.label[j] != self.label[i]:
                    self.links.append((self.ids[i], self.ids[j]))
                    self.label[self.label == self.label[j]] = self.label[i]
            others = others[self.label[others] != self.label[i]]
            width = min(4 * width, 64)


def _links(percent):
    """Links within a group of sets; if some are marked as strays, only of those with all."""

    def run(table):
        ids, first = np.unique(table["class"].to_numpy(), return_index=True)
        raw, labels = table["shingles"], table["label"].to_numpy()[first]
        sets = [np.frombuffer(raw[i].as_py(), _U) for i in first.tolist()]
        linker = Linker(ids, sets, labels, percent)
        if "stray" in table.column_names:
            stray = np.zeros(len(ids), bool)
            np.logical_or.at(stray, np.searchsorted(ids, table["class"].to_numpy()), table["stray"].to_numpy(zero_copy_only=False))
            chosen = np.flatnonzero(stray)
        else:
            chosen = np.arange(len(ids))
        everything = np.arange(len(ids))
        for i in chosen.tolist():
            linker.compare(i, everything[i + 1 :] if len(chosen) == len(ids) else everything)
        found = linker.links
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return run


def _blocks(n, size, block, block_shingles):
    """How many blocks a number of classes with so many shingles in all is cut into."""
    return F.greatest(F.ceil(n / F.lit(block)), F.ceil(size / F.lit(block_shingles)), F.lit(1)).cast("int")


def confirmed(members: DataFrame, percent, block=BLOCK, block_shingles=BLOCK_SHINGLES) -> DataFrame:
    """Links ``(a, b)`` that connect what is similar within clusters, from ``(cluster, class, shingles)``."""
    size = F.octet_length("shingles") / 8
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    # Stored, so that a small table is broadcast and no cluster is gathered in one task.
    sizes = stored(sizes.select("cluster", _blocks(F.col("n"), F.col("s"), block, block_shingles).alias("n_blocks")), "cluster-sizes")
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("n_blocks")))
    inside = placed.select("cluster", "block", "class", F.col("class").alias("label"), "shingles")
    links = stored(inside.repartition("cluster", "block").groupBy("cluster", "block").applyInArrow(_links(percent), "a long, b long"), "links-inside")
    large = stored(placed.where("n_blocks > 1").drop("block"), "large-clusters")
    if large.isEmpty():
        return links
    # What blocks have not connected: classes outside the largest component of their cluster.
    names = components(links.join(large.select(F.col("class").alias("a")), "a", "left_semi"))
    labelled = large.join(names.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class"))
    labelled = stored(labelled.drop("component"), "labelled")
    by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = stored(by_label.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "main-labels")
    known = labelled.join(main, "cluster").withColumn("stray", F.col("label") != F.col("main")).drop("main")
    strays = known.where("stray")
    counts = strays.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    counts = stored(counts.select("cluster", _blocks(F.col("n"), F.col("s"), block, block_shingles).alias("n_strays")), "stray-sizes")
    known = known.join(counts, "cluster").withColumn("i", F.pmod(F.xxhash64("class", F.lit(1)), F.col("n_strays"))).withColumn(
        "j", F.pmod(F.xxhash64("class"), F.col("n_blocks"))
    )
    columns = ["cluster", "class", "label", "shingles"]
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = known.where("stray").select(*columns, "stray", "i", F.explode(upto("n_blocks")).alias("j"))
    right = known.select(*columns, F.lit(False).alias("stray"), F.explode(upto("n_strays")).alias("i"), "j")
    pairs = left.select(*columns, "stray", F.col("i").cast("long"), F.col("j").cast("long")).unionAll(
        right.select(*columns, "stray", F.col("i").cast("long"), F.col("j").cast("long"))
    )
    across = pairs.repartition("cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(_links(percent), "a long, b long")
    return links.unionAll(stored(across, "links-across"))


def classes(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, key, row, low, high, n_shingles, bands)`` for each document, stored."""
    schema = "doc_id long, key long, row long, low long, high long, n_shingles long, bands array<long>"
    return stored(texts(docs).withColumn("key", row_key()).mapInArrow(_described(size), schema), "near-described", small=True)


def near_groups(docs: DataFrame, size=5, percent=PERCENT, block=BLOCK, block_shingles=BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, key, row, n_shingles, component_id, chosen)`` per document; ``row`` is a number of its own,
    and ``chosen`` tells whether no other id and text of the group come before these."""
    described = classes(docs, size)
    full = described.where("n_shingles > 0")
    # A class is named by its smallest row number; copies are combined before the exchange.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classed = stored(
        full.groupBy("low", "high").agg(F.min("row").alias("class"), F.min(place).alias("least"), F.count("*").alias("n")), "near-classes"
    )
    named = full.join(classed.select(F.col("class").alias("row")), "row", "left_semi")
    banded = stored(named.select(F.col("row").alias("class"), F.explode("bands").alias("key")), "near-bands")
    shared = banded.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> last")
    shared = stored(shared.select("key", "first"), "near-buckets")
    close = banded.join(shared, "key").where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    clusters = components(close).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    # Sets are made again for the members of clusters alone.
    sought = stored(
        clusters.join(classed, "class").join(described.select(F.col("row").alias("class"), "doc_id"), "class").select("cluster", "class", "low", "high", "doc_id"),
        "near-members",
    )
    ids = stored(sought.select("doc_id").distinct(), "near-member-ids")
    plain = texts(docs)
    again = plain.join(ids.withColumnRenamed("doc_id", "id"), plain["doc_id"].eqNullSafe(F.col("id")), "left_semi")
    sets = again.mapInArrow(_sets(size), "low long, high long, shingles binary")
    members = stored(sets.join(sought.select("cluster", "class", "low", "high"), ["low", "high"]).dropDuplicates(["class"]).drop("low", "high"), "near-sets", small=True)
    linked = components(confirmed(members, percent, block, block_shingles))
    final = classed.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    final = stored(final, "near-components")
    smallest = final.groupBy("component").agg(F.min("least").alias("least"))
    smallest = smallest.select("component", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("least_key"))
    by_class = stored(final.select("low", "high", "n", "component").join(smallest, "component"), "near-groups")
    # Many rows may share a class: adaptive execution splits them, one row stands on the other side.
    return described.join(by_class.select("low", "high", "component_id", "least_key"), ["low", "high"], "left").select(
        "doc_id",
        "key",
        "row",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | (F.col("key") == F.col("least_key"))).alias("chosen"),
    )


def near_duplicates(docs: DataFrame, size=5, percent=PERCENT, **blocks) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``."""
    groups = near_groups(docs, size, percent, **blocks)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are not among the stored ``dropped`` keys."""
    key = unused("dropped", docs)
    return docs.join(dropped.select(F.col("key").alias(key)), row_key() == F.col(key), "left_anti")


def one_of_each(docs: DataFrame, size=5, percent=PERCENT, **blocks) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row stays, which has its smallest id
    (NULL is the largest) and of those the text that hashes lowest; of rows with the same id and text, the one
    whose other values hash lowest, maps apart. Rows without a near text stay, whatever their id. Columns may
    have any name and kind."""
    groups = stored(near_groups(docs, size, percent, **blocks).where("n_shingles > 0").select("key", "chosen"), "near-kept")
    left = without_rows(docs, stored(groups.where(~F.col("chosen")).select("key").distinct(), "near-dropped"))
    key = unused("key", docs)
    repeated = groups.where("chosen").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select(F.col("key").alias(key)), "near-repeated")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, row_key() == F.col(key), "left_semi")
    single = left.join(repeated, row_key() == F.col(key), "left_anti")
    values = F.xxhash64(*[F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind])
    least = again.groupBy(row_key().alias(key)).agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), values).alias("least"))
    return single.unionAll(least.select("least.*"))
