"""Merkle manifest of documents, and a proof for each of them, by time-forward processing.

Every group of documents (a source) is a tree: its leaves in order, each run of three nodes one parent, up to
a single node, the group's subroot. The subroots, ordered by group, are the leaves of the tree above, whose
top is the root. A parent's digest is the SHA-256 of its children's digests as hex text.

Nodes are labelled so that children come before their parents: by the last leaf below them, then by level.
Going up, nodes are handled in ascending order of labels. A node that is handled sends its digest to its
parent through a priority queue ordered by label; a parent finds its children's digests at the queue's head.
Going down, the order is reversed: a parent sends each child the child's siblings, followed by its own
proof, which is a suffix of the child's. So proofs reach the leaves whole.

The queue is external. Messages that cross blocks lie in tables of the shared folder and come back in order
of labels by Spark's sort, which spills; a task's heap has only the messages inside one block of FAN ** STEP
nodes, of which at most three for each level are waiting. Blocks are dealt out by (group, place), so a group
of any size is spread out, and each round has fewer rows than the one before by that factor.

A proof is kept as a path: for each level, from the leaf's up, the siblings to the left, ``|`` for the node
itself, and the siblings to the right; levels are separated by commas.

Defined cases: every field may be NULL and is then ``-``, unlike any text. NULL is a group like others and
comes first, as does a NULL id within its group. Rows with the same id follow each other by their digests; a
repeated row is a leaf for each time it occurs, with a proof of its own. Other columns are not read. An
empty table has no leaves, and so no rows.
"""

import hashlib
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.places import placed, tie_breaker
from leadloom.llm.tables import stored
from leadloom.session import ship

FAN = 3
STEP = 4  # levels that a round climbs
BLOCK = FAN**STEP

_RUNS = "tree string, block long, n long, level int, at long, last long, digests array<string>, digest string, top boolean"
_MESSAGE = ("path", "subroot", "root")


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` for NULL, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def height(n):
    """Levels that a round climbs above n nodes of a tree."""
    level = 0
    while n > 1 and level < STEP:
        n, level = -(-n // FAN), level + 1
    return level


def last(level, at, n):
    """The last of the round's n nodes that lies below the node ``at`` of a level."""
    return min((at + 1) * FAN**level, n) - 1


def ascend(batches):
    """Runs of siblings with their parents' digests, from nodes sorted by (tree, block, at)."""
    queue, block, out = [], None, []

    def send(level, at, digest):
        tree, number, n, top = block
        if level < top:
            parent = at // FAN
            heappush(queue, ((last(level + 1, parent, n), level + 1), at, digest))

    def emit(level, at, digests, digest):
        tree, number, n, top = block
        out.append((tree, number, n, level, at, last(level, at, n), digests, digest, level == top))

    def deliver(before):
        """Handles the nodes whose labels come before the given one."""
        while queue and (before is None or queue[0][0] < before):
            label, digests = queue[0][0], []
            while queue and queue[0][0] == label:
                _, child, digest = heappop(queue)
                digests.append(digest)
            digest = hashlib.sha256("".join(digests).encode()).hexdigest()
            emit(label[1], child // FAN, digests, digest)
            send(label[1], child // FAN, digest)

    def results():
        columns = list(zip(*out)) or [()] * len(_TYPES)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], list(_TYPES))

    for batch in batches:
        for tree, number, n, at, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "at", "digest"))):
            if block is None or block[:2] != (tree, number):
                deliver(None)
                block = tree, number, n, height(n)
            deliver((at, 0))
            if block[3] == 0:
                emit(0, at, [digest], digest)
            send(0, at, digest)
        yield results()
    deliver(None)
    yield results()


_TYPES = {
    "tree": pa.string(), "block": pa.int64(), "n": pa.int64(), "level": pa.int32(), "at": pa.int64(), "last": pa.int64(),
    "digests": pa.list_(pa.string()), "digest": pa.string(), "top": pa.bool_(),
}


def descend(batches):
    """The round's nodes with their proofs, from its messages, runs and nodes, each block from the last label down."""
    queue, block = [], None
    for batch in batches:
        chosen, found = [], []
        columns = (batch.column(c).to_pylist() for c in ("tree", "block", "kind", "n", "level", "at", "last", "digests", *_MESSAGE))
        for k, (tree, number, kind, n, level, at, end, digests, *message) in enumerate(zip(*columns)):
            if block != (tree, number):
                block = tree, number
                queue.clear()
            if kind == 0:  # the message to the block's top
                level = height(n)
                heappush(queue, (-last(level, number * BLOCK // FAN**level, n), -level, *message))
                continue
            *_, path, subroot, root = heappop(queue)
            if kind == 2:
                chosen.append(k)
                found.append((path, subroot, root))
                continue
            for slot in range(len(digests)):
                step = "".join(digests[:slot]) + "|" + "".join(digests[slot + 1 :])
                label = -last(level - 1, at * FAN + slot, n), 1 - level
                heappush(queue, (*label, f"{step},{path}" if path else step, subroot, root))
        nodes = batch.take(pa.array(chosen, pa.int64()))
        proofs = list(zip(*found)) or [()] * len(_MESSAGE)
        arrays = [pa.array(proofs[_MESSAGE.index(c)], pa.string()) if c in _MESSAGE else nodes.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The runs of each round, from leaves ``(tree, n, at, digest)``."""
    rounds = []
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long")).repartition("tree", "block")
        rounds.append(stored(dealt.sortWithinPartitions("tree", "block", "at").mapInArrow(ascend, _RUNS), "merkle-runs"))
        nodes = rounds[-1].where(F.col("top") & (F.col("n") > BLOCK))
        if nodes.isEmpty():
            return rounds
        nodes = nodes.select("tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("at"), "digest")


def tops(rounds) -> DataFrame:
    """``(tree, digest, n, round)``: the top of each tree, and the round that reaches it."""
    found = [r.where(F.col("top") & (F.col("n") <= BLOCK)).select("tree", "digest", "n", F.lit(k).alias("round")) for k, r in enumerate(rounds)]
    return reduce(DataFrame.unionAll, found)


def proofs(rounds, messages: DataFrame, leaves: DataFrame, keep) -> DataFrame:
    """The leaves ``(tree, n, at, *keep)`` with ``path``, ``subroot`` and ``root``.

    ``messages`` are those to the trees' tops: ``(tree, n, round, path, subroot, root)``.
    """
    above = None
    for k in reversed(range(len(rounds))):
        arriving = messages.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), "n", *_MESSAGE)
        if above is not None:
            size = rounds[k].where("top").select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "n")
            match = (F.col("block") == F.col("_block")) & F.col("tree").eqNullSafe(F.col("_tree"))
            arriving = arriving.unionAll(above.join(size, match).select("tree", "block", "n", *_MESSAGE))
        if k:
            below = rounds[k - 1].where(F.col("top") & (F.col("n") > BLOCK))
            nodes = below.select("tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("at"))
        else:
            nodes = leaves.select("tree", "n", "at", *keep)
        nodes = nodes.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long")).withColumn("last", F.col("at")).withColumn("level", F.lit(0))
        runs = rounds[k].where("level > 0").select("tree", "block", "n", "level", "at", "last", "digests")
        kinds = [f.withColumn("kind", F.lit(kind)) for kind, f in enumerate((arriving, runs, nodes))]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds).repartition("tree", "block")
        order = ["tree", "block", F.col("kind") > 0, F.desc("last"), F.desc("level")]
        rows = rows.sortWithinPartitions(*order)
        found = rows.mapInArrow(descend, rows.schema)
        if k == 0:
            return found.select("tree", "at", *keep, *_MESSAGE)
        above = stored(found.select("tree", F.col("at").alias("block"), *_MESSAGE), "merkle-proofs")


def manifest(rows: DataFrame, group: str, order: str, keep=()) -> DataFrame:
    """``(group, order, leaf, *keep, subroot, root, path)`` for rows that have a ``leaf`` digest."""
    ship(rows.sparkSession)
    named = rows.select(
        F.col(group).cast("string").alias("tree"), F.col(order).alias("place_by"), F.col("leaf").alias("digest"),
        F.struct(F.lit(0).alias("_"), *keep).alias("kept"), tie_breaker().alias("tie"),
    )
    by = [F.col("place_by").asc_nulls_first(), F.col("digest"), F.col("tie")]
    leaves = placed(named, "tree", by, "merkle-leaves").withColumnRenamed("place", "at")
    rounds = climb(leaves.select("tree", "n", "at", "digest"))
    subroots = stored(tops(rounds), "merkle-subroots")

    one = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", F.col("n").alias("below"), F.col("round").alias("of_round"))
    upper = placed(one, "tree", [F.col("of").asc_nulls_first()], "merkle-upper").withColumnRenamed("place", "at")
    upper_rounds = climb(upper.select("tree", "n", "at", "digest"))
    root = tops(upper_rounds).select("tree", "n", "round", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    above = proofs(upper_rounds, root, upper, ["of", "digest", "below", "of_round"])
    messages = above.select(
        F.col("of").alias("tree"), F.col("below").alias("n"), F.col("of_round").alias("round"), "path", F.col("digest").alias("subroot"), "root"
    )
    found = proofs(rounds, stored(messages, "merkle-messages"), leaves, ["place_by", "digest", "kept"])
    return found.select(
        F.col("tree").alias(group), F.col("place_by").alias(order), F.col("digest").alias("leaf"),
        *[F.col(f"kept.{c}").alias(c) for c in keep], "subroot", "root", "path",
    )


def siblings(path) -> Column:
    """All digests of a proof, level by level and left to right, as one text."""
    return F.translate(path, ",|", "")


def fold(digest, path) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    steps = F.filter(F.split(path, ","), lambda s: s != "")
    return F.aggregate(steps, F.col(digest), lambda h, step: F.sha2(F.replace(step, F.lit("|"), h), 256))


def documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, leaf, altered)``: ``altered`` is the leaf of a text that lost its line feeds, where the
    id's checksum is even, and NULL elsewhere (also without an id)."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, leaf(*fields, F.replace(text, F.lit("\n"), F.lit(""))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), leaf(*fields, text).alias("leaf"), changed.alias("altered"))


def audit(docs: DataFrame) -> DataFrame:
    """A row for each document: its leaf, the roots and its proof, and whether what was tampered with shows."""
    found = manifest(documents(docs), "source", "doc_id", ["altered"])
    found = found.withColumn("shown", F.coalesce("altered", "leaf")).withColumn("folded_root", fold("shown", "path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
