"""Numbers of tokens without tokens: byte pairs merged in a linked list, driven by a heap.

A piece starts as a linked list of byte symbols, with every adjacent pair that has a rank in a
heap. The pair of lowest rank (the leftmost of equal ones) is popped and merged, its two new
neighbours are pushed, and entries whose symbols are gone are skipped. The count is the number
of symbols less the number of merges; no ids are made. A piece of n bytes costs n log n.

Texts are cut where no piece can cross, and the counts of the parts are remembered per process
up to a fixed number, since words repeat.

Defined cases: a NULL or empty text has 0 tokens. A special string in a text is one token, as
the library's default has it. Repeated rows are counted one by one; other columns are not read.
"""

import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import texts
from leadloom.llm.vocabulary import Memory, byte_pieces, strings, units, vocabulary

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def merges(symbols, ranks, made):
    """How many merges are made until no adjacent pair has a rank.

    Symbols are numbers; ``ranks`` has the rank of ``left << 32 | right``, ``made`` the symbol
    that each rank makes. A heap entry is rank * n + place, which orders by rank, then place.
    """
    n, done = len(symbols), 0
    if n < 2:
        return 0
    parts, after, before = [*symbols, -1], list(range(1, n + 1)), list(range(-1, n - 1))
    heap, rank_of = [], ranks.get
    for i in range(n - 1):
        rank = rank_of(parts[i] << 32 | parts[i + 1])
        if rank is not None:
            heap.append(rank * n + i)
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        if parts[i] < 0:
            continue
        j = after[i]
        if j == n or rank_of(parts[i] << 32 | parts[j]) != rank:
            continue
        done += 1
        joined = parts[i] = made[rank]
        parts[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(joined << 32 | parts[k])
            if rank is not None:
                heapq.heappush(heap, rank * n + i)
        h = before[i]
        if h >= 0:
            rank = rank_of(parts[h] << 32 | joined)
            if rank is not None:
                heapq.heappush(heap, rank * n + h)
    return done


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, path):
        self.vocabulary = vocabulary(path)
        self.pieces = Memory(self._piece, 1 << 19)
        self.units = Memory(self._unit, 1 << 18)

    def _piece(self, piece):
        symbols = self.vocabulary.symbols(piece)
        return len(symbols) - merges(symbols, self.vocabulary.ranks, self.vocabulary.made)

    def _unit(self, unit):
        return sum(map(self.pieces.__getitem__, byte_pieces(unit)))

    def plain(self, text):
        return sum(map(self.units.__getitem__, units(text)))

    def __call__(self, text):
        special = self.vocabulary.special
        if any(s in text for s in special):
            return sum(1 if part in special else self.plain(part) for part in self.vocabulary.special_cut.split(text))
        return self.plain(text)


@lru_cache(maxsize=None)
def counter(path):
    return Counter(path)


def count_batches(path):
    def run(batches):
        count = counter(path)
        for batch in batches:
            found = [count(text) for _, part in strings(batch.column("text")) for text in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path=VOCABULARY, limit=LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``."""
    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(count_batches(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
