"""Text quality learnt from trusted good texts and unlabelled web text.

Positive-unlabelled learning: labels that call a text good are the positives, a sample of all texts is the
unlabelled set, and no negative label is used. A text is described by how its kinds of
characters follow each other and by how much it repeats itself. First a classifier of positives against
unlabelled texts gives an estimate of the class prior: over all thresholds, the least ratio of
the unlabelled share above it to the held-back positive share above it. Then a network with one hidden
layer is trained on the non-negative unbiased risk

    prior * E+[loss(g)] + max(0, Eu[loss(-g)] - prior * E+[loss(-g)])

with the logistic loss, so that the output is a probability. Where the second part falls below zero,
the step undoes it.

Training uses at most ``POSITIVES`` labels and ``UNLABELLED`` texts, chosen by a hash: of the id for labels, of id
and text for unlabelled ones, so that ids which many rows share, or no id, neither fill the sample nor stay
outside it. Scoring passes over all texts once, without a shuffle.

Defined cases: a NULL or empty text is all zeros and is scored like any other. NULL labels are no
labels; a document with several labels is good if all say so, and of several texts with its id the one that
hashes lowest is learnt from. Without positives every score is 0.5. Repeated rows are scored one by one, and
are learnt from once; other columns are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.spans import BETWEEN_SPACES, hashes, shingles, slices, text_column, word_ranges
from leadloom.llm.tables import fold, stored, texts

POSITIVES = 6000
UNLABELLED = 12000
THRESHOLD = 0.5
HIDDEN = 32
ROWS = 4096  # rows that are taken to full precision at once


def _kinds():
    """A kind for each byte: lower, upper, digit, space, line end, other control, non-ASCII, and each mark."""
    kinds = np.full(256, 5, np.int64)
    marks = 7
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            kinds[b] = 6
        elif c.islower() or c.isupper():
            kinds[b] = int(c.isupper())
        elif c.isdigit():
            kinds[b] = 2
        elif c in " \n":
            kinds[b] = 3 + (c == "\n")
        elif c.isprintable():
            kinds[b], marks = marks, marks + 1
    return kinds, marks


KINDS, N_KINDS = _kinds()
EXTRA = 7
WIDTH = N_KINDS * N_KINDS + EXTRA


def _distinct(values, bounds):
    """The number of distinct values of each text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=len(bounds) - 1)


def describe(data, offsets):
    """One row of ``WIDTH`` numbers per text."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    kind = KINDS[data]
    text = np.repeat(np.arange(n), lengths)
    if len(data) > 1:
        same = text[1:] == text[:-1]
        pair = text[1:][same] * N_KINDS**2 + kind[:-1][same] * N_KINDS + kind[1:][same]
        counts = np.bincount(pair, minlength=n * N_KINDS**2).reshape(n, -1)
        out[:, :-EXTRA] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    starts, ends, bounds = word_ranges(data, offsets, BETWEEN_SPACES)
    words = hashes(data, starts, ends)
    runs, run_bounds = shingles(words, bounds, 3)
    n_words, n_runs = np.diff(bounds), np.diff(run_bounds)
    of_word = np.repeat(np.arange(n), n_words)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    per_word = np.maximum(n_words, 1)
    size = (ends - starts).astype(float)
    mean = np.bincount(of_word, size, n) / per_word
    out[:, -7] = np.log1p(n_words) / 10
    out[:, -6] = _distinct(words, bounds) / per_word
    out[:, -5] = np.bincount(of_word, again, n) / per_word
    out[:, -4] = 1 - _distinct(runs, run_bounds) / np.maximum(n_runs, 1)
    out[:, -3] = mean / 10
    out[:, -2] = np.sqrt(np.maximum(np.bincount(of_word, size**2, n) / per_word - mean**2, 0)) / 10
    out[:, -1] = np.log1p(np.bincount(text, data == 10, n)) / 10
    return out


def _described(batches):
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        for first, part, places in slices(data, offsets):
            rows = [row.tobytes() for row in describe(part, places).astype(np.float16)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(rows)), batch.column("key").slice(first, len(rows)), pa.array(rows, pa.binary())],
                ["doc_id", "key", "row"],
            )


def samples(docs: DataFrame, labels: DataFrame, positives=POSITIVES, unlabelled=UNLABELLED):
    """(positive, unlabelled) rows to train on, as arrays."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    known = stored(known, "good-labels")
    plain = texts(docs)
    n_good, n_all = known.count(), plain.count()
    drawn = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(drawn("doc_id", F.lit("good")) < positives / max(n_good, 1))
    # The chosen labels are ``positives`` rows in expectation, whatever the number of labels.
    good = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("row"))
    other = plain.withColumn("key", drawn("doc_id", "text", F.lit("web"))).where(F.col("key") < unlabelled / max(n_all, 1))
    sets = [
        (good.select("doc_id", drawn("doc_id", F.lit("good")).alias("key"), "row.text"), positives),
        (other.dropDuplicates(["doc_id", "key"]), unlabelled),
    ]
    return tuple(_gathered(rows.mapInArrow(_described, "doc_id long, key double, row binary"), bound) for rows, bound in sets)


def _gathered(rows, bound):
    """The rows in the order of their keys as an array of half precision, at most ``bound`` of them."""
    found = rows.toArrow()
    order = pa.compute.sort_indices(found, [("key", "ascending"), ("doc_id", "ascending")])[:bound]
    table = np.empty((len(order), WIDTH), np.float16)
    column = found.column("row").combine_chunks()
    for to, k in enumerate(order.to_numpy()):
        table[to] = np.frombuffer(column[k].as_buffer(), np.float16)
    return table


class Network:
    def __init__(self, seed=0):
        rng = np.random.default_rng(seed)
        self.a = (rng.standard_normal((WIDTH, HIDDEN)) / np.sqrt(WIDTH) * 4).astype(np.float32)
        self.b = np.zeros(HIDDEN, np.float32)
        self.c = (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
        self.d = np.zeros(1, np.float32)

    def parameters(self):
        return [self.a, self.b, self.c, self.d]

    def logits(self, x):
        parts = [x[k : k + ROWS].astype(np.float32) for k in range(0, len(x), ROWS)]
        found = [np.tanh(part @ self.a + self.b) @ self.c + self.d[0] for part in parts]
        return np.concatenate([*found, np.zeros(0, np.float32)])

    def gradient(self, x, slope):
        """The gradient for inputs of which each has the given slope of the loss by its logit."""
        h = np.tanh(x @ self.a + self.b)
        back = slope[:, None] * self.c * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()], np.float32)]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _train(network, positive, unlabelled, slopes, epochs, seed, batch=512, rate=0.003, decay=1e-4):
    """Adam on batches that hold both sets in proportion; ``slopes`` gives each input's slope."""
    rng = np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    steps = max(1, (len(positive) + len(unlabelled)) // batch)
    t = 0
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), steps), np.array_split(rng.permutation(len(unlabelled)), steps)):
            if not len(p) or not len(u):
                continue
            t += 1
            x = np.concatenate((positive[p], unlabelled[u])).astype(np.float32)
            z = network.logits(x)
            slope = slopes(z[: len(p)], z[len(p) :]).astype(np.float32)
            for w, g, (m, v) in zip(network.parameters(), network.gradient(x, slope), state):
                g += decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return network


def _against(zp, zu):
    """Positives against unlabelled, both sets weighing the same."""
    return np.concatenate(((_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)))


def _non_negative(prior):
    def slopes(zp, zu):
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            return np.concatenate((prior * (_sigmoid(zp) - 1 - _sigmoid(zp)) / len(zp), _sigmoid(zu) / len(zu)))
        return np.concatenate((prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)))

    return slopes


def class_prior(positive, unlabelled, slack=0.02):
    """The share of good texts among unlabelled ones: train on one half, compare shares on the other."""
    network = _train(Network(1), positive[::2], unlabelled[::2], _against, epochs=8, seed=1)
    p, u = np.sort(network.logits(positive[1::2])), np.sort(network.logits(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    above_p = 1 - np.searchsorted(p, p) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    width = slack + np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + width) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, epochs=15, prior=None):
    """A trained network, or None without positives."""
    positive, unlabelled = samples(docs, labels)
    if not len(positive) or not len(unlabelled):
        return None
    prior = class_prior(positive, unlabelled) if prior is None else prior
    return _train(Network(), positive, unlabelled, _non_negative(prior), epochs, seed=2)


def _scores(network, batch):
    data, offsets = text_column(batch.column("text"))
    found = [np.full(len(places) - 1, 0.5) if network is None else _sigmoid(network.logits(describe(part, places)).astype(float)) for _, part, places in slices(data, offsets)]
    return pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())


def score(docs: DataFrame, network) -> DataFrame:
    """``(doc_id, score)`` for each row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _scores(network, batch)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, network, threshold=THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, with all their columns."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.compute.greater_equal(_scores(network, batch), threshold))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, folds=3, held_out=1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; labels of the held-out fold are not learnt from."""
    network = train(docs, labels.where(fold("doc_id", folds) != held_out))
    return score(docs, network).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
