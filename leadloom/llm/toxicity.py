"""Toxicity: character n-grams scaled by naive Bayes log-count ratios under a linear classifier.

Features are runs of 4 to 6 characters, hashed, of the text in which A-Z are lower-cased and ASCII characters but
letters and digits are spaces; characters beyond ASCII stay as they are. A feature's value in a text that has it is its log-count ratio: how
much more often toxic training texts have it than others. On these scaled features a logistic
classifier is trained. A text's score does not depend on how often a feature occurs.

Training uses at most ``PER_CLASS`` labelled rows of each class in expectation, chosen by a hash of
the id and weighted back to their share; they are stored once. Feature counts over them are summed by
Spark; of the hashed features the ``FEATURES`` that tell most (by chi-square) are kept. Scoring
passes over all texts once, without a shuffle.

Defined cases: a NULL or empty text has no feature and gets the score of the intercept. NULL labels
are no labels; a document with several labels is toxic if one says so, and of several texts with its id the one
that hashes lowest is learnt from. Without labels of
both classes every score is the share of toxic labels, 0 if there are none. Repeated rows are scored
one by one; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.spans import LETTERS_AND_DIGITS, LOWER, mix, slices, text_column
from leadloom.llm.tables import fold, stored, texts

SIZES = (4, 5, 6)
BITS = 22
PER_CLASS = 8000
FEATURES = 1 << 14
LEAST = 5  # training texts that must have a feature
THRESHOLD = 0.3
_PLAIN = np.where(LETTERS_AND_DIGITS, LOWER, 0x20).astype(np.uint32)[:128]
_BASE = np.uint64(0xD6E8FEB86659FD93)


def characters(data, offsets):
    """(code points, bounds) of UTF-8 texts that lie one after the other."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, begins[offsets]


def features(data, offsets):
    """(text, bucket) of every n-gram of characters of texts that lie one after the other."""
    points, bounds = characters(data, offsets)
    plain = np.where(points < 128, _PLAIN[np.minimum(points, 127)], points).astype(np.uint64)
    n, lengths = len(plain), np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(bounds[1:], lengths) - np.arange(n)
    padded = np.concatenate((plain, np.zeros(SIZES[-1], np.uint64)))
    grams = plain
    for k in range(1, SIZES[-1]):
        grams = grams * _BASE + padded[k : k + n]
        if k + 1 in SIZES:
            inside = left > k
            yield text[inside], (mix(grams[inside] + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS) -> DataFrame:
    """``(text, toxic, weight)``: the labelled texts to train on."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = stored(known, "toxic-labels")
    counts = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, per_class / counts.get(c, 1)) for c in (0, 1)}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    of_class = lambda values: F.when(F.col("toxic") == 1, F.lit(values[1])).otherwise(F.lit(values[0]))
    chosen = known.where(drawn < of_class(rate)).withColumn("weight", of_class({c: 1 / r for c, r in rate.items()}))
    # 2 * per_class labels in expectation, whatever their number, and one text for each.
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "weight")
    rows = labelled.agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("row"))
    return stored(rows.select("row.text", "toxic", "weight"), "toxic-sample")


def _counts(batches):
    total = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        data, offsets = text_column(batch.column("text"))
        for first, part, places in slices(data, offsets):
            for text, bucket in features(part, places):
                pairs = np.unique(text << BITS | bucket)
                label = toxic[first + (pairs >> BITS)]
                for c in (0, 1):
                    total[c] += np.bincount(pairs[label == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    some = np.flatnonzero(total.any(axis=0))
    for k in range(0, len(some), 1 << 18):
        b = some[k : k + (1 << 18)]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(b), "clean": pa.array(total[0][b]), "toxic": pa.array(total[1][b])})


def informative(chosen: DataFrame, n_clean, n_toxic, limit=FEATURES, least=LEAST):
    """(buckets, log-count ratios) of the features that tell the classes apart best."""
    counts = chosen.mapInArrow(_counts, "bucket long, clean int, toxic int").groupBy("bucket").agg(
        F.sum("clean").alias("a"), F.sum("toxic").alias("b")
    )
    n, a, b = float(n_clean + n_toxic), F.col("a").cast("double"), F.col("b").cast("double")
    both = a + b
    gap = a * n_toxic - b * n_clean
    best = (
        counts.where(both >= least)
        .withColumn("chi", n * gap * gap / (n_clean * n_toxic * both * (n - both) + 1))
        .orderBy(F.desc("chi"), "bucket")
        .limit(limit)  # a bounded model
        .toPandas()
        .sort_values("bucket")
    )
    a, b = best["a"].to_numpy(float), best["b"].to_numpy(float)
    return best["bucket"].to_numpy(np.int64), np.log((b + 1) / (n_toxic + 2)) - np.log((a + 1) / (n_clean + 2))


class Model:
    def __init__(self, buckets, weights, intercept):
        self.buckets, self.weights, self.intercept, self._place = buckets, weights, intercept, None

    def __getstate__(self):
        return {**self.__dict__, "_place": None}

    def found(self, data, offsets):
        """(text, feature) of the model's features that each text has, each once."""
        if self._place is None:
            self._place = np.full(1 << BITS, -1, np.int32)
            self._place[self.buckets] = np.arange(len(self.buckets))
        n, pairs = max(len(self.buckets), 1), []
        for text, bucket in features(data, offsets):
            place = self._place[bucket]
            hit = place >= 0
            pairs.append(text[hit] * n + place[hit])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // n, pairs % n

    def score(self, data, offsets):
        text, feature = self.found(data, offsets)
        z = self.intercept + np.bincount(text, self.weights[feature], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _present(model):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for first, part, places in slices(data, offsets):
                text, feature = model.found(part, places)
                n = len(places) - 1
                bounds = np.searchsorted(text, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(first, n), batch.column("weight").slice(first, n), lists], ["toxic", "weight", "features"])

    return run


def fit(rows, ratios, rounds=200, penalty=1.0, rate=0.1):
    """(weights, intercept) of a weighted logistic regression on features scaled by their ratios."""
    y, sample_weight = rows["toxic"].to_numpy().astype(float), rows["weight"].to_numpy()
    lists = rows["features"].combine_chunks()
    feature, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    # Runs of rows of about a million features, so that little is held beside the features.
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)).tolist() + [0, len(y)])
    share = np.clip((y * sample_weight).sum() / sample_weight.sum(), 1e-6, 1 - 1e-6)
    w = np.zeros(len(ratios) + 1)
    w[-1] = np.log(share / (1 - share))
    total, m, v = sample_weight.sum(), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):  # Adam over all rows
        g = np.append(penalty * w[:-1] / total, 0.0)
        for first, last in zip(cuts[:-1], cuts[1:]):
            f = feature[ends[first] : ends[last]]
            row, value = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), ratios[f]
            z = w[-1] + np.bincount(row, value * w[f], last - first)
            slope = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[first:last]) * sample_weight[first:last] / total
            g[:-1] += np.bincount(f, value * slope[row], len(ratios))
            g[-1] += slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1] * ratios, w[-1]


def train(docs: DataFrame, labels: DataFrame, per_class=PER_CLASS) -> Model:
    chosen = sample(docs, labels, per_class)
    seen = {row["toxic"]: row for row in chosen.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if len(seen) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 50.0 if 1 in seen else -50.0)
    buckets, ratios = informative(chosen, seen[0]["n"], seen[1]["n"])
    model = Model(buckets, ratios, 0.0)
    rows = chosen.mapInArrow(_present(model), "toxic int, weight double, features array<int>").toArrow()
    return Model(buckets, *fit(rows, ratios))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row."""

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            found = [model.score(part, places) for _, part, places in slices(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*found, np.zeros(0)]))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds=4, held_out=2) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; labels of the held-out fold are not learnt from."""
    model = train(docs, labels.where(fold("doc_id", folds) != held_out))
    return score(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
