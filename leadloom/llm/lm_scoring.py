"""Texts scored by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are words and one end per text. The vocabulary is counted over all training texts. The
words that occur ``LEAST_COUNT`` times are the shortlist, cut into classes that grow with the rank of their
words, so that frequent words are in small ones; the others fall into tail classes by their endings. The shortlist grows with the vocabulary up to
``SHORTLIST`` words, which bounds the parameters to about 13 MB in a task.
The predicted vector of a place is the sum of the ``CONTEXT`` words before it, each scaled by
weights of its distance. From it come, by matrix products,

    P(word) = (1 - u) * P(class | context) * P(word | class, context)   in the shortlist
    P(word) = (1 - u) * P(tail class | context) * (c + 0.1) / Z(class)   for other known words
    P(unknown) = u, the share of training tokens that occur once (Good and Turing)

which sums to one over all known words and one unknown. The first two factors are softmaxes over
the classes and over the words of one class, normalised at every place.

Training: each task goes over its texts once from the same start and fits words and classes against
noise drawn from the unigram distribution (one draw shared by a batch, so that all scores are
matrix products), at every place. The tasks' parameters are averaged by their numbers of places;
they are summed in pieces as they stream in, never gathered.

Scoring looks up the ``KNOWN`` most frequent words in the task; occurrences of rarer ones are joined
with the counts by Spark. What is sent to tasks, the model and the known words, has a fixed bound.

Defined cases: a NULL or empty text has its end as only token. Without training texts every token is
unknown. A NULL id is held out like the empty text. Repeated rows are learnt from and scored
one by one; other columns are not read.
"""

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.spans import BETWEEN_SPACES, LOWER, hashes, mix, slices, text_column, word_ranges
from leadloom.llm.tables import fold, stored, texts

SHORTLIST, LEAST_COUNT, TAILS = 1 << 16, 5, 64
KNOWN = 1 << 18
DIMENSIONS, CONTEXT = 24, 4
BATCH, RATE = 2048, 0.1
STRETCH = 32  # places in a row that stay together in a batch
CLASS_NOISE, WORD_NOISE = 32, 96
PIECES = 64  # pieces in which parameters are summed
ADD = 0.1
FOLDS, HELD_OUT = 10, 0
_U = np.uint64
END = _U(0x5E2D58D8B3BCDEF1)  # stands for the end of a text


def tokens(data, offsets):
    """(hashes, tail classes, bounds) of the tokens of each text, the end included."""
    starts, ends, bounds = word_ranges(data, offsets, BETWEEN_SPACES)
    n = len(offsets) - 1
    bounds_with_ends = bounds + np.arange(n + 1)
    out = np.full(len(starts) + n, END, _U)
    tails = np.zeros(len(out), np.int16)
    place = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(bounds))
    out[place] = hashes(data, starts, ends)
    ending = np.zeros(len(starts), _U)
    for k in range(1, 4):
        at = ends - k
        ending = (ending << _U(8)) | np.where(at >= starts, LOWER[data[np.maximum(at, 0)]], 0).astype(_U)
    tails[place] = (mix(ending + _U(1)) % _U(TAILS)).astype(np.int16)
    return out, tails, bounds_with_ends


def _counts(batches):
    """Counts of the words of a task, merged as they come and given out when they are many."""
    held, size = [], 0

    def merged():
        keys = np.concatenate([k for k, _, _ in held])
        unique, first, group = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(group, np.concatenate([c for _, _, c in held])).astype(np.int64)
        return unique, np.concatenate([t for _, t, _ in held])[first], n

    def rows(part):
        keys, tails, n = part
        for k in range(0, len(keys), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_pydict({"word": pa.array(keys[s].view(np.int64)), "tail": pa.array(tails[s], pa.int16()), "n": pa.array(n[s])})

    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        for _, part, places in slices(data, offsets):
            words, tails, _ = tokens(part, places)
            unique, first, n = np.unique(words, return_index=True, return_counts=True)
            held.append((unique, tails[first], n))
            size += len(unique)
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield from rows(held[0])
                    held, size = [], 0
    if held:
        yield from rows(merged())


def count(train: DataFrame) -> DataFrame:
    """``(word, tail, c)`` of every word of the training texts."""
    counted = train.mapInArrow(_counts, "word long, tail short, n long")
    return stored(counted.groupBy("word", "tail").agg(F.sum("n").alias("c")), "word-counts")


def _cut(counts: DataFrame, limit):
    """The smallest count such that at most ``limit`` words have it or more."""
    # Every row has a word or more, so ``limit`` rows suffice.
    top = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(limit + 1).toPandas()
    total = top["n"].cumsum()
    inside = top["c"][total <= limit]
    return int(inside.iloc[-1]) if len(inside) else int(top["c"].iloc[0]) + 1 if len(top) else 1


def class_starts(n):
    """Where the classes of ``n`` words in falling frequency begin, and the end. Widths grow in proportion to the
    class's number; with frequencies like 1 / rank, so many classes make class and word sums cheapest together."""
    classes = int(np.ceil(np.sqrt(4 * n / np.log(n + 2))))
    return np.unique(np.append((n * (np.arange(classes) / classes) ** 2).astype(np.int64), n))


class Vocabulary:
    """The known words and the sums over all others."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
        self.n, self.v, once = total["n"] or 0, total["v"], total["once"]
        self.unknown = (once + 0.5) / (self.n + 1)
        self.cut = _cut(counts, KNOWN)
        short = max(_cut(counts, SHORTLIST), self.cut, LEAST_COUNT)
        known = counts.where(F.col("c") >= self.cut).toPandas()  # at most KNOWN rows
        words = known["word"].to_numpy(np.int64).view(_U)
        order = np.argsort(words)
        self.words, self.c = words[order], known["c"].to_numpy(np.int64)[order]
        self.tail_sums = np.zeros(TAILS)
        tails = counts.where((F.col("c") < short) & (F.col("word") != int(END.view(np.int64)))).groupBy("tail")
        for row in tails.agg((F.sum("c") + ADD * F.count("*")).alias("s")).collect():
            self.tail_sums[row["tail"]] = row["s"]
        # The end is always in the shortlist, even if it is rare.
        chosen = np.flatnonzero((self.c >= short) & (self.words != END))
        chosen = chosen[np.argsort(-self.c[chosen], kind="stable")]
        self.short = np.full(len(self.words), -1, np.int32)
        self.short[chosen] = np.arange(1, len(chosen) + 1)
        end = counts.where(F.col("word") == int(END.view(np.int64))).first()
        self.n_ends = end["c"] if end else 0
        self.short[self.words == END] = 0
        mass = np.concatenate(([self.n_ends + ADD], self.c[chosen].astype(float)))
        self.word_share = mass / mass.sum()
        self.starts = class_starts(len(mass))
        classes = np.concatenate((np.add.reduceat(mass, self.starts[:-1]), self.tail_sums))
        self.class_share = classes / classes.sum()

    @cached_property
    def buckets(self):
        """(shift, first): the first known word that is not below each value of the leading bits; half a word has the same."""
        bits = (2 * len(self.words)).bit_length()
        shift = _U(64 - bits)
        return shift, np.searchsorted(self.words, np.arange(1 << bits, dtype=_U) << shift).astype(np.int64)

    def find(self, words, tails):
        """(place among the known or -1, input number) of tokens. Inputs are the shortlist, tail
        classes, and last the start of a text."""
        n_short = len(self.word_share)
        if not len(self.words):
            place = np.full(len(words), -1)
        else:
            shift, first = self.buckets
            place = first[(words >> shift).astype(np.int64)]
            behind = np.flatnonzero(place < len(self.words))
            behind = behind[self.words[place[behind]] < words[behind]]
            while len(behind):
                place[behind] += 1
                behind = behind[place[behind] < len(self.words)]
                behind = behind[self.words[place[behind]] < words[behind]]
            place[place == len(self.words)] = 0
            place[self.words[place] != words] = -1
        short = np.where(place >= 0, self.short[place], -1) if len(self.words) else place
        short = np.where(words == END, 0, short)
        return place, np.where(short >= 0, short, n_short + tails.astype(np.int32))


def line_up(inputs, bounds, start, step=1):
    """(line, real): the tokens of all texts in a row, each text after ``CONTEXT`` marks of its start, so that the words before
    a token are its neighbours. From ``CONTEXT`` on the line has a multiple of ``step`` places; ``real`` tells tokens from marks."""
    texts_before = np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    at = np.arange(len(inputs)) + CONTEXT * texts_before
    last = at[-1] + 1 if len(at) else CONTEXT
    line = np.full(CONTEXT - (CONTEXT - last) // step * step, start, np.int32)
    real = np.zeros(len(line), bool)
    line[at], real[at] = inputs, True
    return line, real


def predicted(rows, scales):
    """Sums of the ``CONTEXT`` rows before each place, scaled by their distance, along the last axis but one."""
    n, width = rows.shape[-2] - CONTEXT, rows.shape[-1]
    flat = rows.reshape(*rows.shape[:-2], -1)
    at = lambda k: flat[..., (CONTEXT - k) * width : (CONTEXT - k + n) * width] * np.tile(scales[k - 1], n)
    total = at(1)
    for k in range(2, CONTEXT + 1):
        total += at(k)
    return total.reshape(*rows.shape[:-2], n, width)


def groups(inputs, starts):
    """The class of each token, tail classes after those of the shortlist."""
    n_short, n_classes = starts[-1], len(starts) - 1
    of = np.repeat(np.arange(n_classes, dtype=np.int32), np.diff(starts))
    return np.where(inputs < n_short, of[np.minimum(inputs, n_short - 1)], n_classes + inputs - n_short)


class Model:
    """Parameters of the network and its normalised log-probabilities. The last column of ``classes`` and ``words``
    is their bias, which meets a one at the end of a predicted vector."""

    def __init__(self, vocabulary):
        n_inputs, n_short = len(vocabulary.word_share) + TAILS + 1, len(vocabulary.word_share)
        rng = np.random.default_rng(7)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        with np.errstate(divide="ignore"):
            log_class = np.maximum(np.log(vocabulary.class_share), -1e4).astype(np.float32)
        biased = lambda rows, bias: np.concatenate((rows, bias[:, None]), axis=1)
        self.parameters = {
            "inputs": draw(n_inputs, DIMENSIONS),
            "scales": np.repeat((1 / np.arange(1, CONTEXT + 1, dtype=np.float32))[:, None], DIMENSIONS, 1),
            "classes": biased(draw(len(log_class), DIMENSIONS), log_class),
            "words": biased(draw(n_short, DIMENSIONS), np.log(vocabulary.word_share).astype(np.float32)),
        }

    def flat(self):
        return np.concatenate([p.ravel() for p in self.parameters.values()])

    def fill(self, values):
        at = 0
        for name, p in self.parameters.items():
            self.parameters[name] = values[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def log_probabilities(self, inputs, bounds, starts, chunk=1 << 16):
        """Natural logs of P(class) and, in the shortlist, P(word | class) added, per token."""
        p, n_classes = self.parameters, len(starts) - 1
        line, real = line_up(inputs, bounds, len(p["inputs"]) - 1)
        group = groups(inputs, starts)
        out = np.empty(len(inputs), np.float32)
        q, done = np.ones((chunk, DIMENSIONS + 1), np.float32), 0
        for k in range(0, len(line) - CONTEXT, chunk):
            rows = np.take(p["inputs"], line[k : k + chunk + CONTEXT], axis=0)
            here = np.flatnonzero(real[k + CONTEXT : k + CONTEXT + chunk])
            n = len(here)
            q[:n, :-1] = np.take(predicted(rows, p["scales"]), here, axis=0)
            target, of = inputs[done : done + n], group[done : done + n]
            found = _log_softmax(q[:n], p["classes"], of)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(n_classes + 1))
            ranked, places = np.take(q[:n], order, axis=0), target[order]
            for c in np.flatnonzero(np.diff(ends)):
                s = slice(ends[c], ends[c + 1])
                found[order[s]] += _log_softmax(ranked[s], p["words"][starts[c] : starts[c + 1]], places[s] - starts[c])
            out[done : done + n] = found
            done += n
        return out.astype(np.float64)


def _log_softmax(q, rows, chosen, held=1 << 18):
    """The log-probability of each chosen row; products of about ``held`` numbers stay in the cache."""
    found, step = np.empty(len(q), np.float32), max(1, held // len(rows))
    of, ones = rows.T.copy(), np.ones(len(rows), np.float32)
    for k in range(0, len(q), step):
        part, mine = q[k : k + step], chosen[k : k + step]
        z = part @ of
        own = z[np.arange(len(z)), mine]
        with np.errstate(over="ignore"):
            total = np.exp(z, out=z) @ ones
        if not (total.min() > 1e-30 and total.max() < 1e30):  # beyond what single precision holds: relative to the largest
            z = part @ of
            largest = z.max(axis=1)
            z -= largest[:, None]
            own -= largest
            total = np.exp(z, out=z) @ ones
        found[k : k + step] = own - np.log(total)
    return found


def _sigmoid(z):
    """In the place of ``z``."""
    with np.errstate(over="ignore"):
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        return np.reciprocal(z, out=z)


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps."""

    def __init__(self, vocabulary, seed):
        self.model, self.vocabulary = Model(vocabulary), vocabulary
        self.squares = {name: np.full(p.shape, 1e-3, np.float32) for name, p in self.model.parameters.items()}
        self.rng = np.random.default_rng(seed)
        self.noise = {}
        for name, share, n_noise in (("classes", vocabulary.class_share, CLASS_NOISE), ("words", vocabulary.word_share, WORD_NOISE)):
            with np.errstate(divide="ignore"):
                self.noise[name] = np.cumsum(share), np.log(n_noise * share).astype(np.float32), n_noise
        self.places = 0

    def _step(self, name, gradient, rows):
        """One step for each row, by the sum of its gradients."""
        p, s = self.model.parameters[name], self.squares[name]
        # Sorted with their places, so that equal rows stay in order.
        bits = len(rows).bit_length()
        ranked = rows.astype(np.int64) << bits
        ranked += np.arange(len(rows))
        ranked.sort()
        order = ranked & ((1 << bits) - 1)
        ranked >>= bits
        new = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        changed, counts = np.take(ranked, begin), np.diff(begin, append=len(ranked))
        total, many = np.take(gradient, np.take(order, begin), axis=0), counts > 1
        if many.any():  # only rows that occur again are summed, in double precision
            again = np.take(gradient, order[np.repeat(many, counts)], axis=0).astype(np.float64)
            counts = counts[many]
            total[many] = np.add.reduceat(again, np.cumsum(counts) - counts, axis=0)
        square = total * total
        square += np.take(s, changed, axis=0)
        s[changed] = square
        np.sqrt(square, out=square)
        total /= square
        total *= RATE
        p[changed] = np.take(p, changed, axis=0) - total

    def _contrast(self, q, target, name):
        """Scores targets and shared noise; steps the outputs and returns the slope of q."""
        p = self.model.parameters[name]
        steps, odds, n_noise = self.noise[name]
        noise = np.minimum(np.searchsorted(steps, self.rng.random(n_noise) * steps[-1]), len(steps) - 1)
        own, other = np.take(p, target, axis=0), np.take(p, noise, axis=0)
        good = np.einsum("ij,ij->i", q, own)
        good -= odds[target]
        good = _sigmoid(good)
        good -= 1
        bad = q @ other.T
        bad -= odds[noise]
        bad = _sigmoid(bad)
        scale = np.float32(1 / len(target))
        good *= scale
        bad *= scale
        own *= good[:, None]
        own += bad @ other
        self._step(name, np.concatenate((good[:, None] * q, bad.T @ q)), np.concatenate((target, noise)))
        return own[:, :-1]

    def learn(self, inputs, bounds):
        """Goes once over all places of the texts, in stretches of ``STRETCH`` places dealt out at random."""
        v, p = self.vocabulary, self.model.parameters
        line, real = line_up(inputs, bounds, len(p["inputs"]) - 1, STRETCH)
        group = groups(line, v.starts)
        order = self.rng.permutation(len(line) // STRETCH) * STRETCH
        for k in range(0, len(order), BATCH // STRETCH):
            at = order[k : k + BATCH // STRETCH, None] + np.arange(STRETCH + CONTEXT)
            words, own = line[at], at[:, CONTEXT:].ravel()
            own, here = own[real[own]], np.flatnonzero(real[own])
            target = line[own]
            x = np.take(p["inputs"], words, axis=0)
            q = np.ones((len(own), DIMENSIONS + 1), np.float32)
            q[:, :-1] = np.take(predicted(x, p["scales"]).reshape(-1, DIMENSIONS), here, axis=0)
            short = np.flatnonzero(target < v.starts[-1])
            slope = self._contrast(q, group[own], "classes")
            if len(short):
                slope[short] += self._contrast(np.take(q, short, axis=0), target[short], "words")
            slopes = np.zeros((len(at) * STRETCH, DIMENSIONS), np.float32)
            slopes[here] = slope
            slopes = slopes.reshape(len(at), -1)
            flat, back, gradient = x.reshape(len(at), -1), np.zeros((len(at), x[0].size), np.float32), np.empty_like(p["scales"])
            for j in range(CONTEXT):
                before = slice((CONTEXT - 1 - j) * DIMENSIONS, (CONTEXT - 1 - j + STRETCH) * DIMENSIONS)
                back[:, before] += slopes * np.tile(p["scales"][j], STRETCH)
                gradient[j] = (slopes * flat[:, before]).sum(axis=0).reshape(STRETCH, DIMENSIONS).sum(axis=0)
            self.squares["scales"] += gradient * gradient
            p["scales"] -= RATE * gradient / np.sqrt(self.squares["scales"])
            self._step("inputs", back.reshape(-1, DIMENSIONS), words.ravel())
            self.places += len(own)


def _trained(vocabulary):
    def run(batches):
        part = TaskContext.get().partitionId()
        trainer, held, size = Trainer(vocabulary, part), [], 0

        def learn():
            inputs, sizes = (np.concatenate(x) for x in zip(*held))
            trainer.learn(inputs, np.concatenate(([0], np.cumsum(sizes))))

        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for _, some, places in slices(data, offsets):
                words, tails, bounds = tokens(some, places)
                _, inputs = vocabulary.find(words, tails)
                held.append((inputs, np.diff(bounds)))
                size += len(inputs)
                if size >= 1 << 18:
                    learn()
                    held, size = [], 0
        if size:
            learn()
        if trainer.places:
            values = np.array_split(trainer.model.flat().astype(np.float64) * trainer.places, PIECES)
            yield pa.RecordBatch.from_pydict(
                {
                    "piece": pa.array(range(PIECES), pa.int32()),
                    "places": pa.array([trainer.places] * PIECES, pa.int64()),
                    "total": pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary()),
                }
            )

    return run


def _summed(batches):
    """Sums by piece, as the parts stream in."""
    total, places = {}, {}
    for batch in batches:
        for piece, n, raw in zip(*(batch.column(c).to_pylist() for c in ("piece", "places", "total"))):
            values = np.frombuffer(raw, np.float32).astype(np.float64)
            total[piece] = total[piece] + values if piece in total else values
            places[piece] = places.get(piece, 0) + n
    if total:
        yield pa.RecordBatch.from_pydict(
            {
                "piece": pa.array(list(total), pa.int32()),
                "mean": pa.array([(total[k] / places[k]).astype(np.float32).tobytes() for k in total], pa.binary()),
            }
        )


def train(docs: DataFrame, vocabulary: Vocabulary) -> Model:
    """The average of the models of all tasks."""
    model = Model(vocabulary)
    parts = docs.mapInArrow(_trained(vocabulary), "piece int, places long, total binary")
    sums = parts.repartition("piece").mapInArrow(_summed, "piece int, mean binary")
    rows = sums.orderBy("piece").collect()  # the parameters once
    return model.fill(np.concatenate([np.frombuffer(row["mean"], np.float32) for row in rows])) if rows else model


_RARE = pa.struct([("word", pa.int64()), ("n", pa.int64()), ("part", pa.float64())])


def _scored(vocabulary, model):
    v, log10 = vocabulary, np.log(10)
    base = np.log10(v.n + ADD * (v.v + 1))
    with np.errstate(divide="ignore"):
        tail_share = np.log10(v.tail_sums)
    known_share = np.log10(1 - v.unknown)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        n_short = len(v.word_share)
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for first, some, places in slices(data, offsets):
                words, tails, bounds = tokens(some, places)
                place, inputs = v.find(words, tails)
                n = len(places) - 1
                text = np.repeat(np.arange(n), np.diff(bounds))
                part = model.log_probabilities(inputs, bounds, v.starts) / log10 + known_share
                tail = inputs >= n_short
                part[tail] -= tail_share[inputs[tail] - n_short]
                c = np.where(place >= 0, v.c[place], 0) if len(v.c) else np.zeros(len(words), np.int64)
                c[words == END] = v.n_ends
                here = (c > 0) | (words == END)
                part[tail & here] += np.log10(c[tail & here] + ADD)
                if not v.n_ends:
                    part[words == END] = np.log10(v.unknown)
                # Words beyond the known ones wait for their counts.
                pairs = np.flatnonzero(~here)
                order = np.lexsort((words[pairs], text[pairs]))
                pairs = pairs[order]
                w, t = words[pairs], text[pairs]
                new = np.ones(len(pairs), bool)
                new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
                begin = np.flatnonzero(new)
                rare_n = np.diff(np.append(begin, len(pairs)))
                rare_part = np.add.reduceat(part[pairs], begin) if len(begin) else np.zeros(0)
                rare = pa.StructArray.from_arrays(
                    [pa.array(w[begin].view(np.int64)), pa.array(rare_n.astype(np.int64)), pa.array(rare_part)], fields=list(_RARE)
                )
                cuts = np.searchsorted(t[begin], np.arange(n + 1))
                of = lambda values: np.bincount(text[here], values[here], n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, n),
                        "row": pa.array(np.arange(row, row + n)),
                        "n_tokens": pa.array(np.diff(bounds)),
                        "n_here": pa.array(np.bincount(text[c > 0], minlength=n)),
                        "base_here": pa.array(of(np.log10(c + ADD) - base)),
                        "score_here": pa.array(of(part)),
                        "rare": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rare),
                    }
                )
                row += n

    return run


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for each row."""
    schema = (
        "doc_id long, row long, n_tokens long, n_here long, base_here double, score_here double, "
        "rare array<struct<word: long, n: long, part: double>>"
    )
    here = stored(texts(docs).mapInArrow(_scored(vocabulary, model), schema), "lm-scored")
    rare = here.select("row", F.inline("rare"))
    # Only words below the cut can occur in ``rare``, so no key of the join is frequent.
    found = rare.join(counts.where(F.col("c") < vocabulary.cut).select("word", "c"), "word", "left")
    n, c = F.col("n"), F.coalesce(F.col("c"), F.lit(0))
    sums = found.groupBy("row").agg(
        F.sum(F.when(c > 0, n).otherwise(0)).alias("n_rare"),
        F.sum(n * F.log10((c + ADD) / (vocabulary.n + ADD * (vocabulary.v + 1)))).alias("base_rare"),
        F.sum(F.when(c > 0, F.col("part") + n * F.log10(c + ADD)).otherwise(n * float(np.log10(vocabulary.unknown)))).alias("score_rare"),
    )
    both = lambda name: F.col(f"{name}_here") + F.coalesce(F.col(f"{name}_rare"), F.lit(0))
    return here.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", both("n").alias("n_known"), both("base").alias("base_score"), both("score").alias("score")
    )


def language_model(docs: DataFrame):
    """(counts, vocabulary, model) learnt from all rows of ``docs``."""
    plain = texts(docs)
    counts = count(plain)
    vocabulary = Vocabulary(counts)
    return counts, vocabulary, train(plain, vocabulary)


def scores(docs: DataFrame, folds=FOLDS, held_out=HELD_OUT) -> DataFrame:
    """Scores of all rows by a model of those outside the held-out fold."""
    counts, vocabulary, model = language_model(docs.where(fold("doc_id", folds) != held_out))
    return score(docs, counts, vocabulary, model).select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
