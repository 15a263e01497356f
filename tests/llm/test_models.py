"""Language model, classifiers, rules and the pipeline."""

import collections
import math
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from leadloom.llm import lm_scoring, quality_pu, quality_rules, toxicity
from leadloom.llm.tables import table, texts
from tests.llm.conftest import edge_rows, same

BETWEEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def held(doc_id, of, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of == fold


def base_by_hand(rows):
    tokens = [[*BETWEEN.findall((t or "").translate(LOWER)), None] for _, t in rows]
    c = collections.Counter(x for (i, _), ts in zip(rows, tokens) if not held(i, 10, 0) for x in ts)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts) for ts in tokens]
    return [(i, held(i, 10, 0), len(ts), sum(c[x] > 0 for x in ts), n, b) for (i, _), ts, b in zip(rows, tokens, base)]


def test_language_model_counts_and_base(edges, nothing):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = lm_scoring.scores(edges).collect()
    rounded = lambda xs: [(*x[:5], round(x[5], 5)) for x in xs]
    same(rounded([tuple(r)[:6] for r in got]), rounded(base_by_hand(rows)))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_scoring.scores(nothing).collect() == []


def test_language_model_without_training_texts(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200) if held(i, 10, 0)], "doc_id long, text string")
    for row in lm_scoring.scores(docs).collect():
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == 0
        assert row["score"] == pytest.approx(3 * math.log10(0.5))


def test_rare_words_are_joined(edges, monkeypatch):
    """With few known words the counts come from the join and the scores stay the same."""
    few = lm_scoring.scores(edges).collect()
    monkeypatch.setattr(lm_scoring, "KNOWN", 5)
    monkeypatch.setattr(lm_scoring, "SHORTLIST", 5)
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = lm_scoring.scores(edges).collect()
    rounded = lambda xs: [(*x[:5], round(x[5], 5)) for x in xs]
    same(rounded([tuple(r)[:6] for r in got]), rounded(base_by_hand(rows)))
    assert len(few) == len(got)


def test_probabilities_sum_to_one(spark, small):
    """Over the shortlist, and over tail classes, at some places of real texts."""
    docs = table(spark, small, "documents")
    _, vocabulary, model = lm_scoring.language_model(docs)
    n_short = len(vocabulary.word_share)
    tails = np.flatnonzero(vocabulary.tail_sums > 0)
    for context in ([5, 3, 1, 0], [n_short + int(tails[0]), 2, 9, 7]):
        total = 0.0
        for chosen in (np.arange(n_short), n_short + tails):
            inputs = np.concatenate([[*context[::-1], t] for t in chosen])
            bounds = np.arange(0, 5 * len(chosen) + 1, 5)
            total += np.exp(model.log_probabilities(inputs, bounds, vocabulary.starts)[4::5]).sum()
        assert total == pytest.approx(1, abs=1e-3)
    known = (vocabulary.c[vocabulary.short < 0] + lm_scoring.ADD).sum()
    assert known == pytest.approx(vocabulary.tail_sums.sum())  # all words are known in so small a table


def test_scores_by_hand(spark):
    """The score of each text against a plain sum over the formula's factors."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{min(int(rng.zipf(1.4)), 400)}" for _ in range(30))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, v, model = lm_scoring.language_model(docs)
    c_of = {r["word"]: r["c"] for r in counts.collect()}
    p, n_short, ends = model.parameters, len(v.word_share), int(lm_scoring.END.view(np.int64))
    soft = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
    want = {}
    for doc_id, text in [*rows, (-1, "unseen w1")]:
        raw = np.frombuffer(text.encode(), np.uint8)
        words, tails, _ = lm_scoring.tokens(raw, np.array([0, len(raw)]))
        place, inputs = v.find(words, tails)
        total, before = 0.0, [n_short + lm_scoring.TAILS] * lm_scoring.CONTEXT
        for word, tail, token in zip(words.view(np.int64).tolist(), tails.tolist(), inputs.tolist()):
            c = c_of.get(word, 0)
            if c:
                q = np.append(sum(s * p["inputs"][b] for s, b in zip(p["scales"].astype(float), before)), 1)
                group = np.searchsorted(v.starts, token, "right") - 1 if token < n_short else len(v.starts) - 1 + token - n_short
                part = soft(p["classes"] @ q)[group] + math.log(1 - v.unknown)
                if token < n_short:
                    low, high = v.starts[group], v.starts[group + 1]
                    part += soft(p["words"][low:high] @ q)[token - low]
                else:
                    part += math.log((c + lm_scoring.ADD) / v.tail_sums[tail])
            else:
                part = math.log(v.unknown)
            total += part / math.log(10)
            before = [token, *before[:-1]]
        want[doc_id] = total
    both = docs.unionAll(spark.createDataFrame([(-1, "unseen w1")], docs.schema))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(both, counts, v, model).collect()}
    assert c_of[ends] == 200 and n_short > 50 and got == pytest.approx(want, rel=1e-4)


def test_language_model_beats_the_base_on_held_out_texts(spark, small):
    rows = [r for r in lm_scoring.scores(table(spark, small, "documents")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_shortlist_grows_with_the_vocabulary(spark):
    """Every word above the least count has parameters; classes grow with the rank of their words."""
    text = " ".join(f"w{k}" for k in range(12000))
    docs = spark.createDataFrame([(k, text) for k in range(lm_scoring.LEAST_COUNT)] + [(9, "rare")], "doc_id long, text string")
    vocabulary = lm_scoring.Vocabulary(lm_scoring.count(texts(docs)))
    n = len(vocabulary.word_share)
    widths = np.diff(vocabulary.starts)
    assert n == widths.sum() == 12001 and vocabulary.starts[0] == 0 and len(widths) <= 72
    assert 1 <= widths[0] <= 4 and widths.max() <= 2 * 12001 / 72 + 2 and (np.diff(widths) >= -1).all()
    assert len(vocabulary.class_share) == len(widths) + lm_scoring.TAILS


def test_tail_inputs_come_after_a_large_shortlist():
    vocabulary = object.__new__(lm_scoring.Vocabulary)
    vocabulary.words, vocabulary.word_share = np.zeros(0, np.uint64), np.ones(60000)
    assert vocabulary.find(np.array([1], np.uint64), np.array([5], np.int16))[1].tolist() == [60005]


def test_training_sees_every_place(edges):
    plain = texts(edges)
    vocabulary = lm_scoring.Vocabulary(lm_scoring.count(plain))
    parts = plain.mapInArrow(lm_scoring._trained(vocabulary), "piece int, places long, total binary")
    assert sum(r["places"] for r in parts.where("piece = 0").collect()) == vocabulary.n > 20000


@pytest.mark.parametrize("step", [1, 7, 32])
def test_neighbours_in_a_line_are_the_words_before(step):
    sizes = [3, 0, 1, 9, 40]
    inputs, bounds = np.arange(sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
    line, real = lm_scoring.line_up(inputs, bounds, 99, step)
    assert (len(line) - lm_scoring.CONTEXT) % step == 0
    assert line[real].tolist() == inputs.tolist()
    starts, at = np.repeat(bounds[:-1], sizes), np.flatnonzero(real)
    for k in range(1, lm_scoring.CONTEXT + 1):
        assert line[at - k].tolist() == [99 if i - k < first else i - k for i, first in enumerate(starts)]
    assert len(lm_scoring.line_up(inputs[:0], bounds[:1], 99, step)[0]) == lm_scoring.CONTEXT


def test_equal_rows_are_stepped_by_the_sum_of_their_gradients(monkeypatch):
    class Vocabulary:
        word_share, class_share, starts = np.full(30, 1 / 30), np.full(1 + lm_scoring.TAILS, 1.0), np.array([0, 30])

    rng = np.random.default_rng(1)
    rows, gradient = rng.integers(0, 30, 200), rng.standard_normal((200, lm_scoring.DIMENSIONS + 1)).astype(np.float32)
    want = lm_scoring.Model(Vocabulary).parameters["words"].astype(float)
    for row in set(rows.tolist()):
        total = gradient[rows == row].astype(float).sum(axis=0)
        want[row] -= lm_scoring.RATE * total / np.sqrt(1e-3 + total * total)
    for batch in (10, 1000):  # fewer and more than the rows
        monkeypatch.setattr(lm_scoring, "BATCH", batch)
        trainer = lm_scoring.Trainer(Vocabulary, 0)
        trainer._step("words", gradient, rows)
        np.testing.assert_allclose(trainer.model.parameters["words"], want, atol=1e-5)


def test_log_softmax_beyond_single_precision():
    q, rows = np.array([[200.0, 1], [-300, 1], [0.5, 1]], np.float32), np.array([[1, 0], [0.5, 0.25], [-1, 3]], np.float32)
    z = q.astype(float) @ rows.T
    want = [row[c] - row.max() - math.log(np.exp(row - row.max()).sum()) for row, c in zip(z, (1, 0, 2))]
    np.testing.assert_allclose(lm_scoring._log_softmax(q, rows, np.array([1, 0, 2])), want, rtol=1e-5)


def test_training_learns_contexts():
    """Words of two languages that never meet: the word before tells which may follow."""

    class Vocabulary:
        word_share = np.concatenate(([0.02], np.full(20, 0.049)))
        class_share = np.concatenate(([1.0], np.zeros(lm_scoring.TAILS)))
        starts = np.array([0, 21])

    rng = np.random.default_rng(0)
    texts = [1 + 10 * (k % 2) + rng.integers(0, 10, 30) for k in range(1500)]
    inputs, bounds = np.concatenate(texts), np.arange(0, 45001, 30)
    trainer = lm_scoring.Trainer(Vocabulary, 0)
    for _ in range(6):
        trainer.learn(inputs, bounds)
    found = trainer.model.log_probabilities(inputs, bounds, Vocabulary.starts).reshape(-1, 30)[:, 5:]
    assert found.mean() > math.log(1 / 13)


def test_toxicity_of_edge_cases(edges, nothing, no_labels, some_labels):
    for labels in (some_labels, no_labels):
        rows = toxicity.toxicity(edges, labels).collect()
        assert len(rows) == len(edge_rows())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    assert toxicity.toxicity(nothing, some_labels).collect() == []


def test_features_are_windows_of_characters():
    texts = ["дурак", "Aé日本語🙂!x", "", "abc", "abcd", "a.B1é"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    found = list(toxicity.features(data, np.cumsum([0, *map(len, raw)])))
    for size, (text, bucket) in zip(toxicity.SIZES, found):
        assert np.bincount(text, minlength=len(texts)).tolist() == [max(0, len(t) - size + 1) for t in texts]
    plain = ["".join(c if not c.isascii() or c.isalnum() else " " for c in t.lower()) for t in texts]
    grams = [[p[k : k + size] for p in plain for k in range(len(p) - size + 1)] for size in toxicity.SIZES]
    buckets = {}
    for of_size, (_, bucket) in zip(grams, found):
        for gram, b in zip(of_size, bucket.tolist()):
            assert buckets.setdefault(gram, b) == b
    assert len(set(buckets.values())) == len(buckets)


def test_counts_and_ratios_by_hand(spark):
    """Log-count ratios of features against a plain count."""
    rng = np.random.default_rng(5)
    rows = [("".join(rng.choice(list("abé "), 12)), int(k % 3 == 0), 1.0) for k in range(300)]
    chosen = spark.createDataFrame(rows, "text string, toxic int, weight double").repartition(3)
    n = [sum(t == c for _, t, _ in rows) for c in (0, 1)]
    buckets, ratios = toxicity.informative(chosen, *n, limit=1 << 20)
    counts = collections.defaultdict(lambda: [0, 0])
    for text, toxic, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        for b in {int(b) for _, bucket in toxicity.features(raw, np.array([0, len(raw)])) for b in bucket}:
            counts[b][toxic] += 1
    want = {b: math.log((t + 1) / (n[1] + 2)) - math.log((c + 1) / (n[0] + 2)) for b, (c, t) in counts.items() if c + t >= toxicity.LEAST}
    assert dict(zip(buckets.tolist(), ratios.tolist())) == pytest.approx(want)


def test_toxic_sample_has_one_text_for_each_label(spark):
    rows = [(7, f"hot {k}") for k in range(500)] + [(None, "none")] * 50 + [(k, f"t {k}") for k in range(10, 60)]
    labels = spark.createDataFrame([(k, k % 2) for k in [7, *range(10, 60)]] + [(None, 1)], "doc_id long, toxic int")
    found = toxicity.sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels).collect()
    assert len(found) == 51 and sum(r["text"].startswith("hot") for r in found) == 1


def test_toxicity_is_learnt_and_held_out_labels_are_not(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(k, " ".join([word() for _ in range(40)] + ["zzvilezz"] * (k % 4 == 0))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, int(k % 4 == 0) if not held(k, 4, 2) else int(k % 4 != 0)) for k, _ in rows]
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)


def test_quality_of_edge_cases(edges, nothing, no_labels, some_labels):
    for labels in (some_labels, no_labels):
        rows = quality_pu.quality(edges, labels).collect()
        assert len(rows) == len(edge_rows())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    assert quality_pu.quality(nothing, some_labels).collect() == []
    kept = quality_pu.keep_good(edges, quality_pu.train(edges, some_labels))
    assert kept.columns == edges.columns


def test_held_out_accuracy_on_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in table(spark, folder, "labels").collect()}
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    for rows, name, least in ((quality_pu.quality(docs, labels), "quality", 0.9), (toxicity.toxicity(docs, labels), "toxic", 0.9)):
        right = [r["predicted"] == truth[r["doc_id"]][name] for r in rows.collect() if r["held_out"] and r["doc_id"] in truth]
        assert np.mean(right) > least


def test_class_prior_is_near_the_true_share():
    rng = np.random.default_rng(0)
    make = lambda n, shift: (rng.standard_normal((n, quality_pu.WIDTH)) * 0.05 + shift).astype(np.float32)
    positive = make(2000, 0.0)
    unlabelled = np.concatenate((make(1400, 0.0), make(600, 0.15)))
    assert abs(quality_pu.class_prior(positive, unlabelled[rng.permutation(2000)]) - 0.7) < 0.08


def rules_by_hand(text):
    w = BETWEEN.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if BETWEEN.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rule_counts_with_edge_cases(edges, nothing, some_labels, no_labels):
    want = []
    for doc_id, text, *_ in edge_rows():
        counts = rules_by_hand(text)
        want.append((doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    for labels in (some_labels, no_labels):
        got = quality_rules.judge(edges, labels).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept").collect()
        same([tuple(r)[:-1] for r in got], want)
        assert all(r["kept"] != r["base_failed"] for r in got)  # too few labels to accept any cut-off
    assert quality_rules.judge(nothing, some_labels).collect() == []


def exact_tail(n, k, share):
    from fractions import Fraction

    p = Fraction(share).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    from pyspark.sql import functions as F

    cells = [(n, k) for n in (0, 1, 7, 400, 1500) for k in (0, 1, 2, 5) if k <= n]
    for n, k, p in spark.createDataFrame(cells, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.005)).collect():
        assert p == pytest.approx(exact_tail(n, k, 0.005), rel=1e-9)


def test_cutoffs_are_the_strictest_that_hold(spark):
    """One language with enough good texts, one with too few; bad symbols at a known share."""
    rows = [(k, "en" if k < 6000 else "de", 10 if k % 1000 == 0 else 0, 1) for k in range(6300)]
    docs = spark.createDataFrame(rows, "doc_id long, stratum string, n_symbols long, quality int")
    measured = docs.selectExpr("doc_id", "stratum", "doc_id text_key", "n_symbols", "100L n_words", "500L word_chars", "0L n_dup_lines", "0L n_repeat_words", "10L n_lines")
    labels = docs.select("doc_id", "quality")
    found = {r["stratum"]: r for r in quality_rules.cutoffs(measured, labels).collect()}
    # 6 of 6000 have 2 % symbols or less than the next cut-off: p is far below 0.05 / 54 at every cut-off.
    assert found["en"]["cut_symbol_share"] == 0.02 and found["en"]["cut_mean_word_length"] == 6.0
    assert all(found["de"][f"cut_{rule}"] is None for rule in quality_rules.RULES)
    m = sum(map(len, quality_rules.RULES.values())) * 2
    for r in quality_rules.tests(measured, labels).collect():
        if r["k"] <= r["n"] * 0.005:
            assert r["p_value"] == pytest.approx(exact_tail(r["n"], r["k"], 0.005), rel=1e-9)
            assert (r["p_value"] * m <= 0.05) == (r["stratum"] == "en")


def test_copies_of_a_good_text_are_one_trial(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text, "en") for k in range(6000)] + [(6000, text + " %", "en"), (6001, text, "de")], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 quality")
    columns = [docs["doc_id"], docs["lang"].alias("stratum")]
    found = quality_rules.tests(quality_rules.measures(docs, columns), labels).collect()
    assert {(r["stratum"], r["n"]) for r in found} == {("en", 2), ("de", 1)}
    cuts = quality_rules.cutoffs(quality_rules.measures(docs, columns), labels).collect()
    assert all(r[f"cut_{rule}"] is None for r in cuts for rule in quality_rules.RULES)


def test_rules_with_accepted_cutoffs_equal_sql(spark, tmp_path, monkeypatch):
    """Enough good texts in two languages for cut-offs to be accepted, few in a third."""
    from checks import compare
    from leadloom.llm.oracles import ORACLES
    from leadloom.llm.queries import QUERIES

    words = " ".join(f"w{k % 50}" for k in range(50))
    bad = ["#" * 40, "same\n" * 30, "a b c " * 20, "x" * 900, ""]
    rows = [(k, f"{words} {k} {bad[k % 5] if k % 500 < 5 else ''}", ("de", "en")[k % 2] if k % 20 else "fr", "s", 1) for k in range(8000)]
    rows += [(k, words, "en", "s", 1) for k in range(8000, 8100)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 500 >= 3), 0) for k in range(8100)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    con = compare.duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    monkeypatch.setitem(compare.QUERIES, "rules", QUERIES["op9_quality_rules"])
    monkeypatch.setitem(compare.ORACLES, "rules", ORACLES["op9_quality_rules"])
    assert compare.differences(spark, con, folder, "rules") is None
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality_rules.judge(docs, labels)
    cuts = {r["stratum"] for r in judged.where("cut_symbol_share is not null").select("stratum").distinct().collect()}
    assert cuts == {"en", "de"} and judged.where("rule_failed is not null").count() > 0


def test_samples_are_bounded_by_row(spark):
    """One id, and no id, hold most rows; both take part and neither fills the sample."""
    rows = [(7, f"hot {k}") for k in range(900)] + [(None, f"none {k}") for k in range(900)] + [(8, "copy")] * 900 + [(k, f"t {k}") for k in range(10, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, 1) for k in [7, 8, *range(10, 40)]] + [(None, 1)], "doc_id long, quality int")
    positive, unlabelled = quality_pu.samples(docs, labels, positives=1000, unlabelled=500)
    assert len(positive) == 32 and 250 < len(unlabelled) < 450
    assert all(len(s) <= n for s, n in zip(quality_pu.samples(docs, labels, positives=10, unlabelled=100), (10, 100)))


def test_pipeline_against_plain_steps(spark, small):
    import corpus_pipeline
    from leadloom.llm import prefix_bpe
    from tests.llm.test_search import hits_by_hand, near_by_hand

    docs = table(spark, small, "documents")
    network = quality_pu.train(docs, table(spark, small, "labels"))
    good = {r["doc_id"] for r in quality_pu.score(docs, network).collect() if r["score"] >= 0.5}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    plain = []
    for doc_id, text in rows:  # so few labels accept no cut-off
        n, _, _, _, repeated = rules_by_hand(text)
        if n >= 50 and 100 * repeated <= 50 * n:
            plain.append((doc_id, text))
    plain = [r for r, near in zip(plain, near_by_hand(plain, 5)) if near[3]]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    plain = [r for r, hit in zip(plain, hits_by_hand(plain, items)) if not hit[5]]
    code = prefix_bpe.encoder(prefix_bpe.VOCABULARY)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: code.encode([t])[0].tolist() for i, t in plain}


def test_decontamination_stage_drops_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"p{k}" for k in range(12))
    spark.createDataFrame([("i", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stay = [(None, "clean"), (None, None), (None, "also clean"), (4, "a text that shares its id"), (5, "other")]
    docs = spark.createDataFrame([*stay, (None, "x " + passage), (4, passage), (4, passage), (6, passage)], "doc_id long, text string")
    same(corpus_pipeline.decontamination_stage(spark, docs.repartition(3), str(tmp_path)).collect(), stay)


def test_pipeline_stages_keep_columns_and_take_edge_cases(spark, edges, nothing, tmp_path):
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    clashing = ["_dropped", "_key", "_least", "_row", "dropped", "key", "least", "text_key", "good", "score"]
    odd = edges.selectExpr("*", "map('a', doc_id) as m", *[f"n_words as `{c}`" for c in clashing])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (edges, odd, nothing):
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, small).collect() == []


def test_words_are_found_by_their_leading_bits_and_steps_sum_equal_rows():
    rng = np.random.default_rng(3)
    low, high = np.uint64(5), np.uint64(2**64 - 3)
    words = np.unique(np.concatenate((rng.integers(0, 2**64, 1000, np.uint64), [low, high], np.arange(2**40, 2**40 + 20, dtype=np.uint64))))
    vocabulary = lm_scoring.Vocabulary.__new__(lm_scoring.Vocabulary)
    vocabulary.words, vocabulary.word_share = words, np.ones(1)
    vocabulary.short = np.full(len(words), -1, np.int32)
    shift, first = vocabulary.buckets
    assert len(first) >= 2 * len(words) and len(first) << int(shift) == 1 << 64
    asked = np.concatenate((words, words - np.uint64(1), words + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)))
    places = {word: k for k, word in enumerate(words.tolist())}
    found, _ = vocabulary.find(asked, np.zeros(len(asked), np.int16))
    assert found.tolist() == [places.get(word, -1) for word in asked.tolist()]

    trainer = lm_scoring.Trainer.__new__(lm_scoring.Trainer)
    start = rng.standard_normal((5000, 3)).astype(np.float32)
    for rows in (np.array([7, 4999, 7, 0, 7, 0]), np.array([3, 2, 1]), rng.integers(0, 50, 3000)):
        trainer.model = SimpleNamespace(parameters={"words": start.copy()})
        trainer.squares = {"words": np.full(start.shape, 0.5, np.float32)}
        gradient = rng.standard_normal((len(rows), 3)).astype(np.float32)
        trainer._step("words", gradient, rows)
        total = np.zeros(start.shape)
        np.add.at(total, rows, gradient.astype(np.float64))
        total = total.astype(np.float32)
        square = np.float32(0.5) + total * total
        assert (trainer.squares["words"] == square).all()
        assert (trainer.model.parameters["words"] == start - total / np.sqrt(square) * np.float32(lm_scoring.RATE)).all()
