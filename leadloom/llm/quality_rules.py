"""Quality rules whose cut-offs carry a guarantee.

Each rule rejects texts whose measure exceeds a cut-off. A cut-off is used in a stratum (a
language) only if labelled good texts show that it rejects few of them: with n good texts of
which k exceed the cut-off, the chance of seeing k or fewer if the true share were the allowed
one is the exact binomial sum. That chance must not exceed ``confidence_error`` divided by the
number of all tests (rules x cut-offs x strata), so all accepted cut-offs hold together. The
allowed share is divided among the rules: a stratum loses at most ``max_false_rejection`` of
its good texts. Of the accepted cut-offs the strictest is taken; where none is accepted, the
rule rejects nothing.

Everything is made of DataFrame functions. The texts are read once; what follows works on the
stored counts.

Defined cases: a NULL or empty text has no words, all counts 0 and fails the base rules. A NULL
language is a stratum of its own. A document with several labels is good if all say so; a NULL
quality is no label. Repeated rows are measured and judged one by one, and equal good texts of a stratum are one
trial. Other columns are not read.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import once
from leadloom.llm.tables import stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Measures and the cut-offs that are tested, fixed before any label is seen.
RULES = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "duplicate_line_share": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeated_word_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "mean_word_length": (6.0, 7.0, 8.0, 10.0, 12.0, 15.0, 20.0),
}
MAX_FALSE_REJECTION = 0.02
CONFIDENCE_ERROR = 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text):
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def lines_with_words(text):
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def repeated_words(words):
    """How many words lie in a run of three words that occurs more than once.

    Runs are sorted by hash, so equal ones meet; their places, sorted again, each cover the
    words up to the next place, three at most. Equal 64-bit hashes stand for equal runs.
    """
    runs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda word, i: F.struct(
            F.xxhash64(word, *(F.get(words, i + k) for k in range(1, WINDOW))).alias("h"), i.alias("p")
        ),
    )

    def places(s):
        same = lambda run, i: F.coalesce(run["h"] == F.get(s, i)["h"], F.lit(False))
        marked = F.transform(s, lambda run, i: F.when(same(run, i - 1) | same(run, i + 1), run["p"]))
        return F.sort_array(F.array_compact(marked))

    def covered(p):
        reach = F.transform(p, lambda place, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - place, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    return once(once(F.sort_array(runs), places), covered)


def measures(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep``, the counts of each text, with the number of lines that have words, and its ``text_key``, a hash."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def all_counts(t):
        def of_words(w):
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.concat_ws("", w)).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            )

        def of_lines(lines):
            n = F.size(lines)
            return F.struct(n.cast("long").alias("n_lines"), (n - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

        return F.struct(
            once(words_of(t), of_words).alias("w"),
            once(lines_with_words(t), of_lines).alias("l"),
            F.regexp_count(t, F.lit(f"[{re.escape(SYMBOLS)}]")).cast("long").alias("n_symbols"),
        )

    counted = docs.select(*keep, F.xxhash64(text).alias("text_key"), once(text, all_counts).alias("_m"))
    return counted.select(
        *counted.columns[:-1], "_m.w.n_words", "_m.w.word_chars", "_m.n_symbols", "_m.l.n_dup_lines", "_m.w.n_repeat_words", "_m.l.n_lines"
    )


def shares():
    """The measures of the rules, by name; larger is worse."""
    at_least_one = lambda name: F.greatest(F.col(name), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / at_least_one("word_chars"),
        "duplicate_line_share": F.col("n_dup_lines") / at_least_one("n_lines"),
        "repeated_word_share": F.col("n_repeat_words") / at_least_one("n_words"),
        "mean_word_length": F.col("word_chars") / at_least_one("n_words"),
    }


def log_factorial(n):
    """ln n! by Stirling's series, shifted by ten so that its error is below 1e-12."""
    x = n + F.lit(11.0)
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x**5)
    shift = F.log(n + F.lit(1.0))
    for k in range(2, 11):
        shift = shift + F.log(n + F.lit(float(k)))
    return series - shift


def binomial_tail(n, k, share):
    """P(at most k of n) at a share, from the largest term downwards."""
    largest = F.exp(
        log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share))
    )
    step = lambda state, i: F.struct(
        (state["term"] * i / (n - i + 1) * ((1 - share) / share)).alias("term"),
        (state["total"] + state["term"] * i / (n - i + 1) * ((1 - share) / share)).alias("total"),
    )
    terms = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(largest.alias("term"), largest.alias("total"))
    return F.aggregate(terms, start, step, lambda state: state["total"])


def tests(measured: DataFrame, labels: DataFrame, max_false_rejection=MAX_FALSE_REJECTION) -> DataFrame:
    """``(stratum, rule, cutoff, n, k, p_value)`` for each rule, cut-off and stratum with good texts.

    The bounds hold for independent trials, so a text counts once in a stratum, however many copies of it are labelled.
    """
    good = (
        labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    )
    measure = shares()
    over = [
        F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cutoff"), F.count_if(measure[rule] > cut).alias("k"))
        for rule, cuts in RULES.items()
        for cut in cuts
    ]
    cells = (
        measured.select("doc_id", "stratum", "text_key", *COUNTS, "n_lines")
        .join(good, "doc_id", "left_semi")
        .dropDuplicates(["stratum", "text_key"])
        .groupBy("stratum")
        .agg(F.count("*").alias("n"), F.array(*over).alias("cells"))
        .select("stratum", "n", F.inline("cells"))
    )
    share = max_false_rejection / len(RULES)
    # A cell whose observed share exceeds the allowed one cannot pass: its chance is about a half or more.
    return cells.withColumn("p_value", F.when(F.col("k") > F.col("n") * share, 1.0).otherwise(binomial_tail(F.col("n"), F.col("k"), share)))


def cutoffs(measured: DataFrame, labels: DataFrame, max_false_rejection=MAX_FALSE_REJECTION, confidence_error=CONFIDENCE_ERROR) -> DataFrame:
    """One row per stratum with a column per rule: the strictest accepted cut-off or NULL."""
    cells = stored(tests(measured, labels, max_false_rejection), "rule-tests")
    passed = F.col("p_value") * cells.count() <= confidence_error
    return (
        cells.groupBy("stratum")
        .agg(*(F.min(F.when((F.col("rule") == rule) & passed, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES))
    )


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, keep=(), **limits) -> DataFrame:
    """Counts, cut-offs and the verdict for each document: ``rule_failed`` names the first rule
    that rejects it, ``kept`` is true if neither the base rules nor a rule does."""
    columns = [F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), *keep]
    measured = stored(measures(docs, columns), "rule-measures")
    cuts = stored(cutoffs(measured, labels, **limits), "rule-cutoffs")
    measure = shares()
    failed = F.coalesce(*(F.when(measure[rule] > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES))
    judged = measured.join(cuts, "stratum", "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("rule_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule_failed").isNull()
    )
