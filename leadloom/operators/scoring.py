"""Features, labels, boosted-tree training, scoring, feedback and evaluation."""

import math
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.features import feature_columns, rule_label, rule_score
from leadloom.functions.grading import grade, recommend, round1, score_from_probability
from leadloom.operators.ranking import nth_smallest, rank_leads
from leadloom.session import shared_dir, worked_out

# Distinct training vectors per partition.
_VECTORS_PER_PART = 50_000


def extract_features(df):
    """Key and the eleven model inputs."""
    return df.select("lead_seq", *[c.alias(n) for n, c in feature_columns().items()])


def with_features(df):
    return df.withColumns(feature_columns())


def generate_labels(features):
    """Rule score and rule label from the feature columns."""
    return features.withColumn("rule_score", rule_score()).withColumn("label", rule_label("rule_score"))


def label_balance(labelled):
    return labelled.agg(
        F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("low")
    )


def grade_leads(df, score):
    """Grade any 0-100 score column, rounded to one place first."""
    return (
        df.withColumn("ml_score", round1(score))
        .withColumn("ml_grade", grade("ml_score"))
        .withColumn("ml_recommend", recommend("ml_score"))
    )


def rule_scored(df):
    """Leads graded by their rule score instead of a model."""
    scored = grade_leads(generate_labels(with_features(df)), "rule_score")
    return worked_out(scored.select(*df.columns, "ml_score", "ml_grade", "ml_recommend"))


def grade_summary(scored):
    """Leads per grade and recommended leads, in one row; absent grades count 0."""
    counts = [F.count_if(F.col("ml_grade") == g).alias(f"grade_{g.lower()}") for g in V.GRADE_ORDER]
    return scored.agg(*counts, F.count_if("ml_recommend").alias("recommended"))


def recommended(scored):
    return scored.where("ml_recommend")


def split(df, share=V.HOLDOUT_SHARE, seed=V.SEED):
    """Training and test rows; the test part holds exactly ``ceil(share * n)`` of them.

    Rows are ordered by a hash of seed and ``lead_seq``, which is written out once. Only the cut
    value is looked up, so splitting moves no rows and gives the same parts on every run.
    """
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.col("lead_seq").cast("string")))
    keys = df.select(
        "lead_seq", text.alias("text"),
        F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint").alias("key"),
    )
    # Looked at several times: neither the rows nor their hashes are made again each time.
    shared_dir(df.sparkSession)
    keys = keys.checkpoint()
    cut = nth_smallest(keys, "key", lambda total: math.ceil(share * total))
    if cut is None:
        return df, df.where(F.lit(False))
    smaller, total = keys.agg(F.count_if(F.col("key") < cut), F.count("*")).first()
    size = math.ceil(share * total)
    tied = keys.where(F.col("key") == cut).orderBy("text", "lead_seq").limit(size - smaller)
    last = tied.agg(F.max(F.struct("text", "lead_seq")).alias("last")).first()["last"]
    edge = F.struct(F.lit(last["text"]), F.lit(last["lead_seq"]).cast("bigint"))
    in_test = F.struct(text, F.col("lead_seq")) <= edge
    return df.where(~in_test), df.where(in_test)


@dataclass(frozen=True)
class Trained:
    """A fitted model, its holdout report if there was enough data, and whether the
    training rows held one class only."""

    model: PipelineModel
    report: DataFrame | None
    single_class: bool


def fit(labelled, trees=V.TREES):
    """Boosted trees over ``label`` and the feature columns.

    Equal feature vectors are first merged into one weighted row. Features take few
    values, so the many passes of boosting run over far fewer rows than there are leads.
    The merged rows are laid out by content, which makes fits repeatable.
    """
    spark = labelled.sparkSession
    shared_dir(spark)
    columns = [*V.FEATURE_COLUMNS, "label"]
    merged = labelled.groupBy(*columns).agg(F.count("*").cast("double").alias("weight")).persist()
    try:
        parts = max(1, math.ceil(merged.count() / _VECTORS_PER_PART))
        rows = merged.repartition(parts, *columns).sortWithinPartitions(*columns)
        steps = [
            VectorAssembler(inputCols=V.FEATURE_COLUMNS, outputCol="features"),
            GBTClassifier(
                maxIter=trees, stepSize=V.LEARNING_RATE, maxDepth=V.TREE_DEPTH,
                minInstancesPerNode=1, seed=V.SEED, weightCol="weight",
            ),
        ]
        model = Pipeline(stages=steps).fit(rows)
        classes = merged.agg(F.count_distinct("label")).first()[0]
    finally:
        merged.unpersist()
    return model, classes < 2


def train(df, trees=V.TREES):
    """Fit on rule labels; with twenty rows or more, on 80 % and report on the rest.

    ``df`` is read several times, but all passes except the fit read ``lead_seq`` alone;
    keep it in a table.
    """
    rows, test = df, None
    if df.count() >= V.HOLDOUT_FROM_ROWS:
        rows, test = split(df)
    model, single_class = fit(generate_labels(extract_features(rows)), trees)
    report = None if test is None else evaluate(model, generate_labels(extract_features(test)))
    return Trained(model, report, single_class)


def evaluate(model, labelled):
    """Classification report of a model on labelled features."""
    return classification_report(model.transform(labelled).select("label", "prediction"))


def confusion(predicted):
    """Counts per (label, prediction) in one row."""
    return predicted.agg(
        *[
            F.count_if((F.col("label") == l) & (F.col("prediction") == p)).alias(f"n{l}{p}")
            for l in V.CLASS_NAMES
            for p in V.CLASS_NAMES
        ]
    )


def classification_report(predicted):
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    Both classes always have a row; a measure without any case is 0.
    """

    def share(part, whole):
        return F.when(whole == 0, 0.0).otherwise(part / whole)

    n = {(l, p): F.col(f"n{l}{p}") for l in (0, 1) for p in (0, 1)}
    total = reduce(lambda a, b: a + b, n.values())
    support = {l: n[l, 0] + n[l, 1] for l in (0, 1)}
    measures = {}
    for l in (0, 1):
        hit, false, missed = n[l, l], n[1 - l, l], n[l, 1 - l]
        measures[l] = {
            "precision": share(hit, hit + false),
            "recall": share(hit, hit + missed),
            "f1": share(2 * hit, 2 * hit + false + missed),
        }
    names = ["precision", "recall", "f1"]

    def row(name, values, cases):
        return F.struct(F.lit(name).alias("name"), *[values[m].alias(m) for m in names], cases.alias("support"))

    accuracy = share(n[0, 0] + n[1, 1], total)
    macro = {m: (measures[0][m] + measures[1][m]) / F.lit(2.0) for m in names}
    weighted = {
        m: share(measures[0][m] * support[0] + measures[1][m] * support[1], total) for m in names
    }
    rows = [row(V.CLASS_NAMES[l], measures[l], support[l]) for l in (0, 1)]
    rows += [
        row("accuracy", dict.fromkeys(names, accuracy), total),
        row("macro avg", macro, total),
        row("weighted avg", weighted, total),
    ]
    return confusion(predicted).select(F.inline(F.array(*rows)))


def predict_proba(model, df):
    """Leads with ``probability_good``, the probability of the good class."""
    scored = model.transform(with_features(df))
    good = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*df.columns, good.alias("probability_good"))


def score(df, model=None, trees=V.TREES, ordered=True, model_path=None):
    """Score, grade and recommendation per lead, best first.

    Without a model the one saved at ``model_path`` is loaded; where there is none, one is trained
    on the same leads, and saved there if a path is given. ``ordered=False`` leaves out the
    total sort where the next step does not need it.
    """
    if model is None:
        model = train(df, trees).model if model_path is None else load_or_train(df, model_path, trees)
    scored = (
        predict_proba(model, df)
        .withColumn("ml_score", score_from_probability("probability_good"))
        .withColumn("ml_grade", grade("ml_score"))
        .withColumn("ml_recommend", recommend("ml_score"))
        .drop("probability_good")
    )
    return rank_leads(scored) if ordered else scored


def apply_feedback(labelled, feedback):
    """Reviewer labels over rule labels; a low-quality verdict wins over a good one."""
    verdicts = feedback.groupBy("lead_seq").agg(F.min("label").alias("_verdict"))
    return (
        labelled.join(verdicts, "lead_seq", "left")
        .withColumn("label", F.coalesce("_verdict", "label"))
        .select(labelled.columns)
    )


def retrain(df, feedback, trees=V.TREES):
    """Fit on every lead, with reviewer labels applied."""
    labelled = apply_feedback(generate_labels(extract_features(df)), feedback)
    model, single_class = fit(labelled, trees)
    return Trained(model, None, single_class)


def save_model(model, path):
    model.write().overwrite().save(path)


def load_model(path):
    """A saved model, or None if there is none."""
    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as error:
        if any(sign in str(error) for sign in ("PATH_NOT_FOUND", "InvalidInputException", "does not exist")):
            return None
        raise


def load_or_train(df, path, trees=V.TREES):
    """The model saved at ``path``; where there is none, train one and save it there."""
    model = load_model(path)
    if model is None:
        model = train(df, trees).model
        save_model(model, path)
    return model
