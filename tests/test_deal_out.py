"""Rows of a single row group go to many tasks, and costly filters with them."""

from pyspark.sql import functions as F

from checks import derived as D
from leadloom import fixed_values as V
from leadloom.functions.features import category_score
from leadloom.operators.ranking import rank_leads, with_rank
from leadloom.operators.scoring import rule_scored, split
from leadloom.session import deal_out, worked_out
from leadloom.streaming.live import best_per_address


def one_file(spark, tmp_path, rows=900):
    """Customers in one file with one row group, some of them repeated or without a key."""
    keys = F.when(F.col("id") % 10 > 0, F.col("id") - F.col("id") % 3)
    customer = spark.range(rows).select(keys.alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit("AUTO").alias("c_mktsegment"))
    customer.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'INDIA' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_rows_stay_and_spread(spark, tmp_path):
    plain = spark.read.parquet(f"{one_file(spark, tmp_path)}/customer.parquet")
    dealt = deal_out(plain)
    assert tasks(plain) == 1 and tasks(dealt) >= 3 * spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(plain).count() == plain.exceptAll(dealt).count() == 0


def test_leads_pages_and_cards_come_from_many_tasks(spark, tmp_path):
    folder = one_file(spark, tmp_path)
    for rows in (
        rule_scored(D.spark_raw_leads(spark, folder)).where("ml_grade < 'E'"),
        D.spark_map_pages(spark, folder).where("html LIKE '%maps%'"),
        D.spark_responses(spark, folder),
    ):
        assert tasks(rows) > 4


def test_filters_run_after_the_rows_are_dealt(spark, tmp_path):
    pages = D.spark_map_pages(spark, one_file(spark, tmp_path)).where("html LIKE '%maps%'")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.index("maps") < plan.index("RoundRobinPartitioning")
    assert "maps" not in plan[plan.index("RoundRobinPartitioning"):]


def test_a_micro_batch_is_dealt_out(spark, tmp_path):
    leads = spark.read.parquet(f"{one_file(spark, tmp_path)}/customer.parquet").selectExpr(
        "c_custkey AS lead_seq", *[f"'a' AS {c}" for c in D.LEAD_COLUMNS if c != "lead_seq"]
    )
    plan = best_per_address(leads, rule_scored, "D")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_columns_are_worked_out_before_filters(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, 2, "b")], "x int, _task int, y string")
    out = worked_out(rows.withColumn("z", F.repeat("y", 3)))
    assert out.columns == [*rows.columns, "z"] and sorted(out.collect(), key=str) == sorted(rows.withColumn("z", F.repeat("y", 3)).collect(), key=str)
    plan = out.where("z = 'bbb'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat") == 1


def counted(spark, rows):
    """Leads with a score that is costly, and a count of how often it was worked out."""
    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    leads = spark.range(0, rows, 1, 2).selectExpr("id % 900 AS lead_seq", "CASE WHEN id % 7 > 0 THEN id % 10 / 2D END AS ml_score")
    return leads.mapInArrow(work, "lead_seq long, ml_score double"), made


def test_ranking_works_scores_out_once(spark):
    for rank in (with_rank, rank_leads):
        scored, made = counted(spark, 1000)
        found = [(r.ml_score, r.lead_seq) for r in rank(scored).collect()]
        assert made.value == 1000
        best_first = sorted(found, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert len(found) == 1000 and (rank is with_rank or found == best_first)


def test_splitting_reads_rows_once_for_the_cut(spark):
    rows, made = counted(spark, 1000)
    parts = split(rows)
    assert made.value == 1000
    sizes = [part.count() for part in parts]
    assert sum(sizes) == 1000 and sizes[1] >= 200


def test_a_filter_on_grades_does_not_work_them_out_again(spark, tmp_path):
    graded = rule_scored(D.spark_raw_leads(spark, one_file(spark, tmp_path))).where("ml_grade < 'D'").select("lead_seq", "ml_grade")
    plan = graded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("freelance") == 1


def test_category_steps_are_clipped_one_by_one(spark):
    """Counts of words decide the score: up to the bound first, then down from there."""
    high, low = V.HIGH_VALUE_KEYWORDS, V.LOW_VALUE_KEYWORDS
    rows = [(" ".join(high[:h] + low[:k]), None) for h in range(len(high) + 1) for k in range(len(low) + 1)]
    found = spark.createDataFrame([*rows, (None, "HOME"), ("", "")], "n string, c string").select("n", "c", category_score("n", "c").alias("s"))
    for row in found.collect():
        text = f"{row.n} {row.c}".lower()
        score = V.CATEGORY_START
        for word in high:
            score = min(1.0, score + V.CATEGORY_HIGH_STEP) if word in text else score
        for word in low:
            score = max(0.0, score - V.CATEGORY_LOW_STEP) if word in text else score
        assert row.s == score
