"""Sources, sinks, model, streams and whole runs."""


import pytest
from pyspark.sql import functions as F

from checks import derived as D
from leadloom.operators import leads as LE
from leadloom.operators import scoring as SC
from leadloom.operators import sinks as SI
from leadloom.plans import runs as RU
from leadloom.session import scratch_path, shared_dir
from leadloom.sources import readers as RD
from leadloom.streaming import live as LI

SENDER = {"name": "S", "company": "C", "service": "t", "website": "w"}


@pytest.fixture(scope="module")
def leads(spark, small):
    return LE.clean_leads(D.spark_raw_leads(spark, small)).persist()


@pytest.fixture(scope="module")
def trained(leads):
    return SC.train(leads, 8)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_csv_by_name_with_mark_and_missing_columns(spark, tmp_path):
    path = tmp_path / "leads.csv"
    path.write_text(
        "﻿source,business_name,email,phone,address,website,category\n"
        'yellowpages,Digital Marketing Agency,N/A,(213) 555-0100,"3775 Long Avenue Los Angeles, CA 90007",http://a.example.com,Marketing Programs & Services\n'
        'yellowpages,"A ""B"" Co",,x,N/A,N/A,N/A\n',
        encoding="utf-8",
    )
    df = RD.read_leads_csv(spark, str(path))
    first, second = df.orderBy("lead_seq").collect()
    assert first.source == "yellowpages" and first.rating == "N/A" and first.address.endswith("CA 90007")
    assert second.business_name == 'A "B" Co' and second.email is None
    got = SC.generate_labels(SC.extract_features(df)).orderBy("lead_seq").first()
    assert (got.category_score, got.address_completeness, got.name_length, got.name_word_count) == (pytest.approx(0.82), 1.0, 0.3, 0.375)
    assert got.rule_score == pytest.approx(51.74) and got.label == 1


def test_rows_from_records(spark):
    df = RD.leads_from_rows(spark, [{"source": "a", "email": "N/A"}, {"source": "b"}])
    assert [(r.lead_seq, r.source, r.email) for r in df.collect()] == [(0, "a", "N/A"), (1, "b", None)]


def test_log_is_replaced_per_batch_and_empty_without_file(spark, tmp_path):
    path = str(tmp_path / "log")
    assert RD.read_log(spark, path).count() == 0
    row = [("t", "e", "b", "s", 1.0, "A", "sent")]
    for batch in ("a", "a", "b"):
        SI.append_log(spark.createDataFrame(row, RD.SENT_LOG), path, batch)
    assert RD.read_log(spark, path).count() == 2
    assert RD.read_log(spark, path, skip_batch="a").count() == 1


def test_searches_pair_every_query_with_every_place(spark):
    got = RD.searches(spark, ["a", "b"], ["x", "y"])
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_empty_tables_write_nothing(spark, leads, tmp_path):
    assert SI.write_leads(leads.limit(0), str(tmp_path / "x")) is False
    assert not (tmp_path / "x").exists()


def test_expected_grades(spark, small):
    summary = SC.grade_summary(SC.rule_scored(LE.clean_leads(D.spark_raw_leads(spark, small)))).first()
    assert tuple(summary) == (30, 30, 40, 50, 66)


def test_scores_agree_with_labels_and_grades_are_monotone(leads, trained):
    rows = SC.score(leads, trained.model).collect()
    assert [r.ml_score for r in rows] == sorted((r.ml_score for r in rows), reverse=True)
    assert all(0 <= r.ml_score <= 100 and r.ml_score == round(r.ml_score, 1) for r in rows)
    assert [r.ml_grade for r in rows] == sorted(r.ml_grade for r in rows)
    assert all(r.ml_recommend == (r.ml_score >= 50) for r in rows)
    labels = {r.lead_seq: r.label for r in SC.generate_labels(SC.extract_features(leads)).collect()}
    assert sum(labels[r.lead_seq] == r.ml_recommend for r in rows) / len(rows) >= 0.95


def test_report_covers_the_holdout(trained):
    rows = {r["name"]: r for r in trained.report.collect()}
    assert rows["accuracy"].support == 30 and not trained.single_class


def test_merged_rows_fit_like_single_rows(spark, leads, trained):
    """Weights stand for repeated rows: a table in which every lead occurs thrice fits alike."""
    labelled = SC.generate_labels(SC.extract_features(leads))
    once, _ = SC.fit(labelled, 8)
    thrice, _ = SC.fit(labelled.unionByName(labelled).unionByName(labelled).repartition(7), 8)
    a, b = ({r.lead_seq: r.probability_good for r in SC.predict_proba(m, leads).collect()} for m in (once, thrice))
    assert a == pytest.approx(b, abs=1e-9)


def test_one_class_and_few_rows(spark, leads):
    few = leads.where("email <> 'N/A' AND phone <> 'N/A' AND website <> 'N/A'").limit(5)
    trained = SC.train(few, 2)
    assert trained.single_class and trained.report is None
    assert all(r.ml_grade == "A" for r in SC.score(few, trained.model).collect())


def test_feedback_changes_the_model(spark, leads, trained):
    bad = leads.select("lead_seq", F.lit(0).alias("label"))
    again = SC.retrain(leads, bad, 2)
    assert again.single_class and SC.grade_summary(SC.score(leads, again.model)).first().grade_d == leads.count()


def test_saved_model_is_loaded(spark, leads, trained):
    path = scratch_path(spark, "model")
    assert SC.load_model(path) is None
    SC.save_model(trained.model, path)
    kept = SC.load_or_train(leads, path)
    assert kept.stages[-1].getNumTrees == 8


def test_names_of_a_stream_equal_batch(spark, leads, tmp_path):
    for i in range(2):
        leads.where(F.col("lead_seq") % 2 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    for _ in range(2):
        stream = spark.readStream.schema(leads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = (
            LI.distinct_names(stream).select("business_name").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    got = [r.business_name for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(r.business_name for r in leads.select("business_name").distinct().collect())


def test_campaign_run_logs_failures_without_using_the_limit(spark, leads, tmp_path):
    path = str(tmp_path / "log")
    scored = SC.rule_scored(leads).withColumn("status", F.when(F.col("lead_seq") % 2 == 0, "failed").otherwise("sent"))
    settings = RU.Settings(query="q", daily_limit=2, sender=SENDER)
    none = spark.createDataFrame([], "lead_seq bigint, response string")
    runs = RU.campaign_run(scored, path, none, settings, batch_id="1", status="status")
    count = {r.disposition: r["count"] for r in runs.groupBy("disposition").count().collect()}
    log = RD.read_log(spark, path)
    assert count["selected"] == 2 and log.where("status = 'sent'").count() == 2
    assert log.where("status = 'failed'").count() == count.get("failed", 0)
    first = {r.to_email for r in log.collect()}
    RU.campaign_run(scored, path, none, settings, batch_id="2", status="status")
    second = {r.to_email for r in RD.read_log(spark, path, skip_batch="1").collect()}
    assert second and not first & second
    assert RU.campaign_run(scored.where("email = 'N/A'"), path, none, settings) is None


def test_full_run(spark, small, tmp_path):
    pages = {
        "google_maps": D.spark_map_pages(spark, small),
        "justdial": D.spark_card_pages(spark, small, D.LISTING_HTML),
        "indiamart": D.spark_card_pages(spark, small, D.SUPPLIER_HTML),
    }
    settings = RU.Settings(query="agency", max_results=10, sender=SENDER, trees=3, lowest_grade="D", daily_limit=5)
    payloads = spark.createDataFrame(
        [(f"s{i}.example.com", '{"data":{"emails":[{"value":"m%d@x.example.com","confidence":9}]}}' % i) for i in range(0, 150)],
        "domain string, payload string",
    )
    none = spark.createDataFrame([], "lead_seq bigint, response string")
    runs = RU.full_run(pages, payloads, none, settings, str(tmp_path))
    assert {r.disposition for r in runs.collect()} >= {"selected"}
    scored = spark.read.csv(str(tmp_path / "scored"), header=True)
    emails = scored.where("email <> 'N/A'").select("email").distinct().count()
    assert 0 < RD.read_log(spark, str(tmp_path / "log")).count() == min(5, emails)
    counts = {r.source: r["count"] for r in scored.groupBy("source").count().collect()}
    assert counts == {"google_maps": 10, "justdial": 10, "indiamart": 10}
    assert RU.full_run({"justdial": pages["justdial"].limit(0)}, None, none, settings, str(tmp_path / "none")) is None
