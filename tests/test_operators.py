"""Order-dependent operators against plain loops on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import campaign as CA
from leadloom.operators import collect as CO
from leadloom.operators import contacts as CN
from leadloom.operators import leads as LE
from leadloom.operators import ranking as RA
from leadloom.operators import report as RE
from leadloom.operators import scoring as SC
from leadloom.schemas import LEAD, SENT_LOG
from leadloom.sources import readers as RD

LEAD_COLUMNS = LEAD.fieldNames()


def lead_table(spark, rows):
    """Leads from dicts; fields left out read N/A."""
    data = [tuple(r.get(c, i if c == "lead_seq" else "N/A") for c in LEAD_COLUMNS) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LEAD)


def collect_by_hand(rows, order, cap):
    taken, names = [], set()
    for source in order:
        count = 0
        for seq, (s, name) in enumerate(rows):
            if count >= cap:
                break
            if s == source and name not in names:
                names.add(name)
                taken.append(seq)
                count += 1
    return sorted(taken)


@pytest.mark.parametrize("read_out", [RA._READ_OUT, 2])
def test_collect_equals_loop(spark, monkeypatch, read_out):
    monkeypatch.setattr(RA, "_READ_OUT", read_out)
    rng = random.Random(7)
    for cap in (1, 3, 5, 50):
        rows = [(rng.choice("abcd"), rng.choice(["N/A", *map(str, range(12))])) for _ in range(60)]
        df = lead_table(spark, [{"source": s, "business_name": n} for s, n in rows])
        got = CO.collect(df.repartition(3), ["c", "a", "b", "none"], cap)
        assert got.columns == LEAD_COLUMNS
        assert sorted(r.lead_seq for r in got.collect()) == collect_by_hand(rows, ["c", "a", "b", "none"], cap)


def test_name_cut_by_a_cap_goes_to_the_next_source(spark):
    df = lead_table(spark, [{"source": s, "business_name": n} for s, n in ["a1", "a2", "b2", "b1", "b3"]])
    assert sorted(r.lead_seq for r in CO.collect(df, ["a", "b"], 1).collect()) == [0, 2]
    assert CO.collect(df, ["a", "b"], 0).count() == 0
    assert CO.collect(df, [], 5).count() == 0


def test_no_source_is_sorted_at_any_cap(spark):
    df = lead_table(spark, [{"source": s, "business_name": str(k)} for k, s in enumerate("abcabc")])
    for cap in (300, 400, 5000, 50_000):
        assert "Window" not in CO.collect(df, ["a", "b", "c"], cap)._jdf.queryExecution().executedPlan().toString()


def test_a_further_source_costs_one_job_and_none_where_its_cap_cannot_cut(spark):
    sources = "abcdefgh"
    df = lead_table(spark, [{"source": s, "business_name": f"{s}{k % 6}"} for s in sources for k in range(12)]).repartition(3)

    def jobs(order, cap):
        group = f"collect-{len(order)}-{cap}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            CO.collect(df, order, cap)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(sources, 4) - jobs(sources[:2], 4) <= 2 * 6
    assert jobs(sources, 7) == jobs(sources[:2], 7)


@pytest.mark.parametrize("read_out", [RA._READ_OUT, 2])
def test_collect_with_alike_numbers(spark, monkeypatch, read_out):
    """Sources that number their leads alike do not take each other's."""
    monkeypatch.setattr(RA, "_READ_OUT", read_out)
    rows = [(s, k, f"n{(k * 5 + len(s)) % 9}") for s in ("x", "yy", "zzz") for k in range(9)]
    df = spark.createDataFrame(rows, "source string, lead_seq bigint, business_name string").repartition(3)
    for cap in (1, 4, 6):
        taken, names = [], set()
        for source in ("yy", "x", "zzz"):
            new = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == source and r[2] not in names][:cap]
            names |= {r[2] for r in new}
            taken += new
        assert sorted(map(tuple, CO.collect(df, ["yy", "x", "zzz"], cap).collect())) == sorted(taken)


def campaign_by_hand(rows, logged, limit):
    """rows: (seq, email, score, status); the log grows while walking."""
    logged, sent, result = set(logged), 0, {}
    for seq, email, _, status in sorted(rows, key=lambda r: (-r[2], r[0])):
        if sent >= limit:
            result[seq] = "beyond_limit"
        elif email in logged:
            result[seq] = "skipped"
        else:
            logged.add(email)
            result[seq] = "failed" if status == "failed" else "selected"
            sent += status != "failed"
    return result


@pytest.mark.parametrize("small", [CA.SMALL_LIMIT, 0])
def test_campaign_on_fine_and_missing_scores(spark, monkeypatch, small):
    monkeypatch.setattr(CA, "SMALL_LIMIT", small)
    scores = [50.001, 50.003, None, 50.002, 50.0021, None, 49.9]
    df = spark.createDataFrame([(i, f"m{i}", s) for i, s in enumerate(scores)], "lead_seq bigint, email string, ml_score double")
    log = spark.createDataFrame([], "to_email string")
    for limit, want in ((2, {1, 4}), (5, {0, 1, 3, 4, 6}), (6, {0, 1, 2, 3, 4, 6}), (9, set(range(7)))):
        got = CA.select_campaign(df, log, limit).where("disposition = 'selected'").collect()
        assert {r.lead_seq for r in got} == want


@pytest.mark.parametrize("small", [CA.SMALL_LIMIT, 0])
@pytest.mark.parametrize("outcome", [None, "status"])
def test_campaign_equals_loop(spark, monkeypatch, small, outcome):
    monkeypatch.setattr(CA, "SMALL_LIMIT", small)
    rng = random.Random(3)
    for limit in (0, 1, 4, 9, 500):
        rows = [
            (i, f"m{rng.randint(0, 14)}", rng.choice([80.0, 75.5, 60.1, 55.0]), rng.choice(["sent", "failed"]) if outcome else "sent")
            for i in range(50)
        ]
        logged = ["m1", "m2", "M3"]
        df = spark.createDataFrame(rows, "lead_seq bigint, email string, ml_score double, status string").repartition(3)
        log = spark.createDataFrame([(m,) for m in logged], "to_email string")
        got = CA.select_campaign(df, log, limit, outcome)
        want = campaign_by_hand(rows, logged, limit)
        assert {r.lead_seq: r.disposition for r in got.collect()} == want
        tally = CA.campaign_tally(got).first()
        count = list(want.values()).count
        assert tuple(tally) == (count("selected"), count("skipped"), count("failed"))


def test_rank_is_dense_and_ordered(spark):
    rng = random.Random(5)
    several = [None, 1.5, None, 7.25, -3.0]
    for scores in ([50.0] * 200, [float(rng.randint(0, 6)) for _ in range(200)], [rng.random() for _ in range(200)], several, [1.5], []):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "lead_seq bigint, ml_score double")
        got = {r.lead_seq: r["rank"] for r in RA.with_rank(df.repartition(3)).collect()}
        order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
        assert got == {seq: place for place, seq in enumerate(order)}


def test_nth_smallest(spark, monkeypatch):
    monkeypatch.setattr(RA, "_FAN", 16)
    monkeypatch.setattr(RA, "_READ_OUT", 5)
    rng = random.Random(9)
    for values in ([rng.randint(-(10**15), 10**15) for _ in range(80)], [3] * 40 + [9], [rng.randint(0, 9) for _ in range(60)],
                   [rng.randint(-(2**63), 2**63 - 1) for _ in range(80)] + [-(2**63), 2**63 - 1], [2**62 + k // 2 for k in range(60)],
                   [rng.random() for _ in range(70)] + [1.79e308, -5.0, 0.1 + 0.2], [1.25] * 30 + [1.26] * 30):
        kind = "double" if isinstance(values[0], float) else "bigint"
        df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
        for n in (1, 2, 17, len(values) - 1, len(values)):
            assert RA.nth_smallest(df, "v", n) == sorted(values)[n - 1]
        assert RA.nth_smallest(df, "v", len(values) + 1) is None
        assert RA.nth_smallest(df, "v", 0) is None


def test_split_is_exact_and_repeatable(spark):
    for n in (1, 20, 23, 100):
        df = spark.range(n).withColumnRenamed("id", "lead_seq")
        rest, test = SC.split(df)
        again = SC.split(df.repartition(5))[1]
        one, two = ({r.lead_seq for r in d.collect()} for d in (test, again))
        assert one == two and len(one) == -(-n // 5) and rest.count() == n - len(one)


def test_dedupe_keeps_the_first_whatever_the_layout(spark):
    rng = random.Random(2)
    rows = [{"business_name": rng.choice(["N/A", "a", "b"]), "phone": rng.choice(["N/A", "1"])} for _ in range(40)]
    df, first = lead_table(spark, rows), {}
    for i, r in enumerate(rows):
        first.setdefault((r["business_name"], r["phone"]), i)
    for parts in (1, 4):
        assert sorted(r.lead_seq for r in LE.dedupe_leads(df.repartition(parts)).collect()) == sorted(first.values())
    assert tuple(LE.dedupe_stats(df).first()) == (40, len(first), 40 - len(first))
    assert tuple(LE.dedupe_stats(df.limit(0)).first()) == (0, 0, 0)


def test_enrich(spark):
    df = lead_table(spark, [
        {"website": "https://a.com/x", "email": "old"}, {"website": "http://none.com", "email": "old"},
        {"website": "N/A", "email": "old"}, {"website": "b.com"}, {"website": "/5", "email": "old"},
        {"website": "c.com", "email": "old"},
    ])
    payloads = spark.createDataFrame([
        ("a.com", '{"data":{"emails":[{"value":"x","confidence":50},{"value":"y","confidence":90.5},{"value":"z","confidence":90.5}]}}'),
        ("b.com", '{"data":{"emails":[{"confidence":5},{"value":"w"}]}}'),
        ("c.com", '{"data":{"emails":[]}}'), ("c.com", "broken"), ("c.com", '{"errors":[1]}'),
    ], "domain string, payload string")
    got = CN.enrich(df, RD.read_contacts(payloads)).orderBy("lead_seq")
    assert got.columns == LEAD_COLUMNS
    assert [r.email for r in got.collect()] == ["y", "old", "old", "N/A", "old", "old"]


def test_feedback_low_verdict_wins(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(4)], "lead_seq bigint, label int")
    fb = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (99, 1)], "lead_seq bigint, label int")
    assert [r.label for r in SC.apply_feedback(df, fb).orderBy("lead_seq").collect()] == [1, 0, 0, 1]


def test_report_has_both_classes_without_cases(spark):
    df = spark.createDataFrame([(1, 1.0)] * 3, "label int, prediction double")
    rows = {r["name"]: r for r in SC.classification_report(df).collect()}
    assert rows["Low Quality"].support == 0 and rows["Low Quality"].f1 == 0.0
    assert rows["Good Lead"].f1 == 1.0 and rows["accuracy"].precision == 1.0 and rows["macro avg"].f1 == 0.5


def test_widths_of_an_empty_table(spark):
    rows = {r.name: r.width for r in RE.width_profile(lead_table(spark, [])).collect()}
    assert rows["source"] == 12 and rows["business_name"] == 17 and list(rows) == list(RE.V.EXPORT_ORDER)


def test_min_grade_and_funnel(spark):
    df = spark.createDataFrame([(g, "x") for g in ("A", "B", "C", "D", "E", None)], "ml_grade string, email string")
    assert [CA.min_grade(df, g).count() for g in ("A", "B", "C", "D", "?")] == [1, 2, 3, 4, 2]
    assert tuple(CA.campaign_funnel(df).first()) == (6, 2, 2)


def test_messages_fall_back(spark):
    sender = {"name": "S", "company": "C", "service": "t"}
    df = spark.createDataFrame([(1, "A", "x, y"), (2, "B", "N/A"), (3, "C", "")], "lead_seq bigint, business_name string, address string")
    resp = spark.createDataFrame([(1, '{"subject":"s","body":"b"}'), (2, "no")], "lead_seq bigint, response string")
    rows = CA.attach_messages(df, resp, sender).orderBy("lead_seq").collect()
    assert [r.subject for r in rows] == ["s", "Quick idea for B", "Quick idea for C"]
    entries = CA.log_entries(
        CA.attach_messages(df, resp, sender).withColumns({"email": F.lit("e"), "ml_score": F.lit(1.0), "ml_grade": F.lit("A")}),
        F.lit("2026-01-02 03:04:05").cast("timestamp"), "sent")
    assert entries.columns == SENT_LOG.fieldNames() and entries.first().timestamp == "2026-01-02 03:04:05"


def test_hot_groups_are_reduced_before_the_shuffle(spark):
    """Ranks per key keep one row per task before the exchange; counts are combined there."""
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    df = lead_table(spark, [{"business_name": "N/A"}] * 3)
    for frame in (LE.dedupe_leads(df), CO.first_occurrences(df), CA.first_per_email(df.withColumn("ml_score", F.lit(1.0)))):
        assert "row_number(), 1, Partial" in plan(frame)
    assert "partial_max_by" in plan(CN.best_contact(RD.read_contacts(spark.createDataFrame([], "domain string, payload string"))))


def test_page_numbers_that_do_not_fit_are_refused(spark):
    cards = spark.createDataFrame([((1 << 44) + 1, 0)], "page_id bigint, card_pos int")
    names = [F.array().cast("array<string>").alias(c) for c in ("names", "phones", "addresses", "websites", "ratings", "categories")]
    with pytest.raises(Exception, match="no lead_seq"):
        LE.to_leads(cards.select("*", *names), RE.V.SUPPLIER_SITE, "q").collect()


def test_csv_keys_do_not_depend_on_splits(spark, tmp_path):
    for k in range(3):
        lines = ["business_name,phone"] + [f"name {k} {i},{i}" for i in range(700)]
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append({r.lead_seq: r.business_name for r in RD.read_leads_csv(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == {700 * k + i: f"name {k} {i}" for k in range(3) for i in range(700)}


def test_a_plain_log_stays_readable_when_batches_are_added(spark, tmp_path):
    from leadloom.operators.sinks import append_log

    row = lambda m: ("t", m, "n", "s", 1.0, "A", "sent")
    path = str(tmp_path / "log")
    spark.createDataFrame([row(f"old{i}") for i in range(15)], SENT_LOG).write.parquet(path)
    append_log(spark.createDataFrame([row("new")], SENT_LOG), path, "b 1")
    assert RD.read_log(spark, path).count() == 16
    assert {r.to_email for r in RD.read_log(spark, path, skip_batch="b 1").collect()} == {f"old{i}" for i in range(15)}
    assert RD.read_log(spark, path, skip_batch="none").count() == 16
    assert RD.read_log(spark, str(tmp_path / "absent")).count() == 0


def test_stream_goes_on_with_what_a_limit_left_over(spark, tmp_path):
    from leadloom.streaming.live import distinct_names, outreach

    leads = lead_table(spark, [{"business_name": f"n{i}", "email": f"m{i}", "source": "clutch"} for i in range(10)])
    folder, log, sender = str(tmp_path / "in"), str(tmp_path / "log"), {"name": "S", "company": "C", "service": "t"}
    leads.coalesce(1).write.parquet(folder)
    score = lambda df: df.withColumns({"ml_score": F.lit(90.0), "ml_grade": F.lit("A")})
    for k, sent in enumerate((4, 8, 10)):
        if k:  # another lead of a known address sets off the next batch
            leads.limit(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(leads.schema).parquet(folder)
        outreach(stream, score, log, sender, limit=4).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert RD.read_log(spark, log).select("to_email").distinct().count() == RD.read_log(spark, log).count() == sent
    stream = spark.readStream.schema(leads.schema).parquet(folder)
    run = distinct_names(stream).writeStream.format("parquet").option("path", str(tmp_path / "names"))
    run.option("checkpointLocation", str(tmp_path / "names-state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "names")).count() == 10
