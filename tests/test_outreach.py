"""One message per address: selection by row, batches that appear whole, outreach over a stream."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadloom.operators import batches as BA
from leadloom.operators import campaign as CA
from leadloom.operators.sinks import append_log
from leadloom.schemas import LEAD, SENT_LOG
from leadloom.sources.readers import read_log
from leadloom.streaming import live as LI

SENDER = {"name": "S", "company": "C", "service": "t"}


# --- selection ---------------------------------------------------------------------------------------------


def walk(rows, logged, limit):
    """rows in order: (email, status, row); the log grows while walking."""
    logged, sent = set(logged), 0
    for email, status, row in rows:
        if sent >= limit:
            yield *row, "beyond_limit"
        elif email in logged:
            yield *row, "skipped"
        else:
            logged.add(email)
            yield *row, "failed" if status == "failed" else "selected"
            sent += status != "failed"


@pytest.mark.parametrize("small", [CA.SMALL_LIMIT, 0])
@pytest.mark.parametrize("outcome", [None, "status"])
def test_repeated_numbers_and_rows(spark, monkeypatch, small, outcome):
    monkeypatch.setattr(CA, "SMALL_LIMIT", small)
    rng = random.Random(11)
    rows = [
        (rng.randrange(9), f"m{rng.randrange(14)}", rng.choice([80.0, 60.1, None]), rng.choice("ab"), rng.choice(["sent", "failed"]) if outcome else "sent")
        for _ in range(60)
    ]
    rows += rows[:20] + [(1, "hot", 99.0, "a", "sent")] * 30
    df = spark.createDataFrame(rows, "lead_seq bigint, email string, ml_score double, name string, status string").repartition(3)
    log = spark.createDataFrame([("m1",), ("m2",), ("M3",)], "to_email string")
    order = sorted((tuple(r.at), r.email, r.status, tuple(r)[:-1]) for r in df.select("*", CA.place(df).alias("at")).collect())
    for limit in (1, 3, 8, 500) if small else (3, 500):
        got = Counter(map(tuple, CA.select_campaign(df, log, limit, outcome).collect()))
        assert got == Counter(walk([r[1:] for r in order], {"m1", "m2", "M3"}, limit))


def test_an_address_under_many_numbers_is_written_once(spark):
    rows = [(k % 10, f"m{k // 10}-{k % 10}", 90.0) for k in range(20)] + [(k, "same", 95.0) for k in range(10)]
    df = spark.createDataFrame(rows, "lead_seq bigint, email string, ml_score double")
    none = spark.createDataFrame([], "to_email string")
    got = [r.email for r in CA.select_campaign(df, none, 6).where("disposition = 'selected'").collect()]
    assert len(got) == len(set(got)) == 6 and "same" in got


# --- batches -----------------------------------------------------------------------------------------------


def entries(spark, *emails):
    return spark.createDataFrame([("t", e, "n", "s", 1.0, "A", "sent") for e in emails], SENT_LOG)


def logged(spark, path, **options):
    return sorted(r.to_email for r in read_log(spark, path, **options).collect())


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "log")
    first = BA.stage(entries(spark, "a", "b"), path, "x")
    assert logged(spark, path) == []
    BA.commit(spark, path, "x", first)
    assert logged(spark, path) == ["a", "b"]
    second = BA.stage(entries(spark, "b", "c"), path, "x")
    assert logged(spark, path) == ["a", "b"]
    BA.commit(spark, path, "x", second)
    assert logged(spark, path) == ["b", "c"] and logged(spark, path, skip_batch="x") == []


def test_names_of_batches_and_files_of_others(spark, tmp_path):
    path = str(tmp_path / "log")
    entries(spark, "plain").write.parquet(path)
    entries(spark, "old").write.parquet(f"{path}/batch_id=old")
    for name in ("a b/c%", "ü+1"):
        append_log(entries(spark, name), path, name)
    assert logged(spark, path) == ["a b/c%", "old", "plain", "ü+1"]
    assert logged(spark, path, skip_batch="a b/c%") == ["old", "plain", "ü+1"]
    append_log(entries(spark, "new"), path, "old")
    assert logged(spark, path) == ["a b/c%", "new", "plain", "ü+1"]
    files = BA.visible_files(spark, path, SENT_LOG, "ü")
    assert len(files) >= 3 and sorted(r.to_email for r in spark.read.schema(SENT_LOG).parquet(*files).collect()) == ["a b/c%", "new", "plain"]


def test_the_newest_batch_and_what_is_dropped(spark, tmp_path):
    path = str(tmp_path / "pool")
    assert BA.read_newest(spark, path, SENT_LOG) is None
    for k in (1, 2, 2, 3):
        BA.write_batch(entries(spark, str(k)), path, k)
        BA.drop_older(spark, path)
    newest = lambda **o: [r.to_email for r in BA.read_newest(spark, path, SENT_LOG, **o).collect()]
    assert newest() == ["3"] and newest(skip=3) == ["2"]
    assert sorted(str(f.relative_to(path).parent.parent) for f in (tmp_path / "pool").glob("*/*/*.parquet")) == sorted(
        [f"batch_id={k}" for k in (2, 3) for f in (tmp_path / "pool" / f"batch_id={k}").glob("*/*.parquet")]
    )
    assert len(list((tmp_path / "pool").glob("batch_id=*/attempt=*"))) == 2


# --- stream ------------------------------------------------------------------------------------------------


class Outreach:
    """Leads that arrive in micro-batches, and what is logged after each."""

    def __init__(self, spark, folder, limit=4):
        self.spark, self.folder, self.limit, self.state = spark, folder, limit, "state"
        self.log = str(folder / "log")

    def send(self, *batches):
        """Batches of leads as (lead_seq, email, score); the addresses written to in each run."""
        for leads in batches:
            rows = [(seq, "clutch", f"{email} {score}", "N/A", "N/A", "N/A", str(score), "N/A", email) for seq, email, score in leads]
            columns = "lead_seq bigint, source string, business_name string, phone string, address string, website string, rating string, category string, email string"
            rows = self.spark.createDataFrame(rows, columns).select(LEAD.fieldNames())
            rows.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        return self.run()

    def run(self):
        before = self.written()
        stream = self.spark.readStream.schema(LEAD).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        score = lambda df: df.withColumns({"ml_score": F.col("rating").cast("double"), "ml_grade": F.lit("A")})
        run = LI.outreach(stream, score, self.log, SENDER, limit=self.limit)
        run = run.option("checkpointLocation", str(self.folder / self.state)).trigger(availableNow=True).start()
        run.awaitTermination()
        after = self.written()
        assert max(Counter(e for emails in after.values() for e in emails).values(), default=1) == 1
        return [after[batch] for batch in sorted(after, key=lambda name: int(name.rpartition("-")[2])) if before.get(batch) != after[batch]]

    def written(self):
        """Addresses of each batch of streams that the log shows."""
        seen = {r.to_email for r in read_log(self.spark, self.log).collect()}
        rows = [(f.split("batch_id=")[1].split("/")[0], f) for f in BA.visible_files(self.spark, self.log, SENT_LOG) if "batch_id=stream" in f]
        found = {batch: [] for batch, _ in rows}
        for batch, file in rows:
            found[batch] = sorted([*found[batch], *[r.to_email for r in self.spark.read.parquet(file).collect()]])
        assert {e for emails in found.values() for e in emails} <= seen
        return found

    def waiting(self):
        return BA.read_newest(self.spark, f"{self.log}-pool", "email string").count()


@pytest.fixture
def outreach(spark, tmp_path):
    return Outreach(spark, tmp_path)


def test_leads_sent_again_and_numbered_alike(outreach):
    """Limit 4 a run: ten leads, ten others with the same numbers, the first ones again, then one of them three times."""
    first, others = [(k, f"a{k}", 50) for k in range(10)], [(k, f"b{k}", 40) for k in range(10)]
    runs = outreach.send(first, others, first, first[:1], first[:1], [(7, "a0", 99)])
    assert [len(emails) for emails in runs] == [4, 4, 4, 4, 4, 0] and outreach.waiting() == 0


def test_a_better_lead_takes_the_place_of_one_that_waits(spark, outreach):
    outreach.limit = 1
    runs = outreach.send([(1, "a", 90), (2, "b", 10), (3, "c", 20)], [(4, "b", 80), (5, "b", 30), (6, "a", 99)], [(7, "b", 95), (8, "c", 5)])
    assert runs == [["a"], ["b"], ["c"]]
    names = {r.to_email: r.business_name for r in read_log(spark, outreach.log).collect()}
    assert names == {"a": "a 90", "b": "b 80", "c": "c 20"}


def test_what_others_log_is_not_written_to(spark, outreach):
    append_log(entries(spark, "a0", "x"), outreach.log, "earlier")
    outreach.limit = 2
    assert outreach.send([(k, f"a{k}", 50 - k) for k in range(8)]) == [["a1", "a2"]]
    append_log(entries(spark, "a4", "late"), outreach.log, "between")  # a4 waits, late has not come yet
    assert outreach.send([(0, "late", 99)], [(0, "x", 99)]) == [["a3", "a5"], ["a6", "a7"]]
    assert outreach.waiting() == 0


def test_a_repeated_batch_replaces_what_it_wrote_and_a_lost_checkpoint_goes_on(outreach):
    (sent,) = outreach.send([(k, f"a{k}", 50 + k % 3) for k in range(10)])
    for done in (outreach.folder / "state" / "commits").glob("*0*"):
        done.unlink()
    assert len(sent) == 4 and outreach.run() == [] and outreach.waiting() == 6
    outreach.state = "other"
    (more,) = outreach.run()
    assert len(more) == 4 and not set(sent) & set(more) and outreach.waiting() == 2


def test_only_folders_of_the_new_addresses_are_read(spark, tmp_path):
    append_log(entries(spark, *[f"m{k}" for k in range(3000)]), str(tmp_path / "log"), "history")
    index = LI._Logged(spark, str(tmp_path / "log"), str(tmp_path / "index"))
    assert index.take_in("own-").count() == 3000 and index.take_in("own-") is None
    left = index.without(spark.createDataFrame([("m7",), ("new",)], "email string"))
    assert [r.email for r in left.collect()] == ["new"]
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)\]", left._jdf.queryExecution().executedPlan().toString())


def test_names_are_forgotten_after_the_horizon(spark, tmp_path):
    columns = "business_name string, at timestamp"
    days = [[("a", 1), ("b", 1), ("a", 1)], [("a", 2), ("c", 2)], [("d", 70)], [("e", 71)], [("a", 72), ("a", 73)], [("f", 140)], [("g", 141)]]
    for rows in days:
        df = spark.createDataFrame([(n, d) for n, d in rows], "n string, d int")
        df = df.select(F.col("n").alias("business_name"), F.timestamp_seconds(F.col("d") * 86400).alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = LI.distinct_names(stream, "at", "30 days").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run = out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = Counter(r.business_name for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter("abcdefg") + Counter("a")
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
