"""Streaming forms of collection and outreach."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.batches import drop_older, read_files, read_newest, visible_files, write_batch
from leadloom.operators.campaign import attach_messages, eligible_leads, first_per_email, log_entries, place, select_campaign
from leadloom.operators.leads import clean_leads, require_name
from leadloom.operators.sinks import append_log
from leadloom.schemas import SENT_LOG
from leadloom.session import deal_out

# Names that a task remembers at a time.
_NAMES_PER_TASK = 1 << 20
# Parts of the index of logged addresses.
_BUCKETS = 256


def distinct_names(leads, seen_at=None, horizon=None):
    """Cleaned leads of a stream, each name once over the whole life of the stream.

    Rows of one name within a micro-batch are first reduced to one per task, so a
    name that a third of all rows have does not meet in one task. The state holds
    every name ever seen and is unbounded for that reason; keep it in
    RocksDB (see :func:`leadloom.session.get_spark`). Caps per source need a
    global order and are not applied here; use :func:`leadloom.operators.collect.collect`.

    With ``seen_at``, a timestamp column, and ``horizon``, an interval such as ``30 days``, a name is kept
    at least that long after its first row. It is forgotten, and may come again, after the watermark, which
    stays a horizon behind the latest row, is a horizon past it; the state is then bounded by the
    names of twice that time. Rows that come later than the watermark, or without a time, are dropped.
    """

    def first_of_each(batches):
        seen = set()
        for batch in batches:
            names = batch.column("business_name").to_pylist()
            new = [k for k, name in enumerate(names) if not (name in seen or seen.add(name))]
            if len(seen) > _NAMES_PER_TASK:
                seen.clear()
            yield batch.take(new)

    def latest_of_each(batches):
        # A micro-batch lets one row of a name pass; the latest is the last that could be too late.
        for batch in batches:
            latest = {}
            for k, at in enumerate(zip(batch.column("business_name").to_pylist(), batch.column(seen_at).cast("int64").to_pylist())):
                name, time = at
                if time is not None and (name not in latest or time > latest[name][0]):
                    latest[name] = time, k
            yield batch.take(sorted(k for _, k in latest.values()))

    cleaned = clean_leads(require_name(leads))
    if horizon is None:
        return cleaned.mapInArrow(first_of_each, cleaned.schema).dropDuplicates(["business_name"])
    reduced = cleaned.mapInArrow(latest_of_each, cleaned.schema)
    return reduced.withWatermark(seen_at, horizon).dropDuplicatesWithinWatermark(["business_name"])


def _bucket(address):
    return F.pmod(F.xxhash64(address), F.lit(_BUCKETS)).cast("int")


class _Logged:
    """Addresses that other writers have logged, dealt out by a hash into folders.

    Each file of the log is read once in the life of the index. An address stays in it, also when the
    batch that held it is replaced by another.
    """

    def __init__(self, spark, log_path, path):
        self.spark, self.log_path, self.path = spark, log_path, path

    def take_in(self, own):
        """Adds what was logged since the last time by batches whose names do not begin with ``own``.
        Returns those addresses, or None if there is nothing new."""
        indexed = read_files(self.spark, f"{self.path}/files", "file string")
        known = set() if indexed is None else {r.file for r in indexed.collect()}
        files = [f for f in visible_files(self.spark, self.log_path, SENT_LOG, own) if f not in known]
        if not files:
            return None
        new = self.spark.read.schema(SENT_LOG).parquet(*files).select(F.col("to_email").alias("email")).distinct()
        parts = new.withColumn("bucket", _bucket("email")).repartition("bucket").sortWithinPartitions("bucket", "email")
        parts.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/addresses")
        self.spark.createDataFrame([(f,) for f in files], "file string").write.mode("append").parquet(f"{self.path}/files")
        return new

    def without(self, leads):
        """Leads whose address is not in the index. Only the folders of their addresses are read."""
        if read_files(self.spark, f"{self.path}/addresses", "email string") is None:
            return leads
        touched = [r.b for r in leads.select(_bucket("email").alias("b")).distinct().collect()]
        index = self.spark.read.schema("email string, bucket int").parquet(f"{self.path}/addresses")
        return leads.join(index.where(F.col("bucket").isin(touched)), "email", "left_anti").select(leads.columns)


def best_per_address(leads, score, lowest=V.DEFAULT_MIN_GRADE):
    """The eligible leads of a stream by address, as changes: the best lead so far of each address for
    which this micro-batch brought a better one, with ``_first`` true if it brought the first.

    The state has one lead for each address ever seen, so a micro-batch looks up the addresses that it
    brings and no others. Rows of an address are combined in each task before they meet. ``score`` must be
    made of what a stream allows: expressions and fitted models, no sorting.
    """
    # A micro-batch may be one file.
    eligible = eligible_leads(score(clean_leads(deal_out(leads))), lowest)
    lead = F.struct(*eligible.columns).alias("lead")
    timed = eligible.select("email", place(eligible).alias("at"), lead, F.current_timestamp().alias("seen"))
    best = F.min_by(F.struct("lead", "seen"), "at").alias("best")
    state = timed.groupBy("email").agg(best, F.min("seen").alias("since"))
    # All rows of a micro-batch carry its own time, also when it is repeated.
    now = F.current_timestamp()
    return state.where(F.col("best.seen") == now).select("best.lead.*", (F.col("since") == now).alias("_first"))


def outreach(
    leads, score, log_path, sender, limit=V.DAILY_LIMIT, lowest=V.DEFAULT_MIN_GRADE, status="dry_run", pool_path=None
):
    """A stream writer that handles each micro-batch as one run and logs it.

    ``score`` turns a stream of leads into scored leads. No address is written to twice, and no run
    writes to more than ``limit``, also when leads are sent again or numbered alike:

    - :func:`best_per_address` tells from its keyed state which addresses are new, and which have a better lead.
    - The pool (by default next to the log) has the leads that still wait, one per address, none of
      them logged. A run chooses from it, and those it chose leave it, so it does not grow with the history.
      Waiting leads are considered again in each run.
    - What others log is taken into an index by address, each file once; new addresses are looked
      up in the folders of the index that may hold them.

    So a run reads what its micro-batch brings and what waits, not the log or the leads of the past. Pool and
    log get each run as a batch that appears whole; a run that is repeated starts from the pool before it and
    replaces both. A stream that starts anew (without its checkpoint) goes on with the pool, and takes
    the earlier stream's messages for those of others. Start the result with a checkpoint location.
    """
    pool_path = (pool_path or f"{log_path.rstrip('/')}-pool").rstrip("/")

    def handle(batch, batch_id):
        spark = batch.sparkSession
        stream = f"stream-{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        part = f"{stream}-{batch_id}"
        arrived = batch.persist()
        try:
            logged = _Logged(spark, log_path, f"{pool_path}/logged")
            just_logged = logged.take_in(f"{stream}-")
            leads_schema = arrived.drop("_first").schema
            pool = read_newest(spark, pool_path, leads_schema, skip=part)
            pool = spark.createDataFrame([], leads_schema) if pool is None else pool
            if just_logged is not None:
                pool = pool.join(just_logged, "email", "left_anti").select(pool.columns)
            new = logged.without(arrived.where("_first").drop("_first"))
            better = arrived.where("not _first").drop("_first").join(pool.select("email"), "email", "left_semi").select(pool.columns)
            waiting = first_per_email(pool.unionByName(new).unionByName(better))
            nothing = spark.createDataFrame([], "to_email STRING")
            chosen = select_campaign(waiting, nothing, limit)
            write_batch(chosen.where("disposition <> 'selected'").drop("disposition"), pool_path, part)
            responses = spark.createDataFrame([], "lead_seq BIGINT, response STRING")
            messages = attach_messages(chosen.where("disposition = 'selected'"), responses, sender)
            append_log(log_entries(messages, F.current_timestamp(), status), log_path, part)
            drop_older(spark, pool_path)
        finally:
            arrived.unpersist()

    return best_per_address(leads, score, lowest).writeStream.outputMode("update").foreachBatch(handle)
