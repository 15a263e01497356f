"""WARC files written from pages, and read back by verifying the chain of record boundaries.

Writing: one record per page. Of pages with equal payloads (by SHA-1) the one with the smallest
id is a response, the others are revisits that refer to it and carry no payload.

Reading: files are read in splits of any place, cut at every occurrence of the version line. Each
cut is a candidate record start; its header gives the offset at which the next record must
start. The version line may also occur inside a payload, so a candidate proves nothing. True records
are those that the chain of successors reaches from the start of the file. Where each candidate
of a split is the next one's successor they form a run, found with windows over the split; runs
leave few links per file, and those are followed by pointer jumping, which doubles the distance
in each round. Payloads that contain version lines are put together from their pieces.

Defined cases: a NULL html is an empty payload. A NULL page id is kept as NULL and comes after all
others when the smallest is sought. Repeated rows of the smallest id are the same page, and all are
responses. Line breaks in a URL are dropped. Other columns are not read. Bytes that no chain
from a file's start reaches are not records; a last record that is cut short is left out.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.tables import stored

VERSION = "WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAP = 4  # the two line breaks after a header, and after a block


def base32_sha1(payload):
    """The SHA-1 of a column in upper-case base 32: forty bits give eight characters."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def marked(pages: DataFrame, min_bytes=0) -> DataFrame:
    """``(page_id, url, payload, bytes, digest, refers_to)``; refers_to is NULL for responses."""
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    sized = plain.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1("payload"))
    # Only payloads that occur again need to be looked up; the table is stored, so that the
    # planner broadcasts it if it is small and otherwise shuffles, splitting hot payloads.
    repeated = (
        sized.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    found = sized.join(stored(repeated, "repeated-payloads"), "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", "bytes", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes=0, date=DATE):
    """One WARC file per task under ``folder``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.translate("url", "\r\n", "")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), text("bytes"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(text("bytes"))),
    ]
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    # The text writer adds the last line feed.
    record = F.concat(F.lit(VERSION), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"))
    marked(pages, min_bytes).select(record.alias("value")).write.option("lineSep", "\n").text(folder)


def field(name):
    """The value of a header line."""
    return F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def block(raw):
    """The block of a record whose bytes after the version line are ``raw``."""
    return F.expr(f"substring({raw}, octet_length(header) + {GAP + 1}, cast(length as int))")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch between two version lines, as it is read."""
    return spark.read.option("lineSep", VERSION).text(folder).withColumn("raw", F.col("value").cast("binary"))


def cuts(spark: SparkSession, folder: str, of) -> DataFrame:
    """For every stretch: file, split, place in the split, bytes, their SHA-1, header, length of
    its block (NULL without one) and ``of`` its block, if it holds all of it."""
    length = F.regexp_extract("header", r"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    found = chunks(spark, folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "raw",
        F.sha1("raw").alias("content"),
        F.substring_index("value", "\r\n\r\n", 1).alias("header"),
        F.octet_length("raw").cast("long").alias("size"),
    )
    head = F.octet_length("header") + GAP
    named = found.withColumn("length", F.when((length != "") & (head <= F.col("size")), length).cast("long"))
    whole = F.col("size") >= head + F.col("length")
    valued = named.withColumn("whole", whole).withColumn("value", F.when(F.col("whole"), of(block("raw"))))
    return stored(valued.drop("raw"), "warc-cuts")


def candidates(cut: DataFrame) -> DataFrame:
    """``(file, split, row, start, next)``: where each candidate starts and where its successor must."""
    lead = len(VERSION)
    here = Window.partitionBy("file", "split").orderBy("row")
    inside = F.coalesce(F.sum(F.col("size") + lead).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    narrow = cut.select("file", "split", "row", "size", "length", F.octet_length("header").alias("head"))
    # One row per split; a file has few.
    splits = narrow.groupBy("file", "split").agg(F.sum(F.col("size") + lead).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    start = F.col("base") + F.col("inside") - lead
    placed = narrow.withColumn("inside", inside).join(bases, ["file", "split"])
    return placed.select(
        "file", "split", "row", start.alias("start"), (start + lead + F.col("head") + 2 * GAP + F.col("length")).alias("next")
    ).where("start >= 0")


def reached(nodes: DataFrame) -> DataFrame:
    """The nodes ``(file, at, next)`` that lead on from at = 0, by pointer jumping: ``(file, at)``."""
    jump = nodes.where("next is not null")
    reach = nodes.where("at = 0").select("file", "at").distinct()
    while not jump.isEmpty():
        ahead = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reach = stored(reach.unionAll(ahead).distinct(), "warc-reach")
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jump = stored(jump.join(further, ["file", "next"]).select("file", "at", F.col("beyond").alias("next")), "warc-jump")
    return reach


def chain(found: DataFrame) -> DataFrame:
    """The candidates that are records: those the chain reaches from the start of their file."""
    here = Window.partitionBy("file", "split").orderBy("row")
    broken = ~F.lag("next").over(here).eqNullSafe(F.col("start"))
    rows = stored(
        found.withColumn("broken", broken.cast("int")).withColumn("run", F.sum("broken").over(here)).drop("broken"), "warc-candidates"
    )
    runs = rows.groupBy("file", "split", "run").agg(F.max_by("next", "row").alias("leave"))
    entries = runs.select("file", F.col("leave").alias("start")).where("start is not null")
    entries = entries.unionAll(rows.select("file", F.lit(0).cast("long").alias("start"))).distinct()
    nodes = stored(
        entries.join(rows.select("file", "start", "split", "run"), ["file", "start"])
        .join(runs, ["file", "split", "run"])
        .select("file", F.col("start").alias("at"), "split", "run", F.col("leave").alias("next")),
        "warc-nodes",
    )
    entered = (
        nodes.join(reached(nodes.select("file", "at", "next")), ["file", "at"]).groupBy("file", "split", "run").agg(F.min("at").alias("entry"))
    )
    joined = rows.join(entered, ["file", "split", "run"], "left")
    return stored(joined.withColumn("on_chain", F.coalesce(F.col("start") >= F.col("entry"), F.lit(False))).drop("entry"), "warc-chain")


def records(spark: SparkSession, folder: str, of=lambda payload: payload) -> DataFrame:
    """``(file, start, header, value)`` of all records under ``folder``; the value is ``of`` the payload.

    What is made of a payload is made where it is read, so that only that is moved.
    """
    cut = cuts(spark, folder, of)
    linked = chain(candidates(cut))
    keys = ["file", "split", "row"]
    own = cut.join(linked.where("on_chain").select(*keys, "start"), keys)
    single = own.where("whole").select("file", "start", "header", "value")
    split_up = own.where(~F.col("whole")).select("file", "start", "length", "header")
    if split_up.isEmpty():
        return single
    # Each candidate belongs to the last record at or before it, perhaps in an earlier split.
    mine = F.when(F.col("on_chain"), F.col("start"))
    inside = Window.partitionBy("file", "split").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    last = linked.groupBy("file", "split").agg(F.max(mine).alias("last"))
    last = last.select("file", "split", F.max("last").over(earlier).alias("before"))
    owned = linked.withColumn("owner", F.max(mine).over(inside)).join(last, ["file", "split"])
    owned = owned.select(*keys, F.col("start").alias("at"), F.coalesce("owner", "before").alias("start"))
    parts = stored(owned.join(split_up.select("file", "start"), ["file", "start"]).join(cut.select(*keys, "content"), keys), "warc-parts")
    # The pieces' bytes are read again. They are found by their content, since another reading
    # may split files elsewhere.
    sought = stored(parts.select("content").distinct(), "warc-contents")
    bytes_of = chunks(spark, folder).select(F.sha1("raw").alias("content"), "raw").join(sought, "content", "left_semi")
    pieces = parts.join(bytes_of.dropDuplicates(["content"]), "content").groupBy("file", "start")
    pieces = pieces.agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("pieces"))
    version = F.lit(VERSION).cast("binary")
    rest = F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0)))
    text = F.aggregate(rest, F.get("pieces", F.lit(0))["raw"], lambda a, p: F.concat(a, version, p["raw"]))
    joined = split_up.join(pieces, ["file", "start"]).withColumn("raw", text)
    complete = joined.where(F.octet_length("raw") >= F.octet_length("header") + GAP + F.col("length"))
    return single.unionAll(complete.select("file", "start", "header", of(block("raw")).alias("value")))


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the records of pages."""
    sized = lambda payload: F.struct(F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"))
    found = records(spark, folder, sized)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    named = found.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        number(field("X-Payload-Length")).alias("named_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("named_digest"),
        "value.bytes",
        "value.digest",
    )
    revisit = F.col("record_type") == "revisit"
    return named.select(
        "page_id",
        F.when(revisit, F.col("named_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("named_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
