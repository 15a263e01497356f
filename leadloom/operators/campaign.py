"""Choice of leads to write to under a limit, messages and log entries."""

import sys

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.grading import min_grade_rank
from leadloom.functions.text import log_time, parse_message, present, template
from leadloom.operators.leads import first_per, with_email
from leadloom.operators.ranking import nth_smallest
from leadloom.schemas import SENT_LOG
from leadloom.session import shared_dir
from leadloom.sources.readers import read_responses

# Largest limit whose chosen rows are sent to every task.
SMALL_LIMIT = 100_000


def min_grade(scored, lowest=V.DEFAULT_MIN_GRADE):
    """Leads graded ``lowest`` or better; an unknown request means B, unknown grades drop out."""
    rank = min_grade_rank(lowest)
    return scored.where(F.col("ml_grade").isin([g for g, r in V.GRADE_ORDER.items() if r <= rank]))


def suppress(leads, log):
    """Leads whose exact address is not in the log, whatever its status there."""
    logged = log.select(F.col("to_email").alias("email")).distinct()
    return leads.join(logged, "email", "left_anti").select(leads.columns)


def first_per_email(leads):
    """The best lead per address."""
    return first_per(leads, ["email"], F.desc("ml_score"), "lead_seq")


def fresh_leads(eligible, log):
    """Leads that would be written to with no limit: first per address, address not logged.

    Reducing to one lead per address first leaves the anti join without hot keys.
    """
    return suppress(first_per_email(eligible), log)


def campaign_funnel(scored, lowest=V.DEFAULT_MIN_GRADE):
    """All leads, those of the grade or better, and those of them with an address."""
    rank = min_grade_rank(lowest)
    good = F.coalesce(F.col("ml_grade").isin([g for g, r in V.GRADE_ORDER.items() if r <= rank]), F.lit(False))
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("graded"),
        F.count_if(good & present("email")).alias("with_email"),
    )


def select_campaign(eligible, log, limit=V.DAILY_LIMIT, outcome=None, top_list=None):
    """Each eligible lead with its ``disposition``.

    Walking best first, fresh leads are ``selected`` until ``limit`` of them succeeded and
    others are ``skipped``; everything after the last success is ``beyond_limit``.
    ``outcome`` names a column with the send status per lead; a lead with ``failed`` is
    handled but does not use up the limit. Without it every fresh lead succeeds.

    Verdicts belong to rows, not to ``lead_seq``: of the rows of an address exactly one is handled,
    also where rows are repeated or sources number their leads alike. Rows of the same score and
    ``lead_seq`` follow each other by a hash of their values.

    The rows are written to the shared folder once, numbered. Only the place of the last success is
    needed, so no total order is computed: rows before it that were not handled are the skipped ones. It
    is found by a top list up to a limit of ``top_list`` (SMALL_LIMIT by default), and by counting beyond.
    """
    if limit <= 0:
        return eligible.withColumn("disposition", F.lit("beyond_limit"))
    shared_dir(eligible.sparkSession)
    small = limit <= (SMALL_LIMIT if top_list is None else top_list)
    columns = eligible.columns
    rows = eligible.withColumns({"_at": place(eligible), "_row": F.monotonically_increasing_id()}).checkpoint()
    status = F.col(outcome) if outcome else F.lit(None).cast("string")
    # One row per address, combined before the exchange, so that no address is hot in the joins.
    firsts = rows.groupBy("email").agg(F.min(F.struct("_at", "_row", status.alias("status"))).alias("first"))
    fresh = suppress(firsts, log).select("first._at", "first._row", "first.status")
    done = fresh.where(F.col("status").isNull() | (F.col("status") != "failed")) if outcome else fresh
    order = ["_at", "_row"]
    if small:
        chosen = done.orderBy(*order).limit(limit)
        cut = chosen.agg(F.when(F.count("*") == limit, F.max(F.struct(*order)))).scalar()
    else:
        cut = _far_cut(done, limit)
    # Without failures the handled rows are the chosen ones, of which there are at most ``limit``.
    handled = F.broadcast(chosen) if small and not outcome else fresh
    handled = handled.select("_row", F.lit(True).alias("_fresh"))
    beyond = F.coalesce(F.struct(*order) > cut, F.lit(False))
    result = F.when(F.col(outcome) == "failed", "failed").otherwise("selected") if outcome else F.lit("selected")
    return (
        rows.join(handled, "_row", "left")
        .withColumn("disposition", F.when(beyond, "beyond_limit").when(F.col("_fresh"), result).otherwise("skipped"))
        .select(*columns, "disposition")
    )


def _worse():
    """Ascends from the best score down; leads without a score come last."""
    return F.coalesce(-F.col("ml_score").cast("double"), F.lit(sys.float_info.max))


def place(leads):
    """Order of a walk, best first: score, number, and the other values in some fixed order."""
    values = F.xxhash64(*[F.col(name) for name, kind in leads.dtypes if "map<" not in kind])
    return F.struct(_worse().alias("s"), F.col("lead_seq").cast("bigint").alias("q"), values.alias("v"))


def _far_cut(done, limit):
    """Place and row of the ``limit``-th lead without sorting, for limits too large for a top list."""
    kept = done.select("_at.s", "_at.q", "_at.v", F.col("_row").alias("r")).persist()
    try:
        rows, left, cut = kept, limit, {}
        for part in ("s", "q", "v", "r"):
            cut[part] = nth_smallest(rows, part, left)
            if cut[part] is None:
                return F.lit(None).cast("struct<_at:struct<s:double,q:bigint,v:bigint>,_row:bigint>")
            left -= rows.where(F.col(part) < cut[part]).count()
            rows = rows.where(F.col(part) == cut[part])
        at = F.struct(F.lit(cut["s"]).alias("s"), *[F.lit(cut[c]).cast("bigint").alias(c) for c in ("q", "v")])
        return F.struct(at.alias("_at"), F.lit(cut["r"]).cast("bigint").alias("_row"))
    finally:
        kept.unpersist()


def campaign_tally(dispositions):
    """Sent, skipped and failed leads of a run; those after the limit are not counted."""
    return dispositions.agg(
        *[
            F.count_if(F.col("disposition") == d).alias(name)
            for d, name in (("selected", "sent"), ("skipped", "skipped"), ("failed", "failed"))
        ]
    )


def attach_messages(leads, responses, sender):
    """Subject and body per lead: the generated response if usable, else the template."""
    fallback = template("business_name", "address", sender)
    message = parse_message("response", "business_name", fallback)
    return (
        leads.join(read_responses(responses), "lead_seq", "left")
        .withColumn("_message", F.when(F.col("response").isNull(), fallback).otherwise(message))
        .select(*leads.columns, "_message.subject", "_message.body")
    )


def log_entries(messages, at, status):
    """Log rows for handled leads. ``at`` is a timestamp column, ``status`` a text or column."""
    status = F.lit(status) if isinstance(status, str) else status
    return messages.select(
        log_time(at).alias("timestamp"),
        F.col("email").alias("to_email"),
        "business_name",
        "subject",
        "ml_score",
        "ml_grade",
        status.alias("status"),
    ).select(SENT_LOG.fieldNames())


def eligible_leads(scored, lowest=V.DEFAULT_MIN_GRADE):
    return with_email(min_grade(scored, lowest))


def join_log(old, new):
    """Old and new log rows as one table."""
    return old.unionByName(new)
