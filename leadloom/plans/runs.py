"""The four steps as whole runs: collect, enrich, score, outreach."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.campaign import attach_messages, eligible_leads, log_entries, select_campaign
from leadloom.operators.collect import collect
from leadloom.operators.contacts import enrich
from leadloom.operators.leads import clean_leads, require_name, to_leads, union_sources
from leadloom.operators.ranking import rank_leads
from leadloom.operators.scoring import save_model, score, train
from leadloom.operators.sinks import append_log, nonempty, write_leads, write_scored
from leadloom.session import shared_dir
from leadloom.sources.cards import extract_cards
from leadloom.sources.readers import read_contacts, read_log

SITES = [V.MAP_SITE, V.LISTING_SITE, V.SUPPLIER_SITE]


@dataclass(frozen=True)
class Settings:
    """What to look for, which sources to use, who writes and under which limits."""

    query: str
    max_results: int = V.MAX_RESULTS
    sources: tuple = tuple(s["source"] for s in SITES)
    sender: dict = field(default_factory=dict)
    lowest_grade: str = V.DEFAULT_MIN_GRADE
    daily_limit: int = V.DAILY_LIMIT
    trees: int = V.TREES


def collect_from_pages(pages_by_source, settings):
    """Leads from harvested pages, ``{source: pages}``, in site order with the cap applied."""
    sites = [s for s in SITES if s["source"] in settings.sources and s["source"] in pages_by_source]
    found = [
        to_leads(extract_cards(pages_by_source[s["source"]], s), s, settings.query) for s in sites
    ]
    if not found:
        raise ValueError("no pages for any enabled source")
    # Parsing is the costly part: its result is written out once, and what follows reads that.
    shared_dir(found[0].sparkSession)
    leads = clean_leads(require_name(union_sources(*found))).checkpoint()
    return collect(leads, [s["source"] for s in sites], settings.max_results)


def collect_and_export(pages_by_source, settings, path, payloads=None):
    """Collect, add addresses if lookups are given, and write the lead file."""
    leads = collect_from_pages(pages_by_source, settings)
    if payloads is not None:
        leads = enrich(leads, read_contacts(payloads))
    return write_leads(leads, path)


def score_run(leads, settings, model_path=None, scored_path=None):
    """Train on the leads, keep the model, score them and write the result best first.

    Scores are written out once: sorting, export and outreach all read them, and the
    model is the costly part.
    """
    shared_dir(leads.sparkSession)
    trained = train(leads, settings.trees)
    if model_path:
        save_model(trained.model, model_path)
    scored = score(leads, trained.model, ordered=False).checkpoint()
    if scored_path:
        write_scored(rank_leads(scored), scored_path)
    return scored, trained


def campaign_run(scored, log_path, responses, settings, at=None, batch_id=None, status="dry_run"):
    """Choose, compose and log one run. Returns the dispositions, or None if no lead has an address.

    ``status`` is the text logged for every chosen lead, or the name of a column holding
    the outcome of each; failed leads are logged but leave the limit untouched.
    """
    spark = scored.sparkSession
    shared_dir(spark)
    eligible = eligible_leads(scored, settings.lowest_grade)
    if not nonempty(eligible):
        return None
    by_column = status in scored.columns
    log = read_log(spark, log_path, skip_batch=batch_id)
    # The dispositions depend on the log as it was, so they are fixed before it grows.
    runs = select_campaign(eligible, log, settings.daily_limit, status if by_column else None).checkpoint()
    handled = runs.where(F.col("disposition").isin("selected", "failed"))
    messages = attach_messages(handled, responses, settings.sender)
    at = F.current_timestamp() if at is None else at
    append_log(log_entries(messages, at, F.col(status) if by_column else status), log_path, batch_id)
    return runs


def full_run(pages_by_source, payloads, responses, settings, out):
    """All four steps; files go under the folder ``out``. None if nothing was collected."""
    leads = collect_from_pages(pages_by_source, settings)
    if payloads is not None:
        leads = enrich(leads, read_contacts(payloads))
    leads = leads.checkpoint()
    if not nonempty(leads):
        return None
    scored, _ = score_run(leads, settings, f"{out}/model", f"{out}/scored")
    return campaign_run(scored, f"{out}/log", responses, settings)
