"""Cards of harvested pages: one pass over the pages, candidates per field out.

Python only finds elements. What to make of the candidates is decided by the
expressions in :mod:`leadloom.functions.pickers`.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import clean, website_domain
from leadloom.schemas import CARD, CARD_FIELDS
from leadloom.sources.markup import Page, compile_selector
from leadloom.session import ship


def _compiled(site):
    fields = {
        f: [compile_selector(s) for s in site["fields"].get(f, [])] for f in CARD_FIELDS
    }
    take = {f: site.get("take", {}).get(f, ["text"]) for f in CARD_FIELDS}
    return [compile_selector(s) for s in site.get("cards", [])], fields, take


def _card_ranges(page, cards):
    """Element ranges to search: inside each card, or the whole page without card rules."""
    if not cards:
        return [range(len(page.tags))]
    return [
        range(e + 1, page.ends[e])
        for e in range(len(page.tags))
        if any(page.matches(e, steps) for steps in cards)
    ]


def _candidates(page, inside, selectors, order):
    """Per selector, what the first matching element holds."""
    found = []
    for steps in selectors:
        hit = next((e for e in inside if page.matches(e, steps)), None)
        if hit is not None:
            found.append(page.read(hit, order))
    return found


def _may_hold(site, key):
    """Pages that can hold an element of ``site[key]``.

    Every selector names a class, id or link text that must occur literally in the page,
    unless the page writes it with character references; such pages are kept as well.
    """
    marks = [re.findall(r"\.([\w-]+)|[\^*]?='([^']*)'", s) for s in site.get(key, [])]
    if not marks or not all(marks):
        return F.lit(True)
    needed = [a or b for mark in marks for a, b in mark[-1:]]
    test = F.col("html").rlike(r"=\s*(\"[^\"]*|'[^']*|[^\s\"'>]*)&")
    for text in needed:
        test = test | F.contains(F.col("html"), F.lit(text))
    return test


def extract_cards(pages, site, parts=None):
    """Candidates ``(page_id, card_pos, names[], phones[], ...)`` of every card, in page order.

    A card matching several selectors counts once; a card inside a card is a card of its
    own. A site without card rules has one record per page. Parsing is the costly part, at
    about a megabyte of HTML per second and core: ``parts`` spreads the pages over that
    many tasks where the partitions of the input are too large for that.
    """
    ship(pages.sparkSession)
    cards, fields, take = _compiled(site)

    def run(batches):
        for batch in batches:
            page_ids, places = [], []
            values, ends = [[] for _ in CARD_FIELDS], [[0] for _ in CARD_FIELDS]
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                page = Page(html or "")
                for pos, inside in enumerate(_card_ranges(page, cards)):
                    page_ids.append(page_id)
                    places.append(pos)
                    for f, have, end in zip(CARD_FIELDS, values, ends):
                        have += _candidates(page, inside, fields[f], take[f])
                        end.append(len(have))
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.string())) for v, e in zip(values, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(page_ids, pa.int64()), pa.array(places, pa.int32()), *lists], CARD.fieldNames())

    wanted = pages.where(_may_hold(site, "cards")).select("page_id", "html")
    wanted = wanted.repartition(parts) if parts else wanted
    return wanted.mapInArrow(run, CARD)


def listing_links(pages, site):
    """Links ``(page_id, link_pos, href)`` to detail pages; a later rule only if earlier ones find none."""
    ship(pages.sparkSession)
    rules = [compile_selector(s) for s in site["links"]]

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                page = Page(html or "")
                everything = range(len(page.tags))
                hits = next((h for h in ([e for e in everything if page.matches(e, r)] for r in rules) if h), [])
                rows += [(page_id, i, page.attrs[e].get("href", "")) for i, e in enumerate(hits)]
            kinds = {"page_id": pa.int64(), "link_pos": pa.int32(), "href": pa.string()}
            yield pa.RecordBatch.from_pylist([dict(zip(kinds, row)) for row in rows], pa.schema(list(kinds.items())))

    return (
        pages.where(_may_hold(site, "links"))
        .select("page_id", "html")
        .mapInArrow(run, "page_id BIGINT, link_pos INT, href STRING")
    )


def page_fields(pages):
    """Title, first heading, link count, first link and web domain of any page."""
    links = F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))

    def inner(tag):
        return clean(F.regexp_extract("html", f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))

    return pages.select(
        "page_id",
        website_domain("url").alias("domain"),
        inner("title").alias("title"),
        inner("h1").alias("name"),
        F.size(links).alias("links"),
        F.coalesce(F.nullif(F.get(links, F.lit(0)), F.lit("")), F.lit(V.MISSING)).alias("website"),
    )
