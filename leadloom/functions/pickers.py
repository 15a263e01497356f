"""Choice among the candidates found for one field of a card."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import _col, clean, strip


def _first(values):
    return F.get(values, F.lit(0))


def first_hit(candidates):
    """First candidate, even if empty; ``N/A`` if there is none."""
    return F.coalesce(strip(_first(_col(candidates))), F.lit(V.MISSING))


def first_raw(candidates):
    """First candidate as read, not trimmed."""
    return F.coalesce(_first(_col(candidates)), F.lit(V.MISSING))


def pick_phone(candidates):
    """First candidate with phone characters left; empty if all were noise."""
    c = _col(candidates)
    kept = F.transform(c, lambda x: strip(F.regexp_replace(x, V.PHONE_NOISE, "")))
    found = _first(F.filter(kept, lambda x: x != ""))
    return F.coalesce(found, F.when(F.size(c) > 0, "").otherwise(V.MISSING))


def pick_address(candidates):
    """First candidate without its label."""
    bare = F.replace(_first(_col(candidates)), F.lit(V.ADDRESS_LABEL), F.lit(""))
    return F.coalesce(strip(bare), F.lit(V.MISSING))


def pick_website(candidates):
    """Link of the first candidate; an empty link is missing."""
    return F.coalesce(F.nullif(_first(_col(candidates)), F.lit("")), F.lit(V.MISSING))


def pick_rating(candidates):
    """First candidate that holds a digit."""
    return F.coalesce(_first(F.filter(_col(candidates), lambda x: x.rlike(r"\p{Nd}"))), F.lit(V.MISSING))


def pick_category(candidates, query):
    """First candidate; the search text stands in where nothing was found."""
    raw = first_raw(candidates)
    return F.when(raw == V.MISSING, _col(query)).otherwise(clean(raw))
