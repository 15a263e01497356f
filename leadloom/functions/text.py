"""Text expressions (Column in, Column out)."""

from string import Formatter

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.schemas import MESSAGE

# Every character that counts as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for patterns: Unicode white space and the four separators it lacks. Spelling
# out the characters in a pattern instead is several times slower.
SPACE_SET = r"\s\x1c-\x1f"
_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
_MISSING = f"^(?:{'|'.join(V.MISSING_TEXTS)})\\z"
_FENCES = ["```json", "```"]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def once(c, use):
    """``use`` applied to a column that is evaluated a single time, however often it occurs.

    Used where the column is costly, or where repeating it would make generated methods
    too large to be compiled or filters pushed through it too large to plan.
    """
    return F.get(F.transform(F.array(_col(c)), use), F.lit(0))


def strip(c):
    """Remove white space at both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def clean(c):
    """Trim and collapse white space; missing in any form becomes ``N/A``.

    The column occurs once in the result, so filters pushed through it stay small.
    """
    collapsed = F.regexp_replace(strip(c), f"(?U)[{SPACE_SET}]+", " ")
    return F.coalesce(F.regexp_replace(collapsed, _MISSING, V.MISSING), F.lit(V.MISSING))


def present(c):
    """True unless the value is the text ``N/A``; NULL and empty count as present."""
    return ~_col(c).eqNullSafe(F.lit(V.MISSING))


def has_value(c):
    return present(c).cast("int")


def website_domain(c):
    """Scheme removed, cut at the first slash; port, query and case stay."""
    bare = F.replace(F.replace(_col(c), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.substring_index(bare, "/", 1)


def title_case(c):
    """Upper-case every cased letter that follows a character without case."""
    words = F.split(_col(c), f"(?<!{_CASED})(?={_CASED})")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))),
        "",
    )


def seed_url(source, query, location):
    """Search address of one source for a query and a place."""
    query, location = _col(query), _col(location)

    def slug(c, mark):
        return F.replace(c, F.lit(" "), F.lit(mark))

    on_map = F.concat(F.lit(V.MAP_SEARCH_URL), slug(F.concat(query, F.lit(" in "), location), "+"))
    on_listing = F.concat(
        F.lit(V.LISTING_SEARCH_URL), slug(location, "-"), F.lit("/"), title_case(slug(query, "-"))
    )
    on_supplier = F.concat(
        F.lit(V.SUPPLIER_SEARCH_URL), slug(strip(F.concat(query, F.lit(" "), location)), "+")
    )
    return (
        F.when(_col(source) == V.MAP_SITE["source"], on_map)
        .when(_col(source) == V.LISTING_SITE["source"], on_listing)
        .when(_col(source) == V.SUPPLIER_SITE["source"], on_supplier)
    )


def city_guess(address):
    """Text after the last comma, or a stand-in where that is empty."""
    last = strip(F.substring_index(_col(address), ",", -1))
    return F.coalesce(F.nullif(last, F.lit("")), F.lit(V.UNKNOWN_CITY))


def preview(body, n=V.PREVIEW_LENGTH):
    return F.concat(F.substring(_col(body), 1, n), F.lit("..."))


def fill(text, **values):
    """A text with ``{name}`` places as one concatenation of columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def template(name, address, sender):
    """Subject and body used when no generated message is available.

    ``sender`` is a dict with ``name``, ``company``, ``service`` and ``website``.
    """
    name = _col(name)
    return F.struct(
        fill(V.TEMPLATE_SUBJECT, business_name=name).alias("subject"),
        fill(
            V.TEMPLATE_BODY,
            business_name=name,
            city=city_guess(address),
            company=F.lit(sender["company"]),
            service=F.lit(sender["service"]),
            sender=F.lit(sender["name"]),
        ).alias("body"),
    )


def prompt(lead_columns, sender):
    """Request text for a writer. Columns the lead lacks are shown as ``N/A``."""
    wanted = ["business_name", "category", "address", "rating", "website", "ml_score", "ml_grade"]
    shown = {
        c: F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in lead_columns else F.lit(V.MISSING)
        for c in wanted
    }
    return fill(
        V.PROMPT_TEXT,
        **shown,
        sender=F.lit(sender["name"]),
        company=F.lit(sender["company"]),
        service=F.lit(sender["service"]),
        site=F.lit(sender.get("website", "")),
    )


def html_body(body):
    """HTML form of a plain body. Markup characters in the body are escaped first."""
    text = _col(body)
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return fill(V.HTML_MESSAGE, body=text)


def log_time(ts):
    return F.date_format(_col(ts), V.LOG_TIME_FORMAT)


def yes_no(flag):
    return F.when(_col(flag), V.YES_TEXT).otherwise(V.NO_TEXT)


def parse_message(response, name, fallback):
    """Subject and body of a generated response, or ``fallback`` where it is unusable.

    The text is read as the only element of an array, so anything after the closing
    brace makes the whole value unreadable instead of being dropped silently.
    """
    text = _col(response)
    for fence in _FENCES:
        text = F.replace(text, F.lit(fence), F.lit(""))
    read = F.from_json(
        F.concat(F.lit("["), strip(text), F.lit("]")),
        MESSAGE,
        {"mode": "PERMISSIVE", "allowSingleQuotes": "false"},
    )
    only = F.when(F.size(read) == 1, F.get(read, F.lit(0)))
    usable = only.isNotNull() & strip(text).startswith("{")
    return F.when(
        usable,
        F.struct(
            F.coalesce(only["subject"], fill(V.GENERATED_SUBJECT, business_name=_col(name))).alias("subject"),
            F.coalesce(only["body"], F.lit("")).alias("body"),
        ),
    ).otherwise(fallback)
