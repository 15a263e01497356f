"""Lead features and the rule score (Column in, Column out)."""

from functools import reduce

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import SPACE_SET, _col, has_value, once, strip

_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def _shown(c):
    """The text a value is shown as: NULL reads ``None``."""
    return F.coalesce(_col(c), F.lit("None"))


def zero_fill(c):
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(_col(c), F.lit(0.0)), F.lit(0.0))


def rating_score(c):
    """Rating over five; comma or point decimals; anything unreadable or infinite is 0."""
    text = strip(F.replace(_col(c), F.lit(","), F.lit(".")))
    digits = F.replace(F.regexp_extract(text, _NUMBER, 0), F.lit("_"), F.lit(""))
    # An empty text is no number either, but finding that out by an error is slow.
    number = F.nullif(digits, F.lit("")).try_cast("double") / F.lit(V.RATING_SCALE)
    return F.coalesce(once(number, lambda n: F.when(F.abs(n) < F.lit(float("inf")), n)), F.lit(0.0))


def source_score(c):
    """Trust in a source, by its lower-cased tag."""
    pairs = [F.lit(x) for item in V.SOURCE_TRUST.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(_col(c))), F.lit(V.DEFAULT_TRUST))


def name_length(c):
    return F.least(F.length(_shown(c)), F.lit(V.NAME_LENGTH_LIMIT)) / F.lit(float(V.NAME_LENGTH_LIMIT))


def name_word_count(c):
    words = F.regexp_count(_shown(c), F.lit(f"(?U)[^{SPACE_SET}]+"))
    return F.least(words, F.lit(V.NAME_WORD_LIMIT)) / F.lit(float(V.NAME_WORD_LIMIT))


def category_score(name, category):
    """Keyword relevance: a step up per high-value word in the text, then a step down per
    low-value word, kept within 0 and 1 at every step.

    All steps of a kind are alike, so the score follows from the two counts of words found.
    """
    text = F.lower(F.concat(_shown(name), F.lit(" "), _shown(category)))
    width = len(V.LOW_VALUE_KEYWORDS) + 1
    scores = F.array(*[F.lit(s) for s in _category_scores()])

    def score(text):
        weights = [(w, width) for w in V.HIGH_VALUE_KEYWORDS] + [(w, 1) for w in V.LOW_VALUE_KEYWORDS]
        place = [F.when(F.contains(text, F.lit(w)), n).otherwise(0) for w, n in weights]
        return F.get(scores, reduce(lambda a, b: a + b, place))

    return once(text, score)


def _category_scores():
    """The score for each number of high-value words, and within these of low-value words, one after the other."""
    scores, raised = [], V.CATEGORY_START
    for _ in range(len(V.HIGH_VALUE_KEYWORDS) + 1):
        score = raised
        for _ in range(len(V.LOW_VALUE_KEYWORDS) + 1):
            scores.append(score)
            score = max(0.0, score - V.CATEGORY_LOW_STEP)
        raised = min(1.0, raised + V.CATEGORY_HIGH_STEP)
    return scores


# Decimal digits of any script, and the other characters that count as digits: raised, lowered,
# circled, bracketed and dotted ones and those of scripts without decimal digits. The last line has the
# decimal digits of scripts that the pattern's own tables may be too old for.
DIGITS = (
    r"\p{Nd}\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
    r"\x{11f50}-\x{11f59}\x{16ac0}-\x{16ac9}\x{1e4f0}-\x{1e4f9}"
)


def address_completeness(c):
    """Shares for a digit, a comma and more than thirty characters; missing scores 0."""
    address = _col(c)
    total = (
        F.when(address.rlike(f"[{DIGITS}]"), V.ADDRESS_DIGIT).otherwise(0.0)
        + F.when(address.contains(","), V.ADDRESS_COMMA).otherwise(0.0)
        + F.when(F.length(address) > V.ADDRESS_LONG_ABOVE, V.ADDRESS_LONG).otherwise(0.0)
    )
    missing = address.isNull() | address.isin(V.MISSING, "")
    return F.when(missing, 0.0).otherwise(F.least(total, F.lit(1.0)))


def _weighted(weights, columns):
    return reduce(lambda a, b: a + b, [columns[k] * F.lit(w) for k, w in weights.items()])


def data_completeness(has_email, has_phone, has_website, has_address):
    flags = dict(
        has_email=_col(has_email), has_phone=_col(has_phone),
        has_website=_col(has_website), has_address=_col(has_address),
    )
    return _weighted(V.COMPLETENESS_SHARES, flags)


def rule_score(**features):
    """Weighted sum of seven features; defaults to the feature columns themselves."""
    return _weighted(V.RULE_WEIGHTS, {k: _col(features.get(k, k)) for k in V.RULE_WEIGHTS})


def rule_label(score):
    return (_col(score) > V.GOOD_LEAD_ABOVE).cast("int")


def feature_columns():
    """All model inputs, keyed by name, over the lead columns."""
    flags = {f"has_{c}": has_value(c) for c in ("email", "phone", "website", "address")}
    return {
        **flags,
        "rating_score": zero_fill(rating_score("rating")),
        "source_score": source_score("source"),
        "name_length": name_length("business_name"),
        "name_word_count": name_word_count("business_name"),
        "category_score": category_score("business_name", "category"),
        "address_completeness": address_completeness("address"),
        "data_completeness": data_completeness(**flags),
    }
