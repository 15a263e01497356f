"""Score rounding, grades and the outreach cut-off."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import _col, once


def round1(score):
    """One decimal place, ties to even."""
    return F.rint(_col(score) * 10) / F.lit(10.0)


def score_from_probability(p):
    return round1(_col(p) * 100)


def grade(score):
    """Letter grade of a score already rounded to one place."""

    def letter(s):
        result = F.when(s >= V.GRADE_FLOORS["A"], "A")
        for name in ("B", "C"):
            result = result.when(s >= V.GRADE_FLOORS[name], name)
        return result.otherwise(V.LOWEST_GRADE)

    return once(score, letter)


def recommend(score):
    return _col(score) >= V.RECOMMEND_FROM


def grade_rank(letter):
    """Position of a grade, best first; unknown grades come last."""
    pairs = [F.lit(x) for item in V.GRADE_ORDER.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(letter)), F.lit(V.UNKNOWN_GRADE_RANK))


def min_grade_rank(letter):
    """Rank for a requested lowest grade; unknown requests mean the default grade."""
    return V.GRADE_ORDER.get(letter, V.GRADE_ORDER[V.DEFAULT_MIN_GRADE])
