"""Statistical expressions with the missing / constant rules built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def defined(value: Column) -> Column:
    """NaN (for instance from infinite inputs) counts as undefined."""
    return F.when(~F.isnan(value), value)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson coefficient over complete pairs; NULL when it is undefined.

    The built-in correlation raises on constant input, and a surrounding CASE
    does not protect an aggregate, hence the explicit quotient.  "Constant" is
    decided by min = max, never by a floating-point deviation.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    ratio = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, clip_unit(defined(ratio)))


#: Upper limits of the absolute coefficient for each word.
STRENGTHS = ((0.1, "none"), (0.3, "weak"), (0.5, "moderate"), (0.7, "noticeable"), (float("inf"), "strong"))


def strength_word(coefficient: float) -> str:
    return next(word for limit, word in STRENGTHS if abs(coefficient) < limit)


def strength(coefficient: Column) -> Column:
    """Verbal strength of a correlation coefficient."""
    words = F.lit(STRENGTHS[-1][1])
    for limit, word in reversed(STRENGTHS[:-1]):
        words = F.when(F.abs(coefficient) < limit, word).otherwise(words)
    return F.when(coefficient.isNull(), STRENGTHS[-1][1]).otherwise(words)


def fit_quality(r2: Column) -> Column:
    return F.when(r2 < 0.2, "weak").when(r2 < 0.5, "moderate").otherwise("good")


def number_label(value: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    whole = value == F.rint(value)
    return F.when(whole, F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))
