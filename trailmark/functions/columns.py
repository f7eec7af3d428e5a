"""Column expressions: identity, calendar, labels, Wilson bound, series of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the words for an effect's size.
EFFECT_BOUNDS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))
#: P below the bound earns the stars.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date; midnight UTC in a UTC session."""
    return F.to_date(F.date_trunc("week", ts))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def weeks_between(later: Column, earlier: Column) -> Column:
    """Whole weeks between two dates."""
    return F.floor(F.datediff(later, earlier) / 7).cast("int")


def day_part(ts: Column) -> Column:
    """morning 6-11, afternoon 12-17, evening 18-23, night 0-5."""
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def clean_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_blank(c: Column) -> Column:
    """Null, empty, or the text "nan"."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan")


def noreply_login(email: Column) -> Column:
    """The login in a GitHub no-reply address, with or without the leading number; null for other addresses."""
    login = F.regexp_extract(F.lower(F.trim(email)), r"^(?:[0-9]+\+)?([^@+]+)@users\.noreply\.github\.com$", 1)
    return F.when(login != "", login)


def effect_label(d: Column) -> Column:
    out = F.when(d.isNull(), F.lit(None).cast("string"))
    for bound, word in EFFECT_BOUNDS:
        out = out.when(F.abs(d) < bound, word)
    return out.otherwise("large")


def significance_stars(p: Column, bounds=STARS) -> Column:
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for bound, stars in bounds:
        out = out.when(p < bound, stars)
    return out.otherwise("ns")


def wilson_lower_bound(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson score interval; 0 without trials."""
    p, zz = k / F.when(n > 0, n), z * z
    inner = p + zz / (2 * n) - z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    return F.when(n > 0, inner / (1 + zz / n)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; null when whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where either side is constant."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
