"""Closed-form forecasters on ordered arrays.

A series is collapsed once to an array of doubles, oldest first; every method is then one expression over that array, so
any number of methods costs one shuffle. All functions take and return Columns; h has at least one element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse(df: DataFrame, key: list[str], order: str, *values: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a key with an array for `order` (named order + 's') and each value, all in order.

    keep: columns that the key determines. They are no part of the grouping, so later steps by the key find their rows in place.
    """
    packed = F.array_sort(F.collect_list(F.struct(order, *values)))
    pick = lambda v: F.transform("_p", lambda x: x[v]).alias(f"{v}s")
    return df.groupBy(*key).agg(packed.alias("_p"), *[F.first(c).alias(c) for c in keep]).select(*key, *keep, *map(pick, (order, *values)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. A column that is used twice is an expression that stands, and runs, twice; a lambda's argument is a value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last(h: Column, back: int = 1) -> Column:
    """Element `back` from the end, null if there is none."""
    return F.try_element_at(h, F.lit(-back))


def tail(h: Column, k: int) -> Column:
    return F.slice(h, F.greatest(F.size(h) - k + 1, F.lit(1)), F.lit(k))


def total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)


def mean(h: Column) -> Column:
    return F.when(F.size(h) > 0, total(h) / F.size(h))


def median(h: Column) -> Column:
    at = lambda s, i: F.try_element_at(s, i.cast("int"))
    return bound(F.array_sort(h), lambda s: (at(s, F.floor((F.size(s) + 1) / 2)) + at(s, F.floor(F.size(s) / 2) + 1)) / 2)


def stddev(h: Column, ddof: int = 0) -> Column:
    n = F.size(h) - ddof
    return F.when(n > 0, F.sqrt(bound(mean(h), lambda m: total(F.transform(h, lambda x: (x - m) * (x - m)))) / n))


def naive(h: Column) -> Column:
    return last(h)


def mean3(h: Column) -> Column:
    return mean(tail(h, 3))


def trend(h: Column, ahead: int = 1) -> Column:
    """Straight line over places 0..n-1, read off `ahead` places after the last; the last value if there is only one."""
    n = F.size(h).cast("double")
    slope = total(F.transform(h, lambda x, i: (i.cast("double") - (n - 1) / 2) * x)) / (n * (n * n - 1) / 12)
    return F.when(F.size(h) < 2, last(h)).otherwise(mean(h) + slope * ((n - 1) / 2 + ahead))


def trend_years(h: Column, years: Column, target: int) -> Column:
    """Straight line over the years themselves, not below zero; the last value if there is only one year."""
    m, t = mean(h), total(F.transform(years, lambda y: y.cast("double"))) / F.size(years)
    xy = total(F.zip_with(h, years, lambda v, y: (y - t) * v))
    xx = total(F.transform(years, lambda y: (y - t) * (y - t)))
    return F.when(F.size(h) < 2, last(h)).otherwise(F.greatest(F.lit(0.0), m + xy / F.nullif(xx, F.lit(0.0)) * (F.lit(float(target)) - t)))


def log_trend(h: Column) -> Column:
    """trend of the logarithms; plain trend if a value is not positive."""
    bad = F.exists(h, lambda x: x <= 0) | (F.size(h) < 2)
    return F.when(bad, trend(h)).otherwise(F.exp(trend(F.transform(h, lambda x: F.ln(F.greatest(x, F.lit(1e-300)))))))


def weighted(h: Column, lam: float = 0.7) -> Column:
    n = F.size(h)
    return bound(F.transform(h, lambda x, i: F.pow(F.lit(lam), (n - 1 - i).cast("double"))), lambda w: total(F.zip_with(h, w, lambda x, v: x * v)) / total(w))


def _level(h: Column, alpha: float) -> Column:
    return F.aggregate(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), F.element_at(h, 1), lambda a, x: alpha * x + (1 - alpha) * a)


def _but_last(h: Column) -> Column:
    return F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(1)))


def _least(options: Column) -> Column:
    """Forecast f of the option (e, i, f) with the smallest error e; the first on ties."""
    return F.array_min(options)["f"]


ALPHAS = [round(0.1 * i, 1) for i in range(1, 10)]


def ses(h: Column) -> Column:
    """Exponential smoothing; alpha is the first of nine that misses the last value least. Below three values alpha is one half."""
    alphas = F.array(*map(F.lit, ALPHAS))
    up = lambda levels, x: F.zip_with(alphas, levels, lambda a, v: a * x + (1 - a) * v)
    # all nine levels in one pass, up to the value before the last
    before = F.aggregate(F.slice(h, 2, F.greatest(F.size(h) - 2, F.lit(0))), F.array_repeat(F.element_at(h, 1), len(ALPHAS)), up)
    option = lambda a, v: F.struct(F.pow(v - last(h), F.lit(2.0)).alias("e"), a.alias("i"), (a * last(h) + (1 - a) * v).alias("f"))
    return F.when(F.size(h) < 3, _level(h, 0.5)).otherwise(_least(F.zip_with(alphas, before, option)))


DAMPED = [(a, b, p) for a in (0.3, 0.6, 0.9) for b in (0.1, 0.3, 0.6) for p in (0.7, 0.9, 0.98)]


_STATE = "struct<l:double,t:double>"


def _start(h: Column) -> Column:
    return F.struct(F.element_at(h, 1).alias("l"), (F.try_element_at(h, F.lit(2)) - F.element_at(h, 1)).alias("t"))


def _step(s: Column, x: Column, a: Column | float, b: Column | float, p: Column | float) -> Column:
    """Level and trend after the value x."""
    return bound(a * x + (1 - a) * (s["l"] + p * s["t"]), lambda level: F.struct(level.alias("l"), (b * (level - s["l"]) + (1 - b) * p * s["t"]).alias("t"))).cast(_STATE)


def damped(h: Column) -> Column:
    """Damped trend; its three factors are the first of 27 triples that miss the last value least. Fixed factors for three values, a line below."""
    triples = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("p")) for i, (a, b, p) in enumerate(DAMPED)])
    step = lambda q, s, x: _step(s, x, q["a"], q["b"], q["p"])
    # the states of all triples in one pass, up to the value before the last; one step more gives the forecast
    states = F.aggregate(F.slice(h, 2, F.greatest(F.size(h) - 2, F.lit(0))), F.array_repeat(_start(h).cast(_STATE), len(DAMPED)), lambda states, x: F.zip_with(triples, states, lambda q, s: step(q, s, x)))

    def option(q: Column, s: Column) -> Column:
        error = F.pow(s["l"] + q["p"] * s["t"] - last(h), F.lit(2.0))
        return bound(step(q, s, last(h)), lambda n: F.struct(error.alias("e"), q["i"].alias("i"), (n["l"] + q["p"] * n["t"]).alias("f")))

    fixed = F.aggregate(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), _start(h).cast(_STATE), lambda s, x: _step(s, x, 0.6, 0.3, 0.9), lambda s: s["l"] + 0.9 * s["t"])
    return F.when(F.size(h) < 3, trend(h)).when(F.size(h) == 3, fixed).otherwise(_least(F.zip_with(triples, states, option)))


def theta(h: Column) -> Column:
    return F.when(F.size(h) < 2, last(h)).otherwise(0.5 * (ses(h) + trend(h)))


def robust_mean(h: Column) -> Column:
    """Mean of the last three values without those more than three median deviations (at least one unit if that is 0) off their median."""

    def kept(t: Column, m: Column, dev: Column) -> Column:
        near = F.filter(t, lambda x: F.abs(x - m) <= 3 * F.when(dev == 0, F.lit(1.0)).otherwise(dev))
        return bound(near, lambda k: F.when(F.size(k) > 0, mean(k)).otherwise(m))

    around = lambda t, m: bound(median(F.transform(t, lambda x: F.abs(x - m))), lambda dev: kept(t, m, dev))
    return bound(tail(h, 3), lambda t: bound(median(t), lambda m: around(t, m)))


def _line_slope(h: Column, years: Column) -> Column:
    """Slope of a straight line over the years; 0 if they are all one."""
    t = total(F.transform(years, lambda y: y.cast("double"))) / F.size(years)

    def slope(t: Column) -> Column:
        xx = total(F.transform(years, lambda y: (y - t) * (y - t)))
        return F.coalesce(total(F.zip_with(h, years, lambda v, y: (y - t) * v)) / F.nullif(xx, F.lit(0.0)), F.lit(0.0))

    return bound(t, slope)


def _lag_row(h: Column, years: Column) -> Column:
    """Features of the value that follows h: last value, the one before, mean, slope."""
    return F.array(last(h), last(h, 2), mean(h), _line_slope(h, years))


def least_squares(columns: Column, y: Column, learn: Column | int, start: Column) -> Column:
    """Prediction for the last row by making columns orthogonal one after another (modified Gram-Schmidt).

    columns: array of columns, each an array of doubles by row; y: the label by row; learn: how many rows are learnt from, in front of the row that is predicted. Rows of a penalty are rows like
    others: one a column, with the root of the penalty there and label 0. start: what a row of zeros gets. Each step takes its share out of the later columns and the label in all rows, so the
    last row's share is its prediction and no system has to be solved.
    """
    rows = lambda c: F.slice(c, F.lit(1), learn if isinstance(learn, Column) else F.lit(learn))
    dot = lambda a, b: total(F.zip_with(rows(a), rows(b), lambda u, v: u * v))
    less = lambda a, b, k: F.zip_with(a, b, lambda u, v: u - k * v)

    def step(s: Column, i: Column) -> Column:
        def with_c(c: Column) -> Column:
            return bound(F.nullif(dot(c, c), F.lit(0.0)), lambda norm: with_norm(c, norm))

        def share(c: Column, other: Column, norm: Column) -> Column:
            return F.coalesce(dot(c, other) / norm, F.lit(0.0))

        def with_norm(c: Column, norm: Column) -> Column:
            later = F.transform(s["c"], lambda other, j: F.when(j > i, bound(share(c, other, norm), lambda k: less(other, c, k))).otherwise(other))
            return bound(share(c, s["y"], norm), lambda k: F.struct(later.alias("c"), less(s["y"], c, k).alias("y"), (s["p"] + k * F.element_at(c, -1)).alias("p")))

        return bound(F.element_at(s["c"], i + 1), with_c)

    state = F.struct(columns.alias("c"), y.alias("y"), start.alias("p"))
    return F.aggregate(F.sequence(F.lit(0), F.size(columns) - 1), state, step, lambda s: s["p"])


def ridge(h: Column, years: Column, target: Column | int, alpha: float = 1.0) -> Column:
    """A ridge of the series on its own last value, the one before, mean and slope (features centred, not scaled), not below zero.

    Each value with two earlier ones is a row. Below two rows: a straight line over the years, read off at the target year.
    """
    places = F.sequence(F.lit(2), F.size(h) - 1)
    row = lambda i: _lag_row(F.slice(h, F.lit(1), i), F.slice(years, F.lit(1), i))
    cell = lambda rows, j: F.transform(rows, lambda r: F.element_at(r, j + 1))
    root = alpha**0.5

    def fit(z: Column) -> Column:
        """z: rows of the values known and, last, the row to predict."""
        m = F.size(z) - 1
        known = F.slice(z, F.lit(1), m)

        def column(j: Column) -> Column:
            penalty = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == j, F.lit(root)).otherwise(F.lit(0.0)))
            return bound(mean(cell(known, j)), lambda c: F.concat(F.transform(cell(known, j), lambda v: v - c), penalty, F.array(F.element_at(F.element_at(z, -1), j + 1) - c)))

        labels = F.slice(h, F.lit(3), m)
        columns = F.transform(F.sequence(F.lit(0), F.lit(3)), column)
        y = bound(mean(labels), lambda c: F.concat(F.transform(labels, lambda v: v - c), F.array(*[F.lit(0.0)] * 5)))
        return F.greatest(F.lit(0.0), least_squares(columns, y, m + 4, mean(labels)))

    every = F.concat(F.transform(places, row), F.array(_lag_row(h, years)))
    return F.when(F.size(h) < 4, line_at(h, years, target)).otherwise(bound(every, fit))


def line_at(h: Column, years: Column, target: Column | int) -> Column:
    """Straight line over the years read off at the target year, not below zero; the last value if there is only one."""
    t = total(F.transform(years, lambda y: y.cast("double"))) / F.size(years)
    at = (target if isinstance(target, Column) else F.lit(target)).cast("double")
    return F.when(F.size(h) < 2, last(h)).otherwise(F.greatest(F.lit(0.0), mean(h) + _line_slope(h, years) * (at - t)))


#: Methods on one history alone.
METHODS: dict[str, Callable[[Column], Column]] = {"DampedTrend": damped, "LogTrend": log_trend, "Mean3": mean3, "Median": median, "Naive": naive, "RobustMean": robust_mean, "SES": ses, "Theta": theta, "Trend": trend, "Weighted": weighted}


def recent_rate(rates: Column) -> Column:
    """Median of the last three rates, the mean if there are fewer than three, null without any."""
    return F.when(F.size(rates) >= 3, median(tail(rates, 3))).otherwise(mean(rates))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """x between lo and hi; null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def around_last(p: Column, h: Column) -> Column:
    """p between 0.3 and 3 times the last value, if that is positive, and not below zero."""
    return F.when(last(h) > 0, clip(p, 0.3 * last(h), 3.0 * last(h))).otherwise(F.greatest(p, F.lit(0.0)))


def smape(actual: Column, predicted: Column) -> Column:
    """Symmetric percentage error, 0 if both are 0."""
    den = (F.abs(actual) + F.abs(predicted)) / 2
    return F.when(den == 0, F.lit(0.0)).otherwise(100 * F.abs(actual - predicted) / den)


def smart(h: Column, drift: Column, rate_based: Column) -> Column:
    """Median of drift, last value and rate-based forecast, wrapped: dead series stay dead, reviving ones are halved, breaks follow the last value."""
    candidates = F.filter(F.array(drift, last(h), rate_based), lambda x: x.isNotNull())
    before = F.when(F.size(h) > 1, median(_but_last(h))).otherwise(last(h))

    def choice(v: Column) -> Column:
        now, m, b = v["now"], v["m"], v["before"]
        return (
            F.when((now == 0) & (F.coalesce(last(h, 2), F.lit(1.0)) == 0), F.lit(0.0))
            .when(now == 0, F.when(m > 0, 0.5 * m).otherwise(F.lit(0.0)))
            .when((b > 0) & (now / F.nullif(b, F.lit(0.0)) < 0.3), now)
            .when((b > 0) & (now / F.nullif(b, F.lit(0.0)) > 3.0), 0.7 * now + 0.3 * b)
            .otherwise(m)
        )

    return bound(F.struct(last(h).alias("now"), median(candidates).alias("m"), before.alias("before")), choice)


def recursive(h: Column, method: Callable[[Column], Column], horizon: int) -> Column:
    """Array of `horizon` forecasts; each is appended to the history of the next."""
    grown = reduce(lambda a, _: F.concat(a, F.array(method(a))), range(horizon), h) if horizon <= 1 else F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), h, lambda a, _i: F.concat(a, F.array(method(a))))
    return F.slice(grown, F.size(h) + 1, F.lit(horizon))
