"""Odds mathematics as Column expressions: price formats, margin removal, scoring rules.

Vectors are ARRAY<DOUBLE> columns. Margins that need a root are solved by a fixed number of bisection
steps, over all rows of an Arrow batch at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BISECTIONS = 45
MAX_DECIMAL = 10001.0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def implied(prices: Column) -> Column:
    return F.transform(prices, lambda p: 1 / p)


def overround(prices: Column) -> Column:
    return total(implied(prices)) - 1


def devig_multiplicative(prices: Column) -> Column:
    """Inverse prices scaled to sum to one."""
    raw = implied(prices)
    return F.transform(raw, lambda q: q / total(raw))


def _solved(prices: Column, solve) -> Column:
    """``solve`` of all arrays of one length at once, as a (rows, length) matrix; rows of NaN become null."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def run(books):
        import numpy as np
        import pyarrow as pa

        lengths = books.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = books.flatten().to_numpy(zero_copy_only=False).astype(float)
        starts = np.cumsum(lengths) - lengths
        out, ok = np.full(len(values), np.nan), np.zeros(len(lengths), bool)
        for n in np.unique(lengths[lengths > 0]):
            of = np.flatnonzero(lengths == n)
            at = starts[of][:, None] + np.arange(n)
            with np.errstate(all="ignore"):
                out[at] = solve(values[at])
            ok[of] = ~np.isnan(out[at]).any(axis=1)
        ends = np.concatenate(([0], np.cumsum(np.where(ok, lengths, 0)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out[np.repeat(ok, lengths)]), mask=pa.array(~ok))

    return run.asNondeterministic()(prices)  # so that no optimiser solves a row twice, in a filter and behind it


def _bisect(f, low: float, high: float, rows: int):
    """Where the decreasing function ``f`` of a column vector turns from positive to negative in [low, high], for each row."""
    import numpy as np

    lo, hi = np.full((rows, 1), low), np.full((rows, 1), high)
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        up = f(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def devig_power(prices: Column) -> Column:
    """(1/p)^k with k in [0.01, 20] such that they sum to one; null if the range does not hold such a k."""

    def solve(p):
        import numpy as np

        log = np.log(p)
        excess = lambda k: np.exp(-k * log).sum(axis=1, keepdims=True) - 1
        fits = (excess(0.01) >= 0) & (excess(20.0) <= 0)
        return np.where(fits, np.exp(-_bisect(excess, 0.01, 20.0, len(p)) * log), np.nan)

    return _solved(prices, solve)


def devig_shin(prices: Column) -> Column:
    """Shin's probabilities: an insider share z in [0, 1) is solved for; zero for a book without margin, null if none fits."""

    def solve(p):
        import numpy as np

        square = 4 / (p * p * (1 / p).sum(axis=1, keepdims=True))
        shares = lambda z: (np.sqrt(z * z + (1 - z) * square) - z) / (2 * (1 - z))
        excess = lambda z: shares(z).sum(axis=1, keepdims=True) - 1
        top, at_zero = 1 - 1e-10, excess(0.0)
        none = np.abs(at_zero) < 1e-12
        fits = (at_zero > 0) & (excess(top) < 0)
        return np.where(none, shares(0.0), np.where(fits, shares(_bisect(excess, 0.0, top, len(p))), np.nan))

    return _solved(prices, solve)


DEVIG = {"multiplicative": devig_multiplicative, "power": devig_power, "shin": devig_shin}


def decimal_prices(values: Column, fmt: Column, maximum: float = MAX_DECIMAL) -> Column:
    """STRUCT<prices, error> of string prices quoted in format HK or DECIMAL."""
    from .scalars import number

    nums = F.transform(values, number)
    missing = F.exists(nums, lambda x: x.isNull())
    shifted = F.when(fmt == "HK", F.transform(nums, lambda x: x + 1)).otherwise(nums)
    error = (
        F.when(missing, "missing_or_non_numeric")
        .when((fmt == "HK") & F.exists(nums, lambda x: x <= 0), "impossible_hk_value")
        .when(~F.coalesce(fmt, F.lit("")).isin("HK", "DECIMAL"), "unverified_odds_format")
        .when(F.exists(shifted, lambda x: (x <= 1) | (x > maximum)), "impossible_decimal_value")
    )
    return F.struct(F.when(error.isNull(), shifted).alias("prices"), error.alias("error"))


def normalised(p: Column) -> Column:
    return F.transform(p, lambda x: x / total(p))


def entropy(p: Column) -> Column:
    """Natural-log entropy of renormalised probabilities; zeros add nothing."""
    return total(F.transform(normalised(p), lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def normalised_entropy(p: Column) -> Column:
    return entropy(p) / F.log(F.size(p).cast("double"))


def brier_mean(p: Column, outcome: Column) -> Column:
    """Mean squared error over the classes; ``outcome`` is the index from 0."""
    return total(F.transform(normalised(p), lambda x, i: F.pow(x - (i == outcome).cast("double"), 2))) / F.size(p)


def brier_sum(p: Column, outcome: Column) -> Column:
    """The sum over the classes, as forecast tables use it."""
    return brier_mean(p, outcome) * F.size(p)


def log_loss(p: Column, outcome: Column, floor: float = 1e-15) -> Column:
    return -F.log(F.greatest(F.get(normalised(p), outcome), F.lit(floor)))


def rps(p: Column, outcome: Column) -> Column:
    """Ranked probability score of three ordered classes."""
    q = normalised(p)
    first = F.get(q, F.lit(0)) - (outcome == 0).cast("double")
    second = F.get(q, F.lit(0)) + F.get(q, F.lit(1)) - (outcome <= 1).cast("double")
    return (first * first + second * second) / 2


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int"))


def poisson_nll(goals: Column, rate: Column) -> Column:
    return rate - goals * F.log(rate) + F.log(F.factorial(goals.cast("int")).cast("double"))


def dixon_coles_tau(h: Column, a: Column, rate_h: Column, rate_a: Column, rho: Column) -> Column:
    return (
        F.when((h == 0) & (a == 0), 1 - rate_h * rate_a * rho)
        .when((h == 0) & (a == 1), 1 + rate_h * rho)
        .when((h == 1) & (a == 0), 1 + rate_a * rho)
        .when((h == 1) & (a == 1), 1 - rho)
        .otherwise(F.lit(1.0))
    )


def quarter_legs(q: Column) -> Column:
    """The two half lines (in quarter units) of a line in quarter units."""
    odd = F.pmod(q, F.lit(2)) == 1
    return F.when(odd, F.array(q - 1, q + 1)).otherwise(F.array(q, q))


def line_semantics(line: Column) -> Column:
    return F.when(F.pmod(line, F.lit(1.0)) == 0.5, "binary_win_loss").otherwise("settlement_weighted")


#: The bands of the exchange price ladder, in cents: from, to, step.
TICK_BANDS = ((101, 200, 1), (200, 300, 2), (300, 400, 5), (400, 600, 10), (600, 1000, 20), (1000, 2000, 50), (2000, 3000, 100), (3000, 5000, 200), (5000, 10000, 500), (10000, 100000, 1000))


def tick_index(cents: Column) -> Column:
    """The place of a price in cents on the ladder, from 0; null off the ladder."""
    out, done = None, 0
    for low, high, step in TICK_BANDS:
        inside = (cents >= low) & (cents < high if high != 100000 else cents <= high)
        here = F.when((cents - low) % step == 0, ((cents - low) / step).cast("int") + done)
        out = F.when(inside, here) if out is None else out.when(inside, here)
        done += (high - low) // step
    return out


def book_spread(back: Column, lay: Column) -> Column:
    """STRUCT of spread, mid and the spread in percentage points; null where lay < back."""
    return F.when(lay >= back, F.struct((lay - back).alias("spread"), ((lay + back) / 2).alias("mid"), (100 * (1 / back - 1 / lay)).alias("spread_pp")))


def time_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)
