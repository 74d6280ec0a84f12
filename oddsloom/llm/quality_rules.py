"""Quality rules: text statistics and robust multivariate outliers.

The statistics of each language and source are held against a minimum-covariance-determinant (MCD)
estimate: the mean and covariance of the ``share`` of rows that lie closest, found by concentration
steps from three starts (quartile ranges, signs and squashed values), of which the one with the least
determinant goes on until its determinant falls no more. The covariance is then made consistent for
normal data. Every step is one aggregation over all rows; medians and distance thresholds come from
counts on a fixed fine grid, so no group is gathered in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, is_empty
from .textops import SPACES, mix, pieces, shingles

WINDOW = 5
STATS = ("log_words", "log_word_length", "symbol_rate", "dup_line_rate", "repeat_rate")
FLOOR = (0.35, 0.10, 0.12, 0.15, 0.15)  # a lesser standard deviation is raised to this: most statistics are zero in clean text
STARTS, TRIAL_STEPS, MOST_STEPS = 3, 2, 30
FELL = 1e-4  # of the log determinant, below which a group's steps have converged
GRID = 256.0  # cells per unit of a statistic
DISTANCE_GRID = 32.0  # cells per factor of two of a squared distance
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_statistics(docs: DataFrame) -> DataFrame:
    """The counts of every row (null text: none)."""

    def run(batches):
        for batch in batches:
            for t in pieces(batch.column(3)):
                n = len(t)
                ws, we = t.words()
                owner = t.of(ws)
                prefix = t.prefix()
                n_words = np.bincount(owner, minlength=n)
                starts_char = (t.data & 0xC0) != 0x80
                chars = t.per_text(starts_char & ~SPACES[t.data])
                symbols = t.per_text(SYMBOL[t.data])
                salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
                # windows of words that are found twice or more in their text
                grams, at = shingles(t.hashes(ws, we, prefix), owner, WINDOW)
                key = grams ^ salt[owner[at]] if len(at) else grams
                order = np.argsort(key)
                same = key[order][1:] == key[order][:-1]
                twice = np.zeros(len(key), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(len(ws) + WINDOW + 1, np.int64)
                np.add.at(cover, at[twice], 1)
                np.add.at(cover, at[twice] + WINDOW, -1)
                covered = np.cumsum(cover)[: len(ws)] > 0
                repeats = np.bincount(owner[covered], minlength=n)
                # lines that hold a word and equal an earlier line
                which, ls, le = t.lines()
                full = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
                which, ls, le = which[full], ls[full], le[full]
                lines = np.bincount(which, minlength=n)
                line_key = mix(t.hashes(ls, le, prefix) + (le - ls).astype(np.uint64)) ^ salt[which]
                _, first = np.unique(line_key, return_index=True)
                distinct = np.bincount(which[first], minlength=n)
                own = batch.slice(t.first, n)
                counts = [n_words, chars, symbols, lines - distinct, repeats, lines]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *(pa.array(x.astype(np.int64)) for x in counts)], [x.split()[0] for x in BASE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(run, BASE)


def statistic_columns() -> list[Column]:
    words = F.col("n_words") + 1.0
    return [
        F.log(words),
        F.log((F.col("word_chars") + 1.0) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1.0)),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty approximation."""
    from statistics import NormalDist

    a = 2 / (9 * k)
    return k * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def _levels(rows: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(lang, source, grp): a group of its own for ``least`` rows or more; smaller ones of a language pool, then all."""
    n = rows.groupBy("lang", "source").count()
    small = F.when(F.col("count") < least, F.col("count")).otherwise(0)
    pooled = n.withColumn("pool", F.sum(small).over(Window.partitionBy("lang")))
    named = F.to_json(F.struct("lang", "source"))
    grp = F.when(F.col("count") >= least, named).when(F.col("pool") >= least, F.to_json(F.struct("lang"))).otherwise(F.lit("*"))
    return scratch.save(pooled.select("lang", "source", grp.alias("grp")))


def _at_quantile(cells: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The least ``cell`` at which ``share`` of the group's count is reached."""
    w = Window.partitionBy(*keys).orderBy("cell")
    running = cells.withColumn("below", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return running.filter(F.col("below") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("cell").alias("cell"))


def chi2_below(x: float, k: int) -> float:
    """P(chi-squared of k degrees of freedom <= x), by Simpson's rule over its square root."""
    from math import lgamma

    y = np.linspace(0, np.sqrt(x), 2001)
    f = np.exp((k - 1) * np.log(np.maximum(y, 1e-300)) - y * y / 2 + np.log(2.0) - k / 2 * np.log(2.0) - lgamma(k / 2))
    return float((y[1] - y[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-2:2].sum()))


def consistency(share: float, k: int) -> float:
    """By how much the covariance of the closest ``share`` of normal rows is too small."""
    return share / chi2_below(chi2_quantile(share, k), k + 2)


def raised(cov: np.ndarray) -> np.ndarray:
    """Covariances whose variances below FLOOR are raised to it; the others are as estimated."""
    own = np.einsum("...ii->...i", cov)
    return cov + np.maximum(np.square(FLOOR) - own, 0)[..., None] * np.eye(cov.shape[-1])


def _fit(moments: DataFrame) -> DataFrame:
    """Per (grp, start) the mean m0.., the entries p00.. of the inverse covariance and its log determinant, from counts and sums of products."""
    p = len(STATS)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    names = [f"m{i}" for i in range(p)] + [f"p{i}{j}" for i, j in upper] + ["det"]

    def run(batches):
        for batch in batches:
            t = batch.to_pandas()
            n = t["n"].to_numpy(float)
            mean = np.stack([t[f"s{i}"] for i in range(p)], 1) / n[:, None]
            cov = np.empty((len(t), p, p))
            for i, j in upper:
                cov[:, i, j] = cov[:, j, i] = t[f"q{i}{j}"] / n - mean[:, i] * mean[:, j]
            cov = raised(cov)
            inverse = np.linalg.inv(cov)
            cols = [mean[:, i] for i in range(p)] + [inverse[:, i, j] for i, j in upper] + [np.linalg.slogdet(cov)[1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in ("grp", "start")), *map(pa.array, cols)], ["grp", "start", *names])

    return moments.mapInArrow(run, "grp string, start int, " + ", ".join(f"{x} double" for x in names))


def _moments(rows: DataFrame) -> DataFrame:
    p = len(STATS)
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _attach(rows: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """Join a table with a row for each group; broadcast only if their checked number is small."""
    return rows.join(F.broadcast(table) if groups <= 20_000 else table, "grp")


def _distance() -> Column:
    p = len(STATS)
    d = [F.col(s) - F.col(f"m{i}") for i, s in enumerate(STATS)]
    return sum((d[i] * d[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0))


def _starts(rows: DataFrame) -> DataFrame:
    """The first estimates of each group, from ``rows`` with their centres c0.. and scales w0..: three starts.

    0: the quartile ranges alone; 1: the covariance of the rows' directions from the centre; 2: of their
    squashed (tanh) values. The last two are shapes, which concentration scales.
    """
    z = [(F.col(s) - F.col(f"c{i}")) / F.col(f"w{i}") for i, s in enumerate(STATS)]
    p = len(STATS)
    norm = F.sqrt(F.greatest(sum((x * x for x in z), F.lit(0.0)), F.lit(1e-6)))
    forms = {1: [x / norm for x in z], 2: [F.tanh(x) for x in z]}
    products = [F.avg(f[i] * f[j]).alias(f"q{k}_{i}{j}") for k, f in forms.items() for i in range(p) for j in range(i, p)]
    given = [F.first(f"{x}{i}").alias(f"{x}{i}") for x in "cw" for i in range(p)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    names = [f"m{i}" for i in range(p)] + [f"p{i}{j}" for i, j in upper] + ["det"]

    def run(batches):
        for batch in batches:
            t = batch.to_pandas()
            n = len(t)
            centre, scale = (np.stack([t[f"{x}{i}"] for i in range(p)], 1) for x in "cw")
            for start in range(STARTS):
                shape = np.tile(np.eye(p), (n, 1, 1))
                if start:
                    for i, j in upper:
                        shape[:, i, j] = shape[:, j, i] = t[f"q{start}_{i}{j}"]
                    shape /= np.maximum(np.trace(shape, axis1=1, axis2=2) / p, 1e-9)[:, None, None]
                    shape = 0.9 * shape + 0.1 * np.eye(p)
                cov = raised(shape * scale[:, :, None] * scale[:, None, :])
                inverse = np.linalg.inv(cov)
                cols = [centre[:, i] for i in range(p)] + [inverse[:, i, j] for i, j in upper] + [np.linalg.slogdet(cov)[1]]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("grp")), pa.array(np.full(n, start, np.int32)), *map(pa.array, cols)], ["grp", "start", *names])

    return rows.groupBy("grp").agg(*given, *products).mapInArrow(run, "grp string, start int, " + ", ".join(f"{x} double" for x in names))


def _step(rows: DataFrame, model: DataFrame, share: float, cell: Column, groups: int) -> DataFrame:
    """A concentration step: the closest rows of each group and start give the next estimate."""
    near = _attach(rows, model, groups).select("grp", "start", *STATS, cell.alias("cell"))
    cut = _at_quantile(near.groupBy("grp", "start", "cell").agg(F.count(F.lit(1)).alias("n")), ["grp", "start"], share).withColumnRenamed("cell", "cut")
    cut = F.broadcast(cut) if groups <= 20_000 else cut
    return _fit(_moments(near.join(cut, ["grp", "start"]).filter(F.col("cell") <= F.col("cut"))))


def quality_verdicts(docs: DataFrame, share: float = 0.75, tail: float = 1e-3, least: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the squared distance.

    Rows that fail the base rules are left out of the estimates. Null languages and sources form groups
    like any other value; groups of fewer than ``least`` rows pool within their language, then over all;
    if even that pool is smaller, its rows are held to the base rules only. Null and empty texts fail
    the base rules. Repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    table = scratch.save(text_statistics(docs).withColumn("base_failed", failed).withColumns(dict(zip(STATS, statistic_columns(), strict=True))))
    good = table.filter(~F.col("base_failed"))
    levels = _levels(good, least, scratch)
    groups = levels.count()
    named = levels.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    named = F.broadcast(named) if groups <= 20_000 else named
    rows = scratch.save(good.join(named, good.lang.eqNullSafe(F.col("lang_")) & good.source.eqNullSafe(F.col("source_"))).select("doc_id", "grp", *STATS))

    # centres and scales: medians and quartile ranges of each statistic
    cells = rows.select("grp", F.posexplode(F.array(*(F.floor(F.col(s) * GRID) for s in STATS)))).groupBy("grp", F.col("pos"), F.col("col").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = scratch.save(cells)
    lower, middle, upper = (_at_quantile(cells, ["grp", "pos"], q).withColumnRenamed("cell", name) for q, name in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi")))
    quartiles = lower.join(middle, ["grp", "pos"]).join(upper, ["grp", "pos"])
    floor = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("pos") + 1)
    spread = F.greatest((F.col("hi") - F.col("lo")) / GRID / 1.349, floor)
    p = len(STATS)
    one = [F.max(F.when(F.col("pos") == i, (F.col("mid") + 0.5) / GRID)).alias(f"c{i}") for i in range(p)]
    two = [F.max(F.when(F.col("pos") == i, spread)).alias(f"w{i}") for i in range(p)]
    scales = scratch.save(quartiles.groupBy("grp").agg(*one, *two))
    model = scratch.save(_starts(_attach(rows, scales, groups)))

    cell = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * DISTANCE_GRID)

    for _ in range(TRIAL_STEPS):
        model = scratch.save(_step(rows, model, share, cell, groups), drop=model)
    best = F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))
    model = scratch.save(model.withColumn("place", best).filter("place = 1").drop("place"), drop=model)
    moving, done = model, None
    for _ in range(MOST_STEPS):  # groups whose determinant still falls take another step
        before = scratch.save(moving.select("grp", F.col("det").alias("was")))
        ids = F.broadcast(before.select("grp")) if groups <= 20_000 else before.select("grp")
        open_rows = rows.join(ids, "grp", "left_semi")
        moving = scratch.save(_step(open_rows, moving, share, cell, groups).join(before, "grp"))
        still = F.col("was") - F.col("det") > FELL
        done = moving.filter(~still).drop("was") if done is None else done.unionByName(moving.filter(~still).drop("was"))
        moving = moving.filter(still).drop("was")
        if is_empty(moving):
            break
    model = scratch.save(done.unionByName(moving))

    far = _attach(rows, model, groups).select("doc_id", "grp", _distance().alias("d2"), cell.alias("cell"))
    middle = _at_quantile(far.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")), ["grp"], 0.5)
    scale = middle.select("grp", (F.pow(F.lit(2.0), (F.col("cell") + 0.5) / DISTANCE_GRID) / chi2_quantile(0.5, p)).alias("scale"))
    counts = rows.groupBy("grp").count().select("grp", (F.col("count") >= least).alias("enough"))
    model = scratch.save(model.join(scale, "grp").join(counts, "grp"), drop=model)

    full = table.join(named, table.lang.eqNullSafe(F.col("lang_")) & table.source.eqNullSafe(F.col("source_")), "left").drop("lang_", "source_")
    full = full.join(F.broadcast(model) if groups <= 20_000 else model, "grp", "left")
    # of two scales the wider one: that of normal rows, and that of the group's own median distance
    d2 = _distance() / F.greatest(F.col("scale"), F.lit(consistency(share, p)))
    outlier = F.col("enough") & (d2 > chi2_quantile(1 - tail, p))
    kept = ~F.col("base_failed") & ~F.coalesce(outlier, F.lit(False))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), d2).alias("distance"))
