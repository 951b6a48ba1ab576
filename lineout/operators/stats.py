"""Regression, analysis of variance, pairwise comparison and plot statistics.

Spark reduces the rows to a few moments; only those, bounded by the number of
factor levels and never by rows, reach the driver for the closing arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineout.operators import distributions as P
from lineout.operators.joins import null_safe_join
from lineout.operators.running import running_totals
from lineout.sources.write import materialise


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line over complete rows, unweighted.

    Gives n, slope, intercept, r2 and sigma = sqrt(RSS / (n - 2)), with the
    moments x_mean, sxx a confidence band needs.
    """
    rows = df.dropna(subset=[x, y])
    fit = rows.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("x_mean"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    )
    rss = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("sxx")), F.lit(0.0))
    sigma = F.when(F.col("n") > 2, F.sqrt(F.try_divide(rss, F.col("n") - 2)))
    return fit.withColumn("sigma", sigma).drop("_syy", "_sxy")


def trend_band(df: DataFrame, y: str, x: str, points: int = 80, level: float = 0.95, critical: float | None = None) -> DataFrame:
    """Fitted line with a confidence band on an even grid of x values.

    The critical value comes from Student's t with n - 2 degrees of freedom
    unless one is given.
    """
    fit = linear_fit(df, y, x)
    if critical is None:
        n = fit.first()["n"]
        critical = P.t_quantile(0.5 + level / 2, n - 2) if n > 2 else float("nan")
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x_at = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / (points - 1)
    grid = grid.withColumn("x", x_at).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    off = F.col("x") - F.col("x_mean")
    error = F.col("sigma") * F.sqrt(1 / F.col("n") + F.try_divide(off * off, F.col("sxx")))
    return grid.withColumn("se", error).select(
        "x", "fit", "se",
        (F.col("fit") - critical * F.col("se")).alias("lower"),
        (F.col("fit") + critical * F.col("se")).alias("upper"),
    )


def cell_moments(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Rows, mean and within-cell sum of squares for each factor combination."""
    rows = df.dropna(subset=[y, *factors])
    return rows.groupBy(*factors).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(F.lit(1))).alias("within"),
    )


def main_effect(df: DataFrame, y: str, factor: str) -> DataFrame:
    """Sum of squares between the levels of one factor (first in the model)."""
    cells = cell_moments(df, y, [factor])
    grand = cells.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g")).scalar()
    held = cells.withColumn("_g", grand)
    gap = F.col("mean") - F.col("_g")
    return held.agg(
        (F.count(F.lit(1)) - 1).alias("df"), F.sum(F.col("n") * gap * gap).alias("sum_sq"),
    )


def _additional_ss(cells: DataFrame, small: str, large: str) -> tuple[float, int]:
    """Explained sum of squares, and its degrees of freedom, of ``small`` after ``large``.

    ``cells`` has n and t, the cell's centred total. The levels of ``large`` are
    eliminated one by one where the rows are; what is solved here has one row and
    column per level of ``small``.
    """
    level = F.col(small).alias("level")
    by_large = cells.groupBy(large).agg(
        F.sum("n").alias("n_all"), F.sum("t").alias("t_all"), F.collect_list(F.struct(level, "n", "t")).alias("row"),
    )
    each = by_large.select("*", F.explode("row").alias("x"))
    right = each.groupBy("x.level").agg(
        F.sum(F.col("x.t") - F.col("x.n") * F.col("t_all") / F.col("n_all")).alias("r"), F.sum("x.n").alias("n"),
    ).collect()
    left = each.select("x", "n_all", F.explode("row").alias("z")).groupBy(F.col("x.level").alias("i"), F.col("z.level").alias("j"))
    left = left.agg(F.sum(F.col("x.n") * F.col("z.n") / F.col("n_all")).alias("m")).collect()
    place = {row["level"]: i for i, row in enumerate(right)}
    matrix = np.diag([float(row["n"]) for row in right])
    for row in left:
        matrix[place[row["i"]], place[row["j"]]] -= row["m"]
    values, vectors = np.linalg.eigh(matrix)
    kept = values > max(values.max(), 0.0) * 1e-10
    part = vectors[:, kept].T @ np.array([row["r"] for row in right])
    return float((part * part / values[kept]).sum()), int(kept.sum())


def anova_two_way(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Two factors with interaction, sequential sums of squares.

    Rows (term, df, sum_sq, mean_sq, f, p). Empty cells lower the interaction's
    degrees of freedom. The factor with more levels is eliminated by aggregation,
    so it may have any number; the driver solves for the other one's levels.
    """
    cells = cell_moments(df, y, [a, b])
    grand = cells.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g")).scalar()
    cells = cells.withColumn("t", F.col("n") * (F.col("mean") - grand)).persist()
    whole = cells.agg(
        F.countDistinct(a).alias("a"), F.countDistinct(b).alias("b"), F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"),
        F.sum("within").alias("within"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("full"),
    ).first()

    def alone(factor: str) -> float:
        totals = cells.groupBy(factor).agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        return totals.agg(F.sum(F.col("t") * F.col("t") / F.col("n"))).first()[0]

    table, residual_df, residual = [], (whole["n"] or 0) - whole["cells"], whole["within"] or 0.0
    noise = residual / residual_df if residual_df > 0 else None
    if whole["cells"]:
        first = alone(a)
        if whole["b"] <= whole["a"]:
            second, second_df = _additional_ss(cells, b, a)
        else:
            swapped, swapped_df = _additional_ss(cells, a, b)
            second, second_df = alone(b) + swapped - first, whole["b"] - 1 + swapped_df - (whole["a"] - 1)
        rest_df = whole["cells"] - 1 - (whole["a"] - 1) - second_df
        for term, dof, ss in (
            (a, whole["a"] - 1, first), (b, second_df, second), (f"{a}:{b}", rest_df, whole["full"] - first - second),
        ):
            ms = ss / dof if dof else None
            f = ms / noise if ms is not None and noise else None
            table.append((term, dof, float(ss), ms, f, P.f_upper(f, dof, residual_df) if f is not None else None))
    cells.unpersist()
    table.append(("Residuals", residual_df, float(residual), noise, None, None))
    return df.sparkSession.createDataFrame(
        table, "term string, df long, sum_sq double, mean_sq double, f double, p double",
    )


PAIR_BLOCKS = 8


def _pairs(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All pairs of levels of a term, the later one first, from rows (by..., level, n, mean).

    Levels fall into blocks by hash, and every pair of blocks is one join key, so that
    the pairs of one term, which are the result, are made in many tasks.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)))
    block = F.pmod(F.xxhash64("level"), F.lit(PAIR_BLOCKS)).cast("int")
    side = lambda i, own, other: means.select(
        *by, F.col("level").alias(f"level_{i}"), F.col("n").alias(f"n_{i}"), F.col("mean").alias(f"mean_{i}"), block.alias(own), every.alias(other),
    )
    both = side(1, "_b1", "_b2").join(side(2, "_b2", "_b1"), [*by, "_b1", "_b2"])
    return both.filter(F.col("level_1") > F.col("level_2")).drop("_b1", "_b2").withColumn("diff", F.col("mean_1") - F.col("mean_2"))


def mean_differences(means: DataFrame, level: str) -> DataFrame:
    """Difference of means for each pair of levels, from a table of level means."""
    named = materialise(means.select(F.col(level).alias("level"), "n", "mean"))
    return _pairs(named).select("level_1", "level_2", "diff", "n_1", "n_2")


def term_means(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Mean per level of each term of a two-way model: (term, level, n, mean).

    A main effect is taken after the terms before it, the interaction compares cells. The
    least-squares fit of both main effects keeps the means of every level, so the second
    effect is its levels' means less what the first effect's means give there.
    """
    grand = cells.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g")).scalar()
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    first = cells.groupBy(a).agg(F.sum("n").alias("n"), mean.alias("mean"))
    beside = cells.join(first.select(a, F.col("mean").alias("_given")), a)
    second = beside.groupBy(b).agg(F.sum("n").alias("n"), (mean - F.sum(F.col("n") * F.col("_given")) / F.sum("n")).alias("_after"))
    text = lambda c: F.col(c).cast("string")
    return (
        first.select(F.lit(a).alias("term"), text(a).alias("level"), "n", "mean")
        .unionByName(second.select(F.lit(b).alias("term"), text(b).alias("level"), "n", (F.col("_after") + grand).alias("mean")))
        .unionByName(cells.select(F.lit(f"{a}:{b}").alias("term"), F.concat_ws(":", text(a), text(b)).alias("level"), "n", "mean"))
    )


def tukey_pairs(
    df: DataFrame, y: str, a: str, b: str, level: float = 0.95,
) -> DataFrame:
    """Honest significant differences of a two-way model with interaction.

    Each pair of levels of a term (see ``term_means``) gets a Tukey-Kramer interval and an
    adjusted p-value, read from the tail of the studentised range at even steps. The driver
    gets one row of totals; levels and pairs stay in Spark. Rows without y or a factor take
    no part; without residual degrees of freedom intervals and p-values are null.
    """
    cells = materialise(cell_moments(df, y, [a, b]))
    total = cells.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum("within").alias("within"),
                      F.countDistinct(a).alias("a"), F.countDistinct(b).alias("b")).first()
    dof = (total["n"] or 0) - total["cells"]
    pairs = _pairs(materialise(term_means(cells, a, b)), ["term"])
    noise = total["within"] / dof if dof > 0 else None
    error = F.sqrt(F.lit(noise) / 2 * (1 / F.col("n_1") + 1 / F.col("n_2"))) if noise is not None else F.lit(None).cast("double")
    width, p = F.lit(None).cast("double"), F.lit(None).cast("double")
    for term, groups in ((a, total["a"]), (b, total["b"]), (f"{a}:{b}", total["cells"])):
        if noise is None or groups < 2:
            continue
        tails = P.tails_at(groups, dof)
        at = F.try_divide(F.abs(F.col("diff")), F.col("_error")) / P.STEP
        step = F.least(F.floor(at), F.lit(P.STEPS - 1)).cast("int")
        listed = F.array(*map(F.lit, tails))
        low, high = F.get(listed, step), F.get(listed, step + 1)
        width = F.when(F.col("term") == term, P.width_at(tails, level)).otherwise(width)
        p = F.when(F.col("term") == term, low + (high - low) * F.least(at - step, F.lit(1.0))).otherwise(p)
    held = pairs.withColumn("_error", error).withColumn("_reach", width * F.col("_error"))
    return held.select(
        "term", "level_1", "level_2", "diff", (F.col("diff") - F.col("_reach")).alias("lower"), (F.col("diff") + F.col("_reach")).alias("upper"), p.alias("p_adj"),
    )


def binned_means(df: DataFrame, y: str, x: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows and mean x, y per group and fine x bin."""
    rows = df.dropna(subset=[x, y])
    slot = F.floor(F.col(x) / F.lit(float(width))).cast("bigint")
    return rows.groupBy(*by, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"),
    )


def smooth_trend(
    df: DataFrame, y: str, x: str, width: float, reach: int = 10, by: Sequence[str] = (),
) -> DataFrame:
    """Local linear trend per group with tricube weights over nearby x bins.

    A stand-in for the plotting smoother: rows are first reduced to bins, and
    each bin is fitted from the ``reach`` bins on either side of it.
    """
    bins = binned_means(df, y, x, width, by)
    centre = bins.select(*by, F.col("bin").alias("at"), F.col("x").alias("x0"), F.col("n").alias("n0"))
    nearby = centre.withColumn("bin", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    pairs = null_safe_join(nearby, bins, [*by, "bin"], "inner")
    off = F.col("x") - F.col("x0")
    closeness = 1 - F.pow(F.least(F.abs(off) / F.lit(float(width * (reach + 1))), F.lit(1.0)), 3)
    pairs = pairs.withColumns({"_off": off, "_w": F.col("n") * F.pow(closeness, 3)})
    w, d, v = F.col("_w"), F.col("_off"), F.col("y")
    sums = pairs.groupBy(*by, "at", "x0", "n0").agg(
        F.sum(w).alias("s0"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"),
        F.sum(w * v).alias("t0"), F.sum(w * d * v).alias("t1"),
    )
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    spread = s0 * s2 - s1 * s1
    # With all weight on one x there is no slope: fall back to the weighted mean.
    value = F.when(spread > 1e-12 * s0 * s2, (s2 * t0 - s1 * t1) / spread).otherwise(t0 / s0)
    return sums.select(*by, F.col("x0").alias("x"), value.alias("smooth"), F.col("n0").alias("n"))


def box_summary(df: DataFrame, y: str, by: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Exact quartiles, whisker ends and number of outliers per group.

    Quartiles interpolate between order statistics at (n - 1) q. Whiskers reach
    the most extreme values within ``whisker`` times the interquartile range.
    Values are counted first and ranked by running totals, so a large group is
    never gathered in one task.
    """
    by = list(by)
    counts = df.dropna(subset=[y]).groupBy(*by, F.col(y).alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running_totals(counts, "_v", ["c"], by=by)
    last = F.col("total_c") - 1

    def at(rank: Column) -> Column:
        """The value whose run of equal rows covers a 0-based rank."""
        covers = (F.col("cum_c") - F.col("c") <= rank) & (rank < F.col("cum_c"))
        return F.max(F.when(covers, F.col("_v")))

    ends = []
    for q in (0.25, 0.5, 0.75):
        name = f"q{int(q * 100)}"
        ends += [at(F.floor(last * q)).alias(f"{name}_lo"), at(F.ceil(last * q)).alias(f"{name}_hi")]
    ends = ranked.groupBy(*by).agg(F.max("total_c").alias("n"), *ends)

    def between(name: str, q: float) -> Column:
        position = (F.col("n") - 1) * q
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return low + (high - low) * (position - F.floor(position))

    box = ends.select(
        *by, "n", between("q25", 0.25).alias("q1"), between("q50", 0.5).alias("median"),
        between("q75", 0.75).alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * whisker
    fences = box.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    inside = null_safe_join(
        counts, fences.select(*by, "_low", "_high"), by, "inner",
        F.col("_v").between(F.col("_low"), F.col("_high")),
    )
    tips = inside.groupBy(*by).agg(
        F.min("_v").alias("whisker_low"), F.max("_v").alias("whisker_high"), F.sum("c").alias("_inside"),
    )
    table = null_safe_join(box, tips, by, "left")
    return table.withColumn("outliers", F.col("n") - F.col("_inside")).drop("_inside")


def grouped_bars(means: DataFrame, rows: str, columns: str, levels: Sequence[str], value: str) -> DataFrame:
    """One row per category with a column per group level, as a bar plot wants."""
    return means.groupBy(rows).pivot(columns, list(levels)).agg(F.first(value))
