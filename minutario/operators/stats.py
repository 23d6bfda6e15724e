"""Descriptive and inferential statistics over columns of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., variable, value) with doubles; nulls and NaN are dropped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_p")
    return df.select(*keep, pairs).select(*keep, "_p.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def describe_numeric(df: DataFrame, columns: Sequence[str], log: bool = False, exact: bool = True) -> DataFrame:
    """One row per column: n, location, spread and shape. Skewness and kurtosis are corrected for bias.

    Exact quantiles keep a count for every distinct value; for columns with billions of them take exact=False, which
    uses mergeable sketches and leaves the mode out.
    """
    long = unpivoted(df, columns)
    if log:
        long = long.withColumn("value", F.log1p("value"))
    v, n = F.col("value"), F.col("n")
    base = long.groupBy("variable").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.percentile if exact else F.percentile_approx)(v, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("_q"), (F.mode(v, True) if exact else F.lit(None).cast("double")).alias("mode"),
        F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"),
    )
    skew = F.when((n > 2) & ~F.isnan("_g1"), F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1"))
    kurt = F.when((n > 3) & ~F.isnan("_g2"), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return base.select(
        "variable", F.lit("log1p" if log else "none").alias("transform"), "n", "mean", F.col("_q")[1].alias("median"), "mode", "variance", "std", "min",
        F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "max", skew.alias("skewness"), kurt.alias("excess_kurtosis"),
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"),
    )


def describe_categorical(df: DataFrame, columns: Sequence[str], missing: str = "<missing>") -> DataFrame:
    """(variable, category, count, share) with a label for nulls."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("category")) for c in columns])).alias("_p")
    counts = df.select(pairs).select("_p.*").groupBy("variable", "category").agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy("variable")))


def rate_by_bin(df: DataFrame, value: str, flag: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, n, n_true, rate) in right-closed bins; empty bins stay, values outside or missing don't count."""
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    place = F.coalesce(*[F.when((F.col(value) > a) & (F.col(value) <= b), i) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    counts = df.select(place.alias("bin"), flag.alias("f")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.count_if("f").alias("n_true"))
    return bins.join(counts, "bin", "left").na.fill(0, ["n", "n_true"]).withColumn("rate", F.when(F.col("n") > 0, F.col("n_true") / F.col("n")))


def zscore_outliers(df: DataFrame, key: str, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """(key, variable, value, z) beyond the threshold; a constant column has none. Moments are joined, not windowed."""
    long = unpivoted(df, columns, key)
    moments = long.groupBy("variable").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    return long.join(F.broadcast(moments), "variable").where("s > 0").select(key, "variable", "value", z.alias("z")).where(F.abs("z") > threshold)


def iqr_outliers(df: DataFrame, key: str, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """(key, variable, value) outside Tukey's fences."""
    long = unpivoted(df, columns, key)
    fences = long.groupBy("variable").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0]), F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])
    return long.join(F.broadcast(fences), "variable").where((F.col("value") < low) | (F.col("value") > high)).select(key, "variable", "value")


#: Ranges that the distinct values are dealt to for running sums: a task holds about this part of a group's values.
RANGES = 64


def mid_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """df with rank (ties share their mean rank) and ties (rows of the same value) per group; null values drop out.

    Rows are counted by value first. The distinct values are dealt to ranges between approximate quantiles, summed up
    in order within each range, and the ranges' own totals, RANGES to a group, are added: no task holds a whole
    group, and the result doesn't depend on where the ranges lie.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    bounds = counts.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(1000)).alias("_bounds"))
    place = F.size(F.filter("_bounds", lambda b: b < F.col(value).cast("double")))
    dealt = counts.crossJoin(F.broadcast(bounds)).select(*by, value, "ties", place.alias("_range"))  # bounds: one row
    inside = F.sum("ties").over(W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    totals = dealt.groupBy(*by, "_range").agg(F.sum("ties").alias("_total"))
    lower = totals.select(*[F.col(c).alias(f"_l_{c}") for c in by], F.col("_range").alias("_lower"), F.col("_total").alias("_below"))
    on = F.col("_lower") < F.col("_range")
    for c in by:
        on &= F.col(f"_l_{c}").eqNullSafe(F.col(c))
    offsets = totals.join(lower, on, "left").groupBy(*by, "_range").agg(F.coalesce(F.sum("_below"), F.lit(0)).alias("_offset"))
    ranked = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    same = reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_range")])
    ranked = ranked.alias("r").join(offsets.alias("o"), same).select(*[F.col(f"r.{c}") for c in (*by, value, "ties")], (F.col("_offset") + F.col("_inside") + (F.col("ties") + 1) / 2).alias("rank"))
    match = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*by, value)])
    return df.alias("d").join(ranked.alias("k"), match).select("d.*", "k.ties", "k.rank")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(n, n_groups, h, epsilon_squared) of the Kruskal-Wallis test with tie correction; nulls don't count."""
    ranked = mid_ranks(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(value, group), value)
    groups = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    core = groups.agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = ranked.select(value, "ties").distinct().agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    n = F.col("n").cast("double")  # the cube of a count above two million is too large for a long
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return core.crossJoin(ties).select("n", "n_groups", h.alias("h"), (h / (n - 1)).alias("epsilon_squared"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """(n, chi2, dof, cramers_v, least_expected) of two categorical columns."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy("r").agg(F.sum("o").alias("nr")), cells.groupBy("c").agg(F.sum("o").alias("nc"))
    total = cells.agg(F.sum("o").alias("n"))
    full = rows.crossJoin(columns).join(cells, ["r", "c"], "left").na.fill(0, ["o"]).crossJoin(total)  # as many rows as categories
    e = F.col("nr") * F.col("nc") / F.col("n")
    sums = full.agg(F.max("n").alias("n"), F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi2"), F.countDistinct("r").alias("kr"), F.countDistinct("c").alias("kc"), F.min(e).alias("least_expected"))
    least = F.least("kr", "kc") - 1
    return sums.select("n", "chi2", ((F.col("kr") - 1) * (F.col("kc") - 1)).alias("dof"), F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("n") * least))).alias("cramers_v"), "least_expected")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, n, pearson, spearman) for every pair of columns over rows where both are known.

    The rows are read once and written out by pair of columns; the pairs are the groups of the ranks.
    """
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")) for n, (x, y) in enumerate(pairs)])).alias("_p")
    long = df.select(each).select("_p.*").where("vx is not null and vy is not null")
    ranked = mid_ranks(mid_ranks(long, "vx", "pair").select("pair", "vx", "vy", F.col("rank").alias("rx")), "vy", "pair")
    found = ranked.groupBy("pair").agg(F.count("*").alias("n"), F.corr("vx", "vy").alias("pearson"), F.corr("rx", "rank").alias("spearman"))
    names = df.sparkSession.createDataFrame([(n, x, y) for n, (x, y) in enumerate(pairs)], "pair int, x string, y string")
    return names.join(found, "pair", "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), "pearson", "spearman")


def benjamini_hochberg(p_values: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """(key, p, q, significant): q is the least p * m / rank from this rank on, at most 1. For a table of tests."""
    m = F.count("*").over(W.partitionBy())
    ranked = p_values.select(key, p).withColumn("_r", F.row_number().over(W.orderBy(p, key))).withColumn("_raw", F.col(p) * m / F.col("_r"))
    q = F.least(F.lit(1.0), F.min("_raw").over(W.orderBy("_r").rowsBetween(0, W.unboundedFollowing)))
    return ranked.select(key, p, q.alias("q"), (q <= alpha).alias("significant"))


def missingness(df: DataFrame) -> DataFrame:
    """(variable, n, n_missing, share) for every column; NaN counts as missing."""
    gone = lambda c, t: F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()
    sums = df.agg(F.count("*").alias("_n"), *[F.count_if(gone(c, t)).alias(c) for c, t in df.dtypes])
    long = sums.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing")) for c in df.columns])).alias("p"))
    return long.select("p.variable", F.col("_n").alias("n"), "p.n_missing", (F.col("p.n_missing") / F.col("_n")).alias("share"))


def regularised_gamma_q(a: float, x: float) -> float:
    """Upper tail of the gamma distribution: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or tiny)
        c = (b + k / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi_square_tail(statistic: float, dof: int) -> float:
    return regularised_gamma_q(dof / 2, statistic / 2)


def correlation_matrix(df: DataFrame, columns: Sequence[str]):
    """The k x k matrix of Pearson correlations over complete rows, gathered in one pass of sums."""
    import numpy as np

    k = len(columns)
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    row = whole.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).collect()[0]
    out = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            out[i, j] = out[j, i] = row[f"{i}_{j}"]
    return out


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, vif): the diagonal of the inverse correlation matrix; infinite for exact dependence."""
    import numpy as np

    matrix = correlation_matrix(df, columns)
    singular = np.linalg.matrix_rank(matrix) < len(columns)
    values = [float("inf")] * len(columns) if singular else np.linalg.inv(matrix).diagonal().tolist()
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "variable string, vif double")


def standardised_components(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, variable, loading, eigenvalue, share, kept): principal components of standardised columns.

    A component's largest loading is positive; kept marks eigenvalues above 1. Only the k x k matrix leaves the cluster.
    """
    import numpy as np

    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    rows = []
    for place, at in enumerate(values.argsort()[::-1], 1):
        v = vectors[:, at] * np.sign(vectors[np.abs(vectors[:, at]).argmax(), at])
        rows += [(place, c, float(x), float(values[at]), float(values[at] / len(columns)), bool(values[at] > 1)) for c, x in zip(columns, v)]
    return df.sparkSession.createDataFrame(rows, "component int, variable string, loading double, eigenvalue double, share double, kept boolean")


def rank_sum(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """(n1, n0, u, z) of the Mann-Whitney test of value between rows where the flag holds and where it doesn't."""
    ranked = mid_ranks(df.where(F.col(value).isNotNull()).select(F.col(value), flag.alias("_f")).where("_f is not null"), value)
    sums = ranked.agg(F.count_if("_f").alias("n1"), F.count_if(~F.col("_f")).alias("n0"), F.sum(F.when(F.col("_f"), F.col("rank"))).alias("r"))
    ties = ranked.select(value, "ties").distinct().agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    u, n = F.col("r") - n1 * (n1 + 1) / 2, n1 + n0
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    return sums.crossJoin(ties).select("n1", "n0", u.alias("u"), ((u - n1 * n0 / 2) / spread).alias("z"))


def kendall_by_group(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n_pairs, tau_b) from concordant and discordant pairs inside small groups, such as a series' meetings."""
    a, b = (df.select(by, F.col(x).alias(f"{s}x"), F.col(y).alias(f"{s}y"), F.monotonically_increasing_id().alias(f"{s}i")) for s in "ab")
    sign = F.signum(F.col("ax") - F.col("bx")) * F.signum(F.col("ay") - F.col("by"))
    pairs = a.join(b, by).where("ai < bi")
    sums = pairs.groupBy(by).agg(F.count("*").alias("n_pairs"), F.sum(sign).alias("s"), F.count_if(F.col("ax") != F.col("bx")).alias("px"), F.count_if(F.col("ay") != F.col("by")).alias("py"))
    return sums.select(by, "n_pairs", F.when((F.col("px") > 0) & (F.col("py") > 0), F.col("s") / F.sqrt(F.col("px") * F.col("py"))).alias("tau_b"))


def local_outlier_factors(df: DataFrame, by: str, key: str, columns: Sequence[str], neighbours: int = 20) -> DataFrame:
    """(by, key, factor): density-based outliers inside groups; 1 is usual, more is sparser.

    Of neighbours at equal distance the lower key counts. A task holds a group's points and one row of distances.
    """
    import numpy as np
    import pandas as pd

    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, key)}

    def factors(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        x = frame[list(columns)].to_numpy(float)
        k = min(neighbours, len(x) - 1)
        if k < 1:
            return frame[[by, key]].assign(factor=1.0)
        # Points at one place share their distances: each place gives its first k + 1 points, and the k + 1 nearest of
        # these are enough for every point there, itself left out.
        places, at = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.r_[np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]), len(x)]
        near, dist = np.empty((len(x), k), np.int64), np.empty((len(x), k))
        enough = min(k + 1, len(places))
        for place in range(len(places)):
            d = np.sqrt(((places - places[place]) ** 2).sum(-1))
            close = np.flatnonzero(d <= np.partition(d, enough - 1)[enough - 1])
            points = np.concatenate([order[starts[c] : min(starts[c] + k + 1, starts[c + 1])] for c in close])
            away = d[at[points]]
            first = np.lexsort((points, away))[: k + 1]
            points, away = points[first], away[first]
            own = order[starts[place] : starts[place + 1]]
            near[own], dist[own] = points[:k], away[:k]
            for j in np.flatnonzero(at[points[:k]] == place):
                near[points[j]], dist[points[j]] = np.delete(points, j), np.delete(away, j)
        radius = dist[:, -1]
        reach = np.maximum(dist, radius[near])
        density = 1 / np.maximum(reach.mean(1), 1e-10)
        return frame[[by, key]].assign(factor=density[near].mean(1) / density)

    return df.select(by, key, *columns).na.drop().groupBy(by).applyInPandas(factors, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, factor double")


def line_outliers(df: DataFrame, column: str, neighbours: int = 20, contamination: float = 0.05) -> DataFrame:
    """(column, lof, lof_flag, robust_sq, mcd_flag) for each distinct value of one numeric column, exactly.

    lof is the density-based factor (1 is usual), flagged above its 1 - contamination quantile over all rows; of
    neighbours at equal distance the lower value counts. robust_sq is the squared distance under the minimum covariance
    determinant, which for one column is the shortest half; it is corrected by the median, reweighted and flagged above
    the 0.975 quantile of chi-square. One task sees one count per distinct value. Nulls and NaN are not scored; fewer
    than three rows or a constant column give no rows.
    """
    import numpy as np
    import pandas as pd

    half, far = 0.45493642311957283, 5.023886187314888  # chi-square of one degree: quantiles 0.5 and 0.975

    def at(cum: np.ndarray, v: np.ndarray, place):
        return v[np.searchsorted(cum, place, "right")]

    def quantile(v: np.ndarray, c: np.ndarray, q: float) -> float:
        order = np.argsort(v, kind="stable")
        cum, place = np.cumsum(c[order]), q * (c.sum() - 1)
        low = at(cum, v[order], int(place))
        return low + (at(cum, v[order], min(int(place) + 1, c.sum() - 1)) - low) * (place - int(place))

    def flags(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_v")
        v, c = frame["_v"].to_numpy(float), frame["_n"].to_numpy(np.int64)
        n = int(c.sum())
        if n < 3 or len(v) < 2:
            return pd.DataFrame({"_v": [], "lof": [], "lof_flag": [], "robust_sq": [], "mcd_flag": []}).astype({"lof_flag": bool, "mcd_flag": bool})
        x = (v - np.average(v, weights=c)) / np.sqrt(np.average((v - np.average(v, weights=c)) ** 2, weights=c))

        k = min(neighbours, n - 1)
        kept = np.minimum(c, k + 1)  # more copies than that change no point's neighbours
        copies, group = np.repeat(x, kept), np.repeat(np.arange(len(x)), kept)
        first = np.cumsum(kept) - kept
        near = first[:, None] + np.r_[-k:0, 1 : 2 * k + 1]
        inside = (near >= 0) & (near < len(copies))
        near = np.clip(near, 0, len(copies) - 1)
        d = np.where(inside, np.abs(copies[near] - x[:, None]), np.inf)
        best = np.argsort(d, 1, kind="stable")[:, :k]
        d, near = np.take_along_axis(d, best, 1), group[np.take_along_axis(near, best, 1)]
        density = 1 / (np.maximum(d, d[near, -1]).mean(1) + 1e-10)
        lof = density[near].mean(1) / density

        h, cum = -(-(n + 2) // 2), np.cumsum(c)
        if h < n:
            starts = np.unique(np.r_[0, cum, cum - h])
            starts = starts[(starts >= 0) & (starts < n - h)]
            width, low, high = np.diff(np.r_[starts, n - h]), at(cum, x, starts), at(cum, x, starts + h)
            least = high - low == (high - low).min()
            centre = np.average((high + low)[least] / 2, weights=width[least])
            order = np.argsort(np.abs(x - centre), kind="stable")
            share = np.zeros(len(x))
            share[order] = np.clip(h - (np.cumsum(c[order]) - c[order]), 0, c[order])
        else:
            share, centre = c.astype(float), np.average(x, weights=c)
        spread = np.average((x - np.average(x, weights=share)) ** 2, weights=share)
        robust = (x - centre) ** 2 / max(spread, 1e-300)
        middle = quantile(robust, c, 0.5) / half
        core = c * (robust / max(middle, 1e-300) < far)
        centre = np.average(x, weights=core)
        robust = (x - centre) ** 2 / max(np.average((x - centre) ** 2, weights=core), 1e-300)
        return pd.DataFrame({"_v": v, "lof": lof, "lof_flag": lof > quantile(lof, c, 1 - contamination), "robust_sq": robust, "mcd_flag": robust > far})

    value = F.col(column).cast("double")
    counts = df.select(value.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    return counts.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(flags, "_v double, lof double, lof_flag boolean, robust_sq double, mcd_flag boolean").withColumnRenamed("_v", column)
