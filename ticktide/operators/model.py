"""Scorecard measures and models: KS, AUC, stability, information, logistic regression, lasso, clustering."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.operators import binning
from ticktide.operators.quantiles import quantiles
from ticktide.operators.relational import fill_missing
from ticktide.operators.scan import running_totals

def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("bad"), F.sum((F.col(label) == 0).cast("long")).alias("good"))


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the largest lead of the good rows' share over the bad rows' share, by ascending score."""
    groups = running_totals(_by_score(df, score, label), "s", ["bad", "good"])
    bad, good = (F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"{c}_whole")) for c in ("bad", "good"))
    return groups.withColumn("gap", good - bad).agg(F.greatest(F.max("gap"), F.lit(0.0)).alias("ks"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the chance that a bad row scores above a good one, ties half."""
    groups = running_totals(_by_score(df, score, label), "s", ["good"])
    won = groups.withColumn("won", F.col("bad") * (2 * F.col("good_before") + F.col("good")))
    return won.agg(F.try_divide(F.sum("won"), 2 * F.sum("bad") * F.sum("good")).alias("auc"))


def psi(df: DataFrame, bin_col: str, sample: str, base: str | None = None) -> DataFrame:
    """Rows (sample, psi) of every other sample against `base`, or of every sample against all rows; counts are raised by one half.

    Bins that a sample lacks count with one half there.
    """
    counts = df.filter(F.col(sample).isNotNull()).groupBy(bin_col, sample).count()
    names = sorted(r[0] for r in counts.select(sample).distinct().collect())
    held = counts.groupBy(bin_col).agg(F.map_from_entries(F.collect_list(F.struct(sample, "count"))).alias("_m"), F.sum("count").alias("_whole"))
    of = lambda name: F.coalesce(F.try_element_at("_m", F.lit(name)), F.lit(0))
    cells = F.array(*[F.struct(F.lit(n).alias(sample), of(n).alias("count")) for n in names if n != base])
    rows = held.select(bin_col, (F.col("_whole") if base is None else of(base)).alias("_ref"), F.explode(cells).alias("_c"))
    full = rows.select(bin_col, "_ref", F.col("_c")[sample].alias(sample), F.col("_c")["count"].alias("count"))
    own = Window.partitionBy(sample)
    share, ref = ((F.col(c) + 0.5) / F.sum(F.col(c) + 0.5).over(own) for c in ("count", "_ref"))
    terms = full.select(sample, share.alias("share"), ref.alias("ref"))
    return terms.groupBy(sample).agg(F.sum((F.col("share") - F.col("ref")) * F.log(F.col("share") / F.col("ref"))).alias("psi"))


def largest_psi(df: DataFrame, bin_col: str, sample: str) -> DataFrame:
    """One row: the largest index of a sample against all rows."""
    return psi(df, bin_col, sample).agg(F.max("psi").alias("psi"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the entropy of the columns' joint distribution, in nats: log n - sum(c log c) / n over the counts c."""
    counts = df.groupBy(*columns).count()
    n = F.sum("count")
    return counts.agg((F.log(n) - F.sum(F.col("count") * F.log("count")) / n).alias("entropy"))


def _signed_entropies(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row: entropies of all subsets of the columns, summed with signs that alternate by size, the whole set's negative.

    One pass over the joint counts by grouping sets, so no group of all rows meets in one task.
    """
    named = {c: f"_k{i}" for i, c in enumerate(columns)}
    joint = df.select(*[F.col(c).alias(k) for c, k in named.items()]).groupBy(*named.values()).agg(F.count(F.lit(1)).alias("_n"))
    columns = list(named.values())
    sets = [list(s) for k in range(1, len(columns) + 1) for s in combinations(columns, k)]
    counts = joint.groupingSets(sets, *columns).agg(F.sum("_n").alias("c"), F.grouping_id().alias("g"))
    n = F.sum("c")
    each = counts.groupBy("g").agg((F.log(n) - F.sum(F.col("c") * F.log("c")) / n).alias("h"))
    return each.agg(F.sum(F.when(F.bit_count("g") % 2 == 0, -F.col("h")).otherwise(F.col("h"))).alias(name))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the mutual information of two columns, in nats."""
    return _signed_entropies(df, [a, b], "mutual_information")


def lift(df: DataFrame, bin_col: str, label: str) -> DataFrame:
    """Rows per bin: cnt, bad, share of rows, share of bad rows, lift."""
    out = df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("cnt"), F.sum((F.col(label) == 1).cast("long")).alias("bad"))
    n, bad = out.agg(F.sum("cnt"), F.sum("bad")).first()
    out = out.withColumns({"cnt_share": F.try_divide("cnt", F.lit(n)), "bad_share": F.try_divide("bad", F.lit(bad))})
    return out.withColumn("lift", F.try_divide("bad_share", "cnt_share"))


def moments(df: DataFrame, xs: list[str], label: str, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient X'(y - p) and Hessian X'WX of the logistic loss (intercept last), in one aggregate."""
    cols = [F.col(x).cast("double") for x in xs] + [F.lit(1.0)]
    z = F.lit(0.0)
    for c, w in zip(cols, coef.tolist(), strict=True):
        z = z + c * F.lit(w)
    rows = df.select(*[c.alias(f"x{k}") for k, c in enumerate(cols)], F.col(label).cast("double").alias("y"), (1 / (1 + F.exp(-z))).alias("p")).dropna()
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col("p") * (1 - F.col("p"))
    sums = rows.agg(
        *[F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(k)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * w).alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    grad = np.array([sums[f"g{i}"] or 0.0 for i in range(k)])
    hess = np.zeros((k, k))
    for i, j in pairs:
        hess[i, j] = hess[j, i] = sums[f"h{i}_{j}"] or 0.0
    return grad, hess


def logistic(df: DataFrame, xs: list[str], label: str, c: float = 1e6, rounds: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (intercept last) by Newton steps with ridge 1 / c; each step is one pass."""
    coef = np.zeros(len(xs) + 1) if start is None else start.copy()
    ridge = np.diag([1 / c] * len(xs) + [0.0])
    for _ in range(rounds):
        grad, hess = moments(df, xs, label, coef)
        step = np.linalg.pinv(hess + ridge) @ (grad - ridge @ coef)
        coef = coef + step
        if np.abs(step).max() < 1e-9:
            break
    return coef


def add_angle(df: DataFrame, used: list[str], more: list[str], label: str, coef: np.ndarray) -> dict[str, float]:
    """For each further column: the cosine, in the Hessian's metric, of its part beyond the used ones to the gradient."""
    xs = [*used, *more]
    full = np.concatenate([coef[:-1], np.zeros(len(more)), coef[-1:]])
    grad, hess = moments(df, xs, label, full)
    inner = [*range(len(used)), len(xs)]
    out = {}
    for k, name in enumerate(more):
        at = len(used) + k
        own = hess[at, at] - hess[at, inner] @ np.linalg.pinv(hess[np.ix_(inner, inner)]) @ hess[inner, at]
        out[name] = float(grad[at] / math.sqrt(own)) if own > 1e-12 else 0.0
    return out


def stepwise(df: DataFrame, xs: list[str], label: str, most: int = 10, least: float = 2.0, positive: bool = True) -> tuple[list[str], np.ndarray]:
    """Adds the column with the largest angle and refits; drops columns with a negative coefficient."""
    used: list[str] = []
    dropped: set[str] = set()
    coef = logistic(df, [], label)
    while len(used) < most:
        left = [x for x in xs if x not in used and x not in dropped]
        if not left:
            break
        angles = add_angle(df, used, left, label, coef)
        best = max(left, key=lambda x: angles[x] if positive else abs(angles[x]))
        if (angles[best] if positive else abs(angles[best])) < least:
            break
        used.append(best)
        coef = logistic(df, used, label, start=np.concatenate([coef[:-1], [0.0], coef[-1:]]))
        while positive and len(used) > 1 and coef[:-1].min() < 0:
            gone = used.pop(int(coef[:-1].argmin()))
            dropped.add(gone)
            coef = logistic(df, used, label)
    return used, coef


def lasso(df: DataFrame, xs: list[str], y: str, alpha: float):
    """Spark ML's lasso on standardised columns."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=xs, outputCol="_raw").transform(df.select(*xs, y).dropna())
    rows = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows)
    return LinearRegression(featuresCol="_x", labelCol=y, elasticNetParam=1.0, regParam=alpha, standardization=False).fit(rows)


def boosted_trees(df: DataFrame, xs: list[str], y: str, order: list[str], rounds: int = 20, depth: int = 5):
    """Gradient-boosted regression on the first 60 % of the rows in order; (model, valid, test) with 20 % each."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=xs, outputCol="_x").transform(df.dropna(subset=[*xs, y]))
    cuts = quantiles(rows, {"t": F.unix_micros(F.col(order[0]).cast("timestamp"))}, [0.6, 0.8])["t"]
    t = F.unix_micros(F.col(order[0]).cast("timestamp"))
    model = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=rounds, maxDepth=depth, seed=1).fit(rows.filter(t <= cuts[0]))
    return model, model.transform(rows.filter((t > cuts[0]) & (t <= cuts[1]))), model.transform(rows.filter(t > cuts[1]))


def cluster_columns(corr: np.ndarray, names: list[str], linkage: str = "average") -> list[tuple[str, str, float]]:
    """Merges (a, b, distance) of columns by 1 - r squared; a small matrix on the driver."""
    dist = 1 - np.asarray(corr, dtype=float) ** 2
    np.fill_diagonal(dist, np.inf)
    labels, sizes, out = list(names), [1] * len(names), []
    while len(labels) > 1:
        i, j = sorted(divmod(int(dist.argmin()), len(labels)))
        out.append((labels[i], labels[j], float(dist[i, j])))
        a, b = sizes[i], sizes[j]
        new = np.minimum(dist[i], dist[j]) if linkage == "min" else (a * dist[i] + b * dist[j]) / (a + b)
        dist[i], dist[:, i] = new, new
        dist[i, i] = np.inf
        dist = np.delete(np.delete(dist, j, 0), j, 1)
        labels[i], sizes[i] = f"({labels[i]},{labels[j]})", a + b
        del labels[j], sizes[j]
    return out


def split(df: DataFrame, key: str, shares: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows by a hash of `key`, so that a row's part never changes."""
    place = F.pmod(F.xxhash64(key), F.lit(10_000)) / 10_000
    a, b = shares[0], shares[0] + shares[1]
    return df.filter(place < a), df.filter((place >= a) & (place < b)), df.filter(place >= b)


def tsi(df: DataFrame, column: str, label: str, sample: str, bins: list[binning.Bin]) -> DataFrame:
    """One row: how much a value's weight of evidence varies (sample deviation, mean over all rows) between samples."""
    k = binning.bin_index(F.col(column), bins).alias("bin")
    counts = df.groupBy(k, sample).agg(F.sum((F.col(label) == 1).cast("long")).alias("bad"), F.sum((F.col(label) == 0).cast("long")).alias("good"), F.count(F.lit(1)).alias("n")).filter("bin IS NOT NULL")
    own = Window.partitionBy(sample)
    good = F.sum("good").over(own)
    base = F.log((F.sum("bad").over(own) + 0.5) / F.when(good > 0, good).otherwise(0.5))
    woe = counts.withColumn("woe", F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - base)
    by_bin = woe.groupBy("bin").agg(F.stddev_samp("woe").alias("s"), F.sum("n").alias("n"))
    return by_bin.agg(F.try_divide(F.sum(F.coalesce("s", F.lit(0.0)) * F.col("n")), F.sum("n")).alias("tsi"))


def score_bands(df: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """Rows (bin_name, bin, cnt, mean_<label>, lift) of equal-frequency bands of a score."""
    bands = binning.bin_table(df, score, [label], parts)
    rate = df.filter(F.col(score).isNotNull()).agg(F.avg(label)).first()[0]
    return bands.withColumn("lift", F.try_divide(F.col(f"mean_{label}"), F.lit(rate).cast("double")))


def interaction(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """One row: the interaction information of three columns, in nats: H(abc) signs with pairs and singles."""
    return _signed_entropies(df, [a, b, c], "interaction")



def cross_validated_angles(df: DataFrame, used: list[str], more: list[str], label: str, key: str, folds: int = 3) -> dict[str, float]:
    """The smallest angle of each further column over models fitted without one fold and judged on it."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    found: list[dict[str, float]] = []
    for k in range(folds):
        coef = logistic(df.filter(fold != k), used, label)
        found.append(add_angle(df.filter(fold == k), used, more, label, coef))
    return {x: min(f[x] for f in found) for x in more}


def angles(df: DataFrame, xs: list[str], label: str, used: list[str], coef: np.ndarray) -> dict[str, float]:
    """For each column: the cosine, in the Hessian's metric, of its direction to the best one that all columns span.

    One pass; `coef` is that of the used columns, intercept last. The number of columns bounds what reaches the driver.
    """
    of = dict(zip(used, coef[:-1].tolist(), strict=True))
    grad, hess = moments(df, xs, label, np.array([*(of.get(x, 0.0) for x in xs), coef[-1]]))
    g, h = grad[:-1], hess[:-1, :-1]
    best = np.linalg.pinv(h) @ g
    inner, size = h @ best, float(best @ h @ best)
    return {x: float(inner[k] / math.sqrt(size * h[k, k])) if size > 0 and h[k, k] > 0 else 0.0 for k, x in enumerate(xs)}


def stepwise_scaled(df: DataFrame, xs: list[str], label: str, least: float, valid: list[DataFrame] | None = None, valid_least: float = 0.5, c: float = 0.1, most: int | None = None) -> list[dict]:
    """Adds the column of the largest angle times the root of the number of columns left, down to `least`; then drops columns of negative angle.

    With validation samples, only columns whose scaled angle exceeds `valid_least` on each of them are candidates.
    Returns the steps: used columns, coefficients (intercept last), the column added and its scaled angle.
    """
    used: list[str] = []
    gone: set[str] = set()
    coef = logistic(df, [], label, c)
    steps: list[dict] = []
    while len(used) < (len(xs) if most is None else most):
        root = math.sqrt(len(xs) - len(used))
        own = {x: a * root for x, a in angles(df, xs, label, used, coef).items() if x not in used and x not in gone}
        for sample in valid or ():
            there = angles(sample, xs, label, used, coef)
            own = {x: a for x, a in own.items() if there[x] * root > valid_least}
        if not own or (new := max(own, key=own.__getitem__)) is None or own[new] < least:
            break
        used.append(new)
        coef = logistic(df, used, label, c, start=np.concatenate([coef[:-1], [0.0], coef[-1:]]))
        while used and min(left := [a for x, a in angles(df, xs, label, used, coef).items() if x in used]) < -1e-9:
            at = [x for x in xs if x in used][left.index(min(left))]
            used.remove(at)
            gone.add(at)
            coef = logistic(df, used, label, c)
        steps.append({"added": new, "angle": own[new], "columns": list(used), "coefficients": coef})
    return steps


def sample_counts(df: DataFrame, bins: dict[str, binning.Fitted], label: str, samples: dict[str, Column]) -> DataFrame:
    """Rows (column, sample, bin, cnt, bad, good) of bins fitted once, counted for every sample in one pass.

    Samples are conditions and may overlap; the sample 'all' is every row, and a row without bin (null) is the
    total of its column and sample, values that fall in no bin included. Each row of the table meets its columns and samples in
    a map-side aggregate, so what is shuffled is columns x samples x bins.
    """
    names = list(bins)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(binning.bin_index(F.col(c), b), F.lit(-1)).alias("bin")) for c, b in bins.items()]).cast("array<struct<column:string,bin:int>>")
    inside = F.array_compact(F.array(F.lit("all"), *[F.when(cond, F.lit(n)) for n, cond in samples.items()]))
    rows = df.select(F.explode(inside).alias("sample"), cells.alias("cells"), (F.col(label) == 1).cast("long").alias("_bad"), (F.col(label) == 0).cast("long").alias("_good"))
    rows = rows.select("sample", F.explode("cells").alias("c"), "_bad", "_good").select("c.*", "sample", "_bad", "_good")
    keys = [F.col("column"), F.col("sample"), F.col("bin")]
    out = rows.groupingSets([keys, keys[:2]], *keys).agg(F.grouping("bin").alias("whole"), F.count(F.lit(1)).alias("cnt"), F.sum("_bad").alias("bad"), F.sum("_good").alias("good"))
    return out.filter("whole = 1 OR bin >= 0").drop("whole") if names else out.drop("whole").limit(0)


def sample_report(df: DataFrame, bins: dict[str, binning.Fitted], label: str, samples: dict[str, Column]) -> DataFrame:
    """`sample_counts` with each bin's name, share of its sample, bad rate and weight of evidence in it."""
    counts = sample_counts(df, bins, label, samples)
    whole = counts.filter("bin IS NULL").select("column", "sample", F.col("cnt").alias("_n"), F.col("bad").alias("_b"), F.col("good").alias("_g"))
    named = df.sparkSession.createDataFrame([(c, k, b.name) for c, own in bins.items() for k, b in enumerate(own)], "column string, bin int, bin_name string")
    base = F.log((F.col("_b") + 0.5) / F.when(F.col("_g") > 0, F.col("_g")).otherwise(0.5))
    rows = counts.filter("bin IS NOT NULL").join(whole, ["column", "sample"]).join(named, ["column", "bin"])
    return rows.select(
        "column", "sample", "bin", "bin_name", "cnt", "bad", "good", F.try_divide("cnt", "_n").alias("share"), (F.col("bad") / (F.col("cnt") + 0.5)).alias("mean"),
        (F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - base).alias("woe"),
    )


def scorecard(df: DataFrame, columns: list[str], label: str, key: str, parts: int = 20, least: int = 100, most: int = 10, angle: float | None = None, samples: dict[str, Column] | None = None) -> dict:
    """Type guess, binning, weights of evidence, stepwise choice and report of a scorecard.

    Text columns of numbers become numbers first; those of other text are left out. Bins are fitted on the training part alone and counted once
    more for each sample. With `angle` columns are chosen by scaled angles, checked on the validation part.
    Returns its bins, the counts by sample, chosen columns, coefficients and per part of the data (train, valid, test) KS and AUC.
    """
    df = fill_missing(df, [c for c, kind in df.dtypes if c in columns and kind == "string"]) if any(kind == "string" for c, kind in df.dtypes if c in columns) else df
    columns = [c for c in columns if dict(df.dtypes)[c] != "string"]
    parts_ = dict(zip(("train", "valid", "test"), split(df, key), strict=True))
    bins = {c: binning.woe_bins(parts_["train"], c, label, parts, least) for c in columns}
    bins = {c: b for c, b in bins.items() if len(b) > 1}
    coded = {}
    for name, rows in parts_.items():
        for c, b in bins.items():
            rows = binning.apply_woe(rows, c, b, f"woe_{c}").withColumn(f"woe_{c}", F.coalesce(f"woe_{c}", F.lit(0.0)))
        coded[name] = rows
    xs = [f"woe_{c}" for c in bins]
    if angle is None:
        used, coef = stepwise(coded["train"], xs, label, most)
    else:
        steps = stepwise_scaled(coded["train"], xs, label, angle, [coded["valid"]], most=most)
        used, coef = (steps[-1]["columns"], steps[-1]["coefficients"]) if steps else ([], logistic(coded["train"], [], label))
    score = sum((F.col(x) * F.lit(float(w)) for x, w in zip(used, coef, strict=False)), F.lit(float(coef[-1])))
    report = {}
    for name, rows in coded.items():
        scored = rows.withColumn("_score", score)
        report[name] = {"ks": ks(scored, "_score", label).first()["ks"], "auc": auc(scored, "_score", label).first()["auc"]}
    return {"bins": bins, "counts": sample_report(df, bins, label, samples or {}), "columns": used, "coefficients": coef, "report": report, "coded": coded, "score": score}
