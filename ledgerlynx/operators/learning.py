"""Model training and evaluation with MLlib, drift and data quality."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .ordering import running


def split(df: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """M2: a stratified split by the rank of a hash within each label; the same rows at every run. Ranks are running counts over ranges, so a label
    of very many rows is no single task; the rows are written once."""
    ranked = running(df.withColumn("_order", F.struct(F.md5(F.col(key).cast("string")), F.col(key))), "_order", {"_place": F.lit(1)}, by=(label,))
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))  # one row a label
    out = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))
    return out.select(*df.columns, F.when(F.col("_place") <= F.floor(F.col("_n") * share), "train").otherwise("test").alias("part"))


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """M1: the features in the order of their names, missing as 0."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=sorted(columns), outputCol="features").transform(filled)


def ensemble(train: DataFrame, label: str, weights=(0.35, 0.35, 0.30)):
    """M4: three tree models with class weights; a function that scores rows with the weighted mean."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    balanced = train.withColumn("row_weight", F.when(F.col(label) == 1, (1 - share) / max(share, 1e-9)).otherwise(1.0))
    shared = {"featuresCol": "features", "labelCol": label, "weightCol": "row_weight", "seed": 7}
    models = [GBTClassifier(maxIter=10, maxDepth=3, **shared).fit(balanced), GBTClassifier(maxIter=10, maxDepth=5, stepSize=0.2, **shared).fit(balanced), RandomForestClassifier(numTrees=20, maxDepth=6, **shared).fit(balanced)]

    def score(rows: DataFrame) -> DataFrame:
        out, total = rows, F.lit(0.0)
        for k, (m, w) in enumerate(zip(models, weights, strict=True)):
            m = m.setPredictionCol(f"p{k}").setProbabilityCol(f"q{k}").setRawPredictionCol(f"r{k}")
            out = m.transform(out).withColumn(f"s{k}", vector_to_array(f"q{k}")[1]).drop(f"p{k}", f"q{k}", f"r{k}")
            total = total + w * F.col(f"s{k}")
        return out.withColumn("score", total).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))

    return score


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """M6: by average ranks; ties share theirs. Ranks come from counts of each distinct score."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = running(by, "s", {"up_to": F.col("n")}).withColumn("rank", F.col("up_to") - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return ranked.agg(((F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def error_profile(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """M9: df: class and features. The largest mean features of false positives and negatives."""
    means = df.where(F.col("class").isin("FP", "FN")).groupBy("class").agg(*(F.avg(c).alias(c) for c in columns)).unpivot("class", columns, "feature", "mean")
    order = Window.partitionBy("class").orderBy(F.abs("mean").desc(), "feature")
    return means.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def ks(reference: DataFrame, current: DataFrame, c: str) -> DataFrame:
    """The largest gap between two empirical distributions; counts of each distinct value, then running sums."""
    both = reference.select(F.col(c).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(current.select(F.col(c), F.lit(0), F.lit(1)))
    by = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = by.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    sums = running(by.withColumn("v", F.col("v").cast("double")), "v", {"x": F.col("a"), "y": F.col("b")})
    return sums.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("x") / F.col("ta") - F.col("y") / F.col("tb"))).alias("ks"))


def chi_square(reference: DataFrame, current: DataFrame, c: str) -> DataFrame:
    """For categories."""
    both = reference.select(F.col(c).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(current.select(F.col(c), F.lit(0), F.lit(1)))
    by = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = by.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    x = by.crossJoin(F.broadcast(total)).withColumn("n", F.col("a") + F.col("b")).withColumn("t", F.col("ta") + F.col("tb"))

    def term(o, t):
        e = F.col("n") * F.col(t) / F.col("t")
        return (F.col(o) - e) * (F.col(o) - e) / e

    return x.agg(F.sum(term("a", "ta") + term("b", "tb")).alias("chi_square"), (F.count("*") - 1).alias("freedom"))


def drift(reference: DataFrame, current: DataFrame, numeric: list[str], categories: list[str] = (), gap: float = 0.1, least_p: float = 0.05) -> DataFrame:
    """Of all features in one pass: feature, kind, statistic, freedom, drifted.

    Features become rows (feature, value, how often before and now). Numeric ones drift if the largest gap between their distributions
    (KS) is above `gap`; its running sums are keyed by the feature and dealt by ranges of the values, so many features and many values are
    one job. Categories drift if chi-square is above its quantile at 1 - `least_p`, by the cube-root approximation. Null values are left out of numeric ones and
    are a category of their own."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"), F.lit(None).cast("string").alias("w")) for c in numeric]
    pairs += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("v"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("w")) for c in categories]
    sides = [d.select(F.inline(F.array(*pairs))).withColumns({"a": F.lit(a), "b": F.lit(1 - a)}) for d, a in ((reference, 1), (current, 0))]
    by = sides[0].unionByName(sides[1]).where("v IS NOT NULL OR w IS NOT NULL").groupBy("feature", "v", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = cut(by)
    totals = by.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row a feature
    sums = running(by.where("w IS NULL"), "v", {"x": F.col("a"), "y": F.col("b")}, by=("feature",)).join(totals, "feature")
    ks_of = sums.groupBy("feature").agg(F.max(F.abs(F.try_divide("x", "ta") - F.try_divide("y", "tb"))).alias("statistic"))
    ks_of = ks_of.select("feature", F.lit("ks").alias("kind"), "statistic", F.lit(None).cast("long").alias("freedom"), (F.col("statistic") > gap).alias("drifted"))
    t = F.col("ta") + F.col("tb")

    def term(o, side):
        e = (F.col("a") + F.col("b")) * F.col(side) / t
        return (F.col(o) - e) * (F.col(o) - e) / e

    chi = by.where("w IS NOT NULL").join(totals, "feature").groupBy("feature").agg(F.sum(term("a", "ta") + term("b", "tb")).alias("statistic"), (F.count("*") - 1).alias("freedom"))
    k = F.col("freedom").cast("double")
    limit = k * F.pow(1 - F.try_divide(F.lit(2.0), 9 * k) + NormalDist().inv_cdf(1 - least_p) * F.sqrt(F.try_divide(F.lit(2.0), 9 * k)), F.lit(3.0))
    chi = chi.select("feature", F.lit("chi_square").alias("kind"), "statistic", "freedom", F.coalesce(F.col("statistic") > limit, F.lit(False)).alias("drifted"))
    return ks_of.unionByName(chi)


def robustness(df: DataFrame, columns: list[str], scorer, key: str, scale: float = 0.05) -> DataFrame:
    """The share of predictions that a small, repeatable noise flips, with its band."""
    noise = {c: F.col(c).cast("double") * (1 + scale * (F.pmod(F.xxhash64(key, F.lit(c)), F.lit(2001)) / 1000 - 1)) for c in columns}
    a, b = scorer(df).select(key, F.col("prediction").alias("before")), scorer(df.withColumns(noise)).select(key, F.col("prediction").alias("after"))
    out = a.join(b, key).agg(F.avg((F.col("before") != F.col("after")).cast("double")).alias("flips"))
    r = 1 - F.col("flips")
    return out.select("flips", r.alias("robustness"), F.when(r >= 0.9, "robust").when(r >= 0.7, "fair").when(r >= 0.5, "weak").otherwise("poor").alias("band"))


def robustness_report(df: DataFrame, perturbed: dict[str, Column], scorer, key: str, label: str = "label", share: float = 0.95) -> DataFrame:
    """One row: accuracy before and after the perturbation of some columns, the share of predictions that it flips, its mean length, the share of rows
    that it moves farther than a percentile of its lengths, the false positive rate after it, robustness and its band. No labelled negatives: rate 0.

    Rows are scored twice and stand side by side; predictions are 0 or 1. Everything is one aggregate after one percentile."""
    moved = sum(((c.cast("double") - F.col(n).cast("double")) * (c.cast("double") - F.col(n).cast("double")) for n, c in perturbed.items()), F.lit(0.0))
    before = scorer(df.withColumn("_moved", F.sqrt(moved))).select(key, F.col(label).alias("y"), "_moved", F.col("prediction").alias("before"))
    both = before.join(scorer(df.withColumns(perturbed)).select(key, F.col("prediction").alias("after")), key)
    limit = both.agg(F.percentile("_moved", F.lit(share)).alias("limit"))  # one row
    mean = lambda c: F.avg(c.cast("double"))
    negative = F.col("y") == 0
    out = both.crossJoin(F.broadcast(limit)).agg(
        mean(F.col("before") == F.col("y")).alias("accuracy_before"), mean(F.col("after") == F.col("y")).alias("accuracy_after"), mean(F.col("before") != F.col("after")).alias("flips"),
        F.avg("_moved").alias("perturbation"), mean(F.col("_moved") > F.col("limit")).alias("detected"), F.coalesce(F.try_divide(F.count_if(negative & (F.col("after") == 1)), F.count_if(negative)), F.lit(0.0)).alias("fpr"),
    )
    r = 1 - F.col("flips")
    return out.withColumns({"robustness": r, "band": F.when(r >= 0.9, "robust").when(r >= 0.7, "fair").when(r >= 0.5, "weak").otherwise("poor")})


def compare_robustness(df: DataFrame, columns: list[str], scorers: dict, key: str, scale: float = 0.05) -> DataFrame:
    """M14 for each named scorer."""
    found = [robustness(df, columns, f, key, scale).withColumn("scorer", F.lit(name)) for name, f in scorers.items()]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def reducer(df: DataFrame, columns: list[str], k: int = 20):
    """M3: a fitted pipeline from the columns to `reduced`: assembled by name, scaled to mean 0 and deviation 1, then at most k principal components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    steps = [
        VectorAssembler(inputCols=sorted(columns), outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=min(k, len(columns)), inputCol="scaled", outputCol="reduced"),
    ]
    return Pipeline(stages=steps).fit(df)


def save_model(model, path: str) -> None:
    """A fitted pipeline, over an older one at the same place."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """M11."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def quantiles(x: DataFrame, values: list[Column], share: float, weight: Column | None = None, bins: int = 1024) -> list[float | None]:
    """Of each value the least one that at least the share of all weight does not exceed, exactly; None without rows.

    The range that holds it is cut into bins, whose sums tell the one to go on with, until that holds a single value: some aggregates of at
    most `bins` rows a value, however many rows there are. What is not finite counts as 1e300 (NaN too) or -1e300."""
    v = F.least(F.greatest(F.col("v"), F.lit(-1e300)), F.lit(1e300))
    long = x.select((F.lit(1) if weight is None else weight).alias("w"), F.posexplode(F.array(*values)).alias("i", "v")).where("v IS NOT NULL").withColumn("v", v)
    per = [F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    at = {r["i"]: [r["low"], r["high"], max(1, int(np.ceil(share * r["n"])))] for r in long.groupBy("i").agg(*per).collect()}
    while wide := [i for i, (low, high, _) in at.items() if low < high]:
        low, high = (F.element_at(F.array(*(F.lit(float(at[i][k]) if i in wide else 0.0) for i in range(len(values)))), F.col("i") + 1) for k in (0, 1))
        inside = long.where(F.col("i").isin(wide) & F.col("v").between(low, high))
        place = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
        found = inside.groupBy("i", place.alias("bin")).agg(*per).orderBy("bin").collect()
        for i in wide:
            left = at[i][2]
            for r in (r for r in found if r["i"] == i):
                if r["n"] >= left:
                    at[i] = [r["low"], r["high"], left]
                    break
                left -= r["n"]
    return [at[i][0] if i in at else None for i in range(len(values))]


def _sums(x: DataFrame, width: int, weight: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows, their mean and their covariance, from one aggregate of width squared sums."""
    w = F.lit(1) if weight is None else weight
    one, two = [F.sum(w * F.col("x")[i]) for i in range(width)], [F.sum(w * F.col("x")[i] * F.col("x")[j]) for i in range(width) for j in range(i + 1)]
    got = x.agg(F.sum(w), *one, *two).first()
    n, one, two = got[0] or 0, got[1 : 1 + width], got[1 + width :]
    mean = np.array(one, float) / max(1, n)
    scatter = np.zeros((width, width))
    scatter[np.tril_indices(width)] = np.array(two, float) / max(1, n)
    scatter = scatter + np.tril(scatter, -1).T - np.outer(mean, mean)
    return n, mean, scatter


def _distance(mean: np.ndarray, scatter: np.ndarray, floor: float) -> tuple[Column, float]:
    """The squared distance of the array column x, and the logarithm of the scatter's determinant. Flat directions count as if they had the floor's variance."""
    values, vectors = np.linalg.eigh(scatter)
    values = np.maximum(values, floor)
    terms = []
    for value, vector in zip(values, vectors.T, strict=True):
        along = sum(((F.col("x")[i] - float(mean[i])) * float(vector[i]) for i in range(len(mean))), F.lit(0.0))
        terms.append(along * along / float(value))
    return sum(terms, F.lit(0.0)), float(np.log(values).sum())


def robust_scatter(x: DataFrame, width: int, share: float = 0.5, steps: int = 20, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, Column]:
    """M5: centre, scatter and squared distance by the minimum covariance determinant of the array column x, over all rows.

    A concentration step takes the mean and covariance of the `share` of rows that are nearest by the last ones; it never raises the
    determinant, and steps go on until that stands still. They start from medians and median deviations, and from the mean and covariance of
    all rows; the smaller determinant counts. Each step is one quantile and one aggregate of width squared sums. The scatter is scaled so that
    the median distance is that of a normal distribution. A covariance without variance in some direction is kept above a floor.
    weight: how many rows a row stands for."""
    n, mean, scatter = _sums(x, width, weight)
    floor = max(1e-12, 1e-6 * float(np.trace(scatter)) / max(1, width))
    middle = np.array(quantiles(x, [F.col("x")[i] for i in range(width)], 0.5, weight), float)
    spread = np.array(quantiles(x, [F.abs(F.col("x")[i] - float(middle[i])) for i in range(width)], 0.5, weight), float)
    starts = [(middle, np.diag(np.maximum((1.4826 * spread) ** 2, floor))), (mean, scatter)]
    best = None
    for centre, shape in starts:
        last = None
        for _ in range(steps):
            d, _ = _distance(centre, shape, floor)
            near = quantiles(x, [d], max(share, min(1.0, (n + width + 1) / (2 * n))), weight)[0]
            _, centre, shape = _sums(x.where(d <= near), width, weight)
            _, size = _distance(centre, shape, floor)
            if last is not None and last - size < 1e-9:
                break
            last = size
        if best is None or size < best[0]:
            best = size, centre, shape
    _, centre, shape = best
    d, _ = _distance(centre, shape, floor)
    normal = width * (1 - 2 / (9 * width)) ** 3  # the median of chi-square, by the cube-root approximation
    scale = quantiles(x, [d], 0.5, weight)[0] / normal
    if not scale > 0:
        scale = 1.0
    return centre, shape * scale, d / scale


def outliers(df: DataFrame, key: str, reduced: str = "reduced", contamination: float = 0.05) -> DataFrame:
    """M5: df: principal components. Isolation forest and distance from a robust centre; either one makes an outlier.
    Both cuts are quantiles over all rows. Equal rows get equal scores, so they are one point with their number as weight, and the points are
    read again and again in place of the rows."""
    from pyspark.ml.functions import vector_to_array

    x = cut(df.withColumn("x", vector_to_array(reduced)))
    points = cut(x.groupBy("x").agg(F.count("*").alias("_n")))
    width, n = len((x.select("x").first() or [[]])[0]), F.col("_n")
    distance = robust_scatter(points, width, weight=n)[2] if width else F.lit(0.0)
    points = cut(points.withColumn("distance", distance).withColumn("isolation", isolation(x, key)("x")))
    cuts = dict(zip(("isolation", "distance"), quantiles(points, [F.col("isolation"), F.col("distance")], 1 - contamination, n), strict=True))
    scored = x.join(points.drop("_n"), "x")
    votes = [F.col(c) > F.lit(cuts[c]) for c in ("isolation", "distance")]
    n = votes[0].cast("int") + votes[1].cast("int")
    return scored.drop("x").withColumns({"votes": n, "is_anomaly": n >= 1, "confidence": n / 2, "anomaly_score": (F.col("isolation") + F.when(votes[1], 0.8).otherwise(0.2)) / 2})


def isolation(x: DataFrame, key: str, trees: int = 100, sample: int = 256):
    """The isolation score of an array column: 2 to the power of minus the mean depth over the expected depth.

    A tree is grown from about `sample` rows drawn by a hash of the key and the tree, as the method asks; trees grow in
    tasks of their own. The forest has at most 2 * trees * sample nodes and is broadcast."""
    rate = min(1.0, sample / max(x.count(), 1))
    forest = x.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))
    drawn = F.pmod(F.xxhash64(F.col(key), F.col("tree")), F.lit(1 << 30)) < int(rate * (1 << 30))
    rows = x.select("x", key).join(F.broadcast(forest), drawn).select("x", "tree")  # one row a tree is broadcast

    def grown(own: pd.DataFrame) -> pd.DataFrame:
        points, rng, nodes = np.array(own["x"].tolist()), np.random.default_rng(int(own["tree"].iloc[0])), []

        def grow(part, depth):
            place = len(nodes)
            nodes.append((-1, 0.0, place, place, float(depth + _mean_depth(len(part)))))
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(low < high)
            if depth < np.ceil(np.log2(sample)) and len(wide):
                f = int(rng.choice(wide))
                cut = float(rng.uniform(low[f], high[f]))
                right = part[:, f] > cut
                nodes[place] = (f, cut, grow(part[~right], depth + 1), grow(part[right], depth + 1), 0.0)
            return place

        grow(points[np.lexsort(points.T)], 0)
        return pd.DataFrame(nodes, columns=["f", "cut", "low", "high", "depth"]).assign(tree=own["tree"].iloc[0], node=range(len(nodes)))

    table = rows.groupBy("tree").applyInPandas(grown, "f int, cut double, low int, high int, depth double, tree int, node int").toPandas()
    forest = [t.sort_values("node") for _, t in table.groupby("tree")]
    forest = x.sparkSession.sparkContext.broadcast([tuple(t[c].to_numpy() for c in ("f", "cut", "low", "high", "depth")) for t in forest])

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        points = np.array(column.tolist()).reshape(len(column), -1)
        total, every = np.zeros(len(points)), np.arange(len(points))
        for f, cut, low, high, depth in forest.value:
            at = np.zeros(len(points), dtype=int)
            while (f[at] >= 0).any():
                at = np.where(points[every, f[at]] > cut[at], high[at], low[at])
            total += depth[at]
        return pd.Series(2.0 ** (-total / max(len(forest.value), 1) / _mean_depth(sample)))

    return score


def _mean_depth(n: int) -> float:
    """The expected depth of a row in a random tree over n rows."""
    return 2 * (sum(1 / k for k in range(1, n)) - (n - 1) / n) if n > 1 else 0.0


def cross_validate(df: DataFrame, label: str, key: str, depths=(2, 4), folds: int = 5) -> DataFrame:
    """M7: the mean area under the curve over folds dealt by a hash of the key, for each depth of a boosted model.
    Rows of a fold with equal features and label are one row with their number as weight, which neither trees nor curve tell apart; they are written once."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="row_weight", maxIter=5, seed=7)
    grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).build()
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    dealt = cut(df.groupBy("features", label, fold.alias("fold")).agg(F.count("*").cast("double").alias("row_weight")))
    curve = BinaryClassificationEvaluator(labelCol=label, weightCol="row_weight")
    found = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=curve, numFolds=folds, foldCol="fold", parallelism=len(depths)).fit(dealt)
    return df.sparkSession.createDataFrame([(d, float(a)) for d, a in zip(depths, found.avgMetrics, strict=True)], "max_depth int, auc double")


def auc_weights(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """M8: each score's area under the curve as a share of their sum."""
    found = [auc(df, c, label).withColumn("model", F.lit(c)) for c in scores]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    total = out.agg(F.sum("auc").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("model", "auc", (F.col("auc") / F.col("total")).alias("weight"))  # one row


#: What an alert's rank is learnt from; missing columns count as 0.
RANK_FEATURES = ("risk_score", "amount", "num_patterns", "customer_risk_level", "has_pep", "has_sanctions", "cross_border", "cash_intensive", "velocity_z_score", "network_centrality")


def rank_features(alerts: DataFrame) -> DataFrame:
    """The ten features as doubles: amounts in thousands, risk levels as 1, 0.5 or 0."""
    def of(c):
        if c not in alerts.columns:
            return F.lit(0.0)
        if c == "customer_risk_level":
            return F.when(F.col(c) == "high", 1.0).when(F.col(c) == "medium", 0.5).otherwise(0.0)
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / (1000 if c == "amount" else 1)

    return alerts.withColumns({f"rank_{c}": of(c) for c in RANK_FEATURES})


def ranker(alerts: DataFrame, label: str = "priority"):
    """A fitted pipeline: the features scaled, then a forest of 100 trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [
        VectorAssembler(inputCols=[f"rank_{c}" for c in RANK_FEATURES], outputCol="rank_features"),
        StandardScaler(inputCol="rank_features", outputCol="rank_scaled", withMean=True, withStd=True),
        RandomForestClassifier(numTrees=100, featuresCol="rank_scaled", labelCol=label, seed=42),
    ]
    return Pipeline(stages=steps).fit(rank_features(alerts))


def ranked(alerts: DataFrame, model=None) -> DataFrame:
    """Alerts with their rank score: the probability of the highest class, or the risk score without a model."""
    if model is None:
        return alerts.withColumn("rank_score", F.coalesce("risk_score", F.lit(0.0)))
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rank_features(alerts)).withColumn("rank_score", F.element_at(vector_to_array("probability"), -1))
    return out.select(*alerts.columns, "rank_score")
