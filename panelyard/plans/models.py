"""Walk-forward fits with pyspark.ml, and everything measured on their out-of-fold rows.

One fit per fold (and class) is a Spark job over the rows of that fold; the loop over folds on the
driver starts jobs and moves no rows.  Out-of-fold rows are written before they are compared, so
no comparison repeats a fit.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard import vocab
from panelyard.functions.numeric import finite
from panelyard.functions.probability import squared_error
from panelyard.operators.evaluation import class_priors, pointwise
from panelyard.operators.folds import inner_validation
from panelyard.operators.logistic import fit_logistic, predict_logistic
from panelyard.operators.quantiles import exact_quantiles
from panelyard.operators.single import beside
from panelyard.session import stored

MISSING = -99999.0  # tree learners get "missing" as a value below all others


def vectors(rows: DataFrame, features, fill: float = MISSING) -> DataFrame:
    filled = rows.withColumns({f"__{c}": F.coalesce(finite(c), F.lit(fill)) for c in features})
    out = VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="x").transform(filled)
    return out.drop(*[f"__{c}" for c in features])


def _classifier(learner: str, label: str, params: dict, validation: str | None = None):
    if learner == "gbt":
        given = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "maxBins": 64, "seed": 7, **params}
        if validation is not None:
            given["validationIndicatorCol"] = validation
        return GBTClassifier(featuresCol="x", labelCol=label, **given)
    if learner == "forest":
        given = {"numTrees": 20, "maxDepth": 5, "maxBins": 64, "seed": 7, **params}
        return RandomForestClassifier(featuresCol="x", labelCol=label, **given)
    raise ValueError(f"unknown learner {learner!r}; use 'gbt' or 'forest'")


def fit(train: DataFrame, k: int, learner: str = "gbt", params: dict | None = None, validation: str | None = None):
    """Fit on rows with ``x`` and ``y``; returns a function that adds ``p`` to rows with ``x``.

    Boosted trees are binary, so a 3-class target is one fit per class, normalised to sum to 1.
    """
    params = params or {}

    def positive(model, rows, name):
        out = model.transform(rows)
        extra = [c for c in out.columns if c not in rows.columns]
        return out.withColumn(name, vector_to_array("probability")).drop(*extra)

    if learner == "forest" or k == 2:
        model = _classifier(learner, "y", params, validation).fit(train)

        def predict(rows: DataFrame) -> DataFrame:
            out = positive(model, rows, "p")
            # a class that the training rows lack gets probability 0
            return out.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get("p", i), F.lit(0.0))))

        predict.model = model
        return predict
    models = []
    for c in range(k):
        one = train.withColumn("__y", (F.col("y") == c).cast("double"))
        models.append(_classifier(learner, "__y", params, validation).fit(one))

    def predict_all(rows: DataFrame) -> DataFrame:
        for c, model in enumerate(models):
            rows = positive(model, rows, f"__p{c}")
        raw = [F.get(f"__p{c}", F.lit(1)) for c in range(k)]
        total = reduce(lambda a, b: a + b, raw)
        return rows.withColumn("p", F.array(*[r / total for r in raw])).drop(*[f"__p{c}" for c in range(k)])

    predict_all.model = models[0]
    return predict_all


def bounded(train: DataFrame, fit_rows: int | None) -> DataFrame:
    """About ``fit_rows`` of the training rows of a classifier, drawn by a hash of their key; None: all.  For trials: no query bounds its fits so."""
    if fit_rows is None:
        return train
    share = fit_rows / max(1, train.count())
    return train if share >= 1 else train.where(F.pmod(F.xxhash64(F.lit("fit"), "ticker", "date"), F.lit(1_000_000)) < int(share * 1_000_000))


def walk_forward(rows: DataFrame, fold_days: DataFrame, features, k: int, learner: str = "gbt", params: dict | None = None,
                 early_stop: tuple[int, int] | None = None) -> DataFrame:
    """Out-of-fold table (fold, ticker, date, y, p, prior), written to the shared folder.

    ``rows``: ticker, date, y and the features.  ``early_stop`` = (test dates, horizon) holds out
    the last dates of each training block as the stopping set.  Every training row is given to the fit of its fold and
    every test row is scored.
    """
    ready = vectors(rows, features).select("ticker", "date", "y", "x")
    marked = ready.join(fold_days, "date")
    n_folds = fold_days.agg(F.max("fold")).first()[0] + 1
    priors = class_priors(marked.where("role = 'train'"), ["fold"], k)
    parts = []
    for f in range(n_folds):
        mine = marked.where(F.col("fold") == f)
        train, validation = mine.where("role = 'train'"), None
        if early_stop is not None and learner == "gbt":
            split = inner_validation(fold_days.where((F.col("fold") == f) & (F.col("role") == "train")), *early_stop)
            train = train.join(split.select("date", (F.col("part") == "valid").alias("held_out")), "date")
            validation = "held_out"
        predict = fit(train, k, learner, params, validation)
        parts.append(predict(mine.where("role = 'test'")).select("fold", "ticker", "date", "y", "p"))
    out = reduce(DataFrame.unionByName, parts).join(priors.select("fold", "prior"), "fold")
    return stored(out, "oof")


class Misaligned(RuntimeError):
    """Two out-of-fold tables do not cover the same rows."""


def check_aligned(ours: DataFrame, saved: DataFrame) -> None:
    """Same (fold, ticker, date, y) rows on both sides, or an error with the counts."""
    key = ["fold", "ticker", "date", "y"]
    a, b = ours.select(*key), saved.select(*key)
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    # one aggregate instead of two set differences: counts that cancel are rows on both sides
    gap = both.groupBy(*key).agg(F.sum("side").alias("s")).agg(
        F.coalesce(F.sum(F.abs("s")), F.lit(0)).alias("n")).first()["n"]
    if gap:
        raise Misaligned(f"{gap} out-of-fold rows differ; use the same panel, folds and thinning")


def fit_sets(rows: DataFrame, fold_days: DataFrame, sets: dict, k: int, saved: DataFrame | None = None, learner: str = "forest",
             params: dict | None = None) -> dict[str, DataFrame]:
    """One small model per feature set through the same folds; aligned with ``saved`` if given."""
    have = set(rows.columns)
    missing = sorted({c for cols in sets.values() for c in cols} - have)
    if missing:
        raise ValueError(f"panel lacks {missing}")
    out = {}
    for name, cols in sets.items():
        out[name] = walk_forward(rows.select("ticker", "date", "y", *cols), fold_days, list(cols), k, learner, params)
        if saved is not None:
            check_aligned(out[name], saved)
    return out


def paired_errors(model: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Long table (name, fold, date, se_model, se_reference, se_base) on identical rows."""
    key = ["fold", "ticker", "date"]
    mine = model.select(*key, squared_error(F.col("p"), F.col("y")).alias("se_model"),
                        squared_error(F.col("prior"), F.col("y")).alias("se_base"))
    parts = [o.select(*key, F.lit(name).alias("name"), squared_error(F.col("p"), F.col("y")).alias("se_reference"))
             for name, o in others.items()]
    return reduce(DataFrame.unionByName, parts).join(mine, key)


def bucket_model(rows: DataFrame, fold_days: DataFrame, feature: str, k: int, buckets: int = 10) -> DataFrame:
    """Class frequencies per quantile bucket of one feature: an exact, deterministic small model.

    Edges and frequencies come from the training rows of each fold; missing values are a bucket.
    """
    marked = rows.select("ticker", "date", "y", finite(feature).alias("v")).join(fold_days, "date")
    train = marked.where("role = 'train'")
    # one row per fold
    cuts = F.broadcast(exact_quantiles(train, ["fold"], "v", [i / buckets for i in range(1, buckets)]).select("fold", "q"))
    place = F.when(F.col("v").isNotNull(), F.size(F.filter("q", lambda e: e <= F.col("v")))).otherwise(-1)
    placed = marked.join(cuts, "fold").withColumn("bucket", place).drop("q")
    freq = class_priors(placed.where("role = 'train'"), ["fold", "bucket"], k).select("fold", "bucket", F.col("prior").alias("p"))
    prior = class_priors(train, ["fold"], k).select("fold", "prior")
    return placed.where("role = 'test'").join(freq, ["fold", "bucket"], "left").join(prior, "fold").select(
        "fold", "ticker", "date", "y", F.coalesce("p", "prior").alias("p"), "prior")


def calibrated(rows: DataFrame, fold_days: DataFrame, feature: str, k: int, least: int = 100, group: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Multinomial logistic model on one feature per fold; rows without it get the class shares.

    All groups are fitted together.  ``group`` may name further columns of ``rows`` that are fitted each for itself; when ``fold`` is a column of
    ``rows``, a row belongs to that fold only.
    """
    group = list(group)
    named = [c for c in group if c in rows.columns]
    marked = rows.select(*named, "ticker", "date", "y", finite(feature).alias("v")).join(fold_days, ["date", *(["fold"] if "fold" in named else [])])
    train = marked.where("role = 'train'")
    prior = class_priors(train, group, k).select(*group, "prior")
    usable = train.where("v IS NOT NULL").groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes"))
    ready = stored(usable.where((F.col("n") >= least) & (F.col("classes") == k)).select(*group), "ready")
    model = fit_logistic(train.where("v IS NOT NULL").join(F.broadcast(ready), group), group, ["v"], k)  # one row per group
    test = marked.where("role = 'test'").select(*group, "ticker", "date", "y", "v").join(F.broadcast(prior), group)
    return predict_logistic(test, model).select(*group, "ticker", "date", "y", F.coalesce("p", "prior").alias("p"), "prior")


def fusion(oof: DataFrame, fold_days: DataFrame, k: int, sentiment: str | None = None) -> DataFrame:
    """Logistic combination of out-of-fold probabilities (and sentiment with its interaction).

    Returns (fold, ticker, date, y, p, p_base, prior); adopt it if its skill gains enough.  The last class's probability enters by its log odds
    against the others, the other classes by theirs, so that they don't add up to a constant.
    """
    def odds(i: int) -> Column:
        share = F.least(F.greatest(F.get("p", F.lit(i)), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.ln(share / (1 - share))

    cols = {f"g{i}": odds(i) for i in range(1, k)}
    if sentiment is not None:
        s = F.coalesce(finite(sentiment), F.lit(0.0))
        cols.update({"s": s, "s_x": s * F.get("p", F.lit(k - 1))})
    rows = oof.withColumns(cols).withColumnRenamed("p", "p_base").drop("fold", "prior").join(fold_days, "date")
    train = rows.where("role = 'train'")
    prior = class_priors(train, ["fold"], k).select("fold", "prior")
    model = fit_logistic(train, ["fold"], list(cols), k)
    test = rows.where("role = 'test'").join(F.broadcast(prior), "fold")  # one row per fold
    return stored(predict_logistic(test, model).select("fold", "ticker", "date", "y", "p", "p_base", "prior"), "fusion")


def fusion_gain(fused: DataFrame) -> DataFrame:
    """Skill of both, the gain, and whether the combination is adopted."""
    meta = pointwise(fused, []).select(F.col("brier_skill").alias("meta_skill"))
    base = pointwise(fused.drop("p").withColumnRenamed("p_base", "p"), []).select(
        F.col("brier_skill").alias("base_skill"))
    gain = F.coalesce("meta_skill", F.lit(0.0)) - F.coalesce("base_skill", F.lit(0.0))
    return beside(meta, base).select("meta_skill", "base_skill", gain.alias("gain"),
                                           (gain >= vocab.FUSION_MIN_GAIN).alias("adopt"))


def tune(rows: DataFrame, fold_days: DataFrame, features, k: int, grid: list[dict], learner: str = "gbt") -> DataFrame:
    """Mean fold skill of every parameter set, best first (trial number breaks ties)."""
    parts = []
    for i, params in enumerate(grid):
        oof = walk_forward(rows, fold_days, features, k, learner, params)
        per = pointwise(oof, ["fold"]).agg(F.avg("brier_skill").alias("mean_skill"))
        text = ", ".join(f"{a}={b}" for a, b in sorted(params.items()))
        parts.append(per.select(F.lit(i).alias("trial"), F.lit(text).alias("params"), "mean_skill"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("mean_skill"), "trial")


def importances(predict, features, spark) -> DataFrame:
    """Ranked feature importances of a fitted tree model."""
    values = predict.model.featureImportances.toArray().tolist()
    ranked = sorted(zip(features, values), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(ranked)], "feature STRING, gain DOUBLE, place INT")


def attribution(rows: DataFrame, features, predict, medians: dict[str, float], top: int = 5) -> DataFrame:
    """Per row the features whose replacement by the median changes the last class most.

    Rows x features is a flat table scored in one pass; ranks are taken per row over its features.
    """
    key = ["ticker", "date"]
    base = rows.select(*key, *[finite(c).alias(c) for c in features])
    varied = base.withColumn("feature", F.explode(F.array(F.lit("(none)"), *[F.lit(c) for c in features])))
    swapped = varied.select(*key, "feature", *[
        F.when(F.col("feature") == c, F.lit(float(medians[c]))).otherwise(F.col(c)).alias(c) for c in features],
        reduce(lambda acc, c: F.when(F.col("feature") == c, F.col(c)).otherwise(acc), features, F.lit(None).cast("double")).alias("value"))
    scored = predict(vectors(swapped, features)).select(*key, "feature", "value", F.element_at("p", -1).alias("s"))
    whole = scored.where("feature = '(none)'").select(*key, F.col("s").alias("full"))
    gaps = scored.where("feature <> '(none)'").join(whole, key).withColumn("delta", F.col("full") - F.col("s"))
    rank = Window.partitionBy(*key).orderBy(F.desc(F.abs("delta")), "feature")
    return gaps.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top).select(
        *key, "place", "feature", "value", "delta", F.when(F.col("delta") > 0, "increases").otherwise("decreases").alias("direction"))


def top_contributions(contributions: Column, k: int = 5) -> Column:
    """Largest absolute contributions from an array of (feature, value, contribution) structs."""
    ordered = F.sort_array(F.transform(contributions, lambda c: F.struct(
        F.abs(c["contribution"]).alias("size"), c["feature"].alias("feature"), c["value"].alias("value"),
        c["contribution"].alias("contribution"))), asc=False)
    return F.transform(F.slice(ordered, 1, k), lambda c: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution"),
        F.when(c["contribution"] > 0, "increases").otherwise("decreases").alias("direction")))


def fingerprint(predict, features, target: str) -> str:
    """Identity of a fitted model: its target, features and trees."""
    text = "|".join([target, *features, getattr(predict.model, "toDebugString", repr(predict.model)).split("\n", 1)[-1]])
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def leading_features(predict, features, k: int = 5) -> list[str]:
    """The k features of largest importance of a tree model."""
    gains = predict.model.featureImportances.toArray().tolist()
    return [f for _, f in sorted(zip((-g for g in gains), features))[:k]]


def score_latest(latest: DataFrame, predictors: dict, features, names: dict, priors: dict,
                 threshold: float = vocab.THRESHOLD_SIGMAS) -> DataFrame:
    """Last row of every ticker x every model: the flat scores table with all columns that the log needs.

    ``latest``: ticker, date, last_close, label_scale, rel_label_scale and the features;
    scales are for one bar and grow with the root of the horizon.
    """
    if not predictors:
        raise ValueError("nothing to score: no model is fitted")
    ready = vectors(latest, features)
    parts = []
    for target, (kind, horizon, predict) in predictors.items():
        labels = names[kind]
        prior = F.array(*[F.lit(float(x)) for x in priors[target]])
        scored = predict(ready)
        scale = F.col("rel_label_scale") if kind == "rel_direction" else F.col("label_scale")
        prob = F.element_at("p", -1)
        parts.append(scored.select(
            "ticker", F.col("date").alias("as_of"), F.lit(target).alias("target"), F.lit(kind).alias("kind"),
            F.lit(horizon).alias("horizon_days"), F.lit(labels[-1]).alias("outcome_class"),
            F.get(F.array(*[F.lit(n) for n in labels]), F.array_position("p", F.array_max("p")).cast("int") - 1).alias("predicted_class"),
            prob.alias("probability"), F.element_at(prior, -1).alias("baseline"),
            (prob / F.greatest(F.element_at(prior, -1), F.lit(1e-9))).alias("lift"),
            F.map_from_arrays(F.array(*[F.lit(n) for n in labels]), F.col("p")).alias("probabilities"),
            "last_close", (scale * F.sqrt(F.lit(float(horizon)))).alias("label_scale"), F.lit(threshold).alias("threshold_sigmas"),
            F.lit(fingerprint(predict, features, target)).alias("model_fingerprint"),
            F.array(*[F.lit(f) for f in leading_features(predict, features)]).alias("top_features")))
    return reduce(DataFrame.unionByName, parts)
