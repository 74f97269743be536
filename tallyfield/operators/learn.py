"""Features, models and scores for demand, surges and district risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar, numeric
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec
from .aggregate import daily_with_calendar, district_volatility
from .clean import label_encode
from . import trees as forests
from .rows import present, seeded_hash
from .series import cap_at_quantile, lag_features, max_column, minmax_column, ordered, strict_mean, whole

# The models' inputs and the names of the risk thirds.
DEMAND_FEATURES = (
    "day_of_week", "month", "quarter", "is_weekend", "is_month_start", "is_month_end",
    "lag_1", "lag_7", "lag_14", "rolling_7_mean", "rolling_14_mean",
)
SURGE_FEATURES = ("day_of_week", "month", "quarter", "is_weekend", "lag_1", "rolling_3_mean")
RISK_LABELS = ("Low Risk", "Medium Risk", "High Risk")

#: Splits that a forest may try in a feature: each distinct value is one up to here. Fits take time in proportion, scores hardly change.
MAX_BINS = 256

# Weights of volatility, coverage and volume in the risk score.
RISK_WEIGHTS = (0.35, 0.35, 0.30)


def ml_features(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Rows with calendar features, 0/1 flags and the encoded state."""
    d = F.col(spec.date)
    cal = calendar.calendar_columns(d)
    dated = df.withColumns({
        "day_of_week": cal["day_of_week"], "month": cal["month"], "day_of_month": cal["day"],
        "quarter": cal["quarter"], **calendar.edge_flags(d),
    })
    return label_encode(dated, spec.state, "state_encoded")


def _recent_mean(w: int, value: str, exclude_current: bool) -> Column:
    """Full-window trailing mean, of the days before only if asked."""
    mean = strict_mean(w, value=value)
    if not exclude_current:
        return mean
    frame = ordered().rowsBetween(-w, -1)
    return F.when(F.count(value).over(frame) == w, F.avg(value).over(frame))


def demand_features(
    df: DataFrame, spec: FactSpec = DEFAULT, target: str | None = None, exclude_current: bool = False
) -> DataFrame:
    """Daily target with calendar, lags 1, 7, 14 and rolling means, complete rows only.

    The rolling means hold the day itself unless ``exclude_current``.
    """
    target = target or spec.total
    daily = daily_with_calendar(df, spec, [target])
    return lag_features(daily, (1, 7, 14), value=target).withColumns({
        f"rolling_{w}_mean": _recent_mean(w, target, exclude_current) for w in (7, 14)
    }).dropna()


def chrono_split(features: DataFrame, fraction: float = 0.8, order: str = "date") -> DataFrame:
    """Mark the first ``fraction`` of the days as training rows."""
    position = F.row_number().over(W.orderBy(order))
    size = F.floor(F.count("*").over(whole()) * fraction)
    return features.withColumn("is_train", position <= size)


def random_split(
    features: DataFrame, test_fraction: float = 0.2, seed: int = 42, key: str = "date"
) -> DataFrame:
    """Mark a fixed random 80/20 split: order by a seeded hash of the key.

    The hash depends on the row alone, so repartitioning changes nothing.
    """
    position = F.row_number().over(W.orderBy(seeded_hash(seed, key), key))
    size = F.ceil(F.count("*").over(whole()) * test_fraction)
    return features.withColumn("is_train", position > size)


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def _importances(model: Model, columns: Sequence[str], df: DataFrame) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def bins_for(data: DataFrame, columns: Sequence[str], most: int = MAX_BINS) -> int:
    """Bins that give every distinct value of each feature its own split, up to ``most``, beyond which quantiles serve."""
    counts = data.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    # the count is approximate, so some more are allowed
    return max(32, min(most, int(1.2 * max((n or 0 for n in counts), default=0)) + 2))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean absolute error and R2 in one pass."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    sst = F.var_pop(y) * F.count(y)
    return present(df, label, prediction).agg(
        F.avg(F.abs(error)).alias("mae"),
        (1.0 - F.try_divide(F.sum(error * error).cast("double"), sst)).alias("r2"),
        F.count("*").alias("rows"),
    )


def classification_metrics(
    df: DataFrame, label: str, prediction: str, names: Sequence[str] = ("Normal", "Surge")
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means.

    Classes are numbered 0, 1, ... in the order of ``names``; an undefined
    ratio counts as 0.
    """
    y, p = F.col(label), F.col(prediction)
    zero = F.lit(0.0)
    counts = [
        F.struct(
            F.lit(name).alias("class"),
            F.count_if((y == i) & (p == i)).alias("hit"),
            F.count_if(p == i).alias("predicted"),
            F.count_if(y == i).alias("support"),
        )
        for i, name in enumerate(names)
    ]
    per_class = df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    precision = F.coalesce(numeric.ratio(F.col("hit"), F.col("predicted")), zero)
    recall = F.coalesce(numeric.ratio(F.col("hit"), F.col("support")), zero)
    scored = per_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        F.coalesce(
            F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero
        ),
    )
    scores = ("precision", "recall", "f1")
    size = F.sum("support")
    accuracy = numeric.ratio(F.sum("hit"), size)
    rows = [
        F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(s) for s in scores], size.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(s).alias(s) for s in scores], size.alias("support")),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[numeric.ratio(F.sum(F.col(s) * F.col("support")), size).alias(s) for s in scores],
            size.alias("support"),
        ),
    ]
    summary = scored.agg(F.array(*rows).alias("s")).select(F.inline("s"))
    return scored.select("class", *scores, "support").unionByName(summary)


def train_demand(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    target: str | None = None,
    trees: int = 200,
    depth: int = 10,
    seed: int = 42,
    exclude_current: bool = False,
) -> tuple[Model, DataFrame, DataFrame]:
    """Random forest for the daily total: (model, importances, test metrics)."""
    target = target or spec.total
    features = chrono_split(demand_features(df, spec, target, exclude_current))
    held = pinned(features, "demand")
    data = _vectors(held, DEMAND_FEATURES)
    forest = RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, maxBins=bins_for(held, DEMAND_FEATURES),
        featureSubsetStrategy="all", maxMemoryInMB=1024, seed=seed,
    )
    model = forest.fit(data.where("is_train"))
    scored = model.transform(data.where("not is_train"))
    return model, _importances(model, DEMAND_FEATURES, df), regression_metrics(scored, target, "prediction")


def surge_label(
    daily: DataFrame, value: str = "value", threshold_percentile: float = 90
) -> DataFrame:
    """Mark the days at or above a percentile of the daily totals."""
    limit = F.percentile(value, F.lit(threshold_percentile / 100)).over(whole())
    return daily.withColumn("threshold", limit).withColumn(
        "is_surge", (F.col(value) >= F.col("threshold")).cast("int")
    )


def surge_features(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    threshold_percentile: float = 90,
    exclude_current: bool = False,
) -> DataFrame:
    """Surge label with calendar, previous day and three-day mean, complete rows only."""
    labelled = surge_label(daily_with_calendar(df, spec), spec.total, threshold_percentile)
    return (
        lag_features(labelled, (1,), value=spec.total)
        .withColumn("rolling_3_mean", _recent_mean(3, spec.total, exclude_current))
        .dropna()
    )


def train_surge(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    threshold_percentile: float = 90,
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
) -> tuple[Model, DataFrame, DataFrame]:
    """Random forest for surge days: (model, classification report, test predictions)."""
    features = random_split(surge_features(df, spec, threshold_percentile), seed=seed)
    held = pinned(features, "surge")
    data = _vectors(held, SURGE_FEATURES)
    forest = RandomForestClassifier(
        labelCol="is_surge", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", maxBins=bins_for(held, SURGE_FEATURES),
        maxMemoryInMB=1024, seed=seed,
    )
    model = forest.fit(data.where("is_train"))
    scored = model.transform(data.where("not is_train"))
    report = classification_metrics(scored, "is_surge", "prediction")
    return model, report, scored.select("date", "is_surge", "prediction")


def tercile(df: DataFrame, value: str, ties: Sequence[str], out: str) -> DataFrame:
    """Three equal bins of the rank of districts, ties broken by ``ties``.

    The bin edges are linear quantiles of the ranks, so sizes differ from
    those of ``ntile`` when the count is not a multiple of three.
    """
    position = F.row_number().over(W.orderBy(value, *ties))
    n = F.count("*").over(whole())
    third = F.coalesce(F.floor(F.try_divide(3 * (position - 1), n - 1)), F.lit(0))
    label = F.element_at(
        F.array(*[F.lit(x) for x in RISK_LABELS]), F.least(third + 1, F.lit(len(RISK_LABELS))).cast("int")
    )
    return df.withColumn(out, label)


def district_risk(
    df: DataFrame, spec: FactSpec = DEFAULT, pincodes: DataFrame | None = None
) -> DataFrame:
    """Districts by service risk: volatility, coverage, volume, highest risk first."""
    data = district_volatility(df, spec, pincodes).withColumn(
        "cv", numeric.ratio(F.col("daily_std"), F.col("daily_mean"))
    )
    data = cap_at_quantile(data, "cv", 0.95)
    data = data.withColumns({
        "cv_normalized": minmax_column("cv"),
        "coverage": max_column("pincodes"),
        "volume_score": max_column("total"),
    })
    a, b, c = RISK_WEIGHTS
    score = (
        F.coalesce("cv_normalized", F.lit(0.5)) * a
        + (1 - F.col("coverage")) * b
        + (1 - F.col("volume_score")) * c
    )
    keys = spec.geo_keys("district")
    ranked = tercile(data.withColumn("risk_score", score), "risk_score", keys, "risk_category")
    return ranked.orderBy(F.desc("risk_score"), *keys)


def risk_summary(risk: DataFrame) -> DataFrame:
    """Districts per risk category."""
    return risk.groupBy("risk_category").agg(F.count("*").alias("districts"))


def importance_features(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Daily total with calendar features and the first two part shares (0 if undefined)."""
    a, b, c = (F.col(p) for p in spec.parts)
    daily = daily_with_calendar(df, spec, spec.measures)
    return daily.select(
        "date", spec.total, "day_of_week", "month", "is_weekend",
        numeric.share(a, a + b + c).alias(spec.share_names[0]),
        numeric.share(b, a + b + c).alias(spec.share_names[1]),
    )


def walked(model: Model, rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The keys of each row with the ``walked`` prediction, from the model's trees as a table.

    A classifier's is the more likely class, as the model says; of equal ones the first.
    """
    table = forests.tree_table(model, rows.sparkSession)
    score = forests.walk(rows, table, columns, keys)
    if isinstance(model, RandomForestClassificationModel):
        return score.select(*keys, (F.round(F.col("score") / F.col("weight"), 12) > 0.5).cast("double").alias("walked"), "n_trees")
    mean = F.col("score") / F.col("weight") if "RandomForest" in type(model).__name__ else F.col("score")
    return score.select(*keys, mean.alias("walked"), "n_trees")


def permuted(df: DataFrame, columns: Sequence[str], key: str = "date", repeats: int = 5, seed: int = 42) -> DataFrame:
    """Every row once for each feature and repeat, that feature's value taken from another row.

    (feature, repeat, and the columns of ``df``): rows stand in the order of a seeded hash of the key, each takes the value of
    the next one, the last that of the first. So each feature's values are the same, and the order depends on the rows alone.
    ``df`` is a set of days, bounded by the calendar.
    """
    turns = [(c, r) for c in columns for r in range(repeats)]
    moved = {}
    for at, (c, r) in enumerate(turns):
        order = W.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(c), F.lit(str(r)), F.col(key).cast("string"))), key)
        first = F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        last = F.row_number().over(order) == F.count("*").over(W.partitionBy())
        moved[f"_moved_{at}"] = F.when(last, first).otherwise(F.lead(c).over(order))
    variants = [
        F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat"), *[(F.col(f"_moved_{at}") if x == c else F.col(x)).alias(x) for x in columns])
        for at, (c, r) in enumerate(turns)
    ]
    others = [x for x in df.columns if x not in columns]
    return df.withColumns(moved).select(*others, F.explode(F.array(*variants)).alias("v")).select("v.feature", "v.repeat", *[
        (F.col(f"v.{x}") if x in columns else F.col(x)).alias(x) for x in df.columns
    ])


def permutation_importance(
    model: Model, df: DataFrame, columns: Sequence[str], label: str, key: str = "date", repeats: int = 5, seed: int = 42
) -> DataFrame:
    """(feature, r2_loss, r2_deviation): how far R2 falls when a feature's values are exchanged between rows.

    The table as it is and all its permuted versions are scored in one pass.
    """
    plain = df.select(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("repeat"), *df.columns)
    scored = model.transform(_vectors(plain.unionByName(permuted(df, columns, key, repeats, seed)), columns))
    error, y = F.col(label) - F.col("prediction"), F.col(label)
    r2 = scored.groupBy("feature", "repeat").agg((1 - F.try_divide(F.sum(error * error).cast("double"), F.var_pop(y) * F.count(y))).alias("r2"))
    whole = F.max(F.when(F.col("feature").isNull(), F.col("r2"))).over(W.partitionBy())
    return r2.withColumn("loss", whole - F.col("r2")).where("feature IS NOT NULL").groupBy("feature").agg(
        F.avg("loss").alias("r2_loss"), F.stddev_pop("loss").alias("r2_deviation")
    )


def fit_importance(
    df: DataFrame, spec: FactSpec = DEFAULT, trees: int = 100, depth: int = 3, seed: int = 42
) -> tuple[Model, DataFrame, tuple[str, ...]]:
    """Boosted trees for the daily total: (model, the rows it was fitted on, its features)."""
    columns = ("day_of_week", "month", "is_weekend", *spec.share_names[:2])
    rows = pinned(importance_features(df, spec), "importance")
    booster = GBTRegressor(labelCol=spec.total, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, maxBins=bins_for(rows, columns))
    return booster.fit(_vectors(rows, columns)), rows, columns


def feature_importance(
    df: DataFrame, spec: FactSpec = DEFAULT, trees: int = 100, depth: int = 3, seed: int = 42, repeats: int = 5
) -> DataFrame:
    """What drives the daily total, by a boosted-tree model: impurity figures, and the R2 lost when a feature is permuted."""
    model, rows, columns = fit_importance(df, spec, trees, depth, seed)
    lost = permutation_importance(model, rows, columns, spec.total, repeats=repeats, seed=seed)
    return _importances(model, columns, df).join(lost, "feature").orderBy(F.desc("importance"), "feature")
