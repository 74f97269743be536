"""Clustering of regions and pincodes, cluster names, underserved districts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec
from . import kmeans
from .aggregate import pincode_profile, region_features
from .clean import add_shares
from .joins import with_scalars
from .series import max_column, minmax_column, quantile_column, whole

# Cluster name limits.
CHILD_SHARE, ADULT_SHARE = 40.0, 50.0


def region_feature_names(spec: FactSpec = DEFAULT) -> list[str]:
    return [*spec.share_names, "daily_avg", "per_pincode_avg"]


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Zero mean and unit population variance; a constant column becomes 0."""
    stats = {f"{c}_mean": F.avg(c) for c in columns} | {f"{c}_std": F.stddev_pop(c) for c in columns}
    scaled = {
        f"{c}{suffix}": F.coalesce(
            numeric.ratio(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")), F.lit(0.0)
        )
        for c in columns
    }
    return with_scalars(df, stats).withColumns(scaled).drop(*stats)


def scaled_points(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Standardised features of an aggregated set as an array ``features``, with the keys as a text ``id``.

    A missing feature counts as 0 there and stays missing in its column. The result is pinned: fitting passes over it many times.
    """
    filled = {f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    scaled = standardize(df.withColumns(filled), list(filled))
    names = [f"{c}_z" for c in filled]
    made = scaled.withColumns({"features": F.array(*names), "id": F.concat_ws("|", *[F.col(k).cast("string") for k in keys])})
    return pinned(made.drop(*names, *filled), "features")


def choose_k(points: DataFrame, max_k: int = 10, seed: int = 42, restarts: int = 10) -> tuple[int, DataFrame]:
    """Best number of clusters by silhouette, and the score of each.

    With fewer than three places there is nothing to choose, and 1 is best. Up to 20,000 places the scores are Euclidean silhouettes; of more they use squared Euclidean
    distance, which needs one pass per ``k`` instead of the distances between all pairs of places.
    """
    spark, rows = points.sparkSession, points.count()
    fits = kmeans.best_fits(points, range(2, min(max_k + 1, rows)), seed, restarts)
    scores = kmeans.silhouettes(points, list(fits.values()))
    if scores is None:
        judge = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster")
        vectors = points.select(array_to_vector("features").alias("vector"), "features")
        scores = {k: float(judge.evaluate(vectors.withColumn("cluster", kmeans.nearest("features", f).cast("double")))) for k, f in fits.items()}
    best = max(scores.items(), key=lambda s: (round(s[1], 9), -s[0]), default=(1, 0.0))[0]
    return best, spark.createDataFrame(sorted(scores.items()), "k int, silhouette double")


def cluster_regions(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    level: str = "district",
    n_clusters: int | None = None,
    seed: int = 42,
    restarts: int = 10,
    pincodes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, kmeans.Fit | None]:
    """Cluster places by shares and averages: (places, cluster profiles, fit); no fit without places."""
    points = scaled_points(region_features(df, spec, level, pincodes), region_feature_names(spec), spec.geo_keys(level))
    if n_clusters is None:
        n_clusters, _ = choose_k(points, seed=seed, restarts=restarts)
    fit = kmeans.best_fits(points, [n_clusters], seed, restarts).get(n_clusters)
    placed = _placed(points, fit)
    profiles = name_clusters(cluster_profiles(placed, spec), spec)
    return placed.join(profiles.select("cluster", "cluster_name"), "cluster", "left"), profiles, fit


def _placed(points: DataFrame, fit: kmeans.Fit | None) -> DataFrame:
    cluster = kmeans.nearest("features", fit) if fit else F.lit(None).cast("int")
    return points.withColumn("cluster", cluster).drop("features", "id")


def cluster_profiles(placed: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Volume, mean shares, mean daily average and size per cluster, to 2 decimals."""
    return placed.groupBy("cluster").agg(
        F.sum(spec.total).alias("total_sum"),
        F.round(F.avg(spec.total), 2).alias("total_mean"),
        *[F.round(F.avg(s), 2).alias(f"avg_{s}") for s in spec.share_names],
        F.round(F.avg("daily_avg"), 2).alias("avg_daily"),
        F.count("*").alias("count"),
    )


def name_clusters(profiles: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Name each cluster by the first rule that holds."""
    daily = F.col("avg_daily")
    high = F.percentile(daily, F.lit(0.75)).over(whole())
    low = F.percentile(daily, F.lit(0.25)).over(whole())
    children, adults = spec.share_names[0], spec.share_names[2]
    return profiles.withColumns({"_hi": high, "_lo": low}).withColumn(
        "cluster_name",
        F.when(daily > F.col("_hi"), "High Volume")
        .when(daily < F.col("_lo"), "Low Volume")
        .when(F.col(f"avg_{children}") > CHILD_SHARE, "Child-Focused")
        .when(F.col(f"avg_{adults}") > ADULT_SHARE, "Adult-Dominated")
        .otherwise("Balanced"),
    ).drop("_hi", "_lo")


def service_scores(
    df: DataFrame, spec: FactSpec = DEFAULT, pincodes: DataFrame | None = None
) -> DataFrame:
    """Every district with its service score and whether it is underserved."""
    data = region_features(df, spec, "district", pincodes)
    data = data.withColumns({
        "daily_avg_normalized": minmax_column("daily_avg"),
        "coverage_score": max_column("unique_pincodes"),
    }).withColumn(
        "service_score", (F.col("daily_avg_normalized") + F.col("coverage_score")) / 2
    )
    low = F.col("service_score") < quantile_column("service_score", 0.25)
    return data.withColumn("is_underserved", F.coalesce(low, F.lit(False)))


def underserved(
    df: DataFrame, spec: FactSpec = DEFAULT, pincodes: DataFrame | None = None
) -> DataFrame:
    """Districts in the lowest quarter of service scores, worst first."""
    return service_scores(df, spec, pincodes).where("is_underserved").orderBy(
        "service_score", *spec.geo_keys("district")
    )


def cluster_pincodes(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    n_clusters: int = 5,
    seed: int = 42,
    restarts: int = 10,
    profile: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cluster pincodes into service zones: (pincodes, summary per cluster)."""
    profile = pincode_profile(df, spec) if profile is None else profile
    data = add_shares(profile, spec).drop(spec.share_names[2]).withColumn(
        "daily_avg", numeric.ratio(F.col(spec.total), F.col("active_days"))
    )
    points = scaled_points(data, ["daily_avg", *spec.share_names[:2]], spec.geo_keys("pincode"))
    zoned = _placed(points, kmeans.best_fits(points, [n_clusters], seed, restarts).get(n_clusters))
    summary = zoned.groupBy("cluster").agg(
        F.count("*").alias("pincodes"),
        F.sum(spec.total).alias(spec.total),
        F.round(F.avg("daily_avg"), 2).alias("daily_avg"),
    )
    return zoned, summary
