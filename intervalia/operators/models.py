"""Models fitted on whole tables of vectors; what reaches the driver grows with the dimensions alone."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardised(vectors: DataFrame) -> DataFrame:
    """vectors with z, a column of v by its mean and sample deviation, 0 where that is 0; null v are left out."""
    x = vectors.where("v IS NOT NULL").withColumn("_x", array_to_vector("v"))
    return StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="z").fit(x).transform(x).drop("_x")


def principal(vectors: DataFrame, share: float = 0.995) -> DataFrame:
    """vec_id and scores: the fewest principal components of z that hold the share of the variance.

    Constant columns hold none. The sign of a component is free. An empty table gives no rows.
    """
    first = vectors.where("v IS NOT NULL").select(F.size("v")).first()
    if first is None:
        return vectors.select("vec_id", F.col("v").alias("scores")).where(F.lit(False))
    z = standardised(vectors)
    model = PCA(k=first[0], inputCol="z", outputCol="p").fit(z)
    held, keep = 0.0, 0
    for part in model.explainedVariance.toArray():
        held, keep = held + part, keep + 1
        if held >= share:
            break
    return model.transform(z).select("vec_id", F.slice(vector_to_array("p"), 1, keep).alias("scores"))


def codebook(vectors: DataFrame, k: int = 8, seed: int = 7) -> DataFrame:
    """vec_id, cluster and d, the distance to the cluster's centre, of every vector, by k-means on v."""
    if not vectors.where("v IS NOT NULL").limit(1).count():
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("d")).where(F.lit(False))
    x = vectors.where("v IS NOT NULL").withColumn("x", array_to_vector("v"))
    model = KMeans(k=k, seed=seed, maxIter=50, tol=1e-6, featuresCol="x", predictionCol="cluster").fit(x)
    centres = F.array(*[F.array(*[F.lit(float(y)) for y in c]) for c in model.clusterCenters()])
    apart = F.zip_with("v", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    return model.transform(x).select("vec_id", "cluster", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda a, b: a + b)).alias("d"))


def halves(vectors: DataFrame, dims: list[int], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Vectors split in two by a mixture of two Gaussians over dims (0-based places in v).

    Returns vec_id, part and p (its probability) of every vector, and dim, d_prime of every dimension that
    varies: the difference of the means over the root of the summed variances, without sign, as the order of
    the parts is free. With fewer than two vectors or no dimension that varies, both are empty.
    """
    spark = vectors.sparkSession
    x = vectors.where("v IS NOT NULL")
    spread = x.agg(F.count("*").alias("n"), *[F.var_samp(F.get("v", F.lit(k))).alias(f"d{k}") for k in dims]).first()
    most = max((spread[f"d{k}"] or 0.0 for k in dims), default=0.0)
    varied = [k for k in dims if (spread[f"d{k}"] or 0.0) > most * 1e-12 * spread["n"]]
    if not varied:
        return spark.createDataFrame([], "vec_id long, part int, p double"), spark.createDataFrame([], "dim int, d_prime double")
    x = x.withColumn("x", array_to_vector(F.array(*[F.get("v", F.lit(k)) for k in varied])))
    model = GaussianMixture(k=2, seed=seed, maxIter=100, tol=1e-4, featuresCol="x", predictionCol="part", probabilityCol="all").fit(x)
    a, b = model.gaussians
    gap = np.abs(b.mean.toArray() - a.mean.toArray()) / np.sqrt(np.diag(a.cov.toArray()) + np.diag(b.cov.toArray()))
    parts = model.transform(x).select("vec_id", "part", F.array_max(vector_to_array("all")).alias("p"))
    return parts, spark.createDataFrame([(k, float(g)) for k, g in zip(varied, gap)], "dim int, d_prime double")
