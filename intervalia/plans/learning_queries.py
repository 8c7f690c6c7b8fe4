"""Queries of linkage, boosting, regression, resampling and recognition; beyond SQL unless given (C, K, A, N, P, Q, R)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from intervalia.operators import boosting, linkage, measures, pair_ranks, percentiles, rank_linkage, resampling
from intervalia.plans.registry import query
from intervalia.sources.fixtures import FS, intervals, table, vectors

# linkage


@query("c02_linkage_cuts")
def c02(spark, d):
    """Complete linkage of all vectors, cut into 4 to 25 clusters."""
    return linkage.cuts(vectors(spark, d), list(range(4, 26))).drop("block")


@query("c05_block_trees")
def c05(spark, d):
    """Trees by mean linkage inside each label."""
    return linkage.trees(vectors(spark, d), "label", "average").withColumn("height", F.round("height", 9))


@query("c06_alphabet")
def c06(spark, d):
    """Ward linkage cut into 20 clusters, named by letters."""
    x = linkage.cuts(vectors(spark, d), [20], rule="ward")
    names = F.array(*[F.lit(linkage.letters(k)) for k in range(1, 21)])
    return x.select("vec_id", F.element_at(names, F.col("cluster")).alias("letter"))


#: Seconds of a window of fine spectra. Frames are samples of the signals, as in p05, so fewer than ten are too short.
WINDOW = 0.00927


def fused(spark, d, *, cepstral: bool = False):
    """The geometric mean of the ranks of pairs by warped and by plain distance, of vectors whose frames last for a window."""
    far = pair_ranks.Cepstral if cepstral else pair_ranks.Warped
    long = vectors(spark, d).where(F.size("v") >= far.features * math.ceil(WINDOW * FS))
    return rank_linkage.Fused(long, far, pair_ranks.Plain)


@query("c01_cluster_pipeline")
def c01(spark, d):
    """Drop short, distances, ranks, fusion, correlation distance, complete linkage, cuts from 4 to 25."""
    return fused(spark, d).cuts(list(range(4, 26)))


@query("c03_cluster_pipeline_on_disk")
def c03(spark, d):
    """The same by way of fused ranks on disk."""
    return fused(spark, d).cuts([4, 10, 25], on_disk=True)


@query("c04_cluster_pipeline_cepstral")
def c04(spark, d):
    return fused(spark, d, cepstral=True).cuts(list(range(4, 11)))


@query("c24_clusters_by_block")
def c24(spark, d):
    """Each label clustered by itself, as a batch over series is."""
    return linkage.cuts(vectors(spark, d), list(range(4, 9)), "label").withColumnRenamed("block", "label")


@query("c25_recut_and_exemplars")
def c25(spark, d):
    """A recut into 12 clusters, with the first member of each as its exemplar."""
    x = linkage.cuts(vectors(spark, d), [12])
    first = x.groupBy("cluster").agg(F.min("vec_id").alias("exemplar"), F.count("*").alias("n"))
    return x.join(first, "cluster").select("vec_id", "cluster", "exemplar", "n")


# boosting: whether a vector is of label 0


def examples(spark, d):
    return vectors(spark, d).withColumn("y", F.when(F.col("label") == 0, 1).otherwise(-1))


def confusion(x):
    return x.groupBy("y", "predicted").agg(F.count("*").alias("n"))


@query("k01_gentle_boosting")
def k01(spark, d):
    """Confusion of 100 rounds of gentle boosting."""
    x = examples(spark, d)
    return confusion(boosting.classified(x, boosting.fit(*boosting.sample(x))))


@query("k02_boosting_folds")
def k02(spark, d):
    """Confusion of real and modest boosting over five folds."""
    x = examples(spark, d)
    out = [confusion(boosting.folds(x, 5, kind=k, rounds=30)).withColumn("kind", F.lit(k)) for k in ("real", "modest")]
    return out[0].union(out[1])


@query("k03_classify")
def k03(spark, d):
    x = examples(spark, d)
    return boosting.classified(x, boosting.fit(*boosting.sample(x), rounds=40)).select("vec_id", F.round("score", 9).alias("score"), "predicted")


@query("k12_noise_labels")
def k12(spark, d):
    """Share of each label that a model of label 0 takes for it."""
    x = examples(spark, d)
    got = boosting.classified(x, boosting.fit(*boosting.sample(x), rounds=40)).join(x.select("vec_id", "label"), "vec_id")
    return got.groupBy("label").agg(F.avg((F.col("predicted") == 1).cast("double")).alias("share"))


@query("k05_adapted_threshold")
def k05(spark, d):
    """The 90th percentile of the distances within each label: two members drawn again and again come to all its pairs."""
    return percentiles.within_labels(vectors(spark, d), 0.9).select("label", F.round("value", 9).alias("threshold"), "pairs")


@query("k06_narrowed_examples")
def k06(spark, d):
    """Each label by complete linkage into as many clusters as the root of its size, the first member of each kept."""
    return linkage.narrowed(vectors(spark, d), "label").withColumnRenamed("block", "label")


@query("k10_song_scores")
def k10(spark, d):
    """Evidence of each template slot at its place after the start of a candidate: nearest label mean of four slots."""
    v = vectors(spark, d)
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.slice("v", 16 * k + 1, 16).alias("s")) for k in range(4)]))
    x = v.select("vec_id", "label", part.alias("p")).select("vec_id", "label", "p.slot", "p.s")
    means = x.select("label", "slot", F.posexplode("s").alias("k", "x")).groupBy("label", "slot", "k").agg(F.avg("x").alias("m"))
    means = means.groupBy("label", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda t: t["m"]).alias("m"))
    met = x.join(F.broadcast(means.withColumnRenamed("label", "type")), "slot")  # as many rows as labels and slots
    gap = measures.euclidean(F.col("s"), F.col("m"))
    return met.groupBy("vec_id", "type").agg(F.round(F.sum(gap), 6).alias("evidence"), F.round(F.max(gap), 6).alias("worst"))


# regressions, resampling, fits


@query("a09_regressions")
def a09(spark, d):
    """Each of the first eight dimensions on the next eight: coefficient, standard error and three levels of significance.

    The sums of products are aggregated over all rows; what reaches the driver is 16 by 16.
    """
    return regressions(vectors(spark, d), list(range(8)), list(range(8, 16)))


def regressions(v, responses: list[int], predictors: list[int]):
    spark = v.sparkSession
    dims = responses + predictors
    p = len(predictors) + 1

    def part(batches):
        for b in batches:
            if len(b):
                x = np.column_stack([np.ones(len(b)), np.stack(b["v"].to_numpy())[:, dims]])
                yield pd.DataFrame({"s": [(x.T @ x).ravel()]})

    m = len(dims) + 1
    sums = v.where("v IS NOT NULL").select("v").mapInPandas(part, "s array<double>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
    if not sums:
        return spark.createDataFrame([], "response int, predictor int, beta double, se double, t double, p05 boolean, p01 boolean, bonferroni boolean")
    g = np.zeros(m * m)
    for r in sums:
        g[r["k"]] = r["s"]
    g = g.reshape(m, m)
    at = [0, *range(len(responses) + 1, m)]
    xx = np.linalg.inv(g[np.ix_(at, at)])
    rows = []
    for k, response in enumerate(responses, 1):
        beta = xx @ g[at, k]
        left = (g[k, k] - beta @ g[at, k]) / (g[0, 0] - p)
        se = np.sqrt(np.maximum(left * np.diag(xx), 0))
        for j, predictor in enumerate(predictors, 1):
            t = beta[j] / se[j] if se[j] > 0 else 0.0
            tail = math.erfc(abs(t) / math.sqrt(2))
            rows.append((response, predictor, float(beta[j]), float(se[j]), float(t), tail < 0.05, tail < 0.01, tail < 0.05 / len(predictors)))
    return spark.createDataFrame(rows, "response int, predictor int, beta double, se double, t double, p05 boolean, p01 boolean, bonferroni boolean")


@query("q05_sign_permutations")
def q05(spark, d):
    """Paired differences of neighbouring events of one user against 1,000 sign flips, by event type."""
    from intervalia.operators import intervals as I

    x = intervals(spark, d)
    length = (F.col("stop_us") - F.col("start_us")) / 1e6
    x = x.select(F.pmod("series", F.lit(10)).alias("key"), "id", (length - F.lag(length).over(I.order())).alias("d"))
    return resampling.sign_flips(x.where("d IS NOT NULL"))


@query("q11_duration_fits")
def q11(spark, d):
    x = intervals(spark, d).select(F.pmod("series", F.lit(10)).alias("key"), ((F.col("stop_us") - F.col("start_us")) / 6e7).alias("x"))
    return resampling.durations(x, 5.0, 90.0)


@query("q12_duration_peaks")
def q12(spark, d):
    x = intervals(spark, d).select(F.pmod("series", F.lit(10)).alias("key"), ((F.col("stop_us") - F.col("start_us")) / 6e7).alias("x"))
    return resampling.peaks(x, 5.0, 300.0, 5.0, 90.0)


@query("r07_train_and_test", "SELECT event_id, CASE WHEN (event_id * 7919 + 13) % 10007 < 8006 THEN 'train' ELSE 'test' END AS part FROM events")
def r07(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.when((F.col("event_id") * 7919 + 13) % 10007 < 8006, "train").otherwise("test").alias("part"))


@query("r08_bootstrap", "WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n, s_acctbal AS x FROM supplier), g AS (SELECT s AS size, t AS trial, unnest(range(0, s)) AS draw FROM (SELECT unnest([100, 200, 400]::BIGINT[]) AS s), (SELECT unnest(range(0, 50)) AS t)), p AS (SELECT size, trial, (trial * 104729 + draw * 15485863 + size * 32452843) % 2147483647 % (SELECT count(*) FROM supplier) AS k FROM g) SELECT size, trial, round(avg(x), 6) AS mean FROM p JOIN v USING (k) GROUP BY size, trial")
def r08(spark, d):
    """Samples with replacement of 100 * 2^k rows, 50 trials each; places come from the ids' order, by ranges."""
    from pyspark.sql import Window

    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    n = s.count()
    # suppliers by blocks of keys, so that no one window holds all rows
    block = F.floor(F.col("s_suppkey") / 4096).alias("b")
    sizes = s.groupBy(block).count()
    before = sizes.select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("before"))
    v = s.withColumn("b", block).join(F.broadcast(before), "b").select((F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("s_suppkey")) - 1).alias("k"), "x")
    g = spark.range(50).select(F.col("id").alias("trial"), F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 200, 400)])).alias("size"))
    g = g.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    k = F.when(F.lit(n) > 0, (F.col("trial") * 104729 + F.col("draw") * 15485863 + F.col("size") * 32452843) % 2147483647 % max(n, 1)).alias("k")
    return g.select("size", "trial", k).join(v, "k").groupBy("size", "trial").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("p16_pruned_features")
def p16(spark, d):
    """Dimensions left when those that alone make most of the distance to templates go, one after the other."""
    return pruned(vectors(spark, d), most=100.0, share=0.4)


def pruned(v, most: float, share: float):
    """dim and contribution of the dimensions that are left.

    Templates are the label means; distances are over z-scores. While the mean deviation of an item's distances over
    that of a template's is above `most`, the dimension with the largest mean share goes if it is above `share`.
    Only sums over items are aggregated, so the driver holds labels by dimensions.
    """
    spark = v.sparkSession
    stats = v.where("v IS NOT NULL").select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).orderBy("k").collect()
    means = v.where("v IS NOT NULL").select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m")).collect()
    n = len(stats)
    if not n:
        return spark.createDataFrame([], "dim int, contribution double")
    m, s = np.array([r["m"] for r in stats]), np.array([r["s"] or 0.0 for r in stats])
    s = np.where(s > 0, s, np.inf)
    labels = sorted({r["label"] for r in means})
    t = np.zeros((len(labels), n))
    for r in means:
        t[labels.index(r["label"]), r["k"]] = r["m"]
    t, keep = (t - m) / s, list(range(n))
    while True:

        def part(batches, keep=tuple(keep)):
            for b in batches:
                if len(b):
                    z = ((np.stack(b["v"].to_numpy()) - m) / s)[:, keep]
                    gap = np.abs(z[:, None, :] - t[None][:, :, keep])
                    d = np.sqrt((gap**2).sum(2))
                    part_of = (gap / np.maximum(d, 1e-300)[..., None]).sum((0, 1))
                    yield pd.DataFrame({"s": [np.concatenate(([len(d), d.std(1, ddof=1).sum()], d.sum(0), (d**2).sum(0), part_of))]})

        got = v.where("v IS NOT NULL").select("v").mapInPandas(part, "s array<double>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
        x = np.zeros(len(got))
        for r in got:
            x[r["k"]] = r["s"]
        rows, a = x[0], len(labels)
        spread = np.sqrt(np.maximum(x[2 + a : 2 + 2 * a] - x[2 : 2 + a] ** 2 / rows, 0) / max(rows - 1, 1))
        contribution = x[2 + 2 * a :] / (rows * a)
        top = int(contribution.argmax())
        if len(keep) > 1 and x[1] / rows / max(spread.mean(), 1e-300) > most and contribution[top] > share:
            keep.pop(top)
            continue
        return spark.createDataFrame([(k, float(c)) for k, c in zip(keep, contribution)], "dim int, contribution double")


@query("n03_common_string")
def n03(spark, d):
    """Length-weighted likeness of each user's symbols to the commonest string of four, at its best and mean offset.

    A user whose best likeness lies above the midpoint of the two halves of all users' is accepted.
    """
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.substring("event_type", 1, 1).alias("c"), F.col("value").alias("w"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lead = lambda c, k: F.lead(c, k).over(w)
    grams = e.select("user_id", F.array("c", *[lead("c", k) for k in (1, 2, 3)]).alias("g"), F.array("w", *[lead("w", k) for k in (1, 2, 3)]).alias("w")).where(F.get("g", F.lit(3)).isNotNull())
    top = grams.groupBy("g").count().orderBy(F.desc("count"), "g").limit(1).select(F.col("g").alias("top"))
    like = F.aggregate(F.zip_with(F.zip_with("g", "top", lambda a, b: (a == b).cast("double")), "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    each = grams.crossJoin(F.broadcast(top)).groupBy("user_id").agg(F.round(F.max(like), 9).alias("best"), F.round(F.avg(like), 9).alias("mean"))
    middle = each.agg(F.avg("best").alias("m"))
    halves = each.crossJoin(F.broadcast(middle)).agg(((F.avg(F.when(F.col("best") > F.col("m"), F.col("best"))) + F.avg(F.when(F.col("best") <= F.col("m"), F.col("best")))) / 2).alias("cut"))
    return each.crossJoin(F.broadcast(halves)).select("user_id", "best", "mean", (F.col("best") > F.col("cut")).alias("accepted"))
