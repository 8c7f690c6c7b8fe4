"""Queries on series, features, distances, clusters, sequences, points and tests (D, G, A, P, F, C, N, K, T, Q)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from intervalia.operators import intervals as I
from intervalia.operators import measures as X
from intervalia.operators import pair_ranks, tiles
from intervalia.operators.offsets import slid
from intervalia.operators.rangejoin import points_in
from intervalia.plans.registry import query
from intervalia.sources.fixtures import frames, intervals, points, spread, table, vectors, with_

FR, IV, VE = with_("fr"), with_("iv"), with_("ve")
R = F.round
#: An hour in microseconds.
H = I.HOUR


def by_frame():
    return Window.partitionBy("vec_id").orderBy("k")


# signals


@query("d01_binomial_smoothing", FR + ", p AS (SELECT *, max(k) OVER (PARTITION BY vec_id) AS n FROM fr) SELECT a.vec_id, a.k, round(sum(b.x * w.w) / 16, 6) AS y FROM p a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([1, 4, 6, 4, 1]) AS w) w, fr b WHERE b.vec_id = a.vec_id AND b.k = least(greatest(a.k + w.o, 1), a.n) GROUP BY a.vec_id, a.k")
def d01(spark, d):
    x = frames(spark, d)
    w, whole = by_frame(), by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = F.first("x").over(whole), F.last("x").over(whole)
    at = lambda o: F.coalesce(F.lag("x", -o).over(w), lo if o < 0 else hi)
    y = sum(at(o) * c for o, c in ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))) / 16
    return x.select("vec_id", "k", R(y, 6).alias("y"))


@query("d06_noise_floor", FR + ", m AS (SELECT vec_id, k, min(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS lo, count(*) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS n FROM fr) SELECT vec_id, round(max(lo), 6) AS threshold FROM m WHERE n = 9 GROUP BY vec_id")
def d06(spark, d):
    w = by_frame().rowsBetween(0, 8)
    m = frames(spark, d).select("vec_id", F.min("x").over(w).alias("lo"), F.count("*").over(w).alias("n")).where("n = 9")
    return m.groupBy("vec_id").agg(R(F.max("lo"), 6).alias("threshold"))


@query("d12_total_power", VE + " SELECT vec_id, round(sqrt(list_sum([x * x for x in v])), 6) AS power FROM ve")
def d12(spark, d):
    return vectors(spark, d).select("vec_id", R(F.sqrt(X.total(F.transform("v", lambda x: x * x))), 6).alias("power"))


@query("d13_centroid", FR + " SELECT vec_id, round(sum(k * abs(x)) / sum(abs(x)), 6) AS centroid FROM fr GROUP BY vec_id")
def d13(spark, d):
    return frames(spark, d).groupBy("vec_id").agg(R(F.sum(F.col("k") * F.abs("x")) / F.sum(F.abs("x")), 6).alias("centroid"))


@query("d14_wiener_entropy", FR + " SELECT vec_id, round(avg(ln(x * x + 1e-9)) - ln(avg(x * x + 1e-9)), 6) AS entropy FROM fr GROUP BY vec_id")
def d14(spark, d):
    p = F.col("x") * F.col("x") + 1e-9
    return frames(spark, d).groupBy("vec_id").agg(R(F.avg(F.log(p)) - F.log(F.avg(p)), 6).alias("entropy"))


@query("d15_frequency_modulation", FR + ", g AS (SELECT vec_id, x - lag(x) OVER w AS dt, lead(x) OVER w - x AS df FROM fr WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, round(atan2(max(dt * dt), max(df * df)) * 180 / pi(), 6) AS fm, round(-sum(dt), 6) AS am FROM g GROUP BY vec_id")
def d15(spark, d):
    w = by_frame()
    g = frames(spark, d).select("vec_id", (F.col("x") - F.lag("x").over(w)).alias("dt"), (F.lead("x").over(w) - F.col("x")).alias("df"))
    sq = lambda c: F.max(F.col(c) * F.col(c))
    return g.groupBy("vec_id").agg(R(F.atan2(sq("dt"), sq("df")) * 180 / F.pi(), 6).alias("fm"), R(-F.sum("dt"), 6).alias("am"))


@query("d20_interpolation", FR + ", g AS (SELECT vec_id, k, x, lead(x) OVER (PARTITION BY vec_id ORDER BY k) AS nx FROM fr), q AS (SELECT unnest([1.5, 10.25, 33.75]) AS place) SELECT vec_id, place::DOUBLE AS place, round(x + (nx - x) * (place - k), 6) AS y FROM g, q WHERE k = floor(place)")
def d20(spark, d):
    g = frames(spark, d).withColumn("nx", F.lead("x").over(by_frame()))
    g = g.withColumn("place", F.explode(F.array(*[F.lit(x) for x in (1.5, 10.25, 33.75)]))).where(F.col("k") == F.floor("place"))
    return g.select("vec_id", "place", R(F.col("x") + (F.col("nx") - F.col("x")) * (F.col("place") - F.col("k")), 6).alias("y"))


@query("d21_time_to_string", IV + " SELECT id, printf('%02d:%02d.%02d', (stop_us - start_us) // 60000000, (stop_us - start_us) % 60000000 // 1000000, (stop_us - start_us) % 1000000 // 10000) AS clock FROM iv")
def d21(spark, d):
    us = F.col("stop_us") - F.col("start_us")
    parts = [F.floor(us / 60_000_000), F.floor(us % 60_000_000 / 1_000_000), F.floor(us % 1_000_000 / 10_000)]
    return intervals(spark, d).select("id", F.format_string("%02d:%02d.%02d", *parts).alias("clock"))


@query("d22_sliding_hamming", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE length(text) >= 5) SELECT doc_id, list_min([(c[o] <> 't')::INT + (c[o + 1] <> 'h')::INT + (c[o + 2] <> 'e')::INT + (c[o + 3] <> 'r')::INT + (c[o + 4] <> 'e')::INT for o in range(1, len(c) - 3)]) / 5.0 AS distance FROM w")
def d22(spark, d):
    t = table(spark, d, "documents").where(F.length("text") >= 5).select("doc_id", F.regexp_extract_all("text", F.lit("(?s)."), 0).alias("c"))
    miss = lambda o: sum(F.when(F.get("c", o + k) != c, 1).otherwise(0) for k, c in enumerate("there"))
    return t.select("doc_id", (F.array_min(F.transform(F.sequence(F.lit(0), F.size("c") - 5), miss)) / 5.0).alias("distance"))


@query("d24_peaks", FR + ", n AS (SELECT vec_id, k, x, lag(x) OVER w AS p, lead(x) OVER w AS q FROM fr WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, k FROM n WHERE x >= p AND x >= q AND x >= 0.1")
def d24(spark, d):
    w = by_frame()
    n = frames(spark, d).withColumns({"p": F.lag("x").over(w), "q": F.lead("x").over(w)})
    return n.where("x >= p AND x >= q AND x >= 0.1").select("vec_id", "k")


@query("g02_sound_regions", FR + ", f AS (SELECT vec_id, k, x, (abs(x) > 0.1)::INT AS on_ FROM fr), g AS (SELECT *, k - row_number() OVER (PARTITION BY vec_id, on_ ORDER BY k) AS g FROM f) SELECT vec_id, min(k) AS k0, max(k) AS k1, round(sum(abs(x)), 6) AS mass FROM g WHERE on_ = 1 GROUP BY vec_id, g HAVING count(*) >= 3")
def g02(spark, d):
    f = frames(spark, d).where(F.abs("x") > 0.1)
    f = f.withColumn("g", F.col("k") - F.row_number().over(by_frame()))
    return f.groupBy("vec_id", "g").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), R(F.sum(F.abs("x")), 6).alias("mass"), F.count("*").alias("n")).where("n >= 3").drop("g", "n")


@query("g05_silence_votes", FR + ", s AS (SELECT vec_id, k, (abs(x) < 0.05)::INT + (avg(abs(x)) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) < 0.07)::INT + (avg(abs(x)) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) < 0.09)::INT AS votes FROM fr) SELECT vec_id, sum((votes >= 2)::INT)::BIGINT AS silent FROM s GROUP BY vec_id")
def g05(spark, d):
    a, w = F.abs("x"), by_frame()
    low = lambda c, t: F.when(c < t, 1).otherwise(0)
    votes = low(a, 0.05) + low(F.avg(a).over(w.rowsBetween(-1, 1)), 0.07) + low(F.avg(a).over(w.rowsBetween(-3, 3)), 0.09)
    return frames(spark, d).withColumn("votes", votes).groupBy("vec_id").agg(F.sum(F.when(F.col("votes") >= 2, 1).otherwise(0)).alias("silent"))


@query("g07_click_fraction", FR + " SELECT vec_id, round(sum(CASE WHEN k > 48 THEN x * x ELSE 0 END) / sum(x * x), 6) AS high FROM fr GROUP BY vec_id")
def g07(spark, d):
    p = F.col("x") * F.col("x")
    return frames(spark, d).groupBy("vec_id").agg(R(F.sum(F.when(F.col("k") > 48, p).otherwise(0)) / F.sum(p), 6).alias("high"))


# features


@query("a01_reductions", FR + ", g AS (SELECT vec_id, avg(x) AS mean, stddev_samp(x) AS std, max(x) AS max, min(x) AS min, list(x ORDER BY k) AS s, count(*) AS n, coalesce(corr(x, k), 0) AS lintrend, arg_min(k, (-x, k)) AS peak, arg_min(k, (x, k)) AS trough FROM fr GROUP BY vec_id) SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(max, 6) AS max, round(min, 6) AS min, round(s[ceil(n * 0.1)::INT], 6) AS attack, round(s[ceil(n * 0.5)::INT], 6) AS sustain, round(s[ceil(n * 0.9)::INT], 6) AS release, round(lintrend, 6) AS lintrend, peak, trough FROM g")
def a01(spark, d):
    x = X.reductions(frames(spark, d))
    return x.select("vec_id", *[R(c, 6).alias(c) for c in x.columns[1:-2]], "peak", "trough")


@query("a05_local_patches", VE + ", p AS (SELECT vec_id, unnest([1, 17, 33, 49]) AS k, v FROM ve) SELECT vec_id, k, round(list_sum(v[k:k + 3]), 6) AS patch FROM p")
def a05(spark, d):
    v = vectors(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(49), F.lit(16))))
    return v.select("vec_id", "k", R(X.total(F.slice("v", F.col("k"), F.lit(4))), 6).alias("patch"))


@query("a06_zscores", FR + ", s AS (SELECT k, avg(x) AS m, stddev_samp(x) AS s FROM fr GROUP BY k) SELECT vec_id, k, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 5) AS z FROM fr JOIN s USING (k)")
def a06(spark, d):
    return X.zscores(frames(spark, d)).select("vec_id", "k", R("z", 5).alias("z"))


@query("a10_quartile_split", "WITH q AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.25) AS lo, quantile_cont(l_extendedprice, 0.75) AS hi FROM lineitem GROUP BY 1) SELECT flag, round(avg(CASE WHEN l_extendedprice <= lo THEN l_quantity END), 6) AS low_mean, round(avg(CASE WHEN l_extendedprice >= hi THEN l_quantity END), 6) AS high_mean, count(*) FILTER (WHERE l_extendedprice <= lo) AS n_low FROM lineitem JOIN q ON flag = l_returnflag GROUP BY flag")
def a10(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_quantity")
    q = x.groupBy("flag").agg(F.percentile("l_extendedprice", 0.25).alias("lo"), F.percentile("l_extendedprice", 0.75).alias("hi"))
    low, high = F.col("l_extendedprice") <= F.col("lo"), F.col("l_extendedprice") >= F.col("hi")
    x = x.join(F.broadcast(q), "flag")
    return x.groupBy("flag").agg(R(F.avg(F.when(low, F.col("l_quantity"))), 6).alias("low_mean"), R(F.avg(F.when(high, F.col("l_quantity"))), 6).alias("high_mean"), F.count_if(low).alias("n_low"))


@query("a12_day_summary", IV + " SELECT start_us // 86400000000 AS day, count(*) AS n, count(*) FILTER (WHERE type IN ('click', 'view')) AS n_labeled, sum(stop_us - start_us)::BIGINT AS total_us, round(100.0 * count(*) FILTER (WHERE type IN ('click', 'view')) / count(*), 6) AS share FROM iv GROUP BY 1")
def a12(spark, d):
    named = F.col("type").isin("click", "view")
    x = intervals(spark, d).groupBy(F.floor(F.col("start_us") / 86_400_000_000).alias("day"))
    return x.agg(F.count("*").alias("n"), F.count_if(named).alias("n_labeled"), F.sum(F.col("stop_us") - F.col("start_us")).alias("total_us"), R(100.0 * F.count_if(named) / F.count("*"), 6).alias("share"))


@query("a13_cube_counts", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a13(spark, d):
    x = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return x.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("a14_duration_histogram", IV + ", h AS (SELECT (stop_us - start_us) // 300000000 AS bin, count(*) AS n FROM iv GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 9) AS pdf FROM h")
def a14(spark, d):
    h = intervals(spark, d).groupBy(F.floor((F.col("stop_us") - F.col("start_us")) / 300_000_000).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("pdf", R(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("a15_histogram_2d", "SELECT least(floor(l_quantity / 10), 4)::BIGINT AS bx, floor(l_discount * 50)::BIGINT AS byy, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a15(spark, d):
    x = table(spark, d, "lineitem")
    return x.groupBy(F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).alias("bx"), F.floor(F.col("l_discount") * 50).alias("byy")).agg(F.count("*").alias("n"))


@query("a17_group_mean_sem", "SELECT l_linestatus AS status, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount) / sqrt(count(*)), 9) AS sem FROM lineitem GROUP BY 1")
def a17(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), R(F.avg("l_discount"), 6).alias("mean"), R(F.stddev_samp("l_discount") / F.sqrt(F.count("*")), 9).alias("sem"))


# distances, ranks, clusters, over all vectors

TRAIN = "WITH ve AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), pr AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS d FROM ve a JOIN ve b ON a.vec_id < b.vec_id), sy AS (SELECT i, j, li, lj, d FROM pr UNION ALL SELECT j, i, lj, li, d FROM pr)"


def train(spark, d):
    return vectors(spark, d)


@query("p01_pairwise_euclidean", TRAIN + " SELECT i, j, round(d, 6) AS d FROM pr")
def p01(spark, d):
    return X.pairs(train(spark, d)).select("i", "j", R("d", 6).alias("d"))


@query("p02_standardised_distance", "WITH fr AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT k, avg(x) AS m, stddev_samp(x) AS s FROM fr GROUP BY k), z AS (SELECT vec_id, list(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END ORDER BY k) AS v FROM fr JOIN s USING (k) GROUP BY vec_id), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM z a JOIN z b ON a.vec_id < b.vec_id) SELECT i, j, round(d / max(d) OVER (), 6) AS d FROM p")
def p02(spark, d):
    z = X.zscores(frames(spark, d))
    v = z.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda s: s["z"]).alias("v")).withColumn("label", F.lit(0))
    p = X.pairs(v)
    return p.crossJoin(F.broadcast(p.agg(F.max("d").alias("most")))).select("i", "j", R(F.col("d") / F.col("most"), 6).alias("d"))


@query("p03_templates_by_items", VE + " SELECT t.vec_id AS template, i.vec_id AS item, round(list_distance(t.v, i.v), 6) AS d FROM ve t JOIN ve i ON true")
def p03(spark, d):
    p = X.pairs(vectors(spark, d)).select("i", "j", "d")
    own = vectors(spark, d).select(F.col("vec_id").alias("template"), F.col("vec_id").alias("item"), F.lit(0.0).alias("d"))
    both = p.select(F.col("i").alias("template"), F.col("j").alias("item"), R("d", 6).alias("d")).union(p.select("j", "i", R("d", 6)))
    return both.union(own)


@query("p09_sliding_cosine", VE + ", o AS (SELECT a.vec_id AS i, b.vec_id AS j, unnest(range(1, 34)) AS o, a.v[1:32] AS x, b.v AS y FROM ve a JOIN ve b ON true) SELECT i, j, round(max(list_cosine_similarity(x, y[o:o + 31])), 6) AS best FROM o GROUP BY i, j")
def p09(spark, d):
    return slid(vectors(spark, d), wanted=("most",), digits=6).withColumnRenamed("most", "best")


@query("p13_correlation_distance", TRAIN + ", f AS (SELECT i, j, d FROM sy UNION ALL SELECT vec_id, vec_id, 0 FROM ve) SELECT a.i AS i, b.i AS j, round(1 - corr(a.d, b.d), 6) AS d FROM f a JOIN f b ON a.j = b.j AND a.i < b.i GROUP BY a.i, b.i")
def p13(spark, d):
    """The rows of distances are formed anew in each tile, as they are many times the vectors."""
    return tiles.correlation_distances(train(spark, d)).select("i", "j", R(F.col("d"), 6).alias("d"))


@query("p15_length_distance", "WITH e AS (SELECT s_suppkey AS id, s_acctbal AS value FROM supplier), p AS (SELECT a.id AS i, b.id AS j, abs(a.value - b.value) AS d FROM e a JOIN e b ON a.id < b.id) SELECT i, j, round(d / max(d) OVER (), 6) AS d FROM p")
def p15(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("vec_id"), F.array(F.col("s_acctbal").cast("double")).alias("v"), F.lit(0).alias("label"))
    p = X.pairs(e).select("i", "j", "d")
    # the largest distance of numbers is their range, which needs no pairs
    most = e.agg((F.max(F.col("v")[0]) - F.min(F.col("v")[0])).alias("m"))
    return p.crossJoin(F.broadcast(most)).select("i", "j", R(F.col("d") / F.col("m"), 6).alias("d"))


RANKED = TRAIN + ", rk AS (SELECT *, row_number() OVER (ORDER BY round(d, 6), i, j) / count(*) OVER () AS p FROM pr)"


def ranked(spark, d, f, schema):
    """f(strip, rows, p) of the ranks of the pairs by distance, in the order of i and j."""
    return pair_ranks.Swept(train(spark, d), pair_ranks.Euclidean).ranks(f, schema)


def local_and_global(p: np.ndarray, f: float) -> np.ndarray:
    return np.exp(f * np.log(p) + (1 - f) * np.log(p / 2 + 0.1))


@query("f01_empirical_rank", RANKED + " SELECT i, j, round(p, 9) AS p FROM rk")
def f01(spark, d):
    return ranked(spark, d, lambda s, rows, p: pair_ranks.pairs(s, rows, p=pair_ranks.rounded(p, 9)), "i long, j long, p double")


@query("f03_geometric_fusion", RANKED + " SELECT i, j, round(sqrt(p * (1 - p)), 9) AS fused FROM rk")
def f03(spark, d):
    return ranked(spark, d, lambda s, rows, p: pair_ranks.pairs(s, rows, fused=pair_ranks.rounded(np.sqrt(p * (1 - p)), 9)), "i long, j long, fused double")


@query("f04_weighted_fusion", RANKED + ", w AS (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS f) SELECT i, j, f, round(exp(f * ln(p) + (1 - f) * ln(p / 2 + 0.1)), 9) AS fused FROM rk, w")
def f04(spark, d):
    weights = {"a": 0.25, "b": 0.5, "c": 0.75}
    x = ranked(spark, d, lambda s, rows, p: pair_ranks.pairs(s, rows, **{k: pair_ranks.rounded(local_and_global(p, f), 9) for k, f in weights.items()}), "i long, j long, a double, b double, c double")
    return x.select("i", "j", F.stack(F.lit(len(weights)), *[c for k, f in weights.items() for c in (F.lit(f), F.col(k))]).alias("f", "fused"))


CENTRE = TRAIN + ", me AS (SELECT i, li, avg(d * d) AS ms, sum(d * d) AS ss FROM sy WHERE li = lj GROUP BY i, li), md AS (SELECT li AS label, arg_min(i, (round(ms, 9), i)) AS medoid, arg_min(ms, (round(ms, 9), i)) AS ms FROM me GROUP BY li)"


def medoids(spark, d):
    own = X.symmetric(X.pairs(train(spark, d), within=True))
    each = own.groupBy("i", "li").agg(F.avg(F.col("d") * F.col("d")).alias("ms"))
    return each.groupBy(F.col("li").alias("label")).agg(F.min(F.struct(R("ms", 9).alias("r"), "i", "ms")).alias("m")).select("label", F.col("m.i").alias("medoid"), F.col("m.ms").alias("ms"))


@query("c09_davies_bouldin", CENTRE + ", q AS (SELECT a.label, avg((sqrt(a.ms) + sqrt(b.ms)) / list_distance(x.v, y.v)) AS di FROM md a JOIN md b ON a.label <> b.label JOIN ve x ON x.vec_id = a.medoid JOIN ve y ON y.vec_id = b.medoid GROUP BY a.label) SELECT label, round(di, 6) AS di FROM q")
def c09(spark, d):
    m = medoids(spark, d).join(train(spark, d).select(F.col("vec_id").alias("medoid"), "v"), "medoid")
    a, b = m.alias("a"), m.alias("b")
    p = a.join(b, F.col("a.label") != F.col("b.label"))
    return p.groupBy(F.col("a.label").alias("label")).agg(R(F.avg((F.sqrt("a.ms") + F.sqrt("b.ms")) / X.euclidean(F.col("a.v"), F.col("b.v"))), 6).alias("di"))


@query("c10_cluster_distances", TRAIN + ", o AS (SELECT i, sum(CASE WHEN li = lj THEN d ELSE 0 END) / (count(*) FILTER (WHERE li = lj) + 1) AS own, avg(CASE WHEN li <> lj THEN d END) AS other FROM sy GROUP BY i) SELECT i, round(own, 6) AS intra, round(own / other, 6) AS inter FROM o")
def c10(spark, d):
    same = F.col("li") == F.col("lj")
    own = F.sum(F.when(same, F.col("s")).otherwise(0)) / (F.sum(F.when(same, F.col("n")).otherwise(0)) + 1)
    s = X.sums(train(spark, d)).groupBy("i").agg(own.alias("own"), (F.sum(F.when(~same, F.col("s"))) / F.sum(F.when(~same, F.col("n")))).alias("other"))
    return s.select("i", R("own", 6).alias("intra"), R(F.col("own") / F.col("other"), 6).alias("inter"))


@query("c11_cluster_diameter", TRAIN + " SELECT li AS label, round(max(d), 6) AS diameter, round(avg(d), 6) AS mean_sep, round(stddev_samp(d), 6) AS std_sep FROM pr WHERE li = lj GROUP BY li")
def c11(spark, d):
    return X.pairs(train(spark, d), within=True).groupBy(F.col("li").alias("label")).agg(R(F.max("d"), 6).alias("diameter"), R(F.avg("d"), 6).alias("mean_sep"), R(F.stddev_samp("d"), 6).alias("std_sep"))


CENTRAL = TRAIN + ", a AS (SELECT i, li, avg(d) AS m FROM sy WHERE li = lj GROUP BY i, li), o AS (SELECT i, li, row_number() OVER (PARTITION BY li ORDER BY round(m, 6), i) AS place FROM a)"


def central(spark, d):
    a = X.sums(train(spark, d), within=True).select("i", "li", (F.col("s") / F.col("n")).alias("m"))
    return a.withColumn("place", F.row_number().over(Window.partitionBy("li").orderBy(R("m", 6), "i")))


@query("c12_most_central", CENTRAL + " SELECT i, li AS label, place FROM o")
def c12(spark, d):
    return central(spark, d).select("i", F.col("li").alias("label"), "place")


@query("c13_conformity", TRAIN + " SELECT li AS label, round(avg(d) FILTER (WHERE li = lj) / avg(d) FILTER (WHERE li <> lj), 6) AS mean_ratio, round(var_samp(d) FILTER (WHERE li = lj) / var_samp(d) FILTER (WHERE li <> lj), 6) AS var_ratio FROM sy GROUP BY li")
def c13(spark, d):
    same = F.col("li") == F.col("lj")
    total = lambda c, where: F.sum(F.when(where, F.col(c)))
    mean = lambda w: total("s", w) / total("n", w)
    var = lambda w: F.when(total("n", w) > 1, (total("q", w) - total("s", w) * mean(w)) / (total("n", w) - 1))
    return X.sums(train(spark, d)).groupBy(F.col("li").alias("label")).agg(R(mean(same) / mean(~same), 6).alias("mean_ratio"), R(var(same) / var(~same), 6).alias("var_ratio"))


@query("c18_exemplars", CENTRAL + " SELECT i, li AS label FROM o WHERE place <= 5")
def c18(spark, d):
    return central(spark, d).where("place <= 5").select("i", F.col("li").alias("label"))


@query("c15_relabel", "SELECT vec_id, CASE WHEN label IN (0, 1) THEN 100 WHEN label IN (2, 3) THEN 101 ELSE label END AS label FROM embeddings")
def c15(spark, d):
    to = spark.createDataFrame([(0, 100), (1, 100), (2, 101), (3, 101)], "label int, new int")
    return vectors(spark, d).join(F.broadcast(to), "label", "left").select("vec_id", F.coalesce("new", "label").alias("label"))


# sequences


def grams(n: int):
    """The n-grams of characters of `text`; the characters are split once, as substrings of UTF-8 are not O(1)."""
    at = lambda c: F.transform(F.sequence(F.lit(0), F.length("text") - n), lambda k: F.concat(*[F.get(c, k + i) for i in range(n)]))
    return F.get(F.transform(F.array(F.split("text", "")), at), 0)


@query("n01_ngram_counts", "WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - 2)) AS k FROM documents), g AS (SELECT substr(text, k, 4) AS gram, count(*) AS n FROM w GROUP BY 1) SELECT gram, n FROM g WHERE n > 20")
def n01(spark, d):
    t = spread(table(spark, d, "documents").where(F.length("text") >= 4).select("doc_id", "text"), "doc_id")
    g = t.select(F.explode(grams(4)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n")).where("n > 20")


@query("n02_ngram_durations", IV + ", g AS (SELECT type || lead(type) OVER w AS gram, lead(stop_us) OVER w - start_us AS span FROM iv WINDOW w AS (PARTITION BY series ORDER BY start_us, id)) SELECT gram, count(*) AS n, round(avg(span), 2) AS mean_us FROM g WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) > 1")
def n02(spark, d):
    w = I.order()
    g = intervals(spark, d).select(F.concat("type", F.lead("type").over(w)).alias("gram"), (F.lead("stop_us").over(w) - F.col("start_us")).alias("span")).where("gram IS NOT NULL")
    return g.groupBy("gram").agg(F.count("*").alias("n"), R(F.avg("span"), 2).alias("mean_us")).where("n > 1")


@query("n04_transitions", IV + ", t AS (SELECT type AS a, CASE WHEN lead(start_us) OVER w - stop_us > 7200000000 THEN 'silence' ELSE lead(type) OVER w END AS b FROM iv WINDOW w AS (PARTITION BY series ORDER BY start_us, id)), c AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY a, b) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM c")
def n04(spark, d):
    w = I.order()
    t = intervals(spark, d).select(F.col("type").alias("a"), F.when(F.lead("start_us").over(w) - F.col("stop_us") > 2 * H, "silence").otherwise(F.lead("type").over(w)).alias("b")).where("b IS NOT NULL")
    c = t.groupBy("a", "b").agg(F.count("*").alias("n"))
    return c.withColumn("p", R(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 9))


@query("n06_occurrences", "WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS k FROM documents WHERE text LIKE '%ther%') SELECT doc_id, k FROM w WHERE substr(text, k, 4) = 'ther'")
def n06(spark, d):
    t = table(spark, d, "documents").where(F.contains("text", F.lit("ther")))
    g = t.select("doc_id", F.posexplode(grams(4)).alias("k", "gram")).where("gram = 'ther'")
    return g.select("doc_id", (F.col("k") + 1).alias("k"))


@query("k04_confusion_matrix", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def k04(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("k08_match_runs", IV + ", w AS (SELECT series, start_us // 3600000000 AS h, count(*) AS n FROM iv GROUP BY 1, 2), r AS (SELECT series, h, h - row_number() OVER (PARTITION BY series ORDER BY h) AS g FROM w WHERE n >= 1) SELECT series, min(h) AS h0, max(h) AS h1, count(*) AS n FROM r GROUP BY series, g HAVING count(*) >= 2")
def k08(spark, d):
    w = intervals(spark, d).groupBy("series", F.floor(F.col("start_us") / H).alias("h")).agg(F.count("*").alias("n"))
    r = w.withColumn("g", F.col("h") - F.row_number().over(Window.partitionBy("series").orderBy("h")))
    return r.groupBy("series", "g").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.count("*").alias("n")).where("n >= 2").drop("g")


# points

PT = with_("iv", "pt") + ", pu AS (SELECT * FROM iv WHERE type = 'purchase')"


def spikes(spark, d, kind="purchase"):
    return points_in(intervals(spark, d, kind), points(spark, d), H)


@query("t01_count_points", PT + " SELECT i.id, count(t_us) AS n, round(count(t_us) / nullif((stop_us - start_us) / 1e6, 0), 9) AS rate FROM pu i LEFT JOIN pt ON pt.series = i.series AND t_us BETWEEN start_us AND stop_us GROUP BY i.id, start_us, stop_us")
def t01(spark, d):
    n = spikes(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    x = intervals(spark, d, "purchase").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    length = (F.col("stop_us") - F.col("start_us")) / 1e6
    return x.select("id", "n", R(F.when(length != 0, F.col("n") / length), 9).alias("rate"))


@query("t02_psth", PT + " SELECT (t_us - start_us) // 600000000 AS bin, count(*) AS n FROM pu i JOIN pt ON pt.series = i.series AND t_us BETWEEN start_us AND stop_us GROUP BY 1")
def t02(spark, d):
    return spikes(spark, d).groupBy(F.floor((F.col("t_us") - F.col("start_us")) / 600_000_000).alias("bin")).agg(F.count("*").alias("n"))


@query("t03_raster", PT + ", o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY start_us, id) AS y FROM pu) SELECT i.series, t_us - start_us AS x, y FROM o i JOIN pt ON pt.series = i.series AND t_us BETWEEN start_us AND stop_us")
def t03(spark, d):
    y = intervals(spark, d, "purchase").withColumn("y", F.row_number().over(I.order()))
    return points_in(y, points(spark, d), H).select("series", (F.col("t_us") - F.col("start_us")).alias("x"), "y")


@query("t05_intervals_between_points", with_("pt") + ", g AS (SELECT t_us - lag(t_us) OVER (PARTITION BY series ORDER BY t_us) AS gap FROM pt) SELECT floor(log10(gap / 1e6) * 4)::BIGINT AS bin, count(*) AS n FROM g WHERE gap > 0 GROUP BY 1")
def t05(spark, d):
    g = points(spark, d).select((F.col("t_us") - F.lag("t_us").over(Window.partitionBy("series").orderBy("t_us"))).alias("gap")).where("gap > 0")
    return g.groupBy(F.floor(F.log10(F.col("gap") / 1e6) * 4).alias("bin")).agg(F.count("*").alias("n"))


@query("t06_baseline_rate", IV + " SELECT series, round((count(*) - count(*) FILTER (WHERE type = 'view')) / ((max(stop_us) - min(start_us)) / 1e6 + 1), 9) AS rate FROM iv GROUP BY series")
def t06(spark, d):
    x = intervals(spark, d).groupBy("series")
    return x.agg(R((F.count("*") - F.count_if(F.col("type") == "view")) / ((F.max("stop_us") - F.min("start_us")) / 1e6 + 1), 9).alias("rate"))


@query("t07_standardised_response", "SELECT l_returnflag AS flag, round((avg(l_quantity) - avg(l_discount)) * sqrt(count(*)) / sqrt(var_samp(l_quantity) + var_samp(l_discount) - 2 * covar_samp(l_quantity, l_discount)), 5) AS z FROM lineitem GROUP BY 1")
def t07(spark, d):
    s, b = F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(R((F.avg(s) - F.avg(b)) * F.sqrt(F.count("*")) / F.sqrt(F.var_samp(s) + F.var_samp(b) - 2 * F.covar_samp(s, b)), 5).alias("z"))


@query("t08_median_split", "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_type, round(avg(value) FILTER (WHERE value < m), 6) AS near, round(avg(value) FILTER (WHERE value > m), 6) AS far FROM events JOIN m USING (event_type) GROUP BY 1")
def t08(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    m = e.groupBy("event_type").agg(F.percentile("value", 0.5).alias("m"))
    e = e.join(F.broadcast(m), "event_type")
    return e.groupBy("event_type").agg(R(F.avg(F.when(F.col("value") < F.col("m"), F.col("value"))), 6).alias("near"), R(F.avg(F.when(F.col("value") > F.col("m"), F.col("value"))), 6).alias("far"))


@query("t09_sparseness", "WITH c AS (SELECT user_id, event_type, count(*) AS r FROM events GROUP BY 1, 2) SELECT user_id, round((1 - pow(sum(r) / 5.0, 2) / (sum(r * r) / 5.0)) / (1 - 1 / 5.0), 6) AS sparseness FROM c GROUP BY 1")
def t09(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("r"))
    return c.groupBy("user_id").agg(R((1 - F.pow(F.sum("r") / 5.0, 2) / (F.sum(F.col("r") * F.col("r")) / 5.0)) / (1 - 1 / 5.0), 6).alias("sparseness"))


@query("t10_share_by_group", "SELECT event_type, round(avg((value > 20)::INT), 9) AS share FROM events GROUP BY 1")
def t10(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(R(F.avg(F.when(F.col("value") > 20, 1).otherwise(0)), 9).alias("share"))


@query("t13_bin_points", with_("pt") + " SELECT series, t_us // 86400000000 AS bin, count(*) AS n FROM pt GROUP BY 1, 2")
def t13(spark, d):
    return points(spark, d).groupBy("series", F.floor(F.col("t_us") / 86_400_000_000).alias("bin")).agg(F.count("*").alias("n"))


@query("t17_triggered_windows", PT + " SELECT i.id, t_us - i.start_us AS at FROM pu i JOIN pt ON pt.series = i.series AND t_us > i.start_us - 3600000000 AND t_us <= i.start_us + 3600000000")
def t17(spark, d):
    around = intervals(spark, d, "purchase").select("id", "series", F.col("start_us").alias("e"), (F.col("start_us") - H).alias("start_us"), (F.col("start_us") + H).alias("stop_us"))
    return points_in(around, points(spark, d), H).where("t_us > start_us").select("id", (F.col("t_us") - F.col("e")).alias("at"))


@query("t19_nearest_interval", IV + ", p AS (SELECT e.id, b.id AS near, row_number() OVER (PARTITION BY e.id ORDER BY least(abs(b.stop_us - e.start_us), abs(b.start_us - e.stop_us)), b.id) AS k FROM iv e JOIN iv b ON e.series = b.series AND e.type = 'purchase' AND b.type = 'view') SELECT id, near FROM p WHERE k = 1")
def t19(spark, d):
    return I.nearest(intervals(spark, d, "purchase"), intervals(spark, d, "view"))


@query("t21_most_responsive", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def t21(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@query("t24_mean_sem_by_label", "SELECT event_type, user_id, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def t24(spark, d):
    g = table(spark, d, "events").groupBy("event_type", "user_id").agg(R(F.avg("value"), 6).alias("mean"), R(F.stddev_samp("value") / F.sqrt(F.count("*")), 6).alias("sem"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


# tests


@query("q01_one_sample_t", "SELECT l_returnflag AS flag, round((avg(l_discount) - 0.05) / (stddev_samp(l_discount) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM lineitem GROUP BY 1")
def q01(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(R((F.avg(x) - 0.05) / (F.stddev_samp(x) / F.sqrt(F.count("*"))), 6).alias("t"), (F.count("*") - 1).alias("df"))


TWO = "WITH s AS (SELECT count(*) FILTER (WHERE l_linestatus = 'F') AS n1, count(*) FILTER (WHERE l_linestatus <> 'F') AS n2, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS m1, avg(l_quantity) FILTER (WHERE l_linestatus <> 'F') AS m2, var_samp(l_quantity) FILTER (WHERE l_linestatus = 'F') AS v1, var_samp(l_quantity) FILTER (WHERE l_linestatus <> 'F') AS v2 FROM lineitem)"


@query("q02_two_sample_t", TWO + " SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS pooled, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch, n1 + n2 - 2 AS df FROM s")
def q02(spark, d):
    x, y = (F.when(c, F.col("l_quantity")) for c in (F.col("l_linestatus") == "F", F.col("l_linestatus") != "F"))
    s = table(spark, d, "lineitem").agg(*[f(v).alias(n) for v, k in ((x, 1), (y, 2)) for f, n in ((F.count, f"n{k}"), (F.avg, f"m{k}"), (F.var_samp, f"v{k}"))])
    return s.selectExpr("round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS pooled", "round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch", "n1 + n2 - 2 AS df")


@query("q03_anova", "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm, sum(n) AS tn, count(*) AS k FROM g) SELECT round((sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / (sum(n * v) / (max(tn) - max(k))), 5) AS f FROM g, t")
def q03(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.var_pop("l_quantity").alias("v"))
    t = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum("n").alias("tn"), F.count("*").alias("k"))
    return g.crossJoin(F.broadcast(t)).agg(R(F.expr("(sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / (sum(n * v) / (max(tn) - max(k)))"), 5).alias("f"))


@query("q06_false_discovery_rate", "WITH p AS (SELECT event_id, value / (SELECT max(value) FROM events) AS p FROM events), r AS (SELECT p, row_number() OVER (ORDER BY p, event_id) AS i, count(*) OVER () AS v FROM p) SELECT round(coalesce(max(p) FILTER (WHERE p <= i * 0.9 / v), 0), 9) AS cut FROM r")
def q06(spark, d):
    e = table(spark, d, "events")
    p = e.crossJoin(F.broadcast(e.agg(F.max("value").alias("most")))).select("event_id", (F.col("value") / F.col("most")).alias("p"))
    n = p.groupBy("p").agg(F.count("*").alias("n"))
    r = n.select("p", F.sum("n").over(Window.orderBy("p")).alias("i"), F.sum("n").over(Window.partitionBy()).alias("v"))
    return r.agg(R(F.coalesce(F.max(F.when(F.col("p") <= F.col("i") * 0.9 / F.col("v"), F.col("p"))), F.lit(0.0)), 9).alias("cut"))


@query("q07_correlation", "SELECT l_returnflag AS flag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def q07(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(R(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("q08_rank_sum", "WITH r AS (SELECT l_linestatus AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem) SELECT g, round(sum(r) - count(*) * (count(*) + 1) / 2.0, 3) AS u FROM r GROUP BY g")
def q08(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v"), F.col("l_linestatus").alias("g")).agg(F.count("*").alias("n"))
    v = x.groupBy("v").agg(F.sum("n").alias("all"))
    v = v.select("v", (F.sum("all").over(Window.orderBy("v")) - F.col("all") + (F.col("all") + 1) / 2.0).alias("r"))
    s = x.join(v, "v").groupBy("g").agg(F.sum(F.col("n") * F.col("r")).alias("w"), F.sum("n").alias("n"))
    return s.select("g", R(F.col("w") - F.col("n") * (F.col("n") + 1) / 2.0, 3).alias("u"))


@query("q09_linear_regression", "SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def q09(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(R(F.regr_slope(y, x), 4).alias("slope"), R(F.regr_intercept(y, x), 3).alias("intercept"), R(F.regr_r2(y, x), 6).alias("r2"))


@query("q14_jackknife_mean", "WITH s AS (SELECT sum(value) AS s, count(*) AS n FROM events) SELECT event_id, round((s - value) / (n - 1), 9) AS leave_one_out FROM events, s")
def q14(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    s = e.agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return e.crossJoin(F.broadcast(s)).select("event_id", R((F.col("s") - F.col("value")) / (F.col("n") - 1), 9).alias("leave_one_out"))


@query("q15_ecdf", "SELECT l_quantity AS x, round(max(c), 9) AS p FROM (SELECT l_quantity, cume_dist() OVER (ORDER BY l_quantity) AS c FROM lineitem) GROUP BY 1")
def q15(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    return x.select("x", R(F.sum("n").over(Window.orderBy("x")) / F.sum("n").over(Window.partitionBy()), 9).alias("p"))


@query("q17_fano_factor", "WITH c AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, round(var_samp(n) / avg(n), 6) AS fano FROM c GROUP BY 1 HAVING count(*) > 2")
def q17(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(R(F.var_samp("n") / F.avg("n"), 6).alias("fano"), F.count("*").alias("k")).where("k > 2").drop("k")
