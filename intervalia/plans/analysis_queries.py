"""Queries of codebooks, triggered averages, repeated designs, signed ranks, paired differences, trees and templates (C, T, Q, K, A, F)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from intervalia.operators import codebooks, factorial, linkage, matching, measures, models, neighbours, pair_ranks, ranks, triggered
from intervalia.plans.learning_queries import regressions
from intervalia.plans.registry import query
from intervalia.plans.signal_queries import TRAIN, train
from intervalia.sources.fixtures import frames, intervals, table, vectors, with_

# codebooks


def code(spark, d):
    v = vectors(spark, d)
    return v, codebooks.fitted(v, 20, 30, 10)[0]


@query("c26_codebook_of_restarts")
def c26(spark, d):
    """The best of 30 restarts with 20 centres: cluster, distance, and its ratio to that of the next centre."""
    return codebooks.assigned(*code(spark, d))


@query("c27_codebook_quality")
def c27(spark, d):
    """Size, mean distance and mean ratio of each cluster of that codebook."""
    return c26(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("d").alias("distance"), F.avg("ratio").alias("ratio"))


@query("c28_city_codebook")
def c28(spark, d):
    """A codebook by the sum of differences, five restarts."""
    v = vectors(spark, d)
    return codebooks.assigned(v, codebooks.fitted(v, 8, 5, 10, codebooks.city)[0], codebooks.city)


@query("c16_all_dimensions")
def c16_all(spark, d):
    """How far apart the two parts of a mixture over all dimensions are in each."""
    return models.halves(vectors(spark, d), list(range(64)))[1]


# trees


@query("c29_tree_neighbours")
def c29(spark, d):
    """Of each cluster of a label's tree, which it merges with at one cluster fewer and into what it parts at one more.

    From the cuts of the trees: a cluster at k and one at k - 1 meet in their members.
    """
    cuts = linkage.cuts(vectors(spark, d), list(range(2, 10)), "label", "average")
    size = cuts.groupBy("block", "k", "cluster").agg(F.count("*").alias("n"), F.min("vec_id").alias("member"))
    up = cuts.select("block", "vec_id", (F.col("k") + 1).alias("k"), F.col("cluster").alias("above"))
    down = cuts.select("block", "vec_id", (F.col("k") - 1).alias("k"), F.col("cluster").alias("below"))
    x = cuts.join(up, ["block", "vec_id", "k"], "left").join(down, ["block", "vec_id", "k"], "left")
    x = x.groupBy("block", "k", "cluster").agg(F.min("above").alias("above"), F.sort_array(F.collect_set("below")).alias("parts"))
    same = x.select("block", "k", F.col("cluster").alias("other"), "above")
    pairs = x.join(same, ["block", "k", "above"]).where("cluster <> other").groupBy("block", "k", "cluster").agg(F.min("other").alias("sibling"))
    return x.join(pairs, ["block", "k", "cluster"], "left").join(size, ["block", "k", "cluster"]).select("block", "k", "cluster", "n", "member", "above", "sibling", F.array_join("parts", ",").alias("parts"))


# triggered averages

TRIGGER = "s AS (SELECT vec_id // 8 AS series, (vec_id % 8) * 64 + k - 1 AS k, x FROM fr)"


def song(spark, d):
    """Eight vectors on end as samples."""
    return frames(spark, d).select(F.floor(F.col("vec_id") / 8).alias("series"), ((F.col("vec_id") % 8) * 64 + F.col("k") - 1).alias("k"), "x")


@query(
    "t28_triggered_gram",
    with_("fr") + f", {TRIGGER}, t AS (SELECT series, k, unnest(range(greatest(((k - 128) // 64 + CASE WHEN k - 128 < 0 AND (k - 128) % 64 <> 0 THEN -1 ELSE 0 END) + 1, 0), k // 64 + 1)) * 64 AS start FROM s WHERE x >= 0.2) SELECT t.series, t.start, s.k - t.k AS lag, count(*) AS n, round(avg(s.x), 9) AS mean FROM t JOIN s ON s.series = t.series AND s.k BETWEEN t.k - 8 AND t.k + 8 GROUP BY ALL",
)
def t28(spark, d):
    """The mean about samples that reach a level, by windows of 128 samples, 64 apart."""
    x = song(spark, d)
    return triggered.triggered_gram(x, x.where("x >= 0.2"), 8, 128, 64).withColumn("mean", F.round("mean", 9))


@query("t29_evoked")
def t29(spark, d):
    """The mean of the vectors of each label, smoothed over eight samples, with bootstrap errors."""
    return triggered.evoked(vectors(spark, d).select(F.col("label").alias("key"), F.col("vec_id").alias("id"), "v"), 20, 8)


# designs and ranks

BY_TYPE = "SELECT user_id AS s, event_type AS a, avg(value) AS x FROM events GROUP BY ALL"


def by_type(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("s"), F.col("event_type").alias("a")).agg(F.avg("value").alias("x"))


@query(
    "q03_repeated_one_way",
    f"""WITH f AS ({BY_TYPE}), k AS (SELECT count(DISTINCT a) AS k FROM f), w AS (SELECT s, avg(x) AS ms FROM f, k GROUP BY s, k HAVING count(*) = k),
c AS (SELECT f.x, ms, k, avg(f.x) OVER (PARTITION BY a) AS ma, avg(f.x) OVER () AS g, count(*) OVER (PARTITION BY a) AS n FROM f JOIN w USING (s), k),
r AS (SELECT max(k) - 1 AS df, (max(k) - 1) * (max(n) - 1) AS df_error, sum((ma - g) ^ 2) AS b, sum((x - ma - ms + g) ^ 2) AS e FROM c)
SELECT df, df_error, b / df / (e / df_error) AS "F" FROM r WHERE df > 0 AND df_error > 0""",
)
def q03_repeated(spark, d):
    """Mean values by type of event within users who have all types."""
    return factorial.repeated_one(by_type(spark, d))


@query(
    "q08_signed_rank",
    """WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) FILTER (WHERE event_type = 'view') AS v, avg(value) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY ALL),
d AS (SELECT dayofweek(day) AS key, round(v - p, 2) AS d FROM m WHERE v IS NOT NULL AND p IS NOT NULL AND round(v - p, 2) <> 0),
r AS (SELECT key, d, rank() OVER (PARTITION BY key ORDER BY abs(d)) + (count(*) OVER (PARTITION BY key, abs(d)) - 1) / 2.0 AS r FROM d),
t AS (SELECT key, sum(t * t * t - t) AS t FROM (SELECT key, abs(d) AS x, count(*) AS t FROM d GROUP BY 1, 2) GROUP BY key),
w AS (SELECT key, count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w FROM r GROUP BY key)
SELECT CAST(key AS BIGINT) + 1 AS key, n, coalesce(w, 0) AS w, round((coalesce(w, 0) - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0), 0), 9) AS z FROM w JOIN t USING (key)""",
)
def q08_signed(spark, d):
    """Views against purchases of the same user and day, by day of the week."""
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    m = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(of("view").alias("v"), of("purchase").alias("p"))
    x = m.select(F.dayofweek("day").cast("long").alias("key"), F.xxhash64("user_id", "day").alias("id"), F.round(F.col("v") - F.col("p"), 2).alias("d"))
    return ranks.signed_rank(x, 5.0).withColumn("z", F.round("z", 9))


PAIRED = """WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) FILTER (WHERE event_type IN ('view', 'click')) AS s, avg(value) FILTER (WHERE event_type IN ('purchase', 'error', 'signup')) AS b FROM events GROUP BY ALL),
z AS (SELECT user_id, count(*) AS n, avg(s) - avg(b) AS rs, sqrt((var_samp(s) + var_samp(b) - 2 * covar_samp(s, b)) / count(*)) AS se FROM m WHERE s IS NOT NULL AND b IS NOT NULL GROUP BY user_id HAVING count(*) > 2),
y AS (SELECT user_id, n, rs / se AS z FROM z WHERE se > 0)"""


def paired(spark, d):
    """user_id, n and z: the mean difference of two kinds of values of the same day over its error, with their covariance."""
    of = lambda *t: F.avg(F.when(F.col("event_type").isin(*t), F.col("value")))
    m = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(of("view", "click").alias("s"), of("purchase", "error", "signup").alias("b")).where("s IS NOT NULL AND b IS NOT NULL")
    n = F.count("*")
    z = m.groupBy("user_id").agg(n.alias("n"), (F.avg("s") - F.avg("b")).alias("rs"), F.sqrt((F.var_samp("s") + F.var_samp("b") - 2 * F.covar_samp("s", "b")) / n).alias("se"))
    return z.where("n > 2 AND se > 0").select("user_id", "n", (F.col("rs") / F.col("se")).alias("z"))


@query("t30_paired_difference", PAIRED + " SELECT user_id, n, round(z, 6) AS z FROM y")
def t30(spark, d):
    """Responses of users, standardised with the covariance of both kinds."""
    return paired(spark, d).withColumn("z", F.round("z", 6))


@query(
    "t31_quartiles_of_differences",
    PAIRED + """, q AS (SELECT quantile_cont(z, 0.25) AS lo, quantile_cont(z, 0.75) AS hi FROM y),
g AS (SELECT CASE WHEN z < lo THEN 'low' WHEN z > hi THEN 'high' END AS g, value FROM y JOIN events USING (user_id), q),
s AS (SELECT g, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM g WHERE g IS NOT NULL GROUP BY g)
SELECT a.n AS n_low, b.n AS n_high, round(a.mean, 6) AS low, round(b.mean, 6) AS high, round(sqrt(a.v / (a.n - 1)), 6) AS sem_low, round(sqrt(b.v / (b.n - 1)), 6) AS sem_high, round((b.mean - a.mean) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t FROM s a JOIN s b ON a.g = 'low' AND b.g = 'high'""",
)
def t31(spark, d):
    """Values of users strictly below the first and above the third quartile of these: means, errors and t."""
    y = paired(spark, d)
    q = y.agg(F.percentile("z", F.lit(0.25)).alias("lo"), F.percentile("z", F.lit(0.75)).alias("hi"))
    g = y.crossJoin(F.broadcast(q)).select("user_id", F.when(F.col("z") < F.col("lo"), 0).when(F.col("z") > F.col("hi"), 1).alias("g")).where("g IS NOT NULL")  # q is one row
    x = g.join(table(spark, d, "events"), "user_id")
    side = lambda k, f: f(F.when(F.col("g") == k, F.col("value")))
    s = x.agg(*[side(k, f).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).where("n0 > 1 AND n1 > 1")
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2) * (1 / F.col("n0") + 1 / F.col("n1"))
    sem = lambda k: F.round(F.sqrt(F.col(f"v{k}") / (F.col(f"n{k}") - 1)), 6)
    return s.select(F.col("n0").alias("n_low"), F.col("n1").alias("n_high"), F.round("m0", 6).alias("low"), F.round("m1", 6).alias("high"), sem(0).alias("sem_low"), sem(1).alias("sem_high"), F.round((F.col("m1") - F.col("m0")) / F.sqrt(pooled), 6).alias("t"))


BURSTS = with_("iv") + """, g AS (SELECT series, type, CASE WHEN start_us % (30 * 86400000000) < 15 * 86400000000 THEN 'first' ELSE 'second' END AS half, start_us, id FROM iv WHERE type IN ('view', 'purchase')),
l AS (SELECT series, type, half, start_us - lag(start_us) OVER (PARTITION BY series, type, half ORDER BY start_us, id) AS gap FROM g),
b AS (SELECT type, half, avg(CAST(gap <= 86400000000 AS INT)) AS x FROM l WHERE gap IS NOT NULL GROUP BY series, type, half)"""


def bursts(spark, d):
    """type, half and x: the share of gaps of a day or less, of each user, type and half of the month."""
    month, day = 30 * 86_400_000_000, 86_400_000_000
    half = F.when(F.col("start_us") % month < 15 * day, "first").otherwise("second")
    g = intervals(spark, d, "view", "purchase").withColumn("half", half)
    gap = F.col("start_us") - F.lag("start_us").over(Window.partitionBy("series", "type", "half").orderBy("start_us", "id"))
    return g.select("series", "type", "half", gap.alias("gap")).where("gap IS NOT NULL").groupBy("series", "type", "half").agg(F.avg((F.col("gap") <= day).cast("double")).alias("x")).drop("series")


@query("t32_burst_design", BURSTS + factorial.unweighted_sql(["type", "half"], "SELECT type, half, x FROM b").replace("\nWITH cells", ", cells", 1))
def t32(spark, d):
    """Bursts by type and half of the month as a design of two factors."""
    return factorial.unweighted(bursts(spark, d), ["type", "half"])


@query("t33_sparseness", "WITH c AS (SELECT user_id, event_type, count(*) AS r FROM events GROUP BY 1, 2), k AS (SELECT count(DISTINCT event_type) AS k FROM events) SELECT user_id, round((1 - pow(sum(r) / k, 2) / (sum(r * r) / k)) / (1 - 1 / k), 6) AS sparseness FROM c, k GROUP BY user_id, k HAVING k > 1")
def t33(spark, d):
    """How selective users are, of as many types as there are."""
    e = table(spark, d, "events")
    k = e.agg(F.count_distinct("event_type").alias("k"))
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("r")).groupBy("user_id").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    share = F.pow(F.col("s") / F.col("k"), F.lit(2)) / (F.col("q") / F.col("k"))
    return c.crossJoin(F.broadcast(k)).where("k > 1").select("user_id", F.round((1 - share) / (1 - 1 / F.col("k")), 6).alias("sparseness"))  # k is one row


@query("r12_crosstab", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS of_a, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 9) AS of_b, round(sum(count(*)) OVER (PARTITION BY l_returnflag) * sum(count(*)) OVER (PARTITION BY l_linestatus) / sum(count(*)) OVER (), 6) AS expected FROM lineitem GROUP BY 1, 2")
def r12(spark, d):
    """A contingency table of whatever values there are, with shares and what independence expects."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))
    # windows over cells
    a, b, all_ = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b")), F.sum("n").over(Window.partitionBy(F.lit(0)))
    return c.select("a", "b", "n", F.round(F.col("n") / a, 9).alias("of_a"), F.round(F.col("n") / b, 9).alias("of_b"), F.round(a * b / all_, 6).alias("expected"))


# templates and predictions

MEANS = with_("fr") + ", m AS (SELECT label, k, avg(x) AS m FROM fr GROUP BY ALL), d AS (SELECT fr.vec_id, fr.label AS actual, m.label AS predicted, sqrt(sum((x - m) ^ 2)) AS d FROM fr JOIN m USING (k) GROUP BY ALL), p AS (SELECT vec_id, actual, predicted, d FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), predicted) = 1)"


def predicted(spark, d):
    """vec_id, actual, predicted and d: each vector with the label whose mean is nearest."""
    x = frames(spark, d)
    means = x.groupBy("label", "k").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda t: t["m"]).alias("m"))
    # as many means as labels, held in one row
    all_ = means.agg(F.collect_list(F.struct(F.col("label"), "m")).alias("all"))
    v = vectors(spark, d).where("v IS NOT NULL").crossJoin(F.broadcast(all_))
    far = F.transform("all", lambda t: F.struct(F.round(measures.euclidean(F.col("v"), t["m"]), 9).alias("d"), t["label"].alias("label")))
    return v.select("vec_id", F.col("label").alias("actual"), F.array_min(far).alias("best")).select("vec_id", "actual", F.col("best.label").alias("predicted"), F.col("best.d").alias("d"))


@query("k16_confusion_of_predictions", MEANS + " SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL")
def k16(spark, d):
    """Labels against those whose mean is nearest."""
    return predicted(spark, d).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query("k17_accuracy_by_label", MEANS + ", a AS (SELECT actual AS label, count(*) AS n, sum((actual = predicted)::INT) AS hit FROM p GROUP BY 1), b AS (SELECT predicted AS label, count(*) AS taken FROM p GROUP BY 1) SELECT label, n, round(hit / n, 9) AS recall, round(hit / taken, 9) AS precision FROM a LEFT JOIN b USING (label)")
def k17(spark, d):
    """Recall and precision of each label under these predictions."""
    p = predicted(spark, d)
    a = p.groupBy(F.col("actual").alias("label")).agg(F.count("*").alias("n"), F.sum((F.col("actual") == F.col("predicted")).cast("long")).alias("hit"))
    b = p.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("taken"))
    return a.join(b, "label", "left").select("label", "n", F.round(F.col("hit") / F.col("n"), 9).alias("recall"), F.round(F.col("hit") / F.col("taken"), 9).alias("precision"))


@query("a10_regressions_of_all_dimensions")
def a10(spark, d):
    """Each of the first 32 dimensions on the other 32."""
    return regressions(vectors(spark, d), list(range(32)), list(range(32, 64)))


@query(
    "f10_fusion_of_two_distances",
    TRAIN + """, u AS (SELECT i, j, round(d, 6) AS d FROM pr), c AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))), 6) AS d FROM ve a JOIN ve b ON a.vec_id < b.vec_id),
r1 AS (SELECT i, j, row_number() OVER (ORDER BY d, i, j) / count(*) OVER () AS p FROM u), r2 AS (SELECT i, j, row_number() OVER (ORDER BY d, i, j) / count(*) OVER () AS q FROM c)
SELECT i, j, round(sqrt(p * q), 9) AS fused FROM r1 JOIN r2 USING (i, j)""",
)
def f10(spark, d):
    """The geometric mean of the ranks of two distances of the same pairs: straight and by the sum of differences."""
    x = pair_ranks.Swept(train(spark, d), pair_ranks.Euclidean, pair_ranks.City)
    return x.ranks(lambda s, rows, p, q: pair_ranks.pairs(s, rows, fused=pair_ranks.rounded(np.sqrt(p * q), 9)), "i long, j long, fused double")


@query("p20_nearest_neighbours", TRAIN + ", q AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.v, b.v), 6) AS d FROM ve a JOIN ve b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM q QUALIFY place <= 5")
def p20(spark, d):
    """The five nearest vectors of every one whose id is divisible by 20."""
    v = vectors(spark, d)
    return neighbours.nearest(v, v.where("vec_id % 20 = 0"), 5).select("i", "j", "d", "place")


def template_scores(spark, d):
    v = vectors(spark, d)
    return matching.scores(v, matching.templates(v, 4))


@query("c30_template_matches")
def c30(spark, d):
    """The type of template that each vector is most like, of four templates of each label."""
    return matching.best(template_scores(spark, d))


@query("c31_consensus_matches")
def c31(spark, d):
    """The type that the vectors of each label are most like on the whole, and the share of them that say so alone."""
    s = template_scores(spark, d).join(vectors(spark, d).select(F.col("vec_id").alias("i"), "label"), "i")
    alone = matching.best(s).join(vectors(spark, d).select(F.col("vec_id").alias("i"), "label"), "i").select("label", F.col("type").alias("own"))
    whole = matching.best(s, "label")
    return alone.join(whole, "label").groupBy("label", "type", "score").agg(F.avg((F.col("own") == F.col("type")).cast("double")).alias("agreement"))


@query("t34_event_related_mean")
def t34(spark, d):
    """Views about purchases in bins of six hours, less what each user's rate gives, for purchases of both halves of the month."""
    month, hour = 30 * 86_400_000_000, 3_600_000_000
    half = F.when(F.col("start_us") % month < month // 2, "first").otherwise("second")
    bought = intervals(spark, d, "purchase").select(half.alias("key"), "series", "id", F.col("start_us").alias("t_us"))
    return triggered.event_related(bought, intervals(spark, d, "view").select("series", F.col("start_us").alias("t_us")), 6 * hour, 4)


#: Symbols of users with a blank mark where more than a day passes between the end of an event and the start of the next.
SILENT = with_("iv") + """, g AS (SELECT series, start_us, id, substr(type, 1, 1) AS c, start_us - lag(stop_us) OVER (PARTITION BY series ORDER BY start_us, id) > 86400000000 AS apart FROM iv),
s AS (SELECT series, string_agg(CASE WHEN apart THEN '_' || c ELSE c END, '' ORDER BY start_us, id) AS s FROM g GROUP BY series),
k AS (SELECT s, unnest(range(1, length(s) + 1)) AS k FROM s)"""


def with_silence(spark, d):
    """series, start_us, id, part and c: the symbols of users, silence as one of its own before what follows it."""
    w = Window.partitionBy("series").orderBy("start_us", "id")
    apart = F.coalesce(F.col("start_us") - F.lag("stop_us").over(w) > 86_400_000_000, F.lit(False))
    x = intervals(spark, d).withColumn("apart", apart).withColumn("c", F.substring("type", 1, 1))
    return x.select("series", "start_us", "id", F.posexplode(F.when(F.col("apart"), F.array(F.lit("_"), "c")).otherwise(F.array("c"))).alias("part", "c"))


@query(
    "n10_grams_against_chain",
    SILENT + """, t AS (SELECT substr(s, k, 3) AS gram, count(*) AS n FROM k WHERE k + 2 <= length(s) GROUP BY 1), b AS (SELECT substr(s, k, 2) AS pair, count(*) AS n FROM k WHERE k + 1 <= length(s) GROUP BY 1),
f AS (SELECT substr(pair, 1, 1) AS c, sum(n) AS n FROM b GROUP BY 1)
SELECT gram, t.n AS n, round(p.n * q.n / f.n, 6) AS expected, round(t.n / (p.n * q.n / f.n), 6) AS ratio FROM t JOIN b p ON p.pair = substr(gram, 1, 2) JOIN b q ON q.pair = substr(gram, 2, 2) JOIN f ON f.c = substr(gram, 2, 1)""",
)
def n10(spark, d):
    """Runs of three symbols, silence being one, against what a chain of first order expects."""
    w = Window.partitionBy("series").orderBy("start_us", "id", "part")
    x = with_silence(spark, d).select("c", F.lead("c", 1).over(w).alias("d"), F.lead("c", 2).over(w).alias("e"))
    t = x.where("e IS NOT NULL").groupBy("c", "d", "e").agg(F.count("*").alias("n"))
    # as many pairs as symbols squared
    b = x.where("d IS NOT NULL").groupBy("c", "d").agg(F.count("*").alias("n"))
    p, q = b.withColumnRenamed("n", "p"), b.select(F.col("c").alias("d"), F.col("d").alias("e"), F.col("n").alias("q"))
    f = b.groupBy(F.col("c").alias("d")).agg(F.sum("n").alias("f"))
    m = t.join(p, ["c", "d"]).join(q, ["d", "e"]).join(f, "d")
    expected = F.col("p") * F.col("q") / F.col("f")
    return m.select(F.concat("c", "d", "e").alias("gram"), "n", F.round(expected, 6).alias("expected"), F.round(F.col("n") / expected, 6).alias("ratio"))


@query("n11_transitions_with_silence", SILENT + ", b AS (SELECT substr(s, k, 1) AS before, substr(s, k + 1, 1) AS after, count(*) AS n FROM k WHERE k + 1 <= length(s) GROUP BY 1, 2) SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY after), 9) AS share FROM b")
def n11(spark, d):
    """Transitions between symbols and silence, as shares of what comes after."""
    w = Window.partitionBy("series").orderBy("start_us", "id", "part")
    x = with_silence(spark, d).select(F.col("c").alias("before"), F.lead("c", 1).over(w).alias("after")).where("after IS NOT NULL")
    b = x.groupBy("before", "after").agg(F.count("*").alias("n"))
    return b.select("before", "after", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("after")), 9).alias("share"))
