"""Factorial analysis of variance from cell sums, with partial aggregation: what meets in one task are cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def two_way(f: DataFrame) -> DataFrame:
    """effect (a, b, ab), df, df_error and F of x by the factors a and b with interaction; f has a, b, x.

    Unweighted means: every cell weighs the harmonic mean of the cell sizes, which is the ordinary analysis where
    cells are of one size. Rows with nulls are left out. Every combination of levels must occur.
    """
    sums = f.dropna(subset=["a", "b", "x"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count("*")).alias("ss"))
    of = sums.agg((F.count("*") / F.sum(1.0 / F.col("n"))).alias("h"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.avg("m").alias("g"), F.sum("ss").alias("sse"), F.sum("n").alias("n"))
    row = sums.withColumns({"ra": F.avg("m").over(Window.partitionBy("a")), "rb": F.avg("m").over(Window.partitionBy("b"))})
    row = row.select("m", "ra", "rb").crossJoin(F.broadcast(of))  # one row
    square = lambda x: F.sum(x * x) * F.first("h")
    s = row.agg(square(F.col("ra") - F.col("g")).alias("a"), square(F.col("rb") - F.col("g")).alias("b"), square(F.col("m") - F.col("ra") - F.col("rb") + F.col("g")).alias("ab"), (F.first("na") - 1).alias("da"), (F.first("nb") - 1).alias("db"), F.first("sse").alias("sse"), (F.first("n") - F.first("na") * F.first("nb")).alias("df_error"))
    each = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("ss"), df.alias("df")) for e, df in (("a", F.col("da")), ("b", F.col("db")), ("ab", F.col("da") * F.col("db")))])
    s = s.select("sse", "df_error", F.inline(each))
    return s.select("effect", "df", "df_error", ((F.col("ss") / F.col("df")) / (F.col("sse") / F.col("df_error"))).alias("F"))


def repeated(f: DataFrame) -> DataFrame:
    """effect and F of x by the within-subject factors a and b; f has one row for each subject s, a and b."""
    over = lambda *by: F.avg("x").over(Window.partitionBy(*by))
    of = f.agg(F.count_distinct("s").alias("ns"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.avg("x").alias("g"))
    c = f.withColumns({"mab": over("a", "b"), "ma": over("a"), "mb": over("b"), "ms": over("s"), "sa": over("s", "a"), "sb": over("s", "b")}).crossJoin(F.broadcast(of))
    x, g, ma, mb, ms, sa, sb, mab = (F.col(k) for k in ("x", "g", "ma", "mb", "ms", "sa", "sb", "mab"))
    square = lambda v: F.sum(v * v)
    da, db, ds = F.first("na") - 1, F.first("nb") - 1, F.first("ns") - 1
    each = c.agg(
        (square(ma - g) / da / (square(sa - ms - ma + g) / (da * ds))).alias("a"),
        (square(mb - g) / db / (square(sb - ms - mb + g) / (db * ds))).alias("b"),
        (square(mab - ma - mb + g) / (da * db) / (square(x - sa - sb - mab + ma + mb + ms - g) / (da * db * ds))).alias("ab"),
    )
    return each.select(F.inline(F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("F")) for e in ("a", "b", "ab")])))


#: Cells that may reach the driver; each is a combination of levels, not a row of data.
MOST_CELLS = 100_000


def cell_sums(f: DataFrame, factors: list[str]) -> DataFrame:
    """n, s and q of x in every combination of levels; rows with nulls are left out."""
    x = f.dropna(subset=[*factors, "x"]).where("NOT isnan(x)")
    return x.groupBy(*factors).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def n_way(f: DataFrame, factors: list[str], order: int = 2) -> DataFrame:
    """Analysis of variance of x by any number of factors, with interactions of up to `order` of them, as a general linear model.

    effect, ss_sequential (each effect after those before it), ss_marginal (each after all others), df, df_error, F and p of
    the marginal sums. Levels are coded as deviations from the mean of all levels. The data come down to sums of cells, which are weighted
    observations of the model; combinations of levels may be missing, then df counts what can be told apart.
    """
    from itertools import combinations

    import numpy as np

    from intervalia.operators import distributions

    cells = cell_sums(f, factors).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of levels")
    cells.sort(key=lambda r: tuple(str(r[c]) for c in factors))
    n, s, q = (np.array([float(r[c]) for r in cells]) for c in ("n", "s", "q"))
    schema = "effect string, ss_sequential double, ss_marginal double, df int, df_error long, F double, p double"
    if not len(cells):
        return f.sparkSession.createDataFrame([], schema)
    coded = {}
    for c in factors:
        values = [r[c] for r in cells]
        levels = sorted(set(values), key=lambda v: (str(type(v)), v))
        eye = np.vstack([np.eye(len(levels) - 1), -np.ones(len(levels) - 1)])
        coded[c] = eye[[levels.index(v) for v in values]]
    terms = [t for k in range(1, order + 1) for t in combinations(factors, k)]
    design = {}
    for t in terms:
        x = np.ones((len(cells), 1))
        for c in t:
            x = (x[:, :, None] * coded[c][:, None, :]).reshape(len(cells), -1)
        design[t] = x
    root = np.sqrt(n)
    y = s / root

    def explained(some: list) -> tuple[float, int]:
        x = np.hstack([np.ones((len(cells), 1)), *[design[t] for t in some]]) * root[:, None]
        u, w, _ = np.linalg.svd(x, full_matrices=False)
        u = u[:, w > w.max(initial=0) * 1e-10]
        return float(((u.T @ y) ** 2).sum()), u.shape[1]

    whole, rank = explained(terms)
    left = int(n.sum()) - rank
    error = max(float(q.sum()) - whole, 0.0)
    out = []
    before = explained([])[0]
    for k, t in enumerate(terms):
        upto = explained(terms[: k + 1])[0]
        rest, others = explained([u for u in terms if u != t])
        df = rank - others
        value = (whole - rest) / df / (error / left) if df and left > 0 and error > 0 else None
        out.append((":".join(t), upto - before, whole - rest, df, left, value, float(distributions.f_tail(value, df, left)) if value is not None else None))
        before = upto
    return f.sparkSession.createDataFrame(out, schema)


def unweighted(f: DataFrame, factors: list[str]) -> DataFrame:
    """effect, ss, df, df_error and F of every effect and interaction by unweighted means: every cell weighs the harmonic mean of the sizes.

    Every combination of levels must occur; where cells are of one size this is the ordinary analysis.
    """
    from itertools import combinations

    cells = cell_sums(f, factors).withColumn("m", F.col("s") / F.col("n"))
    subsets = [t for k in range(len(factors) + 1) for t in combinations(factors, k)]
    mean = lambda t: "m_" + "_".join(t)
    # windows over cells, not over data
    x = cells.withColumns({mean(t): F.avg("m").over(Window.partitionBy(*t)) if t else F.avg("m").over(Window.partitionBy(F.lit(0))) for t in subsets})
    part = lambda t: sum(((-1) ** (len(t) - len(u)) * F.col(mean(u)) for u in subsets if set(u) <= set(t)), F.lit(0.0))
    effects = [t for t in subsets if t]
    sums = x.agg((F.count("*") / F.sum(1.0 / F.col("n"))).alias("h"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("error"), (F.sum("n") - F.count("*")).alias("df_error"), *[F.count_distinct(c).alias(f"k_{c}") for c in factors], *[F.sum(part(t) * part(t)).alias("ss" + mean(t)) for t in effects])

    def df(t):
        out = F.lit(1)
        for c in t:
            out = out * (F.col(f"k_{c}") - 1)
        return out

    each = F.array(*[F.struct(F.lit(":".join(t)).alias("effect"), (F.col("ss" + mean(t)) * F.col("h")).alias("ss"), df(t).cast("long").alias("df")) for t in effects])
    out = sums.select("error", "df_error", F.inline(each))
    return out.select("effect", "ss", "df", "df_error", (F.col("ss") / F.col("df") / (F.col("error") / F.col("df_error"))).alias("F"))


def unweighted_sql(factors: list[str], source: str) -> str:
    """The same in SQL; source is a query of the factors and x."""
    from itertools import combinations

    subsets = [t for k in range(len(factors) + 1) for t in combinations(factors, k)]
    name = lambda t: "m_" + "_".join(t)
    means = ", ".join(f"avg(m) OVER ({'PARTITION BY ' + ', '.join(t) if t else ''}) AS {name(t)}" for t in subsets)
    part = lambda t: "(" + " ".join(f"{'+' if (len(t) - len(u)) % 2 == 0 else '-'} {name(u)}" for u in subsets if set(u) <= set(t)) + ")"
    rows = []
    for t in subsets[1:]:
        df = " * ".join(f"(count(DISTINCT {c}) - 1)" for c in t)
        rows.append(f"SELECT '{':'.join(t)}' AS effect, sum({part(t)} * {part(t)}) * count(*) / sum(1.0 / n) AS ss, {df} AS df, sum(q - s * s / n) AS error, CAST(sum(n) - count(*) AS BIGINT) AS df_error FROM means")
    return f"""
WITH cells AS (SELECT {", ".join(factors)}, count(*) AS n, sum(x) AS s, sum(x * x) AS q, avg(x) AS m FROM ({source}) GROUP BY ALL),
means AS (SELECT *, {means} FROM cells)
SELECT effect, ss, df, df_error, ss / df / (error / df_error) AS "F" FROM ({" UNION ALL ".join(rows)})"""


def repeated_one(f: DataFrame) -> DataFrame:
    """df, df_error and F of x by the within-subject factor a; f has s, a and x, at most one row of each s and a.

    Subjects without every level are left out.
    """
    x = f.dropna(subset=["s", "a", "x"])
    levels = x.agg(F.count_distinct("a").alias("k"))
    own = x.groupBy("s").agg(F.count("*").alias("c"), F.avg("x").alias("ms"))
    whole = own.crossJoin(F.broadcast(levels)).where("c = k").select("s", "ms", "k")  # one row
    x = x.join(whole, "s")
    # levels are few, and sums of all come down to one row
    by = x.groupBy("a").agg(F.avg("x").alias("ma"), F.count("*").alias("n"))
    mean = x.agg(F.avg("x").alias("g"))
    c = x.join(F.broadcast(by), "a").crossJoin(F.broadcast(mean))
    square = lambda v: F.sum(v * v)
    df, left = F.first("k") - 1, (F.first("k") - 1) * (F.first("n") - 1)
    out = c.agg(df.alias("df"), left.alias("df_error"), square(F.col("ma") - F.col("g")).alias("between"), square(F.col("x") - F.col("ma") - F.col("ms") + F.col("g")).alias("rest"))
    return out.where("df > 0 AND df_error > 0").select("df", "df_error", (F.col("between") / F.col("df") / (F.col("rest") / F.col("df_error"))).alias("F"))
