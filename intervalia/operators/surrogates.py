"""Permutation and bootstrap tests of groups: surrogate sums that tasks make by themselves and that add up.

rows are key, id, a, b and y: a and b are the numbers of the levels of two factors, b is 0 where there is one. Labels are permuted
within blocks of about BLOCK rows of a key, which is a permutation of all rows of a key that has no more; each block keeps
the sizes of its cells. A bootstrap draws every cell from all rows of its key: a row comes into a cell of m of n rows as often as a
Poisson number of mean m / n says. What is shuffled is a row for each key, cell, trial and block, however many rows a key has; one_way_tested
shuffles none for keys of one block.
Trial 0 is the data. Rows with nulls are left out; ids order the rows of a block, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from intervalia.operators import distributions
from intervalia.sources.fixtures import apart

BLOCK = 2048
#: Labels that are drawn at a time.
AT_ONCE = 1 << 22
SUMS = "key long, trial int, a int, b int, n double, s double, q double"


def _typed(rows: DataFrame) -> DataFrame:
    x = rows.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("y").cast("double").alias("y"))
    return x.dropna().where("NOT isnan(y)")


def _blocked(x: DataFrame, block: int, *keep: str) -> DataFrame:
    """x with the block of each row; a key of n rows has m = ceil(n / block) of them, which is kept if it is named."""
    many = x.groupBy("key").agg(F.ceil(F.count("*") / block).alias("m"))
    out = x.join(many, "key").withColumn("block", F.pmod(F.xxhash64("key", "id", F.lit("block")), F.col("m")))
    return out if keep else out.drop("m")


def _permutations(own: pd.DataFrame, trials: int, seed: list[int]) -> Iterator[tuple]:
    """begin, cells, n, s and q (cells, trials) of some trials at a time, labels permuted."""
    draw = np.random.default_rng(seed)
    cells, label = np.unique(own[["a", "b"]].to_numpy(), axis=0, return_inverse=True)
    label, y = label.reshape(-1), own["y"].to_numpy()
    n, step = np.bincount(label).astype(float), max(1, AT_ONCE // len(y))
    for begin in range(0, trials + 1, step):
        many = min(step, trials + 1 - begin)
        drawn = draw.permuted(np.tile(label, (many, 1)), axis=1)
        if begin == 0:
            drawn[0] = label
        here = [drawn == c for c in range(len(cells))]
        yield begin, cells, np.tile(n[:, None], (1, many)), np.stack([h @ y for h in here]), np.stack([h @ (y * y) for h in here])


def _draws(own: pd.DataFrame, trials: int, seed: list[int]) -> Iterator[tuple]:
    """The same, each cell drawn from all rows of the key; own has the cells of the key."""
    draw = np.random.default_rng([seed[0], 2, *seed[1:]])
    y, a0, b0 = own["y"].to_numpy(), own["a"].to_numpy(), own["b"].to_numpy()
    cells = [(c["a"], c["b"], c["m"]) for c in own["cells"].iloc[0]]
    total, step = sum(c[2] for c in cells), max(1, AT_ONCE // len(y))
    for begin in range(0, trials + 1, step):
        many = min(step, trials + 1 - begin)
        sums = []
        for a, b, m in cells:
            times = draw.poisson(m / total, (many, len(y))).astype(float)
            if begin == 0:
                times[0] = (a0 == a) & (b0 == b)
            sums.append((times.sum(1), times @ y, times @ (y * y)))
        yield begin, np.array([c[:2] for c in cells]), *(np.stack(x) for x in zip(*sums))


def _parts(make: Callable[..., Iterator[tuple]], own: pd.DataFrame, trials: int, seed: int) -> Iterator[tuple]:
    own = own.sort_values(["id", "a", "b", "y"], kind="stable")
    return make(own, trials, [seed, int(own["key"].iloc[0]) & 0x7FFFFFFFFFFFFFFF, int(own["block"].iloc[0])])


def _summed(x: DataFrame, make: Callable[..., Iterator[tuple]], trials: int, seed: int) -> DataFrame:
    """Sums of the cells of every key and trial, from the blocks of rows."""

    def part(own):
        key, out = own["key"].iloc[0], []
        for begin, cells, n, s, q in _parts(make, own, trials, seed):
            for k, (a, b) in enumerate(cells):
                out.append(pd.DataFrame({"key": key, "trial": np.arange(begin, begin + n.shape[1], dtype=np.int32), "a": np.int32(a), "b": np.int32(b), "n": n[k], "s": s[k], "q": q[k]}))
        return pd.concat(out)

    return _added(apart(x, "key", "block").groupBy("key", "block").applyInPandas(part, SUMS))


def _shared(x: DataFrame) -> DataFrame:
    """x with the cells of its key, which are as many as the levels of the factors."""
    cells = x.groupBy("key", "a", "b").agg(F.count("*").alias("m"))
    return x.join(cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b", "m"))).alias("cells")), "key")


def permuted(rows: DataFrame, trials: int, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Sums of the cells of every key and trial with labels permuted."""
    return _summed(_blocked(_typed(rows), block), _permutations, trials, seed)


def drawn(rows: DataFrame, trials: int, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Sums of the cells of every key and trial drawn from all rows of the key."""
    return _summed(_shared(_blocked(_typed(rows), block)), _draws, trials, seed)


def one_way_tested(rows: DataFrame, trials: int, seed: int = 1, block: int = BLOCK, bootstrap: bool = False) -> DataFrame:
    """What judged gives of one_way_f of the sums; a key of one block is judged in the task that shuffles it, so its sums are not sent."""
    make = _draws if bootstrap else _permutations
    x = _blocked(_typed(rows), block, "m")
    x = _shared(x) if bootstrap else x

    def whole(own):
        parts = list(_parts(make, own, trials, seed))
        n, s, q = (np.concatenate([p[k] for p in parts], axis=1) for k in (2, 3, 4))
        with np.errstate(divide="ignore", invalid="ignore"):
            c, total, mean = (n > 0).sum(0), n.sum(0), np.where(n > 0, s * s / n, 0.0)
            df, left = c - 1.0, total - c
            within = (np.where(n > 0, q, 0.0) - mean).sum(0)
            f = np.where(within > 0, (mean.sum(0) - np.where(n > 0, s, 0.0).sum(0) ** 2 / total) / df / (within / left), np.nan)
        counts = (c > 1) & (total > c)
        none = not counts[0] or np.isnan(f[0])
        far = np.abs(f[counts]) >= abs(f[0]) - 1e-9 * (1 + abs(f[0]))
        return pd.DataFrame({"key": [own["key"].iloc[0]], "effect": "a", "value": f[0], "df": df[0], "df_error": left[0], "p": far.mean()})[: 0 if none else 1]

    small = apart(x.where("m = 1"), "key", "block").groupBy("key", "block").applyInPandas(whole, "key long, effect string, value double, df double, df_error double, p double")
    small = small.withColumn("p_theory", f_tail("value", "df", "df_error"))
    return small.unionByName(judged(one_way_f(_summed(x.where("m > 1"), make, trials, seed))))


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("key", "trial", "a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 0")


def two_sample_t(sums: DataFrame) -> DataFrame:
    """key, trial, effect, value (t of the first level of a less the second, variances pooled), df and df_error."""
    side = lambda k, c: F.sum(F.when(F.col("a") == k, F.col(c)))
    x = sums.groupBy("key", "trial").agg(*[side(k, c).alias(f"{c}{k}") for k in (0, 1) for c in "nsq"]).where("n0 > 0 AND n1 > 0 AND n0 + n1 > 2")
    inner = sum((F.col(f"q{k}") - F.col(f"s{k}") ** 2 / F.col(f"n{k}") for k in (0, 1)), F.lit(0.0))
    left = F.col("n0") + F.col("n1") - 2
    spread = F.sqrt(F.greatest(inner, F.lit(0.0)) / left * (1 / F.col("n0") + 1 / F.col("n1")))
    return x.select("key", "trial", F.lit("t").alias("effect"), F.when(spread > 0, (F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")) / spread).alias("value"), F.lit(1.0).alias("df"), left.alias("df_error"))


def one_way_f(sums: DataFrame) -> DataFrame:
    """The same for F of the levels of a."""
    x = sums.groupBy("key", "trial").agg(F.count("*").alias("c"), F.sum("n").alias("n"), (F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")).alias("between"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("within"))
    x = x.where("c > 1 AND n > c")
    df, left = (F.col("c") - 1).cast("double"), F.col("n") - F.col("c")
    return x.select("key", "trial", F.lit("a").alias("effect"), F.when(F.col("within") > 0, F.col("between") / df / (F.col("within") / left)).alias("value"), df.alias("df"), left.alias("df_error"))


def two_way_f(sums: DataFrame) -> DataFrame:
    """The same for F of a, b and their interaction by unweighted means; keys without every combination of levels are left out."""
    by = ["key", "trial"]
    from pyspark.sql import Window

    m = F.col("s") / F.col("n")
    over = lambda *c: Window.partitionBy(*by, *c)
    x = sums.withColumns({"m": m, "ma": F.avg(m).over(over("a")), "mb": F.avg(m).over(over("b")), "g": F.avg(m).over(over())})
    square = lambda v: F.sum(v * v)
    x = x.groupBy(*by).agg(
        F.count("*").alias("c"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.sum("n").alias("n"), (F.count("*") / F.sum(1 / F.col("n"))).alias("h"),
        F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("within"), square(F.col("ma") - F.col("g")).alias("a"), square(F.col("mb") - F.col("g")).alias("b"), square(F.col("m") - F.col("ma") - F.col("mb") + F.col("g")).alias("ab"),
    ).where("c = na * nb AND na > 1 AND nb > 1 AND n > c")
    da, db, left = (F.col("na") - 1).cast("double"), (F.col("nb") - 1).cast("double"), F.col("n") - F.col("c")
    each = F.array(*[F.struct(F.lit(e).alias("effect"), (F.col(e) * F.col("h")).alias("ss"), d.alias("df")) for e, d in (("a", da), ("b", db), ("ab", da * db))])
    x = x.select(*by, "within", left.alias("df_error"), F.inline(each))
    return x.select(*by, "effect", F.when(F.col("within") > 0, F.col("ss") / F.col("df") / (F.col("within") / F.col("df_error"))).alias("value"), "df", "df_error")


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.Series:
    return pd.Series(distributions.f_tail(f.fillna(0.0), top, bottom)).where(f.notna())


def judged(values: DataFrame, size: Column | None = None) -> DataFrame:
    """key, effect, value, df, df_error, p (share of trials as far out as the data, the data among them) and p_theory.

    size: how far out a value is, its distance from 0 unless given.
    """
    far = F.abs("value") if size is None else size
    x = values.withColumn("far", far)
    data = x.where("trial = 0 AND value IS NOT NULL").select("key", "effect", F.col("value").alias("own"), F.col("far").alias("own_far"), "df", "df_error")
    out = x.select("key", "effect", "far").join(data, ["key", "effect"]).groupBy("key", "effect")
    out = out.agg(F.first("own").alias("value"), F.first("df").alias("df"), F.first("df_error").alias("df_error"), F.avg(F.coalesce(F.col("far") >= F.col("own_far") - 1e-9 * (1 + F.abs("own_far")), F.lit(False)).cast("double")).alias("p"))
    squared = F.when(F.col("effect") == "t", F.col("value") ** 2).otherwise(F.col("value"))
    return out.withColumn("p_theory", f_tail(squared, F.col("df"), F.col("df_error")))
