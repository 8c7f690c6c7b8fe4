"""Queries of maximal repeats (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalia.operators import repeats
from intervalia.plans.comparison_queries import SYMBOLS
from intervalia.plans.registry import query
from intervalia.sources.fixtures import table

SUBSTRINGS = (
    SYMBOLS
    + """, s AS (SELECT user_id, string_agg(c, '' ORDER BY ts, event_id) AS s FROM g GROUP BY 1), k AS (SELECT user_id, s, unnest(range(1, length(s) + 1)) AS k FROM s),
l AS (SELECT user_id, s, k, unnest(range({least}, length(s) - k + 2)) AS l FROM k),
o AS (SELECT substr(s, k, l) AS motif, CASE WHEN k = 1 THEN '<' || user_id ELSE substr(s, k - 1, 1) END AS before, CASE WHEN k + l > length(s) THEN '>' || user_id ELSE substr(s, k + l, 1) END AS after FROM l)
SELECT motif, length(motif) AS length, count(*) AS n FROM o GROUP BY motif HAVING count(DISTINCT before) > 1 AND count(DISTINCT after) > 1"""
)


def sequences(spark, d):
    """series, r and c: the first letters of the types of each user's events in order."""
    e = table(spark, d, "events")
    x = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return repeats.placed(e.select(F.col("user_id").alias("series"), F.col("event_id").alias("id"), x.alias("x"), F.substring("event_type", 1, 1).alias("c")), 86_400e6)


@query("n08_maximal_repeats", SUBSTRINGS.format(least=2))
def n08(spark, d):
    """Motifs of two symbols and more that no longer one explains on either side, of any length."""
    return repeats.maximal_repeats(sequences(spark, d), 2)


@query("n09_motif_places", SYMBOLS + ", s AS (SELECT user_id, string_agg(c, '' ORDER BY ts, event_id) AS s FROM g GROUP BY 1), k AS (SELECT user_id, s, unnest(range(1, length(s) + 1)) AS k FROM s) SELECT user_id AS series, k - 1 AS r FROM k WHERE substr(s, k, 4) = 'cvpc'")
def n09(spark, d):
    """Where a click, a view, a purchase and a click follow one another."""
    return repeats.occurrences("cvpc", sequences(spark, d))
