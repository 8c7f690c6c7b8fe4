"""Interval algebra on hand-made cases."""

from intervalia.operators import intervals as I
from intervalia.operators.rangejoin import overlap_join

SCHEMA = "id long, series long, type string, start_us long, stop_us long"


def make(spark, *pairs):
    return spark.createDataFrame([(k, 1, "x", a, b) for k, (a, b) in enumerate(pairs)], SCHEMA)


def spans(df):
    return sorted((r.start_us, r.stop_us) for r in df.collect())


def test_gap_of_exactly_the_limit_merges(spark):
    df = make(spark, (0, 1_000_000), (1_300_000, 2_000_000), (2_310_000, 3_000_000))
    assert sorted((r.start_us, r.stop_us, r.n) for r in I.merge_gaps(df, 300_000).collect()) == [(0, 2_000_000, 2), (2_310_000, 3_000_000, 1)]


def test_nested_interval_splits_a_group_but_not_a_union(spark):
    df = make(spark, (0, 10), (1, 2), (3, 4))
    assert I.merge_gaps(df, 0).count() == 2
    assert spans(I.union(df)) == [(0, 10)]


def test_touching_is_no_overlap(spark):
    df = make(spark, (1, 10), (10, 20), (15, 30))
    assert [(r.id1, r.id2) for r in I.self_overlaps(df, 7).collect()] == [(1, 2)]


def test_intersection_and_difference(spark):
    a, b = make(spark, (0, 5), (8, 10)), make(spark, (3, 9))
    assert spans(I.intersection(a, b)) == [(3, 5), (8, 9)]
    assert spans(I.difference(a, b)) == [(0, 3), (9, 10)]
    assert spans(I.difference(b, a)) == [(5, 8)]
    size = lambda df: sum(y - x for x, y in spans(df))
    assert size(I.union(a)) == size(I.intersection(a, b)) + size(I.difference(a, b))


def test_first_parent_wins(spark):
    parents, child = make(spark, (0, 1000), (500, 2000)), make(spark, (600, 900))
    assert [r.parent for r in I.parent_of(child, parents, 20).collect()] == [0]


def test_pairs_come_once_however_many_buckets_they_share(spark):
    a = make(spark, (0, 1000))
    assert overlap_join(a, a, 10).count() == 1


def test_union_is_idempotent_and_empty_stays_empty(spark):
    df = make(spark, (0, 5), (3, 9), (20, 30))
    once = I.union(df).withColumnRenamed("island", "id").select("id", "series", "type", "start_us", "stop_us")
    assert spans(I.union(once)) == spans(once)
    assert I.union(df.where("false")).count() == 0


def test_windows(spark):
    assert [r.start_us for r in I.windows(make(spark, (0, 10)), 4, 2).orderBy("k").collect()] == [0, 2, 4, 6]
