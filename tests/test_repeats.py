"""Maximal repeats against all substrings."""

import collections

import numpy as np
import pytest

from intervalia.operators import repeats


def plain(sequences, least):
    before, after, count = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for k, s in sequences.items():
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                w = s[i:j]
                count[w] += 1
                before[w].add(s[i - 1] if i else ("<", k))
                after[w].add(s[j] if j < len(s) else (">", k))
    return sorted((w, len(w), n) for w, n in count.items() if len(before[w]) > 1 and len(after[w]) > 1)


def sequences(kind):
    draw = np.random.default_rng(kind)
    if kind == 0:
        return {k: "".join(draw.choice(list("ab"), 30)) for k in range(6)}
    if kind == 1:  # long copies, periodic and level ones
        part = "".join(draw.choice(list("abcd"), 90))
        return {1: part, 2: "x" + part + "y", 3: part[10:80], 4: "ab" * 40, 5: "a" * 70, 6: "a" * 70, 7: ""}
    return {k: "".join(draw.choice(list("abcde"), int(draw.integers(1, 60)))) for k in range(40)}


def rows(spark, some):
    data = [(k, r, c) for k, s in some.items() for r, c in enumerate(s)]
    return spark.createDataFrame(data, "series long, r long, c string").repartition(3)


@pytest.mark.parametrize("kind, least, options", [(0, 1, {}), (0, 2, {"most": 3, "first": 4}), (1, 3, {"first": 8}), (1, 2, {"most": 30, "first": 16}), (2, 2, {}), (2, 1, {"most": 5, "first": 2})])
def test_same_as_all_substrings(spark, kind, least, options):
    some = sequences(kind)
    got = sorted(map(tuple, repeats.maximal_repeats(rows(spark, some), least, **options).collect()))
    assert got == plain(some, least)


def test_empty_and_single(spark):
    none = rows(spark, {1: "a"}).where("false")
    assert repeats.maximal_repeats(none, 2).count() == 0
    assert repeats.maximal_repeats(rows(spark, {1: "abcdef"}), 1).count() == 0


def test_places(spark):
    some = sequences(1)
    for motif in ("ab", "aaaa", some[1][5:85]):
        want = sorted((k, i) for k, s in some.items() for i in range(len(s)) if s.startswith(motif, i))
        assert sorted(map(tuple, repeats.occurrences(motif, rows(spark, some)).collect())) == want


def test_order_of_symbols(spark):
    data = [(1, 3, 2.0, "b"), (1, 1, 1.0, "a"), (1, 2, 2.0, "c"), (2, 9, -5.0, "z")]
    got = repeats.placed(spark.createDataFrame(data, "series long, id long, x double, c string"), 1.0).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a"), (1, 1, "c"), (1, 2, "b"), (2, 0, "z")]
