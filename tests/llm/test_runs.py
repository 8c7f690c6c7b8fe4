"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import queries, runs  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_runs string, start string, period int"


def smallest_period(w):
    """By the borders of every prefix."""
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def by_definition(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and smallest_period(w[i : i + length]) == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_definition(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *most, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def texts():
    r = random.Random(2)
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a\x0bb " * 12, "é　é " * 30, "ab " * 5000]
    for _ in range(150):
        w = []
        for _ in range(r.randint(1, 6)):
            part = [r.choice("abc") for _ in range(r.randint(1, 12))]
            w += (part * r.randint(1, 12))[: r.randint(1, 90)]
            if r.random() < 0.5:
                w += [f"w{r.randrange(50)}" for _ in range(r.randint(0, 30))]
        out.append(" ".join(w))
    # runs in runs, runs that share words, the same middle between other ends
    inner = ("a " * 30 + "b ") * 4
    out += [inner, ("x a y " + "x b y ") * 20, ("x a y " * 9 + "x b y " * 9) * 3, ("a b " * 15 + "c ") * 5, "a b a " * 9 + "a b " * 14]
    return out + out[40:44]


def rows():
    # among these doc_ids about every tenth repeats a part of itself
    return [(None if k == 50 else k // 2 * 7, t, "clash", "clash", 0) for k, t in enumerate(texts() * 2)]


@pytest.mark.parametrize("group", [1, 500, runs.GROUP])
def test_same_as_definition(spark, group):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted(map(tuple, runs.digests(df, group=group).collect()), key=str)
    assert got == sorted([expected(k, t) for k, t, *_ in rows()], key=str)
    assert runs.digests(df.where("false")).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(map(tuple, queries.op13_word_runs(spark, "/root/testdata/sf0.001").collect()), key=str)
    want = sorted([expected(d.doc_id, d.text) for d in docs], key=str)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def test_all_periods():
    """Runs of two periods and more, with no least length: every run of short texts."""
    r = random.Random(4)
    groups = [[[r.randrange(r.choice((1, 2, 3))) for _ in range(r.randint(0, 40))] for _ in range(20)] for _ in range(20)]
    for g in groups:
        got = runs.periodic([np.array(w, np.int64) for w in g], 2, 2)
        assert got == [by_definition(w, 2, 2) for w in g]


def test_suffixes():
    draw = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 2), (300, 3), (2000, 1), (3000, 500)):
        x = draw.integers(0, k, n)
        order, place = runs.suffix_array(x)
        text = x.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        assert (place[order] == np.arange(n)).all()


def test_common_prefixes():
    draw = np.random.default_rng(2)
    x = draw.integers(0, 2, 400)
    a = draw.integers(0, 401, 3000)
    b = np.where((other := draw.integers(0, 401, 3000)) == a, (a + 1) % 401, other)

    def plain(i, j):
        k = 0
        while i + k < 400 and j + k < 400 and x[i + k] == x[j + k]:
            k += 1
        return k

    assert runs.common_prefixes(x, a, b).tolist() == [plain(i, j) for i, j in zip(a.tolist(), b.tolist())]


def test_outputs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = sorted([(k, by_definition(WORD.findall(t or ""))) for k, t, *_ in rows()], key=str)
    assert sorted([(r.doc_id, [tuple(x) for x in r.runs]) for r in runs.runs(df).collect()], key=str) == want


def test_collapsed(spark):
    df = spark.createDataFrame([(1, "x  y\n" + "a b " * 20 + "end"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, runs.collapsed(df).collect())) == [(1, "x y a b end"), (2, "")]


def test_long_text():
    """A text of a hundred thousand words, plain and periodic, ends in useful time."""
    import time

    draw = np.random.default_rng(3)
    began = time.perf_counter()
    assert runs.periodic([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    part = draw.integers(0, 50, 30_000)
    assert (0, 120_000, 30_000) in runs.periodic([np.tile(part, 4)])[0]
    assert time.perf_counter() - began < 30
