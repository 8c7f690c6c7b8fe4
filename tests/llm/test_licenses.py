"""License scans against the plain count of differences, and edited notices of every template."""

import random

import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import license_scan as ls  # noqa: E402

SCANNER = ls.Scanner(ls.TEMPLATES)


def common(a, b):
    """Length of the longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def test_spans_by_definition():
    r = random.Random(1)
    for _ in range(150):
        words = [r.choice("abcdef") for _ in range(r.randint(1, 9))]
        have = [r.choice("abcdefgh") for _ in range(r.randint(1, 25))]
        notice = ls.Notice("n", words, min(r.randint(0, 4), len(words) - 1))
        got = {last: (differ, first) for differ, first, last in notice.spans(have, 0, len(have))}
        for last in range(1, len(have) + 1):
            ways = [(len(words) + last - first - 2 * common(words, have[first:last]), -first) for first in range(last + 1)]
            differ, first = min(ways)
            if differ <= notice.most and have[last - 1] in words:
                assert got[last] == (differ, -first)
            else:
                assert last not in got


def test_windows_hold_every_span():
    r = random.Random(2)
    for _ in range(300):
        words = [r.choice("abcdefghij") + r.choice(["", "x", "xyz"]) for _ in range(r.randint(2, 12))]
        have = [r.choice("abcdefghijkl") + r.choice(["", "x", "xyz"]) for _ in range(60)]
        at = r.randrange(40)
        have[at : at + len(words)] = [w if r.random() < 0.85 else "new" for w in words]
        notice = ls.Notice("n", words, min(int(0.3 * len(words)), len(words) - 1))
        scanner = ls.Scanner.__new__(ls.Scanner)
        scanner.notices, scanner.cues = [notice], notice.cues
        parts = scanner.candidates(have)
        for differ, first, last in notice.spans(have, 0, len(have)):
            assert any(a <= first and last <= b for _, a, b in parts)


def edited(words, differences, r):
    """Words with at most so many lacking and added."""
    out, left = list(words), differences
    while left:
        kind = r.random()
        k = r.randrange(len(out))
        if kind < 0.4 and left >= 2:
            out[k], left = f"edit{r.randrange(9)}", left - 2
        elif kind < 0.7 and len(out) > 1:
            del out[k]
            left -= 1
        else:
            out.insert(k, r.choice(["the", "of", "edit", *words[:5]]))
            left -= 1
    return out


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_no_edited_notice_is_lost(name):
    """A notice with as many differences as the rule allows is found: it, or one that overlaps it and fits better."""
    r = random.Random(name)
    own = [n for n in SCANNER.notices if n.name == name]
    lost = 0
    for _ in range(400 // len(own)):
        for notice in own:
            changed = edited(notice.words, r.randint(0, notice.most), r)
            if len(notice.words) + len(changed) - 2 * common(notice.words, changed) > notice.most:
                continue
            text = " ".join(["lorem", "ipsum"] * 5 + changed + ["dolor", "sit"] * 5)
            a = len("lorem ipsum " * 5)
            found = SCANNER.judge(text)
            lost += not any(start < a + len(" ".join(changed)) and a < end for _, _, start, end, *_ in found)
    assert lost == 0


def test_templates_without_usual_words():
    """A template of a caller's own is found whatever its words are."""
    own = "This file is in the public domain and may be used by anyone for anything at all without asking"
    scanner = ls.Scanner({"public-domain": (own,), "other": ("do what you like",)})
    for text in (own, own.replace("at all ", "at "), f"x {own.upper()} y", own.replace(" ", "\n# ")):
        assert [x[0] for x in scanner.judge(text)] == ["public-domain"]
    assert scanner.judge("do what you like")[0][0] == "other" and scanner.judge("do what they like") == []


def test_counted_exactly():
    text = "you can redistribute it and/or modify it"  # words around are those of no notice
    gpl = ls.GPL.format(3).split()
    assert text.split()[0] in gpl
    gone = "This program is free software: you can redistribute it and/or modify it under the terms of the the General Public License as published by the Free Software Foundation, either version in of the License, or (at your option) any later version."
    found = SCANNER.judge(gone)
    assert [(x[0], x[4], x[5]) for x in found if x[0].startswith("gpl")] in ([("gpl-2.0", 2, 2)], [("gpl-3.0", 2, 2)])


def test_ranks_of_compression():
    """The right template is among the first by compression for nearly all edited notices, but not for all: it may order, not leave out."""
    r = random.Random(7)
    places = []
    for notice in SCANNER.notices:
        for _ in range(10):
            block = " ".join(edited(notice.words, r.randint(0, notice.most), r))
            places.append(SCANNER.ranked(block).index(notice.name) + 1)
    assert sum(p <= 2 for p in places) / len(places) > 0.6


def test_long_text_of_cues():
    import time

    began = time.perf_counter()
    assert SCANNER.judge("license permission warranties " * 60_000) == []
    assert time.perf_counter() - began < 20
