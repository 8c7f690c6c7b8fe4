"""Why decontamination does not search by random-walk embeddings: their recall at the limit of edits, measured."""

import random

import numpy as np
import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import decontaminate  # noqa: E402

#: Repetitions of the sampling.
REPEATS = 64


def walk(text: bytes, steps: int, seed: int) -> np.ndarray:
    """The embedding: at each step the letter is copied, and the place moves on by a bit drawn for step and letter."""
    bits = np.random.default_rng(seed).integers(0, 2, (steps, 256))
    out, at = np.zeros(steps, np.uint8), 0
    for t in range(steps):
        if at >= len(text):
            break
        out[t] = text[at]
        at += bits[t, text[at]]
    return out


def edited(text: str, share: float, r: random.Random) -> str:
    chars = list(text)
    for _ in range(int(share * len(text))):
        at, kind = r.randrange(len(chars)), r.randrange(3)
        chars[at : at + 1] = [r.choice("abcdefgh ")] if kind == 0 else [chars[at], r.choice("abcdefgh ")] if kind == 1 else []
    return "".join(chars)


def recalls(share: float, sampled: int, items: int = 60) -> tuple[float, float]:
    """Recall of walks over the whole item with keys of so many sampled letters, and of the search that is used."""
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(30)) for _ in range(items)]
    copies = [edited(t, share, r) for t in texts]
    found = 0
    for a, b in zip(texts, copies):
        steps = 3 * len(a)
        draw = np.random.default_rng(9)
        found += any((x == y).all() for x, y in ((walk(a.encode(), steps, k)[p], walk(b.encode(), steps, k)[p]) for k in range(REPEATS) for p in [draw.integers(0, 2 * len(a), sampled)]))
    got = decontaminate.Index(list(enumerate(texts))).matches([b.encode() for b in copies])
    return found / items, sum(k in [x[0] for x in g] for k, g in enumerate(got)) / items


@pytest.mark.parametrize("sampled", [4, 8])
def test_recall_of_walks_and_of_leaves(sampled):
    """Four letters meet by chance in one of 16^4 windows, so 64 keys of 200 items make one of five a candidate."""
    for share in (0.05, 0.1, 0.15, 0.19):
        walks, leaves = recalls(share, sampled)
        print(f"{sampled} letters, {share:.0%} of edits: walks {walks:.2f}, leaves {leaves:.2f}")
        assert leaves == 1.0
    assert walks < 0.9
