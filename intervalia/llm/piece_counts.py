"""Token counts by a linear longest-match automaton.

A trie holds the pieces that may begin a word and, below a second root, those that may continue one.
Each node has a failure link and the number of pieces that following it completes: when no edge fits the
next byte, the greedy longest pieces of what was read are known to end there, and matching goes on at the
link. A word is read once, byte by byte, and only counted: no piece is built.

Words are `[^\\x20\\x09-\\x0D]+`, their pieces are over UTF-8 bytes. A word that no sequence of pieces
covers counts as one unknown piece. Null, blank and empty texts count 0, very long ones are read whole, one batch at a
time. Every row is counted by itself, repeated ones too; null doc_ids stay null; an empty table gives no rows; other
columns are not read, whatever their names. Pieces with a word-end mark match at the
end of a word alone, and the others never there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import text_of

_built: dict[tuple, Automaton] = {}
#: Distinct words whose counts a worker remembers; the memory is dropped when it is full.
REMEMBERED = 500_000
#: Stands for the word-end mark; no word holds it.
END = b" "


class Automaton:
    def __init__(self, first: Iterable[bytes], more: Iterable[bytes], worth: dict[bytes, int] | None = None):
        """first: pieces that begin a word; more: pieces that continue one; worth: those that count otherwise than 1."""
        self.edge: dict[int, int] = {}
        final, children = [0, 0], [[], []]
        worth = worth or {}
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                at = root
                for byte in piece:
                    nxt = self.edge.get(at << 8 | byte)
                    if nxt is None:
                        nxt = self.edge[at << 8 | byte] = len(final)
                        final.append(0)
                        children.append([])
                        children[at].append((byte, nxt))
                    at = nxt
                if at > 1:
                    final[at] = worth.get(piece, 1)
        n = len(final)
        # link -1: no sequence of pieces covers what was read
        self.link, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for u in queue:
            for byte, v in children[u]:
                if final[v]:
                    self.link[v], self.popped[v] = 1, final[v]
                else:
                    z, count = self.link[u], self.popped[u]
                    while z >= 0 and (z << 8 | byte) not in self.edge:
                        count, z = count + self.popped[z], self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.edge[z << 8 | byte], count
                queue.append(v)

    def count(self, word: bytes) -> int:
        edge, link, popped = self.edge, self.link, self.popped
        at, total = 0, 0
        for byte in word:
            while (nxt := edge.get(at << 8 | byte)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = nxt
        while at != 1:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_of(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a byte-level vocabulary file of the tokenizers library: those within a word, and those that
    end one, without their mark."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to = byte_alphabet()
    inside, ends = set(), set()
    for p in vocab:
        x = p.removesuffix("</w>")
        if x and all(c in to for c in x):
            (inside if x == p else ends).add(bytes(to[c] for c in x))
    return inside, ends


def ending(inside: set[bytes], ends: set[bytes]) -> tuple[set[bytes], dict[bytes, int]]:
    """Pieces over words with END after them, and what some of them count.

    A piece that does not end a word leaves at least a byte of it. Where what is left of a word is such a piece
    and no piece that ends one, its longest match is what shorter pieces make of it; it goes in as one piece
    of that many. Words hold no END, so pieces that do are left out.
    """
    inside, ends = ({p for p in pieces if END not in p} for pieces in (inside, ends))
    worth = {}
    for piece in inside - ends:
        at = n = 0
        while piece[at:] not in ends:
            size = next((k for k in range(len(piece) - at - 1, 0, -1) if piece[at : at + k] in inside), 0)
            if not size:
                break
            at, n = at + size, n + 1
        else:
            worth[piece + END] = n + 1
    return inside | {p + END for p in ends} | set(worth), worth


def automaton(path: str) -> Automaton:
    """For words with END after them if the vocabulary marks word ends, else for words."""
    if (path,) not in _built:
        inside, ends = pieces_of(path)
        pieces, worth = ending(inside, ends) if ends else (inside, {})
        _built[path,] = Automaton(sorted(pieces), sorted(pieces), worth)
        _built[path,].end = END if ends else b""
    return _built[path,]


def counts(docs: DataFrame, vocabulary: str, lower: bool = True) -> DataFrame:
    """doc_id, n_words and n_pieces of every row; vocabulary is the path of a vocabulary file."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        built = automaton(vocabulary)
        one, end = built.count, built.end
        for b in batches:
            n_words, n_pieces = [], []
            for t in b.column(1):
                # bytes.split() cuts at space and U+0009 to U+000D alone
                raw = t.as_py().encode()
                words = (raw.lower() if lower else raw).split()
                total = 0
                for w in words:
                    c = known.get(w)
                    if c is None:
                        c = known[w] = one(w + end)
                    total += c
                n_words.append(len(words))
                n_pieces.append(total)
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], names=["doc_id", "n_words", "n_pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(count, "doc_id long, n_words long, n_pieces long")
