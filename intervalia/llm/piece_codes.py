"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent symbol pairs.

A text is cut into characters. An agenda holds every pair of neighbours that makes a piece of the vocabulary, the best score
first and of equal scores the leftmost; the first pair is joined, its pairs with the new neighbours enter the agenda, and
what the join made void is passed over when its turn comes. Characters outside the vocabulary become their UTF-8 bytes if
the vocabulary has byte pieces, else the unknown piece.

No pair is joined across a place where no piece has those two characters side by side, so a text is cut there. In a vocabulary whose
pieces have no space mark after another character, words are therefore independent, and each distinct word or part of a word
is merged once by a worker, while it is remembered. Other vocabularies are merged over whole texts.

What is merged by itself, a distinct word or else a whole text, is also encoded by the sentencepiece library, batch by
batch, and `agrees` says whether all ids of a text are the same. Ids are decoded by the library. Null texts are empty and have the end id alone; very long texts are coded whole, one at a time; every
row is coded by itself, repeated ones too; null doc_ids stay null; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import CACHES, text_of

#: Fixed values of the model file: field numbers, model and piece types, and the mark that stands for a space.
PIECES, TRAINER, MODEL_TYPE, MERGES = 1, 2, 3, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
MARK = "▁"
#: Characters of distinct words whose ids a worker remembers; the memory is dropped when it is full.
REMEMBERED = 8_000_000
#: Characters up to which an agenda is a list, and the place of a pair that is no piece there.
SHORT, NEVER = 64, 1 << 40
#: Characters of texts that are coded at a time.
AT_ONCE = 1 << 20
_built: dict[str, Codes] = {}
CACHES.append(_built)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def vocabulary(path: str) -> list[tuple[str, float, int]]:
    """Piece, score and type by id."""
    with open(path, "rb") as f:
        model = f.read()
    found, kind = [], None
    for number, value in fields(model):
        if number == TRAINER:
            kind = dict(fields(value)).get(MODEL_TYPE)
        if number == PIECES:
            own = dict(fields(value))
            found.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    if kind != MERGES:
        raise ValueError(f"{path} is not a vocabulary of merges")
    return found


class Codes:
    """The ids of texts by merging, from a model file of the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = vocabulary(path)
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        reserved = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (UNKNOWN, CONTROL, BYTE)}
        self.direct = self.ids | reserved
        self.unknown = next(k for k, x in enumerate(pieces) if x[2] == UNKNOWN)
        self.bytes = [reserved.get(f"<0x{b:02X}>") for b in range(256)] if any(x[2] == BYTE for x in pieces) else None
        # equal scores have equal places, so that the leftmost of them is joined first
        place = {s: k for k, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        self.place = {p: place[pieces[k][1]] for p, k in self.ids.items()}
        self.unused = {p for p, _, kind in pieces if kind == UNUSED}
        user = sorted((p for p, _, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        # without a piece for the mark itself, unknown pieces could meet across words
        self.by_word = not user and MARK in self.ids and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # unknown pieces beside one another are one, so texts are cut only where none can be
        self.side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)} if self.bytes is not None and not user else None
        # plain bytes, which the collector of cycles does not visit
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.names = [str(k) for k in range(len(pieces))]
        self.held = 0

    @classmethod
    def of(cls, path: str) -> Codes:
        if path not in _built:
            _built[path] = cls(path)
        return _built[path]

    def merged(self, text: str) -> list[str]:
        """The pieces of a text; user-defined ones stand for themselves, and what lies between two of them is merged by itself."""
        if self.user is None:
            return self._joined(text)
        return [p for k, part in enumerate(self.user.split(text)) if part for p in ([part] if k % 2 else self._joined(part))]

    def _joined(self, text: str) -> list[str]:
        """The pieces of a text by the agenda."""
        if len(text) <= SHORT and not self.unused:
            return self._joined_short(text)
        part, place, n = list(text), self.place.get, len(text)
        # the place of the pair that begins at each symbol; an entry of the agenda holds a place and a symbol
        pair = [place(a + b) for a, b in pairwise(part)]
        pair.append(None)
        agenda = [s << 32 | k for k, s in enumerate(pair) if s is not None]
        if not agenda:
            return part
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        unused, made = self.unused, {}
        if unused:
            made.update((a + b, (a, b)) for a, b in pairwise(part) if a + b in unused)
        while agenda:
            entry = heappop(agenda)
            a = entry & 0xFFFFFFFF
            if pair[a] != entry >> 32:
                continue
            b = after[a]
            part[a] = both = part[a] + part[b]
            part[b] = pair[b] = None
            after[a] = b = after[b]
            if b < n:
                before[b] = a
                pair[a] = s = place(both + part[b])
                if s is not None:
                    heappush(agenda, s << 32 | a)
                    if unused and both + part[b] in unused:
                        made[both + part[b]] = both, part[b]
            else:
                pair[a] = None
            z = before[a]
            if z >= 0:
                pair[z] = s = place(part[z] + both)
                if s is not None:
                    heappush(agenda, s << 32 | z)
                    if unused and part[z] + both in unused:
                        made[part[z] + both] = part[z], both
        return [q for p in part if p for q in self._apart(p, made)] if made else [p for p in part if p]

    def _joined_short(self, text: str) -> list[str]:
        """The same with the agenda as a list by position, whose least is found by looking at all."""
        part, place = list(text), self.place.get
        pair = [place(a + b, NEVER) for a, b in pairwise(part)]
        while pair and (s := min(pair)) != NEVER:
            k = pair.index(s)
            part[k] = both = part[k] + part.pop(k + 1)
            del pair[k]
            if k < len(pair):
                pair[k] = place(both + part[k + 1], NEVER)
            if k:
                pair[k - 1] = place(part[k - 1] + both, NEVER)
        return part

    def _apart(self, piece: str, made: dict[str, tuple[str, str]]) -> list[str]:
        """Unused pieces go back to the pair that they were made of."""
        out, rest = [], [piece]
        while rest:
            p = rest.pop()
            if p in self.unused and p in made:
                rest += reversed(made[p])
            else:
                out.append(p)
        return out

    def coded(self, text: str) -> list[int]:
        """Ids of a normalised text that is merged by itself."""
        out: list[int] = []
        for p in self.merged(text):
            k = self.direct.get(p, self.unknown)
            if k != self.unknown:
                out.append(k)
            elif self.bytes is not None:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != k:
                out.append(k)
        return out

    def _by_part(self, text: str) -> bytes:
        """Ids of a normalised text, cut where no piece has both characters."""
        side = self.side
        cut = [k for k, (a, b) in enumerate(pairwise(text), 1) if a + b not in side] if side else ()
        if not cut:
            return array("i", self.coded(text)).tobytes()
        out = []
        for i, j in pairwise([0, *cut, len(text)]):
            part = text[i:j]
            ids = self.known.get(part)
            if ids is None:
                ids = array("i", self.coded(part)).tobytes()
                if j - i <= SHORT:
                    self.known[part] = ids
                    self.held += j - i
            out.append(ids)
        return b"".join(out)

    def _learn(self, normal: list[str], texts: list[str]) -> list[bytes]:
        """Ids of normalised texts; those that the library codes otherwise from texts are noted."""
        theirs = self.library.encode(texts, num_threads=1)
        ours = [self._by_part(t) for t in normal]
        self.differ.update(t for t, a, b in zip(normal, ours, theirs) if a != array("i", b).tobytes())
        return ours

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each text, and whether the library agrees."""
        normal = self.library.normalize(texts)
        if not self.by_word:
            self.differ.clear()
            return [(array("i", ids).tolist(), t not in self.differ) for ids, t in zip(self._learn(normal, texts), normal)]
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        cut = [self._words(t) for t in normal]
        new = set().union(*cut).difference(self.known)
        # the library puts the first mark before a word itself, but none before nothing
        words = list(new.difference([MARK]))
        self.known.update(zip(words, self._learn(words, [w[1:].replace(MARK, " ") for w in words])))
        self.held += sum(map(len, words))
        if MARK in new:
            ids = self.coded(MARK)
            self.known[MARK] = array("i", ids).tobytes()
            if ids != [self.library.piece_to_id(MARK)]:
                self.differ.add(MARK)
        known, differ = self.known.__getitem__, self.differ
        return [(array("i", b"".join(map(known, words))).tolist(), differ.isdisjoint(words) if differ else True) for words in cut]

    def _words(self, normal: str) -> list[str]:
        """Words of a normalised text, each with the marks before it."""
        if normal and normal[0] == MARK and MARK + MARK not in normal and normal[-1] != MARK:
            words = normal.split(MARK)
            del words[0]
            return [MARK + w for w in words]
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", normal)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of some rows, as many as have AT_ONCE characters together, one at least."""
    for b in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(b.column(0), b.column(1)):
            text = text.as_py()
            if texts and size + len(text) > AT_ONCE:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key.as_py())
            texts.append(text)
            size += len(text)
        if texts:
            yield keys, texts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 and agrees of every row of docs (doc_id, text); an end id follows each text."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes.of(model)
        end = codes.library.eos_id()
        name = codes.names.__getitem__
        for keys, texts in _texts(batches):
            out = codes.encode(texts)
            for ids, _ in out:
                ids.append(end)
            decoded = codes.library.decode([ids for ids, _ in out], num_threads=1)
            columns = [pa.array(keys, pa.int64()), pa.array([len(ids) for ids, _ in out], pa.int64()), pa.array([sha256(" ".join(map(name, ids))) for ids, _ in out]), pa.array([sha256(t) for t in decoded]), pa.array([same for _, same in out])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return _rows(docs).mapInArrow(code, SCHEMA)


def encode(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """doc_id and ids of every row of docs (doc_id, text)."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes.of(model)
        tail = [codes.library.eos_id()] if end else []
        for keys, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([ids + tail for ids, _ in codes.encode(texts)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(code, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of coded (doc_id, ids); null ids are an empty text."""

    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Codes.of(model).library
        for b in batches:
            texts = [library.decode(ids.as_py() or []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(plain, "doc_id long, text string")
