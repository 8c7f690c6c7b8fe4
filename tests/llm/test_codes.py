"""SentencePiece coding against the library."""

import hashlib
import random

import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import piece_codes, queries  # noqa: E402

PATH = queries.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, ids_sha256 int, agrees string"


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def texts():
    r = random.Random(3)
    alphabet = list("abcdefghijklmnopqrstuvwxyz") * 3 + list(" \t\n  ▁.,;:=-_<>/0123456789ABCDEFéüñß€漢字😀́​\x00�")
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(400)]
    out += [None, "", " ", "  ", "   a", "a   ", "▁", "▁▁a", "a▁b", "<s>", "</s>", "<unk>", "<0x41>", "\n\n", "\x00", " " * 33, "=" * 5000, "ab" * 4000, "a b " * 3000, "x" * 60000, "漢" * 500, "🏳️‍🌈", "é"]
    words = ["the", "quick", "international", "Übergröße", "naïve", "supercalifragilistic", "1999", "don't", "foo_bar", "http://x.y/z?q=1"]
    return out + [" ".join(r.choice(words) for _ in range(n)) for n in (1, 5, 50, 5000)]


def test_same_as_library(spark):
    rows = [(None if k == 7 else k // 2 * 2, t, "clash", 1, "x") for k, t in enumerate(texts())]
    sp = library()
    want = []
    for k, t, *_ in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)), True))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = piece_codes.round_trip(df, PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert piece_codes.round_trip(df.where("false"), PATH).count() == 0


def test_query(spark):
    sp = library()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_piece_codes(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)), True)


def test_there_and_back(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = piece_codes.encode(df, PATH)
    sp = library()
    assert {r.doc_id: r.ids for r in coded.collect()} == {k: sp.encode(t or "", add_eos=True) for k, t in rows}
    back = {r.doc_id: r.text for r in piece_codes.decode(coded, PATH).collect()}
    assert back == {k: (t or "").replace("▁", " ") for k, t in rows}
    assert piece_codes.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).collect() == [(1, ""), (2, "")]


def slow(codes, text):
    """Pieces by joining the best pair of all, the leftmost of equals, until none is left."""
    part = list(text)
    while True:
        best = min(((codes.place[a + b], k) for k, (a, b) in enumerate(zip(part, part[1:])) if a + b in codes.place), default=None)
        if best is None:
            return part
        k = best[1]
        part[k : k + 2] = [part[k] + part[k + 1]]


def test_agenda_by_definition():
    codes = piece_codes.Codes.of(PATH)
    for t in texts():
        if t and len(t) < 200:
            normal = codes.library.normalize(t)
            assert codes.merged(normal) == slow(codes, normal)


def proto(number, kind, value):
    return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)


def model_file(path, pieces, kind=2):
    """A small model file: pieces of (text, score, type)."""
    import struct

    data = b"".join(proto(1, 2, proto(1, 2, p.encode()) + proto(2, 5, struct.pack("<f", s)) + proto(3, 0, bytes([t]))) for p, s, t in pieces)
    data += proto(2, 2, proto(3, 0, bytes([kind])))
    data += proto(3, 2, proto(1, 2, b"identity") + proto(3, 0, b"\1") + proto(4, 0, b"\0") + proto(5, 0, b"\1"))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("extra", [[], [("▁", -20.0, 1)], [("▁", -20.0, 1), ("a▁b", -3.5, 1), ("a▁", -3.0, 1)], [("▁", -20.0, 1), ("ab", -1.0, 5)], [("▁", -20.0, 1), ("cab", 0.0, 4)]])
def test_other_vocabularies(tmp_path, extra):
    """Without bytes, without the mark, with pieces across words, unused and user-defined pieces, equal scores."""
    import sentencepiece

    base = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("aa", -1.0, 1), ("bb", -1.0, 1), ("aab", -1.0, 1), ("▁a", -2.0, 1), ("abb", -2.0, 1), ("ba", -2.0, 1), ("a", -9.0, 1), ("b", -9.0, 1), ("c", -9.0, 1)]
    if not any(x[0] == "ab" for x in extra):
        base.append(("ab", -1.5, 1))
    path = model_file(tmp_path / "m.model", base + extra)
    codes = piece_codes.Codes(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    for _ in range(500):
        t = "".join(r.choice("aaabbbc xy ") for _ in range(r.randint(0, 14)))
        assert codes.encode([t])[0][0] == sp.encode(t), t
        assert codes.encode([t])[0][1]


def test_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError):
        piece_codes.vocabulary(model_file(tmp_path / "m.model", [("<unk>", 0.0, 2), ("a", -1.0, 1)], kind=1))
