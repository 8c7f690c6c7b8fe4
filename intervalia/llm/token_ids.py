"""Token ids in bit-plane files: tokenise, shuffle planes, compress, index, write, read back.

File format. A segment holds whole documents in ascending doc_id order:
    b"BPS2", block size, number of ids, number of documents, number of blocks      (<4sIQII)
    doc_id of each document (int64), a byte that is 1 where it is null, ids of each document (uint32)
    chunk index: byte offset and id count of each block                             (uint64, uint32)
    blocks: for each of the four byte planes its compressed length (uint32), then the planes
A block of ids is transposed into byte planes (byte 0 of all ids, byte 1, ...), or with planes="bit"
into 32 bit planes; each plane is compressed by itself with zstandard, a plane of zeros has length 0.
The chunk index gives random access to any run of ids without reading the rest.

Documents are range-partitioned by doc_id, so a shard holds a run of doc_ids and the segments of a
shard follow one another. Null texts are empty; null doc_ids come first; rows with equal doc_id are
ordered by text, and repeated rows are written each. A task holds one segment at a time. A document is never split between
segments, so a very long text may make one of its own. An empty table gives no segments and no rows. Columns beside doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from intervalia.llm.common import CACHES, saved, text_of
from intervalia.llm.piece_counts import byte_alphabet

HEAD = struct.Struct("<4sIQII")
BLOCK = 65536
#: A segment is closed at this many ids.
SEGMENT_IDS = 1 << 20
END_ID = 2
#: Distinct parts whose ids a worker remembers; when so many are new, those of the time before are dropped.
REMEMBERED = 400_000
_known: dict[str, Encoder] = {}
CACHES.append(_known)
#: A run of Latin letters and a run of marks, which the byte-level pattern cuts into these two pieces.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?%&*#$]*)").fullmatch


class Parts(dict):
    """Ids of parts that follow a space; those that are not known are learnt when they are asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        return self.encoder._learn(part)


class Encoder:
    """The ids of a text, as little-endian uint32 bytes.

    A plain space before a character that is no blank always begins a new piece of the byte-level
    pattern, so a text is cut there and the ids of each part are remembered. A line of Latin letters and
    then plain marks is two pieces, which go to the tokenizer's model by themselves; parts that are not lines of that kind, and
    texts with a special token or another blank after a space, go through the tokenizer whole. So do all texts
    if the file is of another kind than byte-level BPE with that pattern and without a normalizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        kind = json.loads(self.tokenizer.to_str())
        cut = kind["pre_tokenizer"] or {}
        self.plain = kind["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and kind["model"]["type"] == "BPE" and not kind["model"].get("dropout")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = False
        self.parts = Parts(self)
        self.words: dict[str, bytes] = {}
        self.before = {}, {}
        letters = {b: c for c, b in byte_alphabet().items()}
        self.shown = [letters[b] for b in range(256)]
        self.line_end = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(self.shown[10])]) if self.plain else b""
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _known:
            _known[path] = cls(path)
        return _known[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = self.words.get(piece)
        if ids is None:
            ids = self.before[1].get(piece)
            if ids is None:
                # ASCII letters and marks show as themselves, so only a space before them is replaced
                shown = self.shown[32] + piece[1:] if piece[0] == " " and piece.isascii() else "".join([self.shown[b] for b in piece.encode()])
                ids = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
            self.words[piece] = ids
        return ids

    def _by_piece(self, part: str, space: str) -> bytes | None:
        """Ids of a part of plain lines: a line end between two characters that are no blanks is a piece of its own."""
        piece, out = self._piece, []
        for line in part.split("\n"):
            m = _PLAIN(line)
            if m is None:
                return None
            out.append(piece(space + m[1]))
            if m[2]:
                out.append(piece(m[2]))
            out.append(self.line_end)
            space = ""
        del out[-1]
        return b"".join(out)

    def _learn(self, part: str) -> bytes:
        """Ids of a part that follows a space and is not known."""
        if not part or part[0].isspace():
            # not remembered, so that each text with such a part is told
            self.blank = True
            return b""
        ids = self.before[0].get(part)
        if ids is None:
            ids = self._piece(" " + part) if part.isascii() and part.isalpha() else self._by_piece(part, " ")
            if ids is None:
                ids = self._ids([" " + part])[0]
        self.parts[part] = ids
        return ids

    def _encode(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        first = self._by_piece(head, "")
        if first is None:
            first = self._ids([head])[0]
        self.blank = False
        ids = first + b"".join(map(self.parts.__getitem__, rest))
        return self._ids([text])[0] if self.blank else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._ids(texts)
        if len(self.parts) > REMEMBERED or len(self.words) > REMEMBERED:
            self.before, self.parts, self.words = (self.parts, self.words), Parts(self), {}
        special = self.special
        return [self._ids([t])[0] if any([x in t for x in special]) else self._encode(t) for t in texts]


def pack_block(ids: np.ndarray, planes: str, compressor) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    rows = [np.packbits((ids >> k).astype(np.uint8) & 1) for k in range(32)] if planes == "bit" else [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    data = [compressor.compress(r.tobytes()) if r.any() else b"" for r in rows]
    return struct.pack(f"<{len(data)}I", *map(len, data)) + b"".join(data)


def unpack_block(data: memoryview, n: int, planes: str, decompressor) -> np.ndarray:
    k = 32 if planes == "bit" else 4
    sizes, at = struct.unpack_from(f"<{k}I", data), 4 * k
    out = np.zeros((n, 4), np.uint8) if k == 4 else np.zeros(n, "<u4")
    for p, size in enumerate(sizes):
        if size:
            row = np.frombuffer(decompressor.decompress(data[at : at + size]), np.uint8)
            if k == 4:
                out[:, p] = row
            else:
                out |= np.unpackbits(row, count=n).astype("<u4") << p
        at += size
    return out.view("<u4").ravel() if k == 4 else out


def pack_segment(doc_ids: list[int | None], each: list[bytes], planes: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(each), "<u4")
    blocks = [pack_block(ids[k : k + block], planes, compressor) for k in range(0, len(ids), block)]
    counts = np.array([min(block, len(ids) - k) for k in range(0, len(ids), block)], "<u4")
    offsets = np.cumsum([0, *map(len, blocks)])[: len(blocks)].astype("<u8")
    head = HEAD.pack(b"BPS2" if planes == "byte" else b"BPB2", block, len(ids), len(each), len(blocks))
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + np.array([len(x) // 4 for x in each], "<u4").tobytes()
    return b"".join([head, table, offsets.tobytes(), counts.tobytes(), *blocks])


def read_segment(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a segment."""
    import zstandard

    magic, _, _, n_docs, n_blocks = HEAD.unpack_from(data)
    if magic not in (b"BPS2", b"BPB2"):
        raise ValueError("not a bit-plane segment")
    at = HEAD.size
    doc_ids, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    nulls, at = data[at : at + n_docs], at + n_docs
    counts, at = np.frombuffer(data, "<u4", n_docs, at), at + 4 * n_docs
    offsets, at = np.frombuffer(data, "<u8", n_blocks, at), at + 8 * n_blocks
    sizes, at = np.frombuffer(data, "<u4", n_blocks, at), at + 4 * n_blocks
    body, d = memoryview(data)[at:], zstandard.ZstdDecompressor()
    ids = np.concatenate([np.zeros(0, "<u4"), *[unpack_block(body[int(o) :], int(n), "byte" if magic == b"BPS2" else "bit", d) for o, n in zip(offsets, sizes)]])
    begin = 0
    for doc_id, null, n in zip(doc_ids, nulls, counts):
        yield None if null else int(doc_id), ids[begin : begin + int(n)]
        begin += int(n)


SEGMENTS = "shard int, seq int, n_docs long, n_ids long, data binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, planes: str = "byte", segment_ids: int = SEGMENT_IDS, block: int = BLOCK) -> DataFrame:
    """Encodes docs (doc_id, text) and writes the segments to the shared folder; returns them as read back."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    end = struct.pack("<I", end_id)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(tokenizer)
        shard, seq, doc_ids, each, size = 0, 0, [], [], 0

        def segment():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(each)], "n_ids": [size], "data": [pack_segment(doc_ids, each, planes, block)]})

        for b in batches:
            if not b.num_rows:
                continue
            shard, keys, texts = b.column(0)[0].as_py(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for begin in range(0, len(texts), 256):
                for doc_id, ids in zip(keys[begin : begin + 256], coder.encode(texts[begin : begin + 256])):
                    doc_ids.append(doc_id)
                    each.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield segment()
                        seq, doc_ids, each, size = seq + 1, [], [], 0
        if each:
            yield segment()

    return saved(rows.mapInArrow(encode, SEGMENTS), "token-ids")


def read(segments: DataFrame, per_document, schema: str) -> DataFrame:
    """Reads segments; per_document(shard, seq, doc_id, local start, ids) gives a tuple of schema."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, seq, data in zip(b.column("shard").to_pylist(), b.column("seq").to_pylist(), b.column("data")):
                begin, out = 0, []
                for doc_id, ids in read_segment(data.as_py()):
                    out.append(per_document(shard, seq, doc_id, begin, ids))
                    begin += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return segments.select("shard", "seq", "data").mapInArrow(decode, schema)


def starts(segments: DataFrame) -> DataFrame:
    """shard, seq and base: the ids of all segments before each."""
    s = segments.select("shard", "seq", "n_ids")
    shards = s.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    inner = s.withColumn("upto", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")))
    return inner.join(shards, "shard").select("shard", "seq", (F.col("before") + F.col("upto") - F.col("n_ids")).alias("base"))


def digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def one(shard, seq, doc_id, begin, ids):
        return shard, seq, doc_id, begin, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())

    rows = read(segments, one, "shard int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts(segments), ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
