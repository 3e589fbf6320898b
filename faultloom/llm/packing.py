"""Packing tokenised documents into sequences of WIDTH ids along a Hilbert curve.

A document's ids (and the closing id) are hashed to HASH_DIMS signed counts and projected to AXES dimensions; its key is
the Hilbert index of that point, so that documents with like vocabulary have neighbouring keys. Documents travel with
their ids, are range-sorted by key, and each partition's stream of ids is cut at every WIDTH: a sequence holds neighbours
of the curve, and a document is cut only where a sequence ends. The last, shorter sequence of a partition is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, per_worker, tidy

WIDTH, END_ID = 1024, 0
HASH_DIMS, AXES, BITS = 256, 3, 10
SEED = 7

#: Fixed value: how the byte-level vocabulary's text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Settings of a BPE model that the fast encoder doesn't know.
_UNLIKE = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def _plain(cut: dict | None) -> bool:
    """Whether a pre-tokeniser is the byte-level one with PATTERN and without a leading blank."""
    return bool(cut) and cut["type"] == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


class Tokenizer:
    """Ids of a byte-level BPE file (tokenizers' JSON), through a faster encoder over the same ranks.

    Texts that the fast encoder refuses, and all texts where the file asks for anything else than byte-level BPE with the
    usual pattern, go to the tokenizers library itself; both give the same ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = told["added_tokens"]
        usual = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and all(x.get("special") for x in added)
        model = told["model"]
        self.same = model["type"] == "BPE" and usual and not told.get("normalizer") and _plain(told.get("pre_tokenizer")) and not any(model.get(k) for k in _UNLIKE)
        if not self.same:
            return
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {x["content"]: x["id"] for x in added}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __call__(self, text: str) -> np.ndarray:
        if not self.same:
            return self.of_library(text)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special if any(s in text for s in self.special) else set(), disallowed_special=())
        except BaseException as e:  # a panic of the Rust code is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.of_library(text)

    def of_library(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer as Slow

            self.slow = Slow.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with bits bits an axis: Skilling's transform, in columns."""
    x = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for axis in x:
            on = (axis & q) != 0
            swap = np.where(on, 0, (x[0] ^ axis) & p)
            x[0] = np.where(on, x[0] ^ p, x[0])
            if axis is x[0]:
                continue
            x[0] ^= swap
            axis ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << 1) | (((axis ^ flip) >> b) & 1)
    return out


class Curve:
    """Hilbert key of a document's ids; the tables follow from SEED."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.axes = rng.normal(size=(HASH_DIMS, AXES))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        mixed = ids.astype(np.uint32) * np.uint32(2654435761)
        counts = np.bincount(mixed >> np.uint32(24), minlength=HASH_DIMS).astype(float)
        odd = np.bincount((mixed >> np.uint32(24))[(mixed & np.uint32(1 << 12)) != 0], minlength=HASH_DIMS)
        signed = np.sign(counts - 2 * odd) * np.sqrt(np.abs(counts - 2 * odd))
        norm = np.sqrt(signed @ signed)
        return (signed / norm if norm else signed) @ self.axes

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        if not len(vectors):
            return np.zeros(0, np.int64)
        return hilbert(np.clip(np.floor((1 << BITS) / (1 + np.exp(-2.0 * vectors))), 0, (1 << BITS) - 1).astype(np.int64))


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key (Hilbert), id, serial (place in its task, tells repeated rows apart), doc_tokens, ids.

    ids are packed in 2 bytes each where all are below 2^16, else in 4.
    """
    arrow_batches(docs.sparkSession)
    names = ["key", "id", "serial", "doc_tokens", "ids"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, curve, serial = per_worker(("tokenizer", tokenizer_path), lambda: Tokenizer(tokenizer_path)), Curve(), 0
        for b in batches:
            vectors, sizes, packed = [], [], []
            for text in b.column("text"):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                vectors.append(curve.vector(ids))
                sizes.append(len(ids))
                packed.append(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
            keys = curve.keys(np.array(vectors).reshape(-1, AXES))
            columns = [pa.array(keys, pa.int64()), b.column("id"), pa.array(np.arange(serial, serial + len(b))), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            serial += len(b)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(encoded), f"key long, id {dict(docs.dtypes)[id_col]}, serial long, doc_tokens long, ids binary")


class Stream:
    """Cuts documents, in the order in which they come, into pieces of sequences; sequences count from first."""

    def __init__(self, first: int = 0) -> None:
        self.sequence, self.offset = first, 0
        self.open: list[tuple] = []  # (document, start, ids) of the unfinished sequence, less than WIDTH ids

    def _closed(self, parts: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for doc, start, ids in parts:
            out.append((doc, start, len(ids), crc32(ids.tobytes()), self.sequence, at))
            at += len(ids)
        self.sequence += 1
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        """Pieces (document, start, length, crc32, sequence, offset) of the sequences that a document's ids fill."""
        out, at = [], 0
        while at < len(ids):
            some = ids[at : at + WIDTH - self.offset]
            self.open.append((doc, at, some))
            self.offset += len(some)
            at += len(some)
            if self.offset == WIDTH:
                out += self._closed(self.open)
                self.open, self.offset = [], 0
        return out

    def finish(self) -> list[tuple]:
        """Pieces of the unfinished sequence, cut into sequences of powers of two."""
        out, left = [], self.offset
        while left:
            width, parts = 1 << (left.bit_length() - 1), []
            left -= width
            while width:
                doc, start, ids = self.open.pop(0)
                if len(ids) > width:
                    self.open.insert(0, (doc, start + width, ids[width:]))
                    ids = ids[:width]
                parts.append((doc, start, ids))
                width -= len(ids)
            out += self._closed(parts)
        self.offset = 0
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert_key.

    Null and empty texts give the closing id alone; rows repeated with one id, and rows without one, are separate
    documents, each packed; equal keys go by id, then by place. Every id lies in one piece, offsets in a sequence are
    gapless from 0, no sequence is longer than WIDTH. Other columns are ignored; an empty docs gives no rows. A very
    long text is one row of ids. Sequences never cross partitions, so tasks can be repeated on their own.
    """
    documents = materialize(tokenised(docs, tokenizer_path, id_col, text_col), "tokenised")
    ranged = documents.repartitionByRange("key", "id", "serial").sortWithinPartitions("key", "id", "serial")
    id_type = dict(docs.dtypes)[id_col]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(TaskContext.get().partitionId() << 36)
        kind = None

        def told(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, length, crc, sequence, offset = zip(*pieces, strict=True)
            key, ids, total = zip(*doc, strict=True)
            columns = [key, pa.array(ids, kind), start, length, crc, total, sequence, offset]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)

        names = ["key", "id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            kind, out = b.schema.field("id").type, []
            for key, own, total, packed in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), b.column("doc_tokens").to_pylist(), b.column("ids"), strict=True):
                raw = packed.as_buffer()
                out += stream.add((key, own, total), np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4").astype("<u4"))
            if out:
                yield told(out)
        if stream.offset:
            yield told(stream.finish())

    placed = ranged.select("key", "id", "doc_tokens", "ids").mapInArrow(tidy(place), f"key long, id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("key").alias("hilbert_key"))
