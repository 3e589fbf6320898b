"""Document quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as half of
(sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 in each of RANK factors. Inputs: log counts of a text's lower-cased words hashed
to WORD_DIMS buckets (unit length), STATS statistics of its bytes, words and lines cut into BINS bins at the training
rows' quantiles, and the metadata column n_chars, binned likewise and compared with the real length. Labels, language,
source and id are never inputs. The model is fitted on at most TRAIN_ROWS labelled rows, those of the least hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, release, tidy

TRAIN_ROWS = 8000
WORD_DIMS, RANK, BINS = 1 << 14, 8, 10
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.08, 1e-5
SEED = 11

#: Byte classes: 0 other, 1 upper case, 2 lower case, 3 digit, 4 blank, 5 bar, 6 sentence mark, 7 other ASCII mark, 8 beyond ASCII.
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((range(33, 127), 7), (range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), ((9, 10, 11, 12, 13, 32), 4), ((124,), 5), ((33, 44, 46, 58, 59, 63), 6), (range(128, 256), 8)):
    _CLASS[list(_chars)] = _k

STATS = 16
DIMS = WORD_DIMS + (STATS + 1) * BINS


def statistics(text: bytes, words: list[bytes], counts: Counter, n_chars: float | None) -> list[float]:
    """STATS numbers about a text; all are defined for an empty text. The last two are metadata."""
    size = len(text)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    lines = text.split(b"\n")
    n, most = len(words), max(counts.values(), default=0)
    share = kinds / max(size, 1)
    length = len(text.decode("utf-8", "replace"))
    return [
        np.log1p(n), np.log1p(size), size / max(n, 1), len(counts) / max(n, 1), most / max(n, 1),
        share[1] / max(share[1] + share[2], 1e-9), share[3], share[5], share[6], share[7], share[8],
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(c for w, c in counts.items() if w[-1] not in _PLAIN_END) / max(1, n),
        -1.0 if n_chars is None else np.log1p(max(n_chars, 0.0)),
        -1.0 if n_chars is None else min(abs(n_chars - length), 1e6) / max(length, 1),
    ]


#: Bytes that end an ordinary word: letters, digits, sentence marks and anything beyond ASCII.
_PLAIN_END = frozenset([*range(97, 123), *range(48, 58), *b".,;:?)\"'", *range(128, 256)])


class Encoder:
    """Turns texts into word indices with weights, and statistics."""

    def __init__(self) -> None:
        self.slots: dict[bytes, int] = {}

    def __call__(self, text: bytes | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or b""
        words = text.lower().split()
        counts = Counter(words)
        slots = self.slots
        if len(slots) > 100_000:
            slots.clear()
        index = np.empty(len(counts), np.int64)
        for i, w in enumerate(counts):
            k = slots.get(w)
            if k is None:
                k = slots[w] = crc32(w) % WORD_DIMS
            index[i] = k
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = np.sqrt(np.dot(value, value))
        return index, value / norm if norm else value, statistics(text, words, counts, n_chars)


class Model:
    """Parameters of the machine; plain arrays of fixed size, so they travel with the task."""

    def __init__(self, edges: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.edges = edges
        self.bias = 0.0
        self.w = np.zeros(DIMS)
        self.v = rng.normal(0, 0.02, (DIMS, RANK))

    def bins(self, stats: list[float] | np.ndarray) -> np.ndarray:
        return WORD_DIMS + np.arange(STATS) * BINS + np.array([np.searchsorted(e, x, side="right") for e, x in zip(self.edges, stats, strict=True)])

    def inputs(self, index: np.ndarray, value: np.ndarray, stats: list[float] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([index, self.bins(stats)]), np.concatenate([value, np.full(STATS, 0.5)])

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows, and the factor sums that a gradient step reuses."""
        at = np.cumsum([0, *(len(i) for i, _ in rows)])[:-1]
        index, value = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat(vx * vx, at, axis=0)
        return self.bias + np.add.reduceat(self.w[index] * value, at) + 0.5 * (sums * sums - squares).sum(1), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
        """AdaGrad on the logistic loss; classes weigh alike half-way (square root of their inverse share)."""
        rng = np.random.default_rng(SEED)
        share = np.clip(labels.mean(), 0.02, 0.98)
        weight = np.where(labels == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
        gw, gv, gb = np.full(DIMS, 1e-6), np.full((DIMS, RANK), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), BATCH):
                part = order[start : start + BATCH]
                some = [rows[k] for k in part]
                margin, sums = self.margins(some)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * weight[part] / len(part)
                own = np.repeat(np.arange(len(some)), [len(i) for i, _ in some])
                index, value = np.concatenate([i for i, _ in some]), np.concatenate([x for _, x in some])
                step = slope[own] * value
                uniq, inverse = np.unique(index, return_inverse=True)
                dw = np.bincount(inverse, step, len(uniq)) + DECAY * self.w[uniq]
                each = step[:, None] * (sums[own] - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(inverse, each[:, f], len(uniq)) for f in range(RANK)], 1) + DECAY * self.v[uniq]
                db = slope.sum()
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                gb += db * db
                self.w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= RATE * 0.3 * dv / np.sqrt(gv[uniq])
                self.bias -= RATE * db / np.sqrt(gb)
        return self

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows)[0], -500, 500)))


def _projected(df: DataFrame, id_col: str, text_col: str, meta_col: str) -> list:
    meta = F.col(meta_col).cast("double") if meta_col in df.columns else F.lit(None).cast("double")
    return [F.col(text_col).cast("string").cast("binary").alias("text"), meta.alias("meta")]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_col: str = "n_chars", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most rows labelled documents that are not held out (crc32 of the id modulo 4 is 2).

    Rows without an id or a label are left out; of several labels of an id the largest counts, of several texts of an id
    that with the least hash: at most rows rows go to the driver, however often an id is repeated. Null texts count as
    empty. Without any labelled document (an empty table too), or with one class only, the scores are near that class's
    share (0.5 without any). Other columns are ignored, whatever their names.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, 4, 2))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    text, meta = _projected(docs, id_col, text_col, meta_col)
    texts = docs.select(F.col(id_col).alias("__id"), text, meta).join(F.broadcast(picked), "__id")
    one = texts.groupBy("__id", "__label").agg(F.min_by(F.struct("text", "meta"), F.xxhash64("text", "meta")).alias("one"))
    source = one.select(F.col("__id").cast("long").alias("id"), F.col("__label").alias("label"), "one.text", "one.meta")
    schema = "id long, label int, slots binary, weights binary, stats array<double>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in batches:
            out = [encoder(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array([i.astype("<u2").tobytes() for i, _, _ in out], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x, _ in out], pa.binary()), pa.array([s for _, _, s in out], pa.list_(pa.float64()))],
                names=["id", "label", "slots", "weights", "stats"],
            )

    table = source.mapInArrow(tidy(encode), schema).toArrow()
    got = table.sort_by([("id", "ascending"), ("label", "ascending"), ("slots", "ascending")]).combine_chunks()
    stats = got["stats"].combine_chunks().flatten().to_numpy().reshape(-1, STATS)
    model = Model(np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(got) else np.zeros((STATS, BINS - 1)))
    encoded = [model.inputs(np.frombuffer(i.as_buffer(), "<u2").astype(np.int64), np.frombuffer(x.as_buffer(), "<f4").astype(np.float64), s) for i, x, s in zip(got["slots"], got["weights"], stats, strict=True)]
    if encoded:
        model.fit(encoded, (got["label"].to_numpy() > 0).astype(float))
    del table, got, encoded
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars", threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs, then the score (0 to 1) and whether it reaches the threshold (1 or 0), under the given names.

    Whole texts are read. A null text scores as an empty one; a null or missing metadata column has a bin of its own.
    Repeated rows get equal scores; an empty docs gives no rows. A column of docs that has one of the names is an error:
    give others.
    """
    if set(names) & set(docs.columns):
        raise ValueError(f"docs has a column {sorted(set(names) & set(docs.columns))}: give other names")
    arrow_batches(docs.sparkSession)
    kept = docs.columns
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *_projected(docs, id_col, text_col, meta_col))
    types = dict(docs.dtypes)
    schema = ", ".join([f"k{i} {types[c]}" for i, c in enumerate(kept)] + ["score double"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for b in batches:
            texts, metas = b.column("text"), b.column("meta").to_pylist()
            scores = np.empty(len(b))
            for at in range(0, len(b), 64):
                rows = [model.inputs(*encoder(t.as_py(), m)) for t, m in zip(texts[at : at + 64], metas[at : at + 64], strict=True)]
                scores[at : at + 64] = model.score(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(kept))), pa.array(scores)], names=[*(f"k{i}" for i in range(len(kept))), "score"])

    out = source.mapInArrow(tidy(apply), schema)
    told = F.col("score").alias(names[0]), (F.col("score") >= threshold).cast("int").alias(names[1])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *told)


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars", threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns unchanged, whatever the names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    args = [names[docs.columns.index(c)] if c in docs.columns else c for c in (id_col, text_col, meta_col)]
    return score(docs.toDF(*names), model, *args, threshold).where("predicted = 1").select(*names).toDF(*docs.columns)
