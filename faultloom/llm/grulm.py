"""Language-model scores: a gated recurrent network with a class-factored output softmax, in numpy.

The HEAD most frequent tokens form classes of WIDTH by frequency; every other token belongs to one of KINDS classes by its
spelling. P(token | past) = P(class | state) * P(token | class, state) for a head token; in a tail class the second
factor is (c + 0.5) / (the class's sum of it, one unseen token included) from counts c over all training documents. The
state (UNITS gated units) is carried from window to window, so a text is scored whole, whatever its length.

Counts: each chunk's counts go to buckets by token hash; a bucket adds them up. The LOOKUP most frequent tokens
travel to every task; occurrences of all others are sent to their bucket, which returns sums by document. Weights: truncated
backpropagation (WINDOW steps) warms up on one group of documents, then every other group goes on from there by itself and
the weights are averaged. Groups hold some GROUP_TOKENS tokens; every training document is in one of them and is passed
once, whatever the size of the corpus. A group's documents, one after another, are cut into streams of equal length; a stream
that begins within a document starts from the state after the WINDOW tokens before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, materialize, most_frequent, tidy
from .shingles import scramble

HEAD, WIDTH, KINDS, UNITS, EMBED = 1024, 32, 16, 16, 16
LOOKUP = 1 << 18
GROUP_TOKENS = 1_000_000
WINDOW = 32

#: Streams that a training step reads side by side, in the warm-up and after it, and at most when scoring.
LANES, MORE_LANES, SCORED = 64, 256, 1024
CHUNK, BUCKET_BYTES = 2_500_000, 64 << 20
RATE, SEED = 0.006, 5

#: The closing token of every document; no word has its kind.
END = (xxhash.xxh3_64_intdigest(b"\n") & ~15) | 15

_ACCENTS = np.zeros(256, np.int64)
_ACCENTS[[0xA1, 0xAD, 0xB1, 0xB3, 0xBA]] = 1
_ACCENTS[[0xA4, 0xB6, 0xBC, 0x9F]] = 2
_ACCENTS[[0xA0, 0xA2, 0xA7, 0xA8, 0xA9, 0xAA, 0xAB, 0xAE, 0xAF, 0xB4, 0xB9, 0xBB]] = 3
_PUNCTUATION, _DIGITS = frozenset(b".,;:?)\"'"), frozenset(b"0123456789")


def kind_of(word: bytes) -> int:
    """Spelling class: 0-3 ASCII (plain, closed by punctuation, digits, other), 4-11 by accents, 12 very long."""
    if len(word) > 32:
        return 12
    last = word[-1]
    if word.isascii():
        return 0 if word.isalpha() else 2 if not _DIGITS.isdisjoint(word) else 1 if last in _PUNCTUATION else 3
    k = word.find(b"\xc3")
    return 4 + (int(_ACCENTS[word[k + 1]]) if 0 <= k < len(word) - 1 else 0) + 4 * (last in _PUNCTUATION)


class Local(dict):
    """Numbers a chunk's distinct words 0, 1, 2 ...; ids holds their 60-bit hashes with the kind in the low four bits."""

    def __init__(self) -> None:
        super().__init__()
        self.ids = [END]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.ids)
        self.ids.append((xxhash.xxh3_64_intdigest(word) & ~15) | kind_of(word))
        return n

    def tokens(self, text: bytes | None) -> np.ndarray:
        """Local numbers of a text's words and the end (0)."""
        words = (text or b"").lower().split()
        return np.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)), np.int32(0))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (scramble(ids, 3) % np.uint64(buckets)).astype(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def count_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: its tokens' ids (sorted) and counts, its most frequent tokens, and mass and number of tokens by kind."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, counts, held = Local(), [], 0

        def packed() -> pa.RecordBatch:
            ids = np.array(local.ids, np.uint64)
            count = np.bincount(np.concatenate(counts), minlength=len(ids)).astype(np.int64)
            ids, count = ids[count > 0], count[count > 0]
            bucket = bucket_of(ids, buckets)
            at = np.argsort(bucket, kind="stable")
            ids, count, bucket = ids[at], count[at], bucket[at]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            cut = [slice(a, z) for a, z in zip(starts, [*starts[1:], len(ids)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([ids[c].tobytes() for c in cut], pa.binary()), pa.array([count[c].tobytes() for c in cut], pa.binary())], names=["bucket", "ids", "counts"])

        for b in batches:
            for text in b.column("text"):
                counts.append(local.tokens(text.as_py()))
                held += len(counts[-1])
                if held >= CHUNK:
                    yield packed()
                    local, counts, held = Local(), [], 0
        if held:
            yield packed()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["ids"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"]])
        ids, inverse = np.unique(every, return_inverse=True)
        count = np.bincount(inverse, counts, len(ids)).astype(np.int64)
        top = np.lexsort((ids, -count))[:LOOKUP]
        kind = (ids & np.uint64(15)).astype(np.int64)
        return pa.table(
            {
                "bucket": [key[0].as_py()], "ids": pa.array([ids.tobytes()], pa.binary()), "counts": pa.array([count.tobytes()], pa.binary()),
                "top": pa.array([ids[top].view(np.int64).tolist()], pa.list_(pa.int64())), "top_counts": pa.array([count[top].tolist()], pa.list_(pa.int64())),
                "mass": pa.array([np.bincount(kind, count, KINDS).astype(np.int64).tolist()], pa.list_(pa.int64())), "types": pa.array([np.bincount(kind, minlength=KINDS).tolist()], pa.list_(pa.int64())),
            }
        )

    schema = "bucket long, ids binary, counts binary, top array<long>, top_counts array<long>, mass array<long>, types array<long>"
    return materialize(docs.mapInArrow(tidy(chunks), "bucket long, ids binary, counts binary").groupBy("bucket").applyInArrow(tidy(merge), schema), "token-counts")


class Vocabulary:
    """What every task knows of the counts: the LOOKUP most frequent tokens (12 bytes each), and sums."""

    def __init__(self, counted: DataFrame) -> None:
        top = most_frequent(counted.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t")).select("t.top", "t.top_counts"), "top", "top_counts", LOOKUP)
        sums = counted.select(F.posexplode(F.arrays_zip("mass", "types")).alias("kind", "s")).groupBy("kind").agg(F.sum("s.mass"), F.sum("s.types")).collect()
        self.mass, self.types = np.zeros(KINDS), np.zeros(KINDS)
        for kind, mass, types in sums:
            self.mass[kind], self.types[kind] = mass, types
        self.total, self.distinct = int(self.mass.sum()), int(self.types.sum())
        ids, counts = top[0].view(np.uint64), top[1]
        head = ids[:HEAD]
        if len(ids) and END not in head:
            head = np.append(head[: HEAD - 1], np.uint64(END))
        at = np.argsort(ids)
        self.ids, self.counts, self.head = ids[at], counts[at], head
        self.head_counts = np.maximum(self.known(head), 0).astype(float)
        own = (head & np.uint64(15)).astype(np.int64)
        self.tail = np.maximum(self.mass - np.bincount(own, self.head_counts, KINDS), 0) + 0.5 * np.maximum(self.types - np.bincount(own, minlength=KINDS), 0) + 0.5

    def classes(self) -> int:
        return -(-len(self.head) // WIDTH)

    def items(self, ids: np.ndarray) -> np.ndarray:
        """Item of each id: its place in the head, or len(head) + kind."""
        order = np.argsort(self.head)
        out = len(self.head) + (ids & np.uint64(15)).astype(np.int64)
        if len(order):
            at = order[np.minimum(np.searchsorted(self.head[order], ids), len(order) - 1)]
            out = np.where(self.head[at] == ids, at, out)
        return out

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Count of each id, -1 where only the id's bucket can tell."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.counts[at], -1 if self.distinct > len(self.ids) else 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name, and what is computed with them. Items: head tokens, tail kinds, the start of a text."""

    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray] | None = None) -> None:
        self.heads, self.classes = len(vocabulary.head), vocabulary.classes()
        if weights is None:
            rng = np.random.default_rng(SEED)
            slots = np.full((max(self.classes, 1), WIDTH), -1e4)
            slots.reshape(-1)[: self.heads] = np.log(vocabulary.head_counts + 0.5)
            mass = np.exp(slots).sum(1)[: self.classes]
            weights = {
                "embed": rng.normal(0, 0.3, (self.heads + KINDS + 1, EMBED)), "wx": rng.normal(0, EMBED**-0.5, (EMBED, 3 * UNITS)), "bx": np.zeros(3 * UNITS),
                "wh": rng.normal(0, UNITS**-0.5, (UNITS, 3 * UNITS)), "wc": np.zeros((UNITS, self.classes + KINDS)), "bc": np.log(np.r_[mass, vocabulary.tail]),
                "wo": np.zeros((max(self.classes, 1), UNITS, WIDTH)), "bo": slots,
            }
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.inputs = None

    def class_of(self, items: np.ndarray) -> np.ndarray:
        return np.where(items < self.heads, items // WIDTH, self.classes + items - self.heads)

    def steps(self, items: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple:
        """States after each step of a window (steps x lanes of items); fresh marks the steps that begin a text."""
        if self.inputs is None or keep:
            self.inputs = self.w["embed"] @ self.w["wx"] + self.w["bx"]
        gates, wh, n = self.inputs[items], self.w["wh"], UNITS
        out = np.empty((*items.shape, n), np.float32)
        held = tuple(np.empty((*items.shape, k), np.float32) for k in (n, 2 * n, n, n)) if keep else ()
        going = np.where(fresh, np.float32(0), np.float32(1))[:, :, None]
        for t in range(len(items)):
            state = state * going[t]
            hidden = state @ wh
            zr = _sigmoid(gates[t, :, : 2 * n] + hidden[:, : 2 * n])
            z, r, inner = zr[:, :n], zr[:, n:], hidden[:, 2 * n :]
            new = np.tanh(gates[t, :, 2 * n :] + r * inner)
            if keep:
                for x, value in zip(held, (state, zr, new, inner), strict=True):
                    x[t] = value
            state = np.add(new, z * (state - new), out=out[t])
        return out, state, held

    def output(self, states: np.ndarray, items: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of items (rows of states); with grads, also the loss's slopes by state."""
        w, every = self.w, np.arange(len(items))
        own = self.class_of(items)
        order = np.argsort(own.astype(np.uint16), kind="stable")
        s, own, items = states[order], own[order], items[order]
        # a column for each item: sums over classes then run along memory
        e = w["wc"].T @ s.T
        e += w["bc"][:, None]
        e -= e.max(0)
        score = e[own, every]
        np.exp(e, out=e)
        total = e.sum(0)
        score -= np.log(total)
        slope = None
        if grads is not None:
            e /= total
            e[own, every] -= 1
            grads["wc"] += (e @ s).T
            grads["bc"] += e.sum(1)
            slope = (w["wc"] @ e).T
        bounds = np.searchsorted(own, np.arange(self.classes + 1))
        for c in range(self.classes):
            at = slice(bounds[c], bounds[c + 1])
            if at.start == at.stop:
                continue
            f = w["wo"][c].T @ s[at].T
            f += w["bo"][c][:, None]
            f -= f.max(0)
            slot, k = items[at] - c * WIDTH, every[: at.stop - at.start]
            score[at] += f[slot, k]
            np.exp(f, out=f)
            sums = f.sum(0)
            score[at] -= np.log(sums)
            if grads is not None:
                f /= sums
                f[slot, k] -= 1
                grads["wo"][c] += (f @ s[at]).T
                grads["bo"][c] += f.sum(1)
                slope[at] += (w["wo"][c] @ f).T
        found, back = np.empty_like(score), None
        found[order] = score
        if grads is not None:  # slopes of the mean
            for k in ("wc", "bc", "wo", "bo"):
                grads[k] /= len(items)
            back = np.empty_like(slope)
            back[order] = slope / len(items)
        return found, back

    def slopes(self, items: np.ndarray, targets: np.ndarray, fresh: np.ndarray, mask: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over a window by backpropagation within it, and the state it ends in."""
        w, n = self.w, UNITS
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        out, last, (before, zr, new, inner) = self.steps(items, fresh, state, keep=True)
        use = np.flatnonzero(mask.reshape(-1))
        back = np.zeros((mask.size, n), np.float32)
        _, back[use] = self.output(out.reshape(-1, n)[use], targets.reshape(-1)[use], grads)
        back = back.reshape(out.shape)
        z, r = zr[:, :, :n], zr[:, :, n:]
        by_new, by_z, by_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), inner * r * (1 - r)
        going = np.where(fresh, np.float32(0), np.float32(1))[:, :, None]
        gates, hidden = (np.empty((*items.shape, 3 * n), np.float32) for _ in range(2))
        carry = np.zeros_like(state)
        for t in range(len(items) - 1, -1, -1):
            d = back[t] + carry
            dn = d * by_new[t]
            hidden[t, :, :n] = d * by_z[t]
            hidden[t, :, n : 2 * n] = dn * by_r[t]
            hidden[t, :, 2 * n :] = dn * r[t]
            gates[t, :, 2 * n :] = dn
            carry = (d * z[t] + hidden[t] @ w["wh"].T) * going[t]
        gates[:, :, : 2 * n] = hidden[:, :, : 2 * n]
        grads["wh"] += before.reshape(-1, n).T @ hidden.reshape(-1, 3 * n)
        flat, rows = gates.reshape(-1, 3 * n), items.reshape(-1)
        grads["bx"] += flat.sum(0)
        grads["wx"] += w["embed"][rows].T @ flat
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        sorted_rows = rows[order]
        starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
        grads["embed"][sorted_rows[starts]] += np.add.reduceat((flat @ w["wx"].T)[order], starts, 0)
        return grads, last

    def fit(self, texts: list[np.ndarray], epochs: int, rate: float, streams: int = LANES) -> None:
        """Adam over windows of streams into which the texts (arrays of items) are cut; the rate falls to a tenth.

        Fewer tokens than GROUP_TOKENS make fewer streams, not shorter ones, so that they move the weights as often.
        """
        size = sum(map(len, texts))
        items, targets, fresh, mask = cut(texts, self.heads + KINDS, min(streams, max(1, size * streams // GROUP_TOKENS)))
        length, lanes = items.shape
        if not length:
            return
        # a stream that goes on within a text has the state after the window before it
        starts = np.maximum(np.arange(lanes) * length + np.arange(-WINDOW, 0)[:, None], 0)
        before = tuple(x.T.reshape(-1)[starts] for x in (items, fresh))
        first, second, step = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2)), None, 0
        first, second = first
        updates = epochs * -(-length // WINDOW)
        for _ in range(epochs):
            state = self.steps(*before, np.zeros((lanes, UNITS), np.float32), keep=True)[1]
            for at in range(0, length, WINDOW):
                part = slice(at, at + WINDOW)
                grads, state = self.slopes(items[part], targets[part], fresh[part], mask[part], state)
                step += 1
                now = rate * (1 - 0.9 * step / updates)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / max(size, 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.inputs = None

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text's classes and head tokens."""
        total = np.zeros(len(texts))
        size = sum(map(len, texts))
        lanes = sorted(deal(texts, self.heads + KINDS, int(np.clip(size // 2500, 1, SCORED))), key=lambda x: -len(x[0]))
        if not lanes:
            return total
        lengths = np.array([len(x[0]) for x in lanes])
        begins = np.cumsum(lengths) - lengths
        items, targets, fresh, own = (np.concatenate(x) for x in zip(*lanes, strict=True))
        del lanes
        state, at = np.zeros((len(lengths), UNITS), np.float32), 0
        while at < lengths[0]:
            on = int((lengths > at).sum())
            # where few streams are left, windows are longer
            steps = min(max(WINDOW, SCORED * WINDOW // 4 // on), int(lengths[0]) - at)
            place = at + np.arange(steps)[:, None]
            use = np.flatnonzero(place < lengths[:on])
            place = np.minimum(begins[:on] + place, size - 1)
            states, state, _ = self.steps(items[place], fresh[place], state[:on])
            place = place.reshape(-1)[use]
            found, _ = self.output(states.reshape(-1, UNITS)[use], targets[place].astype(np.int64))
            total += np.bincount(own[place], found.astype(np.float64), len(texts))
            at += steps
        return total


def cut(texts: list[np.ndarray], start: int, lanes: int) -> tuple[np.ndarray, ...]:
    """All texts, one after another, in up to so many streams of equal length, a window at least: inputs, targets, whether
    a text begins, whether there is a token (steps x streams of each)."""
    targets = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    size = len(targets)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    inputs, fresh = np.r_[0, targets[:-1]][:size], np.zeros(size, bool)
    begins = begins[begins < size]
    inputs[begins], fresh[begins] = start, True
    lanes = int(np.clip(size // WINDOW, 1, lanes))
    length = -(-size // lanes)
    laid = lambda x: np.ascontiguousarray(np.pad(x, (0, lanes * length - size)).reshape(lanes, length).T)
    return laid(inputs), laid(targets), laid(fresh), laid(np.ones(size, bool))


def deal(texts: list[np.ndarray], start: int, lanes: int) -> list[tuple]:
    """Deal texts to lanes of about equal length: (inputs, targets, whether a text begins, number of the text) of each."""
    heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for n in sorted(range(len(texts)), key=lambda n: -len(texts[n])):
        size, k = heapq.heappop(heap)
        own[k].append(n)
        heapq.heappush(heap, (size + len(texts[n]), k))
    out = []
    for numbers in own:
        if numbers:
            targets = np.concatenate([texts[n] for n in numbers]).astype(np.uint16)
            begins = np.cumsum([0, *(len(texts[n]) for n in numbers)])[:-1]
            inputs, fresh = np.roll(targets, 1), np.zeros(len(targets), bool)
            inputs[begins], fresh[begins] = start, True
            out.append((inputs, targets, fresh, np.repeat(np.array(numbers, np.int32), [len(texts[n]) for n in numbers])))
    return out


def _pack(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(w[k], np.float32).tobytes() for k in sorted(w))


def _unpack(blob: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(blob, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def groups_of(vocabulary: Vocabulary) -> int:
    return max(1, round(vocabulary.total / GROUP_TOKENS))


def fit_network(train: DataFrame, vocabulary: Vocabulary) -> Network:
    """Weights from one pass over all training documents (columns group, items), as the module says."""
    base = Network(vocabulary)
    blob = _pack(base.w)

    def learner(blob: bytes, rate: float, streams: int):
        def learn(key: tuple, table: pa.Table) -> pa.Table:
            texts = [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in table["items"]]
            network = Network(vocabulary, _unpack(blob, base.w))
            network.fit(texts, 1, rate, streams)
            return pa.table({"group": [key[0].as_py()], "tokens": pa.array([float(sum(map(len, texts)))]), "weights": pa.array([_pack(network.w)], pa.binary())})

        return tidy(learn)

    def average(key: tuple, table: pa.Table) -> pa.Table:
        tokens = table["tokens"].to_numpy()
        mean = np.average([np.frombuffer(x.as_buffer(), np.float32) for x in table["weights"]], axis=0, weights=tokens).astype(np.float32)
        return pa.table({"group": [key[0].as_py()], "tokens": [float(tokens.sum())], "weights": pa.array([mean.tobytes()], pa.binary())})

    schema = "group long, tokens double, weights binary"
    learned = lambda docs, rate, streams: docs.groupBy("group").applyInArrow(learner(blob, rate, streams), schema)
    warm = learned(train.where("group = 0"), RATE, LANES).collect()
    if warm:
        blob = bytes(warm[0].weights)
    if groups_of(vocabulary) > 1:
        parts = materialize(learned(train.where("group > 0"), RATE / 3, MORE_LANES), "weights")
        halves = parts.withColumn("group", F.col("group") % 64).groupBy("group").applyInArrow(average, schema)
        ends = halves.withColumn("group", F.floor(F.col("group") / 64)).groupBy("group").applyInArrow(average, schema).collect()
        if ends:
            blob = bytes(ends[0].weights)
    return Network(vocabulary, _unpack(blob, base.w))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    A null or empty text is the closing token alone. Rows repeated with one id are scored each. Rows without id are
    training rows. With no training rows all tokens are unknown. Other columns are ignored; an empty docs gives no rows.
    """
    arrow_batches(docs.sparkSession, 500)
    rows = _source(docs, id_col, text_col).withColumn("held", held_out("id", modulus, remainder))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    train = rows.where("not held")
    counted = count_tokens(train.select("text"), buckets)
    vocabulary = Vocabulary(counted)
    known_counts = vocabulary
    rows = rows.withColumn("group", F.pmod(F.xxhash64("id", "text", F.lit(2)), F.lit(groups_of(vocabulary))))
    kind = docs.schema[id_col].dataType
    id_type = dict(docs.dtypes)[id_col]
    ratio = np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        arrow_id, part = to_arrow_type(kind), TaskContext.get().partitionId()
        names = ["chunk", "place", "id", "held", "group", "n_tokens", "n_known", "base", "tail", "items", "bucket", "ids", "places"]
        local, texts, ids, held, group, size, number = Local(), [], [], [], [], 0, 0

        def encoded() -> Iterator[pa.RecordBatch]:
            chunk, token = (part << 24) + number, np.array(local.ids, np.uint64)
            items, count = known_counts.items(token), known_counts.known(token)
            # log10 of c + 0.5 where known here; the tail factor's denominator belongs to the kind
            part_base = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            tail = items >= len(known_counts.head)
            part_tail = np.where(tail, part_base - np.log10(known_counts.tail)[(token & np.uint64(15)).astype(np.int64)], 0.0)
            lengths = np.array([len(x) for x in texts])
            flat, own = np.concatenate(texts), np.repeat(np.arange(len(texts)), lengths)
            by_text = lambda x: np.bincount(own, x[flat], len(texts))
            n, short = len(texts), items.astype(np.uint16)
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk)), pa.array(np.arange(n)), pa.array(ids, arrow_id), pa.array(held, pa.bool_()), pa.array(group, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(by_text((count > 0).astype(float)).astype(np.int64)), pa.array(by_text(part_base) - lengths * ratio), pa.array(by_text(part_tail)), pa.array([short[x].tobytes() for x in texts], pa.binary()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary())],
                names=names,
            )
            open_ = np.flatnonzero((count < 0)[flat])
            if len(open_):
                asked, place = token[flat[open_]], own[open_].astype(np.uint32)
                bucket = bucket_of(asked, buckets)
                at = np.argsort(bucket, kind="stable")
                asked, place, bucket = asked[at], place[at], bucket[at]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                cut = [slice(a, z) for a, z in zip(starts, [*starts[1:], len(bucket)], strict=True)]
                m = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, chunk)), none(m, pa.int64()), none(m, arrow_id), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), none(m, pa.binary()), pa.array(bucket[starts]), pa.array([asked[c].tobytes() for c in cut], pa.binary()), pa.array([place[c].tobytes() for c in cut], pa.binary())],
                    names=names,
                )

        for b in batches:
            for i, text, h, g in zip(b.column("id").to_pylist(), b.column("text"), b.column("held").to_pylist(), b.column("group").to_pylist(), strict=True):
                texts.append(local.tokens(text.as_py()))
                ids.append(i)
                held.append(h)
                group.append(g)
                size += len(texts[-1])
                if size >= CHUNK:
                    yield from encoded()
                    local, texts, ids, held, group, size, number = Local(), [], [], [], [], 0, number + 1
        if texts:
            yield from encoded()

    schema = f"chunk long, place long, id {id_type}, held boolean, group long, n_tokens long, n_known long, base double, tail double, items binary, bucket long, ids binary, places binary"
    first = materialize(rows.mapInArrow(tidy(chunks), schema), "encoded-chunks")
    network = fit_network(first.where("place is not null and not held").select("group", "items"), vocabulary)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, size = [], [], 0

        def judged() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            score = network.score(texts) / np.log(10) + table["tail"].to_numpy()
            return table.drop_columns(["tail", "items"]).append_column("score", pa.array(score)).combine_chunks().to_batches()[0]

        for b in batches:
            begin = 0
            for n, x in enumerate(b.column("items"), 1):
                texts.append(np.frombuffer(x.as_buffer(), np.uint16))
                size += len(texts[-1])
                if size >= CHUNK:
                    parts.append(b.slice(begin, n - begin))
                    yield judged()
                    parts, texts, size, begin = [], [], 0, n
            if begin < len(b):
                parts.append(b.slice(begin))
        if texts:
            yield judged()

    left = first.where("place is not null").select("chunk", "place", "id", "held", "n_tokens", "n_known", "base", "tail", "items")
    texts = materialize(left.mapInArrow(tidy(judge), f"chunk long, place long, id {id_type}, held boolean, n_tokens long, n_known long, base double, score double"), "scored")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of log10(c + 0.5) and numbers of known tokens by chunk and place, for a bucket's open occurrences."""
        out = {"chunk": [], "places": [], "sums": [], "known": []}
        if len(left):
            ids = np.frombuffer(right["ids"][0].as_buffer(), np.uint64) if len(right) else np.zeros(0, np.uint64)
            counts = np.frombuffer(right["counts"][0].as_buffer(), np.int64) if len(right) else np.zeros(0, np.int64)
            for chunk, asked, place in zip(left["chunk"].to_pylist(), left["ids"], left["places"], strict=True):
                asked, place = np.frombuffer(asked.as_buffer(), np.uint64), np.frombuffer(place.as_buffer(), np.uint32)
                c = np.zeros(len(asked), np.int64)
                if len(ids):
                    at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                    c = np.where(ids[at] == asked, counts[at], 0)
                used, inverse = np.unique(place, return_inverse=True)
                out["chunk"].append(chunk)
                out["places"].append(used.tobytes())
                out["sums"].append(np.bincount(inverse, np.log10(c + 0.5), len(used)).tobytes())
                out["known"].append(np.bincount(inverse, c > 0, len(used)).tobytes())
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("places", "sums", "known")}})

    asked = first.where("bucket is not null").select("bucket", "chunk", "ids", "places")
    answered = asked.groupBy("bucket").cogroup(counted.select("bucket", "ids", "counts").groupBy("bucket")).applyInArrow(tidy(answer), "chunk long, places binary, sums binary, known binary")

    def complete(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left.select(["id", "held", "n_tokens", "n_known", "base", "score"])
        more, known = np.zeros(len(left)), np.zeros(len(left))
        row = np.empty(len(left), np.int64)
        row[left["place"].to_numpy()] = np.arange(len(left))
        for places, sums, n in zip(right["places"], right["sums"], right["known"], strict=True):
            at = row[np.frombuffer(places.as_buffer(), np.uint32).astype(np.int64)]
            more[at] += np.frombuffer(sums.as_buffer(), np.float64)
            known[at] += np.frombuffer(n.as_buffer(), np.float64)
        out = left.select(["id", "held", "n_tokens"])
        out = out.append_column("n_known", pa.array(left["n_known"].to_numpy() + known.astype(np.int64)))
        return out.append_column("base", pa.array(left["base"].to_numpy() + more)).append_column("score", pa.array(left["score"].to_numpy() + more))

    out = texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(tidy(complete), f"id {id_type}, held boolean, n_tokens long, n_known long, base double, score double")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
