"""Near duplicates: documents whose shingle sets have a Jaccard similarity of THRESHOLD or more, and their components.

Multiple-global-order prefix filtering (the kernels are in prefixes.py). A pair is a candidate when it shares enough
prefix shingles under every one of several global orders; only candidates have their sets moved and intersected.

1. Every text is shingled: size, 128-bit key, least shingles under HUBS orders, fingerprints of the prefixes under the
   further orders, and counts of the shingles that a task sees twice. Equal sets are one class and take part once.
2. Hubs: all classes with the same least shingle are paired with one of them. That joins most classes of large groups
   of near copies into components by as many pairs as there are classes.
3. Index: each class lists its prefix under the first order, in which frequent shingles come last, with its component.
   Lists that lie in one component propose nothing; others propose the pairs of different components whose sizes and
   ranks allow the threshold. A pair has its first common shingle in one list only.
4. Proposed pairs must share prefix shingles under the further orders too: each bucket's pairs meet the fingerprints of
   their classes there, one row a class. Each component's likeliest pair with another one is intersected, ROUNDS times,
   and then all pairs that are still between components.

No link between components is lost, and pairs within a component aren't counted out unless all links are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches, materialize, most_frequent, plainly, sized, tidy, without_ids
from .components import components
from .prefixes import ORDERS, STORED, Chunk, Lists, Order, agree, common, differing, fingerprints, need, parity, prefix_size, spare
from .shingles import Powers, scramble, set_key, shingle_set

#: Similarity threshold as a fraction.
THRESHOLD = (3, 4)

#: Seeds of the orders whose least shingles bring groups together.
HUBS = (11, 12, 13, 14)

#: Rounds of one pair for each component, before all pairs that are left between components.
ROUNDS = 2

#: At most FREQUENT shingles are known as frequent (12 bytes each, broadcast); those in fewer than RARE sets aren't.
FREQUENT, RARE = 1 << 18, 16

#: Shingles that are counted together in a task, and entries of the index that make a bucket.
CHUNK, BUCKET = 4_000_000, 400_000

#: Entries of one shingle that stay in one bucket; a shingle with more is dealt to blocks of a part against a part.
HOT = 500_000

#: Classes of a component that are compared with as many others in a task, and cells of a table of their shingles.
BLOCK, CELLS = 2048, 8_000_000

#: Copies of a component's least id, among which its classes are dealt.
SALTS = 16


def halves(key: bytes) -> tuple[int, int]:
    """A class's 16-byte key as two longs; the first names the class where no other has it (see renamed)."""
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sig, text): sig tells rows that repeat an id apart by their texts."""
    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sig"), text.alias("text"))


def profile(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int]) -> DataFrame:
    """Rows of two kinds, in one pass over the texts.

    (id, sig, n, node, check, hub0 ..., prefixes, parity) of every row of docs, and (token, count) of shingles that a chunk of
    distinct sets holds twice.
    """
    hubs = [f"hub{k}" for k in range(len(HUBS))]
    types = {"n": pa.int64(), "node": pa.int64(), "check": pa.int64(), **{h: pa.int64() for h in hubs}, "prefixes": pa.binary(), "parity": pa.binary(), "token": pa.int64(), "count": pa.int64()}
    kind = docs.schema[id_col].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk, seen, held = Powers(), [], set(), 0
        every = {"id": to_arrow_type(kind), "sig": pa.int64(), **types}

        def batch(rows: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(rows, t)) for k, t in every.items()], names=list(every))

        def counted() -> pa.RecordBatch:
            tokens = np.concatenate(chunk) if chunk else np.zeros(0, np.uint64)
            tokens.sort()
            tokens, counts = np.unique(tokens[1:][tokens[1:] == tokens[:-1]], return_counts=True)
            return batch(len(tokens), {"token": pa.array(tokens.view(np.int64)), "count": pa.array(counts + 1)})

        for b in batches:
            rows: dict[str, list] = {k: [] for k in types if k not in ("token", "count")}
            for text in b.column("text"):
                s = shingle_set(text.as_py(), known)
                key = set_key(s)
                values = [len(s), *halves(key), *(int(scramble(s, h).min().view(np.int64)) if len(s) else None for h in HUBS), fingerprints(s, threshold) if len(s) else None, parity(s) if len(s) else None]
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)
                if len(s) and key not in seen:
                    seen.add(key)
                    chunk.append(s)
                    held += len(s)
                    if held >= CHUNK:
                        yield counted()
                        chunk, seen, held = [], set(), 0
            yield batch(len(b), {"id": b.column("id"), "sig": b.column("sig"), **{k: pa.array(v, types[k]) for k, v in rows.items()}})
        yield counted()

    names = {pa.int64(): "long", pa.binary(): "binary"}
    schema = f"id {dict(docs.dtypes)[id_col]}, sig long, " + ", ".join(f"`{k}` {names[t]}" for k, t in types.items())
    return materialize(_source(docs, id_col, text_col).mapInArrow(tidy(measure), schema), "profile")


def renamed(rows: DataFrame, classes: DataFrame) -> dict[tuple[int, int], int]:
    """New names of classes whose first half-key another class has too: some n^2 / 2^65 of n classes."""
    clash = classes.where("low <> high").select("node")
    out: dict[tuple[int, int], int] = {}
    if clash.isEmpty():
        return out
    for node, check in rows.join(F.broadcast(clash), "node", "left_semi").select("node", "check").distinct().toLocalIterator():
        out[node, check] = int(scramble(np.array([check], np.int64).view(np.uint64), 23).view(np.int64)[0])
    new = rows.sparkSession.createDataFrame([(v,) for v in out.values()], "node long")
    if len(set(out.values())) < len(out) or not classes.join(F.broadcast(new), "node", "left_semi").isEmpty():
        raise ValueError("a new name of a class is taken; change the seed of set_key")
    return out


def frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, sorted by shingle: FREQUENT of them at most."""
    sums = found.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(f"count >= {RARE}")
    tokens, counts = most_frequent(materialize(sums, "token-counts"), "token", "count", FREQUENT)
    tokens = tokens.view(np.uint64)
    at = np.argsort(tokens)
    return tokens[at], counts[at]


def index(source: DataFrame, buckets: int, often: tuple[np.ndarray, np.ndarray], names: dict, threshold: tuple[int, int]) -> DataFrame:
    """One row per chunk and bucket from (text, component): what the chunk's classes list there, packed in arrays."""
    hot = {int(t): int(-(-c // HOT)) for t, c in zip(*often, strict=True) if c > HOT}

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order, chunk = Powers(), Order(ORDERS[0], *often), Chunk(buckets, hot)
        for b in batches:
            for text, component in zip(b.column("text"), b.column("component").to_pylist(), strict=True):
                s = shingle_set(text.as_py(), known)
                if not len(s):
                    continue
                key = halves(set_key(s))
                chunk.add(names.get(key, key[0]), component, len(s), order.first(s, prefix_size(len(s), threshold)))
                if chunk.held >= CHUNK // 4 or len(chunk.nodes) >= 60_000:
                    yield chunk.packed()
        if chunk.nodes:
            yield chunk.packed()

    return source.select("text", "component").mapInArrow(tidy(entries), "bucket long, " + ", ".join(f"{k} binary" for k in STORED))


#: A bucket's classes, sorted, its pairs as places among them, and how many shingles more each pair may differ in.
PACKED = "bucket long, nodes binary, pairs binary, slack binary"


def packed(bucket: int, nodes: np.ndarray, pairs: np.ndarray, slack: np.ndarray) -> pa.Table:
    """One row of PACKED, with the nodes that have a pair; none without pairs."""
    used, places = np.unique(pairs, return_inverse=True)
    arrays = {"nodes": nodes[used], "pairs": places.astype(np.uint32), "slack": slack.astype(np.uint32)}
    return pa.table({"bucket": pa.array([bucket], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}}).slice(0, int(len(pairs) > 0))


def unpacked(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, pairs, slack) of a row of PACKED."""
    nodes, pairs, slack = (np.frombuffer(row[k][0].as_buffer(), t) for k, t in (("nodes", np.int64), ("pairs", np.uint32), ("slack", np.uint32)))
    return nodes, pairs.reshape(-1, 2).astype(np.int64), slack.astype(np.int64)


def propose(entries: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """One row per bucket: its classes of proposed pairs (nodes, packed) and the pairs as places among them.

    Pairs are of different components and distinct in a bucket; one that two buckets propose is intersected twice at most.
    """

    def of_bucket(key: tuple, table: pa.Table) -> pa.Table:
        nodes, pairs = Lists(table, threshold).proposed()
        return packed(key[0].as_py(), nodes, pairs, np.zeros(len(pairs)))

    return materialize(entries.groupBy("bucket").applyInArrow(tidy(of_bucket), PACKED), "proposals")


def members(proposals: DataFrame) -> DataFrame:
    """(bucket, node) of the classes in proposed pairs."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, nodes in zip(b.column("bucket").to_pylist(), b.column("nodes"), strict=True):
                own = np.frombuffer(nodes.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket)), pa.array(own)], names=["bucket", "node"])

    return materialize(proposals.select("bucket", "nodes").mapInArrow(explode, "bucket long, node long"), "members")


def marks(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """(node, n, columns) of some classes."""
    some = rows.join(sized(nodes), "node", "left_semi")
    return some.groupBy("node").agg(F.min("n").alias("n"), *(F.first(c).alias(c) for c in columns))


def narrowed(near: DataFrame, rows: DataFrame, column: str, passes: Callable, label: str) -> DataFrame:
    """The pairs of a PACKED table that passes(sizes, values of the column, pairs, slack) leaves with a slack of 0 or more."""
    inside = members(near)
    known = inside.join(marks(rows, inside.select("node").distinct(), column), "node").select("bucket", "node", "n", column)

    def of_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left
        nodes, pairs, slack = unpacked(left)
        row = np.argsort(right["node"].to_numpy())
        if not np.array_equal(right["node"].to_numpy()[row], nodes):
            raise ValueError(f"a proposed class has no {column}")
        slack = passes(right["n"].to_numpy()[row], [right[column][int(k)].as_buffer() for k in row], pairs, slack)
        keep = slack >= 0
        return packed(left["bucket"][0].as_py(), nodes, pairs[keep], slack[keep])

    return materialize(near.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(tidy(of_bucket), PACKED), label)


def filtered(proposals: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The proposed pairs whose parities allow the threshold, and that agree under the further orders too.

    Parities are small, so they go to all proposals; prefixes only to those that are left.
    """

    def allowed_by_parity(sizes: np.ndarray, values: list, pairs: np.ndarray, slack: np.ndarray) -> np.ndarray:
        return spare(sizes, [np.frombuffer(v, np.uint8) for v in values], pairs, threshold)

    def allowed_by_orders(sizes: np.ndarray, values: list, pairs: np.ndarray, slack: np.ndarray) -> np.ndarray:
        n, x, seen = sizes.tolist(), [np.frombuffer(v, np.uint16) for v in values], np.zeros(1 << 16, bool)
        return np.where([agree(x[a], x[b], n[a], n[b], threshold, seen) for a, b in pairs.tolist()], slack, -1)

    return narrowed(narrowed(proposals, rows, "parity", allowed_by_parity, "allowed"), rows, "prefixes", allowed_by_orders, "candidates")


def between(near: DataFrame, inside: DataFrame, labels: DataFrame, best: bool) -> DataFrame:
    """Distinct pairs (a < b) of a table of filtered() that are in different components: all, or each component's likeliest in a bucket."""
    known = inside.join(sized(labels), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))

    def of_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, nodes = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        if len(left):
            nodes, pairs, slack = unpacked(left)
            component = right["component"].to_numpy()[np.argsort(right["node"].to_numpy())]
            open_ = component[pairs[:, 0]] != component[pairs[:, 1]]
            pairs, slack = pairs[open_], slack[open_]
            if best:
                side = component[pairs.T.reshape(-1)]
                order = np.lexsort((np.tile(-slack, 2), side))
                first = order[np.r_[True, side[order][1:] != side[order][:-1]][: len(order)]]
                pairs = pairs[np.unique(first % max(len(pairs), 1))]
        a, b = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return near.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(tidy(of_bucket), "a long, b long").distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def joined(pairs: DataFrame, values: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pairs (a, b) with the sizes n, m of both classes and columns of both, renamed, those of b with the ending _b."""
    left = values.select(F.col("node").alias("a"), "n", *(F.col(c).alias(k) for c, k in columns.items()))
    right = values.select(F.col("node").alias("b"), F.col("n").alias("m"), *(F.col(c).alias(f"{k}_b") for c, k in columns.items()))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def _chosen(batches: Iterator[pa.RecordBatch], columns: dict[str, type], passes: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows for which passes(n, m, and the arrays of both classes, column by column)."""
    for batch in batches:
        sizes = zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True)
        arrays = [([x.as_buffer() for x in batch.column(c)], t) for k, t in columns.items() for c in (k, f"{k}_b")]
        keep = [i for i, (n, m) in enumerate(sizes) if passes(n, m, *(np.frombuffer(x[i], t) for x, t in arrays))]
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def allowed(pairs: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of hubs that agree under the further orders, and whose parities allow the threshold."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, bool)

        def passes(n: int, m: int, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
            return differing(p, q) <= n + m - 2 * int(need(n, m, threshold)) and agree(x, y, n, m, threshold, seen)

        yield from _chosen(batches, {"x": np.uint16, "p": np.uint8}, passes)

    known = marks(rows, ends(pairs), "prefixes", "parity")
    return materialize(joined(pairs, known, {"prefixes": "x", "parity": "p"}).mapInArrow(tidy(passing), "a long, b long"), "hub-candidates")


def shingle_sets(source: DataFrame, wanted: DataFrame, names: dict, label: str) -> DataFrame:
    """(node, n, shingles) of the wanted rows (id, sig) of (id, sig, text); shingles are 8 bytes each, in order."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Powers()
        for b in batches:
            found = [s for s in (shingle_set(t.as_py(), known) for t in b.column("text")) if len(s)]
            keys = [halves(set_key(s)) for s in found]
            columns = [pa.array([names.get(k, k[0]) for k in keys], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "shingles"])

    once = source.join(sized(wanted), ["id", "sig"], "left_semi").select("text")
    return materialize(once.mapInArrow(tidy(of_rows), "node long, n long, shingles binary").groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), label)


def intersect(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], label: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar, materialised."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chosen(batches, {"x": np.uint64}, lambda n, m, x, y: common(x, y) >= need(n, m, threshold))

    return materialize(joined(pairs, sets, {"shingles": "x"}).mapInArrow(tidy(similar), "a long, b long"), f"links-{label}")


def hub_pairs(classes: DataFrame, hubs: list[str], threshold: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a < b) of each class with one class of each of its hubs, where their sizes allow the threshold."""
    lists = classes.select("node", "n", F.explode(F.array(*hubs)).alias("hub"))
    heads = lists.groupBy("hub").agg(F.min(F.struct(F.xxhash64("node"), "node", "n")).alias("one"), F.count("*").alias("classes"))
    heads = heads.where("classes > 1").select("hub", F.col("one.node").alias("head"), F.col("one.n").alias("size"))
    a, b = threshold
    close = (F.col("n") * b >= F.col("size") * a) & (F.col("size") * b >= F.col("n") * a)
    pairs = lists.join(heads, "hub").where((F.col("node") != F.col("head")) & close)
    return materialize(pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "hub-pairs")


def similar_counts(sets: list[np.ndarray], own: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """How many others each set is similar to: all of them, or those of the other side where own has two sides."""
    lengths = np.array([len(s) for s in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[inverse]], place[inverse[shared[inverse]]]
    at = np.argsort(column, kind="stable")
    row, column = row[at], column[at]
    left = np.flatnonzero(own == own.min())
    right = np.flatnonzero(own == own.max())
    both, width = np.zeros((len(left), len(right)), np.float32), max(64, CELLS // len(sets))
    for start in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, (start, start + width))
        x = np.zeros((len(sets), min(width, int(shared.sum()) - start)), np.float32)
        x[row[a:z], column[a:z] - start] = 1
        both += x[left] @ x[right].T
    similar = both >= need(lengths[left][:, None], lengths[right][None], threshold)
    out = np.zeros(len(sets), np.int64)
    if own.min() == own.max():
        np.fill_diagonal(similar, False)
    else:
        out[right] = similar.sum(0)
    out[left] = similar.sum(1)
    return out


def link_counts(labels: DataFrame, links: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(node, n_links): the number of all classes that each class of a component is similar to, materialised.

    Links never leave a component. Where the verified links (a, b) are all pairs of a component they are its links; all
    pairs of the other components are intersected, in blocks of some BLOCK classes against each other.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("classes"))
    found = links.join(labels, links["a"] == labels["node"]).groupBy("component").agg(F.count("*").alias("found"))
    sizes = materialize(sizes.join(found, "component"), "component-sizes")
    full = F.col("found") * 2 >= F.col("classes") * (F.col("classes") - 1)
    known = labels.join(sized(sizes.where(full)), "component").select("node", (F.col("classes") - 1).alias("n_links"))
    blocks = F.ceil(F.col("classes") / BLOCK).cast("long")
    open_ = labels.join(sized(sizes.where(~full).withColumn("blocks", blocks)), "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = materialize(dealt.join(sets.select("node", "n"), "node"), "blocks")
    total = dealt.agg(F.sum("n")).first()[0]
    if not total:
        return materialize(known, "link-counts")
    groups = -(-total // CHUNK)

    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        node, own, n = (table[c].to_numpy() for c in ("node", "own", "n"))
        names = np.stack([table[c].to_numpy() for c in ("component", "i", "j")], 1)
        at = np.lexsort((node, *names.T))
        fresh = np.r_[True, (names[at][1:] != names[at][:-1]).any(1) | (node[at][1:] != node[at][:-1])]
        at = at[fresh]  # repeated rows of docs have their set once
        ends = np.flatnonzero(np.r_[True, (names[at][1:] != names[at][:-1]).any(1), True])
        packed, counts = table["shingles"].combine_chunks(), np.zeros(len(at), np.int64)
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            some = at[a:z]
            if names[some[0], 1] == names[some[0], 2] or len(np.unique(own[some])) == 2:
                counts[a:z] = similar_counts([np.frombuffer(packed[int(k)].as_buffer(), np.uint64) for k in some], own[some], threshold)
        return pa.table({"node": node[at], "n_links": counts})

    joined = dealt.drop("n").join(sets.select("node", "n", "shingles"), "node").withColumn("group", F.pmod(F.xxhash64("component", "i", "j"), F.lit(groups)))
    counted = joined.groupBy("group").applyInArrow(tidy(of_group), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return materialize(known.unionByName(counted), "link-counts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, all_links: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (least id with an equal set), component_id; with all_links n_links.

    n_links is the exact number of links of the row's class with other classes. A text of fewer than
    five words is one shingle; empty and null texts have none and are linked with nothing. Rows without an id take no
    part in links and have component_id null; rows that repeat an id are told apart by their texts, and a repeated row
    is linked as one. Ties need no rule: components don't depend on an order. Columns other than id_col and text_col
    are ignored, whatever their names; an empty docs gives no rows. Very long texts are shingled in segments; a text's
    set (8 bytes a shingle) is held whole.
    """
    arrow_batches(docs.sparkSession)
    hubs = [f"hub{k}" for k in range(len(HUBS))]
    found = profile(docs, id_col, text_col, threshold)
    rows = found.where("token is null").drop("token", "count")

    def classes_of(rows: DataFrame) -> DataFrame:
        told = [F.min("id").alias("least"), F.count("*").alias("rows"), F.min("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")]
        return materialize(rows.where("n > 0 and id is not null").groupBy("node").agg(*told, *(F.min(h).alias(h) for h in hubs)), "classes")

    classes = classes_of(rows)
    names = renamed(rows.where("n > 0"), classes)
    if names:
        new = [F.when((F.col("node") == node) & (F.col("check") == check), F.lit(name)) for (node, check), name in names.items()]
        rows = rows.withColumn("node", F.coalesce(*new, "node"))
        classes = classes_of(rows)
    taking = rows.where("n > 0 and id is not null")
    source = _source(docs, id_col, text_col)
    first = taking.select("id", "sig", "node")

    def wanted(nodes: DataFrame) -> DataFrame:
        """(id, sig) of the rows that stand for some classes."""
        some = materialize(classes.join(sized(nodes), "node", "left_semi").select("node", "least"), "some")
        return first.join(sized(some), "node").where("id = least").select("id", "sig")

    near = allowed(hub_pairs(classes, hubs, threshold), taking, threshold)
    sets = shingle_sets(source, wanted(ends(near)), names, "hub-sets")
    links = intersect(near, sets, threshold, "hubs")
    labels = materialize(components(links), "labels")

    often = frequent(found)
    copies = materialize(first.join(sized(classes.where("rows > 1").select("node", "least")), "node").where("id <> least").select("id", "sig"), "copies")
    named = materialize(first.join(sized(labels), "node").select("id", "sig", "component").distinct(), "named")
    single = source.where("id is not null").join(sized(copies), ["id", "sig"], "left_anti").join(sized(named), ["id", "sig"], "left")
    total = classes.agg(F.sum("n")).first()[0] or 0
    proposals = propose(index(single, max(1, -(-total // (4 * BUCKET))), often, names, threshold), threshold)
    near = filtered(proposals, taking, threshold)
    inside = members(near)
    missing = inside.select("node").distinct().join(sized(sets.select("node")), "node", "left_anti")
    sets = sets.unionByName(shingle_sets(source, wanted(materialize(missing, "missing")), names, "index-sets"))
    for k in range(ROUNDS + 1):
        fresh = intersect(between(near, inside, labels, k < ROUNDS), sets, threshold, f"index-{k}")
        links = links.unionByName(fresh)
        labels = materialize(components(labels.toDF("a", "b").unionByName(fresh)), "labels")

    least = classes.join(sized(labels), "node").select("node", "least", "component")
    lowest = least.groupBy("component").agg(F.min("least").alias("lowest"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = least.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    known = dealt.join(sized(materialize(lowest.select("component", "lowest", salts), "lowest")), ["component", "salt"]).select("node", "lowest")
    by_class = classes.select("node", "least").join(sized(materialize(known, "components")), "node", "left")
    if all_links:
        by_class = by_class.join(sized(link_counts(labels, links, sets, threshold)), "node", "left")
    out = rows.drop(*hubs, "prefixes", "parity").join(by_class, (rows["node"] == by_class["node"]) & (rows["n"] > 0) & rows["id"].isNotNull(), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "id").alias("class_id"),
        F.coalesce("lowest", "least", "id").alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if all_links else []),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each component: that of the least id. Rows without id, and empty texts, all stay.

    Where the least id itself is repeated, one of its rows stays (any: they are in one component). Columns are those of
    docs, whatever their names; an empty docs gives no rows.
    """
    return plainly(docs, lambda df, id_col, text_col: _drop_near_copies(df, id_col, text_col, threshold), id_col=id_col, text_col=text_col)


def _drop_near_copies(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int]) -> DataFrame:
    said = near_duplicates(docs, id_col, text_col, threshold).toDF("__i", "__n", "__class", "__component")
    said = materialize(said.select("__i", "__component"), "said")
    out = without_ids(docs, said.where("__i <> __component").select("__i").distinct(), id_col)
    again = materialize(said.where("__i = __component").groupBy("__i").count().where("count > 1").select("__i"), "repeated")
    if again.isEmpty():
        return out
    repeated = out.join(again, F.col(id_col) == F.col("__i"), "left_semi")
    return without_ids(out, again, id_col).unionByName(repeated.dropDuplicates([id_col]))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, s FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
shared AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 75 * (n + m - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a),
least AS (SELECT x, min(y) AS lowest FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS class_id, coalesce(l.lowest, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN least l ON l.x = c.c
"""
