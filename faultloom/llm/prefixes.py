"""Prefix filters on sets of 64-bit shingles, in numpy: global orders, prefixes, and the lists of an inverted index.

Two sets of n and m shingles are similar when they share need(n, m) of them at least. Then, under every order of all
shingles and for every l, they share l shingles among the first n - need + l of the one and m - need + l of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import scramble

#: Seeds of the global orders: the first builds the index, the others must agree before a pair's sets are moved.
ORDERS = (101, 202, 303)

#: Most shingles that a pair must share in its prefixes under each further order.
LEVEL = 32

#: Pairs of entries that are looked at together.
STEP = 1_000_000

#: An entry of a list that is not dealt over several buckets; others are on side 0 or 1 of a block.
WHOLE = 2


def need(n, m, threshold: tuple[int, int]):
    """Least intersection of sets of n and m shingles that are similar."""
    a, b = threshold
    return -(-a * (n + m) // (a + b))


def prefix_size(n: int, threshold: tuple[int, int]) -> int:
    """Shingles of a set of n among which the first common one with any similar set must be."""
    return n - -(-threshold[0] * n // threshold[1]) + 1


class Order:
    """Ranks shingles: rare ones by a hash of the seed, then frequent ones by count."""

    def __init__(self, seed: int, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.seed, self.tokens, self.counts = seed, tokens, counts
        self.maybe = np.zeros(1 << 22, bool)  # by the leading bits: most shingles need no search
        self.maybe[tokens >> np.uint64(42)] = True

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        out = scramble(shingles, self.seed) >> np.uint64(1)
        some = np.flatnonzero(self.maybe[shingles >> np.uint64(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.tokens, shingles[some]), len(self.tokens) - 1)
            found = self.tokens[at] == shingles[some]
            often, at = some[found], at[found]
            count = np.minimum(self.counts[at], (1 << 30) - 1).astype(np.uint64)
            out[often] = (np.uint64(1) << np.uint64(63)) | (count << np.uint64(33)) | (out[often] >> np.uint64(30))
        return out

    def first(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """The first size shingles, in order."""
        keys = self.keys(shingles)
        if size < len(keys):
            part = np.argpartition(keys, size - 1)[:size]
            return shingles[part[np.argsort(keys[part], kind="stable")]]
        return shingles[np.argsort(keys, kind="stable")]


def level(n: int) -> int:
    """Shingles that a set of n must share in its prefix under each further order, if its partner asks for no fewer."""
    return 1 + min(n // 8, LEVEL)


def fingerprints(shingles: np.ndarray, threshold: tuple[int, int]) -> bytes:
    """16 bits of each shingle of the prefixes under all orders but the first, one prefix after the other."""
    n, out = len(shingles), []
    size = min(n, prefix_size(n, threshold) + level(n) - 1)
    for seed in ORDERS[1:]:
        keys = scramble(shingles, seed)
        out.append(np.sort(np.partition(keys, size - 1)[:size]).astype(np.uint16).tobytes())
    return b"".join(out)


def agree(x: np.ndarray, y: np.ndarray, n: int, m: int, threshold: tuple[int, int], seen: np.ndarray) -> bool:
    """Whether fingerprints x and y of sets of n and m shingles share enough under every further order.

    Equal shingles have equal fingerprints and each is counted, so a similar pair always agrees. seen: 2^16 False.
    """
    least = int(need(n, m, threshold))
    if least > min(n, m):
        return False
    shared = min(level(n), level(m), least)
    for a, b in zip(x.reshape(len(ORDERS) - 1, -1), y.reshape(len(ORDERS) - 1, -1), strict=True):
        a = a[: n - least + shared]
        seen[a] = True
        common = np.count_nonzero(seen[b[: m - least + shared]])
        seen[a] = False
        if common < shared:
            return False
    return True


def parity(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2^k >= 2 n slots: sets that differ in d shingles differ in d bits at most."""
    size = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    slots = (shingles >> np.uint64(8) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=size) & 1).astype(np.uint8)).tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parities differ; the longer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def spare(sizes: np.ndarray, parities: list[np.ndarray], pairs: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """How many shingles more each pair of places may differ in, by its parities: negative if it can't be similar."""
    n, m = sizes[pairs[:, 0]], sizes[pairs[:, 1]]
    out = n + m - 2 * need(n, m, threshold)
    widths = np.array([len(p) for p in parities])
    shorter = np.minimum(widths[pairs[:, 0]], widths[pairs[:, 1]])
    for width in np.unique(shorter):
        some = np.flatnonzero(widths >= width)
        place = np.zeros(len(parities), np.int64)
        place[some] = np.arange(len(some))
        folded = np.stack([np.bitwise_xor.reduce(parities[k].reshape(-1, width), 0) for k in some]).view(np.uint64)
        at = np.flatnonzero(shorter == width)
        for part in np.array_split(at, -(-len(at) * int(width) // (64 << 20)) or 1):
            out[part] -= np.bitwise_count(folded[place[pairs[part, 0]]] ^ folded[place[pairs[part, 1]]]).sum(1).astype(np.int64)
    return out


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))


#: Columns of the index and their numpy types: what a chunk of classes has in a bucket. component and labelled are sparse.
STORED = {
    "nodes": np.int64, "sizes": np.uint32, "labelled": np.uint16, "components": np.int64,
    "tokens": np.uint64, "own": np.uint16, "ranks": np.uint32, "before": np.uint64, "sides": np.uint8,
}


class Chunk:
    """Classes whose prefix entries are dealt to buckets together."""

    def __init__(self, buckets: int, hot: dict[int, int]) -> None:
        self.buckets = buckets
        self.hot = np.array(sorted(hot), np.uint64)
        self.splits = np.array([hot[t] for t in sorted(hot)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.nodes, self.components, self.sizes, self.prefixes, self.held = [], [], [], [], 0

    def add(self, node: int, component: int | None, size: int, prefix: np.ndarray) -> None:
        self.nodes.append(node)
        self.components.append(node if component is None else component)
        self.sizes.append(size)
        self.prefixes.append(prefix)
        self.held += len(prefix)

    def dealt(self, token: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(entry, list, side) of every copy of an entry; entries of hot shingles go to all blocks of their group."""
        entry, side = np.arange(len(token)), np.full(len(token), WHOLE, np.uint8)
        if not len(self.hot):
            return entry, token, side
        at = np.minimum(np.searchsorted(self.hot, token), len(self.hot) - 1)
        splits = np.where(self.hot[at] == token, self.splits[at], 1)
        entry = np.repeat(entry, splits)
        other = np.arange(len(entry)) - np.repeat(np.cumsum(splits) - splits, splits)
        group = (scramble(nodes.view(np.uint64), 21)[own[entry]] % splits[entry].astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(group, other), np.maximum(group, other)
        side = np.where(group == other, WHOLE, group > other).astype(np.uint8)
        block = (low * (1 << 20) + high + 1).astype(np.uint64)
        return entry, np.where(splits[entry] > 1, scramble(token[entry] ^ scramble(block)), token[entry]), side

    def packed(self) -> pa.RecordBatch:
        """One row per bucket, and an empty chunk."""
        token = np.concatenate(self.prefixes)
        lengths = np.array([len(p) for p in self.prefixes])
        own = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        before = np.where(rank > 0, np.r_[np.uint64(0), token[:-1]], np.uint64(0))
        nodes, components = np.array(self.nodes, np.int64), np.array(self.components, np.int64)
        sizes = np.array(self.sizes, np.uint32)
        entry, names, side = self.dealt(token, own, nodes)
        bucket = (scramble(names, 9) % np.uint64(self.buckets)).astype(np.int64)
        at = np.argsort(bucket, kind="stable")
        bucket, entry, names, side = bucket[at], entry[at], names[at], side[at]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows: dict[str, list] = {"bucket": [], **{k: [] for k in STORED}}
        for a, z in zip(starts, [*starts[1:], len(bucket)], strict=True):
            some = entry[a:z]
            used, inverse = np.unique(own[some], return_inverse=True)
            labelled = np.flatnonzero(components[used] != nodes[used])
            values = (nodes[used], sizes[used], labelled, components[used][labelled], names[a:z], inverse, rank[some], before[some], side[a:z])
            rows["bucket"].append(int(bucket[a]))
            for (k, t), v in zip(STORED.items(), values, strict=True):
                rows[k].append(v.astype(t).tobytes())
        self.clear()
        types = {"bucket": pa.int64(), **{k: pa.binary() for k in STORED}}
        return pa.RecordBatch.from_arrays([pa.array(rows[k], types[k]) for k in types], names=list(types))


class Lists:
    """A bucket's lists: the classes that share a shingle, where they come from different components."""

    def __init__(self, table: pa.Table, threshold: tuple[int, int]) -> None:
        self.threshold = threshold
        part = {k: [np.frombuffer(x.as_buffer(), t) for x in table[k]] for k, t in STORED.items()}
        base = np.cumsum([0, *map(len, part["nodes"])])
        shifted = lambda k: np.concatenate([x.astype(np.int64) + base[i] for i, x in enumerate(part[k])])
        every = np.concatenate(part["nodes"])
        component = every.copy()
        component[shifted("labelled")] = np.concatenate(part["components"])
        self.nodes, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        self.sizes = np.concatenate(part["sizes"]).astype(np.int64)[first]
        self.components = component[first]
        own = inverse[shifted("own")]
        token, rank, before, side = (np.concatenate(part[k]) for k in ("tokens", "ranks", "before", "sides"))
        at = np.lexsort((own, self.sizes[own], token))
        once = np.r_[True, (token[at][1:] != token[at][:-1]) | (own[at][1:] != own[at][:-1])]
        at = at[once[: len(at)]]  # a repeated row is in a list once
        self._keep(token[at], own[at], rank[at].astype(np.int64), before[at], side[at])

    def _keep(self, token: np.ndarray, own: np.ndarray, rank: np.ndarray, before: np.ndarray, side: np.ndarray) -> None:
        """Keep the lists that hold two components or more; they are in order of size."""
        new = np.r_[True, token[1:] != token[:-1]][: len(token)]
        which = np.cumsum(new) - 1
        component = self.components[own]
        mixed = np.zeros(len(token), bool)
        mixed[which[1:][~new[1:] & (component[1:] != component[:-1])]] = True
        some = mixed[which]
        self.member, self.rank, self.before, self.side = own[some], rank[some], before[some], side[some]
        self.which = np.unique(which[some], return_inverse=True)[1]

    def minor(self) -> np.ndarray:
        """Entries that are not of their list's largest component: every pair between components has one."""
        component = self.components[self.member]
        at = np.lexsort((component, self.which))
        new = np.r_[True, (self.which[at][1:] != self.which[at][:-1]) | (component[at][1:] != component[at][:-1])]
        starts = np.flatnonzero(new)
        lengths = np.diff(np.r_[starts, len(at)])
        by_list = self.which[at][starts]
        best = np.lexsort((-lengths, by_list))
        best = best[np.r_[True, by_list[best][1:] != by_list[best][:-1]]]
        major = np.zeros(len(starts), bool)
        major[best] = True
        out = np.ones(len(at), bool)
        out[at] = ~np.repeat(major, lengths)
        return out

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether entries x and y of one list may be the first shingle that two similar sets of different components share.

        If the shingles just before them are equal too, another list has the first one, and proposes the pair.
        """
        a, b = self.member[x], self.member[y]
        n, m = self.sizes[a], self.sizes[b]
        out = need(n, m, self.threshold) <= np.minimum(n - self.rank[x], m - self.rank[y])
        out &= self.components[a] != self.components[b]
        out &= (self.before[x] != self.before[y]) | (self.rank[x] == 0) | (self.rank[y] == 0)
        return out & ((self.side[x] != self.side[y]) | (self.side[x] == WHOLE))

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries x of minor components, each with all entries y of its list whose sizes x's size and rank allow."""
        minor = self.minor()
        x = np.flatnonzero(minor)
        a, b = self.threshold
        n, rank = self.sizes[self.member], self.rank
        width = int(n.max()) + 2
        place = self.which * width + n  # sorted: by list, then by size
        low = np.searchsorted(place, self.which[x] * width + -(-a * n[x] // b))
        most = np.clip((a + b) * (n[x] - rank[x]) // a - n[x], 0, width - 1)
        count = np.maximum(np.searchsorted(place, self.which[x] * width + most, side="right") - low, 0)
        ends = np.cumsum(count)
        start = 0
        while start < len(x):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, side="right")))
            some = count[start:stop]
            left = np.repeat(x[start:stop], some)
            right = np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[start:stop], some)
            once = (right > left) | ~minor[right]
            yield left[once], right[once]
            start = stop

    def proposed(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes, sorted, and distinct pairs of places among them (columns a < b) that may be similar."""
        size, out, held = len(self.nodes), [np.zeros(0, np.int64)], 0
        for x, y in self.places() if len(self.member) else ():
            ok = self.possible(x, y)
            a, b = self.member[x[ok]], self.member[y[ok]]
            out.append(np.minimum(a, b) * size + np.maximum(a, b))
            held += len(a)
            if held > STEP:
                out = [np.unique(np.concatenate(out))]
                held = len(out[0]) // 2
        every = np.unique(np.concatenate(out))
        pairs = np.stack([every // size, every % size], 1)
        used, places = np.unique(pairs, return_inverse=True)
        return self.nodes[used], places.reshape(-1, 2)
