"""Plain computations that operators are held against."""

from collections import defaultdict
from zlib import crc32

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return text.translate(_LOWER)


def tokens(text):
    out = [""]
    for c in lower(text or ""):
        if c in BLANKS:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def shingle_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = tokens(t)
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


def components(rows):
    """(id, size of the set, least id reachable) of every row, over all pairs."""
    sets = shingle_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def targets(sizes):
    """Reshare the excess until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        share = {s: (left - sum(out[f] for f in full)) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            full.add(s)
            out[s] = 3.0 * sizes[s]


def checked(rows, texts, tokenizer, copies=None):
    """Every id of every document in one piece (copies: so often); sequences gapless; returns the padding's share."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for r in pieces[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
        covered = np.zeros(len(ids) + 1, int)
        for r in pieces[i]:
            covered[r.start] += 1
            covered[r.start + r.length] -= 1
        assert (np.cumsum(covered)[:-1] == (copies[i] if copies else 1)).all()
    total = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 1024
        total += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded / (total + padded)
