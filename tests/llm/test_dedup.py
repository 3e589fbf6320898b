import hashlib
from collections import defaultdict

import pytest

from faultloom.llm import exact_dedup, jaccard, prefixes
from faultloom.llm.shingles import Powers, hashes, shingle_set

from .brute import components, lower, shingle_sets


def test_exact_groups_match_brute_force(docs, corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[lower(t or "")].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dedup.decide(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == {max(g) for g in groups.values()}


def test_exact_odd_rows(odd, none):
    got = exact_dedup.decide(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(5, "another text under the same id"), (5, "some text of a few words here"), (7, "")]
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_heavy_hitters_cover_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as text")
    hot = exact_dedup.heavy_hitters(exact_dedup.digests(rows, "id"))
    assert hashlib.sha256(b"hot").digest() in {bytes(r[0]) for r in hot.collect()}
    assert hot.count() <= exact_dedup.CANDIDATES


@pytest.mark.parametrize(("hubs", "hot", "bucket"), [((11, 12, 13, 14), 500_000, 400_000), ((11,), 2, 1000)])
def test_near_duplicates_match_brute_force(docs, corpus, monkeypatch, hubs, hot, bucket):
    """Also with few hubs, hot shingles dealt over blocks, and many buckets."""
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "RARE", 2)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    got = jaccard.near_duplicates(docs)
    want = components(corpus)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == want
    kept = {r.doc_id for r in jaccard.drop_near_copies(docs).collect()}
    assert kept == {c for _, _, c in want}


def test_classes_with_one_name_are_told_apart(docs, corpus, monkeypatch):
    real = jaccard.halves
    monkeypatch.setattr(jaccard, "halves", lambda key: (real(key)[0] % 2, real(key)[1]) if key[0] % 16 == 0 else real(key))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == components(corpus)


def test_a_list_of_many_unlinked_classes(spark):
    """5000 texts of one frequent passage and a rest of their own, 200 of them near copies of another."""
    import random

    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(5000):
        own = [f"o{i}x{k}" for k in range(24)]
        rows.append((i, " ".join(passage + own)))
        if i < 200:
            rows.append((10_000 + i, " ".join([*passage, *own[:-1], "changed"])))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_a_large_group_of_near_copies(spark):
    """3000 different texts that differ from one text in a word: one component."""
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([*base[: i % 300], f"x{i}", *base[i % 300 + 1 :]])) for i in range(3000)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize(("block", "cells"), [(2048, 8_000_000), (3, 100)])
def test_every_link_is_counted(spark, docs, corpus, monkeypatch, block, cells):
    import random

    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CELLS", cells)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    many = [(1000 + i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(40)}" for w in base)) for i in range(40)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(many, "doc_id long, text string"))
    sets = shingle_sets([(i, t) for i, t, *_ in corpus] + many)
    classes = {s for s in sets.values() if s}
    want = {i: sum(s != o and 4 * len(s & o) >= 3 * len(s | o) for o in classes) if s else 0 for i, s in sets.items()}
    got = jaccard.near_duplicates(both, all_links=True)
    assert {r.doc_id: r.n_links for r in got.collect()} == want
    assert max(want.values()) > 8


def test_near_odd_rows(odd, none):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id == r.doc_id for r in got)
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.near_duplicates(none, all_links=True).count() == 0
    assert {r.n_links for r in jaccard.near_duplicates(odd, all_links=True).collect()} == {0}
    assert jaccard.drop_near_copies(none).columns == none.columns


def test_words_are_hashed_alike_in_any_place():
    p = Powers()
    one, two = "Abc dÉf\x0bghi abc", "x ghi\tdÉf  aBC"
    a, b = hashes(one.encode(), p), hashes(two.encode(), p)
    assert a[0] == a[3] == b[3] and a[1] == b[2] and a[2] == b[1] and len(set(a.tolist()) | set(b.tolist())) == 4
    long = ("word%d " * 90000) % tuple(range(90000))
    assert len(set(hashes(long.encode(), p).tolist())) == 90000
    assert len(shingle_set(b"", p)) == 0 and len(shingle_set(b"a b", p)) == 1


def test_prefix_orders_never_lose_a_similar_pair():
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 60)
        x = set(rng.sample(range(10**9), n))
        y = set(rng.sample(sorted(x), rng.randint(0, n))) | set(rng.sample(range(10**9), rng.randint(0, 12)))
        if not y or 4 * len(x & y) < 3 * len(x | y):
            continue
        x, y = np.array(sorted(x), np.uint64), np.array(sorted(y), np.uint64)
        least = prefixes.need(len(x), len(y), (3, 4))
        order = prefixes.Order(101, x[:3], np.array([5, 4, 3]))
        a, b = (order.first(s, prefixes.prefix_size(len(s), (3, 4))).tolist() for s in (x, y))
        assert any(least <= min(len(x) - a.index(t), len(y) - b.index(t)) for t in a if t in b)
        marks = (np.frombuffer(prefixes.fingerprints(s, (3, 4)), np.uint16) for s in (x, y))
        assert prefixes.agree(*marks, len(x), len(y), (3, 4), np.zeros(1 << 16, bool))
        assert prefixes.differing(*(np.frombuffer(prefixes.parity(s), np.uint8) for s in (x, y))) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_further_orders_refuse_pairs_that_share_little():
    import numpy as np

    rng = np.random.default_rng(5)
    seen, refused = np.zeros(1 << 16, bool), 0
    for _ in range(100):
        both, x, y = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (60, 340, 340))
        marks = (np.frombuffer(prefixes.fingerprints(np.concatenate([both, s]), (3, 4)), np.uint16) for s in (x, y))
        refused += not prefixes.agree(*marks, 400, 400, (3, 4), seen)
        assert not seen.any()
    assert refused >= 99


def test_components_match_union_find(spark):
    import random

    from faultloom.llm import components as stars
    from faultloom.llm.shingles import unions

    rng = random.Random(2)
    for links in ([(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 400)], [(rng.randrange(500), rng.randrange(500)) for _ in range(300)], []):
        rng.shuffle(links)
        df = spark.createDataFrame(links, "a long, b long").repartition(7)
        got = {r.node: r.component for r in stars.components(df).collect()}
        want = {x: r for x, r in unions(links).items()}
        joined = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: want[x] for x in joined}
