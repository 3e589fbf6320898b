import json
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultloom.llm import mixing, packing
from faultloom.llm.queries import tokenizer_file

from .brute import checked, targets


def test_mix(docs, corpus):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus}
    per = defaultdict(int)
    for i, _, _, s, _ in corpus:
        per[s] += size[i]
    want = targets(per)
    got = mixing.mix(docs).collect()
    assert {r.doc_id: r["size"] for r in got} == size
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in per:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_mix_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    got = mixing.mix(rows).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 50 for r in got)


def test_mix_is_unbiased(spark):
    """Each document is taken about as often as wanted, over many documents of one size."""
    rows = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "concat('s', id % 2) as source")
    got = mixing.mix(rows).groupBy("source").agg({"copies": "avg", "target": "max", "source_size": "max"}).collect()
    assert all(r["avg(copies)"] == pytest.approx(r["max(target)"] / r["max(source_size)"], abs=0.01) for r in got)


def test_mix_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


def test_pack(spark, docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    rows = packing.pack(docs, tokenizer_file()).collect()
    assert checked(rows, {i: t for i, t, *_ in corpus}, tokenizer) == 0
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.hilbert_key, r.doc_id))
    ends = sorted((min(x), max(x)) for x in by.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))  # sequences are stretches of the curve, in order
    borders = len(by) - 1
    assert len(rows) <= len(corpus) + borders


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_file())
    return packing.Tokenizer(tokenizer_file()), lambda text: slow.encode(text, add_special_tokens=False).ids


def test_tokenizer_gives_the_librarys_ids(encoders, sf_dir):
    fast, slow = encoders
    assert fast.same
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in ("", " ", "a<|endoftext|>b", "don't  stop\n\n", "ß​ü 12,5 ½\x00", "  x  \t y", "日本 語", "A" * 3000, " " * 500, *(t for t in table if t)):
        assert fast(text).tolist() == slow(text)


@given(text=st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_tokenizer_gives_the_librarys_ids_of_any_text(encoders, text):
    fast, slow = encoders
    assert fast(text).tolist() == slow(text)


def test_another_kind_of_file_goes_to_the_library(tmp_path):
    with open(tokenizer_file(), encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    lower = packing.Tokenizer(str(path))
    assert not lower.same and lower("ABC dEf").tolist() == packing.Tokenizer(tokenizer_file())("abc def").tolist()


def test_pack_odd_rows(odd, none):
    got = packing.pack(odd, tokenizer_file()).collect()
    assert sum(r.length for r in got if r.start + r.length == r.doc_tokens) > 0
    assert sum(r.start == 0 for r in got) == odd.count()
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_hilbert_steps_to_neighbours():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, bits)
    assert sorted(keys) == list(range(1 << 3 * bits))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_stream_cuts_at_every_width_and_ends_in_powers_of_two():
    rng = np.random.default_rng(1)
    for sizes in ([1], [1024], [3000], [5, 5, 5], [1023, 1, 1], rng.integers(1, 900, 40).tolist()):
        stream, out, docs = packing.Stream(7), [], [rng.integers(0, 50_000, n).astype("<u4") for n in sizes]
        for k, ids in enumerate(docs):
            out += stream.add(k, ids)
        out += stream.finish()
        whole = np.concatenate(docs)
        at, lengths = 0, defaultdict(int)
        for doc, start, length, crc, sequence, offset in out:
            ids = docs[doc][start : start + length]
            assert (ids == whole[at : at + length]).all() and crc == crc32(ids.tobytes()) and offset == lengths[sequence]
            at += length
            lengths[sequence] += length
        assert at == len(whole) and min(lengths) == 7
        widths = list(lengths.values())
        assert all(w == 1024 for w in widths[: at // 1024]) and sorted(widths[at // 1024 :]) == [1 << b for b in range(10) if at % 1024 >> b & 1]


def test_pack_a_very_long_text(spark):
    text = "".join(f"word{k} " for k in range(60_000))
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), tokenizer_file()).collect()
    total = next(r.doc_tokens for r in rows if r.doc_id == 1)
    assert sum(r.length for r in rows if r.doc_id == 1) == total > 100_000
