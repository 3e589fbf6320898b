import gzip
import hashlib
import io
import random

import numpy as np

from faultloom.llm import vamana, warc

VEC = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.5 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(3000)]
    rows += [(5000 + i, rows[7][1], 1) for i in range(60)]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0, None] * 8, 1), (9004, [1.0] * 3, 1), (None, [1.0] * 16, 1), (9100, [float("inf")] * 16, 1)]
    return rows


def test_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vamana, "SHARD", 1000)
    rows = vectors()
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in vamana.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and i < 9000]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    assert got.keys() == {i for i in ids if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        distance[ids == q] = np.inf
        best = np.lexsort((ids, distance))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [v for _, v, _ in found]
        assert all(abs(s - distance[ids == v][0]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(ids[best].tolist()))
    assert hits / (10 * len(got)) > 0.95
    copies = [v for _, v, _ in sorted(got[5000])]
    assert copies == [7, *range(5001, 5010)]


def test_ties_of_different_vectors_go_to_smaller_ids(spark):
    """40 unit vectors at right angles are all equally far from each other."""
    rows = [(i, [1.0 if k == i else 0.0 for k in range(41)], 1) for i in range(1, 41)]
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in vamana.neighbours(df, df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [i for i in range(1, 41) if i != q][:10] for q in range(1, 41)}


def test_queries_of_another_length_have_no_answers(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(1, 9)], VEC)
    queries = spark.createDataFrame([(100, [1.0, 2.0, 3.0], 0), (101, [1.0, 2.0, 3.0], 0), (102, [1.0, 1.0], 0)], VEC)
    assert {r.query_id for r in vamana.neighbours(df, queries).collect()} == {102}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (100, [1.0, 1.0], 0)], VEC)
    got = [(r.query_id, r.rank, r.vec_id) for r in vamana.neighbours(df, df.where("vec_id = 100")).collect()]
    assert sorted(got) == [(100, 1, 1), (100, 2, 2)]
    assert vamana.neighbours(df.limit(0), df).count() == 0 and vamana.neighbours(df, df.limit(0)).count() == 0


def pages():
    rng = random.Random(8)
    body = "<html>" + "é" * 60 + "</html>"
    rows = [(i, f"http://x/{i}", "<p>" + "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 400)))) for i in range(50)]
    return rows + [(100 + i, "http://x/ y\r\nz", body) for i in range(5)] + [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", body), (300, "u", "WARC/1.1\r\n\r\n" * 30), (301, "u", "x" * 3_000_000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as path", "2 as records")
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    want = []
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != i and sum((x or "").encode() == b for _, _, x in rows) > 1
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_come_back_and_members_stand_alone(spark):
    df = spark.createDataFrame(pages()[:20], "page_id long, url string, html string")
    normalised = warc.normalise(warc.write_archives(df))
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(normalised).collect()} == {i: h for i, _, h in pages()[:20]}


def test_normaliser_reads_any_gzip_layout():
    records = [warc.page_record(i, "u", b"p" * (i * 1000), "0" * 64, None, True) for i in range(40)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(map(gzip.compress, records))
    for archive in (whole, members):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise_stream(io.BytesIO(archive), out, index) == 40
        for line, record in zip(index.getvalue().splitlines(), records, strict=True):
            offset, size, *_ = line.split(b"\t")
            assert gzip.decompress(out.getvalue()[int(offset) : int(offset) + int(size)]) == record
