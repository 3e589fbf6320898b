from collections import Counter, defaultdict

import corpus_pipeline
from faultloom.llm import quality
from faultloom.llm.common import read_table
from faultloom.llm.queries import tokenizer_file

from .brute import checked, components, lower, targets, tokens


def test_stages_match_brute_force(spark, sf_dir):
    """Each stage on all that its predecessor kept, held against a plain computation over the same rows."""
    from tokenizers import Tokenizer

    docs = read_table(spark, sf_dir, "documents")
    columns, types = docs.columns, docs.dtypes
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    before = docs.collect()

    def stage(k):
        nonlocal docs, before
        out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
        assert out.columns == columns and out.dtypes == types
        rows = out.collect()
        docs, before, old = spark.createDataFrame(rows, docs.schema), rows, before
        return old, rows

    old, kept = stage(0)
    encoder = quality.Encoder()
    good = {r.doc_id for r in old if model.score([model.inputs(*encoder(None if r.text is None else r.text.encode(), r.n_chars))])[0] >= 0.7}
    assert {r.doc_id for r in kept} == good and 0 < len(kept) < len(old)

    old, kept = stage(1)
    groups = defaultdict(list)
    for r in old:
        groups[lower(r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(max(g) for g in groups.values())

    old, kept = stage(2)
    assert {r.doc_id for r in kept} == {c for _, _, c in components([(r.doc_id, r.text) for r in old])} and len(kept) == len({r.doc_id for r in kept})

    old, kept = stage(3)
    copies = Counter(r.doc_id for r in kept)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in old}
    size = {r.doc_id: len(tokens(r.text)) for r in old}
    of, taken, largest = {r.doc_id: r.source for r in old}, Counter(), Counter()
    total = Counter()
    for i, n in size.items():
        total[of[i]] += n
        taken[of[i]] += n * copies[i]
        largest[of[i]] = max(largest[of[i]], n)
    want = targets(total)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in total)

    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == copies
    assert checked(pieces, {r.doc_id: r.text for r in kept}, Tokenizer.from_file(tokenizer_file()), copies) == 0


def test_stages_on_odd_rows(spark, odd, sf_dir):
    """Null ids, repeated rows, and extra columns with the names that operators use: all stages run, columns stay."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        docs = spark.createDataFrame(docs.collect(), odd.schema)
        assert all(r.n == r.least == r.predicted == r.id for r in docs.collect())
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).where("start = 0").count() == docs.count()
    model = quality.Model(quality.np.zeros((quality.STATS, quality.BINS - 1)))
    good = quality.keep_good(odd, model, threshold=0.0)
    assert good.columns == odd.columns and sorted(map(str, good.collect())) == sorted(map(str, odd.collect()))


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
