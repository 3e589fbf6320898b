import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents: exact and near copies, case variants, nulls, empties, one long text, repeats of a passage."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(8):
        t = base[k].split()
        for copy in range(3):
            u = list(t)
            for _ in range(max(1, len(u) // 40)):
                u[rng.randrange(len(u))] = words(rng, 1)
            rows.append((100 + 10 * k + copy, " ".join(u)))
    rows += [(300 + i, base[9]) for i in range(5)] + [(310, base[9].upper()), (320, "ÀÉ x"), (321, "àé x"), (330, None), (331, ""), (332, " \t\n"), (333, "one two"), (334, "One\ttwo"), (340, words(rng, 9000))]
    passage = words(rng, 60)
    rows += [(400 + i, passage + " " + words(rng, rng.randint(0, 40))) for i in range(14)]
    return [(i, t, "en", ["a", "b", None, "Z", "é"][i % 5], None if t is None or i % 7 == 0 else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and extra columns whose names are those that operators use themselves."""
    rows = [(None, "some text of a few words here", 1, 2.0, "x"), (5, "some text of a few words here", 1, 2.0, "x"), (5, "some text of a few words here", 1, 2.0, "x"), (5, "another text under the same id", 1, None, None), (None, None, None, None, None), (7, "", 1, 1.0, "y"), (7, "", 1, 1.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, score double, source string").selectExpr("*", *[f"id as {c}" for c in "key kept n node least predicted component own size copies __id __i __gone __digest __x __words c0 k0 meta label".split()], "source as lang", "cast(null as long) as n_chars")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
