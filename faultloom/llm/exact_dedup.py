"""Exact duplicates with a heavy-hitter split (DataFrame and SQL functions only).

A Misra-Gries summary (Spark's approx_top_k sketch is one: counters that are purged by decrementing) is built per input
partition and merged through a two-level tree. Every digest held by more than 1 / (0.75 * TRACKED) of the rows is among
its candidates. The candidates are verified by exact counts; the winners, CANDIDATES rows at most, are broadcast, so the
rows of hot groups are settled on the map side. All other digests go through an ordinary aggregation and join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, plainly, text_or_empty, without_ids

#: Counters of the summary, and how many of its heaviest digests are verified and broadcast (some 60 bytes each).
TRACKED, CANDIDATES = 4096, 1024

#: Sketches that one task of the first merge level reads are those of every MERGE-th partition.
MERGE = 64


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __row (distinct for every row) and __digest (32 bytes) of every row, written once to the shared folder."""
    text = ascii_lower(text_or_empty(text_col))
    return materialize(
        df.select(F.col(id_col).alias("__id"), F.unhex(F.sha2(text, 256)).alias("__digest")).withColumn("__row", F.monotonically_increasing_id()),
        "digests",
    )


def heavy_hitters(rows: DataFrame, key: str = "__digest") -> DataFrame:
    """Candidate keys of the Misra-Gries summary, CANDIDATES rows at most."""
    sketch = F.expr(f"approx_top_k_accumulate(hex({key}), {TRACKED})")
    level0 = rows.groupBy((F.spark_partition_id() % MERGE).alias("__g")).agg(sketch.alias("__s"))
    # A key, though one: without it, empty partitions would send empty sketches, which the merge refuses.
    level1 = level0.groupBy(F.floor(F.col("__g") / MERGE).alias("__g")).agg(F.expr(f"approx_top_k_combine(__s, {TRACKED})").alias("__s"))
    top = level1.select(F.explode(F.expr(f"approx_top_k_estimate(__s, {CANDIDATES})")).alias("__t"))
    return top.where("__t.count > 1").select(F.unhex("__t.item").alias(key))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal each other. The
    row with the largest id stays; null ids come last. If a row is repeated with the same id and text, exactly one of
    the repeats has kept = true. Other columns of df are ignored, whatever their names; an empty df gives no rows.
    """
    rows = digests(df, id_col, text_col)
    summary = [F.count("*").alias("__n"), F.max(F.struct("__id", "__row")).alias("__keep")]
    hot = heavy_hitters(rows)
    winners = materialize(rows.join(F.broadcast(hot), "__digest", "left_semi").groupBy("__digest").agg(*summary), "winners")
    tagged = rows.join(F.broadcast(winners), "__digest", "left")
    rest = tagged.where("__n is null").select("__digest", "__id", "__row")
    cold = rest.join(rest.groupBy("__digest").agg(*summary), "__digest")
    every = tagged.where("__n is not null").unionByName(cold)
    return every.select(
        F.col("__id").alias(id_col),
        F.col("__keep.__id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__keep.__row")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that decide() keeps, with all their columns.

    The ids to drop are broadcast if they are few (BROADCAST_ROWS), else joined by a shuffle. Rows that share their id
    with another row are settled by (id, digest), so a repeated row stays once. Null and empty texts are one group; an
    empty df gives no rows. Columns may have any names.
    """
    return plainly(df, _drop_copies, id_col=id_col, text_col=text_col)


def _drop_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    said = materialize(decide(df, id_col, text_col).select(F.col(id_col).alias("__i"), "kept", F.unhex("text_sha256").alias("__d")), "decisions")
    by_id = said.groupBy("__i").agg(F.count("*").alias("__n"), F.max("kept").alias("__any"))
    out = without_ids(df, by_id.where("not __any or __n > 1").select("__i"), id_col)
    shared = materialize(by_id.where("__any and __n > 1").select("__i"), "shared-ids")
    if shared.isEmpty():
        return out
    keep = said.where("kept").join(shared.toDF("__s"), F.col("__i").eqNullSafe(F.col("__s")), "left_semi").select("__i", "__d")
    digest = F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)), 256))
    rows = df.withColumn("__digest", digest).join(keep, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")))
    once = rows.groupBy("__i", "__d").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__one"))
    return out.unionByName(once.select("__one.*"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
