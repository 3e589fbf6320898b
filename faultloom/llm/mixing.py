"""Mixing sources to target weights by pivotal rounding in a reduction tree (DataFrame and SQL functions only).

Every document of a source is wanted f = target / size-of-source times. floor(f) copies are certain; the fraction is
rounded by the pivotal method: two documents with fractions a and b exchange mass, at random and without a change in
expected words, until one of the two is 0 or 1; the other goes on to the next pair. Blocks of some BLOCK documents are
folded independently, each leaves one residual document at most, and the residuals are folded in blocks again, level
by level, until a source has one. A source's words thus differ from its target by less than one document's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, plainly, sized, text_or_empty

BLOCK = 64
SEED = 20241

#: The sources' targets are joined by broadcast up to so many sources.
SOURCE_ROWS = 100_000


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """__id, __source, __size, __copy: one row per row of df; rows equal in all three are told apart by __copy."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("__size"))
    grouped = rows.groupBy("__id", "__source", "__size").agg(F.count("*").alias("__m"))
    return materialize(grouped.select("__id", "__source", "__size", F.explode(F.sequence(F.lit(1), F.col("__m").cast("int"))).alias("__copy")), "sizes")


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: __docs, source_size, target.

    Weights 1, 2, 3, repeating, go to the sources in code-point order (null last). Targets are min(3 * size, w * level)
    with the level at which they add up to all words; sorted by the level at which each source is full, the full ones
    come first, so two running sums find it.
    """
    per = rows.groupBy("__source").agg(F.count("*").alias("__docs"), F.sum("__size").alias("source_size"))
    place = Window.orderBy(F.col("__source").asc_nulls_last())
    per = per.withColumn("__w", ((F.row_number().over(place) - 1) % 3 + 1).cast("double")).withColumn("__cap", F.lit(3.0) * F.col("source_size"))
    full_at = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("__cap").over(full_at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(full_at.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("__level", (F.sum("source_size").over(everything) - before) / rest).withColumn("__pos", F.row_number().over(full_at))
    per = per.withColumn("__full", F.col("__cap") <= F.col("__level") * F.col("__w"))
    level = F.min(F.when(~F.col("__full"), F.struct("__pos", "__level"))).over(everything)
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(level["__level"] * F.col("__w"))
    return per.select("__source", "__docs", "source_size", target.alias("target"))


#: The fold of one block in Spark SQL. acc.cur is the document that still has a fraction (null: none), acc.done those
#: settled. x.up / x.down: the words that cur can gain from, or lose to, the next document before one is integral.
FOLD = """
aggregate(
  __members,
  named_struct('cur', cast(null AS struct<k:bigint,id:{id},copy:int,size:bigint,base:bigint,p:double>),
               'done', cast(array() AS array<struct<id:{id},size:bigint,copies:bigint>>)),
  (acc, b) -> if(acc.cur IS NULL, named_struct('cur', b, 'done', acc.done),
    transform(
      transform(
        transform(array(acc.cur), a -> named_struct('a', a, 'up', least(a.size * (1 - a.p), b.size * b.p), 'down', least(a.size * a.p, b.size * (1 - b.p)))),
        x -> if((pmod(xxhash64(x.a.k, b.k, {seed}), 9007199254740992) / 9007199254740992D) * (x.up + x.down) < x.down,
                named_struct('a', x.a, 'pa', if(x.a.size * (1 - x.a.p) <= x.up, 1D, x.a.p + x.up / x.a.size), 'pb', if(b.size * b.p <= x.up, 0D, b.p - x.up / b.size)),
                named_struct('a', x.a, 'pa', if(x.a.size * x.a.p <= x.down, 0D, x.a.p - x.down / x.a.size), 'pb', if(b.size * (1 - b.p) <= x.down, 1D, b.p + x.down / b.size)))),
      y -> named_struct(
        'cur', CASE WHEN y.pa > 0 AND y.pa < 1 THEN named_struct('k', y.a.k, 'id', y.a.id, 'copy', y.a.copy, 'size', y.a.size, 'base', y.a.base, 'p', y.pa)
                    WHEN y.pb > 0 AND y.pb < 1 THEN named_struct('k', b.k, 'id', b.id, 'copy', b.copy, 'size', b.size, 'base', b.base, 'p', y.pb) END,
        'done', concat(acc.done,
          if(y.pa > 0 AND y.pa < 1, array(), array(named_struct('id', y.a.id, 'size', y.a.size, 'copies', y.a.base + cast(y.pa AS bigint)))),
          if(y.pb > 0 AND y.pb < 1, array(), array(named_struct('id', b.id, 'size', b.size, 'copies', b.base + cast(y.pb AS bigint))))))
    )[0]))
"""


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: id, size, source_size, target, taken, copies, source.

    size counts words (null text: 0). A document is taken floor(f) or floor(f) + 1 times, so never over 3 times; empty
    documents floor(f) times. Sources are compared by code point, a null source is one of its own and comes last. The
    random numbers are hashes of ids, so reruns agree, whatever the partitioning. Rows that repeat with the same id,
    source and size are separate documents. Other columns are ignored; an empty df gives no rows.
    """
    rows = measured(df, id_col, text_col, source_col)
    per = materialize(targets(rows), "targets")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(F.col("__f") - F.round("__f")) < 1e-9, F.round("__f")).otherwise(F.col("__f"))
    joined = (
        rows.join(sized(per, SOURCE_ROWS), rows["__source"].eqNullSafe(per["__source"]))
        .drop(per["__source"])
        .withColumn("__f", want)
        .withColumn("__f", near)
        .withColumn("__base", F.floor("__f"))
        .withColumn("__p", F.col("__f") - F.col("__base"))
    )
    whole = (F.col("__p") == 0) | (F.col("__size") == 0)
    settled = [joined.where(whole).select("__source", "__id", "__size", F.col("__base").alias("__copies"))]
    key = F.xxhash64(F.lit(SEED), F.col("__id"), F.col("__copy"), F.col("__size"))
    member = F.struct(key.alias("k"), F.col("__id").alias("id"), F.col("__copy").alias("copy"), F.col("__size").alias("size"), F.col("__base").alias("base"), F.col("__p").alias("p"))
    open_rows = joined.where(~whole).select("__source", member.alias("__m"), F.ceil(F.col("__docs") / BLOCK).alias("__blocks"))
    id_type = df.schema[id_col].dataType.simpleString()
    widest = per.agg(F.max("__docs")).first()[0] or 0
    level, blocks = 0, -(-widest // BLOCK)
    while True:
        place = F.pmod(F.xxhash64(F.lit(SEED + 1 + level), F.col("__m.k")), F.col("__blocks"))
        folded = (
            open_rows.groupBy("__source", "__blocks", place.alias("__block"))
            .agg(F.array_sort(F.collect_list("__m")).alias("__members"))
            .select("__source", "__blocks", F.expr(FOLD.format(id=id_type, seed=SEED + 101 + level)).alias("__r"))
        )
        folded = materialize(folded, f"pivotal-{level}")
        settled.append(folded.select("__source", F.explode("__r.done").alias("__d")).select("__source", "__d.id", "__d.size", "__d.copies"))
        open_rows = folded.where("__r.cur is not null").select("__source", F.col("__r.cur").alias("__m"), F.ceil(F.col("__blocks") / BLOCK).alias("__blocks"))
        if blocks <= 1:
            break
        level, blocks = level + 1, -(-blocks // BLOCK)
    draw = F.pmod(F.xxhash64(F.col("__m.k"), F.lit(SEED + 99)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    last = open_rows.select("__source", "__m.id", "__m.size", (F.col("__m.base") + F.when(draw < F.col("__m.p"), 1).otherwise(0)).alias("copies"))
    every = settled[0].toDF("__source", "__id", "__size", "__copies")
    for part in [*settled[1:], last]:
        every = every.union(part.toDF("__source", "__id", "__size", "__copies"))
    out = every.join(sized(per, SOURCE_ROWS), every["__source"].eqNullSafe(per["__source"]))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"),
        every["__source"].alias("source"),
    )


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df with every row as often as mix() takes it, with all its columns.

    Rows with the same id, source and size share their copies evenly, the first ones (by text) get the odd ones. Null
    texts have no words and are taken as mix() says; an empty df gives no rows. Columns may have any names.
    """
    return plainly(df, _apply_mix, id_col=id_col, text_col=text_col, source_col=source_col)


def _apply_mix(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    said = mix(df, id_col, text_col, source_col).select(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
    keyed = materialize(said.groupBy("__id").agg(F.count("*").alias("__n"), F.sum("copies").alias("__c")), "copies")
    single = sized(keyed.where("__n = 1 and __c > 0").select("__id", "__c"))
    repeat = lambda rows, c: rows.withColumn("__x", F.explode(F.expr(f"array_repeat(1, cast({c} AS int))"))).select(*[F.col(f"`{x}`") for x in df.columns])
    out = repeat(df.join(single, F.col(id_col).eqNullSafe(F.col("__id"))), "__c")
    shared = materialize(keyed.where("__n > 1").select("__id"), "shared-ids")
    if shared.isEmpty():
        return out
    said = said.join(shared.toDF("__s"), F.col("__id").eqNullSafe(F.col("__s")), "left_semi").groupBy("__id", "__source", "__size").agg(F.count("*").alias("__n"), F.sum("copies").alias("__c"))
    rows = df.join(shared.toDF("__s"), F.col(id_col).eqNullSafe(F.col("__s")), "left_semi").withColumn("__words", F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"))
    rows = rows.join(said, F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    turn = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(text_col))
    rows = rows.withColumn("__k", F.floor(F.col("__c") / F.col("__n")) + F.when(turn <= F.col("__c") % F.col("__n"), 1).otherwise(0))
    return out.union(repeat(rows, "__k"))
