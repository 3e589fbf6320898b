"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import inspect
import sys
from collections.abc import Callable
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.session import BROADCAST_ROWS, materialize, shared_path, sized

__all__ = ["BROADCAST_ROWS", "WORD", "arrow_batches", "ascii_lower", "held_out", "materialize", "most_frequent", "per_worker", "plainly", "read_table", "release", "shared_path", "sized", "text_or_empty", "tidy", "without_ids"]

T = TypeVar("T")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but the six ASCII blanks. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of one byte per character take the vectorised path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo modulus; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be very long: hold the rows of an Arrow batch down, so that a Python worker's memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose id_col is not in ids (one column); null ids match null ids."""
    gone = sized(ids.toDF("__gone"))
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """make(), once in the life of a Python worker: for tables that are slow to build and that every task needs."""
    held = sys.__dict__.setdefault("_faultloom_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def plainly(df: DataFrame, f: Callable[..., DataFrame], **columns: str) -> DataFrame:
    """f(df, ...) with df's columns renamed c0, c1 ... meanwhile, so that none has a name that f uses itself.

    columns names f's arguments that are columns of df. f returns rows with df's columns, in their order.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    return f(df.toDF(*names), **{k: names[df.columns.index(c)] for k, c in columns.items()}).toDF(*df.columns)


def most_frequent(counts: DataFrame, key: str, count: str, most: int) -> tuple:
    """Keys (longs) and counts of the most frequent keys as arrays, at most most of them, most frequent first.

    A histogram of the counts (16 bins an octave) gives the bin from which on they are few enough, so that only those
    rows move, however many tasks there are.
    """
    place = F.floor(F.log2(F.col(count).cast("double")) * 16)
    bins = sorted(counts.groupBy(place.alias("bin")).count().collect(), key=lambda r: -r[0])
    least, total = None, 0
    for bin_, size in bins:
        total += size
        if total > most:
            break
        least = bin_
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.where(place >= least).select(key, count).toArrow()
    keys, sizes = table[0].to_numpy(), table[1].to_numpy()
    order = np.lexsort((keys, -sizes))
    return keys[order], sizes[order]


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(f: Callable) -> Callable:
    """f (a function of mapInArrow or applyInArrow), followed by release()."""

    def batches(*args):
        try:
            yield from f(*args)
        finally:
            release()

    def group(*args):
        try:
            return f(*args)
        finally:
            release()

    if inspect.isgeneratorfunction(f):
        return batches
    if len(inspect.signature(f).parameters) == 3:
        return lambda key, left, right: group(key, left, right)
    return lambda first, second: group(first, second)
