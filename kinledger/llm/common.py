"""Shared plumbing of the training-data operators: scratch tables, inputs, hashes, joins on hot keys."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.session import ship
from kinledger.sources import scratch

#: One word, as every contract of this subpackage reads it.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path in the folder that driver and executors share, deleted when the driver ends."""
    ship(spark)
    return scratch.path(spark, label)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it cuts the lineage,
    and a lost executor costs no recomputation of what stands before it."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 0 by 5; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), JVM-side: gaps are shrunk, then counted."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


#: Rows that are broadcast, or written into a plan, at most.
FEW = 10_000


def few(df: DataFrame, n: int) -> DataFrame:
    """``df`` of n rows, marked for broadcast if they are few; else Spark chooses the join."""
    return F.broadcast(df) if n <= FEW else df


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of Python values: few of them are a literal of the plan itself."""
    import json

    if len(rows) > FEW:
        return spark.createDataFrame(rows, schema)
    kind = f"array<struct<{schema}>>"
    one = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r"))
    return one.select("r.*")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with a number after it where ``df`` has such a column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        out.append(next(n for n in itertools.chain([name], (f"{name}_{k}" for k in itertools.count())) if n.lower() not in taken))
        taken.add(out[-1].lower())
    return out


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame) -> Column:
    """Hash of a whole row; rows that share it, their id and their text hash are taken for equal rows."""
    return F.xxhash64(*[F.col(f"`{f.name}`") if _hashable(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema.fields])


#: Rows of one key that a task joins at about the most.
HOT = 100_000


def join_hot(rows: DataFrame, named: DataFrame, key: str, how: str = "inner", most: int = HOT) -> DataFrame:
    """rows (a written table) joined with ``named`` (one row a key) by ``key``, a key of over ``most`` rows in several tasks.

    Such keys, of which there are fewer than rows / ``most``, are counted beforehand and broadcast.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("deals"))
    deals, deal = F.coalesce("deals", F.lit(1)), "deal"
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), key, "left").withColumn(deal, F.pmod("row", deals).cast("int")).drop("deals", "row")
    copies = named.join(F.broadcast(hot), key, "left").withColumn(deal, F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return dealt.join(copies, [key, deal], how).drop(deal)
