"""Intermediate tables in the shared folder, and groups of linked nodes."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.operators.workdir import new_folder


def keep(df: DataFrame, label: str, *by: str, codec: str | None = None) -> DataFrame:
    """Compute once, as a Parquet table in the shared folder; the lineage ends there.

    ``by``: columns whose values have folders of their own. ``codec``: other than the session's.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.partitionBy(*by).parquet(path, compression=codec)
    kept = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[kept] = path
    return kept


#: Where the tables of ``keep`` are.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``keep`` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: A key counts as hot when it has more than one in so many of the rows.
HOT_SHARE = 4096


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` left-joined with ``found``, whatever the skew of the keys (none of them null).

    ``found`` has one row a key; ``weight`` says how many of the rows have it and is dropped. Keys
    with at least one in ``HOT_SHARE`` of all weight, so at most that many, are broadcast; the rest
    is joined by shuffles in which no key weighs more. ``rows`` is read twice: pass a kept table.
    """
    found = keep(found, "found")
    total = found.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE >= total
    heavy = F.broadcast(found.where(hot).drop(weight))
    light = found.where(~hot).drop(weight)
    return (
        rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, "left")
        .unionByName(rows.join(heavy, keys))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, "u")
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges``: two columns of longs, in any order. Alternating stars, a logarithmic number of
    rounds; a node's smallest neighbour is found by partial sums, so that a node with very many
    edges burdens no task, and the driver sees two numbers a round.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now = keep(now.distinct(), "edges")
    seen = None
    while True:
        now = keep(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        seen = state
