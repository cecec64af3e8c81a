"""Substring search by posting lists of three-character pieces."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 3
#: Pieces of a pattern whose lists are read: its rarest. The comparison sees to the others.
READ = 4
ROWS_PER_PART = 250_000
#: Characters whose pieces one task of a build cuts, makes distinct and sorts.
TASK_CHARS = 250_000


def any_like(columns: Sequence[str], pattern: str) -> Column:
    return reduce(or_, [F.col(c).ilike(pattern) for c in columns])


def pieces_of(spark: SparkSession, pattern: str) -> list[str]:
    """The distinct pieces that every match of a LIKE pattern holds, folded as ILIKE folds it.

    Wildcards cut the pattern; a backslash takes the character after it as it is.
    """
    folded = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    runs = [""]
    for plain, escaped in re.findall(r"([^\\])|\\(.)", folded, re.DOTALL):
        if plain in ("%", "_"):
            runs.append("")
        else:
            runs[-1] += plain or escaped
    return sorted({run[i : i + SIZE] for run in runs for i in range(len(run) - SIZE + 1)})


class SearchIndex:
    """Rows dealt to parts by their key, and for every piece of their texts the keys that hold it.

    A search reads the lists of a pattern's rarest pieces, then only the parts that hold one of the
    keys, and compares those rows with the pattern itself. A pattern without a piece of three
    characters compares all rows. Keys may be null or repeat: all rows of a key are compared.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, columns: Sequence[str]):
        self.spark, self.folder, self.key, self.columns = spark, folder, key, list(columns)

    @classmethod
    def build(
        cls, rows: DataFrame, key: str, columns: Sequence[str], folder: str,
        rows_per_part: int = ROWS_PER_PART,
    ) -> SearchIndex:
        """Write the index into a new folder. The columns ``part`` and ``piece`` are its own."""
        spark = rows.sparkSession
        long = reduce(add, [F.coalesce(F.length(c), F.lit(0)) for c in columns])
        size = rows.agg(F.count("*").alias("rows"), F.sum(long).alias("chars")).first()
        parts = size["rows"] // rows_per_part + 1
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
        (
            rows.withColumn("part", part).hint("rebalance", "part")
            .write.partitionBy("part").parquet(f"{folder}/rows")
        )
        # An empty table leaves no part, so its columns are kept apart.
        rows.limit(0).write.parquet(f"{folder}/columns")
        texts = [F.coalesce(F.lower(f"text{i}"), F.lit("")) for i in range(len(columns))]
        every = F.concat(*[F.regexp_extract_all(t, F.lit("(?s)(?=(...))"), 1) for t in texts])
        # A few characters a task, however large the files that the rows come from; in each a key
        # that repeats is reduced before it meets its like.
        tasks = (size["chars"] or 0) // TASK_CHARS + 1
        dealt = rows.select(F.col(key).alias("key"), part, *[F.col(c).alias(f"text{i}") for i, c in
                                                             enumerate(columns)])
        dealt = dealt.withColumn("task", (F.rand(1) * tasks).cast("int")).repartition(tasks, "task")
        held = dealt.select("task", "key", "part", F.explode(F.array_distinct(every)).alias("piece"))
        # Ranges of piece and key: a piece that very many keys hold is spread over files.
        (
            held.distinct().drop("task")
            .repartitionByRange(tasks, "piece", "key").distinct()
            .sortWithinPartitions("piece", "key")
            .write.parquet(f"{folder}/postings")
        )
        postings = spark.read.parquet(f"{folder}/postings")
        (
            postings.groupBy("piece").count().repartitionByRange("piece")
            .sortWithinPartitions("piece").write.parquet(f"{folder}/pieces")
        )
        return cls(spark, folder, key, columns)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def candidates(self, pattern: str) -> DataFrame | None:
        """(key, part) of all keys that may match, or None where the pattern has no piece."""
        pieces = pieces_of(self.spark, pattern)
        if not pieces:
            return None
        sizes = self._read("pieces").where(F.col("piece").isin(pieces)).collect()
        postings = self._read("postings")
        if len(sizes) < len(pieces):
            return postings.select("key", "part").limit(0)
        rarest = [r["piece"] for r in sorted(sizes, key=lambda r: (r["count"], r["piece"]))[:READ]]
        return (
            postings.where(F.col("piece").isin(rarest)).groupBy("key", "part").count()
            .where(F.col("count") == len(rarest)).select("key", "part")
        )

    def find(self, pattern: str) -> DataFrame:
        """The rows of which a column matches the pattern, as ILIKE on all rows would give them.

        The driver gets the numbers of the parts that hold a candidate, one for ``rows_per_part``
        rows at most.
        """
        kinds = self._read("columns").schema.add("part", T.IntegerType())
        rows = self.spark.read.schema(kinds).parquet(f"{self.folder}/rows")
        found = self.candidates(pattern)
        if found is not None:
            parts = [r["part"] for r in found.select("part").distinct().collect()]
            rows = rows.where(F.col("part").isin(parts))
            rows = rows.join(found, F.col(self.key).eqNullSafe(F.col("key")), "left_semi")
        return rows.where(any_like(self.columns, pattern)).drop("part")
