"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned that bring centred unit vectors near the corners of a cube, so that the signs
of their coordinates make balanced binary codes. Codes are cut into parts, one table each; codes
meet that agree in a part. A part has as many bits as the number of vectors has, so a bucket holds
about one stranger whatever the size of the table, and there are as many tables as let a pair at
the least cosine meet with probability ``RECALL``. What meets is compared by ``CHECKED`` bits of the
codes, then by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from martwright.llm.tables import components, keep, lookup

COSINE = 0.9
RECALL = 0.97
#: Least bits of a part; bits that are compared whole.
LEAST_PART, CHECKED = 16, 128


def layout(n: int, cosine: float) -> tuple[int, int, int]:
    """(bits of a part, number of parts, most checked bits apart) for ``n`` vectors.

    The signs of two vectors differ in a coordinate with a probability of their angle over pi. A
    pair at the limit lies within the last figure but for six standard deviations.
    """
    flip = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    part = max(LEAST_PART, math.ceil(math.log2(max(n, 2))))
    same = min((1 - flip) ** part, 1 - 1e-12)
    parts = max(CHECKED // part, math.ceil(math.log(1 - RECALL) / math.log(1 - same)))
    apart = CHECKED * flip + 6 * math.sqrt(CHECKED * flip * (1 - flip))
    return part, parts, min(CHECKED, math.ceil(apart))


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 7):
    """(mean, projection): alternates between the nearest corners and the rotation that is nearest
    to them (an orthogonal Procrustes problem). Vectors of fewer dimensions than ``bits`` get
    several random rotations to start from, side by side."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    dims = centred.shape[1]
    rng = np.random.default_rng(seed)
    blocks, left = [], bits
    # Of the dims x dims moments; a full decomposition of the sample would be sample x sample.
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    while left > 0:
        width = min(dims, left)
        base = axes[:, :width]
        flat = centred @ base
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(rounds):
            corners = np.where(flat @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ flat)
            rotation = (u @ v).T
        blocks.append(base @ rotation)
        left -= width
    return mean, np.concatenate(blocks, axis=1)


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors; each is first divided by its largest component, so that no square runs out of
    the range of numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dims).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    """Only finite components, and some that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0.0), F.lit(False)
    )


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
    sample: int = 20_000,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; a link is a cosine of ``cosine`` or more.

    The rotations are learned on at most ``sample`` vectors of a length, those with the smallest
    hashes; every vector is indexed. Vectors are compared with others of their length; a vector
    that is null, empty, zero or holds null or non-finite components links with nothing. Equal
    vectors (by two 64-bit hashes) are one while searching and link with each other. A component is
    named by its smallest id. Rows that share an id are vectors of their own. Null ids are larger
    than any; a row with one has the component of its vector.
    """
    x = F.col(vector).cast("array<double>")
    wide = rows.select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
    # Zeros of either sign are one number.
    plain = wide.withColumn("x", F.when(_usable(F.col("x")), F.transform("x", lambda v: v + F.lit(0.0))))
    keyed = plain.withColumns({"k": F.xxhash64("x"), "l": F.xxhash64(F.lit(1), "x")})
    distinct = keep(
        keyed.where(F.col("x").isNotNull()).groupBy("k", "l")
        .agg(F.first("x").alias("x"), F.min("id").alias("least"), F.count("*").alias("m"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    links = keep(_links(distinct, cosine, sample), "links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    brief = distinct.select("node", "k", "l", "least", "m")
    linked = both.join(brief.select(F.col("node").alias("b"), F.col("m").alias("copies")), "b")
    linked = linked.groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    member = components(links.select("a", "b")).join(brief.select("node", "least"), "node")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = lookup(
        keep(member.select("node", "component"), "members"),
        named.join(member.groupBy("component").agg(F.count("*").alias("n")), "component"),
        ["component"], "n",
    )
    placed = brief.join(linked, "node", "left").join(member.drop("component"), "node", "left").select(
        "k", "l", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"), "m",
    )
    usable = F.col("x").isNotNull()
    ids = keep(keyed.select("id", usable.alias("usable"), "k", "l"), "ids")
    nothing = F.lit(None).cast("long")
    found = lookup(ids.where("usable"), placed, ["k", "l"], "m").unionByName(
        ids.where("NOT usable").withColumns({"n_links": nothing, "component_id": nothing})
    )
    component = F.coalesce("component_id", "id")
    return found.select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.col("component_id").isNull()).alias("kept"),
    )


def _links(distinct: DataFrame, cosine: float, sample: int) -> DataFrame:
    """(a, b, cosine) of distinct vectors, by their nodes, a < b. One search for each length."""
    sizes = distinct.groupBy(F.size("x").alias("dims")).count().collect()
    found = distinct.sparkSession.createDataFrame([], "a long, b long, cosine double")
    for dims, n in sorted(sizes):
        some = distinct.where(F.size("x") == dims)
        found = found.union(_links_of(some, dims, n, cosine, sample))
    return found


def _links_of(vectors: DataFrame, dims: int, n: int, cosine: float, sample: int) -> DataFrame:
    part, parts, apart = layout(n, cosine)
    chosen = vectors.orderBy("k", "l").limit(sample).select("x").toArrow()
    matrix = _units(chosen.column("x").combine_chunks(), dims)
    mean, axes = learn_rotation(matrix, max(part * parts, CHECKED))
    powers = np.int64(1) << np.arange(part, dtype=np.int64)
    words = np.uint64(1) << np.arange(64, dtype=np.uint64)

    @arrow_udf("array<long>")
    def code_of(column: pa.Array) -> pa.Array:
        """The parts, then the checked bits as numbers of 64 bits."""
        signs = (_units(column, dims) - mean) @ axes >= 0
        keys = signs[:, : part * parts].reshape(-1, parts, part) @ powers
        whole = (signs[:, :CHECKED].reshape(-1, CHECKED // 64, 64) * words).sum(2, dtype=np.uint64)
        each = np.concatenate([keys, whole.view(np.int64)], axis=1)
        ends = np.arange(len(each) + 1, dtype=np.int32) * each.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(each.reshape(-1)))

    @arrow_udf("double")
    def cosine_of(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array((_units(left, dims) * _units(right, dims)).sum(axis=1))

    codes = keep(vectors.select("node", code_of("x").alias("code")), "codes")
    checked = [F.element_at("code", parts + 1 + i).alias(f"c{i}") for i in range(CHECKED // 64)]
    entries = codes.select(
        "node", *checked, F.posexplode(F.slice("code", 1, parts)).alias("t", "key")
    )
    left = entries.withColumnRenamed("node", "a")
    right = entries.select("t", "key", F.col("node").alias("b"),
                           *[F.col(f"c{i}").alias(f"d{i}") for i in range(CHECKED // 64)])
    bits = sum((F.bit_count(F.col(f"c{i}").bitwiseXOR(F.col(f"d{i}")))
                for i in range(CHECKED // 64)), F.lit(0))
    # Near pairs meet in several tables.
    pairs = keep(
        left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (bits <= apart))
        .select("a", "b").distinct(),
        "pairs",
    )
    side = vectors.select("node", "x")
    joined = pairs.join(side.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(
        side.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b"
    )
    # Nondeterministic, so that the filter does not make Spark compute the cosine twice.
    near = cosine_of.asNondeterministic()("xa", "xb")
    scored = joined.select("a", "b", near.alias("cosine"))
    return scored.where(F.col("cosine") >= cosine)
