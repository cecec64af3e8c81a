"""The trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

A node stands for a distinct sequence of first turns. Its identity is a sum, over the turns, of two
64-bit hashes of (turn, place); sums along a conversation are taken block by block, so that a
conversation of any length is spread over tasks, and are kept exact. Nodes are then the groups of
equal sums, found by partial aggregation.

Subtree totals come from contracting the tree in rounds. In a round leaves are raked into their
parents, and a node with one child is spliced out, its total so far added to its parent and its
child handed over, if a hash of it and the round is below those of both neighbours; so no two
neighbours go at once and about a third of the chain nodes goes. A leaf whose parent has the lower
hash waits, as the parent may go. All that nodes have to tell one another in a round are messages,
grouped by receiver with partial sums, so that a round is a single shuffle and a node with very
many children burdens no task. A tree of n nodes of any shape, a single long chain included, takes
a logarithmic number of rounds. Spliced nodes are re-expanded by doubling: the total of each is
what it had gathered plus the total of the child it handed over.

What Spark's driver holds for its plans and stages counts too: a round is a short piece of a plan
without branches, and once few nodes are left, several rounds are one job.

Rows without a conversation id belong to none and are left out. A null role or text is empty. Turns
of a conversation go by number, null first; rows that share a number go by the first 200 characters
of role and text, then by a hash of both, and equal rows are turns of their own. An empty table has
no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.tables import keep, lookup

#: Ids of one node that are joined to a piece of text before the pieces are hashed in order.
PIECE = 512

#: So many live nodes or fewer go through ``ROUNDS`` rounds in one job; what is done by then is
#: carried through the rest of them.
FEW = 1 << 17
ROUNDS = 6

_EXACT = "decimal(38,0)"


def turns_in_order(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv, blk, pos, n, token, length): every turn with its place from 0 in its conversation.

    ``n`` is the number of turns of the conversation, ``token`` a digest of role and text,
    ``length`` the code points of the text. Rows are spread by ranges of (conversation, turn);
    ``blk`` numbers the ranges, so that a conversation with very many turns has many.
    """
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.substring(F.concat(who, F.lit("\0"), said), 1, 200).alias("tie"),
        F.unhex(F.sha2(whole, 256)).alias("token"),
        F.length(said).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row"),  # splits equal rows, whose order is no matter
    )
    order = ["conv", F.asc_nulls_first("turn"), "tie", "token", "row"]
    spread = keep(
        rows.repartitionByRange(*order).withColumn("blk", F.spark_partition_id()), "turns"
    )
    inside = Window.partitionBy("conv", "blk").orderBy(*order[1:])
    along = Window.partitionBy("conv").orderBy("blk")
    blocks = (
        spread.groupBy("conv", "blk").agg(F.count("*").alias("here"))
        .select("conv", "blk", (F.sum("here").over(along) - F.col("here")).alias("skipped"),
                F.sum("here").over(Window.partitionBy("conv")).alias("n"))
    )
    placed = spread.withColumn("at", F.row_number().over(inside)).join(blocks, ["conv", "blk"])
    return placed.select(
        "conv", "blk", (F.col("skipped") + F.col("at") - 1).alias("pos"), "n", "token", "length"
    )


def rebuilt(turns: DataFrame, most: int = 5, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of the first one of their family.

    Conversation c starts with the first h turns of conversation c - c % ``family``, h being the
    CRC-32 of c's decimal digits modulo ``most + 1``, or with all that it has; its own turns after
    its first h follow. Returns (conv, size) and (conv, blk, depth, token, length).
    """
    turns = keep(turns, "placed")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = turns.groupBy("conv").agg(F.max("n").alias("n")).withColumn("h", h)
    head = convs.select(F.col("conv").alias("base"), F.col("n").alias("of_base"))
    # A base has fewer than two families of conversations, so the key is never hot.
    convs = keep(
        convs.withColumn("base", F.col("conv") - F.col("conv") % family).join(head, "base", "left")
        .withColumn("q", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))))
        .withColumn("size", F.col("q") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv", "base", "h", "q", "size"),
        "convs",
    )
    blocks = turns.select("conv", "blk").distinct().join(convs, "conv")
    own = (
        turns.join(blocks.select("conv", "blk", "h", "q"), ["conv", "blk"])
        .where(F.col("pos") >= F.col("h"))
        .select("conv", "blk", (F.col("pos") - F.col("h") + F.col("q") + 1).alias("depth"),
                "token", "length")
    )
    first = turns.where((F.col("pos") < most) & (F.col("conv") % family == 0)).select(
        F.col("conv").alias("base"), "pos", "token", "length"
    )
    lent = (
        convs.select("conv", "base", "q").join(first, "base").where(F.col("pos") < F.col("q"))
        .select("conv", F.lit(-1).alias("blk"), (F.col("pos") + 1).alias("depth"), "token", "length")
    )
    return convs.select("conv", "size"), own.unionByName(lent)


def _id(depth: Column, first: Column, second: Column) -> Column:
    parts = [c.cast("string") for c in (depth, first.cast(_EXACT), second.cast(_EXACT))]
    return F.unhex(F.md5(F.concat_ws(",", *parts).cast("binary")))


def prefixes(steps: DataFrame) -> DataFrame:
    """(conv, depth, length, id, parent) for every first d turns of every conversation.

    ``steps``: (conv, blk, depth, token, length), blocks of a conversation being ranges of depth.
    """
    hashed = keep(
        steps.withColumn("x", F.xxhash64("token", "depth").cast(_EXACT))
        .withColumn("y", F.xxhash64(F.lit(1), "token", "depth").cast(_EXACT)),
        "steps",
    )
    along = Window.partitionBy("conv").orderBy("blk")
    blocks = hashed.groupBy("conv", "blk").agg(
        F.sum("x").cast(_EXACT).alias("bx"), F.sum("y").cast(_EXACT).alias("by")
    ).select("conv", "blk", *[
        (F.sum(b).over(along) - F.col(b)).cast(_EXACT).alias(b) for b in ("bx", "by")
    ])
    inside = Window.partitionBy("conv", "blk").orderBy("depth")
    summed = hashed.select("*", F.sum("x").over(inside).alias("sx"), F.sum("y").over(inside).alias("sy"))
    x, y = F.col("bx") + F.col("sx"), F.col("by") + F.col("sy")
    return summed.join(blocks, ["conv", "blk"]).select(
        "conv", "depth", "length", _id(F.col("depth"), x, y).alias("id"),
        _id(F.col("depth") - 1, x - F.col("x"), y - F.col("y")).alias("parent"),
    )


# --- contraction -----------------------------------------------------------------------------

_DONE = "id binary, state string, parent binary, child binary, rest long, a long, b long"


def _round(rows: DataFrame, number: int) -> DataFrame:
    """Rake and compress once, by one shuffle; rows that are not live stay as they are.

    ``rows`` has the columns of ``_DONE``. Of a live node ``rest`` counts the children, ``child``
    is the only one (unknown in the first round); of a spliced node it is the one handed over.
    """
    # Text, as Spark would write a number into the code it compiles, anew for every round.
    rank = lambda node: F.xxhash64(node, F.lit(str(number)))
    live, below = F.col("state") == "live", F.col("parent").isNotNull()
    waits = below & (rank("parent") < rank("id")) if number > 1 else F.lit(False)
    goes = live & below & F.col("child").isNotNull() & ~waits & (rank("id") < rank("child"))
    marked = rows.withColumn("rakes", live & (F.col("rest") == 0) & ~waits).withColumn("goes", goes)
    rakes, goes = F.col("rakes"), F.col("goes")
    none, nothing = F.lit(None).cast("binary"), F.lit(0).cast("long")

    def message(id, state=F.lit(None).cast("string"), parent=none, moved=none, child=none,
                heir=none, rest=nothing, a=nothing, b=nothing):
        parts = {"id": id, "state": state, "parent": parent, "moved": moved, "child": child,
                 "heir": heir, "rest": rest, "a": a, "b": b}
        return F.struct(*[part.alias(name) for name, part in parts.items()])

    itself = message(
        F.col("id"), F.when(rakes, "raked").when(goes, "spliced").otherwise(F.col("state")),
        F.col("parent"), child=F.when(goes | ~live, F.col("child")), a=F.col("a"), b=F.col("b"),
    )
    given = rakes | goes
    up = message(
        F.col("parent"), rest=F.when(rakes, 0).otherwise(1).cast("long"),
        heir=F.when(goes, F.col("child")).when(~rakes, F.col("id")),
        a=F.when(given, F.col("a")).otherwise(nothing),
        b=F.when(given, F.col("b")).otherwise(nothing),
    )
    down = message(F.col("child"), moved=F.col("parent"))
    sent = F.when(goes, F.array(itself, up, down)).when(live & below, F.array(itself, up))
    told = marked.select(F.inline(sent.otherwise(F.array(itself)))).groupBy("id").agg(
        *[F.max(c).alias(c) for c in ("state", "parent", "moved", "child", "heir")],
        *[F.sum(c).alias(c) for c in ("rest", "a", "b")],
    )
    only = (F.col("state") == "live") & (F.col("rest") == 1)
    return told.select(
        "id", "state", F.coalesce("moved", "parent").alias("parent"),
        F.when(only, F.col("heir")).otherwise(F.col("child")).alias("child"), "rest", "a", "b",
    )


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(id, a, b): sums of ``a`` and ``b`` over the subtree of each node, its own included.

    ``nodes``: (id, parent, n_children, a, b); a root has a null parent. Several trees may stand in
    the table. The driver sees one number a job.
    """
    spark = nodes.sparkSession
    live = nodes.select(
        "id", F.lit("live").alias("state"), "parent", F.lit(None).cast("binary").alias("child"),
        F.col("n_children").alias("rest"), "a", "b",
    )
    done = spark.createDataFrame([], _DONE)
    number = 0
    while left := live.count():
        for _ in range(ROUNDS if left <= FEW else 1):
            number += 1
            live = _round(live, number)
        step = keep(live, "contracted")
        done = done.unionByName(step.where("state <> 'live'"))
        live = step.where("state = 'live'")
    raked, spliced = done.where("state = 'raked'"), done.where("state = 'spliced'")
    # A spliced node's child was contracted in a later round, so no chain has more links than
    # there were rounds.
    chain = spliced.select("id", "child", "a", "b")
    reach = 1
    while reach < number:
        chain = keep(chain, "chains")
        onward = chain.select(F.col("id").alias("child"), F.col("child").alias("then"),
                              F.col("a").alias("more_a"), F.col("b").alias("more_b"))
        nothing = F.lit(0).cast("long")
        chain = chain.join(onward, "child", "left").select(
            "id", F.coalesce("then", "child").alias("child"),
            (F.col("a") + F.coalesce("more_a", nothing)).alias("a"),
            (F.col("b") + F.coalesce("more_b", nothing)).alias("b"),
        )
        reach *= 2
    ends = raked.select(F.col("id").alias("child"), F.col("a").alias("end_a"), F.col("b").alias("end_b"))
    expanded = chain.join(ends, "child").select(
        "id", (F.col("a") + F.col("end_a")).alias("a"), (F.col("b") + F.col("end_b")).alias("b")
    )
    return raked.select("id", "a", "b").union(expanded)


# --- digests of member lists -----------------------------------------------------------------


def id_digests(members: DataFrame) -> DataFrame:
    """(id, digest): SHA-256 of each node's ascending decimal ``conv``s joined by commas.

    The order is by ranges over all nodes; pieces of ``PIECE`` ids are joined in parallel, and one
    task hashes a node's pieces as they stream by, since a SHA-256 has no parallel form.
    """
    order = ["id", "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, start = [], 0
            while start < len(ids):
                stop = start + 1
                while stop < min(len(ids), start + PIECE) and ids[stop] == ids[start]:
                    stop += 1
                out.append((ids[start], convs[start], ",".join(map(str, convs[start:stop]))))
                start = stop
            if out:
                names, firsts, texts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(firsts, pa.int64()),
                     pa.array(texts, pa.string())], ["id", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for found, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if found != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = found, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            if out:
                yield _digest_batch(out)
        if node is not None:
            yield _digest_batch([(node, state.hexdigest())])

    ordered = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ordered.mapInArrow(pieces, "id binary, first long, piece string")
    dealt = cut.repartition("id").sortWithinPartitions("id", "first")
    return dealt.mapInArrow(digests, "id binary, digest string")


def _digest_batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    names, texts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()), pa.array(texts, pa.string())], ["id", "digest"]
    )


# --- the trie --------------------------------------------------------------------------------


def trie(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per node of the trie of ``steps``, from the textless root on.

    ``convs``: (conv, size), all members, also those without a turn. Columns: id, parent (null at
    the root), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256 of the members that end here.
    """
    paths = keep(prefixes(steps), "prefixes")
    zero = F.lit(0).cast("long")
    top = _id(zero, zero, zero)
    root = (
        convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
        .where("n_convs > 0")
        .select(top.alias("id"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"),
                "conv_id", "n_convs", zero.alias("length"))
    )
    found = paths.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"),
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("length").alias("length"),
    )
    every = keep(found.unionByName(root), "nodes")
    children = every.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n_children")
    )
    nodes = keep(
        every.join(children, "id", "left")
        .withColumn("n_children", F.coalesce("n_children", zero))
        .withColumn("a", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("b", (F.col("n_convs") - 1) * F.col("length")),
        "counted",
    )
    sums = keep(subtree_sums(nodes), "sums")
    last = paths.join(convs.withColumnRenamed("size", "depth"), ["conv", "depth"]).select("id", "conv")
    last = last.union(convs.where("size = 0").select(top, "conv"))
    digests = id_digests(last)
    parents = nodes.where("n_children > 0").select(
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    below = nodes.drop("n_children").where("parent IS NOT NULL")
    named = lookup(below.select("id", "parent"), parents, ["parent"], "n_children").drop("parent")
    named = keep(named, "named")  # like the sums: the driver holds no plan of everything at once
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.drop("a", "b").join(sums, "id").join(named, "id", "left").join(digests, "id", "left")
        .select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                F.col("a").alias("n_leaves"), F.col("b").alias("saved_tokens"),
                F.coalesce("digest", none).alias("ends_sha256"))
    )
