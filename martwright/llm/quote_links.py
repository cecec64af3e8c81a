"""Conversations from quoted mail: quote levels, passages, their originals, reply order.

Everything here is DataFrame functions and joins; nothing leaves the JVM.

A line's level is the number of ``>`` before its text. A passage is a run of lines of one level
without a blank line in it; lower-cased and with single blanks it is hashed. A passage quoted at a
level is joined to the earlier messages that hold it one level lower, as the message quoted does, or
say it at level 0. The message replied to is the one that agrees best: at the lowest level, with
most passages there, with most passages at all, and of equals the last before the reply.

A passage that very many messages hold alike ("Yes.") is not paired with all its holders. Messages
that hold the same of what a reply asks agree alike, and of equals the last wins: so of each set of
common passages that some message holds of those asked, the last holder before the reply is a
candidate, found along ranges of ids. Sets are compared once for all messages that hold, or ask
for, the same common passages.

Conversations are what replies connect; they are found by doubling pointers, a logarithmic number
of joins. Within one, messages are in order of their ids: a message is quoted after it was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.tables import keep

#: Positions are counted in spans of 2 ** SPAN_BITS ids, so that a conversation of any size is
#: many tasks.
SPAN_BITS = 16
#: Passages that more messages hold at one level are linked by sets, not holder by holder.
COMMON = 16
ATTRIBUTION = r"^.{1,200}\b(wrote|schrieb|escribió|a écrit)\s*:\s*$"


def parsed_lines(messages: DataFrame, msg_id: str = "msg_id", text: str = "text") -> DataFrame:
    """(id, line, level, said, blank, passage): each line of each message that has an id.

    ``passage`` numbers the passages of a message; attribution lines before a deeper level are
    marked by a null passage, as blank lines are.
    """
    # Repeated rows are one message; of two texts with one id the greater counts.
    single = messages.where(F.col(msg_id).isNotNull()).groupBy(
        F.col(msg_id).cast("long").alias("id")
    ).agg(F.coalesce(F.max(text), F.lit("")).alias("text"))
    lines = single.select("id", F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "raw"))
    marks = F.regexp_extract("raw", r"^((?:[ \t]?>)*)", 1)
    level = F.char_length(F.regexp_replace(marks, "[^>]", ""))
    cut = F.when(level > 0, F.regexp_replace("raw", r"^(?:[ \t]?>)+[ \t]?", "")).otherwise(F.col("raw"))
    lines = lines.select("id", "line", level.alias("level"), cut.alias("said"))
    order = Window.partitionBy("id").orderBy("line")
    blank = F.col("said").rlike(r"^\s*$")
    named = F.col("said").rlike(ATTRIBUTION) & (F.lead("level").over(order) > F.col("level"))
    lines = lines.withColumn("idle", blank | F.coalesce(named, F.lit(False))).withColumn(
        "named", F.coalesce(named, F.lit(False))
    )
    starts = (
        F.lag("idle", 1, True).over(order) | (F.lag("level").over(order) != F.col("level"))
    ) & ~F.col("idle")
    number = F.sum(F.when(starts, 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return lines.select(
        "id", "line", "level", "said", "named", F.when(~F.col("idle"), number).alias("passage")
    )


def _normal(parts) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(F.array_join(parts, " ")), r"\s+", " "))


def _in_order(value: str, when) -> F.Column:
    """The values of a message's lines, in order; bounded by the message."""
    picked = F.sort_array(F.collect_list(F.when(when, F.struct("line", value))))
    return F.transform(picked, lambda x: x[value])


def passages(lines: DataFrame) -> DataFrame:
    """(id, level, print): the hash of each passage."""
    found = lines.where(F.col("passage").isNotNull()).groupBy("id", "passage").agg(
        F.min("level").alias("level"), _normal(_in_order("said", F.lit(True))).alias("said")
    )
    return found.select("id", "level", F.md5(F.col("said").cast("binary")).alias("print"))


def bodies(lines: DataFrame) -> DataFrame:
    """(id, body): what each message says itself, without quotes, their attributions, and blank
    lines around."""
    own = (F.col("level") == 0) & ~F.col("named")
    said = F.array_join(_in_order("said", own), "\n")
    return lines.groupBy("id").agg(
        F.regexp_replace(said, r"^\s+|\s+$", "").alias("body")
    )


def _last_holders(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, level, print, holder): the last message before ``id`` that holds the passage at the
    level ``lev`` asked for. Rows of both kinds lie along ids, in spans of bounded width."""
    key = ["print", "lev"]
    rows = held.select(*key, "id", F.col("id").alias("holder"), F.lit(None).cast("int").alias("level"))
    rows = rows.union(asked.select(*key, "id", F.lit(None).cast("long"), "level"))
    rows = keep(rows.withColumn("span", F.shiftright("id", SPAN_BITS)), "along")
    # A message is no holder for itself: its questions come before it.
    inside = Window.partitionBy(*key, "span").orderBy("id", F.col("holder").isNotNull())
    near = rows.withColumn("near", F.last("holder", True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy(*key, "span").agg(F.max("holder").alias("top"))
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*key, "span", F.max("top").over(before).alias("far"))
    found = near.where(F.col("holder").isNull()).join(spans, [*key, "span"])
    return found.select(
        "id", "level", "print", F.coalesce("near", "far").alias("holder")
    ).where(F.col("holder").isNotNull())


def _set_key(rows: DataFrame, by: list[str], parts: list[str], name: str) -> DataFrame:
    """(*by, name, n): the hash of each group's distinct ``parts``, and their number."""
    each = F.sort_array(F.collect_set(F.concat_ws(":", *parts)))
    return rows.groupBy(*by).agg(each.alias("each")).select(
        *by, F.md5(F.array_join("each", ",").cast("binary")).alias(name), F.size("each").alias("n")
    )


def _set_holders(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, holder): of each set of two or more passages that a message holds of those ``id`` asks
    for, the last holder before ``id``; only of the sets that agree best among those held by then.

    Asks and messages with the same passages are one class each, and classes are compared.
    """
    held_in = _set_key(held, ["id"], ["print", "lev"], "holds").where("n > 1").drop("n")
    held_in = keep(held_in, "holds")
    asks_in = _set_key(asked, ["id"], ["level", "print", "lev"], "asks").where("n > 1").drop("n")
    asks_in = keep(asks_in, "asks")
    held_of = held.join(held_in, "id").select("holds", "print", "lev").distinct()
    asks_of = asked.join(asks_in, "id").select("asks", "level", "print", "lev").distinct()
    both = keep(asks_of.join(held_of, ["print", "lev"]), "both")
    sets = _set_key(both, ["asks", "holds"], ["print", "lev"], "kind").where("n > 1").drop("n")
    by_level = both.select("asks", "holds", "level", "print").distinct().groupBy(
        "asks", "holds", "level").agg(F.count("*").alias("n"))
    worth = by_level.groupBy("asks", "holds").agg(
        F.max(F.struct((-F.col("level")).alias("low"), "n")).alias("best"), F.sum("n").alias("all")
    )
    sets = keep(sets.join(worth, ["asks", "holds"]), "sets")
    kinds = sets.select("kind", "holds").distinct()
    holders = keep(held_in.join(kinds, "holds").select("id", "kind"), "kinds")
    # Best of the sets that a message before the reply holds.
    first = holders.groupBy("kind").agg(F.min("id").alias("first"))
    wanted = sets.select("asks", "kind", "best", "all").distinct().join(first, "kind")
    wanted = asks_in.join(wanted, "asks").where(F.col("first") < F.col("id"))
    top = wanted.groupBy("id").agg(F.max(F.struct("best", "all")).alias("top"))
    wanted = wanted.join(top, "id").where(F.struct("best", "all") == F.col("top"))
    lev, none = F.lit(0).alias("lev"), F.lit(0).alias("level")
    return _last_holders(
        holders.select("id", F.col("kind").alias("print"), lev),
        wanted.select("id", F.col("kind").alias("print"), lev, none).distinct(),
    ).select("id", "holder").distinct()


def parents(found: DataFrame, common: int = COMMON, whole: bool = False) -> DataFrame:
    """(id, parent) of each message that quotes an earlier one.

    A passage that more than ``common`` messages hold at a level is a common one there. ``whole``
    compares sets of common passages, so that ``common`` does not change the result; without it, of
    holders found by common passages alone only the last of each passage counts.
    """
    held = keep(found.select("id", F.col("level").cast("int").alias("level"), "print").distinct(),
                "held")
    asked = held.where("level > 0").select(
        "id", "level", "print",
        F.explode(F.array_distinct(F.array(F.col("level") - 1, F.lit(0)))).alias("lev"),
    )
    held = held.withColumnRenamed("level", "lev")
    number = held.groupBy("print", "lev").agg(F.count("*").alias("n"))
    rare, often = number.where(F.col("n") <= common), number.where(F.col("n") > common)
    few = held.join(rare.drop("n"), ["print", "lev"]).withColumnRenamed("id", "holder")
    paired = asked.join(few, ["print", "lev"]).where(F.col("holder") < F.col("id"))
    many = often.drop("n")
    held_often = keep(held.join(many, ["print", "lev"], "left_semi"), "held_often")
    asked_often = keep(asked.join(many, ["print", "lev"], "left_semi"), "asked_often")
    last = _last_holders(held_often, asked_often)
    agreed = keep(paired.select("id", "level", "print", "holder").union(last).distinct(), "agreed")
    candidates = agreed.select("id", "holder")
    if whole:
        candidates = candidates.union(_set_holders(held_often, asked_often))
    # Who is found by one passage or set agrees by the common ones it holds as well, last or not.
    also = (
        candidates.distinct().join(asked_often, "id")
        .join(held.withColumnRenamed("id", "holder"), ["holder", "print", "lev"], "left_semi")
    )
    agreed = agreed.union(also.select("id", "level", "print", "holder")).distinct()
    by_level = agreed.groupBy("id", "holder", "level").agg(F.count("*").alias("n"))
    lowest = F.max(F.struct((-F.col("level")).alias("low"), "n")).alias("best")
    each = by_level.groupBy("id", "holder").agg(lowest, F.sum("n").alias("all"))
    return each.groupBy("id").agg(F.max(F.struct("best", "all", "holder")).alias("won")).select(
        "id", F.col("won.holder").alias("parent")
    )


def roots(replies: DataFrame) -> DataFrame:
    """(id, root, depth) of every message with a parent; replies always point to smaller ids."""
    now = keep(
        replies.select("id", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth")),
        "pointers",
    )
    done = []
    while True:
        ahead = now.select(
            F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more")
        )
        # Who points at a message without a parent has arrived and is joined no more.
        moved = keep(now.join(ahead, "to", "left"), "pointers")
        done.append(moved.where(F.col("next").isNull()).select(
            "id", F.col("to").alias("root"), "depth"
        ))
        going = moved.where(F.col("next").isNotNull())
        if going.isEmpty():
            break
        # Those that have arrived are still looked up by the others.
        settled = done[-1].select("id", F.col("root").alias("to"), "depth")
        step = going.select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        arrived = settled.join(step.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
        now = keep(step.union(arrived), "pointers")
    out = done[0]
    for rows in done[1:]:
        out = out.union(rows)
    return out.distinct()


def conversations(
    messages: DataFrame, msg_id: str = "msg_id", text: str = "text"
) -> DataFrame:
    """(message_id, conversation_id, parent_id, depth, position, body), one row for each id.

    A conversation is named by its first message; ``position`` counts from 0 in reply order. A
    message that quotes nothing known is a conversation of its own; so is a null, empty or blank
    text, with an empty body. A quote is never linked to its own message or to a later one. Rows
    with a null id have no row. Other columns are not read.
    """
    lines = keep(parsed_lines(messages, msg_id, text), "lines")
    replies = keep(parents(passages(lines), whole=True), "replies")
    placed = (
        bodies(lines)
        .join(replies, "id", "left")
        .join(roots(replies), "id", "left")
        .select(
            F.col("id").alias("message_id"), F.coalesce("root", "id").alias("conversation_id"),
            F.col("parent").alias("parent_id"), F.coalesce("depth", F.lit(0)).alias("depth"),
            F.shiftright("id", SPAN_BITS).alias("span"), "body",
        )
    )
    placed = keep(placed, "placed")
    # Bounded groups: ids differ, so a span of ids holds no more messages than it is wide.
    counts = placed.groupBy("conversation_id", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conversation_id").orderBy("span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "conversation_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("conversation_id", "span").orderBy("message_id")
    return (
        placed.withColumn("k", F.row_number().over(within) - 1)
        .join(offsets, ["conversation_id", "span"])
        .select("message_id", "conversation_id", "parent_id", "depth",
                (F.col("k") + F.col("offset")).alias("position"), "body")
    )
