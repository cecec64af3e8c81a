"""Repeated passages by a sparse suffix array: suffixes at content-selected minimiser positions.

Of the suffixes of all texts, which start at any word, those are retained that start at a minimiser:
the run of ``SEED`` words with the smallest hash among all such runs of a window of ``PASSAGE``
words (the leftmost of equals). Windows with the same words select the same place in them, so every
repeated passage has a retained suffix at the same place in each copy; about one word in sixteen
starts one. Each is kept with its reach, what the windows that selected it cover: from there it
extends left and right.

Suffixes are sorted by the fingerprints of their first words, then of their whole reach, and
compared with their neighbours. Equal reach: all of it repeats. Equal first words but another
reach: the match ends inside; it is extended left and right window by window, on rolling
fingerprints. So no two occurrences are ever paired, however often a passage repeats: each is held
against the first one of its kind. Words are lower-cased runs of non-blanks; fingerprints of
passages are 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from martwright.llm.rows import Words, gram_hashes, run_hashes, slices, word_hashes
from martwright.llm.tables import keep

PASSAGE, SEED = 50, 20
SUFFIX = "seed long, reach long, before int, windows int, id long, body long, at int"


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of every run of ``width`` values."""
    place = np.arange(len(values))
    best, span = values, 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        place = np.where(take, place[step:], place[: len(place) - step])
        best = np.where(take, right, left)
        span += step
    return place


def _suffixes(words: Words, hashes: np.ndarray, passage: int, seed: int):
    """(text, first window, windows, seed's word, seed hash, reach hash) of retained suffixes."""
    text, at, grams = gram_hashes(words, hashes, seed, 1)
    runs = passage - seed + 1
    if len(grams) < runs:
        return None
    chosen = _window_minima(grams, runs)
    # A window must lie in one text: its first and last seeds do.
    whole = text[: len(chosen)] == text[runs - 1 :]
    window = np.flatnonzero(whole)
    if not len(window):
        return None
    chosen = chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start, pick = at[window[first]], chosen[first]
    reach = run_hashes(hashes, start, start + count + passage - 1, 2)
    return text[window[first]], start, count, at[pick], grams[pick], reach


def _retained(passage: int, seed: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for row, part in slices(batch.column(1)):
                words = Words(pc.utf8_lower(part))
                found = _suffixes(words, word_hashes(words), passage, seed)
                if found is None:
                    continue
                text, start, count, place, grams, reach = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(reach.view(np.int64)),
                     pa.array((place - start).astype(np.int32)),
                     pa.array(count.astype(np.int32)),
                     pa.array(ids[row + text].astype(np.int64)),
                     pa.array(bodies[row + text].astype(np.int64)),
                     pa.array((start - words.first[text]).astype(np.int32))],
                    names=["seed", "reach", "before", "windows", "id", "body", "at"],
                )

    return fn


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in sorted order, those whose neighbour has the same first words."""
    held: pa.Table | None = None
    same_as_before = False
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        seeds = rows.column("seed").to_numpy()
        equal = seeds[1:] == seeds[:-1]
        keeps = np.append(equal, False) | np.insert(equal, 0, same_as_before)
        held = rows.slice(rows.num_rows - 1)  # its right neighbour is still to come
        same_as_before = bool(keeps[-1])
        yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(keeps[:-1])).to_batches()
    if held is not None and same_as_before:
        yield from held.to_batches()


def _extensions(passage: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of the windows of the suffixes listed for each text."""
        for batch in batches:
            ids, bodies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            lists = batch.column(2)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            at, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "windows"))
            for row, part in slices(batch.column(1)):
                words = Words(pc.utf8_lower(part))
                hashes = word_hashes(words)
                low = ends[row - 1] if row else 0
                high = ends[row + len(part) - 1]
                text = np.searchsorted(ends, np.arange(low, high), "right") - row
                start = words.first[text] + at[low:high]
                n = count[low:high]
                skipped = np.repeat(np.cumsum(n) - n, n)
                window = np.repeat(start, n) + np.arange(n.sum()) - skipped
                owner = np.repeat(text, n)
                prints = run_hashes(hashes, window, window + passage, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)),
                     pa.array(ids[row + owner].astype(np.int64)),
                     pa.array(bodies[row + owner].astype(np.int64)),
                     pa.array((window - words.first[owner]).astype(np.int32))],
                    names=["print", "id", "body", "at"],
                )

    return fn


def _merge(lists: pa.Array) -> pa.Array:
    """Each text's spans, sorted and joined where they touch or overlap."""
    out = []
    for spans in lists.to_pylist():
        joined: list[dict] = []
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            if joined and start <= joined[-1]["end"]:
                joined[-1]["end"] = max(joined[-1]["end"], end)
            else:
                joined.append({"start": start, "end": end})
        out.append(joined)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


#: An occurrence: the row, by its id and text, and the word.
PLACE = ("id", "body", "at")


def _body(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string")).alias("body")


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, body, spans): where texts repeat ``passage`` or more words said before.

    A span is (start, end) in words from 0, end excluded: words covered by runs of ``passage``
    words that also stand earlier, in a row with a smaller id, or earlier in the same text. The
    first occurrence is never listed. Texts without repeats have no row, so null, empty and short
    texts have none; nor have rows with a null id, which are not read. Rows that share an id are
    texts of their own, in the order of ``body``, the hash of the text; equal rows are one. Copies
    are repeats like any other. Other columns are not read.
    """
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"),
        _body(text),
    )
    suffixes = keep(rows.mapInArrow(_retained(passage, seed), SUFFIX), "suffixes")
    kind = ["seed", "reach", "before", "windows"]
    kinds = suffixes.groupBy(*kind).agg(
        F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")
    )
    kinds = keep(kinds, "kinds")

    # Equal reach: whatever is not the first of its kind repeats it as a whole.
    again = kinds.where(F.col("n") > 1).drop("n")
    whole = (
        suffixes.join(again, kind)
        .where(F.struct(*PLACE) != F.col("first"))
        .select("id", "body", F.col("at").alias("start"),
                (F.col("at") + F.col("windows") + F.lit(passage - 1)).alias("end"))
    )

    # Equal first words, another reach: the firsts of such kinds are extended by windows.
    order = ["seed", "reach", "before", "windows"]
    parts = (
        kinds.select("seed", "reach", "before", "windows", "first.*")
        .repartitionByRange("seed")
        .sortWithinPartitions(*order)
        .mapInArrow(_with_neighbours, SUFFIX)
        .groupBy("id", "body")
        .agg(F.collect_list(F.struct("at", "windows")).alias("at"))  # bounded by the text's length
    )
    one = rows.join(parts, ["id", "body"]).groupBy("id", "body").agg(
        F.max("text").alias("text"), F.first("at").alias("at")
    )
    prints = keep(
        one.select("id", "text", "at", "body").mapInArrow(
            _extensions(passage), "print long, id long, body long, at int"
        ),
        "prints",
    )
    firsts = prints.groupBy("print").agg(
        F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")
    ).where(F.col("n") > 1).drop("n")
    single = (
        prints.join(firsts, "print")
        .where(F.struct(*PLACE) != F.col("first"))
        .select("id", "body", F.col("at").alias("start"), (F.col("at") + F.lit(passage)).alias("end"))
    )
    merge = arrow_udf(_merge, "array<struct<start:int, end:int>>")
    return (
        whole.union(single)
        .groupBy("id", "body")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most one a word
        .select(F.col("id").alias(doc_id), "body", merge("spans").alias("spans"))
    )


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if not text or not cuts:
            out.append(text)
            continue
        # Lower-casing can change the number of bytes, never the words: blanks stay as they are.
        words = Words(pa.array([text], pa.large_string()))
        raw, starts = text.encode(), [*words.start.tolist(), None]
        parts, done = [], 0
        for cut in cuts:
            parts.append(raw[done : starts[cut["start"]]])
            done = starts[cut["end"]]
            if done is None:
                done = len(raw)
                break
        out.append(b"".join([*parts, raw[done:]]).decode())
    return pa.array(out, pa.string())


def cut_repeats(
    docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text",
    size: str | None = None,
) -> DataFrame:
    """``docs`` without the words in ``spans`` and the blanks after them; all rows and columns stay.

    A text that repeats others from end to end becomes empty. Rows without spans are unchanged.
    ``size``: a column that gets the number of characters of a text that was cut.
    """
    cuts = spans.select(
        F.col(doc_id).alias("__id"), F.col("body").alias("__body"), F.col("spans").alias("__spans")
    )
    cut = arrow_udf(_cut, "string").asNondeterministic()  # once a row, though used twice
    has = F.col("__spans").isNotNull()
    own = (F.col(doc_id).cast("long") == F.col("__id")) & (_body(text) == F.col("__body"))
    joined = docs.join(cuts, own, "left")
    left = joined.withColumn("__left", cut(F.col(text).cast("string"), "__spans"))
    new = {text: F.when(has, F.col("__left")).otherwise(F.col(text))}
    if size is not None and size in docs.columns:
        kind = docs.schema[size].dataType
        new[size] = F.when(has, F.char_length("__left").cast(kind)).otherwise(F.col(size))
    return left.withColumns(new).select(*docs.columns)
