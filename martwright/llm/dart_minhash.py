"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles: an element's weight is how often it occurs.
Every element owns a strip of the plane weight x rank, cut at the weights 1, 2, 4, 8, ... Darts,
placed by hashes of element and strip alone, hit a strip as a Poisson process, in order of rank; a
dart counts if it lies below the element's weight. Each dart also names one of ``coordinates``
coordinates. Of each coordinate a document keeps its earliest dart, so two documents agree there
with a probability equal to their weighted Jaccard similarity. Few darts have to be thrown: those
of small rank, about coordinates * ln(coordinates), whatever the number of elements.

Coordinates are joined in bands. What shares a band is compared exactly, by the sum of least over
the sum of largest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from martwright.llm.rows import (
    Words,
    gram_hashes,
    mix,
    run_hashes,
    slices,
    with_text_column,
    word_hashes,
)
from martwright.llm.tables import components, keep

SHINGLE = 5
COORDINATES, BAND_SIZE = 100, 5
SIMILARITY = 0.8
#: Members of a bucket that are compared in one task are those of two blocks of about this size.
BLOCK = 256
COLUMNS = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def shingles(texts: pa.Array, size: int = SHINGLE):
    """(Words, word hashes, text index, hash) of all shingles of some texts, lower-cased.

    A text of fewer than ``size`` words has one shingle, all its words; without words, none.
    """
    words = Words(pc.utf8_lower(texts))
    hashes = word_hashes(words)
    text, _, grams = gram_hashes(words, hashes, size)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        text = np.concatenate([text, short])
        tail = run_hashes(hashes, words.first[:-1][short], words.first[1:][short], 1)
        grams = np.concatenate([grams, tail])
    return words, hashes, text, grams


def weigh(text: np.ndarray, grams: np.ndarray):
    """(text, element, weight) without repeats."""
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return text[at], grams[at], np.diff(np.append(at, len(text))).astype(float)


def signatures(text, element, weight, texts: int, coordinates: int = COORDINATES) -> np.ndarray:
    """texts x coordinates: the earliest dart of each coordinate; 0 where a text has no element."""
    # An element of weight x owns the strips 0-1, 1-2, 2-4, ... up to x.
    strips = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    owner = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(owner)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip == 0, 0.0, 2.0 ** (strip - 1.0))
    width = np.where(strip == 0, 1.0, low)
    seed = mix(element[owner] + (strip.astype(np.uint64) + np.uint64(1)) * _STEP)
    total = np.bincount(text, weight, texts)
    out = np.zeros((texts, coordinates), np.uint64)
    # Ranks up to this bound hold so many darts of a text that hardly a coordinate stays empty.
    reach = np.full(texts, coordinates * (np.log(coordinates) + 3))
    pending = total > 0
    while pending.any():
        mine = np.flatnonzero(pending[text[owner]])
        doc, lo, wide = text[owner[mine]], low[mine], width[mine]
        top, rank, base = weight[owner[mine]], np.zeros(len(mine)), seed[mine]
        bound = reach / np.maximum(total, 1e-300)
        cells, ranks, darts = [], [], []
        turn = 0
        while len(doc):
            turn += 1
            dart = mix(base + np.uint64(turn * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            u = (dart >> np.uint64(11)).astype(float) * _UNIT
            rank = rank - np.log1p(-u) / wide
            live = rank <= bound[doc]
            doc, lo, wide, top = doc[live], lo[live], wide[live], top[live]
            rank, base, dart = rank[live], base[live], dart[live]
            place = mix(dart ^ _STEP)
            height = lo + wide * ((place >> np.uint64(32)).astype(float) * 2.0**-32)
            hit = height < top
            slot = (place & np.uint64(0xFFFFFFFF)) % np.uint64(coordinates)
            cells.append(doc[hit] * coordinates + slot[hit].astype(np.int64))
            ranks.append(rank[hit])
            darts.append(dart[hit])
        cell, rank, dart = np.concatenate(cells), np.concatenate(ranks), np.concatenate(darts)
        first = np.full(texts * coordinates, np.inf)
        np.minimum.at(first, cell, rank)
        earliest = rank == first[cell]
        flat = np.zeros(texts * coordinates, np.uint64)
        flat[cell[earliest]] = dart[earliest]
        full = np.isfinite(first).reshape(texts, coordinates).all(axis=1) & pending
        out[full] = flat.reshape(texts, coordinates)[full]
        pending &= ~full
        reach = reach * 2
    return out


def _sign(column: pa.Array) -> pa.Array:
    digests, counts, bands = [], [], []
    for _, part in slices(column):
        words, hashes, text, grams = shingles(part)
        ends = words.first[:-1], words.first[1:]
        digests.append([run_hashes(hashes, *ends, which) for which in (2, 3)])
        counts.append(np.diff(words.first))
        drawn = signatures(*weigh(text, grams), len(part))
        rows = np.arange(0, COORDINATES + 1, BAND_SIZE)
        flat = drawn.reshape(-1)
        at = (np.arange(len(part))[:, None] * COORDINATES + rows[None, :-1]).reshape(-1)
        bands.append(run_hashes(flat, at, at + BAND_SIZE, 2))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    width = COORDINATES // BAND_SIZE
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(0, width * len(column) + 1, width), pa.int32()),
        pa.array(join(bands).view(np.int64)),
    )
    return pa.StructArray.from_arrays(
        [pa.array(join([d[0] for d in digests]).view(np.int64)),
         pa.array(join([d[1] for d in digests]).view(np.int64)),
         pa.array(join(counts).astype(np.int64)), lists],
        ["d1", "d2", "n", "bands"],
    )


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts, by their shingles' counts."""
    sides = []
    for texts in (left, right):
        _, _, text, grams = shingles(texts)
        sides.append(weigh(text, grams))
    sums = [np.bincount(t, w, len(left)) for t, _, w in sides]
    text = np.concatenate([s[0] for s in sides])
    grams = np.concatenate([s[1] for s in sides])
    weight = np.concatenate([s[2] for s in sides])
    order = np.lexsort((grams, text))
    text, grams, weight = text[order], grams[order], weight[order]
    same = np.flatnonzero((text[1:] == text[:-1]) & (grams[1:] == grams[:-1]))
    common = np.bincount(text[same], np.minimum(weight[same], weight[same + 1]), len(left))
    union = sums[0] + sums[1] - common
    return np.divide(common, union, out=np.zeros(len(left)), where=union > 0)


def _compare(left: pa.Array, right: pa.Array) -> pa.Array:
    out = [np.zeros(0)]
    both = pc.binary_join_element_wise(
        pc.fill_null(left, ""), pc.fill_null(right, ""), "\n"
    )
    for start, part in slices(both):
        pair = [pc.fill_null(x.slice(start, len(part)), "").cast(pa.large_string())
                for x in (left, right)]
        out.append(similarities(*pair))
    return pa.array(np.concatenate(out))


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, d1, d2, n, bands) for every row: digest of the words, their number, band hashes."""
    kind = "struct<d1:long, d2:long, n:long, bands:array<long>>"
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return with_text_column(rows, "text", "s", _sign, kind).select("id", "s.*")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, d1, d2, class_id, kept) for every row of ``docs``; a class's smallest id stays.

    Two texts are linked if they share a band and their weighted similarity is at least
    ``similarity``; a class is what links reach. Texts with the same words, whatever their case
    and blanks, are one text. A null or empty text, or one of blanks, is its own class. A row
    with a null id has a null class and is kept. Rows with one id are one document: all get its
    class. Other columns are not read.
    """
    rows = keep(signed(docs, doc_id, text), "signed")
    usable = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    distinct = keep(
        usable.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("bands").alias("bands")),
        "distinct",
    )
    found = keep(_links(docs, distinct, doc_id, text, similarity), "links")
    # Copies join their text's node, so that rows of one id with two texts join both.
    copies = usable.select("id", "d1", "d2").join(distinct.drop("bands"), ["d1", "d2"])
    edges = found.union(copies.where(F.col("id") != F.col("node")).select("id", "node"))
    classes = components(edges)
    return (
        rows.join(classes.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("class_id", F.coalesce("component", "id"))
        .select(
            F.col("id").alias("doc_id"), "d1", "d2", "n", "class_id",
            F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"),
        )
    )


def _links(docs, distinct, doc_id, text, similarity) -> DataFrame:
    """(a, b): enough links between distinct texts to connect all that candidate pairs connect.

    In a bucket (a shared band) everyone is compared with its smallest node. Where that leaves a
    bucket with more than one class, all members of different classes are compared, block against
    block inside tasks, and only links come out: of those of one task no more than connect its
    classes. So a tight group of m texts costs m comparisons a band, a loose one no more than
    its blocks, and no candidate pair that could connect two classes is left out.
    """
    entries = distinct.select(
        "node", F.posexplode("bands").alias("band", "value")
    ).select(F.xxhash64("band", "value").alias("bucket"), "node")
    sizes = entries.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("node").alias("hub")
    ).where(F.col("size") > 1)
    members = keep(entries.join(sizes, "bucket"), "members")
    pairs = members.where(F.col("node") != F.col("hub")).select(
        F.col("hub").alias("a"), F.col("node").alias("b")
    ).distinct()
    nodes = members.select(F.col("node").alias("id")).distinct()
    texts = keep(
        docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        .join(nodes, "id", "left_semi")
        .groupBy("id").agg(F.max("text").alias("text")),
        "texts",
    )

    def verified(candidates: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        alike = arrow_udf(_compare, "double").asNondeterministic()
        joined = candidates.join(left, "a").join(right, "b")
        return keep(
            joined.select("a", "b", alike("ta", "tb").alias("s"))
            .where(F.col("s") >= similarity).select("a", "b"),
            "verified",
        )

    links = verified(pairs)
    placed = members.join(components(links), "node", "left").select(
        "bucket", "node", "size", F.coalesce("component", "node").alias("class")
    )
    mixed = placed.groupBy("bucket").agg(
        F.min("class").alias("least"), F.max("class").alias("most")
    ).where(F.col("least") != F.col("most")).select("bucket")
    loose = keep(placed.join(mixed, "bucket", "left_semi"), "loose")
    elements = arrow_udf(_elements, "array<long>").asNondeterministic()
    sets = keep(
        texts.join(loose.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        .select(F.col("id").alias("node"), elements("text").alias("elements")),
        "sets",
    )
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("node"), blocks)
    meets = loose.select(
        "bucket", "node", "class", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"),
    ).select("bucket", "node", "class", F.least("mine", "other").alias("i"),
             F.greatest("mine", "other").alias("j"))
    found = meets.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(
        _between_classes(similarity), "a long, b long"
    )
    return links.union(verified(found.distinct()))


def _elements(texts: pa.Array) -> pa.Array:
    """A text's shingles as hashes, one for each occurrence: the third of a shingle is another
    element than its first. They have all 64 bits, so that a block counts what the exact
    comparison counts."""
    flat, ends = [], [np.zeros(1, np.int64)]
    for _, part in slices(texts):
        _, _, text, grams = shingles(part)
        text, grams, weight = weigh(text, grams)
        count = weight.astype(np.int64)
        layer = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        each = mix(np.repeat(grams, count) + layer.astype(np.uint64) * _STEP)
        flat.append(each.view(np.int64))
        sizes = np.bincount(text, count, len(part)).astype(np.int64)
        ends.append(ends[-1][-1] + np.cumsum(sizes))
    values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(values))


def _between_classes(similarity: float):
    def fn(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        label = rows.column("class").to_numpy()
        lists = rows.column("elements").combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[tuple[int, int]] = []
        if len(set(label.tolist())) > 1:
            owner = np.repeat(np.arange(len(node)), size)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
            shared = count[column] > 1  # what one text alone has meets nothing
            order = np.argsort(column[shared], kind="stable")
            owner, column = owner[shared][order], column[shared][order]
            common = np.zeros((len(node), len(node)))  # whole numbers: products of one piece are exact
            edges = np.searchsorted(column, np.arange(0, len(count) + COLUMNS, COLUMNS))
            for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if high > low:
                    has = np.zeros((len(node), COLUMNS), np.float32)
                    has[owner[low:high], column[low:high] - k * COLUMNS] = 1
                    common += has @ has.T
            whole = size[:, None] + size[None, :] - common
            alike = np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)
            near = (alike >= similarity) & (label[:, None] != label[None, :])
            parent = {x: x for x in label.tolist()}

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in np.argwhere(np.triu(near, 1)):
                a, b = find(int(label[i])), find(int(label[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()),
                         "b": pa.array([x[1] for x in out], pa.int64())})

    return fn


def filter_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with its own columns: of the class's smallest id, and of several
    rows with this id the smallest row. Rows with a null id stay."""
    classes = near_duplicates(docs, similarity=similarity)
    lost = classes.where(~F.col("kept")).select("doc_id").distinct()
    others = [c for c in docs.columns if c != "doc_id"]
    single = (
        docs.where(F.col("doc_id").isNotNull())
        .join(lost, "doc_id", "left_anti")
        .groupBy("doc_id")
        .agg(F.min(F.struct(*others)).alias("__row"))
        .select("doc_id", "__row.*")
        .select(*docs.columns)
    )
    return single.unionByName(docs.where(F.col("doc_id").isNull()))
