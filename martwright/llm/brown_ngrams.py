"""Brown class-based n-grams: words in classes by exchange, class trigrams, word emissions.

Every word type has a class. Words seen ``min_count`` times or more, by default all that are not
seen just once, are put into ``classes`` classes by exchange clustering: a word moves to the class
that raises the likelihood of the class bigrams most; a third of the words may move in a round, on
the counts of the round before, or fewer where that lowers the likelihood. Rounds go on until a pass over all words moves fewer than 1 % of
them or adds less than 0.001 to the log-likelihood of a token. Words seen once are what the model
knows of unknown words; both are in a class by their shape (length, last character, digits). The
end of a text is a word and a class of its own, and stands before its beginning.

p(word | text so far) = p(class | two classes before) * p(word | class), where class trigrams are
smoothed by Witten and Bell's rule down to one class, and in a shape class known words give up an
absolute discount for the one unknown word of that shape. All counts cover all training texts.

Texts are turned into word numbers once, chunk by chunk; a chunk looks up its own distinct words by
a join, so the vocabulary is a table and no task or driver holds it. What is broadcast is the class
of each number, one byte a word. Neighbour counts lie in blocks of words, one row a block, dealt by
the word's number: results do not depend on the number of partitions or the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martwright.llm.rows import Words, slices, word_hashes
from martwright.llm.tables import discard, keep

CLASSES, MIN_COUNT = 48, 2
#: A pass over all words in so many rounds; passes end below these shares of words and nats a token.
TURNS, FEW_MOVES, LITTLE_GAIN = 3, 0.01, 0.001
#: A pass that lowers the likelihood is repeated in more rounds, up to about so many.
MOST_TURNS = 81
#: Words above this share of the tokens have their neighbours summed over all tasks.
HEAVY_SHARE = 1 / 1000
SHAPES = 18
#: Text numbered together, in bytes: its distinct words are looked up at once.
CHUNK_BYTES = 24 << 20
#: Tokens whose pairs are counted at once in a task, and tokens for each block of neighbours.
PAIR_TOKENS, BLOCK_TOKENS = 1 << 20, 2 << 20
#: Words whose numbers a task sorts by chunk at once.
ANSWERS = 1 << 20
#: Words numbered by one task.
NUMBERED = 100_000
#: Counts below this have their gains from a table.
SMALL = 12
#: The side of a neighbour: set before the word, clear after it.
BEFORE = np.uint64(1 << 31)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDING = np.zeros(256, np.int64)
_ENDING[list(b".!?")] = 2
_ENDING[list(b",;:")] = 1
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, perplexity double"
)
_DEALT = "chunk long, train long, texts binary"
_ANSWERS = "chunk long, h binary, unit binary, n binary"
_NUMBERED = (
    "id long, held_out boolean, n_tokens long, n_known long, base double, fixed double, units binary"
)


def _words(part: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, hashes, shapes) with A-Z lower-cased."""
    words = Words(part)
    words.data = _LOWER[words.data]
    size = words.end - words.start
    last = words.data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    first = words.data[words.start] if len(words) else np.zeros(0, np.uint8)
    digit = (first >= 48) & (first <= 57)
    length = np.searchsorted([3, 6, 10, 16], size)
    kind = np.where(digit, 0, 1 + length)  # 0..5
    return words, word_hashes(words), _ENDING[last] * 6 + kind


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _numbers(column: pa.Array, dtype) -> list[np.ndarray]:
    """The number arrays that the rows of a binary column hold."""
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _small(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def _counts(data: pa.Buffer, size: int) -> np.ndarray:
    """``size`` counts written by ``_small``."""
    return np.frombuffer(data, f"u{max(1, data.size // max(1, size))}")


def _packed(texts: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
    with pa.ipc.new_stream(sink, texts.schema, options=options) as out:
        out.write_batch(texts)
    return sink.getvalue().to_pybytes()


def _unpacked(texts: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(
        texts.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)
    ).read_all()


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in chunks of about CHUNK_BYTES, packed slice by slice."""
    first, seen = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, part in slices(batch.column("text")):
            some = batch.slice(start, len(part))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([first + seen // CHUNK_BYTES], pa.int64()),
                "train": pa.array([pc.sum(pc.invert(some.column("held_out"))).as_py()], pa.int64()),
                "texts": pa.array([_packed(some)], pa.binary()),
            })
            seen += int(size[start : start + len(part)].sum())


def _kinds(h: np.ndarray, shape: np.ndarray, n: np.ndarray):
    """The distinct hashes, rising, each with a shape that stands beside it and the sum of ``n``."""
    if not len(h):
        return h, shape, n
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], shape[order[first]], np.add.reduceat(n[order], first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk, or of its part in this task, with their training counts."""
    now, found = None, []

    def done():
        h, shape, n = _kinds(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return _batch({
            "chunk": np.full(len(h), now), "h": h.view(np.int64), "shape": shape.astype(np.int32), "n": n,
        })

    for batch in batches:
        for c, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
            if c != now and found:
                yield done()
                found = []
            now, rows = c, _unpacked(texts)
            for flag in (False, True):
                some = rows.filter(pc.equal(rows.column("held_out"), flag)).column("text")
                for _, part in slices(some.combine_chunks()):
                    _, hashes, shapes = _words(part)
                    found.append(_kinds(hashes, shapes, np.full(len(hashes), int(not flag))))
    if found:
        yield done()


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, their numbers and counts in rows of a chunk."""

    def done():
        chunk, h, unit, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk = chunk[order]
        cut = np.flatnonzero(np.diff(chunk, prepend=chunk[:1] - 1))
        h, unit, n = (np.split(x[order], cut[1:]) for x in (h, unit.astype(np.uint32), n))
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array(chunk[cut]),
            "h": pa.array([x.tobytes() for x in h], pa.binary()),
            "unit": pa.array([x.tobytes() for x in unit], pa.binary()),
            "n": pa.array([_small(x) for x in n], pa.binary()),
        })

    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            size += batch.num_rows
        if size >= ANSWERS:
            yield done()
            waiting, size = [], 0
    if waiting:
        yield done()


def _number(words: DataFrame, often: Column, tokens: int) -> tuple[DataFrame, int, int]:
    """(h, n, unit) of all training words, the number of heavy ones, and of all clustered ones.

    Numbers: heavy words by falling counts, the shapes (of all words that are not clustered), the
    end of a text, then the light words. The driver gets the heavy words, of which there are no
    more than 1 / HEAVY_SHARE, and one count for every NUMBERED light words.
    """
    spark = words.sparkSession
    heavy = F.col("n") > HEAVY_SHARE * tokens
    top = words.where(often & heavy).orderBy(F.desc("n"), "h").select("h").collect()
    first = len(top) + SHAPES + 1
    light = words.where(often & ~heavy)
    parts = light.count() // NUMBERED + 1
    light = light.withColumn("part", F.pmod("h", F.lit(parts)))
    sizes = {r["part"]: r["count"] for r in light.groupBy("part").count().collect()}
    before, at = [], first
    for part in range(parts):
        before.append((part, at))
        at += sizes.get(part, 0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("h")) - 1
    numbered = light.join(
        F.broadcast(spark.createDataFrame(before, "part long, before long")), "part"
    ).select("h", "n", (F.col("before") + place).alias("unit"))
    ranks = spark.createDataFrame([(r["h"], i) for i, r in enumerate(top)], "h long, unit long")
    return (
        numbered.unionByName(words.join(F.broadcast(ranks), "h").select("h", "n", "unit"))
        .unionByName(words.where(~often).select("h", "n", (F.col("shape") + len(top)).cast("long").alias("unit"))),
        len(top),
        at - SHAPES - 1,
    )


@dataclass
class Counts:
    """What is known of the training words before any class is."""

    heavy: int
    clustered: int
    shape_total: np.ndarray  # tokens of words that are not clustered, by shape
    discount: np.ndarray
    log_unknown: np.ndarray  # of the unknown word of each shape
    tokens: int
    types: int
    texts: int

    @property
    def end(self) -> int:
        return self.heavy + SHAPES

    @property
    def units(self) -> int:
        return self.clustered + SHAPES + 1


def _number_chunk(shared):
    def fn(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Texts as word numbers, with all that the classes have no part in."""
        counts: Counts = shared.value
        h, unit, n = (answers.column(c).combine_chunks() for c in ("h", "unit", "n"))
        known = np.concatenate([np.zeros(0, np.uint64), *_numbers(h, np.uint64)])
        unit_of = np.concatenate([np.zeros(0, np.uint32), *_numbers(unit, np.uint32)])
        n_of = np.concatenate([
            np.zeros(0), *(_counts(x.as_buffer(), y.as_buffer().size // 4) for x, y in zip(n, unit, strict=True))
        ])
        # A chunk's words are distinct.
        order = np.argsort(known)
        known, unit_of, n_of = known[order], unit_of[order], n_of[order]
        ids, held, done = [], [], []
        for texts in rows.column("texts").combine_chunks():
            some = _unpacked(texts)
            ids.append(some.column("id"))
            held.append(some.column("held_out"))
            done += [
                _numbered(counts, part, known, unit_of, n_of)
                for _, part in slices(some.column("text").combine_chunks())
            ]
        n, hits, base, fixed, units = zip(*done, strict=True)
        return pa.table({
            "id": pa.chunked_array([x for c in ids for x in c.chunks], pa.int64()),
            "held_out": pa.chunked_array([x for c in held for x in c.chunks], pa.bool_()),
            "n_tokens": np.concatenate(n), "n_known": np.concatenate(hits),
            "base": np.concatenate(base), "fixed": np.concatenate(fixed),
            "units": pa.chunked_array(units, pa.binary()),
        })

    return fn


def _numbered(counts: Counts, part: pa.Array, known, unit_of, n_of):
    words, hashes, shapes = _words(part)
    count, unit = np.zeros(len(hashes)), counts.heavy + shapes
    if len(known):
        at, order = np.empty(len(hashes), np.int64), np.argsort(hashes)
        at[order] = np.minimum(np.searchsorted(known, hashes[order]), len(known) - 1)
        hit = known[at] == hashes
        count[hit], unit[hit] = n_of[at[hit]], unit_of[at[hit]]
    rare = (unit >= counts.heavy) & (unit < counts.end)
    total = np.maximum(counts.shape_total[shapes], 1)
    share = np.log10(np.maximum(count - counts.discount[shapes], 1e-9) / total)
    emit = np.where(count > 0, share, counts.log_unknown[shapes])
    emit = np.where(rare, emit, np.log10(np.maximum(count, 1)))
    texts, of_text = len(words.first) - 1, words.of_text()
    n = np.diff(words.first) + 1
    base = np.bincount(of_text, np.log10(count + 1), texts) + np.log10(counts.texts + 1)
    hits = np.bincount(of_text, count > 0, texts).astype(np.int64) + (counts.texts > 0)
    places = (4 * words.first).astype(np.int32)
    units = pa.Array.from_buffers(
        pa.binary(), texts, [None, pa.py_buffer(places), pa.py_buffer(unit.astype(np.uint32))]
    )
    bottom = np.log10(counts.tokens + counts.types + 1)
    return n, hits, base - n * bottom, np.bincount(of_text, emit, texts), units


def _streams(batch: pa.RecordBatch, end: int, ahead: int):
    """(first row, rows, numbers) of pieces of a batch: the numbers of the texts with the end after
    each, and ``ahead`` ends before the first."""
    column = batch.column("units")
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    ends, start = np.cumsum(size, dtype=np.int64), 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIR_TOKENS, "right")))
        close = np.full(1, end, np.uint32)
        parts = [np.full(ahead, end, np.uint32)]
        for units in _numbers(column.slice(start, stop - start), np.uint32):
            parts += [units, close]
        yield start, stop - start, np.concatenate(parts).astype(np.int64)
        start = stop


def _pairs(counts: Counts, blocks: int):
    """Neighbours for each block: a row holds the words (each less the one before it), their neighbours
    with the side, and the counts, all compressed.

    A pair stands with its light words; one of heavy words, shapes and ends alone has a block by
    both, and is written after the first of them only.
    """
    first = counts.end + 1

    def entries(key, n):
        u, v = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        light_u, light_v = u >= first, v >= first
        alone = ~light_u & ~light_v
        after = light_u | alone
        block = np.concatenate([np.where(alone, u * 31 + v, u)[after], v[light_v]]) % blocks
        both = np.concatenate([
            key[after], key[light_v] << np.uint64(32) | key[light_v] >> np.uint64(32) | BEFORE,
        ])
        # By block, in it by word and neighbour: such rows are small when compressed.
        order = np.argsort(both)
        order = order[np.argsort(block[order].astype(np.min_scalar_type(blocks)), kind="stable")]
        block, both = block[order], both[order]
        n = np.concatenate([n[after], n[light_v]])[order]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        rows = [np.split(x, cut[1:]) for x in (both, n)]
        step = [np.diff(x >> np.uint64(32), prepend=np.uint64(0)) for x in rows[0]]
        return pa.RecordBatch.from_pydict({
            "block": pa.array(block[cut]), "size": pa.array([len(x) for x in step], pa.int64()),
            **{k: pa.array([pa.compress(x.astype(np.uint32).tobytes(), "zstd", asbytes=True) for x in of],
                           pa.binary())
               for k, of in (("step", step), ("other", rows[0]), ("n", rows[1]))},
        })

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for _, _, stream in _streams(batch, counts.end, 1):
                if waiting and size + len(stream) > PAIR_TOKENS:
                    yield entries(*np.unique(np.concatenate(waiting), return_counts=True))
                    waiting, size = [], 0
                stream = stream.view(np.uint64)
                waiting.append(stream[:-1] << np.uint64(32) | stream[1:])
                size += len(stream)
        if waiting:
            yield entries(*np.unique(np.concatenate(waiting), return_counts=True))

    return fn


def _merge(rows: pa.Table) -> pa.Table:
    """One row for a block, sorted by word and neighbour."""
    step, other, n = (
        [
            np.frombuffer(pa.decompress(x.as_buffer(), 4 * size, "zstd"), np.uint32)
            for x, size in zip(rows.column(c).combine_chunks(), rows.column("size").to_pylist(), strict=True)
        ]
        for c in ("step", "other", "n")
    )
    key = np.concatenate([
        np.cumsum(x, dtype=np.uint64) << np.uint64(32) | y for x, y in zip(step, other, strict=True)
    ])
    n = np.concatenate(n)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
    n = np.add.reduceat(n[order], at, dtype=np.int64)
    key = key[at]
    unit, other = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)
    start = np.flatnonzero(np.diff(unit.astype(np.int64), prepend=-1))
    ends = np.append(start[1:], len(unit)).astype(np.int64)
    return pa.table({
        "block": rows.column("block").slice(0, 1),
        **{k: pa.array([x], pa.binary())
           for k, x in (("unit", unit[start].tobytes()), ("ends", ends.tobytes()),
                        ("other", other.tobytes()), ("n", _small(n)))},
    })


def _opened(batch: pa.RecordBatch):
    """(words, ends of their entries, neighbours, whether those stand before, counts) of each block."""
    for row in range(batch.num_rows):
        unit, ends, other = (
            np.frombuffer(batch.column(c)[row].as_buffer(), kind)
            for c, kind in (("unit", np.uint32), ("ends", np.int64), ("other", np.uint32))
        )
        n = _counts(batch.column("n")[row].as_buffer(), len(other))
        side = other >= np.uint32(BEFORE)
        yield unit.astype(np.int64), ends, other & np.uint32(BEFORE - np.uint64(1)), side, n


def _f(x):
    return x * np.log(np.maximum(x, 1))


def _gains(cells: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What small counts add to the likelihood, one row for each distinct pair, and each pair's row.

    ``pairs``: counts below SMALL times the number of rows of ``cells``, plus the row.
    """
    used = np.bincount(pairs, minlength=SMALL * len(cells)) > 0
    of = np.cumsum(used) - 1
    n, row = np.divmod(np.flatnonzero(used), len(cells))
    rest = np.maximum(cells[row], 0)
    return _f(rest + n[:, None]) - _f(rest), of[pairs]


def _best(own, after, before, self_n, matrix: np.ndarray, movable: int) -> np.ndarray:
    """The class of each word that gives the class bigrams the highest likelihood.

    ``after`` and ``before``: word x class, the counts of its neighbours other than itself.
    """
    words = np.arange(len(own))
    gain = np.zeros((len(own), movable))
    for counts, others, cells in ((after, before, matrix.T), (before, after, matrix)):
        at = np.flatnonzero(counts.ravel() > 0)
        n, (w, j) = counts.ravel()[at], np.divmod(at, counts.shape[1])
        mine = own[w]
        cells = np.ascontiguousarray(cells[:, :movable])
        exact = (n >= SMALL) | (j == mine)
        # Small counts: the sum of table rows.
        at = np.flatnonzero(~exact)
        if len(at):
            k, row, col = n[at].astype(np.int64), w[at], j[at]
            table, of = _gains(cells, k * len(cells) + col)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            gain[row[starts]] += np.add.reduceat(table[of], starts, axis=0)
            # In its own class the word itself does not count; a class beside itself comes later.
            rest = cells[col, mine[at]]
            less = _f(np.maximum(rest - k, 0) + k) - _f(np.maximum(rest - k, 0))
            gain[words, own] += np.bincount(row, less - table[of, mine[at]], len(own))
            inner = np.flatnonzero(col < movable)
            gain[row[inner], col[inner]] -= table[of[inner], col[inner]]
        # Large counts, and neighbours in the word's own class.
        w, j, n, mine = w[exact], j[exact], n[exact], mine[exact]
        if not len(w):
            continue
        each = np.arange(len(w))
        rest = cells[j]
        rest[each, mine] -= n
        same = np.flatnonzero(j == mine)
        rest[same] -= others[w[same], :movable]
        rest[same, mine[same]] -= self_n[w[same]]
        rest = np.maximum(rest, 0)
        more = _f(rest + n[:, None]) - _f(rest)
        inner = np.flatnonzero(j < movable)
        more[inner, j[inner]] = 0
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(more, first, axis=0)
    around = after[:, :movable] + before[:, :movable] + self_n[:, None]
    at = np.flatnonzero(around.ravel() > 0)
    more, (w, j) = around.ravel()[at], np.divmod(at, movable)
    rest = np.maximum(np.diag(matrix)[j] - np.where(j == own[w], more, 0), 0)
    gain[w, j] += _f(rest + more) - _f(rest)
    for counts, axis in ((after, 1), (before, 0)):
        total = counts.sum(axis=1) + self_n
        kinds, of = np.unique(total, return_inverse=True)
        sums = matrix.sum(axis=axis)[:movable]
        rest = np.maximum(sums, 0)
        less = (_f(rest + kinds[:, None]) - _f(rest))[of]
        rest = np.maximum(sums[own] - total, 0)
        less[words, own] = _f(rest + total) - _f(rest)
        gain -= less
    to = gain.argmax(axis=1)
    return np.where(gain[words, to] > gain[words, own] + 1e-6, to, own)


def _best_classes(shared, movable: int, first: int, turns: int, turn: int, blocks: int, most: int = 256):
    """(words, classes) of a block's words that a move would make more likely.

    After every ``most`` words a block adds their moves to its class counts as often as there are
    blocks in the round, as the others meet words of the same kinds; else all would rush to the
    same classes.
    """
    times = -(-blocks // turns)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, start = shared.value
        for batch in batches:
            for unit, ends, other, side, n in _opened(batch):
                moved = _block_moves(class_of, start.copy(), unit, ends, other, side, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in moved], ["unit", "to"]
                )

    def _block_moves(class_of, matrix, unit, ends, other, side, n):
        size = len(matrix)
        units, goals = [], []
        ends = np.concatenate([[0], ends])
        for at in range(int(np.searchsorted(unit, first)), len(unit), most):
            some = unit[at : at + most]
            place = slice(ends[at], ends[at + len(some)])
            word = np.repeat(np.arange(len(some)), np.diff(ends[at : at + len(some) + 1]))
            apart = other[place] != some[word]
            cell = (side[place] * len(some) + word) * size + class_of[other[place]]
            counts = np.bincount(cell[apart], n[place][apart], 2 * len(some) * size)
            after, before = counts.reshape(2, len(some), size)
            itself = ~apart & ~side[place]
            self_n = np.bincount(word[itself], n[place][itself], len(some))
            own = class_of[some].astype(np.int64)
            to = _best(own, after, before, self_n, matrix, movable)
            moved = np.flatnonzero(to != own)
            # Class x moved word: where a word's counts leave, and where they come to.
            onto = np.zeros((size, len(moved)))
            onto[own[moved], np.arange(len(moved))] = -times
            onto[to[moved], np.arange(len(moved))] = times
            matrix += onto @ after[moved] + (onto @ before[moved]).T
            matrix[np.arange(size), np.arange(size)] += onto @ self_n[moved]
            np.maximum(matrix, 0, out=matrix)
            units.append(some[moved])
            goals.append(to[moved])
        none = np.zeros(0, np.int64)
        return (
            np.concatenate([none, *units]).astype(np.uint32),
            np.concatenate([none, *goals]).astype(class_of.dtype),
        )

    return fn


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(word, neighbour, whether that stands before, count) of the entries of blocks, PAIR_TOKENS at once."""
    for batch in batches:
        for unit, ends, other, side, n in _opened(batch):
            unit = np.repeat(unit, np.diff(ends, prepend=0))
            for start in range(0, len(unit), PAIR_TOKENS):
                some = slice(start, start + PAIR_TOKENS)
                yield unit[some], other[some].astype(np.int64), side[some], n[some]


def _cells(class_of, m: int, heavy: int, unit, other, side, n, own) -> np.ndarray:
    """Cells of the class matrix, then of the heavy words' neighbours, then their own pairs.

    ``own``: the entries that stand for their pairs in the class matrix.
    """
    found = np.zeros(m * m + heavy * (2 * m + 1))
    mine, theirs = class_of[unit].astype(np.int64), class_of[other].astype(np.int64)

    def add(at, cell):
        found[:] += np.bincount(cell, n[at], len(found))

    at = np.flatnonzero(own)
    add(at, np.where(side[at], theirs[at] * m + mine[at], mine[at] * m + theirs[at]))
    # Heavy words: their neighbours after them, then before.
    at = np.flatnonzero(side & (other < heavy))
    add(at, m * m + other[at] * m + mine[at])
    at = np.flatnonzero((unit < heavy) & (unit != other))
    add(at, m * m + unit[at] * m + theirs[at])
    at = np.flatnonzero(~side & (other < heavy) & (unit != other))
    add(at, m * m + (heavy + other[at]) * m + mine[at])
    at = np.flatnonzero((unit < heavy) & (unit == other))
    add(at, m * m + 2 * heavy * m + unit[at])
    return found


def _count_classes(shared, m: int, counts: Counts, pairs: bool = False):
    """The cells of all blocks; with ``pairs`` also, after them, the pairs of heavy words."""
    first, heavy = counts.end + 1, counts.heavy

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(m * m + heavy * (2 * m + 1))
        both = np.zeros(heavy * heavy if pairs else 0)
        for unit, other, side, n in _pieces(batches):
            found += _cells(shared.value, m, heavy, unit, other, side, n, ~side | (other < first))
            if pairs:
                at = np.flatnonzero((unit < heavy) & (other < heavy))
                both += np.bincount(unit[at] * heavy + other[at], n[at], len(both))
        found = np.concatenate([found, both])
        at = np.flatnonzero(found)
        yield _batch({"cell": at, "n": found[at]})

    return fn


def _count_changes(shared, moved, m: int, counts: Counts, blocks: int, turns: int, turn: int):
    """What the moves of a round's light words, all of them in its blocks, add to the cells."""
    first, heavy = counts.end + 1, counts.heavy

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(m * m + heavy * (2 * m + 1))
        was = shared.value[0]
        units, goals = moved.value
        now = was.copy()
        now[units] = goals
        changed = now != was
        for unit, other, side, n in _pieces(batches):
            at = np.flatnonzero(changed[unit] | changed[other])
            unit, other, side, n = unit[at], other[at], side[at], n[at]
            # A pair of two words of this round's blocks stands after the first of them too.
            own = ~side | (other < first) | (other % blocks % turns != turn)
            for class_of, sign in ((now, 1), (was, -1)):
                found += sign * _cells(class_of, m, heavy, unit, other, side, n, own)
        at = np.flatnonzero(found)
        yield _batch({"cell": at, "n": found[at]})

    return fn


def _move_heavy(out: np.ndarray, pairs: np.ndarray, m: int, word: int, own: int, to: int) -> None:
    """The cells once one heavy word has moved. ``pairs``: counts of heavy words in a row."""
    heavy = len(pairs)
    matrix = out[: m * m].reshape(m, m)
    around = out[m * m : m * m + 2 * heavy * m].reshape(2, heavy, m)
    itself = out[m * m + 2 * heavy * m + word]
    for c, sign in ((own, -1), (to, 1)):
        matrix[c] += sign * around[0, word]
        matrix[:, c] += sign * around[1, word]
        matrix[c, c] += sign * itself
    others = np.arange(heavy) != word
    for c, sign in ((own, -1), (to, 1)):
        around[0, others, c] += sign * pairs[others, word]
        around[1, others, c] += sign * pairs[word, others]


def _likelihood(matrix: np.ndarray) -> float:
    return float(_f(matrix).sum() - _f(matrix.sum(axis=1)).sum() - _f(matrix.sum(axis=0)).sum())


def exchange(near: DataFrame, class_of: np.ndarray, counts: Counts, classes: int, blocks: int) -> np.ndarray:
    """The classes when few words move. ``near``: the blocks of neighbours, by ``slot``, which is the
    block's number modulo TURNS.

    Class counts are taken from all blocks once; then a round adds what its moves change, from its
    own blocks. The driver gets class counts, the class counts around heavy words, and moves; a move
    is five bytes, and the broadcast classes one byte a word.
    """
    m, movable = classes, classes - SHAPES - 1
    sc = near.sparkSession.sparkContext
    heavy, size = np.arange(counts.heavy), m * m + counts.heavy * (2 * m + 1)

    def summed(cells: DataFrame, size: int) -> np.ndarray:
        got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size)
        out[got["cell"].to_numpy()] = got["n"].to_numpy()
        return out

    class_of = class_of.copy()
    best, reached, moves, turn, turns = class_of.copy(), -np.inf, counts.clustered, 0, TURNS
    undone = False
    if counts.clustered:
        shared = sc.broadcast(class_of)
        out = summed(
            near.mapInArrow(_count_classes(shared, m, counts, pairs=True), "cell long, n double"),
            size + counts.heavy**2,
        )
        shared.destroy()
        out, pairs = out[:size], out[size:].reshape(counts.heavy, counts.heavy)
        best_out = out.copy()
    while counts.clustered:
        matrix = out[: m * m].reshape(m, m)
        if turn == 0:
            now = _likelihood(matrix)
            gained, few = now - reached, moves < FEW_MOVES * counts.clustered
            if undone:
                gained, few, undone = np.inf, False, False
            if gained > 0:
                best, best_out, reached = class_of.copy(), out.copy(), now
            if few or 0 <= gained < LITTLE_GAIN * counts.tokens or turns > MOST_TURNS:
                break
            moves = 0
            if gained < 0:
                # Too many words moved together: the pass is undone, and fewer do.
                class_of, out, turns, undone = best.copy(), best_out.copy(), TURNS * turns, True
                continue
        shared = sc.broadcast((class_of, matrix))
        # Blocks of a round are in one folder, as every number of turns is TURNS times some.
        some = near.where((F.col("slot") == turn % TURNS) & (F.col("block") % turns == turn))
        got = some.mapInArrow(
            _best_classes(shared, movable, counts.end + 1, turns, turn, blocks),
            "unit binary, to binary",
        ).toArrow()
        none = np.zeros(0, np.uint32)
        units = np.concatenate([none, *_numbers(got["unit"], np.uint32)])
        goals = np.concatenate([none.astype(class_of.dtype), *_numbers(got["to"], class_of.dtype)])
        # A third of the heavy words moves in each round.
        mine = heavy[heavy % turns == turn]
        own = class_of[mine].astype(np.int64)
        around = out[m * m : m * m + 2 * counts.heavy * m].reshape(2, counts.heavy, m)
        to = _best(own, around[0, mine], around[1, mine], out[m * m + 2 * counts.heavy * m :][mine],
                   matrix, movable)
        if len(units):
            moved = sc.broadcast((units, goals))
            out = out + summed(
                some.mapInArrow(
                    _count_changes(shared, moved, m, counts, blocks, turns, turn),
                    "cell long, n double",
                ), size,
            )
            moved.destroy()
            class_of[units] = goals
        shared.destroy()
        for word, a, b in zip(mine, own, to, strict=True):
            if a != b:
                _move_heavy(out, pairs, m, word, a, b)
        class_of[mine] = to
        moves += len(units) + int((to != own).sum())
        turn = (turn + 1) % turns
    return best


@dataclass
class Model:
    counts: Counts
    class_of: np.ndarray  # of each word number
    classes: int
    log_next: np.ndarray  # class x class x class: log10 p(third | first, second)
    log_size: np.ndarray  # log10 of the clustered tokens of each class; 0 for shapes and the end


def _count_grams(shared, end: int, m: int):
    """Counts of three classes in a row, as one number each."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, found = shared.value, np.zeros(m**3, np.int64)
        for batch in batches:
            for _, _, stream in _streams(batch, end, 2):
                found += np.bincount(_histories(class_of[stream].astype(np.int64), m), minlength=m**3)
        at = np.flatnonzero(found)
        yield _batch({"key": at, "n": found[at]})

    return fn


def _histories(stream: np.ndarray, m: int) -> np.ndarray:
    """Three classes in a row as one number. Before a text there are only ends (the last class)."""
    first = np.where(stream[1:-1] == m - 1, m - 1, stream[:-2])
    return (first * m + stream[1:-1]) * m + stream[2:]


def _trigram_table(three: np.ndarray) -> np.ndarray:
    """log10 of Witten-Bell probabilities from counts of three classes."""
    m = len(three)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p = (one + 1) / (one.sum() + m)
    for level in (two, three):
        n = level.sum(axis=-1, keepdims=True)
        kinds = (level > 0).sum(axis=-1, keepdims=True)
        weight = np.maximum(n + kinds, 1)
        p = np.where(n > 0, (level + kinds * p) / weight, p)
    return np.log10(p)


def learn(
    docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    classes: int = CLASSES, min_count: int = MIN_COUNT, min_share: float = 0.0,
) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table (h, n, unit) of all training words, and all texts as word numbers.

    Learns from the rows where ``held_out`` is false (all, where it is not given). Null texts are
    empty ones. The driver gets class counts and one byte a clustered word. A caller may bound the
    clustered words by ``min_share`` of the tokens; by default it is 0.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), held_out.alias("held_out"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    dealt = keep(rows.mapInArrow(_deal, _DEALT), "dealt")
    local = keep(
        dealt.select("chunk", "texts")
        .mapInArrow(_count_words, "chunk long, h long, shape int, n long"),
        "chunk_words",
    )
    words = keep(
        local.where("n > 0").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")),
        "words",
    )
    texts = int(dealt.agg(F.sum("train")).first()[0] or 0)
    total = words.agg(F.sum("n"), F.count("*")).first()
    tokens = int(total[0] or 0) + texts
    often = F.col("n") >= max(min_share * tokens, min_count)
    shape_total, discount, log_unknown = np.zeros(SHAPES), np.zeros(SHAPES), np.zeros(SHAPES)
    for r in words.groupBy("shape").agg(
        F.sum(F.when(~often, F.col("n"))).alias("n"), F.count_if(~often).alias("kinds"),
        F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"),
    ).where("kinds > 0").collect():
        d = r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] else 0.5
        d = min(max(d, 0.1), 0.95)
        shape_total[r["shape"]], discount[r["shape"]] = r["n"], d
        log_unknown[r["shape"]] = np.log10(d * r["kinds"] / r["n"])
    numbered, heavy, clustered = _number(words, often, tokens)
    numbered = keep(numbered, "numbers")
    counts = Counts(heavy, clustered, shape_total, discount, log_unknown, tokens,
                    int(total[1]) + (texts > 0), texts)

    answers = (
        local.select("chunk", "h").join(numbered, "h").select("chunk", "h", "unit", "n")
        .mapInArrow(_by_chunk, _ANSWERS)
    )
    coded = keep(
        dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInArrow(_number_chunk(sc.broadcast(counts)), _NUMBERED),
        "numbered_texts", codec="zstd",
    )
    discard(dealt, local, words)
    train = coded.where("not held_out").select("units")
    movable = max(1, min(classes, clustered))
    m = movable + SHAPES + 1
    # The most frequent words have a class each, all others the last one.
    class_of = np.full(counts.units, movable - 1, np.min_scalar_type(m - 1))
    top = numbered.where(~F.col("unit").between(heavy, counts.end)).orderBy(F.desc("n"), "h")
    for rank, r in enumerate(top.limit(movable - 1).collect()):
        class_of[r["unit"]] = rank
    class_of[heavy : counts.end + 1] = movable + np.arange(SHAPES + 1)
    blocks = MOST_TURNS * (1 + tokens // (MOST_TURNS * BLOCK_TOKENS))
    kind = "block long, size long, step binary, other binary, n binary"
    near = keep(
        train.mapInArrow(_pairs(counts, blocks), kind).groupBy("block")
        .applyInArrow(_merge, "block long, unit binary, ends binary, other binary, n binary")
        .withColumn("slot", (F.col("block") % TURNS).cast("int")),
        "neighbours", "slot", codec="zstd",
    )
    class_of = exchange(near, class_of, counts, m, blocks)
    grams = train.mapInArrow(_count_grams(sc.broadcast(class_of), counts.end, m), "key long, n long")
    got = grams.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(m**3)
    three[got["key"].to_numpy()] = got["n"].to_numpy()
    three = three.reshape(m, m, m)
    log_size = np.log10(np.maximum(three.sum(axis=(0, 1)), 1))
    log_size[movable:] = 0
    return Model(counts, class_of, m, _trigram_table(three), log_size), numbered, coded


def _score(shared):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        log_next = model.log_next.reshape(-1)
        for batch in batches:
            for start, size, units in _streams(batch, model.counts.end, 2):
                part = batch.slice(start, size)
                base, fixed, n = (
                    part.column(c).to_numpy(zero_copy_only=False) for c in ("base", "fixed", "n_tokens")
                )
                stream = model.class_of[units].astype(np.int64)
                step = log_next[_histories(stream, model.classes)] - model.log_size[stream[2:]]
                # The last step of each text is its end.
                score = fixed + np.add.reduceat(step, np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("held_out"), part.column("n_tokens"),
                    part.column("n_known"), pa.array(np.full(size, model.counts.tokens)),
                    pa.array(base), pa.array(score),
                    pa.array(10 ** np.minimum(-score / n, 300)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                    "score", "perplexity"])

    return fn


def score(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """One row of SCORES for every row of ``docs``, learned from those where ``held_out`` is false.

    A null or empty text is its end alone; null ids stay null; repeated rows are scored each.
    Other columns are not read, whatever their names. The scores are a function of the rows alone.
    """
    model, _, coded = learn(docs, held_out, doc_id, text, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return coded.mapInArrow(_score(shared), SCORES)
