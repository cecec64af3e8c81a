"""Brown n-grams: memory of counting pairs, class counts kept up to date by a round's moves."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from martwright.llm import brown_ngrams
from martwright.llm.tables import discard, keep


def shared(value):
    return type("Shared", (), {"value": value})


def counts_of(heavy, clustered):
    none = np.zeros(brown_ngrams.SHAPES)
    return brown_ngrams.Counts(heavy, clustered, none, none, none, 0, 0, 0)


def blocks_of(batches, counts, blocks):
    rows = pa.Table.from_batches(list(brown_ngrams._pairs(counts, blocks)(iter(batches))))
    return {
        block: brown_ngrams._merge(rows.filter(pa.compute.equal(rows["block"], block)))
        for block in sorted(set(rows["block"].to_pylist()))
    }


def texts_of(*texts):
    return pa.RecordBatch.from_pydict({"units": pa.array([x.tobytes() for x in texts], pa.binary())})


def test_memory_of_pairs_does_not_grow_with_the_texts_of_a_task():
    counts = counts_of(50, 400_000)
    rng = np.random.default_rng(1)
    batches = [texts_of(*rng.integers(0, counts.units, (900, 1000)).astype(np.uint32)) for _ in range(4)]
    tracemalloc.start()
    try:
        n = sum(batch.num_rows for batch in brown_ngrams._pairs(counts, 81)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n >= 81
    assert peak < 300e6


@pytest.mark.parametrize("turns", [3, 9])
def test_changes_of_a_round_give_the_counts_of_all_blocks(turns):
    rng = np.random.default_rng(turns)
    counts, blocks, m = counts_of(7, 300), 27, 5 + brown_ngrams.SHAPES + 1
    texts = [(rng.zipf(1.3, rng.integers(0, 60)) % counts.units).astype(np.uint32) for _ in range(400)]
    near = blocks_of([texts_of(*texts)], counts, blocks)
    first, size = counts.end + 1, m * m + counts.heavy * (2 * m + 1)

    def all_cells(class_of):
        batches = (b for t in near.values() for b in t.to_batches())
        out = np.zeros(size + counts.heavy**2)
        for b in brown_ngrams._count_classes(shared(class_of), m, counts, pairs=True)(batches):
            out[b["cell"].to_numpy()] = b["n"].to_numpy()
        return out[:size], out[size:].reshape(counts.heavy, counts.heavy)

    class_of = rng.integers(0, 5, counts.units).astype(np.uint8)
    class_of[counts.heavy : first] = 5 + np.arange(brown_ngrams.SHAPES + 1)
    out, pairs = all_cells(class_of)
    plain = Counter()
    for text in texts:
        units = [counts.end, *text.tolist(), counts.end]
        plain.update(zip(units, units[1:]))
    assert pairs.tolist() == [[plain[u, v] for v in range(7)] for u in range(7)]
    for turn in range(turns):
        light = np.arange(first, counts.units)
        light = light[light % blocks % turns == turn]
        units = rng.choice(light, len(light) // 2, replace=False).astype(np.uint32)
        goals = rng.integers(0, 5, len(units)).astype(np.uint8)
        some = (b for k, t in near.items() if k % turns == turn for b in t.to_batches())
        for b in brown_ngrams._count_changes(
            shared((class_of, None)), shared((units, goals)), m, counts, blocks, turns, turn
        )(some):
            out[b["cell"].to_numpy()] += b["n"].to_numpy()
        class_of[units] = goals
        for word in rng.choice(7, 4, replace=False):
            to = int(rng.integers(0, 5))
            brown_ngrams._move_heavy(out, pairs, m, word, int(class_of[word]), to)
            class_of[word] = to
        assert out.tolist() == all_cells(class_of)[0].tolist()


def test_discarded_tables_are_gone(spark):
    kept, other = (keep(spark.range(10).withColumnRenamed("id", "k"), "some") for _ in range(2))
    assert kept.count() == 10
    discard(kept)
    assert other.count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|No such file"):
        kept.count()
