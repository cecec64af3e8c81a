"""Operators on pairs and passages, against brute force: near duplicates, vectors, repeats."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martwright.llm import dart_minhash, itq_hamming, sparse_suffixes, tables
from martwright.llm.queries import table
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, class_id string"


def prose(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("xyzuvw") + str(rng.randint(0, 40)) for _ in range(n)]


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_counts(text):
    words = (text or "").lower().encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def alike(a, b):
    both = sum((a & b).values())
    return bool(both) and both / sum((a | b).values()) >= 0.8


def brute_classes(rows):
    sets = {i: shingle_counts(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    return union(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if alike(sets[a], sets[b])])


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = prose(rng, rng.randint(1, 120))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    # A large group in which not everyone is near everyone.
    base = prose(rng, 150)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"odd{rng.randint(0, 10**6)}"
        rows.append((len(rows), "  ".join(copy).upper()))
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (0, rows[0][1]),
            (n + 5, "rep " * 30_000), (n + 6, "rep " * 30_000)]


def test_near_duplicates(spark, near_rows):
    rows = [(*r, "clash") for r in near_rows] + [(None, near_rows[0][1], "clash")]
    found = dart_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    want = brute_classes(near_rows)
    for r in found:
        assert r["class_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"])


def test_filter_keeps_one_of_each(spark, near_rows):
    rows = [(*r, "clash") for r in near_rows] + [(None, "x", "clash")]
    df = spark.createDataFrame(rows, SCHEMA)
    left = dart_minhash.filter_near_duplicates(df)
    assert left.columns == df.columns
    want = brute_classes(near_rows)
    ids = sorted(r["doc_id"] for r in left.where("doc_id is not null").collect())
    assert ids == sorted(i for i, c in want.items() if i == c)
    assert left.where("doc_id is null").count() == 1
    assert dart_minhash.filter_near_duplicates(df.limit(0)).count() == 0


def test_collisions_are_as_frequent_as_weighted_similarity():
    rng = np.random.default_rng(5)
    element = rng.integers(0, 2**63, 40, dtype=np.uint64)
    a, b = rng.uniform(0.2, 9, 40), rng.uniform(0.2, 9, 40)
    b[:25] = a[:25]
    signs = dart_minhash.signatures(
        np.repeat([0, 1], 40), np.concatenate([element, element]), np.concatenate([a, b]), 2, 4000
    )
    share = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signs[0] == signs[1]).mean() - share) < 0.03
    assert (signs != 0).all()


def test_similarities():
    pairs = [("a b c d e f", "a b c d e f"), ("a b c d e f g", "a b c d e f h"), ("", "a"), ("x", "X")]
    left, right = (pa.array(s, pa.large_string()) for s in zip(*pairs, strict=True))
    got = dart_minhash.similarities(left, right)
    assert got.tolist() == pytest.approx([1.0, 0.5, 0.0, 1.0])


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    pairs += [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(40)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    want = union({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["component"] for r in tables.components(edges).collect()}
    assert got == {n: want[n] for n in nodes}
    assert tables.components(edges.limit(0)).count() == 0


def brute_spans(rows, passage=50):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        words, spans = text.lower().encode().split(), []
        for a in range(len(words) - passage + 1):
            gram = tuple(words[a : a + passage])
            if gram not in seen:
                seen.add(gram)
            elif spans and a <= spans[-1][1]:
                spans[-1][1] = a + passage
            else:
                spans.append([a, a + passage])
        if spans:
            out[i] = spans
    return out


@pytest.fixture(scope="module")
def passage_rows():
    rng = random.Random(12)
    shared = [prose(rng, rng.randint(45, 130)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            cut = rng.randint(0, 10)
            words += part[cut : len(part) - rng.randint(0, 10)] + prose(rng, rng.randint(0, 30))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(60, rows[3][1]), (61, "na " * 300), (62, None), (63, ""), (64, "É " + rows[5][1].upper())]
    return rows


def test_repeated_passages(spark, passage_rows):
    df = spark.createDataFrame([(*r, "x") for r in passage_rows] + [(None, passage_rows[3][1], "x")],
                               "doc_id long, text string, spans string")
    found = sparse_suffixes.repeated_passages(df)
    got = {r["doc_id"]: [[s["start"], s["end"]] for s in r["spans"]] for r in found.collect()}
    assert got == brute_spans(passage_rows)
    assert sparse_suffixes.repeated_passages(df.limit(0)).count() == 0


def test_cut(spark, passage_rows):
    df = spark.createDataFrame([(*r, 7) for r in passage_rows], "doc_id long, text string, n_chars int")
    spans = sparse_suffixes.repeated_passages(df)
    left = sparse_suffixes.cut_repeats(df, spans, size="n_chars")
    assert left.schema == df.schema
    want, texts = brute_spans(passage_rows), dict(passage_rows)
    for row in left.collect():
        if row["doc_id"] not in want:
            assert row["text"] == texts[row["doc_id"]] and row["n_chars"] == 7
            continue
        words = texts[row["doc_id"]].split()
        gone = {j for a, b in want[row["doc_id"]] for j in range(a, b)}
        assert row["text"].split() == [w for j, w in enumerate(words) if j not in gone]
        assert row["n_chars"] == len(row["text"])
    again = sparse_suffixes.repeated_passages(left.where("doc_id < 60"))
    assert again.count() <= spans.count()


def brute_vectors(rows):
    good = {i: np.array(v, float) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    degree = defaultdict(int)
    for pair in links:
        for x in pair:
            degree[x] += 1
    return degree, union([r[0] for r in rows], links)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + 0.15 * rng.standard_normal(32)).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(3)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 32), (n + 3, [float("nan")] * 32),
             (n + 4, [1.0, None, *[0.0] * 30]), (n + 5, [float("inf")] * 32), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, cosine double")
    found = {r["vec_id"]: r for r in itq_hamming.near_vectors(df).collect()}
    degree, component = brute_vectors(rows)
    assert len(found) == len(rows)
    assert {i: r["n_links"] for i, r in found.items()} == {i: degree[i] for i, _ in rows}
    assert {i: r["component_id"] for i, r in found.items()} == component
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert itq_hamming.near_vectors(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_cut_by_themselves(spark):
    """Texts under one id, one shorter than the other's spans; equal rows are one."""
    said = [f"w{i}" for i in range(140)]
    rows = [(1, " ".join(said)), (2, "short text"), (2, "before " + " ".join(said[:120])),
            (2, "before " + " ".join(said[:120])), (2, "a b " + " ".join(said[60:]) + " end"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sparse_suffixes.repeated_passages(df)
    assert sorted((r.doc_id, [(x.start, x.end) for x in r.spans]) for r in spans.collect()) == [
        (2, [(1, 121)]), (2, [(2, 82)])]
    left = sorted((r.doc_id, r.text) for r in sparse_suffixes.cut_repeats(df, spans).collect() if r.text)
    assert left == [(1, " ".join(said)), (2, "a b end"), (2, "before "), (2, "before "), (2, "short text")]


def test_blocks_count_as_the_exact_comparison(spark):
    """Elements have 64 bits and one text's weight is that of its occurrences."""
    import pyarrow as pa

    texts = ["a b c d e f " * 30, "a b c d e f g", None, ""]
    lists = dart_minhash._elements(pa.array(texts)).to_pylist()
    assert [len(x) for x in lists] == [max(0, len((t or "").split()) - 4) for t in texts]
    assert all(len(set(x)) == len(x) for x in lists)
    assert max(abs(v) for x in lists for v in x) > 1 << 40


def test_vectors_of_extreme_size_and_shared_ids(spark):
    """Components whose squares vanish or overflow, a constant table, ids that say two things."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(i, (s * (base + 0.05 * rng.standard_normal(8))).tolist())
            for i, s in enumerate((1e-200, 1e200, 1.0, 5e-324 * 1e16, 1e300, -1e-200))]
    rows += [(6, (base * 2).tolist()), (6, rng.standard_normal(8).tolist()), (None, base.tolist()),
             (None, (-base).tolist()), (7, [1e-200] * 8), (8, [1e200] * 8), (9, [0.0, -0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept)
                  for r in itq_hamming.near_vectors(df).collect()), key=str)
    units = [np.array(x) / np.abs(x).max() if any(x) else None for _, x in rows]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None
             and units[i] @ units[j] >= 0.9] for i in range(len(rows))]
    want = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids, default=None)
        want.append((vec_id, len(near[i]), component, component is None or vec_id == component))
    want = [(a, b, c, bool(d) if a is not None else c is None) for a, b, c, d in want]
    assert got == sorted(want, key=str)
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in itq_hamming.near_vectors(one).collect()] == [(1, 0, 1, True)]


def test_tables_grow_with_the_vectors_and_buckets_do_not():
    for n in (10, 10**5, 10**8):
        part, parts, apart = itq_hamming.layout(n, 0.9)
        assert n / 2**part <= 1
        flip = np.arccos(0.9) / np.pi
        assert 1 - (1 - (1 - flip) ** part) ** parts >= itq_hamming.RECALL - 1e-9
        assert 30 < apart < 50


def test_recall_on_clusters_of_every_nearness(spark):
    """Cosines from the limit to equality, against brute force."""
    rng = np.random.default_rng(8)
    x = np.concatenate([
        rng.standard_normal(64) + spread * rng.standard_normal((5, 64))
        for spread in np.linspace(0.05, 0.36, 150)
    ]).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = int((unit @ unit.T >= 0.9).sum()) - len(x)
    got = itq_hamming.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert want > 1000 and 0.95 * want <= got <= want


def test_vector_recall_at_the_limit(spark):
    """Pairs whose cosine is just above the limit, against brute force."""
    rng = np.random.default_rng(4)
    rows, want = [], 0
    for i in range(400):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.9005 * a + np.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, c.tolist())]
        want += 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = itq_hamming.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert got <= want and got >= 0.9 * want


def test_on_the_small_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = dart_minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows)
    spans = sparse_suffixes.repeated_passages(docs).collect()
    assert {r["doc_id"]: [[s["start"], s["end"]] for s in r["spans"]] for r in spans} == brute_spans(rows)
