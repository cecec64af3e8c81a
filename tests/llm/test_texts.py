"""Language model, packing, quotations and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martwright.llm import best_fit_packing, brown_ngrams, quote_links
from martwright.llm.queries import QUERIES, message_id
from martwright.llm.rows import fold_of
from tests.conftest import SMALL


def test_brown_scores(spark):
    rng = random.Random(1)
    kinds = [["the", "a", "some"], ["dog", "cat", "cow"], ["eats", "sees", "likes"]]
    rows = [(i, " ".join(rng.choice(kinds[k % 3]) for k in range(rng.randint(3, 30))), "x")
            for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (None, "The DOG", "x"), (302, "zzz qqq. 12", "x"),
             (303, "dog " * 50_000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = fold_of(F.col("doc_id"), 7) == 2
    got = brown_ngrams.score(docs, held, classes=4, min_share=1 / 1000).collect()
    assert len(got) == len(rows)
    kept = docs.withColumn("h", held).collect()
    counts, texts = Counter(), 0
    for r in kept:
        if not r["h"]:
            counts.update((r["text"] or "").encode().lower().split())
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    by_id = {(r["doc_id"], (r["text"] or "")): r for r in kept}
    want = Counter()
    for doc_id, text in by_id:
        words = [*text.encode().lower().split(), None]
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        want[(doc_id, len(words), sum(counts[w] > 0 for w in words), round(float(base), 4))] += 1
    found = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got}
    assert found == set(want)
    assert all(r["train_tokens"] == total and np.isfinite(r["score"]) for r in got)
    held_rows = [r for r in got if r["held_out"] and r["n_tokens"] < 100]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows) + 1
    empty = brown_ngrams.score(docs.limit(0), held)
    assert empty.count() == 0


def test_probabilities_of_the_next_word_add_to_one(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame(
        [(i, " ".join(rng.choices(["a", "b", "c", "dd", "e.", "rare" + str(i)], k=12))) for i in range(80)],
        "doc_id long, text string",
    )
    model, words, _ = brown_ngrams.learn(docs, classes=3, min_share=1 / 60)
    counts = model.counts
    for history in [(0, 1), (model.classes - 1, model.classes - 1), (2, 0)]:
        nexts = 10 ** model.log_next[history]
        assert nexts.sum() == pytest.approx(1)
    inside, rare = Counter(), 0
    for r in words.collect():
        if counts.heavy <= r["unit"] < counts.end:
            rare += 1
        else:
            of = int(model.class_of[r["unit"]])
            inside[of] += 10 ** (np.log10(r["n"]) - model.log_size[of])
    assert inside and list(inside.values()) == pytest.approx([1] * len(inside))
    for shape in np.flatnonzero(counts.shape_total):
        seen = 10 ** counts.log_unknown[shape] * counts.shape_total[shape] / counts.discount[shape]
        known = counts.shape_total[shape] - counts.discount[shape] * round(seen)
        assert known / counts.shape_total[shape] + 10 ** counts.log_unknown[shape] == pytest.approx(1)
    assert rare > 0


def test_rare_words_are_in_learned_classes(spark):
    rng = random.Random(3)
    # 30,000 words of three occurrences or so, of one shape; the word before tells their kind.
    rows = [(i, " ".join(f"{k} {k}{rng.randrange(15_000):05d}" for k in rng.choices("xy", k=50)))
            for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, numbered, _ = brown_ngrams.learn(docs, classes=4)
    counts = Counter(w for _, text in rows for w in text.encode().split())
    known = model.counts
    assert known.clustered == sum(n > 1 for n in counts.values()) > 20_000
    unit_of = {r["h"]: r["unit"] for r in numbered.collect()}
    rare = sum(known.heavy <= u < known.end for u in unit_of.values())
    assert rare == sum(n == 1 for n in counts.values())
    clustered = [u for u in unit_of.values() if not known.heavy <= u < known.end]
    assert sorted([*clustered, *range(known.heavy, known.end + 1)]) == list(range(known.units))
    words = sorted(w for w, n in counts.items() if n > 1 and len(w) > 1)
    _, hashes, _ = brown_ngrams._words(pa.array([b" ".join(words).decode()], pa.large_string()))
    classes = model.class_of[[unit_of[h] for h in hashes.view(np.int64).tolist()]]
    assert classes.max() < 4
    kinds = Counter((w[:1], int(c)) for w, c in zip(words, classes, strict=True))
    pure = sum(max(kinds[(b"x", c)], kinds[(b"y", c)]) for c in range(4))
    assert pure > 0.99 * len(words)


def test_class_counts_of_the_blocks_are_those_of_the_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = spark.createDataFrame(
        [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for i in range(200)]
        + [(200, "the " * 5000)], "doc_id long, text string",
    )
    model, numbered, coded = brown_ngrams.learn(docs, classes=5)
    counts, m = model.counts, model.classes
    assert 0 < counts.heavy < counts.clustered
    pairs, triples = Counter(), Counter()
    for r in coded.collect():
        units = [counts.end, counts.end, *np.frombuffer(r["units"], np.uint32).tolist(), counts.end]
        of = [int(model.class_of[u]) for u in units]
        pairs.update(zip(units[1:], units[2:]))
        triples.update(zip(of, of[1:], of[2:]))
    entries = [
        brown_ngrams._merge(pa.Table.from_batches([b]).filter(pa.compute.equal(b["block"], x)))
        for b in brown_ngrams._pairs(counts, 7)(iter([pa.RecordBatch.from_pandas(
            coded.select("units").toPandas())]))
        for x in b["block"].to_pylist()
    ]
    shared = type("Shared", (), {"value": model.class_of})
    batches = (b for t in entries for b in t.to_batches())
    found = np.zeros(m * m + counts.heavy * (2 * m + 1))
    for b in brown_ngrams._count_classes(shared, m, counts)(batches):
        found[b["cell"].to_numpy()] += b["n"].to_numpy()
    want = np.zeros_like(found)
    for (u, v), n in pairs.items():
        a, b = int(model.class_of[u]), int(model.class_of[v])
        want[a * m + b] += n
        if u == v and u < counts.heavy:
            want[m * m + 2 * counts.heavy * m + u] += n
        if u != v and u < counts.heavy:
            want[m * m + u * m + b] += n
        if u != v and v < counts.heavy:
            want[m * m + (counts.heavy + v) * m + a] += n
    assert found.tolist() == want.tolist()
    three = np.zeros((m, m, m))
    for (a, b, c), n in triples.items():
        three[a, b, c] += n
    assert np.allclose(brown_ngrams._trigram_table(three), model.log_next)


def test_brown_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = fold_of(F.col("doc_id"), 7) == 2
    results = []
    for partitions, order in ((1, "doc_id"), (8, "text"), (23, F.xxhash64("doc_id"))):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            dealt = docs.orderBy(order).repartition(partitions)
            rows = brown_ngrams.score(dealt, held, classes=12).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        results.append({r["doc_id"]: round(r["score"], 6) for r in rows})
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == docs.count()


def test_best_class_is_that_of_the_highest_likelihood():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 4, (12, 12)).astype(float)
    class_of = rng.integers(0, 4, 12)
    class_of[10:] = [4, 5]  # not movable

    def matrix(of):
        return np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(6)] for a in range(6)])

    onto = np.eye(6)[class_of]
    apart = pairs * (1 - np.eye(12))
    got = brown_ngrams._best(
        class_of[:10], (apart @ onto)[:10], (apart.T @ onto)[:10], np.diag(pairs)[:10].copy(),
        matrix(class_of), 4,
    )
    for word in range(10):
        reached = []
        for c in range(4):
            other = class_of.copy()
            other[word] = c
            reached.append(brown_ngrams._likelihood(matrix(other)))
        assert reached[got[word]] == pytest.approx(max(reached))


def brute_best_fit(sizes, opened, capacities, cost):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += size
        else:
            bins.append([best_fit_packing._open_for(size, opened, cost), size])
    return sum(cost(min(c for c in capacities if c >= used)) for _, used in bins)


def test_plan_is_item_by_item_best_fit():
    rng = random.Random(3)
    cost = best_fit_packing._default_cost
    for _ in range(40):
        capacities = sorted(rng.sample([8, 12, 16, 24, 32, 64], 3))
        sizes = [rng.randint(1, capacities[-1]) for _ in range(rng.randint(1, 120))]
        plans = [(*some, capacities[-1]) for some in [(), capacities[:1], capacities[1:2], capacities[:2]]]
        plan = best_fit_packing.plan_packing(Counter(sizes), capacities, cost)
        assert plan.cost <= min(brute_best_fit(sizes, p, capacities, cost) for p in plans) + 1e-9
    nothing = best_fit_packing.plan_packing({}, [8, 16])
    assert nothing.cost == 0


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i // 2, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, 30, 100, 257])), "x") for i in range(400)]
    rows += [(None, "w w", "x"), (7, None, "x"), (8, " \n ", "x"), (9, "w " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    packed = best_fit_packing.pack(docs, capacities=(16, 64, 128)).collect()
    words = Counter()
    for doc_id, text, _ in rows:
        words[doc_id] += len((text or "").split())
    found, content = Counter(), {}
    for r in packed:
        found[r["doc_id"]] += r["n_words"]
        if r["bin"] is None:
            assert r["n_words"] == 0
        else:
            content.setdefault((r["bin"], r["capacity"]), []).append((r["place"], r["n_words"]))
    assert found == words
    for (_, capacity), parts in content.items():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= capacity and capacity == min(c for c in (16, 64, 128) if c >= at)
    assert len({b for b, _ in content}) == len(content)
    used = sum(n for parts in content.values() for _, n in parts)
    assert used / sum(c for _, c in content) > 0.9
    bins = best_fit_packing.bins(best_fit_packing.pack(docs, capacities=(16, 64, 128)))
    assert bins.count() == len(content)
    assert best_fit_packing.pack(docs.limit(0)).count() == 0


MAIL = [
    (1, "Shall we meet?\n\nAt noon?"),
    (2, "Yes.\n\nOn Monday Ann wrote:\n> Shall  we meet?\n>\n> At noon?"),
    (3, "Noon it is\n\n> On Monday Ann wrote:\n>> At noon?\n> Yes."),
    (4, "> nobody said this\nHm"),
    (5, "> Noon IT is\nFine\n>> Shall we meet?"),
    (6, None), (7, ""), (8, "> Later words"), (9, "Later words"), (None, "> Yes."),
    (2, "Yes.\n\nOn Monday Ann wrote:\n> Shall  we meet?\n>\n> At noon?"),
    (10, "Shall we meet?"), (11, ">Shall we meet?\n> > At noon?\nok"),
]


def test_conversations(spark):
    mail = spark.createDataFrame([(*r, 1) for r in MAIL], "msg_id long, text string, body int")
    got = {r["message_id"]: r for r in quote_links.conversations(mail).collect()}
    assert sorted(got) == list(range(1, 12))
    assert {k: r["parent_id"] for k, r in got.items()} == {
        1: None, 2: 1, 3: 2, 4: None, 5: 3, 6: None, 7: None, 8: None, 9: None, 10: None, 11: 1}
    assert [got[k]["conversation_id"] for k in (1, 2, 3, 5, 11)] == [1] * 5
    assert [got[k]["depth"] for k in (1, 2, 3, 5, 11)] == [0, 1, 2, 3, 1]
    assert [got[k]["position"] for k in (1, 2, 3, 5, 11)] == [0, 1, 2, 3, 4]
    assert got[2]["body"] == "Yes." and got[5]["body"] == "Fine" and got[4]["body"] == "Hm"
    assert got[1]["body"] == "Shall we meet?\n\nAt noon?" and got[6]["body"] == ""
    assert quote_links.conversations(mail.limit(0)).count() == 0


def test_a_common_answer_keeps_its_thread(spark):
    """Two threads that both say "Yes.", and a third that asks later and quotes deeper."""
    mail = [(1, "Tea?"), (2, "Yes.\n\n> Tea?"), (11, "Coffee?"), (12, "Yes.\n\n> Coffee?"),
            (13, "Good.\n\n> Yes."), (14, "Fine.\n\n> Yes.\n>> Tea?"), (15, "Late.\n\n> Tea?\n>\n> Coffee?")]
    for common in (0, 1, 16):
        lines = quote_links.parsed_lines(spark.createDataFrame(mail, "msg_id long, text string"))
        got = {r["id"]: r["parent"] for r in
               quote_links.parents(quote_links.passages(lines), common).collect()}
        assert got == {2: 1, 12: 11, 13: 12, 14: 2, 15: 11}


def plain_parents(held, common):
    n = Counter((p, lev) for _, lev, p in held)
    out = {}
    for i in {x[0] for x in held}:
        pairs, found = set(), set()
        for _, level, p in [x for x in held if x[0] == i and x[1] > 0]:
            for lev in {0, level - 1}:
                who = sorted(h for h, hl, hp in held if hp == p and hl == lev and h < i)
                pairs |= {(h, level, p) for h in who}
                found |= set(who if n[p, lev] <= common else who[-1:])
        agreed = {x for x in pairs if x[0] in found}
        scores = []
        for h in {x[0] for x in agreed}:
            levels = Counter(level for x, level, _ in agreed if x == h)
            scores.append((-min(levels), levels[min(levels)], sum(levels.values()), h))
        if scores:
            out[i] = max(scores)[3]
    return out


@pytest.mark.parametrize("common", [0, 2, 50])
def test_parents_as_stated(spark, common, monkeypatch):
    monkeypatch.setattr(quote_links, "SPAN_BITS", 3)
    rng = random.Random(common)
    held = {(rng.randrange(90), rng.choice([0, 0, 1, 1, 2, 3]), rng.choice("abcdefghij"))
            for _ in range(300)}
    df = spark.createDataFrame(sorted(held), "id long, level int, print string")
    got = {r["id"]: r["parent"] for r in quote_links.parents(df, common).collect()}
    assert got == plain_parents(held, common)


@pytest.mark.parametrize("seed", [1, 2])
def test_common_passages_lose_no_candidate(spark, seed, monkeypatch):
    monkeypatch.setattr(quote_links, "SPAN_BITS", 3)
    rng = random.Random(seed)
    held = {(rng.randrange(90), rng.choice([0, 0, 1, 1, 2, 3]), rng.choice("abcdefghij"))
            for _ in range(400)}
    df = spark.createDataFrame(sorted(held), "id long, level int, print string")
    got = {r["id"]: r["parent"] for r in quote_links.parents(df, seed - 1, whole=True).collect()}
    assert got == plain_parents(held, 1000)


def test_two_common_passages_find_who_says_both(spark):
    mail = [(i, "Yes.") for i in range(20)] + [(i, "Thanks.") for i in range(20, 40)]
    mail += [(40, "Yes.\n\nThanks."), (41, "Yes."), (42, "Thanks."),
             (43, "So be it.\n\n> Yes.\n>\n> Thanks."), (44, "Why?\n\n> Thanks.")]
    got = quote_links.conversations(spark.createDataFrame(mail, "msg_id long, text string"))
    got = {r["message_id"]: r["parent_id"] for r in got.collect() if r["parent_id"] is not None}
    assert got == {43: 40, 44: 42}


def test_a_very_long_message(spark):
    text = "\n\n".join(f"> part {i}" for i in range(3000)) + "\n" + "x" * 300_000
    mail = [(1, "\n\n".join(f"part {i}" for i in range(3000))), (2, text)]
    got = quote_links.conversations(spark.createDataFrame(mail, "msg_id long, text string")).collect()
    assert {r["message_id"]: (r["parent_id"], len(r["body"])) for r in got} == {
        1: (None, len(mail[0][1])), 2: (1, 300_000)}


def test_long_conversations_do_not_run_into_others(spark, tmp_path):
    rows = [(1, t, "user", f"first says {t}") for t in range(-2, 1203)]
    rows += [(2, t, "user", f"second says {t}") for t in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op1_quote_links"](spark, str(tmp_path)).collect()
    assert sorted(r["body"] for r in got) == sorted(r[3] for r in rows)
    body = {r["message_id"]: r["body"] for r in got}
    assert len(body) == len(rows)
    replies = {r["body"]: body.get(r["parent_id"]) for r in got}
    before = {(c, t): text for c, t, _, text in rows}
    assert replies == {text: before.get((c, t - 1)) for c, t, _, text in rows}
    places = {r["body"]: r["position"] for r in got}
    assert places == {text: t + 2 if c == 1 else t for c, t, _, text in rows}
    assert {2000 + t for t in range(300)} < set(body)
    beyond = spark.range(1).select(message_id(F.lit(1 << 40), F.lit(1000)))
    with pytest.raises(Exception, match="too large"):
        beyond.collect()


def test_long_chain_and_broad_star(spark):
    rows = [(0, "start")]
    rows += [(i, f"say {i}\n> {'start' if i == 1 else f'say {i - 1}'}") for i in range(1, 70)]
    rows += [(i, f"to all {i}\n> start") for i in range(100, 400)]
    got = quote_links.conversations(spark.createDataFrame(rows, "msg_id long, text string"))
    by_id = {r["message_id"]: r for r in got.collect()}
    assert {r["conversation_id"] for r in by_id.values()} == {0}
    assert all(by_id[i]["depth"] == i for i in range(70)) and by_id[399]["depth"] == 1
    assert sorted(r["position"] for r in by_id.values()) == list(range(370))


def test_no_python_in_the_plan(spark):
    mail = spark.createDataFrame(MAIL, "msg_id long, text string")
    plan = quote_links.conversations(mail)._jdf.queryExecution().executedPlan().toString()
    lines = quote_links.passages(quote_links.parsed_lines(mail))
    plan += lines._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        path = spark.conf.get("spark.checkpoint.dir") + f"/test-{name}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL)
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_pipeline_of_awkward_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0),
            (3, "word " * 40_000, "en", "s", 5), (3, "word " * 40_000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, str(tmp_path)).count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
