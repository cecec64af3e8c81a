"""Operators that judge or rewrite each row by itself: codec, toxicity, quality, language."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import bpe_tree, compression_bands, cross_parsing, kn_toxicity
from martwright.llm.queries import QUERIES

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

HARD = [None, "", " \n\t", "a", "x" * 30_000, "word " * 20_000, "Ünï çødé 日本語 ‍👩‍🚀", "same", "same"]

SF = "/root/testdata/sf0.01"


def frame(spark, texts, **more):
    """Rows with a null id, a repeated id and a clashing extra column."""
    rows = [(None if i == 0 else i // 2, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def codec():
    ranks = bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe_tree.Codec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )


def test_codec_as_the_library(codec, library):
    rng = random.Random(3)
    alphabet = "aab bcé ñ日本\n\t  012'sstion.,!?THEthe‍👩"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 4000, "ab" * 999, "= " * 300, "\n" * 500, "日本" * 400, "<|endoftext|>"]
    for text in texts:
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_join_is_the_encoding_of_the_joined_bytes(codec):
    rng = random.Random(4)
    for _ in range(2000):
        data = "".join(rng.choice("thesinga er") for _ in range(rng.randint(2, 40))).encode()
        cut = rng.randint(0, len(data))
        whole = codec.join(codec.merge(data[:cut]), codec.merge(data[cut:]))
        assert whole == codec.merge(data)


def test_codec_columns(spark, codec, library):
    shared = bpe_tree.share(spark, codec.ranks, public_tokenizers.PATTERN)
    df = bpe_tree.with_bytes(bpe_tree.with_tokens(frame(spark, HARD), shared), shared)
    for row in df.collect():
        ids = library.encode_ordinary(row["text"] or "")
        assert row["ids"] == ids and bytes(row["bytes"]) == (row["text"] or "").encode()
    assert bpe_tree.with_tokens(frame(spark, HARD).limit(0), shared).count() == 0


def test_digest_of_ids_as_text(spark):
    df = spark.createDataFrame([([1, 22, 333],), ([],)], "ids array<int>")
    listed = F.expr("trim(BOTH '[]' FROM replace(cast(ids AS string), ',', ''))")
    assert [r[0] for r in df.select(listed).collect()] == ["1 22 333", ""]
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(listed, 256)).collect()[1][0]


def brute_quality(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {
        j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)
    }
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def test_quality_counts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "é#", "c|d", "\n", "x\ny"]) for _ in range(rng.randint(0, 90)))
             for _ in range(60)] + [None, "", "\n\n", "a\x0bb\x0cc d\x85e"]
    rows = compression_bands.with_quality(frame(spark, texts)).collect()
    for row in rows:
        q = row["quality_rules"]
        got = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"])
        assert got == brute_quality(row["text"])
        assert q["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (q["kept"] and q["base_failed"])


def test_quality_bands(spark):
    rng = random.Random(6)
    prose = " ".join("".join(rng.choice(["an", "re", "ti", "on", "sh"]) for _ in range(rng.randint(1, 4)))
                     for _ in range(400))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(600))
    mixed = prose + " " + noise + " " + noise[::-1]
    same = "\n".join(f"{i} all work and no play makes a dull day of it" for i in range(400))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, same), (4, mixed)], "doc_id long, text string")
    kept = {r["doc_id"] for r in compression_bands.filter_quality(df).collect()}
    assert kept == {1}
    hard = compression_bands.with_quality(frame(spark, HARD)).collect()
    assert len(hard) == len(HARD) and not any(r["quality_rules"]["kept"] for r in hard)
    assert compression_bands.filter_quality(df).columns == df.columns


def test_measured_bands_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = QUERIES["op7_compression_bands"](spark, SF).where(~F.col("base_failed"))
    lost = judged.where(~F.col("kept")).join(labels, "doc_id").groupBy("quality").count()
    lost = {r["quality"]: r["count"] for r in lost.collect()}
    assert lost.get(0, 0) > 0 and lost.get(1, 0) == 0
    rng = random.Random(7)
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    noise = [" ".join("".join(rng.choices(letters[:k], k=8)) for _ in range(n))
             for k, n in [(62, 100), (62, 400), (62, 4000), (16, 700), (16, 4000)]]
    bands = compression_bands.MEASURED
    rows = compression_bands.with_quality(frame(spark, noise), bands=bands).collect()
    assert not any(r["quality_rules"]["kept"] or r["quality_rules"]["base_failed"] for r in rows)
    fitted = compression_bands.fit(docs).limits
    assert [x[0] for x in fitted] == [x[0] for x in bands.limits]
    assert all(abs(x[1] - y[1]) < 0.05 for x, y in zip(fitted[3:6], bands.limits[3:6], strict=True))


def toxic_rows(n, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) + rng.choice(["an", "en", ""]) for _ in range(rng.randint(20, 120))]
        bad = i % 3 == 0
        if bad:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["vilea", "vileo", "scumm"]) + rng.choice("xyz"))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_unseen_texts(spark):
    rows = toxic_rows(360, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    model = kn_toxicity.learn(docs, labels)
    unseen = toxic_rows(120, 2)
    found = kn_toxicity.with_toxicity(
        spark.createDataFrame([r[:2] for r in unseen], "doc_id long, text string"), model
    ).collect()
    right = sum((f["toxicity"]["score"] >= 0.5) == bool(r[2]) for f, r in zip(found, unseen, strict=True))
    assert right >= 114
    hard = kn_toxicity.with_toxicity(frame(spark, HARD), model).collect()
    assert all(0 <= r["toxicity"]["score"] <= 1 for r in hard) and len(hard) == len(HARD)
    assert kn_toxicity.filter_toxic(docs, model).columns == docs.columns
    # One class only: nothing can be told apart.
    even = kn_toxicity.learn(docs, labels.where("toxic = 0"))
    assert kn_toxicity.filter_toxic(docs, even).count() == 360


def plain_differences(rows, discount):
    """Log-ratios of words and pairs by the definition, with dictionaries."""
    first, texts = {}, {}
    for toxic, fold, text in rows:
        words, known = kn_toxicity.tokens(text), set()
        for w in set(words):
            texts[toxic, w] = texts.get((toxic, w), 0) + 1
        for g, h, w in zip(["", "", *words], ["", *words], words):
            if (h, w) not in known:
                known.add((h, w))
                first.setdefault((fold, toxic, h, w), set()).add(g)
    pair = {}
    for (_, c, h, w), before in first.items():
        pair[c, h, w] = pair.get((c, h, w), 0) + len(before)
    words = {w for _, _, w in pair}
    follows = {}
    for c, _, w in pair:
        follows[c, w] = follows.get((c, w), 0) + 1
    levels = [{w: [min(follows.get((c, w), 0), texts.get((c, w), 0)) for c in (0, 1)] for w in words}]
    totals = [max(1.0, sum(n[c] for n in levels[0].values())) for c in (0, 1)]
    sizes = [*kn_toxicity.STEMS, 0]
    for size in sizes:
        up = {}
        for u, n in levels[-1].items():
            here = up.setdefault(u[:size], [0, 0])
            for c in (0, 1):
                here[c] += min(n[c], discount)
        levels.append(up)
    rest = levels[-1][""]
    pool = [max(rest[c], 0.5) / totals[c] for c in (0, 1)]
    share, known = {"": 1.0}, []
    for depth in range(len(sizes) - 1, -1, -1):
        mass = {u: sum(min(x, discount) for x in n) for u, n in levels[depth].items()}
        pooled = {}
        for u, x in mass.items():
            pooled[u[:sizes[depth]]] = pooled.get(u[:sizes[depth]], 0) + x
        share = {u: x / pooled[u[:sizes[depth]]] * share[u[:sizes[depth]]] for u, x in mass.items()}
        here = {}
        for u, n in levels[depth].items():
            if share[u] and (depth == 0 or max(n) > discount):
                below = next((k[u[:s]] for s, k in zip(sizes[depth:-1], known[::-1])
                              if u[:s] in k), pool)
                here[u] = [max(n[c] - discount, 0) / totals[c] / share[u] + below[c] for c in (0, 1)]
        known.append(here)
    alone = {w: [p * share[w] for p in known[-1][w]] for w in known[-1]}
    of_h = {}
    for (c, h, _), n in pair.items():
        all_, left = of_h.setdefault(h, [[0, 0], [0, 0]])
        all_[c] += n
        left[c] += min(n, discount)
    pairs, after = {}, {}
    for h, (n, left) in of_h.items():
        kept = [left[c] / n[c] if n[c] else 1.0 for c in (0, 1)]
        if min(kept) < 1:
            after[h] = np.log(kept[1] / kept[0])
    for h, w in {(h, w) for _, h, w in pair}:
        n = [pair.get((c, h, w), 0) for c in (0, 1)]
        if h in after and max(n) > discount:
            all_, left = of_h[h]
            kept = [left[c] / all_[c] if all_[c] else 1.0 for c in (0, 1)]
            both = sum(p * t for p, t in zip(alone[w], totals)) / sum(totals)
            joint = sum(max(x - discount, 0) for x in n) / sum(all_)
            joint += sum(k * x for k, x in zip(kept, all_)) / sum(all_) * both
            p = [(max(n[c] - discount, 0) / all_[c] if all_[c] else 0)
                 + kept[c] * alone[w][c] * joint / both for c in (0, 1)]
            pairs[h, w] = np.log(p[1] / p[0])
    singles = {w: np.log(p[1] / p[0]) for w, p in known[-1].items()}
    return singles, pairs, after


def test_differences_by_definition(spark):
    rng = random.Random(12)
    vocabulary = ["the", "a", "of", "vilely", "vilest", "vileness", "house", "houses", "é", "日本"]
    rows = [(int(i % 3 == 0), i % 2,
             " ".join(rng.choices(vocabulary, [9, 7, 5, 3 * (i % 3 == 0) + .1, 2, 1, 3, 3, 1, 1],
                                  k=rng.randint(0, 25))))
            for i in range(90)] + [(0, 0, "the same long passage said by many")] * 9
    sample = spark.createDataFrame(rows, "toxic int, fold int, text string")
    found = kn_toxicity.learn_differences(sample, 2.0)[kn_toxicity.WHOLE]
    words, pairs, after = plain_differences(rows, 2.0)
    assert pairs and ("same", "long") not in pairs  # copies count once a fold
    # Words seen rarely are not listed: their stems speak for them.
    assert found.words.keys() <= words.keys() and {"the", "vilely", "house"} <= found.words.keys()
    words = {w: words[w] for w in found.words}
    assert found.pairs.keys() == pairs.keys()
    assert found.after.keys() == after.keys()
    for got, want in ((found.words, words), (found.pairs, pairs), (found.after, after)):
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_held_out_toxicity_on_the_supplied_table(spark):
    """Most toxic rows of the held-out fold are found and few others, by their texts alone."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    found = QUERIES["op5_kn_toxicity"](spark, sf).where("held_out").join(labels, "doc_id")
    got = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] >= 0.85 * (got[1, 1] + got.get((1, 0), 0))
    assert got.get((0, 1), 0) <= 0.02 * (got[0, 0] + got.get((0, 1), 0))


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "toxic words", "x", 1.0), (2, None, None, None)],
        "doc_id long, text string, toxicity string, score double",
    )
    labels = spark.createDataFrame([], "doc_id long, toxic int, text string")
    model = kn_toxicity.learn(docs, labels)
    assert kn_toxicity.learn(docs.limit(0), labels).weights is not None
    assert kn_toxicity.filter_toxic(docs, model).columns == docs.columns
    assert kn_toxicity.filter_toxic(docs, model).count() == 2
    assert kn_toxicity.with_toxicity(docs.limit(0), model).count() == 0
    quality = docs.withColumnRenamed("toxicity", "quality_rules")
    assert compression_bands.with_quality(quality.limit(0)).count() == 0
    assert compression_bands.with_quality(quality).columns == quality.columns
    assert compression_bands.filter_quality(quality).columns == quality.columns
    language = docs.withColumnRenamed("toxicity", "language").withColumn("lang", F.lit("en"))
    automata = cross_parsing.learn(language)
    assert cross_parsing.with_language(language, automata).columns == language.columns
    assert cross_parsing.with_language(language.limit(0), automata).count() == 0


def brute_phrases(text: bytes, sample: bytes) -> int:
    count, start = 0, 0
    while start < len(text):
        end = start + 1
        while end < len(text) and text[start : end + 1] in sample:
            end += 1
        count, start = count + 1, end
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(7)
    draw = lambda n, letters: bytes(rng.choice(letters) for _ in range(n))
    samples = {"x": draw(300, b"abc"), "y": draw(300, b"bcd")}
    automata = cross_parsing._table(samples)
    texts = [draw(rng.randint(1, 200), b"abcde") for _ in range(50)]
    got = automata.phrases(texts)
    for j, lang in enumerate(automata.langs):
        assert [int(x) for x in got[j]] == [brute_phrases(t, samples[lang]) for t in texts]


def test_language(spark):
    rng = random.Random(8)
    sound = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ein", "ung"], "cc": ["eau", "oir", "que"]}
    rows = [(i, " ".join("".join(rng.choices(sound[k], k=3)) for _ in range(rng.randint(3, 60))), k)
            for i in range(120) for k in sound]
    docs = spark.createDataFrame([*rows, (1, "x", None), (2, None, "aa"), (None, "12", "bb")],
                                 "doc_id long, text string, lang string")
    automata = cross_parsing.learn(docs.where("doc_id % 2 = 0"))
    found = cross_parsing.with_language(docs.where("doc_id % 2 = 1 and lang is not null"), automata)
    assert found.where("language.lang <> lang").count() == 0
    hard = cross_parsing.with_language(frame(spark, [*HARD, "123 !?"]), automata).collect()
    for row in hard:
        no_letter = not any(c.isalpha() for c in row["text"] or "")
        assert (row["language"]["lang"] == "und") == no_letter
        assert 0 <= row["language"]["score"] <= 1
    nothing = cross_parsing.with_language(docs, cross_parsing.learn(docs.limit(0)))
    assert {r[0] for r in nothing.select("language.lang").collect()} == {"und"}
