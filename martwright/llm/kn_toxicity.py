"""Toxicity by two Kneser-Ney models, one for each class, over shared backoff counts.

A model's events are words after the word before them. Of each count the first ``discount`` go to
the level below: from a word after a word to the word alone (there, by Kneser-Ney's rule, a word
counts once for each word it follows, and no more than it has texts), from the word to its first letters, six, five, four, and
from there to a pool that both classes share. So an expression seen a few times says nothing about
a class, a frequent one says much, and an unseen ending of a known stem is judged by its stem.
Shared factors cancel in the difference of the two log-likelihoods; only differences are kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.rows import hash_sample, texts_of, with_text_column
from martwright.llm.tables import keep

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (6, 5, 4)
#: Nats by which a token must favour a class to tell by itself; what passes them is summed.
STRONG = 1.0
FIELDS = "struct<score:double, log_ratio:double, n_tokens:long>"
#: Stands for the word before in rows that count a word's texts; no token has it.
DOCUMENT = "\n"
#: Models: 0 and 1 without the labelled rows of that fold, 2 with all.
FOLDS, WHOLE = 2, 2
CELLS = [f"n{fold}{toxic}" for fold in range(FOLDS) for toxic in (0, 1)]


def tokens(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


@dataclass
class Difference:
    """Log-likelihood differences (toxic minus ordinary), in nats.

    ``stems``: for each length of STEMS the known stems of that length (shorter words: themselves).
    ``after``: what a word alone gains after a given word; ``pairs``: known pairs as a whole.
    """

    words: dict[str, float]
    stems: list[dict[str, float]]
    nothing: float
    after: dict[str, float]
    pairs: dict[tuple[str, str], float]

    def of_word(self, word: str) -> float:
        found = self.words.get(word)
        if found is not None:
            return found
        for size, known in zip(STEMS, self.stems, strict=True):
            found = known.get(word[:size])
            if found is not None:
                return found
        return self.nothing

    def text(self, text: str, memory: dict[str, float]) -> tuple[float, float, float, int]:
        """(sum over the tokens, sums of what passes ``STRONG`` nats for and against, number of
        tokens).

        ``memory`` keeps words already looked up.
        """
        words = tokens(text)
        if not words:
            return 0.0, 0.0, 0.0, 0
        if len(memory) > 150_000:
            memory.clear()
        for word in set(words).difference(memory):
            memory[word] = self.of_word(word)
        each = np.array(list(map(memory.__getitem__, words)))
        before = ["", *words[:-1]]
        for i, step in enumerate(map(self.after.get, before)):
            if step is not None:
                pair = self.pairs.get((before[i], words[i]))
                each[i] = each[i] + step if pair is None else pair
        strong = [float(np.maximum(sign * each - STRONG, 0).sum()) for sign in (1, -1)]
        return float(each.sum()), *strong, len(words)


@dataclass
class Model:
    difference: Difference
    weights: np.ndarray


def features(found: list[tuple]) -> np.ndarray:
    """The length-normalised log-likelihood difference, a token's; what single expressions tell
    strongly for and against; the length.

    The sums of strong differences are normalised by the root of the length, as a sum over n tokens
    varies: a few insults in a long text tell, though its mean hardly moves.
    """
    total, more, less, n = np.array(found, float).reshape(-1, 4).T
    n = np.maximum(n, 1)
    root = np.sqrt(n)
    return np.stack([total / n, more / root, less / root, np.log1p(n), np.ones_like(n)], -1)


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, doc_id: str, text: str, label: str
) -> DataFrame:
    """(toxic, fold, text) of at most ``per_class`` rows of each class, by the hash of their ids.

    A document labelled both ways counts as toxic. Null ids, labels and texts are left out.
    """
    key = F.col(doc_id).cast("string")
    marked = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(key.alias("__key"))
        .agg(F.max(label).cast("int").alias("toxic"))
        .join(docs.where(F.col(text).isNotNull()).select(key.alias("__key")).distinct(), "__key",
              "left_semi")
    )
    chosen = hash_sample(marked, "toxic", per_class, "__key")
    texts = docs.select(key.alias("__key"), F.col(text).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "__key")  # at most 2 * per_class short rows
        .groupBy("__key", "toxic")
        .agg(F.min("text").alias("text"))
        .select("toxic", (F.abs(F.hash("__key", F.lit(1))) % FOLDS).alias("fold"), "text")
    )


def _pair_counts(sample: DataFrame) -> DataFrame:
    """(h, w, n<fold><class>...): after how many words w follows h ('': it comes first), each text
    giving one; or in how many texts w stands at all (h is DOCUMENT).

    So a pair in a passage that many texts copy counts once, as a word does that always follows
    the same word.
    """

    def count(batches):
        for batch in batches:
            found: dict[tuple, list[int]] = defaultdict(lambda: [0] * (2 * FOLDS))
            for toxic, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                         strict=True):
                words = tokens(text)
                once = {(DOCUMENT, w): "" for w in words}
                for g, *pair in zip(["", "", *words], ["", *words], words, strict=False):
                    once.setdefault(tuple(pair), g)  # a text that repeats itself says a thing once
                for pair, g in once.items():
                    found[(g, *pair)][2 * fold + toxic] += 1
            keys = list(zip(*found, strict=True)) if found else [[], [], []]
            sums = list(zip(*found.values(), strict=True)) if found else [[]] * (2 * FOLDS)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k, pa.string()) for k in keys),
                 *(pa.array(list(n), pa.int64()) for n in sums)],
                names=["g", "h", "w", *CELLS],
            )

    schema = ", ".join(["g string", "h string", "w string", *(f"{c} long" for c in CELLS)])
    seen = sample.mapInArrow(count, schema).groupBy("g", "h", "w").agg(
        *[F.sum(c).alias(c) for c in CELLS]
    )
    in_texts = F.col("h") == DOCUMENT
    return seen.groupBy("h", "w").agg(
        *[F.sum(F.when(in_texts, F.col(c)).otherwise((F.col(c) > 0).cast("long"))).alias(c)
          for c in CELLS]
    )


def _in_model(model: int, toxic: int):
    """A pair's count in a model: of the other fold, or of all."""
    folds = range(FOLDS) if model == WHOLE else [f for f in range(FOLDS) if f != model]
    return sum((F.col(f"n{f}{toxic}") for f in folds), F.lit(0))


def learn_differences(sample: DataFrame, discount: float) -> dict[int, Difference]:
    """A model without each fold, and one with all rows.

    What comes to the driver are expressions seen more than ``discount`` times in the sample,
    whose number the sample bounds.
    """
    def low(x):
        return F.least(x.cast("double"), F.lit(float(discount)))

    cells = [(m, c) for m in range(FOLDS + 1) for c in (0, 1)]
    name = {cell: f"m{cell[0]}{cell[1]}" for cell in cells}
    often = reduce(or_, [F.col(name[cell]) > discount for cell in cells])
    counted = keep(
        _pair_counts(sample).select(
            "h", "w", *[_in_model(*cell).alias(name[cell]) for cell in cells]
        ),
        "pairs",
    )
    in_texts = F.col("h") == DOCUMENT
    pairs = counted.where(~in_texts)
    listed_pairs = pairs.where(often)
    listed = listed_pairs.collect()
    context = (
        pairs.groupBy("h")
        .agg(*[F.sum(name[x]).alias(name[x]) for x in cells],
             *[F.sum(low(F.col(name[x]))).alias(f"r{name[x]}") for x in cells])
        .where(reduce(or_, [F.col(name[x]) > F.col(f"r{name[x]}") for x in cells]))
        .collect()
    )
    # A word counts once for each word it follows, and no more than it has texts.
    level = keep(
        counted.groupBy(F.col("w").alias("u")).agg(
            *[F.least(F.count_if(~in_texts & (F.col(name[x]) > 0)),
                      F.max(F.when(in_texts, F.col(name[x])))).alias(name[x]) for x in cells]
        ),
        "words",
    )
    sums = [F.sum(name[x]).alias(name[x]) for x in cells]
    totals = level.agg(*sums).first()
    sizes = {x: float(totals[name[x]] or 0) for x in cells}

    # Down from the word to the shortest stem: what the discount leaves to each stem.
    tables = []
    for size in [*STEMS, 0]:
        split = level.withColumn("p", F.expr(f"left(u, {size})"))
        tables.append(split)
        level = keep(
            split.groupBy("p").agg(*[F.sum(low(F.col(name[x]))).alias(name[x]) for x in cells])
            .withColumnRenamed("p", "u"),
            "stems",
        )
    last = level.first()
    rest = {x: float(last[name[x]] or 0) if last else 0.0 for x in cells}
    # Up again: each unit's probability in the pool of each model, then what is seen often.
    pools = [f"s{m}" for m in range(FOLDS + 1)]
    above = level.select("u", *[F.lit(1.0).alias(s) for s in pools],
                         *[(F.col(name[(m, 0)]) + F.col(name[(m, 1)])).alias(f"p{m}")
                           for m in range(FOLDS + 1)])
    levels = []
    for table in reversed(tables):
        upper = above.select(F.col("u").alias("p"), *[F.col(s).alias(f"up{s}") for s in pools],
                             *[F.col(f"p{m}") for m in range(FOLDS + 1)])
        joined = table.join(upper, "p")
        mass = [low(F.col(name[(m, 0)])) + low(F.col(name[(m, 1)])) for m in range(FOLDS + 1)]
        shares = [(mass[m] / F.greatest(F.col(f"p{m}"), F.lit(1e-9)) * F.col(f"ups{m}"))
                  .alias(f"s{m}") for m in range(FOLDS + 1)]
        here = keep(joined.select("u", *[name[x] for x in cells], *shares), "pool")
        # Pooled counts of the units as parents of the next level.
        above = here.select("u", *pools)
        if table is not tables[0]:
            below = tables[tables.index(table) - 1]
            parents = below.groupBy("p").agg(
                *[F.sum(low(F.col(name[(m, 0)])) + low(F.col(name[(m, 1)]))).alias(f"p{m}")
                  for m in range(FOLDS + 1)]
            ).withColumnRenamed("p", "u")
            above = above.join(parents, "u")
            wanted = here.where(often)
        else:
            in_pairs = listed_pairs.select(F.col("w").alias("u")).distinct()
            wanted = here.where(often).union(here.where(~often).join(in_pairs, "u", "left_semi"))
        levels.append(wanted.collect())

    out = {}
    for model in range(FOLDS + 1):
        total = [max(sizes[(model, c)], 1.0) for c in (0, 1)]
        cols = [name[(model, c)] for c in (0, 1)]
        # The mass of the pool in each class; a class without rows gets some.
        pool = tuple(max(rest[(model, c)], 0.5) / total[c] for c in (0, 1))
        known: list[dict[str, tuple[float, float]]] = []
        scale: dict[str, float] = {}
        for rows in levels:
            here: dict[str, tuple[float, float]] = {}
            for r in rows:
                share = r[f"s{model}"]
                if not share or (max(r[cols[0]], r[cols[1]]) <= discount and rows is not levels[-1]):
                    continue
                below = pool
                for size, stems in zip(STEMS[len(STEMS) - len(known):], reversed(known),
                                       strict=True):
                    if r["u"][:size] in stems:
                        below = stems[r["u"][:size]]
                        break
                own = [max(r[c] - discount, 0.0) / n for c, n in zip(cols, total, strict=True)]
                here[r["u"]] = tuple(o / share + b for o, b in zip(own, below, strict=True))
                scale[r["u"]] = share  # in the end the words'
            known.append(here)

        def ratio(p: tuple[float, float]) -> float:
            return float(np.log(p[1]) - np.log(p[0]))

        *stems, words = [{u: ratio(p) for u, p in k.items()} for k in known]
        result = Difference(words, stems[::-1], ratio(pool), {}, {})
        seen = {}
        for r in context:
            n = [float(r[c]) for c in cols]
            kept = [r[f"r{c}"] / x if x else 1.0 for c, x in zip(cols, n, strict=True)]
            if min(kept) < 1.0:
                seen[r["h"]] = n, kept
                result.after[r["h"]] = ratio(tuple(kept))
        for r in listed:
            if r["h"] not in seen or max(r[cols[0]], r[cols[1]]) <= discount:
                continue
            n, kept = seen[r["h"]]
            # How much more often w stands after h than elsewhere is taken from both classes
            # together, so that a pair one class has not seen costs it little.
            alone = [p * scale[r["w"]] for p in known[-1][r["w"]]]
            both, share = sum(n), np.average(alone, weights=total)
            lost = min(discount, r[cols[0]]) + min(discount, r[cols[1]])
            after = (r[cols[0]] + r[cols[1]] - lost) / both + np.average(kept, weights=n) * share
            own = [max(r[c] - discount, 0.0) / x if x else 0.0
                   for c, x in zip(cols, n, strict=True)]
            result.pairs[(r["h"], r["w"])] = ratio(
                tuple(own[c] + kept[c] * alone[c] * after / share for c in (0, 1))
            )
        out[model] = result
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; classes weigh as they are in the sample.

    The last column is the constant. The others are brought to one scale before the penalty.
    """
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[-1] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = probability(z, w)
        grad = z.T @ (p - y) + penalty @ w
        hess = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    w = w / scale
    w[-1] -= mean @ w
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2500,
    discount: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Fit on a bounded sample: at most ``per_class`` labelled rows of each class.

    The two models of a fold score the other fold's rows; on these scores the weights are fitted,
    so that they are those of unseen texts. Without rows of both classes every score is 0.
    """
    sample = keep(labelled_sample(docs, labels, per_class, doc_id, text, label), "labelled")
    models = learn_differences(sample, discount)
    shared = docs.sparkSession.sparkContext.broadcast({k: models[k] for k in range(FOLDS)})

    def outside(batches):
        for batch in batches:
            memory = {0: {}, 1: {}}
            columns = [batch.column(i).to_pylist() for i in range(3)]
            toxic, rows = columns[0], [
                # model f was learned without fold f
                shared.value[fold].text(body, memory[fold])
                for fold, body in zip(*columns[1:], strict=True)
            ]
            parts = [toxic, *(zip(*rows, strict=True) if rows else [[]] * 4)]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), k) for v, k in zip(parts, kinds, strict=True)],
                names=["toxic", "a", "b", "c", "n"],
            )

    scored = sample.mapInArrow(
        outside, "toxic int, a double, b double, c double, n long"
    ).collect()  # five numbers for each row of the bounded sample
    y = np.array([r["toxic"] for r in scored], float)
    if len(set(y)) < 2:
        return Model(models[WHOLE], np.array([0.0, 0.0, 0.0, 0.0, -50.0]))
    x = features([tuple(r)[1:] for r in scored])
    return Model(models[WHOLE], fit_weights(x, y))


def with_toxicity(
    df: DataFrame, model: Model, text: str = "text", into: str = "toxicity"
) -> DataFrame:
    """``df`` with struct (score 0 to 1, log_ratio a token, n_tokens) for every row.

    A null text counts as empty; a text without letters has log_ratio 0 and the score of length 0.
    Every row is judged by its text alone; a column named ``into`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(column: pa.Array) -> pa.Array:
        memory: dict[str, float] = {}
        found = [shared.value.difference.text(x, memory) for x in texts_of(column)]
        count = np.array([x[3] for x in found], np.int64)
        total = np.array([x[0] for x in found], float)
        return pa.StructArray.from_arrays(
            [pa.array(probability(features(found), shared.value.weights)),
             pa.array(total / np.maximum(count, 1)), pa.array(count)],
            ["score", "log_ratio", "n_tokens"],
        )

    return with_text_column(df, text, into, judge, FIELDS)


def filter_toxic(df: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is below ``limit``, with their own columns."""
    verdict = "__toxicity"
    scored = with_toxicity(df, model, text, verdict)
    return scored.where(F.col(f"{verdict}.score") < limit).drop(verdict)
