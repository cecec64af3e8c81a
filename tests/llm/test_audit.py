"""The filter interaction audit against a plain count, order by order."""

import random
import re
from itertools import permutations

import pytest

from martwright.llm import filter_audit as fa

CAPS = re.compile("[A-Z]")
MARKS = re.compile("[#$%&*|]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang in docs:
        body = text or ""
        words = WORDS.findall(body)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(CAPS.findall(body)) > 3 * len(body),
            "D": bool(MARKS.search(body)),
            "E": i is not None and i > least[body],
        }
        fails = {k for k, failed in tests.items() if failed}
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = set()
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone),
                              failing - len(gone), sum(r[0] == {f} for r in rows),
                              sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out |= {(*r, shapley[r[1][r[2] - 1]]) for r in found}
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame(
        [(*r, "x", "y", 0) for r in docs],
        "doc_id long, text string, lang string, part string, fails string, id int",
    )
    q = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit(fa.removals(fa.posting_lists(fa.failures(d), q)))
    return {tuple(r) for r in got.collect()}, got


def some_text(rng):
    long = rng.random() < 0.5
    words = [rng.choice("alpha beta gamma Delta EPSILON ze#ta eta é日 x y z".split())
             for _ in range(rng.randint(200, 260) if long else rng.randint(0, 30))]
    if rng.random() < 0.6:
        words = [f"{w}{i}" for i, w in enumerate(words)]
    return rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)


def test_same_as_every_order_applied(spark):
    rng = random.Random(5)
    texts = [some_text(rng) for _ in range(120)] + [None, "", " \n", "A", "|"]
    docs = [(rng.choice([None, *range(-3, 400)]), rng.choice(texts), rng.choice(["en", "de", None, ""]))
            for _ in range(700)]
    docs += docs[:40]  # repeated rows
    docs += [(7, "word " * 30_000, "en"), (8, "x" * 200_000, None)]  # very long
    labels = [(rng.choice([None, *range(-3, 400)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]))
              for _ in range(300)]
    got, df = audited(spark, docs, labels)
    want = brute(docs, labels)
    assert got == want and df.count() == len(want) == 3 * 600


def test_empty_tables(spark):
    got, df = audited(spark, [], [])
    assert got == set()
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant",
                          "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got, _ = audited(spark, [(1, None, None)], [])
    assert got == brute([(1, None, None)], [])


def test_many_ranges_and_a_hot_text(spark, monkeypatch):
    """Ranges of a few entries, a third of all rows one text, a third one id."""
    docs = [(i, "same $ text", "en") for i in range(300)]
    docs += [(9, f"Text {i % 7}", "en") for i in range(300)]
    docs += [(i, "a b " * (i % 90 + 60), "de") for i in range(300)]
    labels = [(i, i % 2, i % 3) for i in range(0, 300, 4)]
    monkeypatch.setattr(fa, "BLOCK", 16)
    got, _ = audited(spark, docs, labels)
    assert got == brute(docs, labels)
    lists = fa.posting_lists(
        fa.failures(spark.createDataFrame(docs, "doc_id long, text string, lang string")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    assert all(r.ids == sorted(r.ids) for r in lists)
    assert sum(sum(r.docs) for r in lists) == len(docs)


def test_hot_and_rare_keys_are_looked_up_alike(spark, monkeypatch):
    from martwright.llm import tables

    monkeypatch.setattr(tables, "HOT_SHARE", 4)
    rows = tables.keep(spark.range(1000).selectExpr("id", "if(id < 400, 0, id) AS k"), "rows")
    found = rows.groupBy("k").count().selectExpr("k", "k * 2 AS twice", "count AS n").where("k < 700")
    got = tables.lookup(rows, found, ["k"], "n")
    assert got.columns == ["k", "id", "twice"]
    want = {(0 if i < 400 else i, i, (0 if i < 400 else 2 * i) if i < 700 else None) for i in range(1000)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(60))
def test_merges(seed):
    rng = random.Random(seed)

    def ascending(most):
        return sorted(rng.sample(range(most), rng.randint(0, min(60, most))))

    lists = [ascending(rng.choice([3, 60, 1000])) for _ in range(rng.randint(0, 5))]
    assert fa.union(lists) == sorted(set().union(*lists))
    a, b = ascending(200), ascending(rng.choice([20, 200, 5000]))
    assert fa.minus(a, b) == sorted(set(a) - set(b))
    assert fa.common(a, b) == sorted(set(a) & set(b))
    for wanted in range(0, 200, 7):
        low = rng.randint(0, len(a))
        place = fa.gallop(a, wanted, low)
        assert place >= low and all(x >= wanted for x in a[place:])
        assert all(x < wanted for x in a[low:place])
