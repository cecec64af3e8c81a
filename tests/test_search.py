"""Substring search through posting lists gives what a comparison of all rows gives."""

import random
import re

import pytest
from pyspark.sql.functions import input_file_name

from martwright.operators import grams
from martwright.operators.grams import SearchIndex, any_like, pieces_of

COLUMNS = ("user_id", "username")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    made = [(f"{i}", "".join(rng.choice("abAB_%\\ü") for _ in range(rng.randrange(0, 9))), i)
            for i in range(400)]
    made += [(None, "abab", 1), ("x", None, 2), (None, None, 3), ("", "", 4), ("7", "again ABBA", 5)]
    made += [(f"hot{i}", f"user number {i}", i) for i in range(600)]
    made += [("long", "ab" * 40_000 + "needle", 0), ("smile", "a😀bc😀d", 0), ("sigma", "ΟΔΟΣ ΟΔΟΣ", 0)]
    return spark.createDataFrame(made, "user_id string, username string, count long")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "users")
    return SearchIndex.build(rows, "user_id", COLUMNS, folder, rows_per_part=50)


def test_pieces_are_cut_at_wildcards(spark):
    assert pieces_of(spark, "%ABcd%e_fgh%") == ["abc", "bcd", "fgh"]
    assert pieces_of(spark, "%a\\%b%") == ["a%b"]
    assert pieces_of(spark, "%ab%") == pieces_of(spark, "%%") == []


@pytest.mark.parametrize("wanted", [
    "aba", "BAB", "ab", "a", "", "a%b", "ab_a", "b_a%ab", "a\\\\b", "a\\%b", "üa", "aüb", "user number 1",
    "user", "hot5", "needle", "babneedle", "😀bc", "abab", "again%ba", "no such", "οδος", "ΟΔΟΣ ΟΔ", "7",
])
def test_same_rows_as_a_comparison_of_all(rows, index, wanted):
    pattern = f"%{wanted}%"
    want = sorted(map(str, rows.where(any_like(COLUMNS, pattern)).collect()))
    assert sorted(map(str, index.find(pattern).select(*rows.columns).collect())) == want


def test_only_parts_with_a_candidate_are_read(rows, index):
    found = index.find("%babneedle%")
    assert found.count() == 1
    assert index.candidates("%babneedle%").select("part").distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=) ", plan)
    assert index.candidates("%babneedle%").count() < rows.count() / 100


def test_empty_table(rows, tmp_path):
    index = SearchIndex.build(rows.limit(0), "user_id", COLUMNS, str(tmp_path / "none"))
    assert index.find("%abc%").count() == index.find("%a%").count() == 0


def test_rows_are_dealt_to_tasks_before_they_are_cut(rows, tmp_path, monkeypatch):
    """One file of many rows is cut by many tasks; keys that repeat have one posting a piece."""
    monkeypatch.setattr(grams, "TASK_CHARS", 10_000)
    twice = rows.union(rows).coalesce(1)
    index = SearchIndex.build(twice, "user_id", COLUMNS, str(tmp_path / "users"), rows_per_part=50)
    postings = index._read("postings")
    assert postings.count() == postings.distinct().count()
    assert postings.select(input_file_name()).distinct().count() >= 8
    want = sorted(map(str, twice.where(any_like(COLUMNS, "%aba%")).collect()))
    assert sorted(map(str, index.find("%aba%").select(*rows.columns).collect())) == want
