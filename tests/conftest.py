from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from martwright.sources.core import SCHEMAS, CoreTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("martwright-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def order(order_id, user_id, when, status="paid", **more) -> dict:
    """An order row; money given as text becomes Decimal."""
    row = {"order_id": order_id, "user_id": user_id, "status": status, "timestamp": utc(when)}
    for name, value in more.items():
        money = name in ("amount_rub", "amount_rub_original", "cost_rub", "profit_rub",
                         "cost_per_star")
        row[name] = Decimal(str(value)) if money and value is not None else value
    return row


@pytest.fixture
def tables(spark):
    """Core tables from lists of dicts; unnamed columns are NULL, unnamed tables empty."""

    def make(**rows) -> CoreTables:
        def fetch(name):
            schema = spark.range(0).selectExpr(
                *[f"CAST(NULL AS {f.split(None, 1)[1]}) AS {f.split(None, 1)[0]}"
                  for f in (p.strip() for p in SCHEMAS[name].replace("\n", " ").split(", "))]
            ).schema
            data = [tuple(r.get(c) for c in schema.names) for r in rows.get(name, [])]
            return spark.createDataFrame(data, schema)

        return CoreTables(fetch)

    return make


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
