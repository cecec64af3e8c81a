"""Core tables as fixed expressions over the supplied Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martwright.sources.core import CoreTables


def _moment(base: str, days: str, minutes: str) -> str:
    return f"timestampadd(MINUTE, int(({days}) * 1440 + ({minutes})), timestamp_ntz'{base}')"


def _day_of(column: str) -> str:
    return f"datediff(CAST({column} AS DATE), date'1995-01-01') % 180"


BASE = "2010-10-01 00:00:00"
EVENT_MINUTE = "(l_orderkey * 7 + l_linenumber) % 1440"


def map_orders(raw: DataFrame) -> DataFrame:
    """Orders from a frame with the columns of the supplied ``orders`` table."""
    return raw.selectExpr(
        "string(o_orderkey) AS order_id",
        "if(o_custkey % 50 = 7, NULL, string(o_custkey)) AS user_id",
        "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'created' ELSE 'failed' END"
        " AS status",
        "CASE o_orderkey % 5 WHEN 0 THEN 'gift' WHEN 1 THEN '' WHEN 2 THEN NULL"
        " ELSE 'stars' END AS product_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'platega' WHEN '2-HIGH' THEN 'card'"
        " WHEN '3-MEDIUM' THEN 'wallet' WHEN '5-LOW' THEN '' END AS payment_provider",
        "if(o_orderkey % 97 = 0, NULL, CAST(o_totalprice AS DECIMAL(14,2))) AS amount_rub",
        "CAST(if(o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0,"
        " CAST(o_totalprice AS DECIMAL(14,2)) + CAST(o_orderkey % 50 AS DECIMAL(14,2)), NULL)"
        " AS DECIMAL(15,2)) AS amount_rub_original",
        "CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0"
        " ELSE o_orderkey % 1000 - 5 END AS DECIMAL(14,2)) AS cost_rub",
        "CAST(if(o_orderkey % 3 = 0, o_orderkey % 700 - 20, NULL) AS DECIMAL(14,2)) AS profit_rub",
        "CAST(if(o_orderkey % 11 = 0, NULL, 1 + o_orderkey % 3) AS DECIMAL(14,4)) AS cost_per_star",
        "if(o_orderkey % 6 = 0, concat('PROMO', o_orderkey % 4), NULL) AS promo_code",
        _moment(BASE, _day_of("o_orderdate"), "o_orderkey % 1440") + " AS timestamp",
    )


def _users(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "string(c_custkey) AS user_id",
        "CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS username",
        "CASE WHEN c_custkey % 3 = 0 THEN string(c_custkey div 3)"
        " WHEN c_custkey % 30 = 1 THEN '' END AS referrer_id",
        _moment("2010-09-15 00:00:00", "c_custkey * 7 % 200", "c_custkey * 13 % 1440")
        + " AS created_at",
    )


def _transactions(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id",
        "if(l_partkey % 13 = 0, NULL, string(l_orderkey)) AS order_id",
        "CASE l_suppkey % 6 WHEN 0 THEN 'platega' WHEN 1 THEN 'platega_status'"
        " WHEN 2 THEN 'card' WHEN 3 THEN 'wallet' WHEN 4 THEN '' END AS provider",
        "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''"
        " ELSE concat('tx', l_orderkey, '-', l_linenumber % 3) END AS provider_txn_id",
        "CASE l_returnflag"
        " WHEN 'R' THEN if(l_linenumber < 4, 'CONFIRMED', 'paid')"
        " WHEN 'A' THEN if(l_linenumber = 1, '', 'pending')"
        " ELSE if(l_linenumber = 2, NULL, 'canceled') END AS status",
        f"if(l_partkey % 7 = 0, NULL, {_moment(BASE, _day_of('l_shipdate'), EVENT_MINUTE)})"
        " AS created_at",
    )


SHIPPED = _moment(BASE, _day_of("l_shipdate"), "l_orderkey % 1440") + " AS created_at"


def _redemptions(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "if(l_partkey % 29 = 0, NULL, concat('PROMO', l_orderkey % 4 + 2)) AS code",
        SHIPPED,
    )


def _earnings(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "if(l_partkey % 17 = 0, NULL, string(l_orderkey)) AS order_id",
        "if(l_partkey % 19 = 0, NULL, int(l_quantity)) AS stars",
        SHIPPED,
    )


MAPPING = {
    "orders": ("orders", map_orders),
    "users": ("customer", _users),
    "payment_transactions": ("lineitem", _transactions),
    "promo_redemptions": ("lineitem", _redemptions),
    "referral_earnings": ("lineitem", _earnings),
}


def sample_core(spark: SparkSession, sf_dir: str) -> CoreTables:
    def fetch(name: str) -> DataFrame:
        table, mapped = MAPPING[name]
        return mapped(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return CoreTables(fetch)
