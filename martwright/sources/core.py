"""The five transactional tables the metrics are computed from.

Any reader can supply them: files, a catalog, a database connection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import pairwise

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "orders": """
        order_id string, user_id string, status string, product_type string,
        payment_provider string, amount_rub decimal(14,2), amount_rub_original decimal(15,2),
        cost_rub decimal(14,2), profit_rub decimal(14,2), cost_per_star decimal(14,4),
        promo_code string, timestamp timestamp_ntz""",
    "users": "user_id string, username string, referrer_id string, created_at timestamp_ntz",
    "payment_transactions": """
        id string, order_id string, provider string, provider_txn_id string, status string,
        created_at timestamp_ntz""",
    "promo_redemptions": "code string, created_at timestamp_ntz",
    "referral_earnings": "order_id string, stars int, created_at timestamp_ntz",
}

# Column that places a row in time.
EVENT_TIME = {
    "orders": "timestamp",
    "users": "created_at",
    "payment_transactions": "created_at",
    "promo_redemptions": "created_at",
    "referral_earnings": "created_at",
}

# Tables a snapshot copies; the last one only where it exists. Fixed values.
SNAPSHOT_TABLES = (
    "orders",
    "payment_transactions",
    "users",
    "promo_codes",
    "promo_redemptions",
    "referral_earnings",
    "bonus_grants",
)
SNAPSHOT_OPTIONAL = ("app_events",)


class CoreTables:
    """The core tables by name, opened on first use.

    A table once opened keeps the files it was opened with, so that the parts of one plan agree.
    Each job and micro-batch starts from ``reopened()`` and sees what has arrived by then.
    """

    def __init__(self, fetch: Callable[[str], DataFrame]) -> None:
        self._fetch = fetch
        self._open: dict[str, DataFrame] = {}

    def reopened(self) -> CoreTables:
        return CoreTables(self._fetch)

    def events(self, name: str) -> DataFrame:
        """The table for range scans: beside the declared columns those that a range is stated on,
        where the source has them, ``<time>_day`` (day folders) and ``<time>_instant`` (the time
        as stored by a zone-aware source)."""
        if name not in self._open:
            self._open[name] = _declared(self._fetch(name), name)
        return self._open[name]

    def _table(self, name: str) -> DataFrame:
        return self.events(name).drop(f"{EVENT_TIME[name]}_instant")

    @property
    def orders(self) -> DataFrame:
        return self._table("orders")

    @property
    def users(self) -> DataFrame:
        return self._table("users")

    @property
    def payment_transactions(self) -> DataFrame:
        return self._table("payment_transactions")

    @property
    def promo_redemptions(self) -> DataFrame:
        return self._table("promo_redemptions")

    @property
    def referral_earnings(self) -> DataFrame:
        return self._table("referral_earnings")

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in their declared types, others as they are.

    Instants of a zone-aware source become UTC wall time. The event time then stays beside it as
    stored, as ``<time>_instant``: a range is stated on that column, and so reaches the files. A
    column already in its type is passed on unchanged.
    """
    declared = {f.name: f.dataType for f in T.StructType.fromDDL(SCHEMAS[name])} if (
        name in SCHEMAS
    ) else {}
    event = EVENT_TIME.get(name)
    new = {}
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType) and not field.name.endswith("_instant"):
            if field.name == event:
                new[f"{event}_instant"] = value
            wall = value.cast("timestamp_ntz")
            value = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)
            new[field.name] = value
        wanted = declared.get(field.name)
        if wanted is not None and wanted != field.dataType:
            new[field.name] = value.cast(wanted)
    for absent in set(declared) - set(df.columns):
        new[absent] = F.lit(None).cast(declared[absent])
    return df.withColumns(new) if new else df


def _declared(df: DataFrame, name: str) -> DataFrame:
    """The table's declared columns, with its day folder and stored instant where it has them."""
    typed = _typed(df, name)
    names = [f.name for f in T.StructType.fromDDL(SCHEMAS[name])]
    event = EVENT_TIME[name]
    more = [c for c in (f"{event}_day", f"{event}_instant") if c in typed.columns]
    return typed.select(*names, *more)


def read_core(spark: SparkSession, root: str) -> CoreTables:
    """Parquet folders ``<root>/<table>``, as left by :func:`snapshot_core` or another writer.

    Files are read in their own types and cast. Day folders written by the snapshot appear as
    ``<time>_day`` and prune range scans.
    """

    def fetch(name: str) -> DataFrame:
        try:
            return spark.read.parquet(f"{root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")  # no file yet

    return CoreTables(fetch)


def read_core_jdbc(
    spark: SparkSession, url: str, slices: dict[str, Sequence[str]], **options: str
) -> CoreTables:
    """Core tables of a database, each read by the conditions given for it.

    A table's conditions cover it without overlap, one task each; :func:`time_slices` makes them.
    """

    def fetch(name: str) -> DataFrame:
        plain = {**options, "preferTimestampNTZ": "true"}
        if name not in slices:
            return spark.read.format("jdbc").options(url=url, dbtable=name, **plain).load()
        names = {k: v for k, v in plain.items()}
        return spark.read.jdbc(url, name, predicates=list(slices[name]), properties=names)

    return CoreTables(fetch)


def time_slices(
    column: str, edges: Sequence[str], undated: Sequence[str] = ("1 = 1",)
) -> list[str]:
    """Conditions for :func:`read_core_jdbc`: before the first edge, between edges, from the last
    on, and rows without a time. The last may be many: ``undated`` splits them by conditions in
    the database's own SQL that cover all rows without overlap, such as a hash of the key."""
    dated = [f"{column} < '{edges[0]}'"]
    dated += [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in pairwise(edges)]
    dated.append(f"{column} >= '{edges[-1]}'")
    return [*dated, *[f"{column} IS NULL AND ({part})" for part in undated]]


# Tables whose snapshot is laid out in one folder per UTC day: the ones read by range.
DAY_FOLDERS = ("orders", "payment_transactions", "promo_redemptions", "referral_earnings")


# Columns by which single rows are looked up: their files get Bloom filters, which tell a reader
# that a file has none of a user's or an order's rows, whatever its range of values.
LOOKUP_COLUMNS = {
    "orders": ("user_id", "order_id"),
    "payment_transactions": ("order_id",),
    "referral_earnings": ("order_id",),
    "users": ("user_id",),
}


def _bloom_options(name: str) -> dict[str, str]:
    """Filters as large as a file's distinct values ask for: of many candidate sizes the smallest
    that holds them is written, so that a file of few rows stays small."""
    found = {}
    for column in LOOKUP_COLUMNS.get(name, ()):
        found[f"parquet.bloom.filter.enabled#{column}"] = "true"
        found[f"parquet.bloom.filter.candidates.number#{column}"] = "15"
    return {**found, "parquet.bloom.filter.adaptive.enabled": "true"} if found else {}


#: Rows that one task sorts and writes; small tables are dealt to all cores by at least so few.
ROWS_PER_TASK, FEW_ROWS = 500_000, 20_000


def _by_day(df: DataFrame, day: str) -> DataFrame:
    """Rows dealt to tasks by day, each a stretch of days or a share of one.

    A task gets a number of rows, whatever they take when compressed, so that its sort stays in
    memory; of a day with more rows than that, each row falls into one of its tasks at random.
    """
    rows = df.count()
    spread = rows // df.sparkSession.sparkContext.defaultParallelism + 1
    size = min(ROWS_PER_TASK, max(FEW_ROWS, spread))
    # One row a day of the calendar.
    days = df.groupBy(F.col(day).alias("__day")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    placed = df.join(F.broadcast(days), F.col(day).eqNullSafe(F.col("__day")))
    task = ((F.col("__before") + F.rand(1) * F.col("__rows")) / size).cast("int")
    dealt = placed.withColumn("__task", task).repartitionById(rows // size + 1, F.col("__task"))
    return dealt.drop("__day", "__rows", "__before", "__task")


def exists(fetch: Callable[[str], DataFrame], name: str) -> bool:
    try:
        fetch(name).schema  # noqa: B018  resolving the schema is the test
    except AnalysisException:
        return False
    return True


def snapshot_core(fetch: Callable[[str], DataFrame], target: str) -> list[str]:
    """Copy the source tables to Parquet; returns the names copied.

    Event tables get one folder per UTC day so that later range scans open only those days. Rows
    are dealt by number within a day, so that a heavy day becomes several files, and sorted by
    owner in each; columns of single look-ups have Bloom filters.
    """
    names = [*SNAPSHOT_TABLES, *[n for n in SNAPSHOT_OPTIONAL if exists(fetch, n)]]
    for name in names:
        df = _typed(fetch(name), name)
        df = df.drop(f"{EVENT_TIME.get(name)}_instant")
        if name in DAY_FOLDERS:
            day = f"{EVENT_TIME[name]}_day"
            df = _by_day(df.withColumn(day, F.to_date(EVENT_TIME[name])), day)
            # Sorted by the first lookup column, a row's neighbours in its file are its owner's.
            df = df.sortWithinPartitions(day, *LOOKUP_COLUMNS.get(name, ())[:1])
            writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
            writer.options(**_bloom_options(name)).partitionBy(day).parquet(f"{target}/{name}")
        else:
            df.write.mode("overwrite").options(**_bloom_options(name)).parquet(f"{target}/{name}")
    return names
