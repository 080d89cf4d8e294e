"""The knowledge store's tables as deterministic views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import hash128
from lorekeep.sources.tables import read_table as read

TYPES = ("fact", "event", "instruction", "task")
START = "2024-01-01"
#: Lines that a task makes edges of.
TASK_LINES = 500_000

SQL = {
    "memories": """memories AS (
        SELECT doc_id AS sequence, substr(sha256('m' || doc_id), 1, 32) AS id, lang AS profile_id, source AS session_id,
               ['fact', 'event', 'instruction', 'task'][CAST(doc_id % 4 + 1 AS INT)] AS type,
               CASE WHEN doc_id % 5 <> 0 THEN lang || '.' || source END AS topic_key, text AS content,
               '{"tool":"' || source || '","stated_at":"' || strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d')
                   || '"}' AS payload,
               DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS created_on,
               CAST(ceil(n_chars / 4.0) AS BIGINT) AS source_tokens, doc_id % 17 = 0 AS forgotten,
               DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS valid_from,
               CASE WHEN doc_id % 5 = 0 THEN DATE '2024-01-01' + CAST(doc_id % 90 AS INT) + 30 END AS valid_to,
               doc_id AS from_sequence, CASE WHEN doc_id % 7 = 0 THEN doc_id + 100 END AS to_sequence
        FROM documents)""",
    "messages": """messages AS (
        SELECT substr(sha256(concat(conv_id, role, text)), 1, 32) AS id, conv_id AS session_id, turn, role, text AS content,
               DATE '2024-01-01' + CAST(conv_id % 300 AS INT) AS said_on
        FROM conversations)""",
    "traces": """traces AS (
        SELECT event_id, user_id AS session_id, event_type AS tool, props AS args,
               CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, ts AS occurred_at
        FROM events)""",
    "edges": """edges AS (
        SELECT 'c' || c_custkey AS source, 'lives in' AS relation, 'n' || c_nationkey AS target, 'c' || c_custkey AS memory_id,
               c_custkey AS sequence FROM customer
        UNION ALL
        SELECT 'o' || o_orderkey, 'placed by', 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders
        UNION ALL
        SELECT DISTINCT 'o' || l_orderkey, 'contains', 'p' || l_partkey, 'o' || l_orderkey, l_orderkey FROM lineitem)""",
    "assertions": """assertions AS (
        SELECT o_custkey AS fact_group, o_orderkey AS revision_id, CAST(o_orderdate AS DATE) AS start,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INT) END AS stop,
               o_orderkey AS transaction_id,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) END AS stated_on,
               CAST(o_orderkey % 4 AS VARCHAR) AS source_order
        FROM orders)""",
}


def sql(body: str, *names: str) -> str:
    """A query over the named views."""
    views = ",\n".join(SQL[n] for n in names)
    body = body.strip()
    for begin in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(begin):
            return f"{begin}{views},\n{body.removeprefix(begin)}"
    return f"WITH {views}\n{body}"


def _day(offset) -> F.Column:
    return F.date_add(F.lit(START).cast("date"), offset.cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    day = _day(n % 90)
    return read(spark, sf_dir, "documents").select(
        n.alias("sequence"),
        hash128(F.lit("m"), n).alias("id"),
        F.col("lang").alias("profile_id"),
        F.col("source").alias("session_id"),
        F.element_at(F.array(*map(F.lit, TYPES)), (n % 4 + 1).cast("int")).alias("type"),
        F.when(n % 5 != 0, F.concat("lang", F.lit("."), "source")).alias("topic_key"),
        F.col("text").alias("content"),
        F.concat(
            F.lit('{"tool":"'), "source", F.lit('","stated_at":"'), F.date_format(_day(n % 365), "yyyy-MM-dd"), F.lit('"}')
        ).alias("payload"),
        _day(n % 400).alias("created_on"),
        F.ceil(F.col("n_chars") / 4).alias("source_tokens"),
        (n % 17 == 0).alias("forgotten"),
        day.alias("valid_from"),
        F.when(n % 5 == 0, F.date_add(day, 30)).alias("valid_to"),
        n.alias("from_sequence"),
        F.when(n % 7 == 0, n + 100).alias("to_sequence"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        hash128(F.col("conv_id"), F.col("role"), F.col("text")).alias("id"),
        F.col("conv_id").alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
        _day(F.col("conv_id") % 300).alias("said_on"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("tool"),
        F.col("props").alias("args"),
        failed.alias("status"),
        F.col("ts").alias("occurred_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(table: DataFrame, source: tuple[str, str], relation: str, target: tuple[str, str]) -> DataFrame:
        def name(kind: str, key: str) -> F.Column:
            return F.concat(F.lit(kind), F.col(key).cast("string"))

        return table.select(
            name(*source).alias("source"),
            F.lit(relation).alias("relation"),
            name(*target).alias("target"),
            name(*source).alias("memory_id"),
            F.col(source[1]).alias("sequence"),
        )

    homes = edge(read(spark, sf_dir, "customer"), ("c", "c_custkey"), "lives in", ("n", "c_nationkey"))
    buyers = edge(read(spark, sf_dir, "orders"), ("o", "o_orderkey"), "placed by", ("c", "o_custkey"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # Spark puts shuffled rows together up to 64 MB a task, which are millions of them; a task's map of distinct ones shall not grow so.
    items = lines.repartition(max(spark.sparkContext.defaultParallelism, lines.count() // TASK_LINES + 1), "l_orderkey").distinct()
    return homes.unionByName(buyers).unionByName(edge(items, ("o", "l_orderkey"), "contains", ("p", "l_partkey")))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fact_group"),
        key.alias("revision_id"),
        day.alias("start"),
        F.when(key % 5 == 0, F.date_add(day, (key % 60 + 30).cast("int"))).alias("stop"),
        key.alias("transaction_id"),
        F.when(key % 3 == 0, F.date_add(day, (key % 7).cast("int"))).alias("stated_on"),
        (key % 4).cast("string").alias("source_order"),
    )
