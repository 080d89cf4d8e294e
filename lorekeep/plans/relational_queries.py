"""Queries of the relational operators: scans, filters, joins, aggregations, ranks, pages and set operations."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text, vectors
from lorekeep.operators import ingest, rows, sets
from lorekeep.plans.derived import TYPES, edges, memories, messages, sql, traces
from lorekeep.plans.registry import query
from lorekeep.sources.tables import read_table
from lorekeep.streaming import feeds

SNAPSHOT = rows.Snapshot("2024-02-15", "2024-06-01", 600)
BOUNDS = """*, created_on AS recorded_from, CASE WHEN sequence % 7 = 0 THEN created_on + 45 END AS recorded_to"""
VALID = "valid_from <= DATE '2024-02-15' AND (valid_to IS NULL OR DATE '2024-02-15' < valid_to)"
RECORDED = "recorded_from <= DATE '2024-06-01' AND from_sequence <= 600"
SEEN = f"{VALID} AND {RECORDED} AND (recorded_to IS NULL OR DATE '2024-06-01' < recorded_to OR to_sequence > 600)"
SEEN_STRICTLY = f"{VALID} AND {RECORDED} AND (recorded_to IS NULL OR (DATE '2024-06-01' < recorded_to AND to_sequence > 600))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with recording bounds."""
    closed = F.when(F.col("sequence") % 7 == 0, F.date_add("created_on", 45))
    return memories(spark, sf_dir).withColumns({"recorded_from": F.col("created_on"), "recorded_to": closed})


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(rows.visible(SNAPSHOT))


SEEN_SQL = f"seen AS (SELECT * FROM (SELECT {BOUNDS} FROM memories) WHERE {SEEN})"

# Scans and sinks


@query(sql("SELECT id, type, topic_key FROM memories WHERE profile_id = 'en'", "memories"))
def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where("profile_id = 'en'").select("id", "type", "topic_key")


@query("""SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'),
    '(?is)<nav\\b[^>]*>.*?</nav\\s*>', ' ', 'g'), '(?is)<header\\b[^>]*>.*?</header\\s*>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer\\s*>', ' ', 'g'),
    '(?is)<aside\\b[^>]*>.*?</aside\\s*>', ' ', 'g'), '(?is)<form\\b[^>]*>.*?</form\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""")
def src_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", text.page_title(F.col("html")).alias("title"), text.page_text(F.col("html")).alias("body"))


@query(sql("SELECT DISTINCT id FROM messages", "messages"))
def snk_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even conversations are stored; all are offered."""
    offered = messages(spark, sf_dir).select("id", "session_id", "content")
    stored = offered.where("session_id % 2 = 0").dropDuplicates(["id"])
    return rows.insert_ignore(stored, offered, "id").select("id")


@query("""SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS spent FROM events GROUP BY ALL""")
def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the first half of the events, to which those of the second are added."""
    events = read_table(spark, sf_dir, "events")

    def counters(part: DataFrame) -> DataFrame:
        return part.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("spent"))

    both = rows.upsert_counters(counters(events.where("event_id % 2 = 0")), counters(events.where("event_id % 2 = 1")), ["user_id", "event_type"])
    return both.withColumn("spent", F.round("spent", 4))


@query(sql("""SELECT '{"id":"' || id || '","type":"' || type || CASE WHEN topic_key IS NULL THEN '' ELSE '","topic_key":"' || topic_key END || '","created_on":"' || created_on
    || '","content":' || replace(to_json(content), '\\u007F', chr(127)) || '}' AS line FROM memories WHERE NOT forgotten""", "memories"))
def snk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each memory that is not forgotten, newest first."""
    kept = memories(spark, sf_dir).where("NOT forgotten")
    return rows.json_lines(kept, ["id", "type", "topic_key", "created_on", "content"], [F.desc("created_on"), F.desc("id")])


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey <> 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'customer' AS kind, c_custkey AS key FROM c UNION ALL SELECT 'orders', o_orderkey FROM o
    UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def snk_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile (the customers of nation 3) goes with all that depends on it, table after table."""
    tables = {n: read_table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left = rows.delete_cascade(tables, "customer", F.col("c_nationkey") == 3, links)
    keys = {"customer": F.col("c_custkey"), "orders": F.col("o_orderkey"), "lineitem": F.col("l_orderkey") * 10 + F.col("l_linenumber")}
    kept = [left[n].select(F.lit(n).alias("kind"), k.alias("key")) for n, k in keys.items()]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("""SELECT vec_id, label = 3 AS forgotten, CASE WHEN label <> 3 THEN len(embedding) END AS width FROM embeddings""")
def snk_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.when(F.col("label") != 3, F.col("embedding"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 3).alias("forgotten"), F.size(vector).cast("long").alias("width")).withColumn(
        "width", F.when(F.col("width") >= 0, F.col("width"))
    )


@query("""SELECT o_custkey, o_orderkey, o_totalprice AS price FROM orders WHERE o_custkey % 10 <> 0
    UNION ALL SELECT o_custkey, o_orderkey, 0.0 FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0""")
def snk_replace_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer's orders are written anew, and only the even ones come again."""
    stored = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))
    tenth = stored.where("o_custkey % 10 = 0")
    anew = tenth.where("o_orderkey % 2 = 0").withColumn("price", F.lit(0.0))
    return rows.replace_group(stored, anew, tenth.select("o_custkey"))


@query("""WITH w AS (SELECT user_id AS consumer, max(event_id) AS seen FROM events WHERE user_id IN (3, 7) AND event_id < 600 GROUP BY 1)
    SELECT consumer, event_id, event_type FROM w JOIN events ON event_id > seen""")
def src_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For two consumers, the changes after the last one that each has seen (their last of the first 600 events)."""
    feed = read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    own = F.col("user_id").isin(3, 7) & (F.col("event_id") < 600)
    marks = {r.user_id: r.seen for r in feed.where(own).groupBy("user_id").agg(F.max("event_id").alias("seen")).collect()}
    read = [feeds.since(feed, "event_id", seen).select(F.lit(k).cast("long").alias("consumer"), "event_id", "event_type") for k, seen in sorted(marks.items())]
    nothing = feed.where("false").select(F.col("user_id").alias("consumer"), "event_id", "event_type")
    return functools.reduce(DataFrame.unionByName, read, nothing)


# Filters and projections


@query(sql(f"SELECT id, sequence FROM (SELECT {BOUNDS} FROM memories) WHERE {SEEN}", "memories"))
def flt_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen(spark, sf_dir).select("id", "sequence")


@query(sql(f"SELECT id, sequence FROM (SELECT {BOUNDS} FROM memories) WHERE {SEEN_STRICTLY}", "memories"))
def flt_visible_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(rows.visible(SNAPSHOT, strict=True)).select("id", "sequence")


@query(sql("SELECT id FROM memories WHERE created_on <= DATE '2024-06-01' AND from_sequence <= 600", "memories"))
def flt_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(rows.recorded_by(SNAPSHOT)).select("id")


@query(sql(f"""WITH {SEEN_SQL} SELECT DISTINCT e AS entity FROM (SELECT source AS e, sequence FROM edges UNION ALL SELECT target, sequence FROM edges)
    WHERE sequence IN (SELECT sequence FROM seen)""", "memories", "edges"))
def flt_active_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of which some edge comes from a visible memory (that of the edge's number)."""
    ends = rows.endpoints(edges(spark, sf_dir), "sequence")
    return ends.join(seen(spark, sf_dir).select("sequence"), "sequence", "left_semi").select("entity").distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the th')")
def flt_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where(rows.contains_ignoring_case(F.col("text"), "The TH")).select("doc_id")


@query(sql("SELECT id FROM memories WHERE coalesce(topic_key, '') NOT LIKE 'en.%'", "memories"))
def flt_null_safe_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where("NOT startswith(coalesce(topic_key, ''), 'en.')").select("id")


@query(sql("SELECT id FROM memories WHERE (topic_key IS NULL OR NOT starts_with(topic_key, 'de.')) AND session_id <> 'src0'", "memories"))
def flt_code_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that come from code neither by their key's namespace (here `de.`) nor by their session (here `src0`)."""
    return memories(spark, sf_dir).where(~rows.from_code(F.col("topic_key"), F.col("session_id"), "de.", "src0")).select("id")


@query(sql("SELECT id FROM memories WHERE starts_with(topic_key, 'fr.')", "memories"))
def flt_trace_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where(F.col("topic_key").startswith("fr.")).select("id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE list_position(['A', 'N', 'R'], l_returnflag) >= 2")
def flt_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of at least a confidence, in the order A, N, R."""
    kept = rows.at_least(F.col("l_returnflag"), ("A", "N", "R"), "N")
    return read_table(spark, sf_dir, "lineitem").where(kept).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def flt_dynamic_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.where_given(read_table(spark, sf_dir, "events"), event_type="click", user_id=7, props="").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.08 OR l_tax > 0.07")
def flt_redacted_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").where("l_discount > 0.08 OR l_tax > 0.07").select("l_orderkey", "l_linenumber")


@query(sql("SELECT id, profile_id, session_id, type, topic_key, created_on FROM memories", "memories"))
def prj_memory_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", "profile_id", "session_id", "type", "topic_key", "created_on")


@query(sql(f"""WITH {SEEN_SQL}, selected AS (SELECT type, topic_key, arg_max(payload, sequence) AS newer FROM seen WHERE topic_key IS NOT NULL GROUP BY ALL)
    SELECT id, coalesce(newer, payload) AS payload FROM seen LEFT JOIN selected USING (type, topic_key)""", "memories"))
def prj_temporal_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible memories with the payload of the revision that is selected in their fact group (type and key), or their own."""
    visible = seen(spark, sf_dir).select("id", "type", "topic_key", "payload", "sequence")
    selected = visible.where("topic_key IS NOT NULL").groupBy("type", "topic_key").agg(F.max_by("payload", "sequence").alias("newer"))
    return visible.join(selected, ["type", "topic_key"], "left").select("id", F.coalesce("newer", "payload").alias("payload"))


# Joins


@query("""SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def join_inner_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return items.join(orders, "l_orderkey").join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").drop("c_custkey")


@query("""SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, sf_dir, "part").select("p_partkey").join(sold, "p_partkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query(sql("""SELECT c_custkey, 'out' AS side, count(*) AS n FROM customer JOIN edges ON 'c' || c_custkey = source GROUP BY 1
    UNION ALL SELECT c_custkey, 'in', count(*) FROM customer JOIN edges ON 'c' || c_custkey = target GROUP BY 1""", "edges"))
def join_or_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a customer at either end: both ends become one key, so no nested loop is needed."""
    ends = F.array(
        F.struct(F.col("source").alias("entity"), F.lit("out").alias("side")),
        F.struct(F.col("target").alias("entity"), F.lit("in").alias("side")),
    )
    touched = edges(spark, sf_dir).select(F.explode(ends).alias("x")).select("x.*")
    people = read_table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"))
    return people.join(touched, "entity").groupBy("c_custkey", "side").agg(F.count("*").alias("n"))


@query(sql("""SELECT event_id, count(*) AS n FROM (SELECT event_id, CAST(ts AS DATE) AS d, user_id FROM events) e
    JOIN memories m ON m.session_id = 'src' || (e.user_id % 20) AND m.valid_from <= e.d AND (m.valid_to IS NULL OR e.d < m.valid_to)
    WHERE m.type = 'task' GROUP BY 1""", "memories"))
def join_range_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks of an event's session were valid on its day. Both sides are first summed to days, so the
    range join runs over days of a session and not over events."""
    events = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("date").alias("d"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("session_id")
    )
    spans = memories(spark, sf_dir).where("type = 'task'").groupBy("session_id", "valid_from", "valid_to").agg(F.count("*").alias("k"))
    days = events.select("session_id", "d").distinct()
    inside = (F.col("valid_from") <= F.col("d")) & (F.col("valid_to").isNull() | (F.col("d") < F.col("valid_to")))
    per_day = days.join(spans, "session_id").where(inside).groupBy("session_id", "d").agg(F.sum("k").alias("n"))
    return events.join(per_day, ["session_id", "d"]).select("event_id", "n")


@query(sql("""SELECT t.session_id, count(*) AS n FROM (SELECT session_id FROM memories WHERE type = 'task' AND contains(content, 'idiot')) t
    JOIN memories m ON m.session_id = t.session_id GROUP BY 1""", "memories"))
def join_cross_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selective side first: its hits are summed per session before they meet the rest."""
    hits = memories(spark, sf_dir).where("type = 'task' AND contains(content, 'idiot')").groupBy("session_id").agg(F.count("*").alias("a"))
    every = memories(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("b"))
    return hits.join(every, "session_id").select("session_id", (F.col("a") * F.col("b")).alias("n"))


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    SELECT a.l_suppkey AS first, b.l_suppkey AS second, count(*) AS shared FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey
    GROUP BY ALL HAVING count(*) >= 8""")
def join_self_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts; a part's suppliers are few, which bounds the pairs."""
    pairs = sets.pairs_in_groups(read_table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return pairs.where("shared >= 8")


@query(sql("""SELECT m.id, h.n FROM memories m JOIN (SELECT 'src' || (session_id % 20) AS session_id, count(*) AS n FROM messages
    WHERE role = 'user' GROUP BY 1) h USING (session_id)""", "memories", "messages"))
def join_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir).where("role = 'user'")
    hits = said.groupBy(F.concat(F.lit("src"), (F.col("session_id") % 20).cast("string")).alias("session_id")).agg(F.count("*").alias("n"))
    return memories(spark, sf_dir).select("id", "session_id").join(hits, "session_id").select("id", "n")


# Aggregations


@query(sql("""SELECT t AS type, count(m.type) AS n FROM unnest(['fact', 'event', 'instruction', 'task', 'cluster']) u(t)
    LEFT JOIN memories m ON m.type = t GROUP BY 1""", "memories"))
def agg_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(t,) for t in (*TYPES, "cluster")], "type string")
    counts = memories(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return kinds.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql("SELECT profile_id, count(*) AS n, count(DISTINCT session_id) AS sessions, max(created_on) AS latest FROM memories GROUP BY 1", "memories"))
def agg_profile_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("profile_id").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.max("created_on").alias("latest")
    )


@query(sql(f"""SELECT profile_id, count(*) AS total, count(*) FILTER (NOT forgotten AND NOT coalesce({SEEN}, false)) AS superseded,
    count(DISTINCT session_id) AS sessions, min(created_on) AS first, max(created_on) AS last, count(*) FILTER (topic_key IS NULL) AS backlog
    FROM (SELECT {BOUNDS} FROM memories) GROUP BY 1""", "memories"))
def agg_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    superseded = ~F.col("forgotten") & ~rows.visible(SNAPSHOT)
    return segments(spark, sf_dir).groupBy("profile_id").agg(
        F.count("*").alias("total"),
        F.count_if(superseded).alias("superseded"),
        F.count_distinct("session_id").alias("sessions"),
        F.min("created_on").alias("first"),
        F.max("created_on").alias("last"),
        F.count_if(F.col("topic_key").isNull()).alias("backlog"),
    )


@query(sql(f"SELECT count(*) AS superseded FROM (SELECT {BOUNDS} FROM memories) WHERE NOT forgotten AND NOT coalesce({SEEN}, false)", "memories"))
def agg_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(~F.col("forgotten") & ~rows.visible(SNAPSHOT)).agg(F.count("*").alias("superseded"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@query("SELECT user_id, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last FROM events GROUP BY 1")
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 3")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n")).where("n >= 3")


@query(sql(f"WITH {SEEN_SQL} SELECT session_id, CAST(coalesce(sum(source_tokens), 0) AS BIGINT) AS tokens FROM seen GROUP BY 1", "memories"))
def agg_sum_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen(spark, sf_dir).groupBy("session_id").agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("tokens"))


@query(sql("""SELECT session_id, count(*) AS calls, count(*) FILTER (tool = 'view') AS recalls, count(*) FILTER (tool <> 'view') AS ingests
    FROM traces GROUP BY 1""", "traces"))
def agg_usage_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy("session_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("tool") == "view").alias("recalls"), F.count_if(F.col("tool") != "view").alias("ingests")
    )


@query("""WITH p(tier, prompt_price, completion_price) AS (VALUES ('view', 0.25, 2.0), ('click', 1.25, 10.0), ('signup', 5.0, 25.0)),
    u AS (SELECT event_type AS tier, CAST(floor(value * 100) AS BIGINT) AS prompt, CAST(json_extract(props, '$.k') AS BIGINT) AS completion FROM events)
    SELECT tier, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(completion) AS BIGINT) AS completion_tokens,
        round(CAST(sum(prompt) AS DOUBLE) / 1e6 * CAST(max(prompt_price) AS DOUBLE) + CAST(sum(completion) AS DOUBLE) / 1e6 * CAST(max(completion_price) AS DOUBLE), 9) AS cost FROM u LEFT JOIN p USING (tier) GROUP BY 1""")
def agg_tier_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost by tier; a tier without a price has no cost."""
    prices = spark.createDataFrame([("view", 0.25, 2.0), ("click", 1.25, 10.0), ("signup", 5.0, 25.0)], "tier string, prompt_price double, completion_price double")
    calls = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tier"), F.floor(F.col("value") * 100).alias("prompt"), F.get_json_object("props", "$.k").cast("long").alias("completion")
    )
    return rows.spend(calls, prices).withColumn("cost", F.round("cost", 9))


@query("""SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM (
    SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY ALL
    UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL)) WHERE r <= 50""")
def agg_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.facets(read_table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query(sql("""SELECT session_id, CAST(sum(m) AS BIGINT) AS memories, CAST(sum(s) AS BIGINT) AS messages FROM (SELECT session_id, count(*) AS m, 0 AS s FROM memories GROUP BY 1
    UNION ALL SELECT 'src' || (session_id % 20), 0, count(*) FROM messages GROUP BY 1) GROUP BY 1""", "memories", "messages"))
def agg_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = memories(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("m")).withColumn("s", F.lit(0).cast("long"))
    key = F.concat(F.lit("src"), (F.col("session_id") % 20).cast("string")).alias("session_id")
    said = messages(spark, sf_dir).groupBy(key).agg(F.count("*").alias("s")).withColumn("m", F.lit(0).cast("long"))
    return kept.unionByName(said).groupBy("session_id").agg(F.sum("m").alias("memories"), F.sum("s").alias("messages"))


@query(sql("SELECT session_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM traces GROUP BY 1", "traces"))
def agg_group_array_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


@query(sql("""SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)) AS entities""", "edges"))
def agg_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = rows.endpoints(edges(spark, sf_dir))
    return counted.groupBy("entity").agg(F.count("*").alias("n")).agg((F.sum("n") / 2).cast("long").alias("edges"), F.count("*").alias("entities"))


@query(sql("SELECT left(e, 1) AS kind, count(*) AS n FROM (SELECT source AS e FROM edges UNION SELECT target FROM edges) GROUP BY 1", "edges"))
def agg_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.endpoints(edges(spark, sf_dir)).distinct().groupBy(F.left("entity", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


@query(sql("SELECT e AS entity, count(*) AS degree FROM (SELECT source AS e FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1", "edges"))
def agg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.endpoints(edges(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("degree"))


@query(sql("""SELECT relation, 'out' AS direction, left(source, 1) AS kind, count(*) AS n FROM edges GROUP BY ALL
    UNION ALL SELECT relation, 'in', left(target, 1), count(*) FROM edges GROUP BY ALL""", "edges"))
def agg_relation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.left("source", F.lit(1)).alias("kind")),
                              F.struct(F.lit("in").alias("direction"), F.left("target", F.lit(1)).alias("kind"))))
    return edges(spark, sf_dir).select("relation", sides.alias("x")).select("relation", "x.*").groupBy("relation", "direction", "kind").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_linestatus = 'F') AS resolved,
    count(*) FILTER (l_linestatus <> 'F') AS heuristic FROM lineitem""")
def agg_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    return read_table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("heuristic")
    )


JUDGED = "SELECT *, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN toxic = 1 THEN 'wrong' ELSE 'abstained' END AS verdict FROM labels"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("toxic") == 1, "wrong").otherwise("abstained")
    return read_table(spark, sf_dir, "labels").withColumn("verdict", verdict)


def _rate(part: F.Column, whole: F.Column) -> F.Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 9))


def _scores() -> list[F.Column]:
    n = F.count("*")
    return [n.alias("n"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "wrong", "abstained")),
            _rate(F.count_if(F.col("verdict") == "correct"), n).alias("accuracy")]


SCORES = """count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong,
    count(*) FILTER (verdict = 'abstained') AS abstained, round(count(*) FILTER (verdict = 'correct') / count(*), 9) AS accuracy"""


@query(f"SELECT {SCORES} FROM ({JUDGED})")
def agg_eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).agg(*_scores())


@query(f"SELECT doc_id % 5 AS category, {SCORES} FROM ({JUDGED}) GROUP BY 1")
def agg_eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("category")).agg(*_scores())


@query("""SELECT event_type AS tier, round(sum(value), 4) AS spent, bool_or(value > 90) AS priced FROM events GROUP BY 1""")
def agg_spend_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tier")).agg(
        F.round(F.sum("value"), 4).alias("spent"), F.bool_or(F.col("value") > 90).alias("priced")
    )


@query(f"""WITH j AS ({JUDGED}) SELECT count(*) FILTER (quality = 1) AS extracted, count(*) FILTER (quality = 1 AND toxic = 0) AS retrieved,
    count(*) FILTER (quality = 1 AND toxic = 0 AND verdict = 'correct' AND doc_id % 3 <> 0) AS answered FROM j""")
def ev_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A funnel: each gate counts only what passed the one before."""
    one, two = F.col("quality") == 1, F.col("toxic") == 0
    three = (F.col("verdict") == "correct") & (F.col("doc_id") % 3 != 0)
    return judged(spark, sf_dir).agg(F.count_if(one).alias("extracted"), F.count_if(one & two).alias("retrieved"), F.count_if(one & two & three).alias("answered"))


# Ranks


@query(sql("""SELECT type, topic_key, arg_max(id, (created_on, sequence)) AS id FROM memories WHERE topic_key IS NOT NULL GROUP BY 1, 2""", "memories"))
def win_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = memories(spark, sf_dir).where("topic_key IS NOT NULL").select("type", "topic_key", "created_on", "sequence", "id")
    return rows.latest_per_key(kept, ["type", "topic_key"], ["created_on", "sequence"]).select("type", "topic_key", "id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def win_latest_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return rows.latest_per_key(kept, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def win_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return rows.latest_per_key(kept, ["o_custkey"], ["o_orderkey"])


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings QUALIFY rank <= 10")
def win_rank_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark filters ranks up to a limit within tasks before it shuffles, so a hot channel stays small."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return read_table(spark, sf_dir, "embeddings").select("label", "vec_id", rank.alias("rank")).where("rank <= 10")


@query(sql("""WITH l AS (SELECT tool, status, session_id, max(event_id) AS event_id FROM traces GROUP BY 1, 2, 3)
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS place FROM l""", "traces"))
def win_last_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each signature and status in a session, in the order in which they came."""
    kept = traces(spark, sf_dir).select("tool", "status", "session_id", "event_id")
    last = rows.latest_per_key(kept, ["tool", "status", "session_id"], ["event_id"])
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")))


@query("""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, (length(text) + 3) // 4 AS t FROM conversations),
    c AS (SELECT conv_id, place AS chunk, greatest(place - 1 - conv_id % 3, 0) AS first, place AS last FROM m WHERE place % 2 = 1),
    o AS (SELECT m.conv_id, m.t, min(chunk) AS chunk FROM m JOIN c ON c.conv_id = m.conv_id AND place BETWEEN first AND last GROUP BY m.conv_id, m.place, m.t)
    SELECT c.conv_id AS session_id, c.chunk, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens FROM c LEFT JOIN o USING (conv_id, chunk) GROUP BY ALL""")
def win_prefix_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a chunk's turns that no earlier chunk has accounted for; chunks end at every second turn and reach back two to four."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    said = messages(spark, sf_dir).select("session_id", place.cast("long").alias("place"), text.tokens_estimate(F.col("content")).alias("tokens"))
    first = F.greatest(F.col("place") - 1 - F.col("session_id") % 3, F.lit(0))
    chunks = said.where("place % 2 = 1").select("session_id", F.col("place").alias("chunk"), first.alias("first"), F.col("place").alias("last"))
    return ingest.new_tokens(chunks, said)


# Order and pages


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(sql("""SELECT id, created_on FROM memories WHERE (created_on, id) < (DATE '2024-12-01', 'f') ORDER BY created_on DESC, id DESC LIMIT 21""", "memories"))
def top_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = memories(spark, sf_dir).select("id", "created_on")
    return rows.keyset_page(kept, "created_on", "id", 20, (datetime.date(2024, 12, 1), "f"))


@query(sql(f"""WITH {SEEN_SQL}, s AS (SELECT id, sequence FROM memories WHERE contains(content, 'the') ORDER BY sequence LIMIT 300)
    SELECT id FROM s WHERE id IN (SELECT id FROM seen) ORDER BY sequence LIMIT 40""", "memories"))
def top_paged_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty eligible hits; of those that match, no more than 300 are looked at, however few of them are visible."""
    hits = segments(spark, sf_dir).where(F.contains("content", F.lit("the")))
    return rows.eligible_page(hits, rows.visible(SNAPSHOT), [F.col("sequence")], scan=300, limit=40).select("id")


@query(sql("""WITH d AS (SELECT entity, degree FROM (SELECT e AS entity, count(*) AS degree FROM (SELECT source AS e FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)
    ORDER BY degree DESC, entity LIMIT 31) SELECT entity, degree, (SELECT count(*) FROM d) > 30 AS truncated FROM d ORDER BY degree DESC, entity LIMIT 30""", "edges"))
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty entities of highest degree, and whether there are more."""
    degrees = rows.endpoints(edges(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("degree"))
    return rows.capped(degrees, [F.desc("degree"), F.col("entity")], 30)


@query(sql("SELECT id, topic_key FROM memories ORDER BY topic_key DESC NULLS LAST, id LIMIT 50", "memories"))
def top_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", "topic_key").orderBy(F.desc_nulls_last("topic_key"), "id").limit(50)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 50")
def top_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey").limit(50)


# Set operations


@query(sql("SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges", "edges"))
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b")))


@query(sql("SELECT memory_id, source AS entity FROM edges UNION SELECT memory_id, target FROM edges", "edges"))
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.endpoints(edges(spark, sf_dir), "memory_id").distinct()


@query("""SELECT o_custkey AS id, min(p) AS priority FROM (SELECT o_custkey, 1 AS p FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_totalprice > 300 UNION ALL SELECT o_custkey, 3 FROM orders) GROUP BY 1""")
def set_candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first channel that offers a candidate counts; one scan gives all channels."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_totalprice") > 300, 2).otherwise(3)
    return read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(urgent).alias("priority"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]),
    CAST(q AS DOUBLE[])), 6) AS distance FROM embeddings, q WHERE label <> 9 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), vec_id LIMIT 10""")
def vec_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, distance, order, limit: no candidate is lost to a filter that comes too late."""
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    one = table.agg(F.min_by("embedding", "vec_id").alias("q"))
    near = table.where("label <> 9").join(F.broadcast(one)).select("vec_id", vectors.l2(F.col("embedding"), F.col("q")).alias("d"))
    return near.orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 6).alias("distance"))
