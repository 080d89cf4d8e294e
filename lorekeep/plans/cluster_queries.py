"""Queries of clustering, page projection, ingestion, traces, evaluation and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import clusters, graph, ingest, pages, ranges, rows, search
from lorekeep.plans.derived import edges, memories, messages, sql, traces
from lorekeep.plans.engine_queries import FTS_SQL, PROBES_SQL, VECTOR_SQL, keyed_hits, nearest, probes
from lorekeep.plans.functions_queries import STOP
from lorekeep.plans.registry import query
from lorekeep.plans.relational_queries import SEEN_SQL, seen
from lorekeep.sources.tables import read_table
from lorekeep.streaming import outcomes

# Clusters


@query(sql(f"""WITH {SEEN_SQL}, g AS (SELECT topic_key FROM seen WHERE topic_key IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
    SELECT topic_key, id FROM seen WHERE topic_key IN (SELECT topic_key FROM g) QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY id) <= 21""", "memories"))
def cl_topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = seen(spark, sf_dir).where("topic_key IS NOT NULL").select("topic_key", "id")
    big = keyed.groupBy("topic_key").agg(F.count("*").alias("n")).where("n >= 3").select("topic_key")
    return search.ranked(keyed.join(big, "topic_key"), 21, [F.col("id")], by="topic_key").select("topic_key", "id")


@query(sql("""WITH k AS (SELECT DISTINCT topic_key, regexp_extract(source || 'x:' || topic_key, '^([^:]+):', 1) AS prefix FROM (
        SELECT topic_key, CASE WHEN sequence % 6 = 0 THEN 'code' WHEN sequence % 6 = 1 THEN 'ab' ELSE session_id END AS source FROM memories WHERE topic_key IS NOT NULL))
    SELECT prefix, count(*) AS clusters FROM k WHERE length(prefix) >= 4 AND prefix NOT IN ('code', 'trace', 'task', 'project', 'general') GROUP BY 1 HAVING count(*) >= 2""", "memories"))
def cl_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces of two scopes or more; short and generic ones tell nothing."""
    n = F.col("sequence") % 6
    name = F.when(n == 0, "code").when(n == 1, "ab").otherwise(F.col("session_id"))
    keyed = memories(spark, sf_dir).where("topic_key IS NOT NULL").select("topic_key", F.concat(name, F.lit("x:"), "topic_key").alias("scope"))
    prefix = F.regexp_extract("scope", "^([^:]+):", 1)
    keys = keyed.select("topic_key", prefix.alias("prefix")).distinct()
    kept = (F.length("prefix") >= 4) & ~F.lower("prefix").isin(*clusters.GENERIC)
    return keys.where(kept).groupBy("prefix").agg(F.count("*").alias("clusters")).where("clusters >= 2")


@query(sql("""SELECT entity, count(DISTINCT memory_id) AS memories FROM (SELECT source AS entity, memory_id FROM edges UNION ALL SELECT target, memory_id FROM edges)
    GROUP BY 1 HAVING count(DISTINCT memory_id) >= 3""", "edges"))
def cl_entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = rows.endpoints(edges(spark, sf_dir), "memory_id")
    return ends.groupBy("entity").agg(F.count_distinct("memory_id").alias("memories")).where("memories >= 3")


@query(sql(f"""WITH {SEEN_SQL} SELECT DISTINCT id FROM seen JOIN (SELECT event_id % 1000 AS sequence FROM events WHERE event_id > 500 AND event_id <= 700) USING (sequence)""", "memories"))
def cl_discovery_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible memories that a window of the change feed names (an event changes the memory of its number)."""
    feed = read_table(spark, sf_dir, "events").where("event_id > 500 AND event_id <= 700").select((F.col("event_id") % 1000).alias("sequence"))
    return seen(spark, sf_dir).join(feed, "sequence", "left_semi").select("id")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS cluster, l_partkey AS m FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS m FROM lineitem WHERE l_linenumber > 1),
    x AS (SELECT cluster, count(*) AS n FROM a GROUP BY 1), y AS (SELECT id, count(*) AS n FROM p GROUP BY 1),
    k AS (SELECT id, cluster, count(*) AS k FROM a JOIN p USING (m) GROUP BY ALL),
    s AS (SELECT id, cluster, k / (x.n + y.n - k) AS likeness FROM k JOIN x USING (cluster) JOIN y USING (id))
    SELECT id, cluster, round(likeness, 9) AS likeness FROM s WHERE likeness > 0.74 QUALIFY row_number() OVER (PARTITION BY id ORDER BY likeness DESC, cluster) = 1""")
def cl_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed groups (the parts of an order without its first line) and the active cluster (the parts of an order) each overlaps most."""
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("member"), "l_linenumber")
    found = clusters.best_overlaps(items.where("l_linenumber > 1"), items, 0.74)
    return found.withColumn("likeness", F.round("likeness", 9))


@query("""SELECT o_custkey, substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey)), 1, 32) AS fingerprint FROM orders GROUP BY 1""")
def cl_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), "\n")
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(members.alias("m")).select("o_custkey", text.hash128(F.col("m")).alias("fingerprint"))


@query("""WITH k AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || ':' || l_suppkey % 5, ',' ORDER BY l_returnflag || ':' || l_suppkey % 5) AS members FROM lineitem GROUP BY 1)
    SELECT l_orderkey, members FROM k WHERE members NOT IN (SELECT members FROM k WHERE l_orderkey % 50 = 1)""")
def cl_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose members (kind and id) are those of a dissolved group are not proposed again."""
    member = F.concat("l_returnflag", F.lit(":"), (F.col("l_suppkey") % 5).cast("string"))
    k = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("members"))
    return k.join(k.where("l_orderkey % 50 = 1").select("members").distinct(), "members", "left_anti").select("l_orderkey", "members")


@query(sql(f"""WITH {SEEN_SQL}, s AS (SELECT type, topic_key, arg_max(id, sequence) AS revision FROM seen WHERE topic_key IS NOT NULL GROUP BY ALL)
    SELECT topic_key, id, revision FROM seen JOIN s USING (type, topic_key)""", "memories"))
def cl_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible originals of each cluster, beside the revision that is selected in their fact group."""
    kept = seen(spark, sf_dir).where("topic_key IS NOT NULL").select("type", "topic_key", "id", "sequence")
    selected = kept.groupBy("type", "topic_key").agg(F.max_by("id", "sequence").alias("revision"))
    return kept.join(selected, ["type", "topic_key"]).select("topic_key", "id", "revision")


@query(sql("""SELECT topic_key, max(created_on) AS updated FROM memories WHERE contains(lower(topic_key), 'src1') GROUP BY 1 ORDER BY updated DESC, topic_key LIMIT 30""", "memories"))
def cl_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = memories(spark, sf_dir).where(rows.contains_ignoring_case(F.col("topic_key"), "SRC1"))
    return hits.groupBy("topic_key").agg(F.max("created_on").alias("updated")).orderBy(F.desc("updated"), "topic_key").limit(30)


@query(sql("""WITH r AS (SELECT topic_key, id, row_number() OVER (PARTITION BY topic_key ORDER BY sequence) AS revision, type, sequence, from_sequence FROM memories WHERE topic_key IS NOT NULL)
    SELECT topic_key, id, revision, revision = max(revision) OVER (PARTITION BY topic_key) AS current FROM r WHERE from_sequence <= 600""", "memories"))
def cl_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of every cluster as it was at a snapshot: all revisions until then, the last one being current."""
    known = memories(spark, sf_dir).where("topic_key IS NOT NULL AND from_sequence <= 600").select("topic_key", "id", "sequence")
    last = known.groupBy("topic_key").agg(F.max("sequence").alias("last"))
    return ranges.numbered(known, "topic_key", ["sequence"], "revision").join(last, "topic_key").select("topic_key", "id", "revision", (F.col("sequence") == F.col("last")).alias("current"))


@query(sql(f"""WITH {PROBES_SQL}, t AS (SELECT query_id, unnest(list_distinct(list_filter(string_split_regex(lower(said), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3
        AND x NOT IN ('the', 'and', 'for', 'with', 'from', 'what', 'how', 'are', 'was', 'this', 'that', 'does', 'can')))) AS term FROM probes),
    c AS (SELECT topic_key, sequence, lower(content) AS claim FROM memories WHERE topic_key IS NOT NULL),
    m AS (SELECT DISTINCT query_id, topic_key, sequence FROM c JOIN t ON contains(claim, term))
    SELECT query_id, topic_key, count(DISTINCT source) AS covered FROM (SELECT query_id, topic_key, unnest([sequence, sequence + 1]) AS source FROM m) GROUP BY ALL""", "memories"))
def cl_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals that are covered by a cluster's claims with a term of a query anywhere in them; a claim (a memory's text) covers two."""
    terms = probes(spark, sf_dir).select("query_id", F.explode(text.claim_terms(F.col("said"))).alias("term"))
    claims = memories(spark, sf_dir).where("topic_key IS NOT NULL").select("sequence", F.lower("content").alias("claim"), "topic_key")
    held = search.contained(claims, "claim", terms.select("term").distinct()).select("topic_key", "sequence", "term")
    met = held.join(terms, "term").select("query_id", "topic_key", F.explode(F.array("sequence", F.col("sequence") + 1)).alias("source"))
    return met.groupBy("query_id", "topic_key").agg(F.count_distinct("source").alias("covered"))


@query(sql("""WITH RECURSIVE up AS (SELECT DISTINCT source AS entity FROM edges WHERE sequence % 11 = 0 AND source LIKE 'o%' UNION
    SELECT target FROM up JOIN edges ON source = entity) SELECT entity FROM up""", "edges"))
def cl_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed and everything above it."""
    e = edges(spark, sf_dir)
    changed = e.where("sequence % 11 = 0 AND source LIKE 'o%'").select(F.col("source").alias("entity"))
    return clusters.closure(e.select(F.col("source").alias("child"), F.col("target").alias("parent")), changed)


@query("""WITH s AS (SELECT c_custkey AS profile, c_custkey % 3 <> 0 AS enabled, printf('%02d:%02d', c_custkey % 24, c_custkey % 7) AS local_time,
        [0, 2, 9, -4][CAST(c_nationkey % 4 + 1 AS INT)] AS hours, CASE WHEN c_custkey % 5 = 0 THEN '2024-07-01' END AS last_date FROM customer),
    t AS (SELECT *, TIMESTAMP '2024-07-01 12:01:30' + to_hours(hours) AS local FROM s)
    SELECT profile, strftime(local, '%Y-%m-%d') AS local_date FROM t WHERE enabled AND date_diff('second', strptime(strftime(local, '%Y-%m-%d') || ' ' || local_time, '%Y-%m-%d %H:%M'), local) BETWEEN 0 AND 119
        AND (last_date IS NULL OR last_date <> strftime(local, '%Y-%m-%d'))""")
def cl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles (customers) whose daily time has come, each in its own time zone."""
    key = F.col("c_custkey")
    zones = F.array(*map(F.lit, ("UTC", "Europe/Berlin", "Asia/Tokyo", "America/New_York")))
    schedules = read_table(spark, sf_dir, "customer").select(
        key.alias("profile"),
        (key % 3 != 0).alias("enabled"),
        F.format_string("%02d:%02d", key % 24, key % 7).alias("local_time"),
        F.element_at(zones, F.col("c_nationkey") % 4 + 1).alias("zone"),
        F.when(key % 5 == 0, "2024-07-01").alias("last_date"),
    )
    return clusters.due(schedules, F.lit("2024-07-01 12:01:30").cast("timestamp")).select("profile", "local_date")


# Pages


@query(sql("""WITH t AS (SELECT sequence, 'topic:' || topic_key AS page, 'group:' || CASE WHEN starts_with(topic_key, 'code:') THEN 'code:' ELSE 'topic:' END
        || regexp_extract(topic_key, '^[^:.]*') AS parent FROM memories WHERE topic_key IS NOT NULL),
    e AS (SELECT DISTINCT m.sequence, 'entity:' || x AS page, 'group:entity:' || left(x, 1) AS parent FROM memories m
        JOIN (SELECT sequence, source AS x FROM edges UNION SELECT sequence, target FROM edges) USING (sequence)), b AS (SELECT * FROM t UNION ALL SELECT * FROM e)
    SELECT sequence, page, parent FROM b UNION SELECT sequence, parent, CASE WHEN starts_with(parent, 'group:entity:') THEN 'directory:Entities'
        WHEN starts_with(parent, 'group:code:') THEN 'directory:Code' ELSE 'directory:Topics' END FROM b""", "memories", "edges"))
def wk_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of which each memory is a core member: its topic's, its entities', and the directories over them."""
    known = memories(spark, sf_dir).select("sequence", "topic_key")
    entities = rows.endpoints(edges(spark, sf_dir), "sequence").distinct()
    return pages.anchors(known, entities)


@query(sql("""SELECT e AS entity FROM (SELECT memory_id, source AS e FROM edges UNION SELECT memory_id, target FROM edges) GROUP BY 1
    HAVING count(*) <= greatest(10, 0.1 * (SELECT count(DISTINCT memory_id) FROM edges))""", "edges"))
def wk_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of ten memories at most, or of a tenth of them."""
    ends = rows.endpoints(edges(spark, sf_dir), "memory_id").distinct()
    whole = ends.agg(F.count_distinct("memory_id").alias("m"))
    counted = ends.groupBy("entity").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(whole)).where("n <= greatest(10, 0.1 * m)").select("entity")


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name), p_partkey) > ('part#1', 5) ORDER BY lower(p_name), p_partkey LIMIT 21")
def wk_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = F.struct(F.lower("p_name"), "p_partkey") > F.struct(F.lit("part#1"), F.lit(5).cast("long"))
    return table.where(after).orderBy(F.lower("p_name"), "p_partkey").limit(21)


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fts
        WHERE id IN (SELECT sequence FROM seen) QUALIFY rank <= 10),
    e AS (SELECT k.item_id AS query_id, s.sequence AS id, row_number() OVER (PARTITION BY k.item_id ORDER BY s.created_on DESC, s.sequence) AS rank FROM benchmark k
        JOIN memories m ON m.sequence = k.item_id JOIN seen s ON s.topic_key = m.topic_key WHERE k.item_id % 20 = 0 QUALIFY rank <= 10),
    {VECTOR_SQL}, r AS (SELECT * FROM f UNION ALL SELECT * FROM e UNION ALL SELECT query_id, id, rank FROM near_top WHERE query_id IN (SELECT query_id FROM probes))
    SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY ALL""", "memories"))
def wk_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three routes with equal weights: full text, the exact key (that of the memory of the query's number) and vectors."""
    visible = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "topic_key", "created_on")
    scored = search.bm25(read_table(spark, sf_dir, "documents"), probes(spark, sf_dir), "doc_id", "text")
    worded = search.ranked(scored.join(visible.select("id"), "id", "left_semi"), 10, [F.desc(F.round("score", 9)), F.col("id")])
    asked = probes(spark, sf_dir).select("query_id")
    keys = asked.join(memories(spark, sf_dir).select(F.col("sequence").alias("query_id"), "topic_key"), "query_id")
    exact = keyed_hits(visible, keys)
    near = nearest(spark, sf_dir, asked=asked)
    routes = search.channel(worded, "fts").unionByName(search.channel(exact, "exact")).unionByName(search.channel(near, "vector"))
    fused = search.fuse(routes, weights=dict.fromkeys(("fts", "exact", "vector"), 1.0))
    return fused.select("query_id", "id", F.round("score", 9).alias("score"))


@query(sql(f"""WITH {SEEN_SQL}, picked AS (SELECT topic_key AS page, sequence FROM seen WHERE topic_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY created_on DESC, sequence) <= 40),
    c AS (SELECT topic_key AS page, sequence AS claim, unnest([sequence, sequence + 80, sequence + 160]) AS source FROM memories WHERE topic_key IS NOT NULL),
    s AS (SELECT page, claim, source FROM c WHERE source IN (SELECT sequence FROM memories WHERE topic_key = page))
    SELECT s.page, claim FROM s LEFT JOIN picked ON picked.page = s.page AND picked.sequence = s.source GROUP BY ALL HAVING bool_and(picked.sequence IS NOT NULL)""", "memories"))
def wk_cluster_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of pages (topics) all of whose supports are among the page's selected evidence, its forty newest visible sources. A claim rests on its
    memory and on those numbered 80 and 160 later, if they are of its topic."""
    visible = seen(spark, sf_dir).where("topic_key IS NOT NULL").select(F.col("topic_key").alias("page"), F.col("sequence").alias("id"), "created_on")
    picked = search.ranked(visible, 40, [F.desc("created_on"), F.col("id")], by="page").select("page", "id")
    known = memories(spark, sf_dir).where("topic_key IS NOT NULL").select(F.col("topic_key").alias("page"), F.col("sequence").alias("id"))
    n = F.col("claim")
    supports = known.select("page", F.col("id").alias("claim")).withColumn("id", F.explode(F.array(n, n + 80, n + 160)))
    return pages.supported_claims(supports.join(known, ["page", "id"], "left_semi"), picked)


@query("""WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 10 = 0)
    SELECT o_orderkey AS peer FROM orders WHERE o_orderkey % 10 <> 0 AND (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM s)""")
def wk_fact_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else is said of the facts (customer and priority) of selected orders (every tenth): each peer once, however many of them are selected."""
    table = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    chosen = table.where("o_orderkey % 10 = 0").select("o_custkey", "o_orderpriority")
    others = table.where("o_orderkey % 10 <> 0").join(chosen, ["o_custkey", "o_orderpriority"], "left_semi")
    return others.select(F.col("o_orderkey").alias("peer"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS page, CASE WHEN p_partkey % 4 = 0 OR p_partkey < 2 THEN NULL ELSE p_partkey - 1 END AS next FROM part),
    walk AS (SELECT page, page AS here, 0 AS steps FROM r UNION ALL SELECT walk.page, r.next, steps + 1 FROM walk JOIN r ON r.page = walk.here WHERE r.next IS NOT NULL)
    SELECT page, arg_max(here, steps) AS canonical FROM walk GROUP BY 1""")
def wk_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects followed to their end, however long the chain."""
    key = F.col("p_partkey")
    parts = read_table(spark, sf_dir, "part").select(key.alias("page"))
    redirects = parts.where((F.col("page") % 4 != 0) & (F.col("page") >= 2)).select("page", (F.col("page") - 1).alias("to"))
    ends = graph.redirect_ends(redirects)
    return parts.join(ends, "page", "left").select("page", F.coalesce("canonical", "page").alias("canonical"))


@query("""WITH o AS (SELECT l_orderkey AS page, o_orderdate AS created, o_custkey % 7 AS parent, l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    m AS (SELECT DISTINCT page, id, created, parent FROM o UNION SELECT DISTINCT -page, l_partkey, o_orderdate + INTERVAL 1 DAY, CASE WHEN page % 5 = 0 THEN 99 ELSE parent END FROM o
        JOIN lineitem ON l_orderkey = page JOIN orders ON o_orderkey = page WHERE l_linenumber > 1),
    z AS (SELECT page, count(*) AS n FROM m GROUP BY 1),
    k AS (SELECT a.page AS first, b.page AS second, count(*) AS k FROM m a JOIN m b ON a.id = b.id AND a.page < b.page AND a.parent = b.parent GROUP BY ALL),
    q AS (SELECT first, second FROM k JOIN z x ON x.page = first JOIN z y ON y.page = second WHERE k / (x.n + y.n - k) >= 0.8 - 1e-9),
    r AS (SELECT page, id FROM m QUALIFY row_number() OVER (PARTITION BY page ORDER BY id) <= 8),
    w AS (SELECT p_partkey AS id, p_brand, list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS t FROM part),
    f AS (SELECT id, p_brand, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE list_distinct(t) END AS s FROM w),
    p AS (SELECT DISTINCT first, second FROM q JOIN r a ON a.page = first JOIN r b ON b.page = second JOIN f x ON x.id = a.id JOIN f y ON y.id = b.id AND y.p_brand = x.p_brand
        WHERE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.6),
    d AS (SELECT DISTINCT page, created FROM m)
    SELECT CASE WHEN (a.created, first) <= (b.created, second) THEN first ELSE second END AS keep, CASE WHEN (a.created, first) <= (b.created, second) THEN second ELSE first END AS remove,
        abs(keep) % 2 = 0 AND keep = -remove AS confirmed FROM p JOIN d a ON a.page = first JOIN d b ON b.page = second""")
def wk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (orders and, with negative ids, later ones without the first line) of one parent that share 0.8 of their members, two
    of which are of one brand and alike in name and type, go into the older one once two rounds have found it; the earlier round is that of the even ones."""
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id"), "l_linenumber")
    members = items.select("page", "id").unionByName(items.where("l_linenumber > 1").select((-F.col("page")).alias("page"), "id"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("created"), (F.col("o_custkey") % 7).alias("parent"))
    later = orders.select((-F.col("page")).alias("page"), (F.col("created") + F.expr("INTERVAL 1 DAY")).alias("created"), F.when(F.col("page") % 5 == 0, 99).otherwise(F.col("parent")).alias("parent"))
    signatures = members.distinct().groupBy("page").agg(clusters.set_signature(F.col("id")).alias("signature"))
    described = rows.settled(orders.unionByName(later).join(signatures, "page"))
    none = [F.array().cast("array<string>").alias("entities"), F.lit(None).cast("array<double>").alias("v")]
    words = text.shingles(F.concat_ws(" ", "p_name", "p_type")).alias("shingles")
    features = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic_key"), *none, words)
    pairs = described.select(F.col("page").alias("keep"), F.col("signature").alias("a")).join(
        described.select((-F.col("page")).alias("keep"), F.col("page").alias("remove"), F.col("signature").alias("b")), "keep"
    )
    both = F.concat_ws("\n", F.col("a").cast("string"), F.col("b").cast("string"))
    earlier = pairs.where("keep > 0 AND keep % 2 = 0").select("keep", "remove", both.alias("signature"))
    return pages.merges(described, members, earlier, features)


@query(sql(f"""WITH {SEEN_SQL}, live AS (SELECT topic_key AS page, bit_xor(CAST('0x' || left(md5(id), 15) AS BIGINT)) AS signature FROM seen WHERE topic_key IS NOT NULL GROUP BY 1),
    old AS (SELECT topic_key AS page, bit_xor(CAST('0x' || left(md5(id), 15) AS BIGINT)) AS signature FROM seen WHERE topic_key IS NOT NULL AND (sequence < 300 OR profile_id = 'de') GROUP BY 1),
    pieces AS (SELECT topic_key AS page, id, left(content, 300) || ' ' AS piece, coalesce(sum(length(left(content, 300)) + 1) OVER (PARTITION BY topic_key ORDER BY id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seen WHERE topic_key IS NOT NULL),
    text AS (SELECT page, md5(string_agg(piece, '' ORDER BY id)) AS excerpt FROM pieces WHERE before < 2000 GROUP BY 1)
    SELECT k.page, CASE WHEN live.page IS NULL THEN 'retired' ELSE 'active' END AS lifecycle, CASE WHEN live.signature IS NOT DISTINCT FROM old.signature THEN 1 ELSE 2 END AS revision, excerpt
    FROM (SELECT DISTINCT topic_key AS page FROM memories WHERE topic_key IS NOT NULL) k LEFT JOIN live USING (page) LEFT JOIN old USING (page) LEFT JOIN text USING (page)""", "memories"))
def wk_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lifecycle, its excerpt, and its revision, which goes up where the members are no longer those of the stored page."""
    members = seen(spark, sf_dir).where("topic_key IS NOT NULL").select(F.col("topic_key").alias("page"), "id", "content", "sequence", "profile_id")
    live = members.groupBy("page").agg(clusters.set_signature(F.col("id")).alias("signature"))
    old = members.where("sequence < 300 OR profile_id = 'de'").groupBy("page").agg(clusters.set_signature(F.col("id")).alias("old"))
    keys = memories(spark, sf_dir).where("topic_key IS NOT NULL").select(F.col("topic_key").alias("page")).distinct()
    found = keys.join(live, "page", "left").join(old, "page", "left").join(clusters.excerpts(members), "page", "left")
    state = F.when(F.col("signature").isNotNull(), "active").otherwise("retired")
    revision = F.when(F.col("signature").eqNullSafe(F.col("old")), 1).otherwise(2)
    return found.select("page", state.alias("lifecycle"), revision.alias("revision"), F.md5("excerpt").alias("excerpt"))


# Ingestion


@query(sql("""SELECT session_id, turn, trim(role) AS role, md5(CASE turn % 3 WHEN 0 THEN content WHEN 1 THEN strftime(said_on - 1, '%Y-%m-%d') || ': ' || content
    ELSE content || ' in ' || strftime(said_on + INTERVAL 1 MONTH, '%B %Y') END) AS content_md5 FROM messages WHERE trim(role) <> '' AND trim(content) <> ''""", "messages"))
def in_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three messages are given a relative date, which becomes what it meant on the day."""
    n = F.col("turn") % 3
    said = F.when(n == 0, F.col("content")).when(n == 1, F.concat(F.lit("Yesterday: "), "content")).otherwise(F.concat("content", F.lit(" in the next month")))
    made = messages(spark, sf_dir).withColumn("content", F.when(F.trim("content") != "", said).otherwise(F.col("content")))
    return ingest.normalize(made).select("session_id", "turn", "role", F.md5("content").alias("content_md5"))


@query(sql("SELECT id, min(session_id * 1000 + turn) AS sequence FROM messages GROUP BY 1", "messages"))
def in_store_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = messages(spark, sf_dir).withColumn("sequence", F.col("session_id") * 1000 + F.col("turn"))
    return rows.first_per_key(numbered.select("id", "sequence"), ["id"], ["sequence"])


@query("""WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, length(role) + length(text) + 8 AS cost FROM conversations),
    w AS (SELECT conv_id, place, CAST(0 AS BIGINT) AS chunk, CAST(cost AS BIGINT) AS size FROM m WHERE place = 0
        UNION ALL SELECT m.conv_id, m.place, CASE WHEN size + cost + 1 > 2000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + cost + 1 > 2000 THEN cost ELSE size + cost + 1 END
        FROM w JOIN m ON m.conv_id = w.conv_id AND m.place = w.place + 1)
    SELECT conv_id AS session_id, chunk, min(place) AS first, max(place) AS last, max(size) AS chars FROM w GROUP BY ALL""")
def in_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk(messages(spark, sf_dir), 2000)


@query("""WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, length(role) + length(text) + 8 AS cost FROM conversations),
    w AS (SELECT conv_id, place, CAST(0 AS BIGINT) AS chunk, CAST(cost AS BIGINT) AS size FROM m WHERE place = 0
        UNION ALL SELECT m.conv_id, m.place, CASE WHEN size + cost + 1 > 800 THEN chunk + 1 ELSE chunk END, CASE WHEN size + cost + 1 > 800 THEN cost ELSE size + cost + 1 END
        FROM w JOIN m ON m.conv_id = w.conv_id AND m.place = w.place + 1),
    c AS (SELECT conv_id AS session_id, chunk, max(size) AS size FROM w GROUP BY ALL)
    SELECT session_id, chunk FROM c WHERE NOT (session_id % 3 = 0 AND chunk % 2 = 0)
        AND (session_id % 4 = 0 OR chunk < (SELECT max(chunk) FROM c d WHERE d.session_id = c.session_id))""")
def in_chunk_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to take in: not those the ledger has (every second of every third session), nor the last of a session that may still grow."""
    chunks = ingest.chunk(messages(spark, sf_dir), 800).withColumn("digest", F.sha2(F.concat_ws(":", "session_id", "first", "last", "chars"), 256))
    ledger = chunks.where("session_id % 3 = 0 AND chunk % 2 = 0").select("session_id", "chunk", "digest")
    ended = chunks.where("session_id % 4 = 0").select("session_id").distinct()
    return ingest.due_chunks(chunks, ledger, ended).select("session_id", "chunk")


@query("""SELECT lower(trim(role)) || ':' || conv_id AS candidate, min(turn) AS turn FROM conversations GROUP BY 1""")
def in_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one key; the first wins."""
    key = F.concat(F.lower(F.trim("role")), F.lit(":"), F.col("conv_id").cast("string"))
    return read_table(spark, sf_dir, "conversations").groupBy(key.alias("candidate")).agg(F.min("turn").alias("turn"))


@query("""WITH s AS (SELECT c.conv_id, c.turn, lower(c.text) AS said, lower(p.text) AS given FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
    t AS (SELECT *, regexp_extract_all(said, '[a-z0-9./_-]+') AS own, regexp_extract_all(given, '[a-z0-9./_-]+') AS known FROM s),
    w AS (SELECT *, list_filter(own, lambda x: NOT regexp_matches(x, '[0-9/]') AND length(x) >= 4) AS plain, list_filter(own, lambda x: regexp_matches(x, '[0-9/]')) AS critical FROM t),
    g AS (SELECT conv_id, turn, len(list_filter(critical, lambda x: NOT contains(given, x))) = 0 AND len(plain) > 0
        AND len(list_filter(plain, lambda x: list_contains(known, x))) >= len(plain) * 0.6 AS grounded FROM w)
    SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'verify' ELSE CASE WHEN grounded THEN 'pass' ELSE 'verify' END END AS route FROM g""")
def in_verify_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is to verify: nothing, all, or what the turn before does not bear out; a third of the conversations each."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("given"))
    mode = F.when(F.col("conv_id") % 3 == 0, "never").when(F.col("conv_id") % 3 == 1, "always").otherwise("grounded")
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", ingest.route(mode, F.col("text"), F.col("given")).alias("route"))


@query("""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, (length(text) + 3) // 4 AS t FROM conversations),
    f AS (SELECT conv_id AS session_id, place // 2 AS chunk, sum(t) AS fresh FROM m GROUP BY ALL)
    SELECT session_id, chunk, CAST(ceil(fresh / (1 + session_id % 3)) AS BIGINT) AS share FROM f""")
def in_source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each survivor's share of its chunk's new tokens, rounded up; a chunk of two turns also repeats the one before, which is not new."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    said = messages(spark, sf_dir).select("session_id", place.cast("long").alias("place"), text.tokens_estimate(F.col("content")).alias("tokens"))
    number = F.floor(F.col("place") / 2)
    chunks = said.groupBy("session_id", number.alias("chunk")).agg(F.greatest(F.min("place") - 1, F.lit(0)).alias("first"), F.max("place").alias("last"))
    survivors = (F.col("session_id") % 3 + 1).alias("survivors")
    fresh = ingest.new_tokens(chunks, said)
    return fresh.select("session_id", "chunk", survivors, "tokens").select("session_id", "chunk", F.ceil(F.col("tokens") / F.col("survivors")).alias("share"))


# Traces


@query(sql("SELECT event_id FROM traces WHERE status = 'failure' OR tool NOT IN ('view', 'click')", "traces"))
def tr_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).where(ingest.admitted(("view", "click"))).select("event_id")


@query(sql("SELECT session_id, tool AS signature, status, max(event_id) AS event_id FROM traces GROUP BY ALL", "traces"))
def tr_batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each signature and status in a batch (a session)."""
    marked = traces(spark, sf_dir).withColumn("signature", text.command_signature(F.col("tool"), F.lit(None).cast("string")))
    return rows.latest_per_key(marked.select("session_id", "signature", "status", "event_id"), ["session_id", "signature", "status"], ["event_id"])


def trace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as commands of forty targets, with signature, status and the digest of what they said; a thousand are a batch."""
    n, who = F.col("event_id"), F.col("session_id") % 40
    args = F.concat(F.lit("run u"), who.cast("string"))
    said = F.when(F.col("status") == "failure", F.concat(F.lit("Boom "), (n % 3).cast("string"), F.lit(" at x:"), n.cast("string"))).otherwise(F.concat(F.lit("took "), (n % 2).cast("string")))
    return traces(spark, sf_dir).select(
        text.command_signature(F.col("tool"), args).alias("signature"), "status", text.error_digest(said).alias("digest"), F.floor(n / 1000).alias("batch"), n.alias("place")
    )


@query(sql("""WITH RECURSIVE e AS (SELECT event_id AS place, event_id // 1000 AS batch, tool || '-run-u' || session_id % 40 AS signature, status, substr(sha256(CASE WHEN status = 'failure'
        THEN 'boom ' || event_id % 3 || ' at x:#' ELSE 'took ' || event_id % 2 END), 1, 32) AS digest FROM traces),
    stored AS (SELECT signature, arg_max(status, place) AS status, CASE WHEN max(place) % 9 <> 0 THEN arg_max(digest, place) END AS digest FROM e WHERE batch = 0 GROUP BY 1),
    d AS (SELECT signature, batch, status, max(place) AS place, arg_max(digest, place) AS digest FROM e WHERE batch > 0 GROUP BY ALL),
    g AS (SELECT signature, list(struct_pack(place, status, digest) ORDER BY place) AS new, row_number() OVER (PARTITION BY signature ORDER BY batch) AS r FROM d GROUP BY signature, batch),
    w AS (SELECT signature, CAST(0 AS BIGINT) AS r, stored.status, stored.digest, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT signature FROM g) LEFT JOIN stored USING (signature)
        UNION ALL SELECT signature, r, CASE WHEN len(f) > 0 THEN f[-1].status ELSE status END, CASE WHEN len(f) > 0 THEN f[-1].digest ELSE digest END, list_transform(f, lambda x: x.place) FROM (
            SELECT w.signature, g.r, w.status, w.digest, list_filter(new, lambda x: w.status IS NULL OR w.digest IS NULL OR w.status <> x.status OR w.digest <> x.digest) AS f
            FROM w JOIN g ON g.signature = w.signature AND g.r = w.r + 1))
    SELECT unnest(kept) AS event_id FROM w""", "traces"))
def tr_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New traces that tell something else than the stored outcome of their signature does, batch after batch; those of the first batch are stored
    (every ninth without a digest, which proves nothing)."""
    every = trace_outcomes(spark, sf_dir)
    stored = every.where("batch = 0").groupBy("signature").agg(F.max_by("status", "place").alias("status"), F.max_by("digest", "place").alias("digest"), F.max("place").alias("n"))
    stored = stored.withColumn("digest", F.when(F.col("n") % 9 != 0, F.col("digest")))
    return outcomes.changed_outcomes(every.where("batch > 0"), stored).select(F.col("place").alias("event_id"))


@query(sql("SELECT substr(sha256(concat(session_id, tool, args, status)), 1, 32) AS id, min(event_id) AS event_id FROM traces GROUP BY 1", "traces"))
def tr_id_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = text.hash128(F.col("session_id"), F.col("tool"), F.col("args"), F.col("status"))
    return traces(spark, sf_dir).groupBy(ident.alias("id")).agg(F.min("event_id").alias("event_id"))


@query(sql("""WITH e AS (SELECT *, CASE WHEN tool = 'click' THEN args ELSE tool || ' ' || args END AS invocation, array_to_string(list_filter(list_transform(list_filter(string_split_regex(trim(lower(args)), '\\s+'), lambda x: x <> '' AND NOT starts_with(x, '-') AND NOT regexp_full_match(x, '\\d+')),
            lambda x: trim(regexp_replace(regexp_replace(x, '^\\./', ''), '[^a-z0-9_]+', '-', 'g'), '-')), lambda x: x <> '')[1:4], '-') AS body FROM traces)
    SELECT event_id, 'trace:outcome:' || CASE WHEN tool = 'click' THEN body ELSE tool || '-' || body END AS topic_key,
        '`' || invocation || '` ' || CASE WHEN status = 'failure' THEN 'failed (exit 1): no such user ' || session_id ELSE 'succeeded (exit 0)' END AS content,
        CASE WHEN status = 'failure' THEN substr(sha256('no such user ' || session_id || ' at x:#'), 1, 32) ELSE substr(sha256('all done'), 1, 32) END AS error_digest FROM e""", "traces"))
def tr_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of each trace (clicks stand for the shell, which goes unnamed)."""
    failed = F.col("status") == "failure"
    error = F.when(failed, F.concat(F.lit("\n no such user "), F.col("session_id").cast("string"), F.lit("\n at x:31")))
    made = traces(spark, sf_dir).withColumns(
        {
            "error": error,
            "output": F.when(~failed, F.lit(" all  done ")),
            "exit_code": F.when(failed, 1).otherwise(0),
            "tool": F.when(F.col("tool") == "click", "Bash").otherwise(F.col("tool")),
        }
    )
    return ingest.outcome(made).select("event_id", "topic_key", "content", "error_digest")


@query(sql("""SELECT event_id, replace(tool || ' ' || args || ' ./src', chr(10), ' ') AS invocation, CAST(CASE WHEN event_id % 3 = 0 THEN occurred_at + INTERVAL 1 DAY
        WHEN event_id % 3 = 1 THEN occurred_at ELSE TIMESTAMP '2024-06-01 00:00:00' END AS DATE) AS occurred_on, event_id % 3 = 2 AS from_receipt,
    CASE WHEN event_id % 2 = 0 THEN 'first problem' WHEN event_id % 5 = 0 THEN 'no output' ELSE 'last line' END AS signal, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS hits FROM traces""", "traces"))
def tr_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces made clean: secrets masked, paths short, the time from the end, else the start, else the receipt; the line worth quoting."""
    n = F.col("event_id")
    raw = traces(spark, sf_dir).select(
        "event_id",
        "tool",
        F.concat("args", F.lit(" /srv/repo/src")).alias("args"),
        F.when(n % 2 == 0, F.lit("\n first problem \npassword=hunter22secret")).alias("error"),
        F.when(n % 5 != 0, F.lit("one\nlast line\n\n")).alias("output"),
        F.when(n % 3 < 2, F.col("occurred_at")).alias("started_at"),
        F.when(n % 3 == 0, F.col("occurred_at") + F.expr("INTERVAL 1 DAY")).alias("ended_at"),
    )
    found = ingest.event(raw, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), 4000, "/srv/repo", "/home/user")
    return found.select(
        "event_id", ingest.invocation().alias("invocation"), F.col("occurred_at").cast("date").alias("occurred_on"), "from_receipt", ingest.signal_line().alias("signal"), "hits"
    )


# Evaluation and audit


@query(f"""WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({STOP}))) AS terms
        FROM benchmark WHERE item_id % 20 = 0),
    m AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM documents),
    s AS (SELECT query_id, id, count(*) AS shared FROM (SELECT query_id, unnest(terms) AS t FROM q) JOIN (SELECT id, unnest(words) AS t FROM m) USING (t) GROUP BY ALL)
    SELECT query_id, id, shared FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) <= 20""")
def ev_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that contain most of a target's words."""
    terms = probes(spark, sf_dir).select("query_id", F.explode("terms").alias("t"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(text.words(F.col("text"), "[^a-z0-9]+"))).alias("t"))
    shared = docs.join(terms, "t").groupBy("query_id", "id").agg(F.count("*").alias("shared"))
    return search.ranked(shared, 20, [F.desc("shared"), F.col("id")]).select("query_id", "id", "shared")


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'view' AND list_bool_and(list_transform(['k', '3'], lambda w: len(list_filter(
    string_split_regex(lower(props), '[^\\p{L}\\p{N}_-]+'), lambda x: starts_with(x, w))) > 0)) ORDER BY ts DESC, event_id DESC LIMIT 26""")
def au_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of calls by equal fields and by words of the body, each of which must begin one of its words."""
    hits = rows.where_given(read_table(spark, sf_dir, "events"), event_type="view").where(text.matches_all_prefixes(F.col("props"), "K 3"))
    return rows.keyset_page(hits, "ts", "event_id", 25).select("event_id", "event_type")


@query("""SELECT page_id, left(html, 100) AS prefix, strlen(html) AS n_bytes, sha256(html) AS sha256, length(html) > 100 AS truncated FROM pages""")
def au_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", *ingest.capture(F.col("html"), 100))
