"""Further queries: payload arrays, fact histories, symbol search, neighbour clusters, page search, streams as batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import dates, stem, text, vectors
from lorekeep.operators import clusters, graph, ingest, pages, recall, rows, search, sets, temporal
from lorekeep.plans.derived import assertions, edges, memories, sql
from lorekeep.plans.engine_queries import FTS_SQL, MESSAGES_SQL, PROBES_SQL, SEGMENTS_SQL, VISIBLE_FTS, bm25_sql, fts, keyed_hits, nearest, probes, ret_fts_message, visible_fts
from lorekeep.plans.functions_queries import SHINGLES, STOP
from lorekeep.plans.registry import query
from lorekeep.plans.relational_queries import SEEN_SQL, seen
from lorekeep.sources.tables import read_table
from lorekeep.streaming import feeds

#: The walk of the graph channel in SQL: seeds are the entities named by a query (here the customer of its number) and those of its first eight memories, eight of each; one hop over its twenty newest edges.
SPREAD_SQL = """ends AS (SELECT source AS e, target AS other, 'out' AS d, * FROM edges UNION ALL SELECT target, source, 'in', * FROM edges),
    h0 AS MATERIALIZED (SELECT query_id, entity FROM (SELECT DISTINCT query_id, e AS entity FROM fts_top JOIN ends ON ends.sequence = id WHERE rank <= 8) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entity) <= 8
        UNION SELECT query_id, 'c' || query_id FROM probes WHERE 'c' || query_id IN (SELECT e FROM ends)),
    h1 AS MATERIALIZED (SELECT DISTINCT query_id, other AS entity FROM (SELECT query_id, other FROM ends JOIN h0 ON e = entity
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sequence DESC, source, relation, target, d) <= 20)
        WHERE (query_id, other) NOT IN (SELECT (query_id, entity) FROM h0)),
    spread AS MATERIALIZED (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1),
    graph_top AS (SELECT query_id, sequence AS id, row_number() OVER (PARTITION BY query_id ORDER BY hop, created_on DESC, sequence) AS rank FROM (
        SELECT query_id, ends.sequence, min(hop) AS hop FROM ends JOIN spread ON e = entity GROUP BY ALL) JOIN seen USING (sequence) QUALIFY rank <= 10)"""

IDS = "list_distinct([event_id % 7, CAST(json_extract(props, '$.k') AS BIGINT)])"


def graph_hits(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    """The graph channel: visible memories whose edges touch what lies around the entities that the question names (here the customer of
    its number) and those of the first wave's memories."""
    e = edges(spark, sf_dir)
    named = probes(spark, sf_dir).select("query_id", F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("entity"))
    found = recall.spread(first, e.withColumn("memory", F.col("sequence")), seeds=8, depth=1, fanout=20, named=named)
    visible = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "created_on")
    return search.ranked(found.join(visible, "id"), 10, [F.col("hop"), F.desc("created_on"), F.col("id")])


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a payload of symbol ids; every fourth is malformed."""
    made = F.concat(F.lit('{"symbolIds":['), (F.col("event_id") % 7).cast("string"), F.lit(","), F.get_json_object("props", "$.k"), F.lit("]}"))
    payload = F.when(F.col("event_id") % 4 == 0, F.lit('{"symbolIds":[')).otherwise(made)
    ids = F.from_json(F.get_json_object(payload, "$.symbolIds"), "array<long>")
    return read_table(spark, sf_dir, "events").select("event_id", F.array_distinct(F.coalesce(ids, F.array().cast("array<long>"))).alias("ids"))


@query(f"SELECT event_id, p_name FROM (SELECT event_id, unnest({IDS}) AS p_partkey FROM events WHERE event_id % 4 <> 0) JOIN part USING (p_partkey)")
def join_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    unnested = _payloads(spark, sf_dir).select("event_id", F.explode("ids").alias("p_partkey"))
    return unnested.join(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("event_id", "p_name")


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE len({IDS}) END AS n_symbols FROM events")
def js_symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("event_id", F.size("ids").cast("long").alias("n_symbols"))


@query("SELECT o_custkey, o_orderpriority AS channel, min(o_shippriority) AS rank FROM (SELECT *, o_orderkey % 97 + 1 AS o_shippriority FROM orders) GROUP BY ALL")
def map_merge_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = (F.col("o_orderkey") % 97 + 1).alias("rank")
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("channel")).agg(F.min(rank).alias("rank"))


@query("""WITH near AS (SELECT q.vec_id - 1 AS query_id, v.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d
        FROM embeddings q JOIN embeddings v ON q.vec_id - 1 <> v.vec_id WHERE q.vec_id % 20 = 1)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM near QUALIFY rank <= 10""")
def ret_hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector channel by vectors of made-up answers, which a model supplies (here a column: the vector of the next number)."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    answers = table.where("id % 20 = 1").select((F.col("id") - 1).alias("query_id"), F.col("v").alias("q"))
    return search.nearest(table, answers, 10).select("query_id", "id", "rank")


@query(sql(f"""WITH {SEEN_SQL}, symbols AS (SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand, p_type) AS said FROM part),
    probes AS (SELECT p_partkey AS query_id, list_distinct(list_filter(string_split_regex(lower(p_brand || ' ' || p_type), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS terms FROM part WHERE p_partkey % 20 = 0),
    {bm25_sql("hit", "symbols", "id", "said")}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hit QUALIFY rank <= 50)
    SELECT query_id, m.id, rank FROM top JOIN (SELECT sequence, id FROM seen) m ON m.sequence = top.id""", "memories"))
def ret_symbol_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (parts) by the words of all their fields, and the visible memories that come from the best fifty of each query."""
    part = read_table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"))
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), text.query_terms(F.concat_ws(" ", "p_brand", "p_type")).alias("terms"))
    top = search.best_bm25(symbols, asked, 50)
    held = seen(spark, sf_dir).select(F.col("sequence").alias("symbol"), F.col("id").alias("memory"))
    return top.join(held, top.id == held.symbol).select("query_id", F.col("memory").alias("id"), "rank")


@query()
def ret_fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text over stems without diacritics, for all questions of the benchmark."""
    asked = read_table(spark, sf_dir, "benchmark")
    queries = asked.select(F.col("item_id").alias("query_id"), F.array_distinct(stem.stems(F.col("text"))).alias("terms"))
    docs = read_table(spark, sf_dir, "documents")
    top = search.best_bm25(docs, queries, 10, "doc_id", "text", stem.stems)
    return top.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(sql("""SELECT id, '- (' || type || ') ' || CASE WHEN length(c) > 200 THEN left(c, 200) || '…' ELSE c END AS line
    FROM (SELECT id, type, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c FROM memories)""", "memories"))
def ret_context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory as one line of a context."""
    c = F.trim(F.regexp_replace("content", r"\s+", " "))
    cut = F.when(F.length("c") > 200, F.concat(F.left("c", F.lit(200)), F.lit("…"))).otherwise(F.col("c"))
    return memories(spark, sf_dir).select("id", "type", c.alias("c")).select("id", F.concat(F.lit("- ("), "type", F.lit(") "), cut).alias("line"))


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, t AS (SELECT query_id, unnest(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 10)) AS term FROM (
        SELECT query_id, list_filter(string_split_regex(lower(said), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2) AS w FROM probes)),
    c AS (SELECT topic_key, sequence, unnest(list_distinct(string_split_regex(lower(content), '[^\\p{{L}}\\p{{Nd}}]+'))) AS term FROM memories WHERE topic_key IS NOT NULL),
    live AS (SELECT topic_key, bool_and(s.sequence IS NOT NULL) AS whole FROM (SELECT * FROM memories WHERE topic_key IS NOT NULL AND sequence % 40 < 2) m LEFT JOIN (SELECT sequence FROM seen) s USING (sequence) GROUP BY 1),
    w AS (SELECT query_id, topic_key, max(sequence) AS latest FROM c JOIN t USING (term) GROUP BY ALL),
    words AS (SELECT query_id, topic_key, row_number() OVER (PARTITION BY query_id ORDER BY latest DESC, topic_key) AS place FROM w QUALIFY place <= 90),
    near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d,
        list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT query_id FROM probes)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place FROM near QUALIFY place <= 90),
    v AS (SELECT query_id, topic_key, min(place) + 1000 AS place FROM top JOIN memories ON sequence = top.id WHERE round(cosine, 9) >= 0.35 AND topic_key IS NOT NULL GROUP BY ALL),
    u AS (SELECT query_id, topic_key, min(place) AS place FROM (SELECT * FROM words UNION ALL SELECT * FROM v) GROUP BY ALL)
    SELECT query_id, topic_key, round(0.85 * 2.5, 9) AS score FROM u WHERE topic_key NOT IN (SELECT topic_key FROM live WHERE NOT whole)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, topic_key) <= 30""", "memories"))
def ret_cluster_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose claims match a query by words, the latest first, then those whose claims' vectors are near (here a cosine of 0.35, as
    the table's vectors lie far apart); only those all of whose supports are visible; injected at 0.85 of the best score (here 2.5)."""
    claims = memories(spark, sf_dir).where("topic_key IS NOT NULL").select(F.col("topic_key").alias("cluster"), F.col("sequence").alias("id"), "content")
    supports = claims.where("id % 40 < 2").select("cluster", F.col("id").alias("source"))
    visible = seen(spark, sf_dir).select(F.col("sequence").alias("source"))
    hidden = supports.join(visible, "source", "left_anti").select("cluster").distinct()
    asked = probes(spark, sf_dir).select("query_id", text.distinct_terms(F.col("said"), 2, 10).alias("terms"))
    vec = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    vectors_ = vec.join(asked.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = recall.claimed_clusters(claims, hidden, asked, vec, vectors_, limit=30, cosine=0.35)
    return found.select("query_id", F.col("cluster").alias("topic_key"), F.round(F.lit(recall.INJECTED * 2.5), 9).alias("score"))


@query(sql("""WITH RECURSIVE steps AS (SELECT DISTINCT source AS child, target AS parent FROM edges WHERE relation <> 'contains'),
    up AS (SELECT child, parent, 1 AS level FROM steps WHERE CAST(substr(child, 2) AS BIGINT) % 10 = 0 AND child LIKE 'o%'
        UNION SELECT s.child, s.parent, level + 1 FROM up JOIN steps s ON s.child = up.parent WHERE level < 4),
    t AS (SELECT unnest(list_filter(string_split(lower('What about the building of machinery'), ' '), lambda x: length(x) >= 3 AND x NOT IN ('what', 'the'))) AS term),
    c AS (SELECT parent, count(DISTINCT child) AS branches, parent IN (SELECT 'c' || c_custkey FROM customer JOIN t ON contains(lower(c_mktsegment), term)) AS matched FROM up GROUP BY 1)
    SELECT parent, branches, matched FROM c WHERE branches >= 2 OR matched ORDER BY matched DESC, branches DESC, parent LIMIT 30""", "edges"))
def ret_cluster_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty parents, up to four levels up, whose claims hold a term of the question (a customer's segment is its claim) or that join two branches with hits or more."""
    e = edges(spark, sf_dir).where("relation <> 'contains'")
    hits = e.where(F.col("source").startswith("o") & (F.substring("source", 2, 20).cast("long") % 10 == 0))
    up = graph.ascend(e, hits.select(F.col("source").alias("entity")), 4)
    terms = text.claim_terms(F.lit("What about the building of machinery"))
    held = F.exists(terms, lambda t: F.contains(F.lower("c_mktsegment"), t))
    claims = read_table(spark, sf_dir, "customer").where(held).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("parent"))
    counted = up.groupBy("parent").agg(F.count_distinct("child").alias("branches")).join(claims.withColumn("hit", F.lit(True)), "parent", "left")
    nominated = counted.select("parent", "branches", F.coalesce("hit", F.lit(False)).alias("matched")).where("branches >= 2 OR matched")
    return nominated.orderBy(F.desc("matched"), F.desc("branches"), "parent").limit(30)


@query(sql(f"""WITH {SEGMENTS_SQL} SELECT a.fact_group, a.revision_id, row_number() OVER (PARTITION BY a.fact_group ORDER BY a.transaction_id, s.valid_from) AS place, s.valid_from,
    coalesce(s.valid_from <= DATE '1996-06-30' AND DATE '1996-06-30' < s.valid_to, false) AS selected FROM assertions a LEFT JOIN segments s USING (fact_group, revision_id)""", "assertions"))
def tmp_fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisions of each fact with the stretches in which each holds, and which one holds on a day."""
    every = assertions(spark, sf_dir)
    return temporal.history(every, temporal.resolve_segments(every), F.lit("1996-06-30").cast("date")).select("fact_group", "revision_id", "place", "valid_from", "selected")


@query(sql(f"""WITH {SEEN_SQL} SELECT session_id, type, topic_key, arg_max(id, sequence) AS id, arg_max(payload, sequence) AS payload, arg_max(valid_from, sequence) AS valid_from FROM seen
    WHERE topic_key IS NOT NULL GROUP BY ALL""", "memories"))
def tmp_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected revision of every visible fact."""
    visible = seen(spark, sf_dir).where("topic_key IS NOT NULL").select("session_id", "type", "topic_key", "id", "payload", "valid_from", "sequence")
    return rows.latest_per_key(visible, ["session_id", "type", "topic_key"], ["sequence"]).drop("sequence")


@query(sql("""WITH stored AS (SELECT fact_group, revision_id, start, stop FROM assertions WHERE transaction_id % 2 = 0),
    incoming AS (SELECT revision_id, fact_group AS own, CASE WHEN transaction_id % 3 = 0 THEN NULL ELSE start END AS start, stop, CASE WHEN transaction_id % 7 = 0 THEN transaction_id + 1 END AS predecessor,
        CASE WHEN transaction_id % 5 = 0 THEN transaction_id - 1 END AS corrects FROM assertions WHERE transaction_id % 2 = 1 OR transaction_id % 10 = 0),
    fresh AS (SELECT i.*, t.fact_group AS target_group, t.start AS target_start, p.fact_group AS predecessor_group FROM incoming i LEFT JOIN stored t ON t.revision_id = i.corrects
        LEFT JOIN stored p ON p.revision_id = i.predecessor WHERE i.revision_id NOT IN (SELECT revision_id FROM stored))
    SELECT coalesce(target_group, predecessor_group, own) AS fact_group, revision_id, coalesce(start, target_start) AS start, false AS closed FROM fresh
    UNION ALL SELECT fact_group, revision_id, start, revision_id IN (SELECT corrects FROM fresh WHERE target_group IS NOT NULL) FROM stored""", "assertions"))
def tmp_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New assertions beside the stored ones: known ones are left out, a correction joins and closes its target, others join their predecessor's group."""
    every = assertions(spark, sf_dir)
    n = F.col("transaction_id")
    stored = every.where("transaction_id % 2 = 0").select("fact_group", "revision_id", "start", "stop")
    incoming = every.where("transaction_id % 2 = 1 OR transaction_id % 10 = 0").select(
        "fact_group", "revision_id", F.when(n % 3 != 0, F.col("start")).alias("start"), "stop", F.when(n % 7 == 0, n + 1).alias("predecessor"), F.when(n % 5 == 0, n - 1).alias("corrects")
    )
    return temporal.append(stored, incoming).select("fact_group", "revision_id", "start", "closed")


@query(sql(f"WITH {SEGMENTS_SQL} SELECT * FROM segments", "assertions"))
def tmp_resolve_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the groups that changed, in place of the stored ones; what comes out is as if all had been resolved."""
    every = assertions(spark, sf_dir)
    stored = temporal.resolve_segments(every.where("transaction_id % 2 = 0"))
    changed = every.where("transaction_id % 2 = 1").select("fact_group").distinct()
    anew = temporal.resolve_segments(every.join(changed, "fact_group", "left_semi"))
    found = rows.replace_group(stored, anew, changed)
    return found.withColumn("valid_to", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))


@query(sql(f"""WITH active AS (SELECT * FROM memories WHERE NOT forgotten AND to_sequence IS NULL), probes AS (SELECT sequence AS query_id, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({STOP}))) AS terms
        FROM active WHERE sequence % 20 = 0), {bm25_sql("fts", "documents", "doc_id", "text")},
    f AS (SELECT query_id, id FROM fts WHERE query_id <> id AND id IN (SELECT sequence FROM active) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 15),
    k AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT query_id FROM probes) AND v.vec_id IN (SELECT sequence FROM active)
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), v.vec_id) <= 15),
    n AS (SELECT * FROM f UNION SELECT * FROM k), g AS ({SHINGLES}),
    c AS (SELECT n.*, a.topic_key = b.topic_key AS keyed, a.session_id = b.session_id OR a.profile_id = b.profile_id AS fits,
        list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cosine,
        len(list_intersect(p.s, q.s)) / greatest(1, len(p.s) + len(q.s) - len(list_intersect(p.s, q.s))) AS likeness FROM n JOIN g p ON p.doc_id = query_id JOIN g q ON q.doc_id = n.id JOIN memories a ON a.sequence = query_id JOIN memories b ON b.sequence = n.id
        LEFT JOIN embeddings x ON x.vec_id = query_id LEFT JOIN embeddings y ON y.vec_id = n.id)
    SELECT query_id AS seed, count(*) + 1 AS members FROM c WHERE fits AND (coalesce(keyed, false) OR likeness >= 0.35 OR coalesce(round(cosine, 9) >= 0.3, false)) GROUP BY 1 HAVING count(*) + 1 BETWEEN 3 AND 20""", "memories"))
def cl_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups around active seeds (every twentieth memory): of fifteen active neighbours by all words and fifteen by vectors those of the same key, of
    like words or of a near vector (here 0.3), if their sources are compatible; three to twenty members."""
    visible = memories(spark, sf_dir).where("NOT forgotten AND to_sequence IS NULL").select(F.col("sequence").alias("id"), "topic_key", "session_id", "profile_id", "content")
    seeds = visible.where("id % 20 = 0").select(F.col("id").alias("query_id"), text.query_terms(F.col("content")).alias("terms"))
    every = memories(spark, sf_dir).select(F.col("sequence").alias("id"), "content", F.expr("NOT forgotten AND to_sequence IS NULL").alias("open"))
    worded = search.best_bm25(every, seeds, 15, apart=True).select("query_id", "id")
    vec = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vec.join(seeds.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = search.nearest(vec.join(visible.select("id"), "id", "left_semi"), asked, 15).select("query_id", "id")
    pairs = worded.unionByName(near).distinct()
    return clusters.discover(pairs, visible, vec, cosine=0.3).select("seed", "members")


@query()
def wk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (topics, profiles, and keys that nearly repeat the topics) for questions: by their own words, by hits among their sources (full text, exact keys
    and vectors), halved where a page that is listed before has nearly the same members; then hits that are on no page, and whether more was to be
    had. Pages of `src9` are redirected to those of `src8`, those of the profile `de` are retired. Checked against brute force."""
    visible = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "topic_key", "profile_id", "created_on")
    pages_of = F.array_compact(F.array(F.concat(F.lit("topic:"), "topic_key"), F.concat(F.lit("profile:"), "profile_id"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("key:"), "topic_key"))))
    placed = rows.settled(visible.where("id % 6 != 0").select("id", F.explode(pages_of).alias("page")))
    canonical = F.when(F.endswith("page", F.lit(".src9")), F.regexp_replace("page", "9$", "8")).otherwise(F.col("page"))
    every = placed.select("page").distinct()
    every = every.unionByName(every.select(canonical.alias("page"))).distinct()
    listed = every.select("page", canonical.alias("canonical"), ((canonical == F.col("page")) & (F.col("page") != "profile:de")).alias("open"))
    asked = probes(spark, sf_dir)
    titles = listed.where("open").select(F.col("page").alias("id"), F.translate("page", ":.", "  ").alias("content"))
    worded = search.ranked(search.bm25(titles, asked), 100, [F.desc(F.round("score", 9)), F.col("id")]).select("query_id", F.col("id").alias("page"), "rank")
    exact = asked.select("query_id", F.concat(F.lit("topic:"), F.lower(F.trim("said"))).alias("page"))
    merged = placed.join(listed, "page").select(F.col("canonical").alias("page"), "id").distinct()
    alike = sets.similar_sets(merged, 0.8, "page", "id").where("likeness > 0.8")
    keys = asked.select("query_id", F.lower(F.trim("said")).alias("topic_key"))
    near = nearest(spark, sf_dir, 100, asked.select("query_id")).join(visible.select("id"), "id", "left_semi")
    routes = {"fts": visible_fts(spark, sf_dir, 100), "exact": keyed_hits(visible, keys, 100), "vector": near}
    channels = reduce(DataFrame.unionByName, (search.channel(hits, name) for name, hits in routes.items()))
    fused = search.fuse(channels, weights=dict.fromkeys(routes, 1.0))
    hits = search.ranked(fused, 100, [F.desc(F.round("score", 12)), F.col("id")]).select("query_id", "id", "rank")
    found, lost, state = pages.search(worded, rows.settled(hits), placed, listed, exact, alike, 10)
    shown = found.select("query_id", F.lit("page").alias("kind"), "place", F.col("page").alias("name"), F.round("score", 9).alias("score"))
    rest = lost.select("query_id", F.lit("unassigned").alias("kind"), F.col("place").cast("long").alias("place"), F.col("id").cast("string").alias("name"))
    return shown.unionByName(rest, allowMissingColumns=True).join(state, "query_id")


@query("""SELECT o_orderkey, d - 1 AS yesterday, CAST(date_trunc('month', d) AS DATE) AS month_from, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS month_to,
        CAST(date_trunc('week', d) AS DATE) + 7 AS next_week FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def dt_effective_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    month = F.date_format(d, "MMMM yyyy")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    said = F.concat(F.lit("it was yesterday, or in "), month, F.lit(", and again next week"))
    bounds = orders.select(
        "o_orderkey",
        dates.effective_bounds(F.lit("Yesterday"), d, said).alias("y"),
        dates.effective_bounds(month, d, said).alias("m"),
        dates.effective_bounds(F.lit("next week"), d, said, "period").alias("w"),
    )
    return bounds.select(
        "o_orderkey",
        F.col("y.from").alias("yesterday"),
        F.col("m.from").alias("month_from"),
        F.col("m.to").alias("month_to"),
        F.col("w.from").alias("next_week"),
    )


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 1 + o_orderkey % 9 AS n FROM orders),
    p AS (SELECT o_orderkey, unnest(['today', 'next week', n || ' days ago', 'soon']) AS phrase, unnest([strftime(d, '%Y-%m-%d'), 'the week of '
        || strftime(CAST(date_trunc('week', d) AS DATE) + 7, '%Y-%m-%d'), strftime(d - CAST(n AS INT), '%Y-%m-%d'), NULL]) AS meaning FROM o WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, unnest(['last month', 'tomorrow']), unnest([strftime(d - INTERVAL 1 MONTH, '%B %Y'), strftime(d + 1, '%Y-%m-%d')]) FROM o WHERE o_orderkey % 2 = 1)
    SELECT * FROM p""")
def dt_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of two forms, with numbers from the rows."""
    key = F.col("o_orderkey")
    one = F.concat(F.lit("Due today or next week; it broke "), (key % 9 + 1).cast("string"), F.lit(" days ago, today, and soon"))
    said = F.when(key % 2 == 0, one).otherwise("Last month, or tomorrow, or LAST MONTH")
    found = dates.residual(said, F.col("o_orderdate").cast("date"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("x")).select("o_orderkey", "x.*")


@query()
def str_hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a line being a paragraph, in pieces of at most 2,000 characters."""
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    pieces = ingest.hard_split(paragraphs, 2000)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("place", "piece")).select(
        "doc_id", "place", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5")
    )


@query("""SELECT doc_id, round(CASE WHEN hi > lo THEN 0.6 * (n_chars - lo) / (hi - lo) ELSE 0.6 END + 0.4 * greatest(0.0, (doc_id % 10 - 3) / 10.0), 9) AS blended FROM (
    SELECT *, min(n_chars) OVER w AS lo, max(n_chars) OVER w AS hi FROM documents WINDOW w AS (PARTITION BY source, lang))""")
def vec_minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths brought to 0..1 within a source and language, mixed with a second measure."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("|", "source", "lang").alias("query_id"), F.col("n_chars").alias("score"), ((F.col("doc_id") % 10 - 3) / 10).alias("cosine")
    )
    return search.blend(docs).select("doc_id", F.round("blended", 9).alias("blended"))


@query(sql("""SELECT fact_group, revision_id, row_number() OVER (PARTITION BY fact_group ORDER BY start DESC, CASE WHEN NOT u THEN stated_on END DESC NULLS LAST,
        CASE WHEN u THEN transaction_id END DESC NULLS LAST, source_order DESC, revision_id DESC) AS place
    FROM (SELECT *, bool_or(stated_on IS NULL) OVER (PARTITION BY fact_group, start) AS u FROM assertions)""", "assertions"))
def tmp_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("fact_group").orderBy(F.desc("priority")))
    return temporal.prioritised(assertions(spark, sf_dir)).select("fact_group", "revision_id", place.alias("place"))


@query(sql("""WITH l AS (SELECT fact_group, max(revision_id) AS latest, arg_max(start, revision_id) AS start, arg_max(coalesce(stop, DATE '9999-12-31'), revision_id) AS stop FROM assertions GROUP BY 1),
    c AS (SELECT fact_group, min(revision_id) AS expected, DATE '1999-01-01' AS a, CASE WHEN fact_group % 3 = 0 THEN DATE '1998-01-01' ELSE DATE '1999-06-01' END AS b FROM assertions GROUP BY 1)
    SELECT fact_group, CASE WHEN latest <> expected THEN 'conflict' WHEN b <= a THEN 'invalid' ELSE 'revised' END AS outcome,
        CASE WHEN latest = expected AND b > a THEN a ELSE start END AS start, CASE WHEN latest = expected AND b > a THEN b ELSE stop END AS stop FROM c JOIN l USING (fact_group)""", "assertions"))
def tmp_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that expect each group's first revision to be its latest."""
    every = assertions(spark, sf_dir)
    new_stop = F.when(F.col("fact_group") % 3 == 0, "1998-01-01").otherwise("1999-06-01").cast("date")
    changes = every.groupBy("fact_group").agg(F.min("revision_id").alias("expected"))
    changes = changes.withColumns({"new_start": F.lit("1999-01-01").cast("date"), "new_stop": new_stop})
    found = temporal.revise(every, changes)
    return found.withColumn("stop", F.coalesce("stop", F.lit("9999-12-31").cast("date")))


#: The code channel in SQL, over fts_top and seen: lines of evidence, and hits.
CODE_SQL = """sym AS (SELECT 's' || doc_id AS symbol, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 6)[1] AS name FROM documents WHERE len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 6)) > 0),
    e AS (SELECT DISTINCT 's' || l_orderkey % 1000 AS source, CASE WHEN l_partkey % 7 > 0 THEN 's' || l_partkey % 1000 END AS target, lower(l_returnflag) AS relation, l_partkey % 7 > 0 AS sure FROM lineitem WHERE l_linenumber % 3 < 2),
    met AS (SELECT DISTINCT query_id, symbol FROM (SELECT query_id, unnest(terms) AS name FROM probes) JOIN sym USING (name)),
    named AS MATERIALIZED (SELECT query_id, symbol AS entity FROM met QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY symbol) <= 8),
    told AS (SELECT query_id, entity, 0 AS rank, 0 AS spot FROM named UNION ALL SELECT query_id, 's' || (id + k), rank, k FROM fts_top, (VALUES (0), (1)) v(k)),
    start AS MATERIALIZED (SELECT query_id, entity FROM (SELECT query_id, entity, min((rank, spot)) AS x FROM told GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x, entity) <= 32),
    asked AS (SELECT * FROM named UNION ALL SELECT * FROM start WHERE query_id NOT IN (SELECT query_id FROM named)),
    touch AS (SELECT DISTINCT query_id, e.* FROM e JOIN asked ON entity = source OR entity = target),
    lines AS (SELECT query_id, source || ' -' || relation || '-> ' || coalesce(target, '?') AS name, row_number() OVER (PARTITION BY query_id ORDER BY sure DESC, relation, source, target NULLS FIRST) AS rank FROM touch QUALIFY rank <= 20),
    steps AS MATERIALIZED (SELECT source AS a, target AS b FROM e WHERE target IS NOT NULL UNION SELECT target, source FROM e WHERE target IS NOT NULL),
    next AS (SELECT DISTINCT query_id, b AS entity FROM start JOIN steps ON a = entity), far AS (SELECT * FROM next QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entity) <= 20),
    reached AS (SELECT * FROM start UNION SELECT * FROM far),
    held AS (SELECT DISTINCT query_id, sequence, created_on FROM seen, (VALUES (0), (1)) v(k), reached WHERE entity = 's' || (sequence + k)),
    hits AS (SELECT query_id, CAST(sequence AS VARCHAR) AS name, row_number() OVER (PARTITION BY query_id ORDER BY created_on DESC, sequence) AS rank FROM held QUALIFY rank <= 10)"""
#: The symbol channel: the fifty best symbols by their words, and the memories whose payload holds them.
SYMBOL_SQL = f"""{bm25_sql("symhit", "sym", "symbol", "name")}, symtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM symhit QUALIFY r <= 50),
    symmem AS (SELECT query_id, s.sequence AS id, min(r) AS r FROM symtop JOIN (SELECT sequence, 's' || (sequence + k) AS symbol FROM seen, (VALUES (0), (1)) v(k)) s ON s.symbol = symtop.id GROUP BY ALL),
    symrank AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r, id) AS rank FROM symmem QUALIFY rank <= 10)"""


def code_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """symbol, name: each document defines a symbol named by its first long word; and id, created, symbols of visible memories, whose payloads hold their
    own symbol and the next."""
    long = F.filter(text.words(F.col("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 6)
    docs = read_table(spark, sf_dir, "documents")
    symbols = docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("symbol"), F.get(long, F.lit(0)).alias("name")).where("name IS NOT NULL")
    known = seen(spark, sf_dir).select(F.col("sequence").alias("id"), F.col("created_on").alias("created"), _own_symbols())
    return symbols, known


def _own_symbols() -> F.Column:
    return F.array(*(F.concat(F.lit("s"), (F.col("sequence") + k).cast("string")) for k in (0, 1))).alias("symbols")


def code_hits(spark: SparkSession, sf_dir: str, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The code channel's memories and lines; line items are the edges between symbols, and questions name symbols by their words."""
    symbols, known = code_symbols(spark, sf_dir)
    items = read_table(spark, sf_dir, "lineitem").where("l_linenumber % 3 < 2")

    def symbol(column: str) -> F.Column:
        return F.concat(F.lit("s"), (F.col(column) % 1000).cast("string"))

    sure = F.col("l_partkey") % 7 > 0
    e = items.select(symbol("l_orderkey").alias("source"), F.when(sure, symbol("l_partkey")).alias("target"), F.lower("l_returnflag").alias("relation"), sure.alias("sure"))
    payloads = memories(spark, sf_dir).select(F.col("sequence").alias("id"), _own_symbols())
    names = probes(spark, sf_dir).select("query_id", F.explode("terms").alias("name"))
    return recall.code_graph(first, payloads, names, symbols, rows.settled(e.distinct()), known)


def symbol_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol channel: the memories that hold the fifty best symbols by their words."""
    symbols, known = code_symbols(spark, sf_dir)
    scored = search.bm25(symbols.select(F.col("symbol").alias("id"), F.col("name").alias("content")), probes(spark, sf_dir))
    top = search.ranked(scored, 50, [F.desc(F.round("score", 9)), F.col("id")]).select("query_id", F.col("id").alias("symbol"), F.col("rank").alias("r"))
    held = known.select("id", F.explode("symbols").alias("symbol")).join(top, "symbol").groupBy("query_id", "id").agg(F.min("r").alias("r"))
    return search.ranked(held, 10, [F.col("r"), F.col("id")]).select("query_id", "id", "rank")


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, {VISIBLE_FTS}, {CODE_SQL}
    SELECT query_id, 'line' AS kind, name, rank FROM lines UNION ALL SELECT query_id, 'memory', name, rank FROM hits""", "memories"))
def ret_code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel of code: memories around the symbols of a question, and lines of evidence."""
    hits, lines = code_hits(spark, sf_dir, rows.settled(visible_fts(spark, sf_dir).select("query_id", "id", "rank")))
    shown = lines.select("query_id", F.lit("line").alias("kind"), F.col("line").alias("name"), "rank")
    return shown.unionByName(hits.select("query_id", F.lit("memory").alias("kind"), F.col("id").cast("string").alias("name"), "rank"))


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, {VISIBLE_FTS}, {SPREAD_SQL}, {MESSAGES_SQL}, {CODE_SQL}, {SYMBOL_SQL},
    ex AS (SELECT p.query_id, s.sequence AS id, row_number() OVER (PARTITION BY p.query_id ORDER BY s.created_on DESC, s.sequence) AS rank FROM probes p
        JOIN memories m ON m.sequence = p.query_id JOIN seen s ON s.topic_key = m.topic_key QUALIFY rank <= 10),
    b AS (SELECT query_id, 'src' || CAST(split_part(id, ':', 1) AS BIGINT) % 10 AS session_id, max(score) AS score FROM said GROUP BY ALL),
    m AS (SELECT query_id, sequence AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, session_id, created_on DESC, sequence) AS rank FROM b JOIN seen USING (session_id) QUALIFY rank <= 10),
    v AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), v.vec_id) AS rank
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT query_id FROM probes) AND v.vec_id IN (SELECT sequence FROM seen) QUALIFY rank <= 10),
    h AS (SELECT q.vec_id - 1 AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), v.vec_id) AS rank
        FROM embeddings q JOIN embeddings v ON q.vec_id - 1 <> v.vec_id WHERE q.vec_id - 1 IN (SELECT query_id FROM probes) AND v.vec_id IN (SELECT sequence FROM seen) QUALIFY rank <= 10),
    u AS (SELECT query_id, id, 1.0 / (60 + rank) AS share FROM fts_top UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM graph_top UNION ALL SELECT query_id, id, 3.0 / (60 + rank) FROM ex
        UNION ALL SELECT query_id, id, 0.5 / (60 + rank) FROM m UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM v UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM h
        UNION ALL SELECT query_id, CAST(name AS BIGINT), 1.0 / (60 + rank) FROM hits UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM symrank)
    SELECT query_id, id, round(sum(share), 9) AS score FROM u GROUP BY ALL""", "memories", "edges"))
def recall_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight channels of both waves over visible memories, fused: keys, words, messages, vectors, vectors of made-up answers, symbols, and the
    graphs of entities and of code."""
    visible = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "topic_key", "session_id", "created_on")
    asked = probes(spark, sf_dir)
    first = rows.settled(visible_fts(spark, sf_dir).select("query_id", "id", "rank"))
    keys = asked.select("query_id").join(memories(spark, sf_dir).select(F.col("sequence").alias("query_id"), "topic_key"), "query_id")
    exact = keyed_hits(visible, keys)
    vec = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    open_ = vec.join(visible.select("id"), "id", "left_semi")
    own = vec.join(asked.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    made = vec.join(asked.select((F.col("query_id") + 1).alias("id")), "id").select((F.col("id") - 1).alias("query_id"), F.col("v").alias("q"))
    channels = {
        "fts": first,
        "exact": exact,
        "message": ret_fts_message(spark, sf_dir),
        "vector": search.nearest(open_, own, 10),
        "hyde": search.nearest(open_, made, 10),
        "graph": graph_hits(spark, sf_dir, first),
        "symbol": symbol_hits(spark, sf_dir),
        "code_graph": code_hits(spark, sf_dir, first)[0],
    }
    return recall.fused(channels).select("query_id", "id", F.round("score", 9).alias("score"))


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, {VISIBLE_FTS}, {SPREAD_SQL},
    u AS (SELECT query_id, id, 1.0 / (60 + rank) AS share FROM fts_top UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM graph_top)
    SELECT query_id, id, round(sum(share), 9) AS score FROM u GROUP BY ALL""", "memories", "edges"))
def ret_two_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two waves fused: full text, and what the graph finds around the entities of its hits. The first wave is kept for the second."""
    first = rows.settled(visible_fts(spark, sf_dir).select("query_id", "id", "rank"))
    second = graph_hits(spark, sf_dir, first)
    return recall.fused({"fts": first, "graph": second}).select("query_id", "id", F.round("score", 9).alias("score"))


@query("""WITH t AS (SELECT 'c' || c_custkey AS cluster, r AS revision, c_name AS title, CASE WHEN r = 2 AND c_custkey % 9 = 0 THEN 'dissolved' ELSE 'active' END AS state FROM customer, (VALUES (1), (2)) v(r) WHERE r = 1 OR c_custkey % 3 = 0
        UNION ALL SELECT 'n' || n_nationkey, 1, n_name, 'active' FROM nation),
    m AS (SELECT 'n' || c_nationkey AS cluster, 1 AS revision, 'c' || c_custkey AS child, false AS leaf FROM customer UNION ALL SELECT 'n' || (c_nationkey + 1) % 25, 1, 'c' || c_custkey, false FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT 'c' || o_custkey, r, 'o' || o_orderkey, true FROM orders, (VALUES (1), (2)) v(r) WHERE r = 1 OR o_orderkey % 2 = 0),
    p AS (SELECT 'c' || c_custkey AS cluster, 'n' || CASE WHEN c_custkey % 6 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS was, CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE c_name END AS named, CASE WHEN c_custkey % 18 = 0 THEN 'retired' ELSE 'active' END AS lifecycle
        FROM customer WHERE c_custkey % 5 <> 0),
    a AS (SELECT cluster, arg_max(title, revision) AS title, max(revision) AS revision FROM t GROUP BY 1 HAVING arg_max(state, revision) = 'active'),
    k AS (SELECT DISTINCT m.cluster, child, leaf FROM m JOIN a USING (cluster, revision) WHERE leaf OR child IN (SELECT cluster FROM a)),
    c AS (SELECT child AS cluster, coalesce(max(CASE WHEN k.cluster = was THEN was END), min(k.cluster)) AS parent FROM k LEFT JOIN p ON p.cluster = child WHERE NOT leaf GROUP BY 1),
    g AS (SELECT a.cluster, coalesce(parent, 'directory:Topics') AS parent, title, 'active' AS lifecycle, NOT (coalesce(named = title, false) AND coalesce(was = coalesce(parent, 'directory:Topics'), false) AND coalesce(lifecycle = 'active', false)) AS changed
        FROM a LEFT JOIN c USING (cluster) LEFT JOIN p USING (cluster) UNION ALL SELECT cluster, was, named, 'retired', lifecycle <> 'retired' FROM p WHERE cluster NOT IN (SELECT cluster FROM a))
    SELECT 'page' AS kind, cluster, parent AS other, title, lifecycle, changed FROM g UNION ALL SELECT 'link', cluster, child, NULL, NULL, NULL FROM k WHERE NOT leaf
    UNION ALL SELECT DISTINCT 'source', x.cluster, x.child, NULL, NULL, NULL FROM (SELECT cluster, child FROM k WHERE leaf UNION SELECT a.cluster, b.child FROM k a JOIN k b ON b.cluster = a.child WHERE b.leaf) x""")
def wk_cluster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of clusters (customers, and nations over them; every fourth customer is under two), the sources nested under each (orders) and the links
    between them, by the latest revision of each cluster; pages of dissolved ones are retired, and a page keeps its parent while it may."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    table = read_table(spark, sf_dir, "customer")

    def name(kind: str, column: F.Column) -> F.Column:
        return F.concat(F.lit(kind), column.cast("string"))

    again = F.explode(F.array(F.lit(1), F.lit(2))).alias("revision")
    topics = table.select(name("c", key).alias("cluster"), "c_custkey", again, F.col("c_name").alias("title")).where((F.col("revision") == 1) | (key % 3 == 0))
    state = F.when((F.col("revision") == 2) & (key % 9 == 0), "dissolved").otherwise("active").alias("state")
    nations = read_table(spark, sf_dir, "nation").select(name("n", F.col("n_nationkey")).alias("cluster"), F.lit(1).alias("revision"), F.col("n_name").alias("title"), F.lit("active").alias("state"))
    topics = topics.select("cluster", "revision", "title", state).unionByName(nations)
    first = table.select(name("n", nation).alias("cluster"), F.lit(1).alias("revision"), name("c", key).alias("child"), F.lit(False).alias("leaf"))
    second = table.where(key % 4 == 0).select(name("n", (nation + 1) % 25).alias("cluster"), F.lit(1).alias("revision"), name("c", key).alias("child"), F.lit(False).alias("leaf"))
    orders = read_table(spark, sf_dir, "orders").select(name("c", F.col("o_custkey")).alias("cluster"), "o_orderkey", again)
    orders = orders.where((F.col("revision") == 1) | (F.col("o_orderkey") % 2 == 0)).select("cluster", "revision", name("o", F.col("o_orderkey")).alias("child"), F.lit(True).alias("leaf"))
    stored = table.where(key % 5 != 0).select(
        name("c", key).alias("cluster"),
        name("n", F.when(key % 6 == 0, (nation + 1) % 25).otherwise(nation)).alias("parent"),
        F.when(key % 7 == 0, "old").otherwise(F.col("c_name")).alias("title"),
        F.when(key % 18 == 0, "retired").otherwise("active").alias("lifecycle"),
    )
    found, sources, links = clusters.pages_of(topics, first.unionByName(second).unionByName(orders), stored)
    shown = found.select(F.lit("page").alias("kind"), "cluster", F.col("parent").alias("other"), "title", "lifecycle", "changed")
    shown = shown.unionByName(links.select(F.lit("link").alias("kind"), F.col("parent").alias("cluster"), F.col("child").alias("other")), allowMissingColumns=True)
    return shown.unionByName(sources.select(F.lit("source").alias("kind"), "cluster", F.col("source").alias("other")), allowMissingColumns=True)


@query("SELECT event_type, user_id, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def agg_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streaming counters hold once all events have come."""

    return feeds.counters(read_table(spark, sf_dir, "events"), ["event_type", "user_id"], "value").withColumn("total", F.round("total", 4))


def page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("page"), F.col("vec_id").alias("id"), "embedding")


def split_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """page, place, id: the groups of large pages in order of their seeds; and the children of an earlier split, before every seventh source came."""
    members = page_members(spark, sf_dir)
    now = pages.split(members, admit=0.2, over=30)
    before = pages.split(members.where("id % 7 != 0"), admit=0.2, over=30)
    stored = before.select("page", F.col("seed").alias("child"), F.col("seed").alias("created"), "id")
    return now.select("page", F.col("seed").alias("place"), "id"), stored


@query()
def wk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of over 30 sources in groups around farthest-first seeds, each with the child of the page that it goes on as (null: a new one); last the
    children that no group took, which are emptied. Checked against brute force."""
    groups, stored = (rows.settled(x) for x in split_groups(spark, sf_dir))
    matched = rows.settled(pages.children(groups, stored))
    sizes = groups.groupBy("page", "place").agg(F.count("*").alias("members"))
    gone = stored.select("page", "child").distinct().join(matched.select("page", "child"), ["page", "child"], "left_anti")
    kept = matched.join(sizes, ["page", "place"]).select("page", F.col("place").alias("seed"), "child", F.round("likeness", 9).alias("likeness"), "members")
    return kept.unionByName(gone.withColumn("members", F.lit(0).cast("long")), allowMissingColumns=True)


@query("""WITH RECURSIVE p AS (SELECT source, length(text) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id % 3 <> 0),
    w AS (SELECT source, place, CAST(0 AS BIGINT) AS chunk, CAST(cost AS BIGINT) AS size FROM p WHERE place = 0
        UNION ALL SELECT p.source, p.place, CASE WHEN size + cost > 40000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + cost > 40000 THEN cost ELSE size + cost END
        FROM w JOIN p ON p.source = w.source AND p.place = w.place + 1)
    SELECT source, chunk, min(place) AS first, max(place) AS last, max(size) AS size FROM w GROUP BY ALL""")
def in_onboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of what has changed since a ledger that holds every third document, and every third of the rest at an older state."""
    docs = read_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("provenance"), "text")
    state = F.when(F.col("provenance") % 3 == 0, F.col("text")).otherwise("older")
    ledger = docs.where("provenance % 3 <> 2").select("source", "provenance", F.sha2(state, 256).alias("digest"))
    return ingest.onboard(docs, ledger)[1]


@query("""WITH RECURSIVE p AS (SELECT o_custkey % 50 AS profile_id, o_orderkey AS id, o_orderkey % 900 AS cost, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS place
        FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)),
    w AS (SELECT profile_id, id, place, CAST(0 AS BIGINT) AS chunk, CAST(cost AS BIGINT) AS size, 1 AS n FROM p WHERE place = 0
        UNION ALL SELECT p.profile_id, p.id, p.place, CASE WHEN n = 8 OR size + cost > 3000 THEN chunk + 1 ELSE chunk END,
            CASE WHEN n = 8 OR size + cost > 3000 THEN cost ELSE size + cost END, CASE WHEN n = 8 OR size + cost > 3000 THEN 1 ELSE n + 1 END
        FROM w JOIN p ON p.profile_id = w.profile_id AND p.place = w.place + 1)
    SELECT id, chunk, coalesce(k, 0) AS edges, chunk % 4 <> 3 AS adopted FROM w LEFT JOIN (SELECT l_orderkey AS id, count(*) AS k FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) USING (id) WHERE chunk % 4 <> 3
    UNION ALL SELECT id, chunk, 0, false FROM w WHERE chunk % 4 = 3""")
def in_reminisce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories without edges (orders without a third line) in batches, the graph that a model gave for a batch (their first lines; every
    fourth batch failed) attached, and those that were taken up stamped, whether they got an edge or not."""
    own = read_table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("profile_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 900).alias("chars")
    )
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), "l_linenumber")
    open_ = ingest.orphans(own, lines.where("l_linenumber = 3"))
    batches = ingest.pack(open_, "profile_id", "id", "chars", 3000, most=8)
    return ingest.adopt(open_, batches.withColumn("done", F.col("chunk") % 4 != 3), lines.where("l_linenumber <= 2").select("memory_id"))


@query(sql("""WITH o AS (SELECT o_orderkey AS memory_id, CAST(o_orderkey % 7 AS INT) AS attempts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 2000 AS taken FROM orders)
    SELECT memory_id, outcome, CASE WHEN outcome = 'failed' THEN attempts + 1 ELSE attempts END AS attempts FROM (SELECT *, CASE WHEN NOT taken THEN 'waiting' WHEN attempts >= 5 THEN 'abandoned'
        WHEN memory_id NOT IN (SELECT sequence FROM memories) THEN 'orphaned' WHEN memory_id IN (SELECT vec_id FROM embeddings) THEN 'succeeded' ELSE 'failed' END AS outcome FROM o)""", "memories"))
def in_outbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of an outbox's rows (orders stand for them, with attempts so far) when its 2,000 oldest are drained, given the memories that there
    still are and the vectors that a model gave; the others wait. `streaming.outbox` keeps such an outbox over batches."""
    box = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("memory_id"), "o_orderdate", (F.col("o_orderkey") % 7).cast("int").alias("attempts"))
    batch = rows.settled(box.orderBy("o_orderdate", "memory_id").limit(2000).drop("o_orderdate"))
    vec = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    known = memories(spark, sf_dir).select(F.col("sequence").alias("id"))
    rest = box.join(batch.select("memory_id"), "memory_id", "left_anti").select("memory_id", F.lit("waiting").alias("outcome"), "attempts")
    return feeds.outcomes(batch, known, vec).select("memory_id", "outcome", "attempts").unionByName(rest)


@query(sql(f"""WITH {PROBES_SQL}, {FTS_SQL}, f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM fts QUALIFY place <= 10),
    c AS (SELECT query_id, place, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM f JOIN documents ON doc_id = id)
    SELECT query_id, string_agg('- ' || CASE WHEN length(said) > 200 THEN left(said, 200) || '…' ELSE said END, chr(10) ORDER BY place) AS context FROM c GROUP BY 1""", "memories"))
def ret_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context for a model's answer: what full text finds, a line each."""
    known = memories(spark, sf_dir).select(F.col("sequence").alias("id"), "content")
    return recall.context(fts(spark, sf_dir).select("query_id", "id", F.col("rank").alias("place")), known)
