"""Queries of recall, model-fed steps, packing, traces as graphs and page evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import codec, text
from lorekeep.operators import clusters, graph, ingest, pages, recall, rows, search
from lorekeep.plans.derived import edges, memories, sql, traces
from lorekeep.plans.engine_queries import FTS_SQL, FTS_TOP, PROBES_SQL, VISIBLE_FTS, fts, probes, visible_fts
from lorekeep.plans.functions_queries import SHINGLES, STOP
from lorekeep.plans.registry import query
from lorekeep.plans.relational_queries import BOUNDS, SEEN_SQL, SEEN_STRICTLY, SNAPSHOT, seen, segments
from lorekeep.plans.rest_queries import SPREAD_SQL, graph_hits
from lorekeep.sources import transcripts
from lorekeep.sources.tables import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query()
def recall_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: benchmark questions answered from the documents, in one plan for all questions."""
    known = memories(spark, sf_dir).select(F.col("sequence").alias("id"), "content", "topic_key", F.col("created_on").alias("known"))
    return recall.recall(probes(spark, sf_dir), known)


SELF_PROBES_SQL = f"""probes AS (SELECT sequence AS query_id, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'),
    lambda x: length(x) >= 2 AND x NOT IN ({STOP}))) AS terms FROM memories WHERE sequence % 20 = 0)"""
#: For every twentieth memory, the ten best full-text hits among active memories of its profile and type.
NEAR_DUP_SQL = """near AS (SELECT query_id, f.id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, f.id) AS rank
    FROM fts f JOIN memories a ON a.sequence = query_id JOIN memories b ON NOT b.forgotten AND b.to_sequence IS NULL AND b.sequence = f.id AND b.type = a.type AND b.profile_id = a.profile_id QUALIFY rank <= 10)"""


def own_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of memories themselves: all terms of every twentieth."""
    return memories(spark, sf_dir).where("sequence % 20 = 0").select(F.col("sequence").alias("query_id"), text.query_terms(F.col("content")).alias("terms"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id, rank: what every twentieth memory may restate: the ten best hits for all its terms among active ones (neither forgotten nor closed) of its profile and type."""
    known = memories(spark, sf_dir).withColumn("kind", F.concat("profile_id", F.lit(":"), "type"))
    active = known.select(F.col("sequence").alias("id"), "content", "kind", F.expr("NOT forgotten AND to_sequence IS NULL").alias("open"))
    asked = known.where("sequence % 20 = 0").select(F.col("sequence").alias("query_id"), "kind", text.query_terms(F.col("content")).alias("terms"))
    return search.best_bm25(active, asked, 10).select("query_id", "id", "rank")


# Sources


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def src_ndjson_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the lines of a request body, parsed back."""
    lines = read_table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line"))
    parsed = lines.select(F.from_json("line", "conv_id long, turn long, role string, text string").alias("x")).select("x.*")
    return parsed.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, role, turn, md5(text) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def src_transcript_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))
    lines = read_table(spark, sf_dir, "conversations").select(
        F.to_json(F.struct(F.col("role").alias("type"), content.alias("message"))).alias("line"),
        F.concat_ws(":", "conv_id", "turn").alias("source"),
        F.lit(0).alias("place"),
    )
    at = F.split("source", ":")
    found = transcripts.parse_blocks(lines)
    return found.select(at[0].cast("long").alias("conv_id"), "role", at[1].cast("long").alias("turn"), F.md5("content").alias("text_md5"))


@query("SELECT conv_id, role, turn, md5(text) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def src_transcript_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.array(F.struct(F.lit("input_text").alias("type"), F.col("text")))
    payload = F.struct(F.lit("message").alias("type"), F.col("role"), content.alias("content"))
    lines = read_table(spark, sf_dir, "conversations").select(
        F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("line"),
        F.concat_ws(":", "conv_id", "turn").alias("source"),
        F.lit(0).alias("place"),
    )
    at = F.split("source", ":")
    found = transcripts.parse_items(lines)
    return found.select(at[0].cast("long").alias("conv_id"), "role", at[1].cast("long").alias("turn"), F.md5("content").alias("text_md5"))


@query("SELECT CAST(conv_id AS VARCHAR) AS sample_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS place, role AS speaker, md5(text) AS text_md5 FROM conversations")
def src_locomo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a benchmark sample of one session, parsed back."""
    turn = F.struct("turn", "role", F.col("role").alias("speaker"), "text")
    grouped = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("session_1"))
    sample = F.to_json(F.struct(F.col("conv_id").cast("string").alias("sample_id"), F.struct("session_1").alias("conversation")))
    turns, _ = transcripts.parse_benchmark(grouped.select(sample.alias("sample")))
    return turns.select("sample_id", F.col("place").cast("long").alias("place"), "speaker", F.md5("text").alias("text_md5"))


# Packing


@query("""WITH RECURSIVE m AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, n_chars AS cost FROM documents),
    w AS (SELECT source, place, CAST(0 AS BIGINT) AS chunk, cost AS size FROM m WHERE place = 0
        UNION ALL SELECT m.source, m.place, CASE WHEN size + cost > 40000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + cost > 40000 THEN cost ELSE size + cost END
        FROM w JOIN m ON m.source = w.source AND m.place = w.place + 1)
    SELECT source, chunk, min(place) AS first, max(place) AS last, max(size) AS size FROM w GROUP BY ALL""")
def str_batch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pack(_documents(spark, sf_dir), "source", "doc_id", "n_chars", 40_000)


@query()
def str_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that share two turns with the one before."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    return ingest.chunk(turns, 2000, overlap=2)


@query("""SELECT source, 'It defines ' || array_to_string(list_slice(list_sort(list_distinct(list(lang || ' ' || (doc_id % 12)))), 1, 30), ', ') || '.' AS fact
    FROM documents GROUP BY 1""")
def str_fact_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.collect_set(F.concat_ws(" ", "lang", (F.col("doc_id") % 12).cast("string"))))
    listed = F.array_join(F.slice(names, 1, 30), ", ")
    return _documents(spark, sf_dir).groupBy("source").agg(F.concat(F.lit("It defines "), listed, F.lit(".")).alias("fact"))


# Vectors


@query("SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def vec_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as bytes and read back."""
    table = read_table(spark, sf_dir, "embeddings")
    back = table.select("vec_id", codec.decode_vector(codec.encode_vector(F.col("embedding"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("v").cast("long").alias("width"), F.round(total, 5).alias("total"))


@query("""WITH q AS (SELECT vec_id - 1 AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 1),
    d AS (SELECT query_id, vec_id, list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS d FROM embeddings JOIN q ON vec_id <> query_id)
    SELECT query_id, vec_id, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) <= 10""")
def vec_hyde_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest to second query vectors, those of made-up answers, which a model supplies (here a column: the vector of the next number)."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    answers = table.where("id % 20 = 1").select((F.col("id") - 1).alias("query_id"), F.col("v").alias("q"))
    return search.nearest(table, answers, 10).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


# Retrieval


@query(f"""WITH {PROBES_SQL}, {FTS_SQL}, {FTS_TOP}, l AS (SELECT f.*, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 2 WHEN quality = 1 AND id % 2 = 0 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END AS bucket
        FROM fts_top f LEFT JOIN labels ON doc_id = id),
    k AS (SELECT * FROM l WHERE bucket IS NOT NULL), s AS (SELECT query_id, bool_or(bucket < 2) AS useful FROM k GROUP BY 1)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN useful THEN bucket ELSE 0 END, rank) AS rank FROM k JOIN s USING (query_id) WHERE NOT useful OR bucket < 2""")
def ret_rerank_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits reordered by labels that a model gave, here those of the table of labels; hits without one are not asked about."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    hits = fts(spark, sf_dir).join(labels, "id")
    good = (F.col("quality") == 1) & (F.col("toxic") != 1)
    label = F.when(good & (F.col("id") % 2 == 0), "essential").when(good, "related").otherwise("irrelevant")
    return recall.rerank_by_label(hits.withColumn("label", label).select("query_id", "id", "rank", "label"))


@query(sql(f"WITH {SELF_PROBES_SQL}, {FTS_SQL}, {NEAR_DUP_SQL} SELECT query_id, id, rank FROM near", "memories"))
def ret_near_dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth memory the ten best full-text hits for all its terms, among active ones of its profile and type: filtered before the limit."""
    return near_duplicates(spark, sf_dir)


@query(sql(f"""WITH {SEEN_SQL}, {SELF_PROBES_SQL}, {FTS_SQL}, i AS (SELECT sequence AS query_id, type, topic_key FROM memories WHERE sequence % 20 = 0),
    k AS (SELECT query_id, s.sequence AS id, 1 AS p FROM i JOIN seen s USING (type, topic_key) WHERE s.sequence <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_on DESC, s.sequence) <= 4),
    f AS (SELECT query_id, id, 2 AS p FROM fts WHERE query_id <> id AND id IN (SELECT sequence FROM seen) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 4),
    e AS (SELECT sequence, source AS x FROM edges WHERE relation <> 'lives in' UNION SELECT sequence, target FROM edges WHERE relation <> 'lives in'),
    g AS (SELECT query_id, b.sequence AS id, 3 AS p FROM (SELECT DISTINCT i.query_id, b.sequence FROM i JOIN e a ON a.sequence = query_id JOIN e b ON b.x = a.x WHERE b.sequence <> query_id) b
        WHERE b.sequence IN (SELECT sequence FROM seen) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.sequence) <= 4),
    n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
        WHERE q.vec_id % 20 = 0 AND v.vec_id IN (SELECT sequence FROM seen)),
    v AS (SELECT query_id, id, 4 AS p FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) <= 4)
    SELECT query_id, id, min(p) AS priority FROM (SELECT * FROM k UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g UNION ALL SELECT * FROM v) GROUP BY ALL""", "memories", "edges"))
def ret_conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each new memory (every twentieth) may contradict: open ones of its key, near by words, by the graph, by vectors; four of each, the first channel counts."""
    known = memories(spark, sf_dir)
    open_ = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "type", "topic_key", "created_on")
    new = known.where("sequence % 20 = 0").select(F.col("sequence").alias("query_id"), "type", "topic_key")
    keyed = search.ranked(open_.join(new, ["type", "topic_key"]).where("query_id <> id"), 4, [F.desc("created_on"), F.col("id")])
    every = segments(spark, sf_dir).select(F.col("sequence").alias("id"), "content", rows.visible(SNAPSHOT).alias("open"))
    worded = search.best_bm25(every, own_probes(spark, sf_dir), 4, apart=True)
    ends = rows.endpoints(edges(spark, sf_dir).where("relation <> 'lives in'"), "sequence").distinct()
    named = new.select("query_id").join(ends.withColumnRenamed("sequence", "query_id"), "query_id")
    linked = ends.select("entity", F.col("sequence").alias("id")).join(named, "entity").select("query_id", "id").distinct().where("query_id <> id")
    linked = search.ranked(linked.join(open_.select("id"), "id", "left_semi"), 4, [F.col("id")])
    vec = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vec.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = search.nearest(vec.join(open_.select("id"), "id", "left_semi"), asked, 4)
    return search.first_channel([keyed, worded, linked, near])




@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, {VISIBLE_FTS}, {SPREAD_SQL} SELECT query_id, id, rank FROM graph_top""", "memories", "edges"))
def ret_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible memories by how near they are, in the graph, to the entities of the first wave's best; then the newest."""
    return graph_hits(spark, sf_dir, visible_fts(spark, sf_dir)).select("query_id", "id", "rank")


# Time


@query(sql(f"""WITH {SELF_PROBES_SQL}, {FTS_SQL}, {NEAR_DUP_SQL}, s AS ({SHINGLES}),
    c AS (SELECT near.* FROM near JOIN memories a ON a.sequence = query_id JOIN memories b ON b.sequence = near.id WHERE query_id <> near.id AND a.session_id <> 'src0' AND b.session_id <> 'src0'),
    j AS (SELECT c.*, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS likeness FROM c JOIN s x ON x.doc_id = query_id JOIN s y ON y.doc_id = c.id WHERE len(x.s) > 0 AND len(y.s) > 0)
    SELECT query_id AS id, id AS supersedes, round(likeness, 9) AS likeness FROM j WHERE likeness >= 0.7 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY likeness DESC, rank DESC) = 1""", "memories"))
def tmp_supersede_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each new memory (every twentieth) restates: of its near-duplicate candidates, none from code (here `src0`) nor itself, the likeliest, if 0.7 of
    the shingles are shared; of equals the later hit."""
    known = memories(spark, sf_dir).where("session_id <> 'src0'").select(F.col("sequence").alias("id"), "content")
    hits = near_duplicates(spark, sf_dir).where("query_id <> id").join(known.select("id"), "id", "left_semi")
    return search.restated(hits, known, 0.7).select(F.col("query_id").alias("id"), F.col("id").alias("supersedes"), F.round("likeness", 9).alias("likeness"))


# Graph


@query(sql("""WITH t AS (SELECT event_id, lower(tool) AS tool, CASE WHEN tool = 'click' THEN 'write' ELSE lower(tool) END AS shown, status, session_id, CAST(json_extract(args, '$.k') AS BIGINT) AS k FROM traces),
    c AS (SELECT *, shown || ' src/a.py :mod' || k % 3 || ':test b' || k || '.ts' AS command FROM t)
    SELECT event_id, shown AS source, 'invoked' AS relation, command AS target FROM c
    UNION ALL SELECT event_id, command, 'failed_in', 'suite' || session_id FROM c WHERE status = 'failure'
    UNION ALL SELECT event_id, command, 'validates', 'mod' || k % 3 FROM c
    UNION ALL SELECT event_id, command, 'touched', f FROM c, unnest(['./src/a.py', 'b' || k || '.ts']) u(f) WHERE shown = 'write'""", "traces"))
def gr_trace_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What traces say as edges (clicks stand for an editing tool)."""
    k = F.get_json_object("args", "$.k").cast("long")
    made = traces(spark, sf_dir).select(
        "event_id",
        F.when(F.col("tool") == "click", "Write").otherwise(F.col("tool")).alias("tool"),
        F.concat(F.lit("./src/a.py :mod"), (k % 3).cast("string"), F.lit(":test b"), k.cast("string"), F.lit(".ts")).alias("args"),
        "status",
        F.when(F.col("status") == "failure", F.concat(F.lit("Suite"), F.col("session_id").cast("string"), F.lit(" > works() FAILED"))).alias("error"),
        F.lit(None).cast("string").alias("output"),
    )
    return ingest.trace_triples(made, "event_id").select("event_id", "source", "relation", "target")


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
    s AS (SELECT p_partkey AS symbol, 'pkg.C' || p_partkey % 50 || '.run' AS qualified, 'C' || p_partkey % 50 AS name FROM part),
    q AS (SELECT event_id, symbol FROM e JOIN s ON qualified = 'pkg.C' || k || '.run' WHERE k % 2 = 0),
    b AS (SELECT event_id, symbol FROM e JOIN s ON name = 'C' || (k + 1) % 60),
    u AS (SELECT event_id, symbol, min(p) AS p FROM (SELECT *, 1 AS p FROM q UNION ALL SELECT *, 2 FROM b) GROUP BY ALL)
    SELECT event_id, symbol FROM u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p, symbol) <= 3""")
def gr_trace_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that a trace's stack frames name, then those of the files it names; three at most."""
    k = F.get_json_object("props", "$.k").cast("long")
    frame = F.concat(F.lit("boom\n  at pkg.C"), k.cast("string"), F.lit(".run (C.java)"))
    calls = read_table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 2 == 0, frame).alias("error"), F.lit(None).cast("string").alias("output"), F.concat(F.lit("src/C"), ((k + 1) % 60).cast("string"), F.lit(".py")).alias("args")
    )
    n = (F.col("p_partkey") % 50).cast("string")
    symbols = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol"), F.concat(F.lit("pkg.C"), n, F.lit(".run")).alias("qualified"), F.concat(F.lit("C"), n).alias("name")
    )
    return ingest.trace_links(calls, symbols, "event_id", most=3)


@query(sql("""WITH e AS (SELECT source, target FROM edges WHERE sequence % 3 > 0), steps AS MATERIALIZED (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
    h0 AS (SELECT o_orderkey AS query_id, 'o' || o_orderkey AS entity FROM orders WHERE o_orderkey % 20 = 0),
    n1 AS (SELECT DISTINCT query_id, b AS entity FROM h0 JOIN steps ON a = entity), t1 AS (SELECT * FROM n1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entity) <= 5),
    h1 AS MATERIALIZED (SELECT * FROM t1 EXCEPT SELECT * FROM h0),
    n2 AS (SELECT DISTINCT query_id, b AS entity FROM h1 JOIN steps ON a = entity), t2 AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entity) <= 5),
    h2 AS (SELECT * FROM t2 EXCEPT SELECT * FROM h1 EXCEPT SELECT * FROM h0)
    SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2""", "edges"))
def gr_code_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks both ways from every twentieth order over edges that are not merely guessed; repeated edges do not spend the fanout of five."""
    sure = F.element_at(F.array(*map(F.lit, ("guessed", "inferred", "exact"))), (F.col("sequence") % 3 + 1).cast("int"))
    e = edges(spark, sf_dir).withColumn("confidence", sure).where(rows.at_least(F.col("confidence"), ("guessed", "inferred", "exact"), "inferred"))
    key = F.col("o_orderkey")
    seeds = read_table(spark, sf_dir, "orders").where(key % 20 == 0).select(key.alias("query_id"), F.concat(F.lit("o"), key.cast("string")).alias("entity"))
    return graph.symbol_walk(e, seeds, depth=2, fanout=5)


# Clusters and pages


ELIGIBLE_SQL = f"""WITH strict AS (SELECT * FROM (SELECT {BOUNDS} FROM memories) WHERE {SEEN_STRICTLY}),
    s AS (SELECT topic_key AS cluster, sequence // 100 AS synthesis, sequence, session_id FROM memories WHERE topic_key IS NOT NULL AND sequence % 9 = 0),
    l AS (SELECT cluster, max(synthesis) AS latest FROM s GROUP BY 1),
    o AS (SELECT cluster, synthesis, bool_and(t.id IS NOT NULL) AND NOT bool_or(s.session_id = 'src0') AS whole FROM s LEFT JOIN (SELECT sequence, id FROM strict) t USING (sequence) GROUP BY ALL),
    p AS (SELECT cluster, synthesis, substr(cluster, 1, 3) || 'src1' AS child, CASE WHEN synthesis % 2 = 0 THEN (SELECT latest FROM l d WHERE d.cluster = substr(o.cluster, 1, 3) || 'src1') ELSE 0 END AS pinned FROM o)
    SELECT cluster, synthesis, synthesis = latest AND whole AND coalesce((SELECT latest FROM l d WHERE d.cluster = p.child), -1) = coalesce(pinned, -1) AS eligible FROM o JOIN l USING (cluster) JOIN p USING (cluster, synthesis)"""


@query(sql(ELIGIBLE_SQL, "memories"))
def cl_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthesis counts while it is its cluster's latest, all its supports are visible (by both bounds) and none comes from code (here `src0`), and
    the child syntheses it was made from are still the latest."""
    strict = segments(spark, sf_dir).where(rows.visible(SNAPSHOT, strict=True)).select(F.col("sequence").alias("source"))
    s = memories(spark, sf_dir).where("topic_key IS NOT NULL AND sequence % 9 = 0")
    supports = s.select(F.col("topic_key").alias("cluster"), F.floor(F.col("sequence") / 100).alias("synthesis"), F.col("sequence").alias("source"), (F.col("session_id") == "src0").alias("code"))
    child = F.concat(F.substring("cluster", 1, 3), F.lit("src1"))
    made = supports.select("cluster", "synthesis", child.alias("child")).distinct()
    latest = supports.groupBy(F.col("cluster").alias("child")).agg(F.max("synthesis").alias("last"))
    pinned = F.when(F.col("synthesis") % 2 == 0, F.col("last")).otherwise(0)
    pins = made.join(latest, "child", "left").select("cluster", "synthesis", "child", pinned.alias("pinned"))
    return clusters.eligible(supports, pins, strict)


@query(sql("""WITH k AS (SELECT topic_key, max(sequence) AS revision, count(*) AS n FROM memories WHERE topic_key IS NOT NULL GROUP BY 1)
    SELECT '{"kind":"cluster","id":"' || topic_key || '","revision":' || revision || ',"members":' || n || '}' AS line FROM k
    UNION ALL SELECT '{"kind":"member","cluster":"' || topic_key || '","id":"' || id || '","role":"' || CASE WHEN sequence % 3 = 0 THEN 'core' ELSE 'related' END || '"}' FROM memories WHERE topic_key IS NOT NULL
    UNION ALL SELECT '{"kind":"override","cluster":"' || topic_key || '","id":"' || id || '","decision":"excluded"}' FROM memories WHERE topic_key IS NOT NULL AND forgotten
    UNION ALL SELECT '{"kind":"boundary","at":"' || valid_to || CASE WHEN forgotten THEN '","redactionReason":"forgotten_source"}' ELSE '","memoryId":"' || id || '"}' END FROM memories WHERE valid_to IS NOT NULL
    UNION ALL SELECT '{"kind":"synthesis","cluster":"' || cluster || '","id":' || synthesis || CASE WHEN eligible THEN ',"claims":' || (SELECT to_json(list(id ORDER BY id)) FROM memories WHERE topic_key = cluster AND sequence % 9 = 0 AND sequence // 100 = synthesis)
        ELSE ',"redactionReason":"source_or_revision_unavailable"' END || '}' FROM (""" + ELIGIBLE_SQL + ")", "memories"))
def cl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all clusters as lines: clusters, members, overrides, times at which memories end, and syntheses, with their claims where they may be
    used. What refers to a forgotten source, or rests on what is no longer there, is redacted. No cluster of any size is gathered."""
    m = memories(spark, sf_dir).where("topic_key IS NOT NULL")
    heads = m.groupBy(F.col("topic_key").alias("id")).agg(F.max("sequence").alias("revision"), F.count("*").alias("members"))
    role = F.when(F.col("sequence") % 3 == 0, "core").otherwise("related")
    members = m.select(F.col("topic_key").alias("cluster"), "id", role.alias("role"))
    overrides = m.where("forgotten").select(F.col("topic_key").alias("cluster"), "id", F.lit("excluded").alias("decision"))
    gone = F.when(F.col("forgotten"), "forgotten_source").alias("redactionReason")
    boundaries = memories(spark, sf_dir).where("valid_to IS NOT NULL").select(F.col("valid_to").alias("at"), F.when(~F.col("forgotten"), F.col("id")).alias("memoryId"), gone)
    claims = m.where("sequence % 9 = 0").groupBy(F.col("topic_key").alias("cluster"), F.floor(F.col("sequence") / 100).alias("synthesis")).agg(F.array_sort(F.collect_list("id")).alias("claims"))
    made = cl_eligible(spark, sf_dir).join(claims, ["cluster", "synthesis"])
    reason = F.when(~F.col("eligible"), "source_or_revision_unavailable").alias("redactionReason")
    syntheses = made.select("cluster", F.col("synthesis").alias("id"), F.when(F.col("eligible"), F.col("claims")).alias("claims"), reason)
    return clusters.archive(cluster=heads, member=members, override=overrides, boundary=boundaries, synthesis=syntheses)


def evidence_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members, supports, claims: the documents of each page (a source) in fact groups, every third a core one; a claim for every tenth document, on itself and
    on the one twenty numbers later."""
    n = F.col("doc_id")
    group = F.concat_ws(":", "lang", (n % 40).cast("string"))
    docs = _documents(spark, sf_dir)
    members = docs.select(F.col("source").alias("page"), n.alias("id"), group.alias("fact_group"), (n % 3 == 0).alias("core"), F.col("n_chars").alias("chars"))
    told = docs.where(n % 10 == 0).select(F.col("source").alias("page"), n.alias("claim"), F.least(F.col("n_chars"), F.lit(400)).alias("chars"))
    near = told.select("page", "claim", F.explode(F.array("claim", F.col("claim") + 20)).alias("id"))
    return members, near.join(members.select("page", "id"), ["page", "id"], "left_semi"), told


@query()
def wk_evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about each page within 8,000 tokens, of which 1,200 characters are the question and 60 stand around each source: whole fact
    groups, core ones first, single sources halved; then the claims that rest on these, as far as there is room. Checked against brute force."""
    members, supports, claims = evidence_inputs(spark, sf_dir)
    chosen = rows.settled(pages.select_evidence(members, 8000, frame=60, overhead=1200))
    kept = pages.fitting_claims(chosen, supports, claims, 8000, frame=60, overhead=1200)
    return chosen.withColumn("kind", F.lit("evidence")).unionByName(kept.select("page", F.col("claim").alias("id"), F.lit("claim").alias("kind")), allowMissingColumns=True)


@query("""WITH d AS (SELECT doc_id, doc_id % 8 = 1 AS no_cites, doc_id % 8 = 2 AS bad_ref, doc_id % 8 = 3 AS markup, doc_id % 8 = 4 AS url, doc_id % 8 = 5 AS bad_link, doc_id % 8 = 6 AS no_sections FROM documents)
    SELECT doc_id, NOT (no_cites OR bad_ref OR markup OR url OR bad_link OR no_sections) AS valid FROM d""")
def wk_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that may cite and link only what they were given, and hold neither markup nor addresses; most are wrong in one way."""
    n = F.col("doc_id") % 8
    said = F.when(n == 3, "see <b>this</b>").when(n == 4, "see www.example.org for more").when(n == 5, "see [[p9]] too").otherwise("see [[p1]] and [[p2]] too")
    cites = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("E1"), F.lit("E7"))).otherwise(F.array(F.lit("E1"), F.lit("E2")))
    sections = F.array(F.struct(F.lit("A title").alias("title"), F.array(F.struct(said.alias("text"), cites.alias("citations"))).alias("paragraphs")))
    article = F.when(n == 6, F.lit('{"sections":[]}')).otherwise(F.to_json(F.struct(sections.alias("sections"))))
    refs, links = (F.array(*map(F.lit, x)) for x in (("E1", "E2", "E3"), ("p1", "p2")))
    return _documents(spark, sf_dir).select("doc_id", pages.valid_article(article, refs, links, 500).alias("valid"))


# Ingestion


@query("""WITH s AS (SELECT conv_id, turn, text, unnest([0, 1, 2]) AS sample FROM conversations WHERE (conv_id + turn) % 5 <> 4)
    SELECT conv_id, turn, 'fact:' || md5(CASE WHEN sample = 2 THEN 'other' ELSE text END) AS candidate, min(sample) AS sample, count(*) AS n FROM s GROUP BY ALL""")
def in_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of what a model's samples found in each chunk, from its answers as JSON (every fifth is malformed and counts for nothing)."""
    samples = F.explode(F.sequence(F.lit(0), F.lit(2)))
    each = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", samples.alias("sample"))
    found = F.md5(F.when(F.col("sample") == 2, "other").otherwise(F.col("text")))
    answer = F.to_json(F.array(F.struct(F.lit("Fact").alias("type"), found.alias("content")), F.struct(F.lit("fact").alias("type"), F.concat(F.lit(" "), found).alias("content"))))
    answers = each.select("conv_id", "turn", "sample", F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, '[{"type":').otherwise(answer).alias("answer"))
    return ingest.candidates(answers, ["conv_id", "turn"])


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL OR l.toxic = 1 THEN 'drop' WHEN l.quality = 0 THEN 'correct' ELSE 'pass' END AS verdict
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def in_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate without a verdict is dropped."""
    verdict = F.when(F.col("quality").isNull() | (F.col("toxic") == 1), "drop").when(F.col("quality") == 0, "correct").otherwise("pass")
    labels = read_table(spark, sf_dir, "labels")
    return _documents(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'replacement' WHEN o_orderkey % 3 = 1 THEN 'correction' ELSE 'unrelated' END AS relationship, o_orderkey % 4 <> 0 AS borne_out FROM orders)
    SELECT o_custkey AS incoming, min(o_orderkey) AS revision_id FROM d WHERE relationship <> 'unrelated' AND borne_out GROUP BY 1 HAVING count(*) = 1""")
def in_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's decision that a new memory replaces or corrects an old one is accepted only where exactly one is borne out by both texts."""
    n = F.col("o_orderkey")
    said = F.concat(F.lit("The price of part "), F.col("o_custkey").cast("string"), F.lit(" is new"))
    decisions = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("incoming"),
        n.alias("revision_id"),
        F.when(n % 3 == 0, "replacement").when(n % 3 == 1, "correction").otherwise("unrelated").alias("relationship"),
        said.alias("content"),
        F.lit("the PRICE of part was old").alias("old"),
        F.array(F.lit("price"), F.when(n % 4 != 0, "of part").otherwise("weight")).alias("subjects"),
        F.lit("is new").alias("evidence"),
        F.lit("was old").alias("old_evidence"),
    )
    return ingest.accepted_conflicts(decisions)


@query(sql("""WITH t AS (SELECT *, event_id // 10 AS batch, tool || '-k-' || CAST(json_extract(args, '$.k') AS BIGINT) AS signature FROM traces),
    w AS (SELECT batch FROM t GROUP BY 1 HAVING bool_or(status = 'failure' OR tool = 'view')),
    r AS (SELECT batch, event_id, event_id % 3 <> 2 AS grounded, event_id % 7 = 0 AS confirmed FROM t WHERE batch IN (SELECT batch FROM w))
    SELECT batch, event_id AS recipe FROM r WHERE grounded OR confirmed QUALIFY row_number() OVER (PARTITION BY batch ORDER BY event_id) <= 3""", "traces"))
def tr_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What batches of traces teach: batches with a failure or an unknown command; of a model's statements those that the log bears out, or that a
    second look confirmed; three at most."""
    n = F.col("event_id")
    t = traces(spark, sf_dir).withColumn("batch", F.floor(n / 10)).withColumn("signature", text.command_signature(F.col("tool"), F.col("args")))
    known = t.where("tool <> 'view'").select("signature").distinct()
    log = F.lit("run gradle check before pushing; the build failed at step 7")
    statement = F.when(n % 3 != 2, "Run gradle check before pushing").otherwise("Always restart the server at step 9")
    statements = t.select("batch", n.alias("recipe"), n.alias("place"), statement.alias("statement"), log.alias("log"), (n % 7 == 0).alias("confirmed"))
    return ingest.recipes(t.select("batch", "signature", "status"), known, statements).select("batch", "recipe")


@query("""WITH f AS (SELECT doc_id, source || '/' || doc_id AS path, source AS module FROM documents WHERE doc_id % 2 = 1),
    s AS (SELECT doc_id, doc_id % 12 + i AS name, i FROM f, range(11) r(i) WHERE i < doc_id % 12)
    SELECT f.doc_id, path, 'It defines ' || coalesce((SELECT string_agg('function s' || name, ', ' ORDER BY name) FROM s WHERE s.doc_id = f.doc_id), 'nothing') || '.' AS fact,
        least((SELECT count(*) FROM s WHERE s.doc_id = f.doc_id), 8) AS defines, e.name AS target
    FROM f LEFT JOIN (SELECT doc_id, 's' || name AS name FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s.name) <= 8) e ON e.doc_id = f.doc_id""")
def cd_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed since the index was made (the odd ones): what each defines as a fact, and a row for each defines edge that the graph gets (eight at most)."""
    docs = _documents(spark, sf_dir)
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), F.sha2("text", 256).alias("digest"))
    symbols = docs.select(path.alias("path"), F.col("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).where(F.col("i") < F.col("doc_id") % 12)
    symbols = symbols.select("path", F.lit("function").alias("kind"), F.col("i").alias("line"), F.concat(F.lit("s"), (F.col("doc_id") % 12 + F.col("i")).cast("string")).alias("name"), (F.col("doc_id") % 12 + F.col("i")).alias("order"))
    ledger = files.where("doc_id % 2 = 0").select("path", "digest")
    found = ingest.index_files(files, ledger, symbols)
    return found.select("doc_id", "path", "fact", "defines", F.explode_outer("targets").alias("target"))
