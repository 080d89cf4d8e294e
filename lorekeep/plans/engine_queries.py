"""Queries of retrieval, temporal and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import dates, text, vectors
from lorekeep.operators import graph, ingest, rows, search, temporal
from lorekeep.operators.vector_blocks import VectorBlocks
from lorekeep.plans.derived import assertions, edges, memories, sql
from lorekeep.plans.functions_queries import STOP
from lorekeep.plans.registry import query
from lorekeep.plans.relational_queries import SEEN_SQL, seen
from lorekeep.sources.tables import read_table

# Retrieval. Queries are the benchmark items whose id is divisible by 20, against all rows.

PROBES_SQL = f"""probes AS (SELECT item_id AS query_id, text AS said, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'),
    lambda x: length(x) >= 2 AND x NOT IN ({STOP}))) AS terms FROM benchmark WHERE item_id % 20 = 0)"""


def bm25_sql(name: str, table: str, ident: str, body: str) -> str:
    return f"""{name}_words AS (SELECT {ident} AS id, unnest(list_filter(string_split_regex(lower({body}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS term FROM {table}),
    {name}_sizes AS (SELECT {ident} AS id, len(list_filter(string_split_regex(lower({body}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS size FROM {table}),
    {name}_tf AS (SELECT id, term, count(*) AS tf FROM {name}_words GROUP BY ALL),
    {name}_idf AS (SELECT term, greatest(ln(((SELECT count(*) FROM {name}_sizes) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM {name}_tf GROUP BY 1),
    {name} AS (SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(size) FROM {name}_sizes)))) AS score
        FROM (SELECT query_id, unnest(terms) AS term FROM probes) JOIN {name}_tf USING (term) JOIN {name}_idf USING (term) JOIN {name}_sizes USING (id) GROUP BY ALL)"""


FTS_SQL = bm25_sql("fts", "documents", "doc_id", "text")
VISIBLE_FTS = f"""fts_top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fts QUALIFY rank <= 300)
    WHERE id IN (SELECT sequence FROM seen) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10)"""
FTS_TOP = "fts_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fts QUALIFY rank <= 10)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("said"), text.query_terms(F.col("text")).alias("terms"))


def fts(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    """The channel of full-text hits over documents."""
    scored = search.bm25(read_table(spark, sf_dir, "documents"), probes(spark, sf_dir), "doc_id", "text")
    return search.ranked(scored, limit, [F.desc(F.round("score", 9)), F.col("id")])


def visible_fts(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    """The best full-text hits over memories that are visible; of a query's hits 300 are looked at."""
    scored = search.bm25(read_table(spark, sf_dir, "documents"), probes(spark, sf_dir), "doc_id", "text")
    looked = search.ranked(scored, 300, [F.desc(F.round("score", 9)), F.col("id")]).withColumnRenamed("rank", "of_all")
    visible = seen(spark, sf_dir).select(F.col("sequence").alias("id"))
    return search.ranked(looked.join(visible, "id", "left_semi"), limit, [F.col("of_all")]).select("query_id", "id", "score", "rank")


@query(sql(f"WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, {VISIBLE_FTS} SELECT query_id, id, rank, round(score, 6) AS score FROM fts_top", "memories"))
def ret_fts_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_fts(spark, sf_dir).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {PROBES_SQL}, {FTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fts)
    SELECT query_id, source, min(rank) AS best FROM t JOIN documents ON doc_id = id WHERE rank <= 300 GROUP BY ALL""")
def agg_min_rank_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank of each source among the 300 hits of a question that are looked at."""
    sources = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return fts(spark, sf_dir, 300).join(sources, "id").groupBy("query_id", "source").agg(F.min("rank").alias("best"))


MESSAGES_SQL = bm25_sql("said", "conversations", "conv_id || ':' || turn || ':' || role", "text")
SESSIONS = """sessions AS (SELECT query_id, CAST(split_part(id, ':', 1) AS BIGINT) AS session_id, max(score) AS score FROM said GROUP BY ALL),
    sessions_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, session_id) AS rank FROM sessions QUALIFY rank <= 10)"""


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {MESSAGES_SQL}, best AS (SELECT query_id, 'src' || CAST(split_part(id, ':', 1) AS BIGINT) % 10 AS session_id, max(score) AS score FROM said GROUP BY ALL)
    SELECT query_id, sequence AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, session_id, created_on DESC, sequence) AS rank FROM best JOIN seen USING (session_id) QUALIFY rank <= 10""", "memories"))
def ret_fts_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible memories of the sessions with the best messages, newest first (a conversation belongs to the session of its last digit)."""
    said = read_table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn", "role").alias("id"), F.col("text").alias("content"))
    scored = search.bm25(said, probes(spark, sf_dir))
    session = F.concat(F.lit("src"), (F.split("id", ":")[0].cast("long") % 10).cast("string"))
    best = scored.groupBy("query_id", session.alias("session_id")).agg(F.max("score").alias("score"))
    held = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "session_id", "created_on")
    order = [F.desc(F.round("score", 9)), F.col("session_id"), F.desc("created_on"), F.col("id")]
    # A question's ten come from its ten best sessions, and from each session's ten newest.
    newest = search.ranked(held, 10, [F.desc("created_on"), F.col("id")], by="session_id").drop("rank")
    some = search.ranked(best.join(newest.select("session_id").distinct(), "session_id", "left_semi"), 10, order[:2]).drop("rank")
    return search.ranked(newest.join(some, "session_id"), 10, order).select("query_id", "id", "rank")


KEYS = ("en.src3", "fr.src1", "de.src2")


@query(sql(f"""WITH {SEEN_SQL} SELECT id, topic_key, list_position(['en.src3', 'fr.src1', 'de.src2'], topic_key) AS priority FROM (
    SELECT * FROM seen WHERE topic_key IN ('en.src3', 'fr.src1', 'de.src2') AND type IN ('fact', 'instruction')
    ORDER BY created_on DESC, id LIMIT 30)""", "memories"))
def ret_exact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the order by key, so an old row of a high key can be cut."""
    hits = seen(spark, sf_dir).where(F.col("topic_key").isin(*KEYS) & F.col("type").isin("fact", "instruction"))
    cut = hits.orderBy(F.desc("created_on"), "id").limit(30)
    return cut.select("id", "topic_key", F.array_position(F.array(*map(F.lit, KEYS)), F.col("topic_key")).cast("int").alias("priority"))


VECTOR_SQL = """near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    near_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM near QUALIFY rank <= 10)"""


def nearest(spark: SparkSession, sf_dir: str, limit: int = 10, asked: DataFrame | None = None) -> DataFrame:
    """The nearest vectors of each query vector: those whose id is divisible by 20, of these only the ones of `asked` (query_id) if given, against all."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    only = asked
    asked = table.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    asked = asked if only is None else asked.join(only, "query_id", "left_semi")
    return search.nearest(table, asked, limit).withColumnRenamed("distance", "d")


def keyed_hits(visible: DataFrame, keys: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, id, rank: the newest memories (id, topic_key, created_on) of each question's key (query_id, topic_key).

    Each key's memories are cut to `limit` before questions meet them, so a question meets no more than that.
    """
    newest = search.ranked(visible, limit, [F.desc("created_on"), F.col("id")], by="topic_key")
    return keys.join(newest.select("topic_key", "id", "rank"), "topic_key").select("query_id", "id", "rank")


@query(f"WITH {VECTOR_SQL} SELECT query_id, id, rank, round(d, 6) AS distance FROM near_top")
def ret_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By blocks around pivots, so that blocks that cannot hold a nearer vector are not compared."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = table.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = VectorBlocks(table, width=64).nearest(asked, 10)
    return found.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


LIKE_SQL = """hits AS (SELECT query_id, doc_id AS id, count(*) AS hits FROM (SELECT query_id, unnest(terms) AS term FROM probes)
    JOIN (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> ''))) AS term FROM documents)
    USING (term) GROUP BY ALL)"""


@query(sql(f"""WITH {PROBES_SQL}, t AS (SELECT query_id, unnest(terms) AS term FROM probes),
    c AS (SELECT query_id, sequence AS id, count(*) AS hits FROM memories JOIN t ON contains(lower(content), term) GROUP BY ALL),
    s AS (SELECT DISTINCT query_id, 'src' || conv_id % 100 AS session_id FROM conversations JOIN t ON contains(lower(text), term)),
    h AS (SELECT * FROM c UNION ALL SELECT query_id, sequence, 1 FROM s JOIN memories USING (session_id))
    SELECT * FROM (SELECT query_id, id, max(hits) AS hits FROM h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) <= 10""", "memories"))
def ret_legacy_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories by how many of the query's terms their text holds anywhere; one whose session has a message with a term counts one at least."""
    terms = probes(spark, sf_dir).select("query_id", F.explode("terms").alias("term"))
    each = terms.select("term").distinct()
    held = memories(spark, sf_dir).select(F.col("sequence").alias("id"), "session_id", F.lower("content").alias("content"))
    own = search.contained(held, "content", each).select("id", "term").join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    said = read_table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 100).cast("string")).alias("session_id"), F.lower("text").alias("said"))
    sessions = search.contained(said, "said", each).select("session_id", "term").join(terms, "term").select("query_id", "session_id").distinct()
    # By its sessions a query gets no more than its first ten, each with one hit at least, and so no more than ten of each session.
    some = search.ranked(held.select("id", "session_id"), 10, [F.col("id")], by="session_id")
    by_session = some.join(sessions, "session_id").select("query_id", "id", F.lit(1).cast("long").alias("hits"))
    best = search.ranked(own, 10, [F.desc("hits"), F.col("id")]).drop("rank").unionByName(by_session).groupBy("query_id", "id").agg(F.max("hits").alias("hits"))
    return search.ranked(best, 10, [F.desc("hits"), F.col("id")]).select("query_id", "id", "hits")


FUSED_SQL = f"""WITH {PROBES_SQL}, {FTS_SQL}, {FTS_TOP}, {VECTOR_SQL}, {LIKE_SQL},
    like_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM hits QUALIFY rank <= 10),
    shares AS (SELECT query_id, id, 'fts' AS channel, 1.0 / (60 + rank) AS share FROM fts_top
        UNION ALL SELECT query_id, id, 'vector', 1.0 / (60 + rank) FROM near_top WHERE query_id IN (SELECT query_id FROM probes)
        UNION ALL SELECT query_id, id, 'message', 0.5 / (60 + rank) FROM like_top),
    fused AS (SELECT query_id, id, sum(share) AS score, 'rrf:' || string_agg(channel, '+' ORDER BY share DESC, channel) AS source FROM shares GROUP BY ALL)"""


def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how many of the query's terms are among their words."""
    terms = probes(spark, sf_dir).select("query_id", F.explode("terms").alias("term"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    counted = docs.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    return search.ranked(counted, 10, [F.desc("hits"), F.col("id")])


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text, vector and term-count channels, fused."""
    asked = probes(spark, sf_dir).select("query_id")
    near = nearest(spark, sf_dir, asked=asked)
    terms = shared_terms(spark, sf_dir)
    channels = search.channel(fts(spark, sf_dir), "fts").unionByName(search.channel(near, "vector")).unionByName(search.channel(terms, "message"))
    return search.fuse(channels)


@query(f"{FUSED_SQL} SELECT query_id, id, round(score, 9) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) <= 10")
def ret_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.ranked(fused(spark, sf_dir), 10, [F.desc(F.round("score", 12)), F.col("id")])
    return top.select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"{FUSED_SQL} SELECT query_id, id, source FROM fused")
def ret_rrf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "id", "source")


@query(f"""{FUSED_SQL} SELECT query_id, f.id, round(score * CASE WHEN d.source = 'src3' THEN 1.5 ELSE 1 END, 9) AS score FROM fused f JOIN documents d ON d.doc_id = f.id""")
def ret_rrf_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("of"))
    boost = F.when(F.col("of") == "src3", 1.5).otherwise(1.0)
    return fused(spark, sf_dir).join(docs, "id").select("query_id", "id", F.round(F.col("score") * boost, 9).alias("score"))


@query(f"""{FUSED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS old FROM fused),
    c AS (SELECT o.*, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS cosine FROM o LEFT JOIN embeddings v ON v.vec_id = o.id
        LEFT JOIN embeddings q ON q.vec_id = o.query_id WHERE old <= 30),
    s AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS scaled
        FROM c WINDOW w AS (PARTITION BY query_id)),
    b AS (SELECT query_id, id, old, round(CASE WHEN cosine IS NULL THEN scaled ELSE 0.6 * scaled + 0.4 * greatest(0.0, cosine) END, 9) AS blended FROM s)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, old) AS place FROM b UNION ALL SELECT query_id, id, old FROM o WHERE old > 30""")
def ret_rerank_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty fused hits in the order of their score blended with the cosine of their vectors; all others follow as they were."""
    hits = search.ranked(fused(spark, sf_dir), 1 << 30, [F.desc(F.round("score", 12)), F.col("id")])
    vec = read_table(spark, sf_dir, "embeddings")
    hits = hits.join(vec.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id", "left")
    hits = hits.join(vec.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    cosine = F.when(F.col("v").isNotNull() & F.col("q").isNotNull(), vectors.cosine(F.col("v"), F.col("q")))
    return search.rescored(hits.withColumn("cosine", cosine), window=30).select("query_id", "id", "place")


@query()
def ret_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits without those that nearly repeat a better one, by words or by vectors; those of one source (`src0`, as it were code) stay."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("source") == "src0").alias("exempt"))
    vec = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = search.ranked(fused(spark, sf_dir), 30, [F.desc(F.round("score", 12)), F.col("id")])
    hits = top.join(docs, "id").join(vec, "id", "left")
    return search.collapse(hits.select("query_id", "id", "rank", text.shingles(F.col("text")).alias("shingles"), "vector", "exempt"))


@query(sql(f"""WITH {SEEN_SQL}, {PROBES_SQL}, {FTS_SQL}, {VISIBLE_FTS} SELECT query_id, id, 'valid from ' || valid_from || CASE WHEN valid_to IS NULL THEN '' ELSE ' until ' || valid_to END AS fact
    FROM fts_top JOIN (SELECT sequence AS id, valid_from, valid_to FROM seen) USING (id)""", "memories"))
def ret_temporal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected validity of each hit, as a fact in words."""
    rows_ = seen(spark, sf_dir).select(F.col("sequence").alias("id"), "valid_from", "valid_to")
    until = F.coalesce(F.concat(F.lit(" until "), F.col("valid_to").cast("string")), F.lit(""))
    fact = F.concat(F.lit("valid from "), F.col("valid_from").cast("string"), until)
    return visible_fts(spark, sf_dir).select("query_id", "id").join(rows_, "id").select("query_id", "id", fact.alias("fact"))


@query(sql("SELECT id FROM memories WHERE session_id <> 'src0'", "memories"))
def ret_exclude_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where("session_id <> 'src0'").select("id")


@query(sql("""WITH h AS (SELECT * FROM memories WHERE contains(lower(content), 'th') AND session_id <> 'src9'),
    p AS (SELECT id, created_on FROM h WHERE type = 'fact' ORDER BY created_on DESC, id DESC LIMIT 21)
    SELECT 'row' AS kind, id AS name, CAST(1 AS BIGINT) AS n FROM p UNION ALL SELECT 'type', type, count(*) FROM h GROUP BY type
    UNION ALL SELECT 'tool', topic_key, count(*) FROM h WHERE starts_with(topic_key, 'fr.') GROUP BY topic_key""", "memories"))
def ret_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of hits of one type, the counts of all types under the other filters, and calls (here keys under `fr.`) grouped by key."""
    hits = memories(spark, sf_dir).where(rows.contains_ignoring_case(F.col("content"), "TH") & (F.col("session_id") != "src9"))
    page = rows.keyset_page(rows.where_given(hits, type="fact", profile_id=""), "created_on", "id", 20)
    kinds = hits.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    calls = hits.where(F.col("topic_key").startswith("fr.")).groupBy("topic_key").agg(F.count("*").alias("n"))
    listed = page.select(F.lit("row").alias("kind"), F.col("id").alias("name"), F.lit(1).cast("long").alias("n"))
    return listed.unionByName(kinds).unionByName(calls.select(F.lit("tool").alias("kind"), F.col("topic_key").alias("name"), "n"))


@query(sql("SELECT id, created_on FROM memories WHERE session_id = 'src1' AND NOT forgotten", "memories"))
def ret_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where("session_id = 'src1' AND NOT forgotten").orderBy(F.desc("created_on"), "id").select("id", "created_on")


@query(sql("""SELECT topic_key, max(created_on) AS latest FROM memories WHERE topic_key IS NOT NULL GROUP BY 1 ORDER BY starts_with(topic_key, 'fr') DESC, topic_key LIMIT 40""", "memories"))
def ret_topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = memories(spark, sf_dir).where("topic_key IS NOT NULL").groupBy("topic_key").agg(F.max("created_on").alias("latest"))
    return keys.orderBy(F.desc(F.col("topic_key").startswith("fr")), "topic_key").limit(40)


# Temporal


SEGMENTS_SQL = """p AS (SELECT *, CASE WHEN u THEN NULL ELSE stated_on END AS stated, CASE WHEN u THEN transaction_id END AS trans FROM (
        SELECT *, bool_or(stated_on IS NULL) OVER (PARTITION BY fact_group, start) AS u FROM assertions)),
    bounds AS (SELECT fact_group, start AS moment FROM assertions UNION SELECT fact_group, stop FROM assertions WHERE stop IS NOT NULL),
    spans AS (SELECT fact_group, moment, lead(moment) OVER (PARTITION BY fact_group ORDER BY moment) AS until FROM bounds),
    held AS (SELECT s.fact_group, moment, until, revision_id FROM spans s JOIN p ON p.fact_group = s.fact_group AND start <= moment AND (stop IS NULL OR moment < stop)
        QUALIFY row_number() OVER (PARTITION BY s.fact_group, moment ORDER BY start DESC, stated DESC NULLS LAST, trans DESC NULLS LAST, source_order DESC, revision_id DESC) = 1),
    marked AS (SELECT *, CASE WHEN lag(revision_id) OVER w = revision_id AND lag(until) OVER w = moment THEN 0 ELSE 1 END AS new FROM held WINDOW w AS (PARTITION BY fact_group ORDER BY moment)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY fact_group ORDER BY moment) AS island FROM marked),
    segments AS (SELECT fact_group, revision_id, min(moment) AS valid_from, arg_max(coalesce(until, DATE '9999-12-31'), moment) AS valid_to FROM islands GROUP BY fact_group, island, revision_id)"""


@query(sql(f"WITH {SEGMENTS_SQL} SELECT * FROM segments", "assertions"))
def tmp_resolve_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.resolve_segments(assertions(spark, sf_dir))
    return found.withColumn("valid_to", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))


@query(sql("""SELECT id, CASE WHEN type IN ('fact', 'instruction') AND topic_key IS NOT NULL THEN type || ':' || topic_key ELSE 'assertion:' || id END AS fact_group
    FROM memories""", "memories"))
def tmp_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = F.col("type").isin("fact", "instruction") & F.col("topic_key").isNotNull()
    group = F.when(keyed, F.concat("type", F.lit(":"), "topic_key")).otherwise(F.concat(F.lit("assertion:"), "id"))
    return memories(spark, sf_dir).select("id", group.alias("fact_group"))


@query(sql("""SELECT fact_group, arg_max(revision_id, (start, transaction_id)) AS revision_id FROM assertions WHERE start <= DATE '1996-06-30'
    AND (stop IS NULL OR DATE '1996-06-30' < stop) GROUP BY 1""", "assertions"))
def tmp_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds on one day, as of which later starts win."""
    day = F.lit("1996-06-30").cast("date")
    valid = assertions(spark, sf_dir).where((F.col("start") <= day) & (F.col("stop").isNull() | (day < F.col("stop"))))
    return valid.groupBy("fact_group").agg(F.max_by("revision_id", F.struct("start", "transaction_id")).alias("revision_id"))


@query(sql("SELECT fact_group, revision_id, row_number() OVER (PARTITION BY fact_group ORDER BY transaction_id) AS place FROM assertions", "assertions"))
def tmp_history(spark: SparkSession, sf_dir: str) -> DataFrame:


    place = F.row_number().over(Window.partitionBy("fact_group").orderBy("transaction_id"))
    return assertions(spark, sf_dir).select("fact_group", "revision_id", place.alias("place"))


@query(sql("""WITH m AS (SELECT *, type || ':' || topic_key AS key, DATE '2024-01-01' + CAST(sequence % 365 AS INT) AS stated FROM memories WHERE topic_key IS NOT NULL AND NOT forgotten),
    b AS (SELECT id, stated, arg_max(id, (stated, sequence)) OVER w AS active, max(stated) OVER w AS latest FROM m WINDOW w AS (PARTITION BY key ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT id, CASE WHEN latest IS NULL OR stated >= latest THEN active END AS supersedes, coalesce(stated < latest, false) AS stale FROM b""", "memories"))
def tmp_supersede_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each memory supersedes on arrival; one that was stated before what is current supersedes nothing and is history at once."""
    kept = memories(spark, sf_dir).where("topic_key IS NOT NULL AND NOT forgotten")
    keyed = kept.select("id", "sequence", F.concat("type", F.lit(":"), "topic_key").alias("key"), dates.payload_time(F.col("payload"), "stated_at").alias("stated"))
    return temporal.supersedes(keyed, "key", "stated", "sequence").select("id", "supersedes", "stale")


@query(sql("""SELECT min(b) AS next_boundary FROM (SELECT start AS b FROM assertions UNION ALL SELECT stop FROM assertions) WHERE b > DATE '1996-01-01'""", "assertions"))
def tmp_next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = assertions(spark, sf_dir).select(F.explode(F.array("start", "stop")).alias("b")).where(F.col("b") > F.lit("1996-01-01").cast("date"))
    return bounds.agg(F.min("b").alias("next_boundary"))


@query(sql("""WITH b AS (SELECT fact_group % 100 AS cluster, start AS b FROM assertions UNION ALL SELECT fact_group % 100, stop FROM assertions)
    SELECT cluster, min(b) AS boundary FROM b WHERE b > DATE '1996-01-01' GROUP BY 1 HAVING min(b) <= DATE '1996-01-04'""", "assertions"))
def tmp_boundaries_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters (of fact groups) whose next boundary after the last look has come, so that they are to be looked at again."""
    day = F.lit("1996-01-01").cast("date")
    bounds = assertions(spark, sf_dir).select((F.col("fact_group") % 100).alias("cluster"), F.explode(F.array("start", "stop")).alias("b"))
    following = bounds.where(F.col("b") > day).groupBy("cluster").agg(F.min("b").alias("boundary"))
    return following.where(F.col("boundary") <= F.lit("1996-01-04").cast("date"))


# Graph


def _seed(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "entity string")


HOP = """SELECT other FROM (SELECT source AS e, target AS other, sequence, source, relation, target, 'out' AS d FROM edges
    UNION ALL SELECT target, source, sequence, source, relation, target, 'in' FROM edges) WHERE e IN (SELECT entity FROM {front})
    ORDER BY sequence DESC, source, relation, target, d LIMIT 20"""
WALK = f"""h0 AS MATERIALIZED (SELECT 'c5' AS entity), h1 AS MATERIALIZED (SELECT DISTINCT other AS entity FROM ({HOP.format(front="h0")}) WHERE other NOT IN (SELECT entity FROM h0)),
    h2 AS MATERIALIZED (SELECT DISTINCT other AS entity FROM ({HOP.format(front="h1")}) WHERE other NOT IN (SELECT entity FROM h0 UNION SELECT entity FROM h1)),
    walk AS MATERIALIZED (SELECT entity, 0 AS hop FROM h0 UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2)"""


@query(sql(f"WITH {WALK} SELECT entity FROM walk", "edges"))
def gr_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(edges(spark, sf_dir), _seed(spark, "c5"), 2, 20).select("entity")


@query(sql(f"""WITH {WALK.replace("FROM edges", "FROM edges_")} SELECT entity, hop FROM walk""".replace("WITH ", "WITH edges_ AS (SELECT * FROM edges WHERE left(source, 1) IN ('o', 'c') AND left(target, 1) IN ('o', 'c')), ", 1), "edges"))
def gr_neighborhood_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With each entity's hop, over entities of two types only."""
    kinds = F.left("entity", F.lit(1)).isin("o", "c") & F.left("other", F.lit(1)).isin("o", "c")
    return graph.neighborhood(edges(spark, sf_dir), _seed(spark, "c5"), 2, 20, kinds)


DEGREES = "degrees AS (SELECT e AS entity, count(*) AS degree FROM (SELECT source AS e FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)"


def degrees(spark: SparkSession, sf_dir: str, few: DataFrame | None = None) -> DataFrame:
    """entity, degree; only of `few` (entity; they are broadcast) where given, so that no other end of an edge is counted."""
    ends = rows.endpoints(edges(spark, sf_dir))
    ends = ends if few is None else ends.join(F.broadcast(few.select("entity")), "entity", "left_semi")
    return ends.groupBy("entity").agg(F.count("*").alias("degree"))


@query(sql(f"""WITH {WALK}, {DEGREES}, r AS (SELECT entity, hop, degree FROM walk JOIN degrees USING (entity) ORDER BY hop, degree DESC, entity LIMIT 13)
    SELECT *, (SELECT count(*) FROM r) > 12 AS truncated FROM r ORDER BY hop, degree DESC, entity LIMIT 12""", "edges"))
def gr_explorer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed, then what is nearest, of equals the highest degree; twelve, and whether there are more."""
    walk = graph.neighborhood(edges(spark, sf_dir), _seed(spark, "c5"), 2, 20)
    return rows.capped(walk.join(degrees(spark, sf_dir, few=walk), "entity"), [F.col("hop"), F.desc("degree"), F.col("entity")], 12)


@query(sql(f"WITH {WALK} SELECT source, relation, target FROM edges WHERE source IN (SELECT entity FROM walk) AND target IN (SELECT entity FROM walk)", "edges"))
def gr_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.neighborhood(edges(spark, sf_dir), _seed(spark, "c5"), 2, 20)
    return graph.induced(edges(spark, sf_dir), nodes).select("source", "relation", "target")


@query(sql("""SELECT source AS entity, 'out' AS direction, relation, target AS other FROM edges WHERE source = 'c7'
    UNION ALL SELECT target, 'in', relation, source FROM edges WHERE target = 'c7'""", "edges"))
def gr_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident(edges(spark, sf_dir)).where("entity = 'c7'").select("entity", "direction", "relation", "other")


@query("""SELECT p_partkey, trim(lower(p_name)) AS name FROM part WHERE trim(lower(p_name)) IN ('part 7', 'part#7', 'part 11') ORDER BY name, p_partkey LIMIT 10""")
def gr_find_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.normalize_entity(F.col("p_name"))
    return read_table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(F.col("name").isin("part 7", "part#7", "part 11")).orderBy("name", "p_partkey").limit(10)


@query(sql("SELECT DISTINCT substr(sha256(concat(left(e, 1), lower(e))), 1, 32) AS id FROM (SELECT source AS e FROM edges UNION SELECT target FROM edges)", "edges"))
def gr_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by content id: those at the heads of edges are stored, those at the tails added where they are new."""
    def named(column: str) -> DataFrame:
        e = F.col(column)
        return edges(spark, sf_dir).select(text.hash128(F.left(e, F.lit(1)), text.normalize_entity(e)).alias("id")).distinct()

    return rows.insert_ignore(named("source"), named("target"), "id")


@query(sql("SELECT DISTINCT memory_id, e AS entity FROM (SELECT memory_id, source AS e FROM edges UNION ALL SELECT memory_id, target FROM edges) WHERE memory_id IN ('o1', 'o2', 'o3')", "edges"))
def gr_entities_for_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.endpoints(edges(spark, sf_dir).where(F.col("memory_id").isin("o1", "o2", "o3")), "memory_id").distinct()


@query(sql(f"""WITH {DEGREES}, short AS (SELECT entity FROM degrees WHERE contains(lower(entity), '12') ORDER BY length(entity), entity LIMIT 50)
    SELECT entity, degree FROM short JOIN degrees USING (entity) ORDER BY degree DESC, entity LIMIT 10""", "edges"))
def gr_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest names first make a short list; only then does degree order it."""
    hits = degrees(spark, sf_dir).where(rows.contains_ignoring_case(F.col("entity"), "12")).orderBy(F.length("entity"), "entity").limit(50)
    return hits.orderBy(F.desc("degree"), "entity").limit(10).select("entity", "degree")


@query(sql(f"""WITH {SEEN_SQL} SELECT id FROM seen WHERE type <> 'task' AND sequence % 13 <> 0 AND sequence NOT IN (SELECT sequence FROM edges WHERE relation = 'placed by' AND sequence % 4 < 2)""", "memories", "edges"))
def gr_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible memories, but for tasks and those that were taken up before (here every thirteenth), of which no edge tells."""
    told = edges(spark, sf_dir).where("relation = 'placed by' AND sequence % 4 < 2").select(F.col("sequence").alias("memory_id"))
    open_ = seen(spark, sf_dir).where("type <> 'task' AND sequence % 13 <> 0").select(F.col("sequence").alias("id"), F.col("id").alias("name"))
    return ingest.orphans(open_, told).select(F.col("name").alias("id"))


@query(sql("""WITH s AS (SELECT DISTINCT left(source, 1) || right(source, 1) AS cluster, target AS entity FROM edges WHERE relation = 'placed by'),
    k AS (SELECT entity FROM s GROUP BY 1 HAVING count(*) <= greatest(2, (SELECT count(DISTINCT cluster) FROM s) // 2))
    SELECT a.cluster AS first, b.cluster AS second, count(*) AS shared, array_to_string(list_slice(list(a.entity ORDER BY a.entity), 1, 3), ',') AS examples
    FROM s a JOIN s b ON a.entity = b.entity AND a.cluster < b.cluster WHERE a.entity IN (SELECT entity FROM k) GROUP BY ALL HAVING count(*) >= 2""", "edges"))
def gr_cluster_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that share entities; entities of over half of the clusters (of two at least) tell nothing, which bounds the pairs."""
    cluster = F.concat(F.left("source", F.lit(1)), F.right("source", F.lit(1)))
    s = edges(spark, sf_dir).where("relation = 'placed by'").select(cluster.alias("cluster"), F.col("target").alias("entity")).distinct()
    most = F.greatest(F.lit(2), F.floor(F.count_distinct("cluster") / 2)).alias("most")
    counted = s.groupBy("entity").agg(F.count("*").alias("n")).join(F.broadcast(s.agg(most)))
    telling = s.join(counted.where("n <= most").select("entity"), "entity")
    pairs = telling.select("entity", F.col("cluster").alias("first")).join(telling.select("entity", F.col("cluster").alias("second")), "entity").where("first < second")
    shared = pairs.groupBy("first", "second").agg(F.count("*").alias("shared"), F.array_sort(F.collect_set("entity")).alias("x")).where("shared >= 2")
    return shared.select("first", "second", "shared", F.array_join(F.slice("x", 1, 3), ",").alias("examples"))


@query(sql("""WITH d1 AS (SELECT DISTINCT source AS root, target AS entity FROM edges WHERE source LIKE 'o%'),
    d2 AS (SELECT DISTINCT root, target AS entity FROM d1 JOIN edges ON edges.source = d1.entity)
    SELECT root, entity, min(level) AS level FROM (SELECT DISTINCT source AS root, source AS entity, 0 AS level FROM edges WHERE source LIKE 'o%'
        UNION ALL SELECT root, entity, 1 FROM d1 UNION ALL SELECT root, entity, 2 FROM d2) GROUP BY ALL""", "edges"))
def gr_dag_descend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    roots = e.where("source LIKE 'o%'").select(F.col("source").alias("entity")).distinct()
    return graph.descend(e, roots, 4)


@query(sql("""WITH down AS (SELECT DISTINCT target AS parent, source AS child FROM edges WHERE relation <> 'contains' UNION SELECT source, target FROM edges WHERE relation = 'contains'),
    c1 AS (SELECT DISTINCT parent AS cluster, child AS entity FROM down WHERE parent LIKE 'n%'), c2 AS (SELECT DISTINCT cluster, child AS entity FROM c1 JOIN down ON parent = entity),
    c3 AS (SELECT DISTINCT cluster, child AS entity FROM c2 JOIN down ON parent = entity)
    SELECT cluster, left(entity, 1) AS kind, count(DISTINCT entity) AS n FROM (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3) GROUP BY ALL""", "edges"))
def gr_cluster_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is under each nation, down to the parts of its customers' orders, by kind."""
    e = edges(spark, sf_dir)
    inner = e.where("relation <> 'contains'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    down = inner.unionByName(e.where("relation = 'contains'").select("source", "target"))
    roots = inner.where("source LIKE 'n%'").select(F.col("source").alias("entity")).distinct()
    under = graph.descend(down, roots, 4).where("level > 0")
    return under.groupBy(F.col("root").alias("cluster"), F.left("entity", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


@query(sql("""WITH h AS (SELECT source, target FROM edges WHERE source = 'o9') SELECT e.source, e.relation, e.target, CASE WHEN e.relation = 'placed by' THEN 0 ELSE 1 END AS strength
    FROM edges e WHERE e.source IN (SELECT target FROM h UNION SELECT source FROM h) OR e.target IN (SELECT source FROM h)""", "edges"))
def gr_code_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch an order or what it points to, the resolved ones first."""
    e = edges(spark, sf_dir)
    mine = rows.endpoints(e.where("source = 'o9'")).distinct()
    out = e.join(mine.withColumnRenamed("entity", "source"), "source", "left_semi")
    into = e.join(F.broadcast(_seed(spark, "o9").withColumnRenamed("entity", "target")), "target", "left_semi")
    strength = F.when(F.col("relation") == "placed by", 0).otherwise(1)
    found = out.select(e.columns).unionByName(into.select(e.columns)).distinct()
    return found.select("source", "relation", "target", strength.alias("strength")).orderBy("strength", "source", "target")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, p_brand AS name, l_suppkey % 50 + 1 AS file FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)
    SELECT l_orderkey, coalesce((SELECT min(p_partkey) FROM part WHERE p_brand = name AND p_size = file AND p_partkey % 3 = 0),
        (SELECT min(p_partkey) FROM part WHERE p_brand = name AND p_partkey % 3 = 0)) AS resolved FROM r""")
def gr_code_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol (every third part) that a reference means by a qualified name (a brand): in its own file (a size), else the first anywhere."""
    part = read_table(spark, sf_dir, "part")
    symbols = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("file"))
    items = read_table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name")), "l_partkey")
    references = items.select("l_orderkey", "name", (F.col("l_suppkey") % 50 + 1).alias("file"))
    return graph.resolve(references, symbols).select("l_orderkey", F.col("symbol").alias("resolved"))
