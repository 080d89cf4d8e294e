"""Queries that apply the text, date and vector functions to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import dates, text, vectors
from lorekeep.operators.rows import settled
from lorekeep.plans.derived import memories, messages, sql, traces
from lorekeep.plans.registry import query
from lorekeep.sources.tables import read_table

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _digest(array: Column) -> Column:
    return F.md5(F.array_join(array, " "))


@query("""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS t FROM documents)""")
def str_tokenize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), _digest(t).alias("tokens_md5"))


SHINGLES = """SELECT doc_id, lang, text, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1),
        lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE list_distinct(t) END AS s FROM (
    SELECT doc_id, lang, text, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS t FROM documents)"""


@query(f"""SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS shingles_md5 FROM ({SHINGLES})""")
def str_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.shingles(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").cast("long").alias("n_shingles"), F.md5(F.array_join(F.sort_array("s"), "|")).alias("shingles_md5")
    )


@query(f"""WITH s AS ({SHINGLES}), firsts AS (SELECT lang, arg_min(s, doc_id) AS f FROM s GROUP BY lang)
    SELECT doc_id, round(CASE WHEN len(s) = 0 OR len(f) = 0 THEN 0.0 ELSE len(list_intersect(s, f)) /
        len(list_distinct(list_concat(s, f))) END, 9) AS likeness FROM s JOIN firsts USING (lang)""")
def str_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the first of its language. Only numbers are shuffled for it, and languages that are common are broadcast, so texts stay where they are."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    return against_first(docs).select("doc_id", F.round("likeness", 9).alias("likeness"))


#: Documents of a language from which on its first one is broadcast: one in so many, so fewer languages than that.
COMMON = 1000


def against_first(docs: DataFrame) -> DataFrame:
    """doc_id, likeness of each text (doc_id, lang, text) to that of the smallest doc_id of its language, by shingles; documents without a language have none."""
    counted = docs.where("lang IS NOT NULL").groupBy("lang").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    whole = docs.agg(F.count("*").alias("whole"))
    known = settled(counted.join(F.broadcast(whole)).select("lang", "doc_id", (F.col("n") * COMMON > F.col("whole")).alias("common")))

    def firsts(of: DataFrame) -> DataFrame:
        return of.groupBy("lang").agg(F.first(text.shingles(F.col("text"))).alias("f"))

    cut = docs.select("doc_id", "lang", text.shingles(F.col("text")).alias("s"))
    likeness = text.jaccard(F.col("s"), F.col("f")).alias("likeness")
    common = F.broadcast(known.where("common").select("lang", "doc_id"))  # fewer than COMMON languages
    near = cut.join(F.broadcast(firsts(docs.join(common, ["lang", "doc_id"], "left_semi"))), "lang").select("doc_id", likeness)
    rare = settled(known.where("NOT common").select("lang", "doc_id"))
    if rare.isEmpty():
        return near
    far = cut.join(common.select("lang"), "lang", "left_anti")
    return near.unionByName(far.join(firsts(docs.join(rare, ["lang", "doc_id"], "left_semi")), "lang").select("doc_id", likeness))


TERMS = f"""SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'),
        lambda x: length(x) >= 2 AND x NOT IN ({STOP})) AS t FROM benchmark"""
UNIQUE = "list_filter(t, lambda x, i: list_position(t, x) = i)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", text.query_terms(F.col("text")).alias("t"))


@query(f"SELECT item_id, array_to_string({UNIQUE}, ' ') AS terms FROM ({TERMS})")
def str_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select("item_id", F.array_join("t", " ").alias("terms"))


@query(f"""SELECT item_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') AS keys FROM (
    SELECT item_id, CASE WHEN len(u) = 0 THEN [] ELSE list_concat([array_to_string(u, '.'), u[1]],
        list_transform(range(1, len(u)), lambda i: u[i] || '.' || u[i + 1])) END AS k
    FROM (SELECT item_id, {UNIQUE} AS u FROM ({TERMS})))""")
def str_topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = text.topic_keys(F.col("t"))
    return _probes(spark, sf_dir).select("item_id", F.array_join(keys, " ").alias("keys"))


@query(f"""SELECT item_id, array_to_string(list_transform(u, lambda x: '"' || x || '"'), ' OR ') AS expression
    FROM (SELECT item_id, {UNIQUE} AS u FROM ({TERMS}))""")
def str_fts_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.transform("t", lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return _probes(spark, sf_dir).select("item_id", F.array_join(quoted, " OR ").alias("expression"))


@query("""SELECT doc_id FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}_-]+') AS t FROM documents)
    WHERE len(list_filter(t, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'ing'))) > 0""")
def str_fts_prefix_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(text.matches_all_prefixes(F.col("text"), "th ing")).select("doc_id")


@query("""SELECT doc_id, array_to_string(list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 20), ' ') AS terms FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS t FROM documents)""")
def str_fts_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.distinct_terms(F.col("text"), 1, 20), " ").alias("terms"))


@query("""SELECT doc_id, array_to_string(list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 10), ' ') AS terms,
    len(list_distinct(list_filter(t, lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'what', 'how', 'are', 'was', 'this', 'that', 'does', 'can')))) AS covering FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 2) AS t FROM documents)""")
def str_claim_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms by which claims are searched, and how many there are by which coverage is told."""
    terms = F.array_join(text.distinct_terms(F.col("text"), 2, 10), " ")
    return _docs(spark, sf_dir).select("doc_id", terms.alias("terms"), F.size(text.claim_terms(F.col("text"))).cast("long").alias("covering"))


@query("""SELECT event_id, regexp_extract_all(props, '[A-Za-z0-9_]+')[1] AS first_token,
    array_to_string(list_transform(regexp_extract_all(props, '[A-Za-z0-9_]+'), lambda x: '"' || x || '"'), ' OR ') AS expression FROM events""")
def str_fts_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("props", F.lit("[A-Za-z0-9_]+"), 0)
    quoted = F.transform(found, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.get(found, 0).alias("first_token"), F.array_join(quoted, " OR ").alias("expression")
    )


NAMES = """(SELECT p_partkey, p_name, trim(lower(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS n FROM part)"""


@query(f"""SELECT p_partkey, CASE n WHEN 'postgres' THEN 'postgresql' WHEN 'pg' THEN 'postgresql' WHEN 'js' THEN 'javascript'
    WHEN 'ts' THEN 'typescript' ELSE n END AS entity FROM {NAMES}""")
def str_normalize_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", text.normalize_entity(F.col("p_name")).alias("entity"))


@query("""SELECT event_id, CASE e WHEN 'run' THEN 'runs' WHEN 'use' THEN 'uses' ELSE e END AS relation
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'run' WHEN 'view' THEN 'use' ELSE trim(lower(event_type)) END AS e FROM events)""")
def str_normalize_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = F.when(F.col("event_type") == "click", " Run ").when(F.col("event_type") == "view", "USE").otherwise(F.col("event_type"))
    return read_table(spark, sf_dir, "events").select("event_id", text.normalize_relation(verb).alias("relation"))


@query("""SELECT p_partkey, coalesce(nullif(trim(lower(CASE WHEN p_size > 25 THEN p_type ELSE ' ' END)), ''), 'concept') AS type FROM part""")
def str_normalize_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ")
    return read_table(spark, sf_dir, "part").select("p_partkey", text.normalize_type(kind).alias("type"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', '-', 'g'), '-') AS slug FROM part""")
def str_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN b = '' THEN s WHEN s = 'bash' THEN b ELSE s || '-' || b END AS signature FROM (
    SELECT doc_id, s, array_to_string(list_slice(list_filter(list_transform(list_filter(
        string_split_regex(trim(lower(text), chr(32) || chr(10) || chr(9) || chr(13)), '\\s+'),
        lambda x: x <> '' AND NOT starts_with(x, '-') AND NOT regexp_full_match(x, '\\d+')),
        lambda x: trim(regexp_replace(regexp_replace(x, '^\\./', ''), '[^a-z0-9_]+', '-', 'g'), '-')), lambda x: x <> ''), 1, 4), '-') AS b
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'bash' ELSE source END AS s FROM documents))""")
def str_command_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations are whole documents, run by the shell or by a tool of the source's name."""
    tool = F.when(F.col("doc_id") % 2 == 0, "bash").otherwise(F.col("source"))
    return _docs(spark, sf_dir).select("doc_id", text.command_signature(tool, F.col("text")).alias("signature"))


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'none' ELSE substr(sha256(lower(trim(regexp_replace(regexp_replace(
        right(trim(text), 512), ':\\d+(?::\\d+)?\\b', ':#', 'g'), '\\s+', ' ', 'g')))), 1, 32) END AS digest FROM documents""")
def str_error_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.error_digest(F.col("text")).alias("digest"))


@query()
def str_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked, hits = text.redact(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", hits.cast("long").alias("hits"), F.md5(masked).alias("masked_md5"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 160) || chr(10) || '…[' || (length(text) - 400)
    || ' chars elided]…' || chr(10) || right(text, 240) END AS shortened FROM documents""")
def str_truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_head_tail(F.col("text"), 400).alias("shortened"))


@query("SELECT page_id, replace(replace(url, 'https://', './'), 'https:/', '.') AS path FROM pages")
def str_normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text.normalize_paths(F.col("url"), "https:/", "/home/none")
    return read_table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query()
def str_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.scrub(F.col("text"), 4000, "/srv/repo", "/home/user")
    return _docs(spark, sf_dir).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("text_md5"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def str_tokens_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN (i + doc_id) % 5 = 0 THEN '## ' || s WHEN (i + doc_id) % 7 = 0 THEN '### ' || s ELSE s END AS line, i FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    p AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,2}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
    s AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY i) AS section FROM p GROUP BY ALL)
    SELECT doc_id, count(*) AS sections, CAST(sum(length(rtrim(section, chr(10)))) AS BIGINT) AS chars FROM s WHERE trim(section, chr(10) || ' ') <> '' GROUP BY 1""")
def str_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every fifth line made a heading (and some of a lower level, which do not count), in sections."""
    n = F.col("doc_id")
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.when((i + 1 + n) % 5 == 0, F.concat(F.lit("## "), s)).when((i + 1 + n) % 7 == 0, F.concat(F.lit("### "), s)).otherwise(s),
    )
    found = F.filter(text.sections(F.array_join(lines, "\n")), lambda s: F.btrim(s, F.lit("\n ")) != "")
    chars = F.aggregate(found, F.lit(0), lambda t, s: t + F.length(F.rtrim(s, F.lit("\n"))))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("sections"), chars.cast("long").alias("chars")).where("sections > 0")


@query("""WITH s AS (SELECT c.conv_id, c.turn, lower(c.text) AS said, lower(p.text) AS given FROM conversations c
        JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
    t AS (SELECT *, regexp_extract_all(said, '[a-z0-9./_-]+') AS own, regexp_extract_all(given, '[a-z0-9./_-]+') AS known FROM s),
    w AS (SELECT *, list_filter(own, lambda x: NOT regexp_matches(x, '[0-9/]') AND length(x) >= 4) AS plain,
        list_filter(own, lambda x: regexp_matches(x, '[0-9/]')) AS critical FROM t)
    SELECT conv_id, turn, len(list_filter(critical, lambda x: NOT contains(given, x))) = 0 AND len(plain) > 0
        AND len(list_filter(plain, lambda x: list_contains(known, x))) >= len(plain) * 0.6 AS grounded FROM w""")
def str_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn only says what the turn before it gave."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("given"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.grounded(F.col("text"), F.col("given")).alias("grounded")
    )


@query("SELECT doc_id, md5(concat_ws(' ', source, lang, text)) AS text_md5 FROM documents")
def str_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.embed_text(F.array("source", "lang"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(made).alias("text_md5"))


@query("""SELECT substr(sha256(lower(trim(text)) || ':' || source), 1, 32) AS merge_key, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def str_merge_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.hash128(F.lower(F.trim("text")), F.lit(":"), F.col("source"))
    return _docs(spark, sf_dir).groupBy(key.alias("merge_key")).agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT conv_id, string_agg('[' || (turn - low) || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM (
    SELECT *, min(turn) OVER (PARTITION BY conv_id) AS low FROM conversations) GROUP BY conv_id""")
def str_render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    line = F.transform(
        "x",
        lambda x: F.concat(
            F.lit("["), (x["turn"] - F.col("x")[0]["turn"]).cast("string"), F.lit("] "), x["role"], F.lit(": "), x["text"]
        ),
    )
    return said.select("conv_id", F.array_join(line, "\n").alias("transcript"))


@query("""SELECT DISTINCT anchor, upper(n[1]) || n[2:] AS title FROM (SELECT anchor, trim(translate(regexp_replace(anchor,
    '^(topic|entity|code|group|split|directory):', ''), ':_-', '   ')) AS n FROM (SELECT 'topic:' || lang || '-' || source AS anchor FROM documents))""")
def str_wiki_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _docs(spark, sf_dir).select(F.concat(F.lit("topic:"), "lang", F.lit("-"), "source").alias("anchor")).distinct()
    return anchors.select("anchor", text.wiki_title(F.col("anchor")).alias("title"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' END AS language FROM documents""")
def str_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".java", ".JSX", ".py", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/a.b"), ending)
    return _docs(spark, sf_dir).select("doc_id", text.language_of(path).alias("language"))


@query("""WITH dirs AS (SELECT DISTINCT source AS marker FROM documents WHERE source < 'src5' UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE doc_id % 3 = 0),
    files AS (SELECT doc_id, source || '/' || lang || '/f' || doc_id || '.py' AS path FROM documents)
    SELECT doc_id, coalesce(max_by(marker, length(marker)), split_part(path, '/', 1)) AS module FROM files LEFT JOIN dirs ON starts_with(path, marker || '/') GROUP BY doc_id, path""")
def str_module_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest marked folder above each file, else its first folder: a file's own folders are listed and met by an equi-join."""
    docs = _docs(spark, sf_dir)
    inner = F.concat("source", F.lit("/"), "lang")
    marked = docs.where("source < 'src5'").select(F.col("source").alias("marker")).union(docs.where("doc_id % 3 = 0").select(inner)).distinct()
    files = docs.select("doc_id", F.col("source").alias("first"), F.explode(F.array("source", inner)).alias("folder"))
    met = files.join(marked, files.folder == marked.marker, "left")
    return met.groupBy("doc_id", "first").agg(F.max_by("marker", F.coalesce(F.length("marker"), F.lit(-1))).alias("m")).select("doc_id", F.coalesce("m", "first").alias("module"))


# Dates


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(d - 1, '%Y-%m-%d') || ' ' || strftime(d, '%Y-%m-%d') || ' the week of '
        || strftime(CAST(date_trunc('week', d) AS DATE) - 7, '%Y-%m-%d') || ', ' || strftime(d + INTERVAL 1 MONTH, '%B %Y')
    WHEN 1 THEN o_orderpriority || ' due the weekend of ' || strftime(CAST(date_trunc('week', d) AS DATE) + 12, '%Y-%m-%d') || ' or ' || strftime(d + 1, '%Y-%m-%d')
    ELSE 'todays ' || o_orderpriority || ' of ' || (year(d) - 1) END AS rewritten FROM (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def dt_rewrite_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of three forms with words of the rows; a longer word that begins like a date word is none."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"))
    n = F.col("o_orderkey") % 3
    said = (
        F.when(n == 0, "Yesterday today the last week, next MONTH")
        .when(n == 1, F.concat("o_orderpriority", F.lit(" due next weekend or tomorrow")))
        .otherwise(F.concat(F.lit("todays "), "o_orderpriority", F.lit(" of past year")))
    )
    return orders.select("o_orderkey", dates.rewrite_relative(said, F.col("d")).alias("rewritten"))


@query("""SELECT o_orderkey, 'the week of ' || strftime(CAST(date_trunc('week', d) AS DATE) + 7, '%Y-%m-%d') AS next_week,
        'the weekend of ' || strftime(CAST(date_trunc('week', d) AS DATE) - 2, '%Y-%m-%d') AS last_weekend,
        strftime(d - INTERVAL 1 MONTH, '%B %Y') AS last_month, CAST(year(d) + 1 AS VARCHAR) AS next_year
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def dt_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.period(1, "week", d).alias("next_week"),
        dates.period(-1, "weekend", d).alias("last_weekend"),
        dates.period(-1, "month", d).alias("last_month"),
        dates.period(1, "year", d).alias("next_year"),
    )


@query("""SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def dt_span_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = dates.span_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    return items.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", days.cast("long").alias("days"))


@query("""SELECT o_orderkey, CASE WHEN n = 0 THEN 'today' WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' day' ELSE ' days' END || ' ago'
    ELSE 'in ' || -n || CASE WHEN n = -1 THEN ' day' ELSE ' days' END END AS span
    FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') AS n FROM orders)""")
def dt_signed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = dates.signed_span(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", span.alias("span"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN d - CAST(o_orderkey % 9 + 1 AS INT)
        WHEN 1 THEN d - to_months(CAST(o_orderkey % 9 + 1 AS INT)) ELSE d + CAST(7 * (o_orderkey % 9 + 1) AS INT) END AS DATE) AS resolved
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def dt_n_ago_in_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 9 + 1).cast("string")
    said = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("it broke "), n, F.lit(" days ago")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("moved "), n, F.lit(" Months ago")))
        .otherwise(F.concat(F.lit("due in "), n, F.lit(" weeks")))
    )
    orders = read_table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", dates.ago_or_in(said, F.col("o_orderdate").cast("date")).alias("resolved"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) - 7 AS last_week, CAST(o_orderdate AS DATE) + 7 AS next_week FROM orders""")
def dt_last_next_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    moved = [dates.shifted(d, F.lit(n), F.lit("week")) for n in (-1, 1)]
    return read_table(spark, sf_dir, "orders").select("o_orderkey", moved[0].alias("last_week"), moved[1].alias("next_week"))


@query(sql("""WITH q(query_id, said) AS (VALUES (1, 'How many days since the launch?'), (2, 'What was said about it?'), (3, 'how long ago did it break'))
    SELECT query_id, id, date_diff('day', created_on, DATE '2025-06-01') AS days FROM q JOIN memories ON type = 'event' WHERE query_id IN (1, 3)""", "memories"))
def dt_event_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each event, for questions that ask how long ago something was."""
    asked = spark.createDataFrame([(1, "How many days since the launch?"), (2, "What was said about it?"), (3, "how long ago did it break")], "query_id int, said string")
    events = memories(spark, sf_dir).where("type = 'event'").select("id", dates.span_days(F.lit("2025-06-01").cast("date"), F.col("created_on")).alias("days"))
    return events.join(F.broadcast(asked.where(dates.asks_since(F.col("said"))).select("query_id"))).select("query_id", "id", F.col("days").cast("long").alias("days"))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(?:recently|soon)\\b') AS fuzzy FROM conversations""")
def dt_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.col("text").rlike(dates.FUZZY).alias("fuzzy"))


@query(sql("SELECT id, CAST(regexp_extract(payload, '\"stated_at\":\"([0-9-]+)\"', 1) AS DATE) AS stated_on FROM memories", "memories"))
def dt_payload_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", dates.payload_time(F.col("payload"), "stated_at").alias("stated_on"))


@query(sql("""SELECT id, CASE WHEN type = 'task' THEN created_on ELSE CAST(json_extract_string(payload, '$.stated_at') AS DATE) END AS known_on
    FROM memories""", "memories"))
def dt_knowledge_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.when(F.col("type") != "task", dates.payload_time(F.col("payload"), "stated_at"))
    return memories(spark, sf_dir).select("id", F.coalesce(stated, "created_on").alias("known_on"))


@query(sql("""SELECT id, CASE WHEN type = 'event' THEN valid_from ELSE CAST(json_extract_string(payload, '$.stated_at') AS DATE) END AS anchor
    FROM memories""", "memories"))
def dt_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurred = F.when(F.col("type") == "event", F.col("valid_from"))
    stated = dates.payload_time(F.col("payload"), "stated_at")
    return memories(spark, sf_dir).select("id", F.coalesce(occurred, stated).alias("anchor"))


# Vectors and numbers


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS cosine FROM embeddings, q""")
def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = rows.agg(F.min_by("embedding", "vec_id").alias("q"))
    return rows.join(F.broadcast(one)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("""SELECT source, doc_id, row_number() OVER w AS rank, min(n_chars) OVER (PARTITION BY source) AS least, max(n_chars) OVER (PARTITION BY source) AS most,
    CAST((n_chars + count(*) OVER (PARTITION BY source) - 1) // count(*) OVER (PARTITION BY source) AS BIGINT) AS share FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)""")
def mth_rank_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within a source, its bounds, and the share of tokens that falls to each of its rows, rounded up."""
    docs = _docs(spark, sf_dir).select("source", "doc_id", "n_chars")
    sums = docs.groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    share = F.ceil(F.col("n_chars") / F.col("n"))
    return docs.withColumn("rank", rank).join(sums, "source").select("source", "doc_id", "rank", "least", "most", share.alias("share"))


# JSON and arrays


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def js_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN '{' || props ELSE props END) AS valid FROM events")
def js_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return read_table(spark, sf_dir, "events").select("event_id", F.try_parse_json(props).isNotNull().alias("valid"))


@query("""SELECT event_id, unnest([event_id % 7, CAST(json_extract(props, '$.k') AS BIGINT)]) AS symbol FROM events WHERE event_id % 4 <> 0""")
def js_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unnests an array inside JSON; malformed JSON, every fourth here, has no elements."""
    made = F.concat(F.lit('{"symbolIds":['), (F.col("event_id") % 7).cast("string"), F.lit(","), F.get_json_object("props", "$.k"), F.lit("]}"))
    payload = F.when(F.col("event_id") % 4 == 0, F.lit('{"symbolIds":[')).otherwise(made)
    ids = F.from_json(F.get_json_object(payload, "$.symbolIds"), "array<long>")
    return read_table(spark, sf_dir, "events").select("event_id", F.explode(ids).alias("symbol"))


@query(sql("SELECT session_id, '[' || string_agg(DISTINCT '\"' || tool || '\"', ',' ORDER BY '\"' || tool || '\"') || ']' AS tools FROM traces GROUP BY 1", "traces"))
def js_group_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.to_json(F.array_sort(F.collect_set("tool")))
    return traces(spark, sf_dir).groupBy("session_id").agg(tools.alias("tools"))


@query(sql("""SELECT id, '2025-01-01' AS stated_at, json_extract_string(payload, '$.tool') AS tool FROM memories""", "memories"))
def js_with_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON object overwritten, the others kept."""
    fields = F.from_json("payload", "map<string,string>")
    others = F.map_filter(fields, lambda k, _: k != "stated_at")
    changed = F.to_json(F.map_concat(others, F.create_map(F.lit("stated_at"), F.lit("2025-01-01"))))
    return memories(spark, sf_dir).select("id", changed.alias("p")).select(
        "id", F.get_json_object("p", "$.stated_at").alias("stated_at"), F.get_json_object("p", "$.tool").alias("tool")
    )


@query(sql("""SELECT session_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ' ') AS roles FROM (
    SELECT session_id, list(role ORDER BY turn, role) AS r FROM messages GROUP BY 1)""", "messages"))
def arr_ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return said.select("session_id", F.array_join(F.array_distinct(F.transform("x", lambda x: x["role"])), " ").alias("roles"))


@query(sql("""SELECT id, list_position(['task', 'fact', 'event'], type) AS priority FROM memories WHERE type <> 'instruction'""", "memories"))
def arr_index_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*map(F.lit, ("task", "fact", "event")))
    place = F.array_position(order, F.col("type")).cast("int")
    return memories(spark, sf_dir).where("type <> 'instruction'").select("id", place.alias("priority"))
