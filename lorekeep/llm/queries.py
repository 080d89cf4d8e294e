"""The thin queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, chat, exact_dedup, fingerprints, mixing, prefix_trie, quality, repair, secret_scan, sharding, simhash, token_counts, toxicity
from lorekeep.llm.common import held_out, table, whole_text


#: Documents of this score or more are toxic.
TOXIC = 0.5
#: Texts of more tokens are over the limit.
TOKEN_LIMIT = 512


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tuple:
    """Trained on the labels outside the held-out fold."""
    return toxicity.fit(docs, labels, learn=~held_out(F.col("doc_id")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), name="score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(texts, path, pattern)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [p.kind for p in secret_scan.PARTS if p.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(secret_scan.spans_text(own), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(texts, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix_epoch", "mix_weight", "mix_block", "mix_order")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.with_next(table(spark, sf_dir, "documents"))
    changed = fingerprints.with_sketch(
        pairs.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_start"))), "edited", "edited_sketch"
    )
    own = F.col("sketch")
    return changed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.sketch_text(own).alias("fingerprint"),
        fingerprints.sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(own, F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(own, F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(own, F.col("edited_sketch")).alias("contained_in_edited"),
        fingerprints.distinct_shingles(own).alias("distinct_shingles"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return rendered.withColumn("mask", F.array_join(spans, ","))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
    return quality.select(docs, quality.fit(docs, good))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = prefix_trie.steps(table(spark, sf_dir, "conversations"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie.build(*prefix_trie.share_beginnings(steps, shared.cast("int"))).withColumnRenamed("saved", "saved_tokens")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage that a hash of conversation and turn decides; nulls are one space."""
    conversation, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conversation, F.lit(":"), turn).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    bare = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"copy": F.explode(copies), "text": bare})
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), "text")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(damaged(turns), turns.select("conv_id"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_repair": op13_repair,
}

#: CRC-32 of the digits of a number, as a macro-like fragment: {x} is the number. Bits go one by one, so it needs no table.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
            lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

ORACLES = {
    "op11_prefix_trie": f"""
        WITH told AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS step
            FROM conversations WHERE conv_id IS NOT NULL),
        plans AS (
            SELECT *, least(skip, (SELECT count(*) FROM told t WHERE t.conv_id = base)) AS taken
            FROM (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format(x="conv_id")} % 6 AS skip FROM told)),
        rebuilt AS (
            SELECT p.conv_id, t.step, role, text FROM plans p JOIN told t ON t.conv_id = p.base AND t.step <= p.taken
            UNION ALL
            SELECT p.conv_id, t.step - skip + taken, role, text FROM plans p JOIN told t ON t.conv_id = p.conv_id AND t.step > skip),
        reached AS (
            SELECT conv_id, step AS depth, length(text) AS size,
                   list(struct_pack(role, text)) OVER (PARTITION BY conv_id ORDER BY step) AS path,
                   step = max(step) OVER (PARTITION BY conv_id) AS last
            FROM rebuilt
            UNION ALL
            SELECT conv_id, 0, 0, [], conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM plans),
        nodes AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
            FROM reached GROUP BY path, depth),
        kids AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
        under AS (
            SELECT r.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens
            FROM counted u JOIN reached r ON r.conv_id = u.conv_id AND r.depth <= u.depth GROUP BY r.path)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM counted n JOIN under USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:-2]""",
    "op9_chat": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS who,
                   replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS body
            FROM conversations),
        sides AS (SELECT DISTINCT conv_id, who AS perspective FROM said WHERE who <> 'system'),
        seen AS (
            SELECT s.conv_id, perspective, CAST(0 AS BIGINT) AS part, turn, who, body, who = perspective AS own,
                   '<|im_start|>' || CASE WHEN who = 'system' THEN who WHEN who = perspective THEN 'assistant'
                       ELSE 'user name=' || who END || chr(10) AS head,
                   row_number() OVER (PARTITION BY s.conv_id, perspective, part ORDER BY turn NULLS FIRST, who, body) AS place
            FROM said s JOIN sides p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        placed AS (
            SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (
                       PARTITION BY conv_id, perspective, part ORDER BY place
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
            FROM seen)
        SELECT conv_id, perspective, part, count(*) AS n_turns,
               string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY place) AS text,
               coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) + 10 AS BIGINT), ',' ORDER BY place)
                   FILTER (own), '') AS mask
        FROM placed GROUP BY ALL""",
    "op2_exact_dedup": r"""
        WITH rows_ AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM rows_ WINDOW g AS (PARTITION BY text_sha256)""",
}
