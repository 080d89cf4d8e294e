"""What a step takes up does not grow faster than its input."""

from __future__ import annotations

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from lorekeep.functions import stem, text, vectors
from lorekeep.operators import dag, graph, pages, search, sets
from lorekeep.plans import derived, engine_queries


def test_split_compares_each_source_with_a_seed_once(spark, monkeypatch):
    """6,000 sources that no seed admits until there are sixteen: row by row this took over 40 s."""
    rows = spark.range(6_000, numPartitions=4).select((F.col("id") % 2).alias("page"), "id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda n: F.cos(n * F.col("id") * 0.7).cast("float")).alias("embedding"))
    begun = time.monotonic()
    found = pages.split(rows, 0.9, over=30)
    assert found.select("page", "seed").distinct().count() > 2
    assert time.monotonic() - begun < 40


def test_likenesses_are_those_of_cosine(spark):
    """Bit by bit, with null and zero vectors, null members and other widths."""
    held = [[0.1, 0.7, -0.3], [3.3, 1e-3, 7.7], [0.0, 0.0, 0.0], [1.0, 2.0], [], None, [1.0, None, 2.0], [1e-30, 1e-20, 1.0]]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(held)], "id int, v array<float>")
    seeds = rows.agg(F.collect_list(F.struct("id", "v")).alias("s")).select(F.transform(F.array_sort("s"), lambda x: x["v"]).alias("s"))
    met = rows.crossJoin(seeds).union(rows.limit(2).select("id", "v", F.array().cast("array<array<float>>").alias("s")))
    pairs = met.withColumn("found", pages._likenesses(F.col("v"), F.col("s")))
    wanted = F.transform("s", lambda w: vectors.cosine(F.col("v"), w))
    for r in pairs.select("found", wanted.alias("wanted")).collect():
        assert r.found == r.wanted


def test_pairs_in_groups_are_counted_in_chunks(spark, monkeypatch):
    """Groups of many sizes, rows twice, nulls, and chunks smaller than a group; against all pairs."""
    rng = random.Random(5)
    held = {g: {rng.randrange(40) * 10**12 for _ in range(rng.choice([1, 2, 7, 25]))} for g in range(60)}
    rows = spark.createDataFrame([(g, m) for g, s in held.items() for m in s] * 2 + [(None, 1), (None, 2), (1, None)], "g long, m long")
    expected = Counter((a, b) for s in held.values() for a in s for b in s if a < b)
    for chunk in (5, 300, 4_000_000):
        monkeypatch.setattr(sets, "PAIRS", chunk)
        found = sets.pairs_in_groups(rows, "g", "m").collect()
        assert {(r.first, r.second): r.shared for r in found} == expected and len(found) == len(expected)
    assert sets.pairs_in_groups(rows.limit(0), "g", "m").count() == 0


def test_more_pairs_are_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(sets, "PAIRS", 100)
    rows = spark.range(600).select((F.col("id") % 3).alias("g"), "id")
    found = sets.pairs_in_groups(rows, "g", "id")
    assert found.rdd.getNumPartitions() > 500 and found.count() == 3 * 200 * 199 // 2


def test_a_signature_looks_at_the_first_arguments_only(spark):
    """2,000 commands of 20,000 arguments, of which the first four are enough; and those where they are not."""
    rows = spark.range(2_000, numPartitions=4).select(F.repeat(F.lit("some argument "), 10_000).alias("args"))
    begun = time.monotonic()
    assert rows.where(text.command_signature(F.lit("bash"), F.col("args")) != "some-argument-some-argument").count() == 0
    assert time.monotonic() - begun < 30
    flags = "-a 12 ./ " * 20
    said = {flags + "one": "one", flags + "One  two\nthree four five": "one-two-three-four", flags: "", " \n".join("abcde"): "a-b-c-d", "a " * 3 + "7 " * 30 + "./b!": "a-a-a-b", "": "", None: ""}
    given = spark.createDataFrame([(k,) for k in said], "args string")
    found = {r.args: r.s for r in given.select("args", text.command_signature(F.lit("bash"), F.col("args")).alias("s")).collect()}
    assert found == {k: v or "bash" for k, v in said.items()}


def test_stems_are_made_a_few_texts_at_a_time(spark, monkeypatch):
    """A worker holds the words of SLICE texts as Python objects, not those of a whole batch; the stems are the same."""
    texts = [f"Running naïve caresses {n}" if n % 3 else None for n in range(300)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, t string").coalesce(1)
    found = {r.id: r.s for r in rows.select("id", stem.stems(F.col("t")).alias("s")).collect()}
    assert found == {n: ["run", "naiv", "caress", str(n)] if t else [] for n, t in enumerate(texts)}
    assert stem.SLICE < 300


def test_only_vectors_that_are_asked_are_compared(spark, monkeypatch):
    """Of the vectors that a channel could ask for, only those of its questions meet all others."""
    seen = []
    real = search.nearest
    monkeypatch.setattr(search, "nearest", lambda table, asked, *a, **k: seen.append(asked.count()) or real(table, asked, *a, **k))
    folder = "/root/testdata/sf0.001"
    probes = engine_queries.probes(spark, folder).select("query_id").limit(3)
    engine_queries.nearest(spark, folder, asked=probes)
    assert seen[0] <= 3
    seen.clear()
    engine_queries.fused(spark, folder)
    assert seen[0] <= engine_queries.probes(spark, folder).count()


def test_a_descent_writes_what_it_reaches_once(spark, monkeypatch):
    """A chain of 30 with a cycle at its end, walked from its head: rewritten at every level it would be some 500 rows."""
    written = []
    real = graph.settled

    def settled(df):
        out = real(df)
        written.append(out.count() if "level" in out.columns else 0)
        return out

    monkeypatch.setattr(graph, "settled", settled)
    chain = spark.createDataFrame([(n, n + 1) for n in range(30)] + [(30, 28), (30, 0)], "source long, target long")
    found = graph.descend(chain.unionByName(chain), spark.createDataFrame([(0,), (29,)], "entity long"))
    reached = {(r.root, r.entity): r.level for r in found.collect()}
    assert reached == {(0, n): n for n in range(31)} | {(29, n): (n - 29) % 31 if n != 28 else 2 for n in (28, 29, 30)} | {(29, n): n + 2 for n in range(28)}
    assert sum(written) < 62 + 62 * 62 // 16


def test_edges_are_not_shuffled_to_a_small_frontier(spark, monkeypatch):
    plans = []
    real = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    edges = spark.range(100).select(F.concat(F.lit("a"), "id").alias("source"), F.lit("r").alias("relation"), F.concat(F.lit("a"), F.col("id") + 1).alias("target"), F.lit("m").alias("memory_id"), F.col("id").alias("sequence"))
    seeds = spark.createDataFrame([("a5",)], "entity string")
    assert {(r.entity, r.hop) for r in graph.neighborhood(edges, seeds, 2, 20).collect()} == {("a5", 0), ("a4", 1), ("a6", 1), ("a3", 2), ("a7", 2)}
    assert sum("broadcast" in p for p in plans) == 2


def test_sessions_are_cut_before_questions_meet_them(spark, monkeypatch):
    """A question gets ten memories of a session at most, however large that is."""
    cut = []
    real = search.ranked
    monkeypatch.setattr(search, "ranked", lambda df, limit, order, by="query_id": cut.append((by, limit)) or real(df, limit, order, by))
    engine_queries.ret_legacy_like(spark, "/root/testdata/sf0.001")
    assert ("session_id", 10) in cut


def test_admission_looks_at_what_changes_concern(spark, monkeypatch):
    """Of 300 graphs one is changed: the limits are looked at in it, and in clusters that name what was added. The others cost no more than a pass."""
    looked = []
    real = dag._broken
    monkeypatch.setattr(dag, "_broken", lambda graph, *a: looked.append(graph.count()) or real(graph, *a))
    rows = [(10 * g + a, "cluster", 10 * g + b) for g in range(300) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))] + [(10 * g + 3, "memory", -g) for g in range(300)]
    schema = "cluster long, kind string, child long"
    members = spark.createDataFrame(rows + [(2900, "memory", -5000)], schema)
    states = members.select("cluster").unionByName(members.where("kind = 'cluster'").select(F.col("child").alias("cluster"))).distinct().withColumn("state", F.lit("active"))
    sources = spark.createDataFrame([(-g,) for g in range(300)] + [(-5000,)], "child long")

    def judged(added, **limits):
        proposed = [r for r in rows if r[0] in {a[0] for a in added}] + added
        changed = spark.createDataFrame([(c,) for c in {a[0] for a in added}], "cluster long")
        looked.clear()
        found = dag.admit(members, states, changed, spark.createDataFrame(proposed, schema), sources, dag.Limits(**limits))
        return {r.cluster: r.reason for r in found.collect()}

    assert judged([(72, "cluster", 71)]) == {72: None} and max(looked) == 6
    assert judged([(73, "cluster", 70)]) == {73: "cycle"} and max(looked) == 6
    assert judged([(73, "cluster", 80)]) == {73: "levels"} and max(looked) == 11
    assert judged([(3, "memory", -5000), (13, "memory", -5000)], parents=2) == {3: "parents", 13: "parents"} and max(looked) < 20
    assert judged([(3, "memory", -8)], originals=1) == {3: "originals"}


def test_edges_are_made_by_more_tasks_of_more_lines(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(derived, "TASK_LINES", 100, raising=False)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey")
    made = derived.edges(spark, folder).where("relation = 'contains'")
    assert made.rdd.getNumPartitions() > lines.count() // 100 and made.count() == lines.distinct().count()
