"""Operators whose rules SQL cannot say (greedy choices, chains, top-k kernels) against slow versions, and their hard cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import clusters, graph, ingest, pages, recall, rows, search, sets, temporal
from lorekeep.plans import more_queries


def test_nearest_vectors_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "SLICE", 50)
    draw = np.random.default_rng(4)
    data = [(i, draw.integers(0, 3, 6).astype(float).tolist()) for i in range(300)]
    data += [(900 + i, data[5][1]) for i in range(40)] + [(1000, None), (1001, [1.0, 2.0])]
    vectors = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    asked = [(i, v) for i, v in data if i % 15 == 0] + [(2000, [0.0] * 6), (2001, None), (2002, [9.0, 9.0])]
    found = {}
    for r in search.nearest(vectors, spark.createDataFrame(asked, "query_id long, q array<double>"), 9).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    for q, v in asked:
        want = []
        if v is not None:
            far = [(round(math.dist(v, w), 9), i) for i, w in data if w is not None and len(w) == len(v) and i != q]
            want = [(n, i, d) for n, (d, i) in enumerate(sorted(far)[:9], 1)]
        assert sorted(found.get(q, [])) == want
    assert search.nearest(vectors.where("false"), vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")).limit(3), 2).count() == 0
    assert search.nearest(vectors, vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")).where("false"), 2).count() == 0


def test_collapse_by_vectors_spares_the_exempt(spark):
    rows_ = [
        ("q", 1, 1, ["a b c"], [1.0, 0.0], False),
        ("q", 2, 2, ["x y z"], [0.9, 0.1], False),  # near 1 by vector
        ("q", 3, 3, ["a b c"], [0.0, 1.0], True),  # exempt
        ("q", 4, 4, ["a b c"], None, False),  # equal to 1 by words
        ("q", 5, 5, ["m n o"], [0.0, 1.0], False),  # near 3, but 3 is never compared with
        ("q", 6, 6, None, [0.0, 0.0], False),
        ("r", 2, 1, ["x y z"], [0.9, 0.1], False),
    ]
    hits = spark.createDataFrame(rows_, "query_id string, id long, rank long, shingles array<string>, vector array<double>, exempt boolean")
    kept = search.collapse(hits)
    assert kept.columns == ["query_id", "id", "rank"]
    assert sorted((r.query_id, r.id) for r in kept.collect()) == [("q", 1), ("q", 3), ("q", 5), ("q", 6), ("r", 2)]


def slow_pages(own, mapped, exact, alike, limit):
    scores = dict(own)
    for page, ranks in mapped.items():
        scores[page] = scores.get(page, 0) + sum(1 / ((60 + r) * 2**n) for n, r in enumerate(sorted(ranks)[:3]))
    left, out = dict(scores), []
    while left and len(out) < limit:
        page = min(left, key=lambda p: (p not in exact, -left[p], p))
        out.append((page, round(left.pop(page), 12)))
        for other in left:
            if tuple(sorted((page, other))) in alike:
                left[other] /= 2
    return out


def test_page_search_is_that_of_a_slow_one(spark):
    draw = random.Random(5)
    members = {f"p{k:02}": {*draw.sample(range(60), draw.randrange(3, 15))} for k in range(20)}
    members |= {f"z{k}": members[f"p{k:02}"] | ({99} if k % 2 else set()) for k in range(5)}
    placed = spark.createDataFrame([(p, i) for p, m in members.items() for i in m], "page string, id long")
    hits, own = {}, {}
    for q in range(6):
        hits[q] = draw.sample(range(60), 25)
        own[q] = draw.sample(sorted(members), 4)
    page_hits = spark.createDataFrame([(q, p, n) for q, ps in own.items() for n, p in enumerate(ps, 1)], "query_id long, page string, rank int")
    source_hits = spark.createDataFrame([(q, i, n) for q, ids in hits.items() for n, i in enumerate(ids, 1)], "query_id long, id long, rank int")
    exact = spark.createDataFrame([(0, "z3"), (1, "p07"), (1, "p07")], "query_id long, page string")
    alike = sets.similar_sets(placed, 0.8, "page", "id").where("likeness > 0.8")
    pairs = {(a, b) for a in members for b in members if a < b and len(members[a] & members[b]) > 0.8 * len(members[a] | members[b])}
    found = {}
    known = spark.createDataFrame([(p, p, True) for p in members], "page string, canonical string, open boolean")
    listed, lost, state = pages.search(page_hits, source_hits, placed, known, exact, alike, 8)
    held = {i for m in members.values() for i in m}
    assert {(r.query_id, r.place, r.id) for r in lost.collect()} == {(q, n, i) for q, ids in hits.items() for n, i in enumerate([i for i in ids if i not in held][:8], 1)}
    assert {r.truncated for r in state.collect()} == {True}
    for r in sorted(listed.collect()):
        found.setdefault(r.query_id, []).append((r.page, round(r.score, 12)))
    for q in range(6):
        mapped = {p: [n for n, i in enumerate(hits[q], 1) if i in m] for p, m in members.items()}
        listed = {p: v for p, v in mapped.items() if v}
        want = slow_pages({p: 1 / (60 + n) for n, p in enumerate(own[q], 1)}, listed, {"z3"} if q == 0 else {"p07"} if q == 1 else set(), pairs, 8)
        assert found[q] == want


def test_page_search_follows_redirects_and_leaves_out_closed_pages(spark):
    placed = spark.createDataFrame([("old", 1), ("new", 1), ("new", 2), ("shut", 3)], "page string, id long")
    known = spark.createDataFrame([("old", "new", False), ("new", "new", True), ("shut", "shut", False)], "page string, canonical string, open boolean")
    hits = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 9, 3)], "query_id long, id long, rank int")
    words = spark.createDataFrame([(1, "shut", 1)], "query_id long, page string, rank int")
    none = spark.createDataFrame([], "query_id long, page string")
    alike = spark.createDataFrame([], "first string, second string")
    listed, lost, state = pages.search(words, hits, placed, known, none, alike, 5)
    assert [(r.page, r.score) for r in listed.collect()] == [("new", 1 / 61)]  # once, though it is on both
    assert sorted((r.place, r.id) for r in lost.collect()) == [(1, 3), (2, 9)]
    assert [r.truncated for r in state.collect()] == [False]
    assert pages.search(words, hits, placed, known, none, alike, 5, looked=3)[2].first().truncated


def slow_evidence(groups, tokens, most, least, frame=0, overhead=0):
    taken, used, out = 0, overhead, {}
    for name in sorted(groups, key=lambda g: (not any(c for _, c, _ in groups[g]), g)):
        own = groups[name]
        if taken + len(own) > most:
            continue
        chars, more = sum(c for _, _, c in own), frame * len(own)
        while math.ceil((used + chars + more) / 4) > tokens and len(own) == 1 and chars > least:
            chars = max(least, chars // 2)
        if math.ceil((used + chars + more) / 4) <= tokens:
            taken, used = taken + len(own), used + chars + more
            out |= {i: chars if len(own) == 1 else c for i, _, c in own}
    return out


def test_evidence_is_that_of_a_slow_selection(spark):
    draw = random.Random(2)
    made, expected = [], {}
    for page in range(8):
        groups = {}
        for g in range(draw.randrange(1, 30)):
            groups[f"g{g:02}"] = [(page * 1000 + g * 10 + k, draw.random() < 0.2, draw.choice([50, 400, 3000, 40_000])) for k in range(draw.choice([1, 1, 1, 2, 5]))]
        made += [(page, i, g, core, chars) for g, own in groups.items() for i, core, chars in own]
        expected |= {(page, i): c for i, c in slow_evidence(groups, 2000, 12, 256).items()}
    members = spark.createDataFrame(made, "page long, id long, fact_group string, core boolean, chars long")
    found = {(r.page, r.id): r.chars for r in pages.select_evidence(members, 2000, 12).collect()}
    assert found == expected
    assert pages.select_evidence(members.where("false"), 2000).count() == 0


def test_evidence_and_claims_of_the_tables_pages(spark):
    members, supports, claims = more_queries.evidence_inputs(spark, "/root/testdata/sf0.001")
    groups, rests, told = {}, {}, {}
    for r in members.collect():
        groups.setdefault(r.page, {}).setdefault(r.fact_group, []).append((r.id, r.core, r.chars))
    for r in supports.collect():
        rests.setdefault((r.page, r.claim), set()).add(r.id)
    for r in claims.collect():
        told.setdefault(r.page, []).append((r.claim, r.chars))
    expected = set()
    for page, own in groups.items():
        chosen = slow_evidence(own, 8000, 40, 256, 60, 1200)
        expected |= {(page, "evidence", i, c) for i, c in chosen.items()}
        kept = [x for x in sorted(told.get(page, [])) if rests[page, x[0]] <= chosen.keys()] if chosen else []
        while kept and math.ceil((1200 + sum(c + 60 for c in chosen.values()) + sum(c for _, c in kept)) / 4) > 8000:
            kept.pop()
        expected |= {(page, "claim", i, None) for i, _ in kept}
    found = {(r.page, r.kind, r.id, r.chars) for r in more_queries.wk_evidence_select(spark, "/root/testdata/sf0.001").collect()}
    assert found == expected and any(x[1] == "claim" for x in found)


def test_closure_of_cycles_and_nothing(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("c", "d")], "child string, parent string")
    one = spark.createDataFrame([("b",)], "entity string")
    assert sorted(r.entity for r in clusters.closure(steps, one).collect()) == ["a", "b", "c", "d"]
    assert clusters.closure(steps, one.where("false")).count() == 0


def test_best_overlap_takes_the_smaller_of_equals_and_nothing_at_the_bound(spark):
    active = spark.createDataFrame([(c, m) for c, ms in {7: "abcd", 3: "abcd", 5: "abce", 9: "wxyz"}.items() for m in ms], "id long, member string")
    proposed = spark.createDataFrame([(p, m) for p, ms in {1: "abcd", 2: "abcf", 3: "wxy"}.items() for m in ms], "id long, member string")
    found = {r.id: (r.cluster, r.likeness) for r in clusters.best_overlaps(proposed, active, 0.74).collect()}
    assert found == {1: (3, 1.0), 3: (9, 0.75)}
    assert clusters.best_overlaps(proposed, active, 0.75).where("id = 3").count() == 0


def test_discovery_admits_by_words(spark):
    said = "one two three four five six seven eight nine ten"
    sources = spark.createDataFrame(
        [(1, "k", "s", "p", said), (2, None, "s", "q", said + " eleven"), (3, "k", "t", "p", "other words"), (4, None, "t", "q", said), (5, None, "s", "p", "quite different")],
        "id long, topic_key string, session_id string, profile_id string, content string",
    )
    pairs = spark.createDataFrame([(1, i) for i in (2, 3, 4, 5)], "query_id long, id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    found = clusters.discover(pairs, sources, vectors).collect()
    assert [(r.seed, r.members, r.ids) for r in found] == [(1, 3, [2, 3])]  # 4 is alike but from elsewhere


def test_walks_of_many_queries_are_those_of_each(spark):
    draw = random.Random(7)
    data = [(f"n{draw.randrange(30)}", "r", f"n{draw.randrange(30)}", f"m{i}", i) for i in range(120)]
    edges = spark.createDataFrame(data, "source string, relation string, target string, memory_id string, sequence long")
    seeds = [(q, f"n{draw.randrange(30)}") for q in range(4) for _ in range(2)]
    many = graph.walk(edges, spark.createDataFrame(seeds, "query_id long, entity string"), 2, 5)
    for q in range(4):
        own = spark.createDataFrame([(e,) for k, e in seeds if k == q], "entity string")
        one = sorted((r.entity, r.hop) for r in graph.neighborhood(edges, own, 2, 5).collect())
        assert sorted((r.entity, r.hop) for r in many.where(F.col("query_id") == q).collect()) == one
        seen, front = {e: 0 for k, e in seeds if k == q}, {e for k, e in seeds if k == q}
        for hop in (1, 2):
            ends = [(-s, a, r, b, d, o) for a, r, b, _, s in data for e, d, o in ((a, "out", b), (b, "in", a)) if e in front]
            front = {o for *_, o in sorted(ends)[:5]} - seen.keys()
            seen |= dict.fromkeys(front, hop)
        assert one == sorted(seen.items())


def test_cascades_spread_and_nulls_stay(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (None,)], "k long"),
        "b": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "k long, a long"),
        "c": spark.createDataFrame([(100, 10), (200, 20), (300, 99)], "k long, b long"),
    }
    left = rows.delete_cascade(tables, "a", F.col("k") == 1, [("b", "a", "a", "k"), ("c", "b", "b", "k")])
    assert {n: sorted(str(r.k) for r in t.collect()) for n, t in left.items()} == {"a": ["2", "None"], "b": ["20", "30"], "c": ["200", "300"]}


def test_older_statements_never_supersede(spark):
    data = [("a", "k", 5, 1), ("b", "k", 3, 2), ("c", "k", 5, 3), ("d", "k", None, 4), ("e", "k", 9, 5), ("f", "j", 1, 1)]
    made = spark.createDataFrame(data, "id string, key string, stated int, n int")
    found = {r.id: (r.supersedes, r.stale) for r in temporal.supersedes(made, "key", "stated", "n").collect()}
    assert found == {"a": (None, False), "b": (None, True), "c": ("a", False), "d": ("c", False), "e": ("c", False), "f": (None, False)}


def test_terms_are_found_anywhere(spark):
    texts = spark.createDataFrame([(1, "abcd bc"), (2, None), (3, ""), (4, "xbcx")], "id long, t string")
    terms = spark.createDataFrame([("bc",), ("abcd",), ("zz",)], "term string")
    assert sorted((r.id, r.term) for r in search.contained(texts, "t", terms).collect()) == [(1, "abcd"), (1, "bc"), (4, "bc")]
    assert search.contained(texts, "t", terms.where("false")).count() == 0


def test_conflicts_must_be_borne_out_by_both_texts(spark):
    base = ("r1", "correction", "The port is 8080 now", "the  PORT was 80", ["port"], "is 8080", "was 80")
    def one(**change):
        names = ("revision_id", "relationship", "content", "old", "subjects", "evidence", "old_evidence")
        return tuple((dict(zip(names, base)) | change).values())

    data = [(1, *one()), (2, *one()), (2, *one(revision_id="r2")), (3, *one(evidence="is 9090")), (4, *one(subjects=["port", "host"])), (5, *one(relationship="duplicate")), (6, *one(evidence=None))]
    kinds = "incoming long, revision_id string, relationship string, content string, old string, subjects array<string>, evidence string, old_evidence string"
    assert [tuple(r) for r in ingest.accepted_conflicts(spark.createDataFrame(data, kinds)).collect()] == [(1, "r1")]


@pytest.mark.parametrize(("said", "valid"), [("fine", True), ("a [x](y)", False), ("see a@b.org", False), ("[[p1]]", True), ("[[p2]]", False), ("a\nb", False), ("![x", False), ("", False)])
def test_articles(spark, said, valid):
    article = F.to_json(F.struct(F.array(F.struct(F.lit("T").alias("title"), F.array(F.struct(F.lit(said).alias("text"), F.array(F.lit("E1")).alias("citations"))).alias("paragraphs"))).alias("sections")))
    found = spark.range(1).select(pages.valid_article(article, F.array(F.lit("E1")), F.array(F.lit("p1")), 100).alias("v"), pages.valid_article(F.lit("{"), F.array(F.lit("E1")), F.array(F.lit("p1")), 100).alias("m")).first()
    assert (found.v, found.m) == (valid, False)


def test_clusters_by_words_come_before_those_by_vectors(spark):
    claims = spark.createDataFrame([("a", 1, "red fox"), ("b", 2, "red hen"), ("c", 3, "blue whale"), ("d", 4, "red dog")], "cluster string, id long, content string")
    asked = spark.createDataFrame([(9, ["red"])], "query_id long, terms array<string>")
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    hidden = spark.createDataFrame([("d",)], "cluster string")
    own = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, q array<double>")
    assert [(r.cluster, r["rank"]) for r in sorted(recall.claimed_clusters(claims, hidden, asked, vectors, own).collect(), key=lambda r: r["rank"])] == [("b", 1), ("a", 2), ("c", 3)]


def test_traces_name_tests_modules_and_files(spark):
    calls = spark.createDataFrame(
        [
            (1, "Bash", "./gradlew :core:test", "failure", "FooTest > bar() FAILED\nFooTest > baz() FAILED", None),
            (2, "Edit", "src/Main.java", "success", None, None),
            (3, "Bash", "  ", "failure", "FooTest > bar() FAILED", None),
            (4, "Bash", "./gradlew :core:test", "success", None, "FooTest > bar() FAILED"),
        ],
        "id long, tool string, args string, status string, error string, output string",
    )
    found = sorted((r.id, r.source, r.relation, r.target) for r in ingest.trace_triples(calls, "id").collect())
    run = "gradlew :core:test"
    assert found == sorted(
        [(1, "bash", "invoked", run), (1, run, "failed_in", "footest"), (1, run, "validates", "core"), (2, "edit", "invoked", "edit src/main.java"), (2, "edit src/main.java", "touched", "src/main.java"), (4, "bash", "invoked", run), (4, run, "validates", "core")]
    )
    assert ingest.trace_triples(calls, "id", most=2).where("id = 1").count() == 2
