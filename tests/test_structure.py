"""Admission to DAGs, page assignment and splits, and the like, by their rules on small made cases and against slow versions."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import stem
from lorekeep.operators import clusters, dag, packing, pages, ranges, recall, search, temporal
from lorekeep.plans import rest_queries
from test_operators import naive_segments

ROW = "cluster long, kind string, child long"


def rows(spark, graph):
    """Memberships of {cluster: children}; children from 1000 on are memories."""
    data = [(c, "memory" if m >= 1000 else "cluster", m) for c, x in graph.items() for m in x]
    return spark.createDataFrame(data, ROW)


def judged(spark, graph, proposed, dissolved=(), limits=dag.Limits()):
    every = {*graph, *(m for x in graph.values() for m in x if m < 1000), *dissolved}
    states = spark.createDataFrame([(c, "dissolved" if c in dissolved else "active") for c in every], "cluster long, state string")
    changed = spark.createDataFrame([(c,) for c in proposed], "cluster long")
    sources = spark.range(1000, 9000).toDF("child")
    found = dag.admit(rows(spark, graph), states, changed, rows(spark, proposed), sources, limits).collect()
    return {r.cluster: r.reason for r in found}


def slow(graph, proposed, dissolved=(), limits=dag.Limits()):
    """Whether the one change may be made, by walking from every cluster."""
    ((cluster, members),) = proposed.items()
    known = {*graph, *(m for x in graph.values() for m in x if m < 1000)}
    if len(members) > limits.members or len({*members}) < len(members):
        return "members"
    for reason, bad in (("self", lambda m: m == cluster), ("unknown child", lambda m: m not in known | {*dissolved}), ("dissolved child", lambda m: m in dissolved)):
        if any(bad(m) for m in members if m < 1000):
            return reason
    whole, parents = graph | {cluster: members}, defaultdict(int)
    for x in whole.values():
        for m in x:
            parents[m] += 1
    if max(parents.values(), default=0) > limits.parents:
        return "parents"

    def walk(node, path):
        if node in path:
            raise ValueError
        depth, below = 1, set()
        for m in whole.get(node, ()):
            if m >= 1000:
                below.add(m)
            else:
                deep, more = walk(m, path | {node})
                depth, below = max(depth, deep + 1), below | more
        return depth, below

    try:
        found = [walk(c, frozenset()) for c in whole]
    except ValueError:
        return "cycle"
    return "levels" if max(d for d, _ in found) > limits.levels else "originals" if max(len(b) for _, b in found) > limits.originals else None


def test_each_limit_refuses(spark):
    chain = {1: [2], 2: [3], 3: [4], 4: [1000]}
    assert judged(spark, chain, {4: [1]}) == {4: "cycle"}
    assert judged(spark, chain, {4: [5]} | {5: [1001]}) == {4: "unknown child", 5: None}
    assert judged(spark, chain | {5: [1001]}, {4: [5]}) == {4: "levels"}
    assert judged(spark, {c: [1000] for c in range(1, 6)} | {9: []}, {9: [1000]}) == {9: "parents"}
    assert judged(spark, {1: []}, {1: [*range(1000, 1021)]}) == {1: "members"} and judged(spark, {1: []}, {1: [*range(1000, 1020)]}) == {1: None}
    assert judged(spark, {1: []}, {1: [1]}) == {1: "self"} and judged(spark, {1: [1000]}, {1: [2]}, dissolved=[2]) == {1: "dissolved child"}
    assert judged(spark, {1: []}, {1: [99_999]}) == {1: "unknown source"} and judged(spark, {1: [1000]}, {1: [1000, 1000]}) == {1: "members"}
    wide = {1: [*range(2, 22)]} | {c: [*range(1000 + 25 * c, 1000 + 25 * c + 19)] for c in range(2, 22)}  # 380 originals
    more = wide | {c: [*range(1000 + 25 * c, 1000 + 25 * c + 20)] for c in range(2, 22)} | {50: [1, *range(30, 36)]} | {c: [*range(4000 + 20 * c, 4020 + 20 * c)] for c in range(30, 35)} | {35: []}
    assert judged(spark, more, {35: [8000]}) == {35: "originals"}  # 500 are there; one more is too many
    assert judged(spark, more, {35: [4600]}) == {35: None}


def test_of_changes_that_break_a_limit_together_those_that_add_to_it_go(spark):
    found = judged(spark, {1: [1000], 2: [1000], 3: [1000], 4: [1000], 5: [1000], 6: [], 7: [1001]}, {5: [1000, 1002], 6: [1000], 7: [1001, 1003]})
    assert found == {5: None, 6: "parents", 7: None}
    assert judged(spark, {1: [1000], 2: [1001], 3: []}, {1: [2], 2: [1], 3: [1]}) == {1: "cycle", 2: "cycle", 3: None}


@pytest.mark.parametrize("seed", range(6))
def test_single_changes_are_judged_as_by_walking(spark, seed):
    chance, limits = random.Random(seed), dag.Limits(members=4, parents=2, levels=3, originals=5)
    graph = {}
    for c in range(1, 12):  # children have greater numbers, so it has no cycle; grown while it is sound
        for m in chance.sample([*range(c + 1, 12), *range(1000, 1012)], 3):
            if not slow(graph | {x: [] for x in range(1, 12) if x not in graph}, {c: graph.get(c, []) + [m]}, (), limits):
                graph[c] = graph.get(c, []) + [m]
    graph = {c: graph.get(c, []) for c in range(1, 12)}
    for c in chance.sample(range(1, 12), 3):
        new = chance.sample([*range(1, 14), *range(1000, 1014)], chance.randrange(1, 5))
        assert judged(spark, graph, {c: new}, [12], limits) == {c: slow(graph, {c: new}, [12], limits)}


def test_a_dissolved_cluster_leaves_its_parents(spark):
    heads = spark.createDataFrame([(1, 1, "active", "a"), (2, 1, "active", "b"), (3, 4, "active", "c"), (4, 1, "active", "d")], "cluster long, revision long, state string, title string")
    members = rows(spark, {1: [2, 3, 1000], 2: [3, 1001], 3: [1002], 4: [1003]})
    changes = spark.createDataFrame([(3, "dissolve", 4, None), (2, "edit", 1, "new"), (4, "edit", 1, "d"), (9, "edit", 1, "x")], "cluster long, kind string, expected long, title string")
    after, final = dag.apply_structure(heads, members, changes, rows(spark, {2: [1001], 4: [1003]}), spark.range(1000, 1010).toDF("child"))
    assert {(r.cluster, r.revision, r.state, r.title, r.outcome, r.reason) for r in after.collect()} == {
        (1, 2, "active", "a", "detached", None), (2, 2, "active", "b", "conflict", None), (3, 5, "dissolved", "c", "done", None),
        (4, 1, "active", "d", "same", None), (9, None, None, None, "missing", None),
    }
    assert {tuple(r) for r in final.collect()} == {tuple(r) for r in rows(spark, {1: [2, 1000], 2: [1001], 4: [1003]}).collect()}


@pytest.mark.parametrize("seed", range(5))
def test_complementary_hits_as_by_passing_in_order(spark, seed):
    chance, hits, covers = random.Random(seed), [], {}
    for query in range(6):
        for rank, ident in enumerate(chance.sample(range(30), 12), 1):
            hits.append((query, ident, rank, ident % 3 == 0))
            if ident % 3 == 0:
                covers[query, ident] = chance.sample(range(30), chance.randrange(0, 4))
    expected = set()
    for query in range(6):
        represented, listed, late = set(), [], []
        for _, ident, _, cluster in sorted((h for h in hits if h[0] == query), key=lambda h: h[2]):
            own = {*covers[query, ident]} if cluster else {ident}
            if not own:
                late.append((ident, "fallback"))
            elif own <= represented:
                expected.add((query, ident, "suppressed", None))
            else:
                listed.append((ident, "selected"))
                represented |= own
        expected |= {(query, ident, action, place) for place, (ident, action) in enumerate(listed + late, 1)}
    coverage = spark.createDataFrame([(q, i, s) for (q, i), x in covers.items() for s in x], "query_id long, id long, source long")
    found = recall.complementary(spark.createDataFrame(hits, "query_id long, id long, rank int, cluster boolean"), coverage)
    assert {tuple(r) for r in found.collect()} == expected


def slow_children(groups, stored, least=0.5):
    out = set()
    for page, parts in groups.items():
        taken = set()
        for place, own in sorted(parts.items()):
            child, best = None, least
            for name, (_, old) in sorted(stored.get(page, {}).items(), key=lambda x: (x[1][0], x[0])):
                score = len(own & old) / len(own | old)
                if name not in taken and score >= best:
                    child, best = name, score
            taken.add(child)
            out.add((page, place, child, round(best, 9) if child is not None else None))
    return out


def test_groups_go_on_as_the_children_they_overlap(spark):
    chance = random.Random(2)
    groups = {p: {s: {*chance.sample(range(12), chance.randrange(1, 7))} for s in range(chance.randrange(1, 5))} for p in range(60)}
    stored = {p: {100 + c: (chance.randrange(3), {*chance.sample(range(12), chance.randrange(1, 7))}) for c in range(chance.randrange(0, 5))} for p in range(60)}
    now = spark.createDataFrame([(p, s, i) for p, x in groups.items() for s, own in x.items() for i in own], "page long, place long, id long")
    old = spark.createDataFrame([(p, c, t, i) for p, x in stored.items() for c, (t, own) in x.items() for i in own], "page long, child long, created long, id long")
    found = {(r.page, r.place, r.child, r.likeness and round(r.likeness, 9)) for r in pages.children(now, old).collect()}
    assert found == slow_children(groups, stored) and len({r[2] for r in found}) == 5
    assert {r.child for r in pages.children(now, old.where("false")).collect()} == {None} and pages.children(now.where("false"), old).count() == 0


def test_split_pages_keep_their_children(spark):
    folder = "/root/testdata/sf0.001"
    groups, stored = defaultdict(lambda: defaultdict(set)), defaultdict(dict)
    now, before = rest_queries.split_groups(spark, folder)
    for r in now.collect():
        groups[r.page][r.place].add(r.id)
    for r in before.collect():
        stored[r.page].setdefault(r.child, (r.created, set()))[1].add(r.id)
    expected = slow_children(groups, stored)
    taken = {(page, child) for page, _, child, _ in expected}
    expected = {(*x, len(groups[x[0]][x[1]])) for x in expected} | {(p, None, c, None, 0) for p, x in stored.items() for c in x if (p, c) not in taken}
    found = {(r.page, r.seed, r.child, r.likeness, r.members) for r in rest_queries.wk_split(spark, folder).collect()}
    assert found == expected and len(found) > 10


def test_pages_of_many_tokens_split_too(spark):
    data = [(1, i, [1.0, 0.0] if i < 3 else [0.0, 1.0], 10) for i in range(6)]
    members = spark.createDataFrame(data, "page long, id long, embedding array<double>, tokens int")
    assert pages.split(members, 0.5, over=6, tokens=60).count() == 0 and pages.split(members, 0.5, over=6, tokens=59).count() == 6


def test_assignment_takes_candidates_thresholds_and_the_unassigned(spark):
    core = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u"), (4, "u"), (5, "w"), (6, "d")], "id long, page string")
    members = core.selectExpr("id", "page", "'core' AS role").unionByName(spark.createDataFrame([(1, "u", "contextual"), (7, "w", "contextual")], "id long, page string, role string"))
    near = spark.createDataFrame([(1, 5, 1), (7, 3, 1), (8, 6, 1), (9, 3, 1)], "id long, neighbour long, rank int")
    known = spark.createDataFrame([("t", "t", True), ("u", "u", True), ("w", "w", True), ("d", "d", False)], "page string, canonical string, open boolean")
    v = {1: [1.0, 0.0], 3: [0.77, 0.638], 4: [0.0, 1.0], 5: [0.77, 0.638], 9: [0.0, 1.0]}
    words = {9: ["q"], 7: ["a", "b", "c", "d"], 3: ["a", "b", "x", "y"], 5: ["a", "b", "c"]}
    features = spark.createDataFrame([(i, "k" if i != 9 else None, [], v.get(i), words.get(i, ["z"])) for i in range(1, 10)], "id long, topic_key string, entities array<string>, v array<double>, shingles array<string>")
    asked = spark.createDataFrame([(1,), (7,), (8,), (9,)], "id long")
    found = {(r.id, r.page, r.role, round(r.score, 3)) for r in pages.assign(asked, core, members, near, known, features).collect()}
    assert found == {
        (1, "t", "core", 1.0), (1, "u", "contextual", 0.77),  # kept at 0.77, at which w does not take it in
        (7, "w", "contextual", 0.75),  # by words, as it has no vector; u would need more than 0.33
        (8, pages.UNASSIGNED, "core", 1.0), (9, pages.UNASSIGNED, "core", 1.0),  # a directory; no shared subject
    }


@pytest.fixture
def many_ranges(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_a_fact_of_many_ranges_is_resolved_as_by_the_naive_rule(spark, many_ranges, seed):
    draw, day, data = random.Random(seed), datetime.date(2000, 1, 1), []
    sizes = {1: 600, 2: 3, 3: 200, 4: 1, None: 20}
    for group, n in sizes.items():
        for i in range(n):
            start = day + datetime.timedelta(draw.randrange(3 * n))
            length = draw.choice((1, 2, 5, 40, n, 3 * n)) if seed < 3 else 4 * n - 2 * (start - day).days + 1  # nested ones last
            stop = None if draw.random() < (0.02, 0.3, 0.0, 0.0)[seed] or length < 1 else start + datetime.timedelta(length)
            data.append((group, (group or 0) * 1000 + i, start, stop, draw.randrange(50), None if draw.random() < 0.3 else day + datetime.timedelta(draw.randrange(5))))
    schema = "fact_group int, revision_id int, start date, stop date, transaction_id int, stated_on date"
    found = temporal.resolve_segments(spark.createDataFrame(data, schema).repartition(5)).collect()
    names = [f.split()[0] for f in schema.split(", ")]
    for group in sizes:
        mine = [dict(zip(names, d)) for d in data if d[0] == group]
        got = sorted((r.valid_from, r.revision_id, r.valid_to or datetime.date.max) for r in found if r.fact_group == group)
        assert got == [(f, r, t or datetime.date.max) for r, f, t in sorted(naive_segments(mine), key=lambda s: s[1])]


def test_the_source_order_counts_before_the_id(spark):
    day = datetime.date(2024, 1, 1)
    data = [(1, 7, day, None, 3, day, "a"), (1, 5, day, None, 3, day, "b")]
    rows = spark.createDataFrame(data, "fact_group int, revision_id int, start date, stop date, transaction_id int, stated_on date, source_order string")
    assert [r.revision_id for r in temporal.resolve_segments(rows).collect()] == [5]
    assert [r.revision_id for r in temporal.resolve_segments(rows.drop("source_order")).collect()] == [7]


def test_maxima_over_stretches(spark):
    chance = random.Random(1)
    covers = [(k, a, a + chance.randrange(-1, 20), chance.randrange(1000)) for k in range(3) for a in chance.choices(range(30), k=15)]
    found = ranges.spread_maxima(spark.createDataFrame(covers, "key int, first int, last int, value int"), "key", "value").collect()
    expected = {}
    for k, a, z, v in covers:
        for b in range(a, z + 1):
            expected[k, b] = max(v, expected.get((k, b), -1))
    assert {(r.key, r.block): r.value for r in found} == expected


def slow_pack(costs, bounds):
    """Row by row, as a packer that has all rows."""
    out, base, run = [], 0, []

    def size():
        return sum(run) + bounds.joint * max(0, len(run) - 1)

    for cost in costs:
        while run and (size() + bounds.joint + cost > bounds.target or len(run) == bounds.most):
            out.append((len(out), base, base + len(run) - 1, size()))
            step = max(1, len(run) - bounds.overlap)
            base, run = base + step, run[step:]
        run.append(cost)
    if run:
        out.append((len(out), base, base + len(run) - 1, size()))
    return out


@pytest.mark.parametrize("bounds", [(100,), (100, 2), (100, 3, 5), (100, 0, 0, 4), (60, 5, 1, 3), (1_000_000,), (100_000, 7), (1,)])
def test_groups_of_many_ranges_are_packed_as_row_by_row(spark, many_ranges, bounds):
    chance, bounds = random.Random(len(bounds)), packing.Bounds(*bounds)
    costs = {"a": [chance.choice((0, 1, 7, 20, 50, 99, 300)) for _ in range(900)], "b": [5] * 3, "c": [chance.randrange(30) for _ in range(250)], None: [40, 70, 40]}
    data = [(g, i, c) for g, x in costs.items() for i, c in enumerate(x)]
    rows_ = spark.createDataFrame(data, "g string, o long, c int").repartition(5)
    found = defaultdict(list)
    for r in packing.pack(rows_, "g", "o", "c", bounds).collect():
        found[r.g].append((r.chunk, r.first, r.last, r.size))
    assert {g: sorted(x) for g, x in found.items()} == {g: slow_pack(x, bounds) for g, x in costs.items()}
    assert packing.pack(rows_.where("false"), "g", "o", "c", bounds).count() == 0


def test_pages_of_clusters_go_as_deep_as_these_do(spark):
    topics = [(f"k{i:02}", 1, f"t{i}", "active") for i in range(15)] + [("k03", 2, "t3 again", "active"), ("k20", 1, "gone", "dissolved")]
    held = [(f"k{i:02}", 1, f"k{i + 1:02}", False) for i in range(14)] + [("k03", 2, "k04", False), ("k03", 2, "m3", True), ("k14", 1, "m14", True), ("k20", 1, "k00", False), ("k09", 1, "k11", False)]
    stored = [("k11", "k10", "t11", "active"), ("k05", "k99", "t5", "active"), ("k20", None, "gone", "active"), ("k21", "k00", "older", "retired")]
    found, sources, links = clusters.pages_of(
        spark.createDataFrame(topics, "cluster string, revision int, title string, state string"),
        spark.createDataFrame(held, "cluster string, revision int, child string, leaf boolean"),
        spark.createDataFrame(stored, "cluster string, parent string, title string, lifecycle string"),
    )
    rows_ = {r.cluster: r for r in found.collect()}
    assert rows_["k00"].parent == "directory:Topics" and rows_["k05"].parent == "k04" and rows_["k05"].changed and rows_["k03"].title == "t3 again"
    assert rows_["k11"].parent == "k10" and not rows_["k11"].changed and rows_["k12"].parent == "k11"
    assert [(rows_[k].lifecycle, rows_[k].changed) for k in ("k20", "k21")] == [("retired", True), ("retired", False)]
    assert {(r.cluster, r.source) for r in sources.collect()} == {(f"k{i:02}", "m14") for i in range(15)} | {(f"k{i:02}", "m3") for i in range(4)}
    assert links.count() == 15


def test_what_is_superseded_in_keys_of_many_ranges(spark, many_ranges):
    chance = random.Random(8)
    data = [(f"i{n}", "hot" if n % 3 else None if n % 2 else "cold", None if chance.random() < 0.2 else chance.randrange(40), n) for n in chance.sample(range(900), 700)]
    current, expected = {}, set()
    for ident, key, stated, order in sorted(data, key=lambda x: x[3]):
        now = current.get(key)
        stale = bool(now and now[0] is not None and stated is not None and stated < now[0])
        expected.add((ident, None if now is None or stale else now[2], stale))
        new = (stated, order, ident)
        if now is None or (now[0] is not None, now[0] or 0, now[1]) <= (stated is not None, stated or 0, order):
            current[key] = new
    rows_ = spark.createDataFrame(data, "id string, key string, stated int, seq int").repartition(5)
    found = {(r.id, r.supersedes, r.stale) for r in temporal.supersedes(rows_, "key", "stated", "seq").collect()}
    assert found == expected


def test_numbers_within_keys_of_many_ranges(spark, many_ranges):
    data = [(n % 5 and "hot" or None, n * 7919 % 900, n) for n in range(900)] + [("one", 5, 1)]
    found = ranges.numbered(spark.createDataFrame(data, "key string, a int, b int").repartition(4), "key", ["a", "b"], "n").collect()
    for key in ("hot", None, "one"):
        own = sorted((r.n, r.a, r.b) for r in found if r.key == key)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted((a, b) for k, a, b in data if k == key)


def test_documents_of_a_common_language_stay_where_they_are(spark):
    """Three languages: their documents do not meet by a shuffle of texts. Rare languages and documents without one beside them."""
    from lorekeep.plans.functions_queries import against_first

    rows = [(n, ["de", "en", "fr"][n % 3], f"a b c d{n % 5} e") for n in range(3000)] + [(5000 + n, f"rare{n % 2}", f"x y z w{n % 2 * n}") for n in range(4)] + [(9000, None, "a b c"), (9001, "none", None)]
    found = against_first(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    got = {r.doc_id: round(r.likeness, 6) for r in found.collect()}
    assert 9000 not in got and len(got) == 3005 and got[9001] == 0.0
    assert got[0] == got[15] == 1.0 and got[3] == 0.2 and got[5000] == got[5002] == 1.0 and got[5003] == round(1 / 3, 6)
    only = against_first(spark.createDataFrame(rows[:3000], "doc_id long, lang string, text string"))
    only.collect()
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_stemmed_search_asks_all_questions(spark):
    """Every question of the benchmark that has a hit, not every twentieth; against BM25 of all documents."""
    folder = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.array_distinct(stem.stems(F.col("text"))).alias("terms"))
    scored = search.bm25(spark.read.parquet(f"{folder}/documents.parquet"), items, "doc_id", "text", stem.stems)
    best = search.ranked(scored, 10, [F.desc(F.round("score", 9)), F.col("id")])
    found = {(r.query_id, r["rank"], r.id) for r in rest_queries.ret_fts_stemmed(spark, folder).collect()}
    assert found == {(r.query_id, r["rank"], r.id) for r in best.collect()}
    assert {q for q, _, _ in found} == {r.query_id for r in items.collect()}
