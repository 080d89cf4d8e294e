"""Prefix trie, sharding and repair against brute force: smallest table, hard cases, one conversation of many ranges, empty table."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import prefix_trie, queries, repair, sharding

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, step int, k1 string, of int"
HARD = [
    (0, 0, "system", "Be kind."), (0, 1, "user", "Hello there."), (0, 2, "assistant", "Hello!"), (0, 2, "assistant", "Hello!"),
    (0, 7, "user", "no end"), (0, 9, "assistant", "   \t"), (0, None, "user", None), (0, None, None, "who?"),
    (1, 1, "user", "Hi."), (2, 1, "assistant", "Hi."), (3, 5, "tool", "x" * 100_000), (3, 6, "", "end."),
    (99, 1, "user", "a."), (100, 1, "user", "a."), (150, 1, "user", "a."), (150, 1, "assistant", "a."), (205, 3, "user", "x."),
    (-7, 1, "user", "Below."), (-107, 2, "user", "Below."), (12, None, None, None), (13, 4, "user", "é ünï 日本語 😀."), (13, 4, "user", "é ünï 日本語 😀."),
    *((31, k // 3, ("user", "assistant")[k % 2], f"Turn {k % 11}{'.' * (k % 4 > 0)}") for k in range(60)),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables too are dealt out to several tasks, so that conversations lie in several ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module", params=["table", "hard", "long", "empty"])
def turns(request, spark, tmp_path_factory):
    if request.param == "table":
        return FOLDER, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = HARD if request.param == "hard" else []
    if request.param == "long":  # lies in all ranges, with twins and repeated texts
        rows = [(5, k // 2, ("user", "assistant", "system")[k * k % 7 % 3], f"Said {k % 97}{'.?'[: k % 3]}") for k in range(1500)]
        rows += [(5, 800 + k, "user", f"{k} " * 400_000) for k in range(4)]
        rows += [(5, 333, "user", "Again and again.")] * 700 + [(9, 1, "user", "Other."), (4, 1, "user", "First.")]
    folder = str(tmp_path_factory.mktemp(request.param))
    data = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], TURNS)
    data.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_prefix_trie(spark, turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MERGED", 2)
    folder, rows = turns
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in order(x)] for c, x in by.items()}
    rebuilt = {}
    for c, told in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, own.get(c - int(c / 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        rebuilt[c] = base[:h] + told[h:]
    nodes = defaultdict(list)
    for c, told in rebuilt.items():
        for d in range(len(told) + 1):
            nodes[tuple(told[:d])].append(c)
    expected = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path] if len(path) < 50 else [p for p in nodes if len(p) >= len(path) and p[: len(path)] == path]
        ended = sorted(c for c in members if len(rebuilt[c]) == len(path))
        kids = Counter(p[:-1] for p in nodes if p)
        expected.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids[path], sum(not kids[p] for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), sha(",".join(map(str, ended))),
        ))
        if len(nodes) > 1000 and len(expected) > 40:
            break  # the long conversation's nodes are looked at near the top only
    found = [tuple(r) for r in queries.QUERIES["op11_prefix_trie"](spark, folder).collect()]
    assert len(found) == len(nodes)
    assert Counter(expected) <= Counter(found)


def test_end_lists_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 10)
    ends = spark.range(-35, 95).selectExpr("0L AS depth", "id % 3 AS k1", "7L AS k2", "id AS conv_id").where("k1 >= 0")
    found = {r.k1: r.digest for r in prefix_trie.end_lists(ends).collect()}
    lists = defaultdict(list)
    for r in ends.collect():
        lists[r.k1].append(r.conv_id)
    assert found == {k: sha(",".join(map(str, sorted(x)))) for k, x in lists.items()}


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(roles, marks):
    """(cost, audit) by trying each edit at each turn, states as strings of what came last."""
    after = {("", "u"), ("", "s"), ("s", "u"), ("u", "a"), ("a", "u")}

    def insert(best):
        for _ in range(4):
            for (state, (cost, audit)), new in itertools.product(list(best.items()), "ua"):
                if (state, new) in after:
                    best[new] = min(best.get(new, (10**9, "")), (cost + 3, audit + "I"))
        return best

    best = {"": (0, "")}
    for role, mark in zip(roles, marks):
        new = {}
        for state, (cost, audit) in insert(best).items():
            options = [(state, 4, "D")]
            if mark not in ("blank", "duplicate"):
                more = 3 * (mark == "truncated")
                options += [(x, 3 + more, "R") for x in "ua" if (state, x) in after]
                options += [(role, more, "K")] if (state, role) in after else []
            for x, price, letter in options:
                new[x] = min(new.get(x, (10**9, "")), (cost + price, audit + letter))
        best = new
    return min(v for k, v in insert(best).items() if k in ("", "a"))


def replay(rows, audit):
    out, left, last = [], list(rows), ""
    for letter in audit:
        need = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((need, ""))
        else:
            _, _, role, text = left.pop(0)
            if letter == "D":
                continue
            out.append((role if letter == "K" else need, text))
        last = out[-1][0][:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and not left
    return "\n".join(f"{r}:{t}" for r, t in out)


def test_repair(spark, turns, monkeypatch):
    monkeypatch.setattr(repair, "MERGED", 2)
    folder, rows = turns
    by = {r[0]: [] for r in rows}
    for c, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[c] += [(c, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    expected = []
    for c, told in by.items():
        told = order(told)
        marks, roles = faults(told), [r[2][:1] for r in told]
        numbers = [r[1] for r in told if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        cost, audit = cheapest(roles, marks)
        counts = (marks.count(x) for x in ("blank", "duplicate", "truncated"))
        expected.append((c, gaps, *counts, illegal, cost, audit, sha(replay(told, audit))))
    found = queries.QUERIES["op13_repair"](spark, folder).collect()
    assert Counter(map(tuple, found)) == Counter(expected)


def test_repair_keeps_conversations_without_id_together(spark):
    data = spark.createDataFrame([(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, 2, "assistant", "B.")], "conv_id long, turn long, role string, text string")
    (row,) = repair.repair(data).collect()
    assert (row.conv_id, row.duplicate, row.cost, row.audit) == (None, 1, 4, "KKD") and row.repaired_sha256 == sha("user:A.\nassistant:B.")


def test_repair_products_associate():
    chance = random.Random(3)
    for _ in range(50):
        codes = bytes(chance.randrange(16) for _ in range(chance.randrange(1, 40)))
        whole = None
        for c in codes:
            whole = repair.turn_matrix(c) if whole is None else repair.times(whole, repair.turn_matrix(c))
        cut = chance.randrange(len(codes))
        halves = repair.product(codes) if not cut else repair.times(repair.product(codes[:cut]), repair.product(codes[cut:]))
        assert whole == repair.product(codes) == halves
        assert repair.outcome(whole)[:2] == cheapest(["sua?"[c // 4] for c in codes], [["", "blank", "duplicate", "truncated"][c % 4] for c in codes])


def test_differencing_against_all_partitions():
    chance = random.Random(5)
    for _ in range(60):
        sizes = [chance.randrange(1, 60) for _ in range(chance.randrange(1, 8))]
        dealt = sharding.differenced(sizes, 3)
        spread = max(s := [sum(x for x, d in zip(sizes, dealt) if d == k) for k in range(3)]) - min(s)
        best = min(
            max(t := [sum(x for x, d in zip(sizes, way) if d == k) for k in range(3)]) - min(t)
            for way in itertools.product(range(3), repeat=len(sizes))
        )
        assert best <= spread <= max(sizes)
    assert sharding.differenced([8, 7, 6, 5, 4], 2) in ([0, 1, 0, 1, 1], [1, 0, 1, 0, 0])  # sums 14 and 16, as the method's textbook case has it
    assert sharding.differenced([], 4) == [] and sharding.differenced([3, 2], 1) == [0, 0] and sharding.differenced([0, 0], 2)


@pytest.mark.parametrize("bundles", [4, 4096])
@pytest.mark.parametrize("case", ["table", "hard", "empty"])
def test_shards(spark, case, bundles):
    if case == "table":
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    else:
        rows = [(k % 50 if k % 7 else None, None if k % 11 == 0 else "" if k % 13 == 0 else "same" if k % 3 == 0 else "é" * (k % 40) + str(k)) for k in range(300)]
        rows = rows + [(1000, "long " * 40_000), (1000, "long " * 40_000)] if case == "hard" else []
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, digest int").repartition(5)
    texts = [((r.doc_id), (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    found = sharding.shard(docs, 16, bundles).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in texts)
    homes = defaultdict(set)
    for r in found:
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    for k in range(16):
        own = sorted((r.slot, r.doc_id if r.doc_id is not None else -1) for r in found if r.shard == k)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    if texts and case == "table" and bundles > 4:
        sums = [sum(r.size for r in found if r.shard == k) for k in range(16)]
        assert max(sums) - min(sums) <= 64


def test_op12_columns(spark):
    found = queries.QUERIES["op12_sharding"](spark, FOLDER)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert found.where((F.col("law") != "bytes") | F.col("grown_shard").isNotNull()).count() == 0
