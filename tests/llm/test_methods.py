"""The operators' own methods: kernels against brute force, skew, links, masks, accuracy on held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import chat, components, exact_dedup, fingerprints, mixing, quality, secret_scan, simhash, token_counts, toxicity

FOLDER = "/root/testdata/sf0.01"


def naive_components(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_links(n, radius):
    draw = np.random.default_rng(n)
    prints = draw.integers(0, 2**63, n, dtype=np.uint64)
    for i in range(n // 3):
        flips = draw.choice(64, draw.integers(0, radius + 3), replace=False)
        prints[i] = prints[n - 1 - i % 7] ^ np.uint64(sum(1 << int(b) for b in flips))
    prints = np.unique(prints)
    n = len(prints)
    near = [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= radius)]
    assert naive_components(n, simhash.linked(prints[:, None], radius)) == naive_components(n, near)


def test_wide_bit_sliced_links():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 2**63, (150, 8), dtype=np.uint64)
    prints[50:100] = prints[:50]
    for i in range(50):
        for b in draw.choice(512, draw.integers(0, 180), replace=False):
            prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    near = [(i, j) for i in range(150) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= 90]
    assert naive_components(150, simhash.linked(prints, 90)) == naive_components(150, near)


def test_keys_cover_every_choice_of_differing_bits():
    draw = random.Random(2)
    for equal in (1, 2, 3):
        masks = [m & (2**64 - 1) for m in simhash.block_masks(4, equal)]
        for _ in range(300):
            flips = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_large_buckets_are_dealt_out_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    draw = random.Random(4)
    base = draw.getrandbits(63)
    values = sorted({base ^ (1 << draw.randrange(60)) ^ (1 << draw.randrange(60)) for _ in range(300)})
    nodes = spark.createDataFrame([(v,) for v in values], "node long")
    links = simhash.links(simhash._keyed(nodes, 4), 4)
    assert {r.component for r in components.connected_components(links).collect()} == {values[0]}


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert found == {i: 0 for i in range(200)} | {500: 500, 501: 500}


def test_near_copies_by_similarity(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [draw.choice(words) for _ in range(300)]
    near, far = base.copy(), base.copy()
    for i in range(5):
        near[i * 50] = "changed"
    for i in range(0, 300, 6):
        far[i] = "other"
    rows = [(3, " ".join(base)), (2, " ".join(near)), (1, " ".join(far)), (9, " ".join(base)), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _head string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    twice = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert simhash.drop_near_duplicates(twice).count() == 1


def jaccard(a, b, words=5):
    a, b = ({*simhash.shingle_hashes(x, words).tolist()} for x in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def edited_copies(seed, texts, copies, size=120):
    """Texts, and copies of each with a few words changed: likeness from about 0.6 up."""
    draw = random.Random(seed)
    made = []
    for _ in range(texts):
        base = [f"w{draw.randrange(4000)}" for _ in range(size)]
        made.append(" ".join(base))
        for _ in range(copies):
            own = base.copy()
            for at in draw.sample(range(size), draw.randrange(1, 8)):
                own[at] = f"v{draw.randrange(4000)}"
            made.append(" ".join(own))
    return made


@pytest.mark.parametrize("chunk", [1 << 20, 2000])
def test_links_of_similarity_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", chunk)
    texts = edited_copies(3, 8, 12) + edited_copies(4, 1, 90)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert [found[i] for i in range(len(texts))] == naive_components(len(texts), near)


def test_links_of_repeated_lines_and_short_texts_are_those_of_brute_force(spark):
    draw = random.Random(5)
    texts = []
    for times in (5, 40):
        base = [f"w{draw.randrange(4000)}" for _ in range(204)]
        line = [f"v{draw.randrange(4000)}" for _ in range(10)]
        texts += [" ".join(x) for x in (base, base + line * times, base + base[-14:] * times)]
    for size in range(5, 21):
        for _ in range(30):
            base = [f"w{draw.randrange(4000)}" for _ in range(size)]
            texts += [" ".join(x) for x in (base, [*base, "end"], base[1:], [*base[:-1], "other"])]
    near = []
    for k in range(0, len(texts), 2):  # only copies of one base can be near: three in a row, then four in a row
        near += [(i, j) for i in range(k, min(k + 7, len(texts))) for j in range(k, i) if jaccard(texts[i], texts[j]) >= 0.8]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert [found[i] for i in range(len(texts))] == naive_components(len(texts), near)


@pytest.mark.parametrize("shared, one, two", [(4, 0, 1), (12, 1, 2), (8, 1, 1), (80, 10, 10)])
def test_bits_differ_as_often_as_worked_out(shared, one, two):
    draw = np.random.default_rng(shared)
    bits = draw.integers(0, 2, (40_000, shared + one + two), dtype=np.int8)
    a, b = bits[:, : shared + one], np.delete(bits, slice(shared, shared + one), axis=1)
    apart = (2 * a.sum(axis=1) > shared + one) != (2 * b.sum(axis=1) > shared + two)
    assert simhash.differs(shared, one, two) == pytest.approx(apart.mean(), abs=0.01)


def test_overlaps_are_jaccard_likenesses():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 50, n, dtype=np.uint64)) for n in (1, 5, 40, 40, 80)]
    want = [len({*sets[2].tolist()} & {*s.tolist()}) / len({*sets[2].tolist()} | {*s.tolist()}) for s in sets]
    assert simhash.overlaps(sets[2], sets).tolist() == pytest.approx(want)


def test_heavy_digests_are_settled_without_a_shuffle_of_their_rows(spark):
    ids = spark.range(6000)
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    rows = docs.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest"))
    heavy = exact_dedup.heavy_digests(rows).collect()
    assert [(r.keep_id, r.group_size) for r in heavy] == [(0, 2000)]
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert found[3] == (0, 2000, False) and found[0] == (0, 2000, True) and len(found) == 6000


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a  b"), (2, "a\tb"), (3, None), (None, ""), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, digest int")
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (True, None)]


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = [(r.doc_id, r.text, r.toxic) for r in docs.join(labels, "doc_id").collect()]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    settings = toxicity.Settings()
    scorer = toxicity.Scorer(*toxicity.train([r[1] for r in learn], [r[2] for r in learn], settings), settings)
    scores, truth = scorer.scores([r[1] for r in test]), np.array([r[2] for r in test])
    better = (scores[truth == 1][:, None] > scores[truth == 0]).mean()
    assert better > 0.9
    assert ((scores >= 0.5) & (truth == 0)).sum() < 0.02 * (truth == 0).sum()
    seen, misspelt, clean = scorer.logits(["worthless", "worthles", "thation"])
    assert seen > misspelt > clean


def test_toxicity_without_lessons():
    numbers, offset = toxicity.train([], [])
    scorer = toxicity.Scorer(numbers, offset, toxicity.Settings())
    assert scorer.scores(["", "anything"]).tolist() == pytest.approx([0.25, 0.25])  # nothing goes where nothing is known
    assert 0 < toxicity.Scorer(*toxicity.train(["a", ""], [0, 0]), toxicity.Settings()).scores(["a"])[0] < 0.5


def test_linking_needs_complementary_parts(spark):
    rows = [
        (1, "user: alice\npwd: hunter2"),
        (2, "user: alice"),
        (3, "pwd: hunter2"),
        (4, "user: alice" + " filler" * 60 + " pwd: hunter2"),
        (5, "see https://db.example.org/x then secret=abcdef12"),
        (6, None),
    ]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == [("account", 0, 11), ("phrase", 12, 24)]
    assert found[2] == found[3] == found[4] == found[6] == []
    assert [k for k, _, _ in found[5]] == ["endpoint", "assign"]


def test_prefix_scan_equals_running_one_character_at_a_time():
    draw = np.random.default_rng(3)
    to, out = token_counts.cutter()
    for n in (1, 127, 128, 129, 5000):
        kinds = draw.integers(0, 12, n).astype(np.uint8)
        state, starts = token_counts.FREE, np.zeros(n, bool)
        for i, kind in enumerate(kinds):
            mark = out[state, kind]
            starts[i] |= bool(mark & token_counts.HERE)
            if i and mark & token_counts.BEFORE:
                starts[i - 1] = True
            state = to[state, kind]
        assert (token_counts.token_starts(kinds) == starts).all()


def test_transducer_counts_what_merging_gives():
    counter = token_counts.text_counter(public_tokenizers.path("byte_bpe_50k.json")).words
    ranks = {(a, b): r for (a, b), r in ((divmod(k, 1 << 32), r) for k, r in counter.ranks.items())}
    names = {i: t for t, i in counter.tokens.items()}
    draw = random.Random(6)
    for _ in range(300):
        word = "".join(draw.choice("aabcdeilnorst-é") for _ in range(draw.randrange(1, 20))).encode()
        parts = [counter.tokens[bytes([b])] for b in word]
        while True:
            ranked = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [counter.tokens[names[parts[i]] + names[parts[i + 1]]]]
        assert counter.count(word) == len(parts)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the tokens in one of five sources."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs.withColumn("source", F.when(F.col("doc_id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))).cache()


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(entropy=0.99, repetition=100), mixing.Target(repetition=1.5), mixing.Target(budget=0.5, repetition=1e9)])
def test_mix_meets_its_target(skewed, target):
    words = mixing.count_words(F.col("text"))
    natural = {r.source: r.t for r in skewed.groupBy("source").agg(F.sum(words).alias("t")).collect()}
    whole = sum(natural.values())
    mixed = mixing.mix(skewed, target).withColumn("t", words)
    got = {r.source: r for r in mixed.groupBy("source").agg(F.sum("t").alias("t"), F.max("mix_weight").alias("w"), F.max("t").alias("m")).collect()}
    weights = {s: r.w for s, r in got.items()}
    assert math.isclose(sum(weights.values()), 1, rel_tol=1e-9)
    scale = whole * (target.budget or max(natural[s] / whole / w for s, w in weights.items()))
    for source, r in got.items():
        assert abs(r.t - scale * r.w) <= 25_000 and r.t <= scale * r.w + 1
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    repeats = max(scale * w / natural[s] for s, w in weights.items())
    assert repeats <= target.repetition + 1e-6
    powers = {s: math.log(weights[s] / weights["hot"]) / math.log(natural[s] / natural["hot"]) for s in weights if s != "hot"}
    assert max(powers.values()) - min(powers.values()) < 1e-6
    assert abs(entropy - target.entropy) < 1e-4 or abs(repeats - target.repetition) < 1e-3
    if target.budget is None:
        assert mixed.select("doc_id").distinct().count() == skewed.count()


def test_merged_sketches_equal_the_sketch_of_the_whole(spark):
    parts = spark.createDataFrame([(1, "a b c d e f g h"), (1, "x y z a b c d e f"), (2, "only five words are here"), (2, None)], "g int, text string")
    made = fingerprints.with_sketch(parts, k=4)
    merged = {r.g: r.sketch for r in fingerprints.merge_all(made, ["g"], k=4).collect()}
    rows = made.collect()
    for g in (1, 2):
        assert merged[g] == sorted({h for r in rows if r.g == g for h in r.sketch})[:4]


def slow_dialogue(turns, side):
    """The dialogue of turns (number, who, text) from one side: text and mask."""
    out, mask = "", []
    for _, who, said in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
        name = who if who == "system" else "assistant" if who == side else f"user name={who}"
        out += f"<|im_start|>{name}\n"
        if who == side:
            mask.append((len(out), len(out) + len(said) + 10))
        out += f"{said}<|im_end|>\n"
    return out, mask


def test_perspectives(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 70, "ann", None), (2, 0, "system", "alone"), (None, None, None, "x")],
        "conv_id long, turn long, role string, text string",
    )
    found = {(r.conv_id, r.perspective): r for r in chat.rotate(turns.withColumns({"part": F.lit("clash"), "x": F.lit(1), "n": F.lit(None), "of": F.lit(2)})).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann, bob = found[1, "ann"], found[1, "bob"]
    assert ann.text == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann.text[a:b] for a, b in ann.mask] == ["hi <| im_end|><|im_end|>", "<|im_end|>"] and ann.n_turns == 4
    assert [bob.text[a:b] for a, b in bob.mask] == ["yo<|im_end|>"]
    assert chat.rotate(turns.where("false")).count() == 0


def test_long_dialogues_are_one_row(spark):
    draw = random.Random(8)
    spoken = [(i * 100, draw.choice(["ann", "bob", "cy", "system"]), "é" * draw.randrange(40)) for i in range(500)]
    spoken += [(7, "ann", f"same number {i}") for i in range(200)] + [(None, "bob", "first"), (9, "cy", "long " * 100_000)]
    rows = [(1, *t) for t in spoken] + [(c, i, f"p{i}", f"hi {c}") for c in range(2, 60) for i in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = {(r.conv_id, r.perspective): r for r in chat.rotate(turns).collect()}
    assert len(found) == 3 + 58 * 3 and {r.part for r in found.values()} == {0}
    for side in ("ann", "bob", "cy"):
        text, mask = slow_dialogue(spoken, side)
        own = found[1, side]
        assert own.text == text and [*map(tuple, own.mask)] == mask and own.n_turns == 702


def test_parts_repeat_the_system_turns(spark):
    spoken = [(0, "system", "rules"), *((i, "ab"[i % 2], f"turn {i:03}") for i in range(1, 300)), (150, "system", "more rules")]
    turns = spark.createDataFrame([(1, *t) for t in spoken], "conv_id long, turn long, role string, text string").repartition(16)
    rows = sorted((r for r in chat.rotate(turns, part_chars=2500).collect() if r.perspective == "a"), key=lambda r: r.part)
    assert len(rows) > 1 and sum(r.n_turns for r in rows) == 301
    for r in rows:
        assert r.text.startswith("<|im_start|>system\nrules")
        assert ("more rules" in r.text) == (max(re.findall(r"turn (\d+)", r.text)) >= "150")
        assert all(r.text[a:b].startswith("turn") and r.text[a:b].endswith("<|im_end|>") for a, b in r.mask)
    assert sum(len(r.mask) for r in rows) == 149


def test_neighbours_of_uneven_ids(spark):
    ids = [*range(3000), 1 << 60, -(1 << 62), 5, 5, 5, None, None]
    rows = [(i, f"text {k} of {i}" if k % 7 else None) for k, i in enumerate(ids)] + [(77, "again and again"), (77, "again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("key"), "text")
    hashes = {(r.key.doc_id, r.text): r.key.hash for r in keyed.collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r]))
    expected = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        expected.append((i, t, after[: len(t) // 2]))
    found = [(r.doc_id, r.text, r.next_start) for r in fingerprints.with_next(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    made = fingerprints.next_keys(keyed.select("key").distinct().repartition(4))
    assert made.count() == made.select("next").distinct().count()
    ranges = docs.select("doc_id").distinct().repartitionByRange(4, F.desc_nulls_last("doc_id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 2 * 3000 / 4


def test_quality_on_held_out_rows(spark):
    from lorekeep.llm import queries

    found = queries.op10_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = [r for r in found.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = np.array([r.log_weight for r in rows if r.quality])
    bad = np.array([r.log_weight for r in rows if not r.quality])
    assert (good[:, None] > bad).mean() > 0.98


def test_kth_largest_with_ties(spark, monkeypatch):
    monkeypatch.setattr(quality, "ENOUGH", 20)
    draw = random.Random(3)
    data = [(draw.choice([1.0, 2.0, draw.random() * 100]), i) for i in range(500)]
    rows = spark.createDataFrame(data, "key double, tie long")
    for k in (1, 100, 333, 500, 900):
        assert quality.kth_largest(rows, k) == sorted(data, reverse=True)[min(k, 500) - 1]
    assert quality.kth_largest(rows, 0) is None and quality.kth_largest(rows.where("false"), 3) is None


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
