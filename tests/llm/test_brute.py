"""Whole results of op5, op7, op8, op10 and the pipeline against slow versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import bpe, mixing, quality, queries, secret_scan, simhash
from tests.llm.test_toxicity import slow_logit

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest table with near copies, repeated lines, a hot source, nulls, repeated rows and a clashing extra column."""
    draw, path = random.Random(1), str(tmp_path_factory.mktemp("brute"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    own = 10_000
    for i in range(25):
        base = [draw.choice(["red", "blue", "green", "gold"]) + str(draw.randrange(500)) for _ in range(draw.randrange(6, 200))]
        for changes in (0, 1, 2, 4):
            near = base.copy()
            for at in draw.sample(range(len(base)), min(changes, len(base))):
                near[at] = f"changed{draw.randrange(99)}"
            docs.append((own, " ".join(near) + ("\n" + " ".join(near[-6:])) * (i % 3), f"s{own % 3}"))
            own += 1
    docs += [(own, None, None), (own + 1, "", "s1"), (own + 2, " \n", "s1"), (None, "no id", "s2"), (own + 3, "twice", "s0"), (own + 3, "twice", "s0")]
    docs += [(own + 4, "word " * 20_000, "long"), (own + 5, "pwd: hunter22 at host: db.example.org user=ann ſecret=abcdefgh tokeN: abcdefgh", "s2")]
    rows = [(i, t, "en", s, None, "x", 3) for i, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, own int").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def texts(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def both_cases(pattern):
    """A pattern whose (?i:...) parts match ASCII letters of either case and no others."""

    def either(x):
        if len(x[0]) == 1:
            return f"[{x[0]}{x[0].upper()}]"
        return x[0].replace("a-z", "a-zA-Z")

    def group(m):
        return "(?:" + re.sub(r"\\x..|\[[^]]*\]|[a-z]", either, m[1])

    out, at = "", 0
    for m in re.finditer(r"\(\?i:", pattern):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(pattern[end], 0)
            end += 1
        out += pattern[at : m.start()] + group(re.match(r"(.*)", pattern[m.end() : end], re.S))
        at = end
    return out + pattern[at:]


def test_op5_spans(spark, folder):
    expected = []
    for ident, text in texts(spark, folder):
        found = []
        for place, part in enumerate(secret_scan.PARTS):
            for m in re.finditer(both_cases(part.pattern), text):
                if len(m[part.group]) >= part.least:
                    found.append((m.start(), place, m.end()))
        kept = []
        for start, place, end in found:
            part = secret_scan.PARTS[place]
            others = [secret_scan.PARTS[p].role == "secret" for s, p, _ in found if abs(s - start) <= secret_scan.SCOPE]
            if part.base or (not all(others) if part.role == "secret" else any(others)):
                kept.append((start, place, end))
        expected.append((ident, ",".join(f"{secret_scan.PARTS[p].kind}:{s}:{e}" for s, p, e in sorted(kept))))
    found = [(r.doc_id, r.spans) for r in queries.op5_secret_scan(spark, folder).collect()]
    assert Counter(found) == Counter(expected) and any("phrase" in s for _, s in found)


def slow_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for word in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    return "".join(f"{h % (1 << 64):016x}" for h in sorted(hashes)[:64])


def test_op8_fingerprints(spark, folder):
    known = Counter((i, slow_sketch(t), len(t)) for i, t in texts(spark, folder))
    found = queries.op8_fingerprints(spark, folder).collect()
    assert Counter((r.doc_id, r.fingerprint, r.n_chars) for r in found) == known
    pages = {r.doc_id: r for r in found}
    rows = texts(spark, folder)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:]):
        if sum(x[0] == i for x in order) == 1:
            half = len(t) // 2
            assert pages[i].edited_fingerprint == slow_sketch(t[: len(t) - half] + after[:half])


def slow_mix(rows, orders, target):
    """(position, epoch) of every occurrence; rows: (source, tokens); orders(epoch): the order of each row's occurrence in an epoch."""
    tokens = defaultdict(int)
    for source, n in rows:
        tokens[source] += n
    whole = sum(tokens.values())
    shares = {s: n / whole for s, n in tokens.items() if n}

    def weights(e):
        powers = {s: p**e for s, p in shares.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    def entropy(e):
        return -sum(w * math.log(w) for w in weights(e).values())

    def repeats(e):
        w = weights(e)
        scale = max(shares[s] / w[s] for s in shares) if target.budget is None else target.budget
        return {s: w[s] * scale / shares[s] for s in shares}

    def least(fails):
        """The least e in 0..1 from which `fails` no longer holds (it holds at first or never)."""
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if fails(middle) else (low, middle)
        return high

    wanted = target.entropy * math.log(len(shares)) if shares else 0
    flat = least(lambda e: entropy(e) >= wanted - 1e-12) if entropy(1) < wanted else 1.0
    calm = least(lambda e: max(repeats(e).values()) > target.repetition) if max(repeats(0).values()) > target.repetition else 0.0
    final = repeats(max(flat, calm))
    out = []
    for source in tokens:
        own = [i for i, r in enumerate(rows) if r[0] == source]
        r = final.get(source, 1.0)
        full = math.floor(r + 1e-9)
        out += [(i, e) for i in own for e in range(full)]
        left, at = (r - full) * tokens[source] + 1e-3, orders(full)
        for i in sorted(own, key=at.__getitem__):
            left -= rows[i][1]
            if left < 0:
                break
            if tokens[source]:
                out.append((i, full))
    return out


def mixed(spark, docs, target=mixing.Target()):
    """What slow_mix says of docs, as (doc_id, text, epoch)."""
    ident = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("s"), ident.alias("i")).collect()
    keys = spark.createDataFrame([(k, r.i) for k, r in enumerate(rows)], "k int, i long").cache()

    def orders(epoch):
        return {r.k: r.o for r in keys.select("k", mixing._order(target.seed, F.lit(epoch), F.col("i")).alias("o")).collect()}

    sizes = [(r.s, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in rows]
    return [(rows[i].doc_id, rows[i].text, e) for i, e in slow_mix(sizes, orders, target)]


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(entropy=0.99, repetition=50), mixing.Target(repetition=1.2)])
def test_op7_occurrences(spark, folder, target):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r.doc_id, r.text or "", r.mix_epoch) for r in mixing.mix(docs, target).collect())
    assert got == Counter(mixed(spark, docs, target))
    if target == mixing.Target():
        assert Counter((r.doc_id, r.mix_epoch) for r in queries.op7_mixing(spark, folder).collect()) == Counter({(i, e): 0 for i, _, e in got}) + Counter(
            (i, e) for (i, _, e), n in got.items() for _ in range(n)
        )


def slow_features(text, size):
    hashes = [zlib.crc32(p.encode()) for p in quality.PIECE.findall(text.lower())]
    out = [h % size for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        two = (a * 0x9E3779B1 + b * 0x85EBCA6B) % 2**64
        two = (two ^ two >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 32
        out.append(two % size)
    return out


def test_op10_selection(spark, folder):
    settings = quality.Settings()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("tie"))
    docs = docs.withColumn("noise", quality.gumbel(settings.seed, F.col("tie"))).collect()
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    target, every = Counter(), Counter()
    features = [slow_features(r.text, settings.buckets) for r in docs]
    for r, found in zip(docs, features):
        every.update(found)
        if r.doc_id in good:
            target.update(found)
    sums = [sum(x.values()) + settings.buckets for x in (target, every)]
    ratio = [math.log((target[b] + 1) / sums[0]) - math.log((every[b] + 1) / sums[1]) for b in range(settings.buckets)]
    weights = [sum(ratio[b] for b in found) for found in features]
    best = sorted(((w + r.noise, r.tie, k) for k, (w, r) in enumerate(zip(weights, docs))), reverse=True)
    last = best[round(settings.keep * len(docs)) - 1][:2]
    expected = [(r.doc_id, len(f), round(w, 6), (w + r.noise, r.tie) >= last) for r, f, w in zip(docs, features, weights)]
    found = [(r.doc_id, r.n_features, round(r.log_weight, 6), r.selected) for r in queries.op10_quality(spark, folder).collect()]
    by = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    for got, want in zip(by(found), by(expected), strict=True):
        assert got[:2] == want[:2] and got[3] == want[3] and got[2] == pytest.approx(want[2], abs=1e-4)


def as_rows(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_stages_and_pipeline(spark, folder):
    """Each stage against its slow version, on what its predecessor left, and run() against all of them."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    settings = queries.toxicity.Settings()
    rows = as_rows(docs)
    clean = [(i, t) for i, t in rows if slow_logit(t, *model, settings) < 0]
    assert 0 < len(clean) < len(rows)
    kept = stages["toxicity"](spark, docs, folder).checkpoint()
    assert Counter(as_rows(kept)) == Counter(clean)

    groups = defaultdict(list)
    for i, t in clean:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append((math.inf if i is None else i, t))
    ones = [min(g) for g in groups.values()]
    kept = stages["exact_dedup"](spark, kept, folder).checkpoint()
    assert Counter(i for i, _ in as_rows(kept)) == Counter(None if i == math.inf else i for i, _ in ones)

    rows = as_rows(kept)
    sets = [{*simhash.shingle_hashes(t, 5).tolist()} for _, t in rows]
    root = [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for h in s or {None}:
            holders[h].append(k)
    for held in holders.values():
        for b in held:
            for a in held:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    members = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        members[find(k)].append((math.inf if i is None else i, t))
    heads = [min(g) for g in members.values()]
    assert len(heads) < len(rows)
    kept = stages["simhash_near_dedup"](spark, kept, folder).checkpoint()
    assert Counter(i for i, _ in as_rows(kept)) == Counter(None if i == math.inf else i for i, _ in heads)

    expected = Counter((i, t) for i, t, _ in mixed(spark, kept))
    kept = stages["mixing"](spark, kept, folder).checkpoint()
    assert kept.columns == docs.columns and Counter(as_rows(kept)) == expected

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codes = Counter((i, tuple(coder.encode_ordinary(t))) for i, t in expected.elements())
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in out) == codes
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)


def test_stages_on_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_recall_of_near_copies(spark):
    """Of some thousand pairs of likeness 0.8 or more, short texts among them, none is lost."""
    draw, made = random.Random(11), []
    for size in [*range(5, 25)] * 6 + [40, 80, 160, 320] * 60:
        base = [f"w{draw.randrange(5000)}" for _ in range(size)]
        made.append(base)
        for _ in range(4):
            near = base.copy()
            for at in draw.sample(range(size), max(1, size // 60)):
                near[at] = "other"
            made.append(near if draw.random() < 0.5 else [*base, "end"])
    sets = [{tuple(m[i : i + 5]) for i in range(max(1, len(m) - 4))} for m in made]
    pairs = [(a, b) for k in range(0, len(made), 5) for b in range(k, k + 5) for a in range(k, b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) >= 1000
    docs = spark.createDataFrame([(i, " ".join(m)) for i, m in enumerate(made)], "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    lost = [(a, b) for a, b in pairs if of[a] != of[b]]
    assert not lost, np.array(lost)
