"""Sources and stores that change: the change log, parted tables, the outbox, keyed state in streams."""

from __future__ import annotations

import datetime
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import search
from lorekeep.operators.text_index import TextIndex
from lorekeep.operators.vector_blocks import VectorBlocks
from lorekeep.plans import cluster_queries
from lorekeep.sources.changelog import ChangeLog
from lorekeep.sources.parts import PartedTable, delete_cascade, part_of
from lorekeep.streaming import outcomes
from lorekeep.streaming.outbox import Outbox, follow

CHANGE = "sequence long, id string, kind string, payload string"


def run(frame, name, folder, **options):
    writer = frame.writeStream.format("memory").queryName(name).options(**options).option("checkpointLocation", str(folder)).trigger(availableNow=True)
    writer.start().awaitTermination()


def test_change_log_is_read_once_by_a_stream_that_begins_again(spark, tmp_path):
    spark.dataSource.register(ChangeLog)
    path, out = str(tmp_path / "log"), str(tmp_path / "out")

    def append(low, high):
        rows = spark.range(low, high).selectExpr("id AS sequence", "CAST(id % 7 AS STRING) AS id", "'edit' AS kind", "concat('é\\n\"', id) AS payload")
        rows.repartitionByRange(3, "sequence").write.format("changelog").mode("append").save(path)

    def stream():
        changes = spark.readStream.format("changelog").schema(CHANGE).load(path)
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(CHANGE).parquet(out).collect())

    def table(**options):
        return sorted(tuple(r) for r in spark.read.format("changelog").options(**options).schema(CHANGE).load(path).collect())

    assert spark.read.format("changelog").schema(CHANGE).load(path).count() == 0
    append(0, 50)
    assert stream() == table() and len(table()) == 50
    append(50, 80)
    append(80, 81)
    assert stream() == table() == sorted((i, str(i % 7), "edit", f'é\n"{i}') for i in range(81))
    assert stream() == table() and [r[0] for r in table(above=70)] == list(range(71, 81))


def test_a_failed_write_leaves_no_segment(spark, tmp_path):
    spark.dataSource.register(ChangeLog)
    path = str(tmp_path / "log")
    broken = spark.range(20).selectExpr("IF(id = 13, raise_error('no'), id) AS sequence", "'a' AS id", "'b' AS kind", "'c' AS payload").repartition(4)
    with pytest.raises(Exception, match="no"):
        broken.write.format("changelog").mode("append").save(path)
    assert spark.read.format("changelog").schema(CHANGE).load(path).count() == 0
    with pytest.raises(Exception, match="appended"):
        spark.range(1).selectExpr("id AS sequence").write.format("changelog").mode("overwrite").save(path)


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, x in os.walk(path) for f in x if f.endswith(".parquet")}


def test_replacing_a_file_leaves_other_parts_alone(spark, tmp_path):
    path = str(tmp_path / "symbols")
    table = PartedTable(spark, path, "file", "file string, symbol long", parts=8)
    rows = spark.range(200).selectExpr("concat('f', id % 20) AS file", "id AS symbol")
    table.replace(rows.select("file"), rows)
    assert table.read().count() == 200
    before = files(path)
    part = spark.range(1).select(part_of(F.lit("f3"), 8).alias("p")).first().p
    new = spark.createDataFrame([("f3", 1000), ("f3", 1001)], "file string, symbol long")
    assert table.replace(new, new) == [part]
    after = files(path)
    kept = {f: t for f, t in before.items() if f"part={part}/" not in f}
    assert {f: t for f, t in after.items() if f"part={part}/" not in f} == kept and len(kept) < len(before)
    assert Counter(r.file for r in table.read().collect()) == {f"f{k}": 2 if k == 3 else 10 for k in range(20)}
    failing = new.withColumn("symbol", F.when(F.col("symbol") > 0, F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        table.replace(new, failing)
    assert files(path) == after
    with pytest.raises(ValueError):
        table.replace(new.where("false"), new)
    every = rows.select("file").distinct()
    assert table.delete(every) and table.read().count() == 0 and not files(path)


def test_a_cascade_rewrites_the_parts_of_what_goes(spark, tmp_path):
    names = {"profile": "profile long", "memory": "memory long, profile long", "edge": "edge long, memory long"}
    tables = {n: PartedTable(spark, str(tmp_path / n), n, s, parts=16) for n, s in names.items()}
    data = {"profile": spark.range(5).toDF("profile"), "memory": spark.range(40).selectExpr("id AS memory", "id % 5 AS profile"), "edge": spark.range(90).selectExpr("id AS edge", "id % 45 AS memory")}
    for n, rows in data.items():
        tables[n].replace(rows.select(n), rows)
    before = files(str(tmp_path))
    touched = delete_cascade(tables, "profile", spark.createDataFrame([(3,)], "profile long"), [("memory", "profile", "profile"), ("edge", "memory", "memory")])
    assert {r.profile for r in tables["memory"].read().collect()} == {0, 1, 2, 4} and tables["profile"].read().count() == 4
    assert {r.edge for r in tables["edge"].read().collect()} == {e for e in range(90) if e % 45 >= 40 or e % 45 % 5 != 3}
    after = files(str(tmp_path))
    for f, t in before.items():
        name, part = f.split("/")[-3], int(f.split("part=")[1].split("/")[0])
        assert part in touched[name] or after[f] == t
    assert len(touched["profile"]) == 1


def test_poison_rows_leave_after_their_attempts_and_healthy_ones_once(spark, tmp_path):
    outbox = Outbox(spark, str(tmp_path / "box"), size=6, most=3)
    memories = spark.createDataFrame([(i,) for i in range(12) if i != 5], "id long")
    asked = []

    def embed(rows):
        found = [r.memory_id for r in rows.collect()]
        asked.extend(found)
        return spark.createDataFrame([(i, [float(i)]) for i in found if i not in (1, 2)], "memory_id long, vector array<double>")

    at = datetime.datetime(2024, 1, 1)
    outbox.enqueue(spark.createDataFrame([(i, at + datetime.timedelta(days=i)) for i in range(12)] + [(0, at)], "memory_id long, enqueued_at timestamp"), 0)
    outbox.drain(memories, embed, 1)
    first = {r.memory_id: r.outcome for r in outbox.results().collect()}
    assert first == {0: "succeeded", 1: "failed", 2: "failed", 3: "succeeded", 4: "succeeded", 5: "orphaned"}
    outbox.drain(memories, embed, 1)  # once more, as after a failure
    assert {r.memory_id: r.outcome for r in outbox.results().collect()} == first
    for batch in range(2, 6):
        outbox.drain(memories, embed, batch)
    found = Counter((r.memory_id, r.outcome) for r in outbox.results().collect())
    assert found == Counter([(i, "succeeded") for i in range(12) if i not in (1, 2, 5)] + [(5, "orphaned")] + 3 * [(1, "failed"), (2, "failed")] + [(1, "abandoned"), (2, "abandoned")])
    assert outbox.waiting().count() == 0 and Counter(asked)[1] == 4 and Counter(asked)[7] == 1 and 5 not in asked


def test_outbox_follows_a_stream(spark, tmp_path):
    rows = spark.range(9).selectExpr("id AS memory_id", "timestamp_seconds(id) AS enqueued_at").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outbox = Outbox(spark, str(tmp_path / "box"))
    memories = spark.range(9)
    follow(outbox, arrivals, lambda: memories, lambda x: x.selectExpr("memory_id", "array(1D) AS vector"), str(tmp_path / "c")).awaitTermination()
    outbox.drain(memories, lambda x: x.selectExpr("memory_id", "array(1D) AS vector"), 99)
    assert Counter((r.memory_id, r.outcome) for r in outbox.results().collect()) == Counter((i, "succeeded") for i in range(9))


def test_new_outcomes_in_a_stream_are_those_of_the_table(spark, tmp_path):
    every = cluster_queries.trace_outcomes(spark, "/root/testdata/sf0.001").withColumn("batch", F.floor(F.col("place") / 200)).cache()
    stored = every.where("batch = 0").groupBy("signature").agg(F.max_by("status", "place").alias("status"), F.max_by("digest", "place").alias("digest"))
    rest = every.where("batch > 0")
    for n in sorted(r.batch for r in rest.select("batch").distinct().collect()):
        rest.where(F.col("batch") == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n:03}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = spark.readStream.schema(rest.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run(outcomes.changed_outcomes(feed, stored), "told", tmp_path / "c", outputMode="append")
    finally:
        spark.conf.unset(key)
    expected = sorted(r.place for r in outcomes.changed_outcomes(rest, stored).collect())
    assert sorted(r.place for r in spark.table("told").collect()) == expected and 0 < len(expected) < rest.count()


def test_index_scores_as_a_scan_does_through_changes(spark, tmp_path):
    chance, words = random.Random(4), [f"w{i}" for i in range(40)]
    texts = {i: " ".join(chance.choices(words, weights=range(40, 0, -1), k=chance.randrange(1, 30))) for i in range(300)}
    texts[7], texts[8], texts[9] = "rare rare word", "", None
    index = TextIndex(spark, str(tmp_path / "index"), parts=8, buckets=32)
    asked = spark.createDataFrame([(1, ["rare", "w1", "w1"]), (2, ["w3", "w30"]), (3, ["nothing"]), (4, ["w0"])], "query_id long, terms array<string>")

    def check():
        live = spark.createDataFrame([(i, t) for i, t in texts.items() if t is not None], "id long, content string")
        expected = search.ranked(search.bm25(live, asked), 10, [F.desc(F.round("score", 9)), F.col("id")])
        assert [(r.query_id, r.id, r.rank, round(r.score, 9)) for r in index.search(asked, 10).orderBy("query_id", "rank").collect()] == [
            (r.query_id, r.id, r.rank, round(r.score, 9)) for r in expected.orderBy("query_id", "rank").collect()
        ]

    def apply(changed):
        texts.update(changed)
        return index.apply(spark.createDataFrame([*changed.items()], "id long, content string"))

    assert index.search(asked).count() == 0
    apply(texts)
    check()
    apply({7: "w1 w2", 20: None, 21: "rare w30 w30", 400: "w3 w0", 9999: None})
    check()
    apply({7: None, 20: "w0 again", 21: "rare"})
    before = files(str(tmp_path / "index"))
    check()
    assert files(str(tmp_path / "index")) == before
    os.remove(str(tmp_path / "index" / "totals" / "gen=3" / "_SUCCESS"))  # as if the last one had failed at its end
    apply({7: None, 20: "w0 again", 21: "rare"})
    check()
    _, _, read = index.bounds(asked.where("query_id = 4"))
    assert len(read) == 1


def test_index_leaves_out_buckets_that_cannot_win(spark, tmp_path):
    data = spark.range(4000).selectExpr("id", "concat('common ', IF(id % 97 = 0, repeat('rare ', 1 + CAST(id % 5 AS INT)), concat('filler', id))) AS content")
    index = TextIndex(spark, str(tmp_path / "index"), parts=4, buckets=512)
    index.apply(data)
    asked = spark.createDataFrame([(1, ["common", "rare"])], "query_id long, terms array<string>")
    hits, looked = index.explain(asked, 5)
    expected = search.ranked(search.bm25(data, asked), 5, [F.desc(F.round("score", 9)), F.col("id")])
    assert [(r.id, round(r.score, 9)) for r in hits.orderBy("rank").collect()] == [(r.id, round(r.score, 9)) for r in expected.orderBy("rank").collect()]
    row = looked.first()
    assert row.looked < row.all / 10


def test_an_index_shuffles_no_postings_that_are_not_asked_for(spark, tmp_path):
    """Postings and blocks meet a question where they are read; what comes to a block and what goes from it is one row of a generation."""
    index = TextIndex(spark, str(tmp_path / "index"), parts=4, buckets=8)
    docs = spark.range(200).select("id", F.concat(F.lit("all w"), F.col("id") % 9).alias("content"))
    index.apply(docs)
    index.apply(docs.where("id % 3 = 0").withColumn("content", F.concat(F.lit("all v"), F.col("id") % 9)))
    second = index._table("blocks").where("gen = 2")
    assert second.count() == second.select("term", "bucket").distinct().count()
    held = index._table("blocks").groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
    assert {(r.term, r.n) for r in held.collect()} == {("all", 200)} | {(f"{'v' if n % 3 == 0 else 'w'}{n}", len(range(n, 200, 9))) for n in range(9)}
    asked = spark.createDataFrame([(1, ["w1", "all"])], "query_id int, terms array<string>")
    weighed, bound, parts = index.bounds(asked)
    plan = index._scores(weighed, bound.select("query_id", "bucket"), parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2
    assert [r.id for r in index.search(asked, 3).collect()] == [1, 10, 19]


def test_blocks_find_what_a_scan_finds_and_leave_out_far_ones(spark, monkeypatch):
    monkeypatch.setattr("lorekeep.operators.vector_blocks.SEAT", 50)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 8)) * 30
    laid = [[float(x) for x in centres[i % 20] + draw.normal(size=8)] for i in range(1500)]
    laid[1:300] = [laid[0]] * 299  # one vector held by a fifth of the rows
    data = [(i, v) for i, v in enumerate(laid)] + [(5000, None), (5001, [1.0, 2.0])]
    vectors = spark.createDataFrame(data, "id long, v array<double>")
    asked = spark.createDataFrame([(i, laid[i]) for i in (0, 7, 400, 1499)] + [(-1, [0.0] * 8), (-2, None), (-3, [1.0])], "query_id long, q array<double>")
    blocks = VectorBlocks(vectors, 8)
    for k in (1, 7, 400):
        hits, looked = blocks.explain(asked, k)
        expected = search.nearest(vectors, asked, k)
        got = sorted((r.query_id, r.rank, r.id, round(r.distance, 6)) for r in hits.collect())
        assert got == sorted((r.query_id, r.rank, r.id, round(r.distance, 6)) for r in expected.where("query_id <> -3").collect())
        if k < 100:
            shares = {r.query_id: r.looked / r.all for r in looked.collect()}
            assert shares[400] < 1 / 3 and shares[1499] < 1 / 3
    assert VectorBlocks(vectors.where("false"), 8).nearest(asked, 3).count() == 0
    assert blocks.nearest(asked.where("false"), 3).count() == 0
