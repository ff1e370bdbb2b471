"""The store of versions, micro-batches that run again, and streams that go on from their state."""

import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from memspark.operators import kg, transcripts, versions
from memspark.streaming import jobs


def rows_of(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], "id string, wing string, content string, filed_at string")


def content(df):
    return sorted((r["id"], r["wing"], r["content"]) for r in df.collect())


def test_changes_rewrite_the_wings_they_touch(spark, tmp_path):
    store = versions.DrawerStore(spark, str(tmp_path / "store"), files_per_wing=1).create()
    assert store.create().versions() == [0] and store.read().count() == 0
    assert store.append(rows_of(spark, ("1", "a/b", "x", "1"), ("2", "c", "y", "1"), ("3", "", "z", "1"), ("4", "c", "v", "1"))) == 1
    assert store.upsert(rows_of(spark, ("2", "c", "new", "2"), ("4", "c", "old", "0"))) == 2
    one, two = (dict((w, f) for f, w in store.folders(n)) for n in (1, 2))
    assert {w for w in one if one[w] != two[w]} == {"c"}
    assert content(store.read()) == [("1", "a/b", "x"), ("2", "c", "new"), ("3", "", "z"), ("4", "c", "v")]
    assert content(store.read(1))[1] == ("2", "c", "y") and content(store.read(wings=["a/b"])) == [("1", "a/b", "x")]
    # A row that moves leaves its old wing.
    store.upsert(rows_of(spark, ("1", "c", "moved", "3")))
    assert content(store.read()) == [("1", "c", "moved"), ("2", "c", "new"), ("3", "", "z"), ("4", "c", "v")]
    store.delete(rows_of(spark, ("4", "", "", ""), ("none", "", "", "")))
    store.append(rows_of(spark, ("5", "c", "more", "1")))
    before, n = content(store.read()), len(store.folders())
    assert store.delete(rows_of(spark, ("none", "", "", ""))) == store.versions()[-1]
    store.compact()
    assert content(store.read()) == before and len(store.folders()) == n - 1
    assert content(store.read(1)) == [("1", "a/b", "x"), ("2", "c", "y"), ("3", "", "z"), ("4", "c", "v")]


def test_a_batch_that_was_broken_off_counts_once(spark, tmp_path, monkeypatch):
    """A micro-batch that fails after its write, one that fails after its version, and the run that follows each."""
    kind = "rel_path string, source_file string, source_mtime double, text string"
    files = lambda n: spark.createDataFrame([(f"notes/{i}.md", f"/s/{i}.md", 5.0, f"text {i} " * 60) for i in range(n, n + 3)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = versions.DrawerStore(spark, str(tmp_path / "store"), files_per_wing=1).create()
    run = lambda: jobs.mine_into(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), store, str(tmp_path / "state"), "w", "files").awaitTermination()
    commit = versions.DrawerStore.commit

    def before(self, folders, after):
        raise OSError("lost before the version")

    def behind(self, folders, after):
        commit(self, folders, after)
        raise OSError("lost behind the version")

    files(0)
    for broken in (before, behind):
        monkeypatch.setattr(versions.DrawerStore, "commit", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    monkeypatch.setattr(versions.DrawerStore, "commit", commit)
    run()
    got = store.read()
    assert got.select("source_file").distinct().count() == 3 and got.count() == got.select("id").distinct().count() and store.versions() == [0, 1]
    files(3)
    run()
    run()
    assert store.read().select("source_file").distinct().count() == 6 and store.versions() == [0, 1, 2]


def test_workers_get_few_texts_at_once(spark, tmp_path, monkeypatch):
    """What reaches a Python worker while files are mined is bounded by bytes, however many files a task has; the user's session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    files = spark.range(400, numPartitions=1).select(F.format_string("notes/%d.md", "id").alias("rel_path"), F.format_string("/s/%d.md", "id").alias("source_file"), F.lit(5.0).alias("source_mtime"), F.expr("repeat('word ', 20000)").alias("text"))
    files.write.parquet(str(tmp_path / "in"))

    @F.arrow_udf("long")
    def handed(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    def sizes(batch, stored, wing):
        return batch.coalesce(1).select(F.col("source_file").alias("id"), "source_file", F.lit(wing).alias("wing"), handed("text").cast("string").alias("content"))

    store, held = versions.DrawerStore(spark, str(tmp_path / "store"), files_per_wing=1).create(), spark.conf.get(name)
    monkeypatch.setattr(jobs, "mine_project", sizes)
    jobs.mine_into(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "state"), "w", "files").awaitTermination()
    got = [int(r["content"]) for r in store.read().select("content").collect()]
    assert len(got) == 400 and max(got) <= jobs.ARROW_BYTES + 200_000
    assert spark.conf.get(name) == held


def test_chunks_are_passed_on_by_their_size(spark, monkeypatch):
    """Long texts are not held with 63 others; all rows come, in their order, null and empty ones with no chunk."""
    held = []
    plain = transcripts.pa.array
    monkeypatch.setattr(transcripts.F, "arrow_udf", lambda kind: lambda f: lambda text: held.append(f) or F.array(F.lit("x")))
    transcripts.chunk_text(spark.range(1).select(F.lit("t").alias("text")))
    monkeypatch.undo()
    texts = [None, "", *("word " * 100_000 for _ in range(20)), "short " * 20, *[None] * 200]
    made = [part.to_pylist() for part in held[0](iter([plain(texts[:5]), plain(texts[5:5], "string"), plain(texts[5:])]))]
    assert [x for part in made for x in part] == [transcripts.cut(x) for x in texts]
    assert max(sum(map(len, x)) for part in made for x in [[c for text in part for c in text]]) < transcripts.CHUNKED_CHARS + 700_000
    assert max(map(len, made)) <= 64


def test_folder_tables_start_no_python(spark, tmp_path):
    """Neither a version's table nor an empty store's rows come out of a Python worker."""
    store = versions.DrawerStore(spark, str(tmp_path / "store")).create()
    seen = []
    commit = DataFrameWriter.parquet

    def parquet(self, path, *how, **more):
        seen.append(self._df._jdf.queryExecution().toRdd().toDebugString())
        return commit(self, path, *how, **more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", parquet)
        assert store.commit([("batch=a/wing=w", "w"), ("batch=b/wing=__", "")], 0) == 1
        versions.DrawerStore(spark, str(tmp_path / "other")).create()
    none = versions.DrawerStore(spark, str(tmp_path / "other")).read()
    seen.append(none._jdf.queryExecution().toRdd().toDebugString())
    assert len(seen) == 3 and not any("PythonRDD" in x for x in seen)
    assert store.versions() == [0, 1] and store.folders() == [("batch=a/wing=w", "w"), ("batch=b/wing=__", "")] and store.folders(0) == []
    assert none.count() == 0 and [(f.name, f.dataType) for f in none.schema] == [(f.name, f.dataType) for f in versions.DRAWER]


EVENTS = "seq long, subject string, predicate string, object string, valid_from string, valid_to string, ended string"


def test_triples_by_keyed_state(spark, tmp_path):
    """Two micro-batches against one batch after another of `add_triples` and `invalidate`; the second reads no file of the first."""
    known = spark.createDataFrame([("t0", "a", "p", "b", "2019", None, 1.0, None, None, ""), ("t1", "a", "p", "c", "2019", "2020", 1.0, None, None, "")], kg.TRIPLE)
    source = str(tmp_path / "in")
    run = lambda rows, start: (
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source),
        jobs.keyed_triples(spark.readStream.schema(EVENTS).parquet(source), str(tmp_path / "kg"), str(tmp_path / "state"), start, "2026-01-01").awaitTermination(),
    )
    with jobs.keyed_state(spark):
        run([(1, "A", "P", "B", "2020", None, None), (2, "A", "P", "C", "2020", None, None), (3, "A", "P", "D", "2021", None, None), (4, "A", "P", "D", None, None, ""), (5, "A", "P", "D", "2022", None, None)], known)
        first = spark.read.parquet(str(tmp_path / "kg/log"))
        assert sorted((r["event"], r["object"], r["seq"]) for r in first.collect()) == [("added", "c", 2), ("added", "d", 3), ("added", "d", 5), ("ended", "d", 4)]
        run([(6, "A", "p", "b", None, None, "2025"), (7, "a", "p", "b", "2025", None, None), (8, "a", "p", "d", "2026", None, None), (9, "a", "q", "d", "2020", "2021", None), (10, "a", "q", "d", "2020", "2021", None)], None)
    rows = sorted((r["predicate"], r["object"], r["valid_from"], r["valid_to"]) for r in jobs.logged_triples(spark, str(tmp_path / "kg"), known).collect())
    want = [("p", "b", "2019", "2025"), ("p", "b", "2025", None), ("p", "c", "2019", "2020"), ("p", "c", "2020", None), ("p", "d", "2021", "2026-01-01"), ("p", "d", "2022", None), ("q", "d", "2020", "2021"), ("q", "d", "2020", "2021")]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_idle_sessions_over_event_time(spark, tmp_path):
    """A stream in three runs, rows out of order within one, against the table at once; sessions end where they fall silent."""
    kind = "session_id string, role string, content string, ts timestamp, id long"
    minute = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    batches = [[("a", 1), ("b", 2), ("a", 0), ("a", 3)], [("a", 5), ("b", 40), ("b", 41), ("c", 42)], [("a", 90), ("b", 91), ("a", 92), ("a", 93), ("c", 44 + 50), ("b", 95)]]
    every, n = None, 0
    for batch in batches:
        made = []
        for name, m in batch:
            n += 1
            made.append((name, "user", "hello", minute(m), n))
        df = spark.createDataFrame(made, kind)
        every = df if every is None else every.unionByName(df)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with jobs.keyed_state(spark):
            stream = jobs.save_checkpoints(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 2, idle_ms=30 * 60_000, lateness="5 minutes")
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.select("session_id", "n", "since_last").collect())
    got = rows(spark.read.schema(jobs.CHECKPOINT).parquet(str(tmp_path / "out")))
    assert got == rows(jobs.idle_checkpoints_batch(every, 30 * 60_000, 2)) == [("a", 2, 2), ("a", 2, 2), ("a", 4, 2), ("b", 2, 2), ("b", 2, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") is not None


def test_state_of_idle_sessions_goes():
    """The state and its timer, with the handle that Spark gives played by the test."""

    class Handle:
        counts, timers = None, []

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.counts is not None

        def get(self):
            return self.counts

        def update(self, counts):
            self.counts = counts

        def clear(self):
            self.counts = None

        def listTimers(self):
            return self.timers

        def deleteTimer(self, at):
            self.timers = [x for x in self.timers if x != at]

        def registerTimer(self, at):
            self.timers = [*self.timers, at]

    handle, kept = Handle(), jobs.SaveEvery(3, idle_ms=50)
    kept.init(handle)
    told = lambda *ms: [tuple(x) for f in kept.handleInputRows(("a",), iter([pd.DataFrame({"ms": ms, "id": range(len(ms))})]), None) for x in f.itertuples(index=False)]
    assert told(0, 10) == [] and handle.timers == [60]
    assert told(30, 20) == [("a", 3, 3)] and handle.timers == [80] and handle.counts == (4, 3, 30)
    assert told(81) == [] and handle.counts == (1, 0, 81) and handle.timers == [131]
    assert sum(len(f) for f in kept.handleExpiredTimer(("a",), None, None)) == 0 and not handle.exists()


def test_triples_share_states(spark, tmp_path):
    """Many triples take no more states than there are buckets; null is a name of its own, and the store's rows are the first state."""
    names = [None, "a b", *(f"n{i}" for i in range(600))]
    known = spark.createDataFrame([(f"k{i}", f"n{i}", "p", "o", "2019", None, 1.0, None, None, "") for i in range(0, 600, 3)], kg.TRIPLE)
    adds = spark.createDataFrame([(i, x, "p", "o", "2020", None, None) for i, x in enumerate([*names, *names])], EVENTS)
    ends = spark.createDataFrame([(5000 + i, x, "p", "o", None, None, "") for i, x in enumerate(names[:102])], EVENTS)
    source = str(tmp_path / "in")
    for rows, start in ((adds, known), (ends, None)):
        rows.write.mode("append").parquet(source)
        with jobs.keyed_state(spark):
            query = jobs.keyed_triples(spark.readStream.schema(EVENTS).parquet(source), str(tmp_path / "kg"), str(tmp_path / "state"), start, "2026-01-01", buckets=8)
            query.awaitTermination()
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 8
    rows = jobs.logged_triples(spark, str(tmp_path / "kg"), known).collect()
    assert len(rows) == len({r["subject"] for r in rows}) == 602
    assert sum(r["valid_to"] == "2026-01-01" for r in rows) == 102 and sum(r["id"].startswith("k") for r in rows) == 200


def test_sessions_share_a_state():
    """A bucket's sessions take one state and one timer, which drops those that are idle; counts are those of a state for each."""

    class Handle:
        counts, timers, updates = None, [], 0

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.counts is not None

        def get(self):
            return self.counts

        def update(self, counts):
            self.counts, self.updates = counts, self.updates + 1

        def clear(self):
            self.counts = None

        def listTimers(self):
            return self.timers

        def deleteTimer(self, at):
            self.timers = [x for x in self.timers if x != at]

        def registerTimer(self, at):
            self.timers = [*self.timers, at]

    class Expired:
        def getExpiryTimeInMs(self):
            return self.at

    handle, kept = Handle(), jobs.SaveEveryOfMany(2, idle_ms=50)
    kept.init(handle)
    told = lambda rows: [tuple(x) for f in kept.handleInputRows((0,), iter([pd.DataFrame({"session_id": [s for s, _ in rows], "ms": [m for _, m in rows], "id": range(len(rows))})]), None) for x in f.itertuples(index=False)]
    many = [(f"s{i}", i % 7) for i in range(1000)]
    assert told([*many, ("a", 40), ("a", 20)]) == [("a", 2, 2)] and handle.updates == 1 and handle.timers == [50]
    assert sorted(told([("s3", 30), ("a", 120), ("s6", 200)])) == [("s3", 2, 2)] and handle.timers == [50]
    expired = Expired()
    expired.at = 60
    assert sum(len(f) for f in kept.handleExpiredTimer((0,), None, expired)) == 0
    assert dict(zip(handle.counts[0], handle.counts[3], strict=True)) == {"s3": 30, "a": 120, "s6": 200} and handle.timers == [80]
    expired.at = 250
    list(kept.handleExpiredTimer((0,), None, expired))
    assert not handle.exists() and handle.timers == []
