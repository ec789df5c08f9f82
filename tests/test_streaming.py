"""Streaming jobs over several micro-batches, against their batch twins."""

import pytest
from pyspark.sql import functions as F

from gradewright.operators import gate, responses, review
from gradewright.operators.redact import decrypt
from gradewright.plans.registry import Tables
from gradewright.sources import merge
from gradewright.streaming import folds, retries, runs, traces

SF = "/root/testdata/sf0.001"


def split_files(spark, frame, path, parts, by):
    """Write a frame as several files, one micro-batch each."""
    for i in range(parts):
        frame.filter(F.col(by) % parts == i).coalesce(1).write.mode("append").parquet(path)
    return (spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path))


def run_append(stream, tmp_path, spark):
    done = runs.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def same(a, b):
    order = sorted(a.columns)
    return sorted(map(repr, a.select(order).collect())) == sorted(map(repr, b.select(order).collect()))


@pytest.fixture
def tables(spark):
    return Tables(spark, SF)


def test_retry_stream_equals_batch_for_any_arrival_order(spark, tables, tmp_path):
    log = responses.validate_responses(tables.view("responses")).withColumn(
        "payload", F.coalesce("case_type", "draft_reply")).select(
        "run_id", "record_id", "stage", "attempt", "valid", "provider_error", "payload", "event_id")
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    stream = split_files(spark, log, str(tmp_path / "in"), 3, "event_id")
    before = spark.conf.get(retries.PROVIDER)
    spark.conf.set(retries.PROVIDER, retries.ROCKSDB)
    try:
        got = run_append(retries.resolve_stream(stream, timeout_ms=None), tmp_path, spark)
    finally:
        spark.conf.set(retries.PROVIDER, before)
    want = responses.resolve_retries(log, payload=["payload"]).filter("outcome <> 'open'")
    assert same(got, want)


def test_retry_state_is_forgotten_and_open_calls_are_emitted(spark, tmp_path):
    """20 batches, an hour each: calls time out while the stream runs, and state stays flat."""
    hour, path = 3600, str(tmp_path / "in")
    for b in range(20):
        data = [("r", f"ok-{b}", "triage", 1, True, "p", b * hour), ("r", f"open-{b}", "triage", 1, False, None, b * hour),
                ("r", f"gap-{b}", "triage", 2, True, "late", b * hour)]
        (spark.createDataFrame(data, "run_id STRING, record_id STRING, stage STRING, attempt INT, valid BOOLEAN, payload STRING, s LONG")
         .select("*", F.lit(None).cast("string").alias("provider_error"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")).drop("s")
         .coalesce(1).write.mode("append").parquet(path))
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get(retries.PROVIDER)
    spark.conf.set(retries.PROVIDER, retries.ROCKSDB)
    try:
        resolved = retries.resolve_stream(stream, timeout_ms=2 * hour * 1000, delay="1 hour")
        done = runs.start(resolved, str(tmp_path / "out"), str(tmp_path / "cp"))
        done.awaitTermination()
    finally:
        spark.conf.set(retries.PROVIDER, before)
    got = {r.record_id: (r.outcome, r.attempt, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for b in range(20):
        assert got.pop(f"ok-{b}") == ("ok", 1, "p")
        over = b + 2 + 1 <= 19  # timeout and delay behind the last hour
        assert (got.pop(f"open-{b}", None) == ("open", None, None)) == over
        assert (got.pop(f"gap-{b}", None) == ("ok", 2, "late")) == over
    assert not got
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress]
    assert 0 < max(rows[10:]) <= max(rows[:10]) < 20


def test_calls_share_state_rows_and_stay_apart(spark, tables, tmp_path):
    """State is a row a bucket, whatever the number of calls; null keys are calls too."""
    log = responses.validate_responses(tables.view("responses")).withColumn(
        "payload", F.coalesce("case_type", "draft_reply")).select(
        F.expr("CASE WHEN event_id % 80 >= 8 THEN run_id END").alias("run_id"), "record_id", "stage", "attempt", "valid",
        "provider_error", "payload", "event_id")
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    stream = split_files(spark, log, str(tmp_path / "in"), 3, "event_id")
    before = spark.conf.get(retries.PROVIDER)
    spark.conf.set(retries.PROVIDER, retries.ROCKSDB)
    try:
        done = runs.start(retries.resolve_stream(stream, timeout_ms=None, buckets=3), str(tmp_path / "out"), str(tmp_path / "cp"))
        done.awaitTermination()
    finally:
        spark.conf.set(retries.PROVIDER, before)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = responses.resolve_retries(log, payload=["payload"]).filter("outcome <> 'open'")
    assert same(got, want) and got.filter("run_id IS NULL").count() > 0
    assert got.count() > 100
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress) <= 3


def test_attempts_without_a_time_count_and_end_nothing(spark, tmp_path):
    data = [("r", "a", "triage", 1, True, "p", None), ("r", "a", "triage", 1, True, "p", 10), ("r", "b", "triage", 1, False, None, 20),
            ("r", "b", "triage", 2, True, "q", None), ("r", "c", "triage", 1, False, None, 30)]
    (spark.createDataFrame(data, "run_id STRING, record_id STRING, stage STRING, attempt INT, valid BOOLEAN, payload STRING, s LONG")
     .select("*", F.lit(None).cast("string").alias("provider_error"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")).drop("s")
     .coalesce(1).write.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get(retries.PROVIDER)
    spark.conf.set(retries.PROVIDER, retries.ROCKSDB)
    try:
        got = run_append(retries.resolve_stream(stream, timeout_ms=1000, buckets=1), tmp_path, spark)
    finally:
        spark.conf.set(retries.PROVIDER, before)
    assert {r.record_id: (r.outcome, r.attempt, r.failed_attempts, r.payload) for r in got.collect()} == {
        "a": ("ok", 1, 0, "p"), "b": ("ok", 2, 1, "q")}


def test_timeout_decides_from_what_was_seen():
    resolver = retries.RetryResolver(["k"], 3, 1000)
    assert resolver._decide(0b10, 0b00, 2, 0, force=False) is None
    assert resolver._decide(0b10, 0b00, 2, 0, force=True) == ("ok", 2, 0)
    assert resolver._decide(0b11, 0b01, 2, 0, force=False) == ("ok", 2, 1)
    assert resolver._decide(0b11, 0b01, 0, 2, force=False) == ("provider_error", 2, 1)
    assert resolver._decide(0b111, 0b111, 0, 0, force=False) == ("exhausted", None, 3)
    assert resolver._decide(0b11, 0b11, 0, 0, force=False) is None
    assert resolver._decide(0b11, 0b11, 0, 0, force=True) == ("open", None, 2)


def test_queue_stream_equals_batch_when_the_log_is_ordered(spark, tables, tmp_path):
    queue = tables.view("queue").select("record_id", "draft_reply", "decision", "reviewer_text")
    log = tables.view("decisions")
    third = log.groupBy().agg(F.max("event_id").alias("m")).collect()[0].m // 3 + 1
    marked = log.withColumn("batch", F.floor(F.col("event_id") / third))
    path = str(tmp_path / "in")
    for i in range(3):
        marked.filter(F.col("batch") == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(path)
    root = str(tmp_path / "queue")
    table = runs.PartTable(spark, root, runs.hash_part(["record_id"]))
    table.create(queue)
    done = runs.start_folds(stream, table, str(tmp_path / "cp"), folds.queue_step(("ts", "event_id")), "append")
    done.awaitTermination()
    assert done.lastProgress["batchId"] == 2
    want = review.apply_decisions(queue, review.first_decisions(log, queue, ("ts", "event_id")))
    assert same(table.latest(), want)


def test_running_sums_equal_one_aggregate(spark, tables, tmp_path):
    rows = tables.view("cell_ratings").select("combination", "metric", F.col("hit").alias("score"),
                                              "l_orderkey")
    stream = split_files(spark, rows, str(tmp_path / "in"), 4, "l_orderkey")
    keys = ["combination", "metric"]
    table = runs.PartTable(spark, str(tmp_path / "sums"), runs.hash_part(keys, 8))
    table.create(folds.empty_sums(spark, keys))
    done = runs.start_folds(stream, table, str(tmp_path / "cp"), folds.sums_step(keys), "append")
    done.awaitTermination()
    want = rows.groupBy(*keys).agg(F.count("score").alias("n"),
                                   F.sum("score").cast("double").alias("total"))
    assert same(table.latest(), want)


def test_partial_sums_add_up_in_any_order(rows):
    a = rows([("x", 1, 2.0)], "k STRING, n BIGINT, total DOUBLE")
    b = rows([("x", 2, 3.0), ("y", 1, 1.0)], "k STRING, n BIGINT, total DOUBLE")
    assert same(gate.add_running_sums(a, b, ["k"]), gate.add_running_sums(b, a, ["k"]))


def test_ingested_traces_hold_no_plain_text(spark, tables, tmp_path):
    rows = tables.view("traces").select(
        "record_id", "stage", F.when(F.col("event_id") % 10 != 3, F.col("model")).alias("model"),
        "seconds", F.concat(F.lit("words "), "record_id").alias("prompt"), "event_id")
    stream = split_files(spark, rows, str(tmp_path / "in"), 2, "event_id").drop("event_id")
    sealed = run_append(traces.sealed_traces(stream, "k" * 16), tmp_path, spark)
    assert sealed.filter(F.contains("prompt", F.lit("words"))).count() == 0
    plain = rows.filter("model IS NOT NULL").drop("event_id")
    assert same(decrypt(sealed, "k" * 16), plain)
    assert traces.rejected_traces(rows).count() == rows.count() - plain.count()


def test_stage_correlation_respects_the_bound(spark, tmp_path):
    data = [("a", "triage", 0, 1.0), ("a", "draft", 30, 2.0), ("b", "triage", 0, 1.0),
            ("b", "draft", 7200, 2.0), ("c", "triage", 10, 1.0), ("c", "draft", 5, 2.0)]
    frame = spark.createDataFrame(data, "record_id STRING, stage STRING, s INT, seconds DOUBLE"
                                  ).withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    joined = traces.correlate_stages(stream.filter("stage = 'triage'"),
                                     stream.filter("stage = 'draft'"), "1 HOUR")
    got = run_append(joined, tmp_path, spark).collect()
    assert [(r.record_id, r.end_to_end) for r in got] == [("a", 3.0)]


def test_an_unpaired_triage_leaves_when_no_draft_can_come(spark, tmp_path):
    hour, path = 3600, str(tmp_path / "in")
    batches = [[("a", "triage", 0, 1.0), ("a", "draft", 30, 2.0), ("b", "triage", 10, 4.0)],
               [("c", "triage", 3 * hour, 1.0), ("c", "draft", 3 * hour + 5, 2.0), ("a", "draft", 3 * hour, 9.0)],
               [("d", "triage", 6 * hour, 1.0), ("d", "draft", 6 * hour + 5, 2.0), ("e", "triage", 6 * hour, 1.0)]]
    for rows in batches:
        frame = spark.createDataFrame(rows, "record_id STRING, stage STRING, s INT, seconds DOUBLE").withColumn(
            "at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
        frame.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    joined = traces.correlate_stages(stream.filter("stage = 'triage'"), stream.filter("stage = 'draft'"), "1 HOUR",
                                     unpaired=True)
    got = sorted((r.record_id, r.draft_seconds, r.end_to_end) for r in run_append(joined, tmp_path, spark).collect())
    assert got == [("a", 2.0, 3.0), ("b", None, None), ("c", 2.0, 3.0), ("d", 2.0, 3.0)]  # e may still get one


def test_restart_with_nothing_new_returns_the_same_table(spark, tables, tmp_path):
    rows = tables.view("cell_ratings").select("combination", "metric", F.col("hit").alias("score"), "l_orderkey")
    keys = ["combination", "metric"]
    table = runs.PartTable(spark, str(tmp_path / "sums"), runs.hash_part(keys, 8))
    table.create(folds.empty_sums(spark, keys))
    stream = split_files(spark, rows, str(tmp_path / "in"), 6, "l_orderkey")
    found = []
    for _ in range(2):
        runs.start_folds(stream, table, str(tmp_path / "cp"), folds.sums_step(keys), "append").awaitTermination()
        found.append(table.latest())
        assert table.versions() == [5, 6]
    assert same(*found)
    assert found[0].agg(F.sum("n")).first()[0] == rows.count()


def test_incomplete_version_is_not_taken(spark, tmp_path):
    table = runs.PartTable(spark, str(tmp_path / "v"), runs.hash_part(["id"], 4))
    table.create(spark.range(3).toDF("id"))
    spark.range(9).withColumn("_part", F.lit(0)).write.partitionBy("_part").parquet(str(tmp_path / "v/data/version=000000001"))
    (tmp_path / "v/manifest/_000000001").write_text("{}")
    assert table.latest().count() == 3 and table.versions() == [0]
    with pytest.raises(FileNotFoundError):
        runs.PartTable(spark, str(tmp_path / "none"), runs.hash_part(["id"])).latest()


def test_a_batch_rewrites_only_its_parts_and_may_be_replayed(spark, tmp_path):
    """20,000 keys in 32 parts; batches of three keys write a few parts, and the same again on replay."""
    def size(version):
        return sum(f.stat().st_size for f in (tmp_path / f"t/data/version={version:09d}").rglob("*.parquet"))

    table = runs.PartTable(spark, str(tmp_path / "t"), runs.hash_part(["id"], 32))
    table.create(spark.range(20_000).select("id", F.lit(0).cast("long").alias("n")))

    def step(state, batch):
        return state.unionByName(batch).groupBy("id").agg(F.sum("n").alias("n"))
    want = {}
    for number in range(4):
        batch = spark.createDataFrame([(7, 1), (8, 2), (20_000 + number, 5)], "id LONG, n LONG")
        full = size(0) if number == 0 else full
        table.fold(batch, number, step)
        once = sorted(map(tuple, table.latest().filter("n > 0").collect()))
        table.fold(batch, number, step)  # replayed: reads the version before its own
        assert once == sorted(map(tuple, table.latest().filter("n > 0").collect()))
        assert 0 < size(number + 1) < full / 5
        want = {7: number + 1, 8: 2 * (number + 1), **{20_000 + k: 5 for k in range(number + 1)}}
        assert dict(once) == want
    assert table.latest().count() == 20_004 and table.versions() == [3, 4]
    table.fold(spark.createDataFrame([], "id LONG, n LONG"), 4, step)  # an empty batch writes no data
    assert table.latest().count() == 20_004 and not (tmp_path / "t/data/version=000000005").exists()


def test_closed_windows_are_not_rewritten(spark, tmp_path):
    table = runs.PartTable(spark, str(tmp_path / "w"), runs.range_part("start", 10))
    table.create(spark.createDataFrame([], "start LONG, n LONG"))
    for number in range(5):
        batch = spark.createDataFrame([(10 * number + k, 1) for k in range(10)], "start LONG, n LONG")
        table.fold(batch, number, lambda state, new: merge.merge_by_key(state, new, ["start"]))
        manifest = table._manifest(number + 1)["parts"]
        assert manifest == {str(k): k + 1 for k in range(number + 1)}
    assert table.latest().count() == 50


def test_late_rows_of_later_batches_are_counted(spark, tmp_path):
    """The second batch moves the watermark far ahead; the third brings rows of the first window."""
    hour = 3600
    data = [(0, 100, 100), (0, 200, 900), (1, 50 * hour, 50 * hour), (1, 60 * hour, 60 * hour),
            (2, 300, 61 * hour), (2, 400, 61 * hour), (2, 61 * hour, 61 * hour)]
    frame = (spark.createDataFrame(data, "batch INT, s LONG, a LONG").select(
        "batch", F.timestamp_seconds("s").alias("at"), F.timestamp_seconds("a").alias("arrived"),
        F.lit("x").alias("stage"), F.lit(True).alias("success"), F.lit(1.0).alias("seconds"),
        F.lit(2).cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens")))
    path = str(tmp_path / "in")
    for i in range(3):
        frame.filter(F.col("batch") == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    marked = traces.split_late(stream, "at", "arrived", "1 HOUR")
    late = traces.late_rows(marked, "at", ["stage"], "24 hours").select(
        F.unix_micros("window.start").alias("w"), "stage")
    part = runs.range_part("w", 24 * hour * 1_000_000)
    table = runs.PartTable(spark, str(tmp_path / "late"), part)
    table.create(spark.createDataFrame([], "w BIGINT, stage STRING, late BIGINT"))
    runs.start_folds(late, table, str(tmp_path / "cp"), folds.count_step(["w", "stage"], "late"), "append").awaitTermination()
    assert [tuple(r) for r in table.latest().collect()] == [(0, "x", 2)]
    flat = traces.rolling_operations(marked, "at", ["stage"], "24 hours").select(
        F.unix_micros("window.start").alias("w"), "stage", "calls")
    table = runs.PartTable(spark, str(tmp_path / "rolled"), part)
    table.create(spark.createDataFrame([], flat.schema))
    runs.start_folds(flat, table, str(tmp_path / "cp2"), lambda state, batch: merge.merge_by_key(
        state, batch, ["w", "stage"])).awaitTermination()
    assert sorted((r.w // (24 * hour * 1_000_000), r.calls) for r in table.latest().collect()) == [
        (0, 2), (2, 3)]


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """The smallest tables, with events as a folder of three files."""
    import os
    root = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", root / name)
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3, "event_id").write.parquet(str(root / "events.parquet"))
    assert len(list((root / "events.parquet").glob("*.parquet"))) == 3
    return str(root)


@pytest.mark.parametrize("name", ["s6_trace_append", "t1_trace_ingest", "t1_rejected_traces", "t2_queue_stream",
                                  "t3_retry_stream", "t4_tumbling_operations", "t5_stage_correlation"])
def test_stream_queries_read_folder_tables(spark, folder_tables, name):
    from gradewright.plans import catalog
    build = catalog.queries()[name]
    got, want = build(spark, folder_tables), build(spark, SF)
    assert want.count() > 0 and same(got, want)


def test_a_missing_table_fails(spark, tmp_path):
    from gradewright.plans import catalog
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalog.queries()["s6_trace_append"](spark, str(tmp_path))
