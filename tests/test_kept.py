"""Tables that streams and updates keep."""

import datetime as dt
import random

import pytest
from comparing import of_sql, rows
from pyspark.sql import functions as F

from spindrift.operators import feedback, merge
from spindrift.operators.store import BucketStore, refresh
from spindrift.plans import catalog, kept
from spindrift.sources import files, order
from spindrift.streaming import sessions
from spindrift.streaming.keyed import KeyedTable, last_wins

EVENTS = "event_id long, user_id long, event_type string, session_id string, ts timestamp"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), lambda parts: parts.groupBy("k").agg(F.sum("n").alias("n")), compact_every=3)
    batch = lambda *r: spark.createDataFrame(r, "k string, n long")
    want = {}
    for n in range(8):
        own = [("a", n), (f"k{n % 2}", 1)]
        for k, v in own:
            want[k] = want.get(k, 0) + v
        table.write(batch(*own), n)
        table.write(batch(("a", 1000)), n)  # the same number again: after a failure, say
        assert dict(map(tuple, table.read().collect())) == want
    assert files.names(spark, str(tmp_path / "t")) == ["batch=6", "batch=7", "upto=5"]
    table.write(batch(("a", 1000)), 4)
    assert dict(map(tuple, table.read().collect())) == want


def test_compaction_that_stopped_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, last_wins(["k"]), compact_every=2)
    batch = lambda *r: spark.createDataFrame(r, "k string, n long")
    table.write(batch(("a", 1), ("b", 1)), 0)
    batch(("a", 2)).write.parquet(f"{path}/batch=1")  # written, but not made one with the others
    batch(("c", 9)).write.parquet(f"{path}/upto=1")
    files.delete(spark, f"{path}/upto=1/_SUCCESS")  # begun, not complete
    assert dict(map(tuple, table.read().collect())) == {"a": 2, "b": 1}
    table.write(batch(("a", 2)), 1)
    assert dict(map(tuple, table.read().collect())) == {"a": 2, "b": 1} and files.names(spark, path) == ["upto=1"]


def test_sessions_over_several_starts(spark, tmp_path):
    """Late and repeated rows, and a stop in between: equal to the batch roll-up of distinct rows."""
    draw = random.Random(3)
    events = [(i, draw.choice([1, 2, 3, None]), draw.choice("abc"), f"s{draw.randint(0, 9)}", at(1 + i // 20, i % 20)) for i in range(200)]
    events[7] = (7, 1, None, "s1", None)
    landed, path = str(tmp_path / "in"), str(tmp_path)
    made = None
    for i in range(4):
        own = [e for n, e in enumerate(events) if n // 50 == i or (n // 50 == i - 1 and n % 7 == 0)]  # one in seven comes again
        late = [e for n, e in enumerate(events) if n // 50 == i - 1 and n % 11 == 0]
        now = [e for e in own if not (e[0] // 50 == i and e[0] % 11 == 0 and i < 3)]
        spark.createDataFrame(now + late, EVENTS).coalesce(2).write.mode("append").parquet(landed)
        stream = sessions.without_repeats(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(landed), ["event_id"], "20 days")
        made = sessions.kept_sessions(stream, "session_id", path, keep_hours=24 * 20)
    got = {r["session_id"]: (r["event_count"], r["started_at"], r["last_active_at"], r["features_used"]) for r in made.collect()}
    want = {}
    for _, _, kind, s, ts in events:
        if ts is None:
            continue
        n, a, b, kinds = want.get(s, (0, ts, ts, set()))
        times = [t for t in (a, b, ts) if t]
        want[s] = (n + 1, min(times, default=None), max(times, default=None), kinds | ({kind} if kind else set()))
    assert got == {s: (n, a, b, sorted(k)) for s, (n, a, b, k) in want.items()}


def test_state_goes_after_its_time(spark, tmp_path):
    """A session that was quiet for longer than it is kept begins anew."""
    landed = str(tmp_path / "in")
    for rows_ in ([(1, 1, "a", "s", at(1))], [(2, 1, "a", "x", at(9))], [(3, 1, "a", "y", at(9, 1))], [(4, 1, "a", "s", at(10))]):
        spark.createDataFrame(rows_, EVENTS).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(landed).withWatermark("ts", "1 hour")
        made = sessions.kept_sessions(stream, "session_id", str(tmp_path), keep_hours=24)
    assert {r["session_id"]: r["event_count"] for r in made.collect()} == {"s": 1, "x": 1, "y": 1}


@pytest.mark.parametrize("key", ["session_id", "user_id"])
def test_sessions_go_on_over_parts_of_state(spark, tmp_path, key):
    """A key's parts are one session until it is quiet for longer than state and late rows are kept; state is Spark's own, no row of it passes through Python."""
    draw = random.Random(5)
    days = {"s0": [1, 2, 3, 4], "s1": [1, 4, 5], "s2": [2, 9, 10], "s3": [10]}
    events = [(i, int(s[1]), draw.choice(["a", "b", None]), s, at(d, draw.randint(0, 5))) for i, (s, d) in enumerate((s, d) for s, ds in days.items() for d in ds)]
    landed, made = str(tmp_path / "in"), None
    for first, last in ((1, 2), (3, 4), (5, 10)):
        spark.createDataFrame([e for e in events if first <= e[4].day <= last], EVENTS).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(EVENTS).parquet(landed).withWatermark("ts", "2 days")
        made = sessions.kept_sessions(stream, key, str(tmp_path), keep_hours=24, late_hours=60)
    want = {}
    for _, user, kind, s, ts in sorted(events, key=lambda e: e[4]):
        n, a, b, kinds = want.get(s if key == "session_id" else user, (0, ts, ts, set()))
        n, a, kinds = (0, ts, set()) if ts - b > dt.timedelta(hours=84) else (n, a, kinds)
        want[s if key == "session_id" else user] = (n + 1, a, ts, kinds | ({kind} if kind else set()))
    got = {r[key]: (r["event_count"], r["started_at"], r["last_active_at"], r["features_used"]) for r in made.collect()}
    assert got == {k: (n, a, b, sorted(kinds)) for k, (n, a, b, kinds) in want.items()} and sorted(n for n, *_ in got.values()) == [1, 2, 3, 4]
    plan = sessions.updated_parts(spark.read.schema(EVENTS).parquet(landed), key)._jdf.queryExecution().toString()
    assert "Python" not in plan and "TransformWithState" not in plan


def test_larger_deliveries_make_no_more_micro_batches(spark, tmp_path):
    """Four deliveries of five files each are two micro-batches, as those of one file each; before there were ten."""
    rows_ = spark.range(200).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    for n_files in (1, 5):
        path, landed = kept.delivered(rows_.repartition(n_files), F.array((F.col("id") % 4).cast("int")), 4, "larger")
        table = KeyedTable(spark, f"{path}/t", last_wins(["id"]))
        table.run(kept.streamed(spark, landed, rows_, 4), "append")
        assert files.names(spark, f"{path}/t") == ["batch=0", "batch=1"] and table.read().count() == 200


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_do_not_depend_on_batches(spark, tmp_path, seed):
    draw = random.Random(seed)
    times = [dt.datetime(2024, 1, 1) - dt.timedelta(days=draw.choice([0, 1, 30, 400, 9000])) for _ in range(60)]
    votes = [(draw.choice(["rating_up", "rating_down", "other"]), t, [draw.choice(["a", "b", "", "c"]) for _ in range(draw.randint(0, 3))]) for t in times]
    frame = lambda some: spark.createDataFrame(some, "type string, ts timestamp, ids array<string>")
    now = F.lit("2024-01-05").cast("timestamp")
    want = {r["doc_id"]: r["net"] for r in feedback.source_scores(frame(votes), now).collect()}
    table = KeyedTable(spark, str(tmp_path / "t"), feedback.merged_parts, compact_every=2)
    draw.shuffle(votes)
    cuts = sorted(draw.sample(range(60), 4))
    for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True)):
        table.write(feedback.score_parts(frame(votes[i:j])), n)
    got = {r["doc_id"]: r["net"] for r in feedback.scores_at(table.read(), now).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scores_never_overflow(spark):
    rows_ = [("rating_up", dt.datetime(1, 1, 2), ["a"]), ("rating_up", dt.datetime(9999, 1, 1), ["a", "b"]), ("rating_down", dt.datetime(1, 1, 2), ["c"])]
    parts = feedback.score_parts(spark.createDataFrame(rows_, "type string, ts timestamp, ids array<string>"))
    assert {r["doc_id"]: r["mass"] for r in parts.collect()} == {"a": 1.0, "b": 1.0, "c": -1.5}


def test_deliveries_in_any_order_give_one_table(spark, sf_dir):
    want = rows(of_sql(catalog.ORACLES["documents_landed_twice"], sf_dir))
    for turn in ([0, 1, 2, 3], [2, 0, 3, 1]):
        got = kept.landed_documents(spark, sf_dir, turn).select("doc_id", F.col("updated").cast("string").alias("updated"), merge.text_hash(F.col("text")).alias("text_hash"))
        assert rows(got.toPandas()) == want


def held(spark, store):
    facts = files.facts(spark, f"{store.path}/table")
    return {r["path"]: r["modified"] for r in facts.collect() if "part-" in r["path"]}


def test_an_update_rewrites_only_what_it_touches(spark, tmp_path):
    made = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    store = BucketStore(spark, str(tmp_path / "s"), "doc_id", buckets=8)
    docs = {i: f"text {i}" for i in range(40)}
    store.create(kept.text_vectors(made(list(docs.items())).withColumn("text_hash", merge.text_hash(F.col("text")))))
    before = held(spark, store)
    assert refresh(store, made(list(docs.items())), kept.text_vectors) == [] and held(spark, store) == before
    docs[3] = "another text"
    docs[99] = "new"
    del docs[5]
    touched = refresh(store, made(list(docs.items())), kept.text_vectors)
    bucket = lambda i: spark.range(1).select(F.pmod(F.xxhash64(F.lit(i).cast("long")), F.lit(8))).head()[0]
    assert touched == sorted({bucket(3), bucket(99), bucket(5)})
    after = held(spark, store)
    same = {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in touched}
    assert same and all(after.get(p) == before[p] for p in same)
    assert {r["doc_id"] for r in store.read().collect()} == set(docs)
    gone = {i for i in docs if bucket(i) == touched[0]}
    refresh(store, made([(i, t) for i, t in docs.items() if i not in gone]), kept.text_vectors)
    assert {r["doc_id"] for r in store.read().collect()} == set(docs) - gone


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k", buckets=4)
    frame = lambda some: spark.createDataFrame(some, "k long, v string")
    store.create(frame([(i, "old") for i in range(20)]))

    def broken(v):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        store.update(frame([(1, "new")]).withColumn("v", F.udf(broken, "string")("v")))
    assert {r["v"] for r in store.read().collect()} == {"old"} and store.read().count() == 20
    # a stage that is complete, but was not swapped in, is taken up by the next call
    swap, BucketStore._swap = BucketStore._swap, lambda self: None
    try:
        store.update(frame([(1, "new")]))
    finally:
        BucketStore._swap = swap
    assert {r["k"]: r["v"] for r in store.read().collect()} == {i: "new" if i == 1 else "old" for i in range(20)}


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_the_last_row_read_is_the_last(spark, tmp_path, form):
    path = str(tmp_path / form)
    for i in range(3):
        spark.createDataFrame([(k, i * 10 + k) for k in range(4) for _ in range(2)] + [(0, 100 + i)], "k long, v long").coalesce(1).write.mode("append").format(form).save(path)
    read = order.read(spark, path, form, "k long, v long", by_time=True)
    for n in (1, 3, 5):
        got = {r["k"]: r["v"] for r in merge.last_by_key(read.repartition(n), "k").collect()}
        assert got == {0: 102, 1: 21, 2: 22, 3: 23}
    assert files.facts(spark, path).filter("size > 0").count() >= 3


def test_equal_places_take_the_greatest(spark):
    rows_ = spark.createDataFrame([(1, i) for i in range(8)], "k long, v long")
    assert all([tuple(r) for r in merge.last_by_key(rows_.repartition(n), "k").collect()] == [(1, 7)] for n in (1, 3, 5))
