"""Nested values, trailing windows, hash trees, landed pages and stores."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import documents, evaluation, trees, variants, windows
from spindrift.operators.store import BucketStore
from spindrift.plans import catalog, texts
from spindrift.plans.engine import Engine, FeedbackStore
from spindrift.sources import pages, trials


def nested(draw, depth):
    kind = draw.choice(["text", "number", "truth", "null", "list", "struct"] if depth else ["text", "number"])
    if kind == "list":
        return [nested(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    if kind == "struct":
        return {draw.choice("abcd"): nested(draw, depth - 1) for _ in range(draw.randint(0, 3))}
    return {"text": draw.choice(["x", "", "y z"]), "number": draw.randint(0, 9), "truth": True, "null": None}[kind]


def plain_leaves(v, path="$"):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from plain_leaves(x, f"{path}.{k}")
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from plain_leaves(x, f"{path}[{i}]")
    else:
        yield path, None if v is None else "true" if v is True else json.dumps(v) if isinstance(v, (dict, list)) else str(v)


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_of_any_shape(spark, seed):
    draw = random.Random(seed)
    rows = [(p, v, {f: nested(draw, 3) for f in draw.sample([f"field{i}" for i in range(34)], 20)}) for p in range(8) for v in range(1, 6) if (p, v) != (3, 3)]
    made = spark.createDataFrame([(p, v, json.dumps(b)) for p, v, b in rows], "p long, version int, j string").select("p", "version", F.parse_json("j").alias("body"))
    held = {(p, v): dict(plain_leaves(b)) for p, v, b in rows}
    got = variants.leaves(made, "body").collect()
    assert sorted((r["p"], r["version"], r["path"], str(r["value"])) for r in got) == sorted((p, v, k, str(x)) for (p, v), own in held.items() for k, x in own.items())
    want = set()
    for (p, v), own in held.items():
        if (p, v - 1) in held:
            old = held[p, v - 1]
            for k in own.keys() | old.keys():
                if k not in old or k not in own or old[k] != own[k]:
                    want.add((p, v, k, "added" if k not in old else "dropped" if k not in own else "changed", old.get(k), own.get(k)))
    assert set(map(tuple, variants.diff(made, ["p"]).collect())) == want


def test_deep_values_and_empty_tables(spark):
    deep = spark.createDataFrame([('{"a": {"a": {"a": {"a": 1}}}}',), ("[]",), ("null",), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert sorted((r["path"], str(r["value"])) for r in variants.leaves(deep, "v", depth=2).collect()) == [("$", "None"), ("$", "None"), ("$", "[]"), ("$.a.a", '{"a":{"a":1}}')]
    assert variants.leaves(deep.limit(0), "v").count() == 0


def events(spark, n=3000, seed=4):
    draw = random.Random(seed)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randint(0, 24 * 20)), draw.choice(["a", "b"]), draw.choice([None, *range(200)]), draw.choice([None, *(x / 7 for x in range(5000))])) for _ in range(n)]
    return rows, spark.createDataFrame([(t, e, None if u is None else f"user{u}", x) for t, e, u, x in rows], "timestamp timestamp, endpoint string, user_id string, latency_ms double")


def test_trailing_windows(spark):
    rows, frame = events(spark)
    numbered = windows.numbered(frame, "user_id", "no")
    seen = {r["no"] for r in numbered.collect()} - {None}
    assert seen == set(range(1, len({u for _, _, u, _ in rows if u is not None}) + 1))
    rolled = windows.daily_distinct(numbered, "no", ["endpoint"])
    got = {(r["endpoint"], r["until"]): r["n"] for r in windows.trailing_distinct(rolled, ["endpoint"], 7).collect()}
    days = {t.date() for t, *_ in rows}
    inside = lambda t, until: until - dt.timedelta(days=6) <= t.date() <= until
    want = {(e, d): len({u for t, x, u, _ in rows if x == e and u is not None and inside(t, d)}) for e in "ab" for d in days}
    assert got == {k: n for k, n in want.items() if n}
    sketch = windows.trailing_latency(windows.daily_latency(frame, ["endpoint"]), ["endpoint"]).collect()
    assert len(sketch) == 2 * len(days)
    for r in sketch:
        own = sorted(x for t, e, _, x in rows if e == r["endpoint"] and x is not None and inside(t, r["until"]))
        assert r["calls"] == len(own)
        for share, value in ((0.5, r["p50"]), (0.95, r["p95"])):
            low, high = sum(x < value for x in own) / len(own), sum(x <= value for x in own) / len(own)
            assert low - 0.0165 - 1 / len(own) <= share <= high + 0.0165 + 1 / len(own)  # the sketch's rank error with k = 200


@pytest.mark.parametrize("changes", [0, 1, 12])
def test_trees_find_what_differs(spark, changes):
    draw = random.Random(changes)
    old = {i * 3: f"text {i}" for i in range(3000)}
    new = dict(old)
    for i in draw.sample(sorted(old), changes):
        if i % 2:
            del new[i]
        else:
            new[i] = None if i % 4 else "other"
    if changes:
        new[100_001] = "new"
    made = [trees.built(spark.createDataFrame(list(d.items()), "id long, v string").repartition(n), "id", ["v"], leaf=64, fanout=8, levels=4) for d, n in ((old, 3), (new, 5))]
    got = {r["id"]: r["change"] for r in trees.differing(*made).collect()}
    want = {i: "added" if i not in old else "dropped" if i not in new else "changed" for i in old.keys() | new.keys() if old.get(i, 0) != new.get(i, 0)}
    assert got == want
    read = trees.leaves_read(*made).head()
    assert read["read"] <= changes + 1 and read["of"] >= 140
    assert (made[0].top().head() == made[1].top().head()) == (not changes)
    with pytest.raises(ValueError):
        trees.differing(made[0], trees.built(spark.createDataFrame([(1, "a")], "id long, v string"), "id", ["v"]))


def test_filters_skip_pages(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"c{i // 30}", None if i < 40 else i * 2, "2024-01-%02d" % (1 + i // 10)) for i in range(200)], "id long, kind string, n long, updated string")
    path, columns = str(tmp_path / "landed"), "id long, kind string, n long, updated string"
    pages.land(rows, path, ["id"], 10)
    read = lambda: pages.read(spark, path, columns)
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, rows.collect()))
    everything = read().rdd.getNumPartitions()
    for keep in ("id >= 150", "updated > '2024-01-18'", "kind = 'c2'", "id IN (3, 77)", "id < 12 AND n IS NULL", "n <= 90", "id >= 900"):
        some = read().filter(keep)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, rows.filter(keep).collect()))
        assert some.rdd.getNumPartitions() < everything / 2
    plan = read().filter("id >= 150")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan
    assert pages.read(spark, str(tmp_path / "none"), columns).count() == 0


def test_pages_as_a_stream(spark, tmp_path):
    path, out = str(tmp_path / "landed"), str(tmp_path / "out")
    part = lambda a, b: spark.createDataFrame([(i, f"x{i}") for i in range(a, b)], "id long, v string")

    def run():
        pages.stream(spark, path, "id long, v string").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    pages.land(part(0, 25), path, ["id"], 10)
    run()
    first = spark.read.parquet(out).count()
    run()
    assert first == 25 and spark.read.parquet(out).count() == 25
    last = spark.read.json(f"{path}/index").agg(F.max("page")).head()[0]
    pages.land(part(25, 60), path, ["id"], 10, first_page=last + 1)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(60))


def test_an_update_of_a_stored_snapshot(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), "k", 4)
    store.create(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string"))
    incoming = spark.createDataFrame([("b", 5, 1), ("b", 2, 2), ("c", 9, 1), ("d", 4, 1)], "k string, v int, pos int")
    assert Engine.ingest(store, incoming) == {"n_new": 1, "n_updated": 1, "total": 4}
    assert dict(map(tuple, store.read().collect())) == {"a": "1", "b": "2", "c": "9", "d": "4"}


def test_promoting_stores_the_alias_first(spark, tmp_path):
    log = FeedbackStore(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("f1", "correction", " TDXD ", "T-DXd")], "id string, type string, alias string, canonical string"), "2024-01-01T00:00:00")
    known = spark.createDataFrame([("a", "A")], "alias string, canonical string")

    def fails(_):
        raise OSError("full")

    with pytest.raises(OSError):
        log.promote("f1", known, "2024-01-02T00:00:00", fails)
    assert log.read().head()["status"] == "open"
    stored = []
    made = log.promote("f1", known, "2024-01-02T00:00:00", stored.append)
    assert stored == [made] and sorted(map(tuple, made.collect())) == [("a", "A"), ("tdxd", "T-DXd")]
    assert log.read().head()["status"] == "resolved" and log.promote("none", known, "2024-01-03T00:00:00", fails) is None


def test_corpora_that_are_not_enabled(spark):
    corpora = Engine.corpora(spark, spark.createDataFrame([("melanoma",)], "corpus string"))
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "corpus string")
    assert Engine.of_enabled(ask("melanoma"), corpora).count() == 1
    with pytest.raises(ValueError, match="lymphoma"):
        Engine.of_enabled(ask("melanoma", "lymphoma"), corpora)


def test_contexts_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([(1, "N2", 2, "b", "0"), (1, "N1", 1, "", "x"), (2, "N3", 1, None, "False")], "qid long, doc_id string, rank int, title string, extra string")
    got = {r["qid"]: r["context"] for r in documents.context(rows, {"title": "Title", "extra": "Extra"}, by="qid").collect()}
    assert got == {1: "<trial id=1>\nNCT ID: N1\nExtra: x\n</trial>\n\n<trial id=2>\nNCT ID: N2\nTitle: b\n</trial>", 2: "<trial id=1>\nNCT ID: N3\n</trial>"}
    assert trials.read_registry(spark, str(tmp_path / "none.json"), "a string").count() == 0
    (tmp_path / "r.json").write_text('{"a": "x"}\nbroken\n')
    assert [r["a"] for r in trials.read_registry(spark, str(tmp_path / "r.json"), "a string").collect()] == ["x"]


def test_the_report_has_the_figures_of_the_means(spark, sf_dir):
    told = json.loads(texts.evaluation_report(spark, sf_dir).head()["report"])
    want = {r["category"]: {k: r[k] for k in ("n", "hit_rate", "mrr", "precision")} for r in catalog.keyword_eval_hit_mrr_p(spark, sf_dir).collect()}
    assert told == {"overall": want.pop(None), "by_category": want}
    empty = spark.createDataFrame([], "category string, hit int, rr double, precision double")
    assert evaluation.report_json(empty).count() == 1


def test_a_task_sorts_the_leaves_of_so_many_versions(spark):
    """Leaves are dealt by the number of versions, not by what the session's partitions are, and are not shuffled; before, two tables of leaves were."""
    rows = [(k, v, f'{{"a": {k % 3 if v % 2 else v}, "b": [{v}], "c{v % 2}": null}}') for k in range(60) for v in range(1, 6) if (k + v) % 7] + [(None, 1, "{}"), (None, 2, '{"a": 1}'), (1, 2, '{"a": 1}')]
    made = spark.createDataFrame(rows, "k int, version int, body string").withColumn("body", F.parse_json("body"))
    want = variants.diff(made, ["k"])
    small = variants.diff(made, ["k"], per_task=25)
    assert sorted(map(str, small.collect())) == sorted(map(str, want.collect())) and want.count() > 300 and want.filter("k IS NULL").isEmpty()
    assert small.rdd.getNumPartitions() == 11 and want.rdd.getNumPartitions() <= 4
