import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import source_mix as M


def wanted(sizes, weights=(5, 2, 1)):
    """Targets by handing on what is above twice the size, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] = share * weight[s]
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= 2.0 * sizes[s]
        open_ -= full
    return target


@pytest.mark.parametrize("odd", [False, True])
def test_digest(frame, rows, odd_rows, odd):
    data = odd_rows if odd else rows
    made = M.plan(frame(data), block_words=300)
    draws = M.shard_draws(made, 5).cache()
    got = M.taken(made, draws).join(made["sources"].select("s", "source_size", "target"), "s").select("doc_id", "source", "size", "source_size", "target", "taken", "shares").collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = wanted(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == sum(x["words"] for x in r["shares"])
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = M.taken(made, draws).agg(F.sum(F.hash("doc_id", "taken").cast("long"))).head()[0]
    assert again == M.taken(M.plan(frame(data[::-1]), block_words=300), M.shard_draws(M.plan(frame(data[::-1]), block_words=300), 5)).agg(F.sum(F.hash("doc_id", "taken").cast("long"))).head()[0]


def test_the_tree_decides(frame, rows):
    """Each shard takes of each source what its node of the tree was dealt; a draw that no node holds is not taken."""
    made = M.plan(frame(rows), block_words=300)
    draws = M.shard_draws(made, 5)
    counts = {r["s"]: r["count"] for r in made["draws"].groupBy("s").count().collect()}
    quotas = frame([]).sparkSession.createDataFrame([(sorted(counts.items()),)], "quotas array<struct<s: int, n: bigint>>")
    dealt = {(r["shard"], q["s"]): q["n"] for r in M.split_tree(quotas, 5).collect() for q in r["quotas"]}
    got = M.taken(made, draws).select("s", "block", F.explode("shares").alias("x")).select("s", "block", "x.*").groupBy("shard", "s").agg(F.count_distinct("block", "pass").alias("n"))
    assert {(r["shard"], r["s"]): r["n"] for r in got.collect()} == dealt
    fewer = draws.filter("shard <> 2")
    lost = sum(x["words"] for r in M.taken(made, draws).collect() for x in r["shares"] if x["shard"] == 2)
    assert lost > 0 and M.taken(made, draws).agg(F.sum("taken")).head()[0] - M.taken(made, fewer).agg(F.sum("taken")).head()[0] == lost


@pytest.mark.parametrize("few", [0, 200_000])
def test_joins_without_a_broadcast(frame, rows, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_ROWS", few)
    made = M.plan(frame(rows), block_words=300)
    got = M.taken(made, M.shard_draws(made, 5)).agg(F.count("*"), F.sum("taken")).head()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert got[0] == len(rows) and abs(got[1] - 1.5 * total) <= 30


def test_mix(frame, rows):
    df = frame(rows)
    out = M.mix(df, shards=4, block_words=300).collect()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert abs(sum(r["mix_words"] for r in out) - 1.5 * total) <= 30
    assert {r["mix_shard"] for r in out} <= set(range(4))
    assert len({(r["doc_id"], r["mix_pass"]) for r in out}) == len(out)


def test_clashing_names_and_empty_table(frame, odd_rows):
    out = M.mix(frame(odd_rows, clashing=True))
    assert len(set(out.columns)) == len(out.columns) and len(out.collect()) > 0
    assert M.mix(frame([])).count() == 0


def test_hypergeometric(spark):
    x = spark.range(4000).select(M.hypergeometric(F.lit(30).cast("long"), F.lit(100).cast("long"), F.lit(40).cast("long"), M._uniform(F.col("id"))).alias("k")).toPandas().k
    assert abs(x.mean() - 12) < 0.2 and abs(x.var() - 5.09) < 0.6 and x.min() >= 0 and x.max() <= 30


def test_tree_keeps_quotas(spark):
    quotas = [100, 7, 0, 33, 1234]
    made = M.split_tree(spark.createDataFrame([(list(enumerate(quotas)),)], "quotas array<struct<s: int, n: bigint>>"), 7).collect()
    assert all(q["n"] > 0 for r in made for q in r["quotas"])
    got = np.stack([[dict(map(tuple, r["quotas"])).get(i, 0) for i in range(5)] for r in made])
    assert got.sum(0).tolist() == quotas and got.min() >= 0 and np.ptp(got.sum(1)) <= 3
