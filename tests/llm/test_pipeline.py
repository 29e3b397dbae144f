import collections
import re

import pytest
import test_decontamination
import test_exact_dedup
import test_ngram_join
import test_source_mix

import corpus_pipeline as P


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(data, items):
    """The rows that each stage but the last leaves, by plain Python."""
    kept = [r for r in data if any(c.isalpha() for c in r[1] or "")]
    yield kept
    kept = [r for r, b in zip(kept, test_exact_dedup.brute(kept), strict=True) if b[3]]
    yield kept
    component = {d: c for d, _, c in test_ngram_join.brute(kept)}
    kept = [r for r in kept if r[0] is None or component[r[0]] == r[0]]
    yield kept
    hit = {b[0] for b in test_decontamination.brute(kept, items) if b[5]}
    kept = [r for r in kept if r[0] not in hit]
    yield kept


def check_mix(mix, kept):
    """Each source's words come near its target, no document gives more than twice its own."""
    size, source = {r[0]: words(r[1]) for r in kept}, {r[0]: r[3] for r in kept}
    total = collections.Counter()
    for r in kept:
        total[r[3]] += words(r[1])
    target, taken, own = test_source_mix.wanted(total), collections.Counter(), collections.Counter()
    for r in mix:
        taken[r["source"]] += r["mix_words"]
        own[r["doc_id"]] += r["mix_words"]
        assert source[r["doc_id"]] == r["source"] and r["mix_pass"] in (1, 2)
    assert all(abs(taken[s] - target[s]) <= 1 for s in total) and all(n <= 2 * size[d] for d, n in own.items())


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]


def key(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_run_against_brute_force(spark, sf_dir, rows, items):
    kept = [*brute(rows, items)][-1]
    made = P.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in made} <= {r[0] for r in kept}
    check_mix(made, kept)


def test_each_stage_with_odd_rows(spark, sf_dir, frame, odd_rows, items):
    """Null ids and texts, repeated rows, long texts and columns with the operators' names, each stage on what brute force leaves."""
    data = odd_rows
    for (_, stage), want in zip(P.STAGES[:-1], brute(odd_rows, items), strict=True):
        docs = frame(data, clashing=True)
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert key(out.select("doc_id", "text").collect()) == key(want)
        data = want
    with_id = [r for r in dict.fromkeys(data) if r[0] is not None]
    check_mix(P.STAGES[-1][1](spark, frame(with_id, clashing=True), sf_dir).collect(), with_id)
    assert P.STAGES[-1][1](spark, frame(data), sf_dir).count() > 0


def test_empty_table(spark, sf_dir, frame):
    docs = frame([])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
