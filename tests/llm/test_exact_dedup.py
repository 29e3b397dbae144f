import hashlib
import re

from comparing import of_sql
from comparing import rows as shown

from spindrift.llm import exact_dedup as E


def brute(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, *_ in data]
    groups = {}
    for (d, t, *_), n in zip(data, norm, strict=True):
        groups.setdefault(n, []).append((-len(t or ""), d is None, d))
    for (d, *_), n in zip(data, norm, strict=True):
        keep = min(groups[n], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        yield (d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest())


def test_against_brute_force(frame, odd_rows):
    index = E.DigestIndex(frame([]).sparkSession, buckets=4)
    got = sorted(map(tuple, E.ingest(frame(odd_rows, clashing=True), index).collect()), key=str)
    assert got == sorted(brute(odd_rows), key=str)
    index.drop()


def test_index_persists(frame, rows):
    spark = frame([]).sparkSession
    index = E.DigestIndex(spark, buckets=4)
    first = E.deduplicate(frame(rows[:100]), index).count()
    again = E.ingest(frame(rows[:120]), index).collect()
    seen = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "").encode()).hexdigest() for r in rows[:100]}
    assert len(seen) == first and not any(r["kept"] for r in again if r["text_sha256"] in seen)
    assert index.read().count() == len({hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "").encode()).hexdigest() for r in rows[:120]})
    index.drop()


def test_filter_and_empty(frame, odd_rows):
    kept = E.deduplicate(frame(odd_rows)).collect()
    assert len({re.sub(r"\s+", "", r["text"] or "") for r in odd_rows_as_dicts(odd_rows)}) == len({re.sub(r"\s+", "", r["text"] or "") for r in kept})
    assert E.deduplicate(frame([])).count() == 0


def odd_rows_as_dicts(data):
    return [{"text": t} for _, t, *_ in data]


def test_clashing_names_and_extreme_ids(frame, odd_rows):
    data = [*odd_rows, (-(2**63), odd_rows[3][1], None, None, 0), (2**63 - 1, odd_rows[4][1], None, None, 0), (-5, "a b", None, None, 0), (-4, "a  b", None, None, 0), (-6, "ab", None, None, 0)]
    df = frame(data, clashing=True)
    out = E.deduplicate(df)
    assert out.columns == df.columns
    want = [d for d, _, _, kept, _ in brute(data) if kept]
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(want, key=str)


def test_the_anti_join_decides(frame, monkeypatch):
    """Without it a group whose rows fall into both appends would be new twice."""
    data = [(i, " " * (i % 2) * 9 + f"text {i // 2}", None, None, 0) for i in range(40)]
    index = E.DigestIndex(frame([]).sparkSession, buckets=4)
    assert sorted(map(tuple, E.ingest(frame(data), index).collect())) == sorted(brute(data))
    assert index.read().count() == 20
    index.drop()
    monkeypatch.setattr(E.DigestIndex, "unseen", lambda self, new: new)
    assert sorted(map(tuple, E.ingest(frame(data), index).collect())) != sorted(brute(data))
    index.drop()


def test_sql(spark, sf_dir):
    assert shown(E.op7_exact_dedup(spark, sf_dir).toPandas()) == shown(of_sql(E.ORACLE, sf_dir))
