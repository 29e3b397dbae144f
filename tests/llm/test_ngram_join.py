import collections
import re

import pytest

from spindrift.llm import ngram_join as J


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(data):
    sets = []
    for _, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    places = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            places[g].append(i)
    same = collections.Counter((a, b) for own in places.values() for b in own for a in own if a < b)
    parent = list(range(len(data)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in same.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for i, (d, *_) in enumerate(data):
        groups[top(i)].append(d)
    low = {g: min((d for d in own if d is not None), default=None) for g, own in groups.items()}
    return sorted(((d, len(sets[i]), low[top(i)] if sets[i] else d) for i, (d, *_) in enumerate(data)), key=str)


def got(frame, data, **how):
    return sorted(map(tuple, J.near_duplicates(frame(data, **how)).collect()), key=str)


def test_odd_rows(frame, odd_rows):
    assert got(frame, odd_rows, clashing=True) == brute(odd_rows)


def test_chains_and_hubs(frame, rows):
    base = rows[5][1].split()[:60]
    data = [(i, " ".join(base[: 60 - i] + [f"w{j}" for j in range(i)]), "en", "a", 0) for i in range(30)]
    hub = rows[9][1].split()[:100]
    # copies that are near the hub alone: each has its own five words changed
    data += [(100 + i, " ".join(f"v{i}" if j in (i % 80, i % 80 + 7, i % 80 + 14) else w for j, w in enumerate(hub)), "en", "a", 0) for i in range(60)]
    data += [(99, " ".join(hub), "en", "a", 0), (300, "a b c d e f g h", None, None, 0), (301, "a b c d e f g", None, None, 0)]
    assert got(frame, data) == brute(data)


@pytest.mark.parametrize("common", [20, 60])
def test_a_passage_that_all_share(frame, rows, common):
    passage = rows[9][1].split()[:common]
    data = [(i, " ".join([f"x{i}-{j}" for j in range(i % 25)] + passage), "en", "a", 0) for i in range(60)]
    assert got(frame, data) == brute(data)


@pytest.mark.parametrize("split", [5, 40])
def test_split_columns(frame, rows, split):
    """Columns of more nodes than one block takes are dealt over several."""
    base = rows[9][1].split()[:120]
    data = [(i, " ".join(f"v{i}" if j in (i % 110, i * 7 % 110) else w for j, w in enumerate(base)), "en", "a", 0) for i in range(90)] + rows[:40]
    assert sorted(map(tuple, J.near_duplicates(frame(data), split=split).collect()), key=str) == brute(data)


def test_partners_of_fitting_sizes():
    import numpy as np

    rng = np.random.default_rng(3)
    gram = np.sort(rng.integers(0, 12, 200)).astype(np.uint64)
    fact = np.zeros(200, J.FACT)
    fact["group"], fact["size"] = rng.integers(0, 3, 200), rng.integers(1, 40, 200)
    want = [
        min((int(fact["size"][j]) for j in range(200) if gram[j] == gram[i] and fact["group"][j] != fact["group"][i] and 100 * min(fact["size"][i], fact["size"][j]) >= 75 * max(fact["size"][i], fact["size"][j])), default=0)
        for i in range(200)
    ]
    assert J._partners(gram, fact).tolist() == want


def test_filter_and_empty(frame, rows):
    assert J.keep_one(frame(rows)).count() == len({c for _, _, c in brute(rows)})
    assert got(frame, []) == []


def test_grams_that_agree_in_32_bits():
    """A column block tells grams apart whose hashes differ above their low 32 bits alone."""
    import numpy as np
    import pyarrow as pa

    gram = np.array([7, 7 | 1 << 33, 7 | 1 << 47], np.uint64)
    both = np.concatenate([gram, gram])
    row = {"block": [0], "nodes": [np.array([11, 22], np.int64).tobytes()], "cells": [np.array([3, 3], np.uint32).tobytes()], "low": [both.astype(np.uint32).tobytes()], "high": [(both >> np.uint64(32)).astype(np.uint16).tobytes()]}
    empty = pa.array([b""])
    table = pa.table({**row, "facts": pa.array([None], pa.binary()), "marks": empty, "sums": pa.array([None], pa.binary())})
    assert {(r["a"], r["b"], r["n"]) for r in J._counted(table).to_pylist()} == {(11, None, 3), (22, None, 3)}
    asks = np.array([1, 0, 22], np.int64).tobytes()  # numbers of partners, then partners
    assert [(r["a"], r["b"], r["n"]) for r in J._pair_product(pa.table({**row, "facts": [asks], "marks": empty, "sums": empty})).to_pylist()] == [(11, 22, 3)]


def test_a_hot_group_is_folded(frame, rows):
    """Many near copies in one batch: their columns are folded, also those that other batches hold."""
    base = rows[9][1].split()[:120]
    data = [(i, " ".join(f"v{i}" if j in (i % 110, i % 110 + 8) else w for j, w in enumerate(base)), "en", "a", 0) for i in range(400)]
    data += [(1000 + i, " ".join(base[: 30 + 2 * i] + [f"z{i}"] * 3), "en", "a", 0) for i in range(40)]
    data += data[5:9] * 3
    assert got(frame, data) == brute(data)
    assert sorted(map(tuple, J.near_duplicates(frame(data).repartition(7)).collect()), key=str) == brute(data)


def test_keep_one_with_clashing_names(frame, odd_rows):
    df = frame(odd_rows, clashing=True)
    out = J.keep_one(df)
    assert out.columns == df.columns
    low = {(d, n): c for d, n, c in brute(odd_rows)}
    assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == {d for (d, _), c in low.items() if d is not None and d == c}
