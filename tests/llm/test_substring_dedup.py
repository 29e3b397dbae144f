import hashlib

from spindrift.llm import substring_dedup as D

LAST = 2**63 - 1


def brute(data):
    first = {}
    for d, t, *_ in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], LAST if d is None else d)
    for d, t, *_ in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (LAST if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        yield (d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())


def test_odd_rows(frame, odd_rows):
    base = odd_rows[5][1]
    data = odd_rows + [(5000 + k, "xy" * k + base[100 + k : 151 + k + k % 3] + "ü" * k, None, None, 0) for k in range(30)]
    data += [(6000, "a" * 200, None, None, 0), (6001, "b" + "a" * 120, None, None, 0), (6002, "ab" * 80, None, None, 0), (6003, "a" * 49, None, None, 0), (6004, "ba" * 25, None, None, 0)]
    got = sorted(map(tuple, D.removals(frame(data, clashing=True)).collect()), key=str)
    assert got == sorted(brute(data), key=str)


def test_texts_and_empty(frame, rows):
    out = D.removals(frame(rows), with_text=True).collect()
    assert all(r["n_removed"] == 0 or r["kept_text"] != "" or r["n_removed"] == r["n_bytes"] for r in out)
    assert D.removals(frame([])).count() == 0
