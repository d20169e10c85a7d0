import hashlib
import random
import zlib

import numpy as np
from roadweave.llm import periodic_runs, registry


def brute(w):
    """All runs by trying every start and period."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any((i, length, p) in out for p in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng):
    out = [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"a", b"b"] * 300, [b"x"] * 2000]
    for _ in range(250):
        n, kinds = rng.randrange(1, 90), rng.choice([1, 2, 2, 3, 8])
        w = [bytes([97 + rng.randrange(kinds)]) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            at, q = rng.randrange(n), rng.randrange(1, 12)
            piece = [bytes([97 + rng.randrange(kinds)]) for _ in range(q)]
            w[at:at] = (piece * rng.randrange(3, 9))[: rng.randrange(3 * q, 9 * q)]
        out.append(w)
    fib = [[b"b"], [b"a"]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    return [*out, fib[-1], [b"%d" % (i % 37) for i in range(1000)] + fib[9] * 7]


def test_runs_against_brute_force():
    found = texts(random.Random(1))
    assert periodic_runs.runs_of(found) == [brute(w) for w in found]


def test_candidates_without_any_run():
    """Five equal words are a candidate for period 1, too short for a run; nothing else is in the chunk."""
    assert periodic_runs.runs_of([[b"a"] * 5]) == [[]]
    assert periodic_runs.runs_of([[b"x"], [b"a"] * 4, []]) == [[], [], []]


def test_extensions_in_both_directions():
    rng = random.Random(2)
    w = [-1, *[rng.randrange(2) for _ in range(300)], -2, *([1, 0, 0] * 60), -3]
    a, b = (np.array(x) for x in zip(*[sorted(rng.sample(range(1, len(w) - 1), 2)) for _ in range(3000)], strict=True))
    levels = periodic_runs.compress(np.array(w))

    def plain(i, j, way):
        n = 0
        while 0 <= i + n * way and j + n * way < len(w) and w[i + n * way] == w[j + n * way]:
            n += 1
        return n

    assert periodic_runs.extensions(levels, a, b).tolist() == [plain(i, j, 1) for i, j in zip(a, b, strict=True)]
    assert periodic_runs.extensions(levels, a, b, back=True).tolist() == [plain(i, j, -1) for i, j in zip(a, b, strict=True)]


def test_grid_in_parts_and_chunks(monkeypatch):
    found = texts(random.Random(3))
    monkeypatch.setattr(periodic_runs, "GRID", 50)
    assert periodic_runs.runs_of(found[-40:]) == [brute(w) for w in found[-40:]]
    monkeypatch.setattr(periodic_runs, "CHUNK", 100)
    assert [w for part in periodic_runs._chunks(found) for w in part] == found


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "a b " * 9, 1), (7, None, 2), (8, "", 3), (8, "", 3), (9, "w " * 30_000, 4), (10, " \t", 5), (11, "Ü\x1cé x\x0b" * 8, 6)]
    rows += [(100 + i, " ".join(rng.choice("ab") + rng.choice(["", "", "c"]) for _ in range(rng.randrange(1, 60))), i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((repr(tuple(r)) for r in registry.op13_periodic_runs(spark, str(tmp_path)).collect()))
    want, changed = [], 0
    for key, text, _ in rows:
        w = (text or "").encode().split()
        n = len(w)
        if key is not None and n:
            h = zlib.crc32(str(key).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                changed += 1
        runs = brute(w) if n < 1000 else [(0, n, 1)]
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append(repr((key, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())))
    assert changed > 10 and got == sorted(want)


def test_no_rows(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
