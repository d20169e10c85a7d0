import math
import random

from roadweave.llm import segment_search


def brute(rows, asked, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if asked(q):
            scores = {}
            for c, b in usable:
                if c != q and len(a) == len(b):
                    scores[c] = max(sum(x * y for x, y in zip(a, b, strict=True)), scores.get(c, -(10**30)))
            out += [(q, r, c, s) for r, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(set(out))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(5)]
    near = lambda: [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]
    rows = [(i, near(), 1, "s") for i in range(400)]
    rows += [(450, None, 1, "s"), (500, [1.0, None] * 12, 1, "s"), (None, near(), 1, "s"), (550, [math.nan] + [0.0] * 23, 1, "s"), (551, [math.inf] * 24, 1, "s")]
    rows += [(600, [1.0, 2.0], 1, "s"), (601, [0.5, 0.25], 1, "s"), (650, [3.0] * 7, 1, "s"), (700, [], 1, "s"), (701, [], 1, "s")]
    rows += [(800 + i, rows[20][1], 1, "s") for i in range(9)] + rows[5:12] + [rows[20]] * 30 + [rows[0]]  # ties and repeated rows
    schema = "vec_id long, embedding array<float>, rank int, score string"
    import numpy as np

    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], *r) for i, v, *r in rows]
    table = spark.createDataFrame(rows, schema).repartition(3)
    want = brute(rows, lambda q: q % 50 == 0, 5)
    for size in (2048, 16):
        monkeypatch.setattr(segment_search, "CANDIDATE_ROWS", size)
        monkeypatch.setattr(segment_search, "QUERY_ROWS", max(3, size // 8))
        for share in (1 / 50, 1.0, 4.0):  # one, some and many groups of queries
            got = segment_search.top_k(table, table.where("vec_id % 50 = 0"), share=share).collect()
            assert sorted(tuple(r) for r in got) == want


def test_other_queries_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], schema)
    asked = spark.createDataFrame([(9, [0.0, 1.0]), (1, [1.0, 1.0])], schema)
    got = segment_search.top_k(table, asked, 3, among=False).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2, 65536), (9, 1, 2, 32768), (9, 2, 1, 0)]
    none = spark.createDataFrame([], schema)
    assert segment_search.top_k(none, none).count() == 0
    assert segment_search.top_k(table, none).count() == 0
