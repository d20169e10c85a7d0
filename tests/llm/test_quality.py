import os
import random

import numpy as np
import pytest
from roadweave.llm import quality as q


def test_accuracies_of_known_labellers():
    rng = random.Random(11)
    truth = [rng.random() < 0.8 for _ in range(6000)]
    right = [(0.99, 0.6), (0.97, 0.5), (0.95, 0.7), (0.98, 0.5), (0.9, 0.6), (0.95, 0.6), (0.97, 0.4), (0.99, 0.7)]  # P(g | good), P(b | bad)
    patterns = {}
    marks = []
    for good in truth:
        k = "".join("-" if rng.random() < 0.2 else ("gb"[rng.random() >= a] if good else "bg"[rng.random() >= b]) for a, b in right)
        patterns[k] = patterns.get(k, 0) + 1
        marks.append(k)
    p, share, table = q.accuracies(patterns)
    assert abs(share - 0.8) < 0.03
    assert sum((p[k] >= 0.5) == t for k, t in zip(marks, truth, strict=True)) > 0.97 * len(truth)
    for (a, b), t in zip(right, table, strict=True):
        assert abs(t[0, 0] - a) < 0.03 and abs(t[1, 1] - b) < 0.06
    assert q.accuracies({})[0] == {}


def test_votes():
    prose = ("The end of the day was near and it rained on the hills. " * 2).encode()
    assert "b" not in q.votes(prose, prose.split())
    assert q.votes(b"", []) == "b" * 8
    loud = prose.upper()
    assert q.votes(loud, loud.split())[0] == "b"
    same = b"word " * 90
    assert q.votes(same, same.split())[2] == "b"


def test_odd_rows(spark):
    rng = random.Random(12)
    plain = ["".join(rng.choice("bdglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)] + ["the", "of", "and"] * 60
    prose = lambda n: ". ".join(" ".join(rng.choice(plain) for _ in range(12)).capitalize() for _ in range(n)) + "."
    junk = lambda n: rng.choice([prose(n).upper().replace(" ", "!! "), "buy " * n * 9, " | ".join(prose(n).split()), "%%% ".join(prose(n).split())])
    rows = [(i, prose(rng.randrange(3, 30)), 1, "s") for i in range(300)] + [(1000 + i, junk(rng.randrange(6, 30)), 1, "s") for i in range(60)]
    odd = [(2000, None, 1, "s"), (2001, "", 1, "s"), (2002, " \n", 1, "s"), (None, rows[0][1], 1, "s"), rows[5], (2003, prose(30_000), 1, "s")]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, votes int, score string").repartition(4)
    got = q.classify(table).collect()
    assert len(got) == len(rows) + len(odd)
    keep = {r.doc_id: r.keep for r in got}
    assert not any(keep[i] for i in (2000, 2001, 2002)) and keep[None] and keep[2003]
    assert np.mean([keep[i] for i in range(300)]) > 0.99 and np.mean([keep[1000 + i] for i in range(60)]) < 0.03
    assert q.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/labels.parquet"), reason="no test tables")
def test_agreement_with_given_labels(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rows = q.classify(read("documents")).join(read("labels"), "doc_id").collect()
    right = np.mean([r.keep == (r.quality == 1) for r in rows])
    assert right > 0.97, right
