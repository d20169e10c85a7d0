import random
from collections import Counter

import numpy as np
import pytest
from roadweave.llm import relative_lz


def brute(texts, n):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append((" ".join(x.decode() for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def make(rng, n_docs, vocabulary):
    passage = [[rng.choice(vocabulary) for _ in range(k)] for k in (34, 35, 36, 50, 90, 200)]
    texts = []
    for _ in range(n_docs):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passage)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            parts += rng.choice([p, p[a:b], [rng.choice(vocabulary) for _ in range(rng.randrange(60))]])
        texts.append(" ".join(parts))
    return texts


def check(spark, tmp_path, texts, n=35):
    path = str(tmp_path / f"docs{random.random()}")
    rows = [(i if i % 9 else None, t, 1, "h") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, rid int, h string").repartition(4).write.parquet(path)
    got = relative_lz.remove_duplicates(spark.read.parquet(path), window=n).collect()
    want = [(k, *b) for (k, *_), b in zip(rows, brute(texts, n), strict=True)]
    order = lambda x: (x[0] is None, *map(str, x))
    assert sorted(((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got), key=order) == sorted(want, key=order)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    check(spark, tmp_path, [*make(rng, 60, [f"w{i}" for i in range(400)]), None, "", " \x0b\t", "a " * 34, "b " * 200, "ç\xa0d e\x1cf " * 40])


def test_few_words_and_repeats(spark, tmp_path):
    rng = random.Random(7)
    texts = make(rng, 25, ["x", "y"])
    check(spark, tmp_path, texts + texts[:3], 35)
    check(spark, tmp_path, texts[:8], 12)


def test_empty_table_and_bounds(spark):
    assert relative_lz.remove_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="window"):
        relative_lz.remove_duplicates(spark.createDataFrame([], "doc_id long, text string"), window=200)


def test_slices_do_not_matter(monkeypatch):
    h = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    begins = np.array([0, 100, 100, 500])
    want = relative_lz._anchors(h, begins, 35)
    monkeypatch.setattr(relative_lz, "_SLICE", 40)
    assert all((a == b).all() for a, b in zip(want, relative_lz._anchors(h, begins, 35), strict=True))
