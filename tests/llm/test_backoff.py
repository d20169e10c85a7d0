import math
import random
import zlib
from collections import Counter

import pytest
from roadweave.llm import backoff, registry


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def model(train, order, mu):
    """(probability of a word after a context, counts of words, N, V) straight from the definition."""
    c = Counter()
    for t in train:
        w = [b"\n", *tokens(t)]
        for i in range(1, len(w)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    c[tuple(w[i - k + 1 : i + 1])] += 1
    one = {k[0]: n for k, n in c.items() if len(k) == 1}
    n, v = sum(one.values()), len(one)

    def p(word, context):
        if not context:
            return (one.get(word, 0) + 1) / (n + v + 1)
        return (c[*context, word] + mu * p(word, context[1:])) / (c[context] + mu)

    return p, one, n, v


def brute(rows, order, mu):
    p, one, n, v = model([t for _, t, held in rows if not held], order, mu)
    out = []
    for key, text, held in rows:
        w = [b"\n", *tokens(text)]
        total = sum(math.log10(p(w[i], tuple(w[max(0, i - order + 1) : i]))) for i in range(1, len(w)))
        base = sum(math.log10((one.get(x, 0) + 1) / (n + v + 1)) for x in w[1:])
        out.append((key, bool(held), len(w) - 1, sum(x in one for x in w[1:]), n, base, total))
    return out


def same(got, want):
    key = lambda r: repr(r[:5]) + f"{r[5]:.6f}"
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def texts(rng, n):
    return [" ".join(rng.choice(["a", "B", "c", "é", "dd\x1c"]) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_brute_force(spark, order):
    rng = random.Random(order)
    rows = [(i, t, i % 5 == 2) for i, t in enumerate(texts(rng, 120))] + [(None, None, False), (7, "", False), (7, "", False), (8, "never seen here", True), (9, "a b " * 9000, True)]
    docs = spark.createDataFrame([(k, t, h, "x", 1) for k, t, h in rows], "doc_id long, text string, held boolean, block string, n int")
    same(backoff.score(docs.repartition(6), "held", order=order, mu=3.0).collect(), brute(rows, order, 3.0))


def test_words_after_a_context_sum_to_one():
    p, one, *_ = model(texts(random.Random(9), 40), 3, 2.0)
    for context in [(), (b"a",), (b"a", b"c"), (b"\n",), (b"?",)]:
        assert sum(p(w, context) for w in one) + p(b"unseen", context) == pytest.approx(1)


def test_small_blocks_and_ranges(monkeypatch):
    """Blocks cut one table in many ways; a batch's rows are each in one block, in order."""
    import pyarrow as pa

    monkeypatch.setattr(backoff, "BLOCK", 10)
    monkeypatch.setattr(backoff.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_pydict({"key": [1, 2, 3, 4], "text": ["a " * 30, "b", None, "c " * 8], "held": [False] * 4})
    cut = list(backoff._cut(iter([batch, batch])))
    assert [i for _, rows, _ in cut for i in rows] == [0, 1, 2, 3] * 2 and len({b for b, *_ in cut}) == len(cut) > 4


def test_packing_is_undone():
    import numpy as np

    x = np.array([0, 1, 255, 2**63, 2**64 - 1], np.uint64)
    assert (backoff._unpack(backoff._pack(x)) == x).all()


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(texts(rng, 200))]
    spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_lm_scores(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), brute(rows, 2, 1000.0))


def test_no_rows_and_no_training(spark):
    schema = "doc_id long, text string, held boolean"
    assert backoff.score(spark.createDataFrame([], schema), "held").count() == 0
    same(backoff.score(spark.createDataFrame([(1, "a b", True)], schema), "held").collect(), brute([(1, "a b", True)], 2, 1000.0))
