import math
import random
import zlib

from roadweave.llm import toxicity as t


def all_maximal(weights):
    """Recursive definition: the best segment (shortest, leftmost), then the same on both sides."""
    best = None
    for a in range(len(weights)):
        for b in range(a + 1, len(weights) + 1):
            s = sum(weights[a:b])
            if s > 1e-12 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and b - a < best[1] - best[0]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return all_maximal(weights[:a]) + [best] + [(b + x, b + y, z) for x, y, z in all_maximal(weights[b:])]


def test_segments_against_their_definition():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(0, 14)
        weights = [rng.choice([-1.0, -1.0, 1.37, 2.11, 0.53]) for _ in range(n)]
        places = [i for i, w in enumerate(weights) if w > 0]
        got = t.segments(places, [weights[i] for i in places], -1.0)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in all_maximal(weights)]


def corpus(rng, n):
    plain = ["".join(rng.choice("bdglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
    bad = ["vrakz", "zulgrim", "zulgrat", "zulgrok", "xofby"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice([",", ".", ""]))
        docs.append((i, " ".join(words), "x", 0.5, i % 2))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(random.Random(10), 1500)
    copies = [(5000 + i, "rupo tema lisu " * 30 + f"w{i % 3}", "x", 0.5, 1) for i in range(400)]  # a large group labelled 1 by mistake
    odd = [(9001, None, "x", 0.5, 1), (9002, "", "x", 0.5, 1), (None, "vrakz", "x", 0.5, 1), (9003, "!!", "x", 0.5, 1), (9004, "a " * 300_000 + "vrakz zulgrim xofby", "x", 0.5, 1), docs[0]]
    known = labels + [(k, 1, 1) for k, *_ in copies] + [(3, None, None), (4, 1, 0), (None, 1, 1)]
    schema = "doc_id long, text string, label string, score double, held_out int"
    table = spark.createDataFrame(docs + copies + odd, schema).repartition(4)
    got = t.score(table, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(copies) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [(by[i].predicted, y) for i, _, y in labels if by[i].held_out]
    assert sum(p == y for p, y in tested) >= 0.99 * len(tested)
    assert by[9001].score == by[9002].score == by[9003].score < 0.5 <= by[None].score
    assert by[9004].found and by[9004].found[0].begin == 300_000


def test_no_rows_and_no_labels(spark):
    docs, labels = "doc_id long, text string", "doc_id long, toxic int"
    none = spark.createDataFrame([], labels)
    assert t.score(spark.createDataFrame([], docs), none).count() == 0
    assert [r.predicted for r in t.score(spark.createDataFrame([(1, "a b")], docs), none).collect()] == [0]


def test_counts_are_not_capped(spark):
    """A toxic word that clean texts hold hundreds of times keeps its weight, as exact counts say; copies count once."""
    rng = random.Random(11)
    plain = ["".join(rng.choice("bdglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(2000)]
    rows = []
    for i in range(6000):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 3 == 0 and rng.random() < 0.9 or i % 3 and rng.random() < 0.1:
            words.insert(rng.randrange(20), "vrakz")
        rows.append((int(i % 3 == 0), " ".join(words)))
    texts = spark.createDataFrame(rows, "label int, text string").repartition(4)
    weights = {r.feature: r.weight for r in t.log_odds(texts).collect()}
    assert sum("vrakz" in x for y, x in rows if not y) > 300
    rate = [sum("vrakz" in x for y, x in rows if y == k) / sum(1 for y, _ in rows if y == k) for k in (0, 1)]
    assert abs(weights[t.features("vrakz")[0]] - math.log(rate[1] / rate[0])) < 0.15
