import random

import xxhash
from roadweave.llm import simhash


def plain(text, k):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + k]), 42) for i in range(max(1, len(found) - k + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute(fps, most):
    """Smallest key reachable, by repeated sweeps over all pairs."""
    label = [k for k, _ in fps]
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= most and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(60)) for _ in range(n)) for n in (400, 300, 5, 3, 90)]
    texts = [*base, *base, None, "", " \t", base[0].replace(base[0].split()[7], "X", 1), base[1] + " more words", "A b C", "a B c", "Ünï\x0bcode\x1cx y z w", "w " * 90_000]
    rows = [(100 - i, t, "clash", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = [(k, plain(t, 4)) for k, t, *_ in rows]
    assert {k: f for k, (f, _) in got.items()} == dict(fps)
    assert [got[k][1] for k, _ in fps] == brute(fps, 4)


def test_links_at_every_distance(spark):
    rng = random.Random(2)
    for most in (3, 4, 8):
        fps = []
        for _ in range(40):
            x = rng.getrandbits(64)
            fps += [x] + [x ^ sum(1 << b for b in rng.sample(range(64), d)) for d in range(1, most + 3)]
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        table = spark.createDataFrame([(x,) for x in signed], "fp long")
        got = {(r.a, r.b) for r in simhash.links(table, most).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= most}
        assert got == want


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string"
    got = simhash.near_duplicates(spark.createDataFrame([(None, None), (None, ""), (5, "x y"), (5, "x y")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component) for r in got) == [(0, None), (0, None), (5, 5), (5, 5)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_long_chain(spark):
    from roadweave.llm.components import connected_components

    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long").repartition(16)
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


def test_group_of_near_copies_by_stars(spark):
    """Chains, a group around one fingerprint, and pairs that no cell's smallest fingerprint meets: the same components as all pairs give."""
    rng = random.Random(6)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        fps |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(60)}
        for _ in range(40):
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed * 2], "fp long")
    root = {r.node: r.root for r in simhash.connected(table).collect()}
    label = brute(list(zip(signed, fps, strict=True)), 4)
    assert {x: root.get(x, x) for x in signed} == dict(zip(signed, label, strict=True))


def test_one_of_each_keeps_rows_whole(spark, tmp_path):
    rows = [(3, "a b c d e", "x"), (2, "A b c d e", "y"), (2, "A b c d e", "z"), (None, None, "n"), (9, "", "m"), (5, "w " * 60_000, "l")]
    spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3).write.parquet(f"{tmp_path}/t")
    got = simhash.one_of_each(spark.read.parquet(f"{tmp_path}/t"))
    assert got.columns == ["doc_id", "text", "_row"]
    assert sorted((r.doc_id or 0, r._row if r.doc_id != 2 else "") for r in got.collect()) == [(0, "n"), (2, ""), (5, "l")]
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_of_many_rows_are_not_broadcast_however_small_their_files(spark, monkeypatch):
    from pyspark.sql import functions as F
    from roadweave import session

    monkeypatch.setattr(session, "MANY_ROWS", 1000)

    def joined(n):
        wide = spark.range(n).select("id", *[F.lit(None).cast("string").alias(f"t{i}") for i in range(30)])
        other = spark.range(3000).select("id", F.lit("x").alias("v")).repartition(3)
        table = session.pin_table(wide)
        return other.join(table.select("id"), "id"), other.join(table.where("id >= 0").groupBy("id").count(), "id")

    for df, size in [(f, n) for n in (5, 2000) for f in joined(n)]:
        assert df.count() == size
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("Broadcast" in plan) == (size == 5), plan
