"""Connected components: few links take few rounds, many take as many as they need, with the same outcome."""

import random

from roadweave.operators import components


def written(monkeypatch):
    made, write = [], components.pin_table
    monkeypatch.setattr(components, "pin_table", lambda df: made.append(1) or write(df))
    return made


def outcome(spark, pairs, parts):
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(parts)
    return {r.node: r.root for r in components.connected_components(edges, "a", "b").collect()}


def test_few_links_in_many_partitions_take_no_rounds(spark, monkeypatch):
    """A chain in 40 partitions took several rounds of four tables each, and one more to see that nothing changed."""
    made = written(monkeypatch)
    assert outcome(spark, [(i, i + 1) for i in range(200)], 40) == dict.fromkeys(range(201), 0)
    assert len(made) == 2


def test_rounds_without_thinning(spark, monkeypatch):
    """As if no two links met in a task: a long chain, a hub, random links; nulls, loops and repeats."""

    def as_they_are(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            high, low = pc.max_element_wise(*b.columns), pc.min_element_wise(*b.columns)
            yield pa.RecordBatch.from_arrays([high, low], names=["u", "v"])

    monkeypatch.setattr(components, "_forest", as_they_are)
    made = written(monkeypatch)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(80)] + [(500, 500 + i) for i in range(60)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    pairs += [(None, 3), (4, None), (7, 7), (1, 0)]
    up = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in pairs:
        if None not in (a, b) and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert outcome(spark, pairs, 16) == {x: root(x) for x in up}
    assert len(made) > 2


def test_no_links(spark):
    assert outcome(spark, [], 2) == {}
