import random
from collections import Counter

import regex
from roadweave.llm import templates as t
from pyspark.sql import functions as F


def plain(text):
    """The template and slot values of a text, written anew word by word."""
    found = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", (text or "").replace("#", "~")) if w] or [""]
    out, slots = [], []
    for i, w in enumerate(found):
        starts = i > 0 and found[i - 1][-1] not in ".!?:"
        m = regex.match(r"\p{Lu}[\p{L}\p{M}]*", w)
        c = "#p" + w[m.end() :] if m and starts else w
        if regex.search("[0-9]", c):
            c = "#n"
        c = c.lower()
        c = "#s" if c and not regex.search(r"[\p{L}\p{N}#]", c) else regex.sub(r"[^\p{L}\p{N}\s#]+", "", c)
        c = "#n" if c in t.NUMBER_WORDS else c
        c = "#u" if c in t.UNITS and out and out[-1] == "#n" else c
        out.append(c)
        v = w.lower()
        if regex.search(r"[\p{L}\p{N}]", v):
            v = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", v)
        slots.append(v)
    return out, slots


def _judge(hits, total):
    """Number of windows of one place whose slots agree; hits (q, filled)."""
    counts = Counter(x for _, f in hits for x in f)
    usual = {}
    for (k, a, b), n in counts.items():
        usual[k, a] = max(usual.get((k, a), (0, "")), (n, b))
    good = {q for q, f in hits if all(usual[k, a][1] == b for k, a, b in f)}
    return len(good) if len(good) >= 0.8 * total else 0


def brute(docs, items):
    """One place that holds four fifths of a text's windows suffices; texts without a window are met as a whole."""
    texts = [(item, *plain(text)) for item, text in items]
    out = []
    for key, text in docs:
        c, v = plain(text)
        best = {}
        for item, ic, iv in texts:
            typed = lambda q, p, n: tuple((k, a, b) for k, a, b in zip(ic[q : q + n], iv[q : q + n], v[p : p + n], strict=True) if k in ("#n", "#u", "#p"))  # noqa: B023, E731
            usable = [q for q in range(len(ic) - 4) if sum(not x.startswith("#") for x in ic[q : q + 5]) >= 3]
            found = []
            if usable:
                hits = [(q, p, typed(q, p, 5)) for q in usable for p in range(len(c) - 4) if c[p : p + 5] == ic[q : q + 5]]
                found.append(_judge([(q, f) for q, _, f in hits], len(usable)))
                for d in {p - q for q, p, _ in hits}:
                    nearest = {}
                    for q, p, f in hits:
                        if abs(p - q - d) <= t.REACH:
                            nearest[q] = min(nearest.get(q, (99, 0, ())), (abs(p - q - d), p, f))
                    found.append(_judge([(q, f) for q, (_, _, f) in nearest.items()], len(usable)))
            elif len(ic) >= 3:
                for p in range(len(c) - len(ic) + 1):
                    if c[p : p + len(ic)] == ic:
                        f = set(typed(0, p, len(ic)))
                        verbatim = len(ic) < 5 or all(x.startswith("#") for x in ic)
                        found.append(int(v[p : p + len(ic)] == iv if verbatim else len(f) == len({x[:2] for x in f})))
            total = len(usable) or 1
            if found and max(found):
                best[item] = max(best.get(item, (0, 0, 0)), (max(found) / total, total, max(found)))
        out += [(key, item, total, n) for item, (_, total, n) in best.items()]
    return out


def test_templates_word_by_word(spark):
    texts = ["A train leaves Paris at 5 km per hour. Then Bob has twenty apples!", "", None, " x ", "SHOUT!! ALL THE! TIME,", "#tag a-b it's $3.50/kg 7 kg, 7kg - -- é É Éa a.B", "One\ttwo\nThree  four", "a %%% b&&& | c 1,2"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: (r.c, r.v) for r in table.select("i", t.template(F.col("x")).alias("c"), t.values(F.col("x")).alias("v")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == plain(x), x


def test_leaks_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("bdglmn") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    word = lambda: rng.choice([rng.choice(vocabulary)] * 6 + [rng.choice(["Anna", "Berlin", "Carl"]), str(rng.randrange(3, 9)), "kg", rng.choice(vocabulary) + ".", "six"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 15, 15, 20, 30, 30, 45, 60, 3])] + [(None, "x y z " * 9), (50, None), (51, ""), (3, "another text of item three with more words in it than five")]
    docs = []
    for i in range(250):
        body = [word() for _ in range(rng.randrange(0, 60))]
        x = (rng.choice(items)[1] or "").split()
        kind = rng.randrange(5)
        if kind == 1:  # other parameters, the same one for the same one
            new = {w: rng.choice(["77", "81", "95"]) for w in x if w.isdigit()} | {"Anna": "Dora", "Berlin": "Rome"}
            x = [new.get(w, w) for w in x]
        if kind == 2:  # different ones for the same
            x = [str(rng.randrange(1000)) if w.isdigit() else w for w in x]
        if kind == 3 and x:
            x[rng.randrange(len(x))] = "changed"
        if kind == 4:
            x = x[: rng.randrange(len(x) + 1)]
        at = rng.randrange(len(body) + 1)
        docs.append((i if i % 20 else None, " ".join(body[:at] + x + body[at:])))
    docs += [(900, None), (901, ""), docs[1], (902, "w " * 50_000 + (items[6][1]))]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*d, 1, "h", 2) for d in docs], "doc_id long, text string, item_id int, h string, row int").repartition(3).write.parquet(path)
    table, bench = spark.read.parquet(path), spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, row int")
    want = brute(docs, [x for x in items if x[0] is not None])
    got = t.find(table, bench).collect()
    order = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert len(want) > 60
    kept = t.without_leaks(table, bench)
    assert kept.columns == table.columns
    long = [x for x in items if x[0] is not None]
    clean = [d for d in docs if not brute([d], long)]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((k or 0, x or "") for k, x in clean)


def test_long_items_only_and_empty_tables(spark, tmp_path):
    rng = random.Random(14)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((15, 17, 25, 40))]
    docs = []
    for i in range(120):
        x = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = "other"
        docs.append((i, " ".join([*(rng.choice(words) for _ in range(rng.randrange(20))), *x, "end"])))
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in t.find(spark.read.parquet(path), bench).collect()) == sorted(brute(docs, items))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert t.find(none, bench).count() == 0
    assert t.find(spark.read.parquet(path), spark.createDataFrame([], "item_id long, text string")).count() == 0


def probe(spark, tmp_path, items, docs):
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in t.find(spark.read.parquet(path), bench).collect())
    assert got == sorted(brute(docs, items))
    return [r[:2] for r in got]


def test_an_item_twice_in_a_document_with_other_values(spark, tmp_path):
    item = "a hall of 12 by 30 feet joins a room of 44 by 55 feet , so how large is the floor of 12 by 30 and of 44 by 55 feet in all"
    other = lambda *new: " ".join({"12": new[0], "30": new[1], "44": new[2], "55": new[3]}.get(w, w) for w in item.split())
    one, two, mixed = other("13", "31", "47", "58"), other("61", "72", "83", "94"), other("1", "2", "3", "4").replace("of 1 by 2 and", "of 7 by 9 and").replace("of 3 by 4 feet in", "of 5 by 6 feet in")
    torn = " ".join([*item.split()[:14], *(f"x{chr(97 + i)}" for i in range(20)), *item.split()[14:]])
    docs = [(1, one), (2, f"{one} and then {two}"), (3, f"{one} {two}"), (4, mixed), (5, f"so {item} {one} {two} {other('5', '6', '7', '8')}"), (6, torn)]
    got = probe(spark, tmp_path, [(1, item)], docs)
    assert [r for r, _ in got if r != 6] == [1, 2, 3, 5]


def test_short_and_number_heavy_items(spark, tmp_path):
    items = [(1, "What is 17 * 23 + 4 ?"), (2, "solve for x"), (3, "17 + 4"), (4, "x"), (5, "the sum of all the first ten odd numbers"), (5, "sum up it"), (6, "3 + 4 = 7 - 0")]
    docs = [(1, "Well. What is 17 * 23 + 4 ? Say."), (2, "so: What is 18 * 29 + 5 ?"), (3, "please solve for x now"), (4, "17 + 4"), (5, "17 + 5"), (6, "sum up it"), (7, "x"), (8, "What is 18 * 29 + 5"), (9, "3 + 4 = 7 - 0"), (10, "2 + 4 = 6 - 0")]
    assert probe(spark, tmp_path, items, docs) == [(1, 1), (2, 1), (3, 2), (4, 3), (6, 5), (9, 6)]
