import random
import re
import zlib
from collections import Counter

from roadweave.llm import registry, spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    form, out = {}, {}
    for w in n:
        around = sorted((-n[x], x) for x in n if near(w, x))
        if around and -around[0][0] >= 2 * n[w]:
            form[w] = around[0][1]
        out[w] = len(around)
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n[w], out[w], n.get(form.get(w))) for w in n}


def words(rng):
    out = set()
    for _ in range(40):
        w = "".join(rng.choice("aabé") for _ in range(rng.randrange(0, 9)))
        out.add(w)
        for _ in range(12):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i:], w[:i] + rng.choice("aÀ") + w[i + 1 :]])
            out.add(w)
    return sorted(out)


def test_variants_against_brute_force(spark):
    rng = random.Random(1)
    n = {w: rng.choice([3, 3, 4, 6, 7, 13, 26, 60, 200]) for w in [*words(rng), "x" * 3000, "x" * 3001, "x" * 2999 + "y"]}
    got = spelling.variants(spark.createDataFrame([*n.items(), (None, 9), ("rare", 2)], "word string, n long"))
    want = brute({w: k for w, k in n.items() if len(w) < 100})
    long = {w: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect() for w in [r.word]}
    assert {w: long[w] for w in want} == want and set(long) == set(n)
    assert [long["x" * 3000][3], long["x" * 3001][3], long["x" * 2999 + "y"][3]] == [2, 1, 1]


def test_one_character_in_every_place(spark):
    """All replacements, insertions and deletions of one word: as many words in a group as the alphabet has characters."""
    letters = [chr(i) for i in [*range(97, 123), *range(0xC0, 0x100)]]
    w = "aabbc"
    forms = {w, *(w[:i] + x + w[i + k :] for i in range(6) for k in (0, 1) for x in ["", *letters])}
    n = {x: 3 + zlib.crc32(x.encode()) % 9 for x in forms}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == brute(n)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["street", "Streets", "streat", "größe", "grösse", "ABBEY", "abbeys", "señor", "senor", "Ärger", "ärger", "tests", "house1house", "e"]
    rows = [(None, "street " * 5, "x", 1), (3, None, "x", 1), (4, "", "x", 1), (4, "", "x", 1), (5, "street " * 9000, "x", 1), (5, "a" * 100_000, "x", 1)]
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))), "x", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    n, changed = Counter(), 0
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = 1 if key is None else zlib.crc32(f"{key}:{w}".encode())
            if h % 97 == 0:
                w, changed = w[: h % len(w)] + w[h % len(w) + 1 :], changed + 1
            n[w] += 1
    want = brute({w: k for w, k in n.items() if k >= 3 and len(w) >= 5})
    got = registry.op12_spelling_variants(spark, str(tmp_path)).collect()
    assert changed and {r.word: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(docs)).count() == 0
