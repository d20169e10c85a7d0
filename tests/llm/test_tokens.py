import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from roadweave.llm import packing, token_counts, tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " lead", "trail ", "two  spaces", "three   spaces\n\n x", "tab\there \n end", "no break  x", "nul\0 in", "<|endoftext|> word!", "it's Ünïcode 漢字 😀 12345", "!!! ?", "w　 v"]


def ids_of(text):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own.encode(text or "", add_special_tokens=False).ids


def test_cached_words_give_the_ids_of_the_whole_text():
    encode = tokens.Encoder(PATH)
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["ab", " ", "\n", "Cd", ".", "  ", "\t", "é", "'s", "9"]) for _ in range(60)) for _ in range(300)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [ids_of(t) for t in texts]


def _table(spark):
    rng = random.Random(4)
    long = " ".join("word%d" % rng.randrange(5000) for _ in range(9000))
    texts = [*TEXTS, long, *(" ".join(rng.choice("some more plain words here".split()) for _ in range(rng.randrange(1, 1500))) for _ in range(120))]
    rows = [(i if i != 3 else None, t, "x", 1, "y") for i, t in enumerate(texts)] + [(7, TEXTS[7], "x", 1, "y")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length string, _task int, sequence_id string").repartition(5)


def test_packing_is_whole_and_tight(spark):
    rows, docs = _table(spark)
    got = packing.pack(docs, PATH, with_ids=True).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for key, text, *_ in rows:
        mine = sorted(by_doc[key], key=lambda r: (r.piece, r.start))
        copies = sum(k == key for k, *_ in rows)
        assert [r.piece for r in mine] == sorted(list(range(len(mine) // copies)) * copies)
        one = mine[::copies]
        assert [r.start for r in one] == [sum(x.length for x in one[:i]) for i in range(len(one))]
        assert np.frombuffer(b"".join(r.ids for r in one), "<u4").tolist() == [*ids_of(text), 0]
        assert all(r.length == 2048 for r in one[1:])
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plan_near_its_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 2049, 50_000), np.minimum(2048, rng.lognormal(6.5, 1, 20_000).astype(int) + 1), rng.integers(1100, 2049, 3000), np.array([1025] * 5 + [683] * 10), np.array([5])):
        counts = np.bincount(lengths, minlength=2049)
        columns, bound = packing.plan(counts, 2048)
        have = np.zeros(2049, np.int64)
        for column, times in columns:
            assert sum(k * v for k, v in column) <= 2048 and times > 0
            for k, v in column:
                have[k] += v * times
        assert (have == counts).all()
        bins = sum(times for _, times in columns)
        print(len(lengths), bins, bound, len(columns))
        big = int((lengths > 1024).sum())
        assert bins <= max(bound, big) * 1.004 + 1


def test_token_files(spark, tmp_path):
    rows, docs = _table(spark)
    path = str(tmp_path / "in")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.count_documents(docs, str(tmp_path / "ids"), PATH).collect())
    assert got == sorted((k is None, k or 0, len(ids_of(t))) for k, t, *_ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_documents(empty, str(tmp_path / "none"), PATH).count() == 0


def test_separators_across_blocks(spark, tmp_path):
    e = token_counts.END_ID
    files = {"a": [1, 2, 3, 4, 5, 6, 7, e, e, 8, e], "b": [e, 1, 2], "c": [5] * 9, "d": [], "f": [1, 2, e]}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    want = set()
    for name, ids in files.items():
        start = nth = 0
        for i, x in enumerate([*ids, None]):
            if x == e or x is None and i > start:
                want.add((name, nth, start, i - start, x == e))
                nth, start = nth + 1, i + 1
    for size in (1, 2, 3, 100):
        got = {(r.path.split("/")[-1][0], r.nth, r.start, r.n_tokens, r.closed) for r in token_counts.document_lengths(spark, str(tmp_path), block_tokens=size).collect()}
        assert got == want


def test_words_looked_up_by_the_model_alone_and_over_generations(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    pieces = ["word", "Straße", "naïve", "x1", "it's", "###", "end.", "two,", "é.", ".,", "1.", "日本", "<|endoftext|>", "a\0b", "\x1c", "a\x85b", "🙂", "ǅ."]
    rng = random.Random(5)
    texts = ["", " ", "\n", " a", "a ", "a\n", "a\n\nb", "a  b", "a　b c", "\0"]
    texts += [rng.choice([" ", "\n"]).join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(400)]
    encode = tokens.Encoder(PATH)
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(some)] == [whole.encode(t, add_special_tokens=False).ids for t in some]
        # the cache holds two generations at most: no batch here brings more than a few dozen new words
        assert len(encode.known) < 200 and len(encode.before) < 200
