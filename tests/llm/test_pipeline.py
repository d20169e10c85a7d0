import random

import corpus_pipeline
import public_tokenizers
from roadweave.llm import pseudonyms, quality
from roadweave.llm.simhash import fingerprint
from test_simhash import brute as groups
from test_templates import brute as leaked
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("bdglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(900)] + ["the", "of", "and"] * 90
    prose = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(n)) + "."
    items = [(i, prose(2)) for i in range(6)]
    texts = [prose(rng.randrange(4, 30)) for _ in range(120)]
    texts += [prose(9).upper().replace(" ", "!! ") for _ in range(15)] + ["buy " * 80, "%%% ".join(prose(8).split()), None, "", " \n"]
    texts += texts[:6] * 3 + [texts[7] + " Coda mile", texts[8].replace(texts[8].split()[5], "other", 1)]
    texts += [f"{prose(5)} {items[i % 6][1]} {prose(4)}" for i in range(12)]
    texts += [f"{prose(6)} Call +1 (988) 555-{i:04d} or 42.144.35.{i}" for i in range(8)]
    rows = [(i * 7 % 1009 if i % 50 else None, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda r: tuple(map(str, r))
    state = sorted((tuple(r) for r in docs.collect()), key=order)
    assert state == sorted(rows, key=order)
    after = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns, name
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        got = sorted((tuple(r) for r in docs.collect()), key=order)
        if i == 0:
            _, weights, offset = quality.learn(before.select("text"))
            good = lambda t, w=weights, b=offset: quality._score(t.encode(), t.encode().split(), w, b) >= 0.5
            want = [r for r in state if good(r[1] or "")]
            assert {r[1] for r in rows[:120]} <= {r[1] for r in got} and not any("!!" in r[1] or not r[1].strip() for r in got)
        elif i == 1:
            labels = groups([(n, fingerprint(r[1].encode(), 4)) for n, r in enumerate(state)], 4)
            best = {}
            for label, r in zip(labels, state, strict=True):
                k = (r[0] is not None, r[0] or 0)
                best[label] = min(best.get(label, (k, r[1])), (k, r[1]))
            assert len(got) == len(best) and {(r[0] is not None, r[0] or 0) for r in got} == {k for k, _ in best.values()}
            want = got
        elif i == 2:
            want = [r for r in state if not leaked([(0, r[1])], items)]
            assert len(want) <= len(state) - 10
        elif i == 3:
            fresh = [(r, pseudonyms.pseudonymise(r[1], corpus_pipeline.SECRET)[0]) for r in state]
            want = sorted(((*r[:1], t, *r[2:4], len(t)) for r, t in fresh), key=order)
            assert sum(a[1] != t for a, t in fresh) >= 8
        else:
            own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            lengths = sorted((r[0] or -1, len(own.encode(r[1]).ids) + 1) for r in after[-1])
            totals = {}
            for r in docs.collect():
                totals[r.doc_id or -1, r.ids_crc32 if r.length < 2048 else -1] = r.length
            assert sum(n for _, n in lengths) == sum(r.length for r in docs.collect())
            assert docs.selectExpr("count(distinct sequence_id)").first()[0] <= sum(n for _, n in lengths) // 2048 + 2
            want = got
        assert got == sorted(want, key=order), name
        state = got
        after.append(got)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    columns = [c for c in ran.columns if c not in ("sequence_id", "offset")]
    assert sorted((tuple(r) for r in ran.select(columns).collect()), key=order) == sorted((tuple(r) for r in docs.select(columns).collect()), key=order)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
