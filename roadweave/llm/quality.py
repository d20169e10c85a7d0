"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import arrow_rows, text_bytes, words

SAMPLE = 8000  # documents that the scorer is fitted on
DIMENSIONS = 1 << 12
#: Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and a to in is that it was for on with as be by this from or an are have not which at "
        "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden "
        "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il "
        "que el y los se del las por con no una su para es al lo como más o pero sus le ha me"
    ).split()
)
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~!"
_SPACE = b" \t\n\x0b\x0c\r"
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
GOOD, BAD, NONE = "g", "b", "-"
LABELLERS = ("capitals", "symbols", "repeats", "variety", "columns", "function words", "sentences", "letters")


def _vote(value: float, good: float, bad: float) -> str:
    """Good up to one bound, bad from the other on (in whichever direction), nothing between."""
    if good > bad:
        value, good, bad = -value, -good, -bad
    return GOOD if value <= good else BAD if value >= bad else NONE


def votes(text: bytes, found: list[bytes]) -> str:
    """One letter for each labeller; a text without words gets bad from all."""
    n = len(found)
    if not n:
        return BAD * len(LABELLERS)
    left = lambda drop: len(text) - len(text.translate(None, drop))
    letters, visible = left(_LETTERS), len(text) - left(_SPACE)
    bare = sum(w in FUNCTION_WORDS for w in found) / n
    ends = sum(w.endswith((b".", b"!", b"?", b".\"")) for w in found) / n
    lone = sum(len(w) == 1 and not w.isalnum() and w < b"\x80" for w in found) / n
    return "".join(
        (
            _vote(left(_UPPER) / max(1, letters), 0.2, 0.5),
            _vote(left(_SYMBOLS) / n, 0.1, 0.4),
            _vote(sum(map(operator.eq, found, found[1:])) / n, 0.05, 0.2),
            NONE if n < 30 else _vote(len(set(found)) / n**0.5, 3.5, 2.0),
            _vote(lone, 0.02, 0.1),
            NONE if n < 10 else _vote(bare, 0.1, 0.02),
            NONE if n < 30 else BAD if ends > 0.5 else GOOD if ends > 0.005 else NONE,
            NONE if n < 20 else _vote(letters / visible, 0.9, 0.75),
        )
    )


def hashed(text: bytes, found: list[bytes]) -> tuple[list[int], list[float]]:
    """Buckets and values of the word shapes (first and last two character classes), their length classes and repetition."""
    n = len(found) + 20  # short texts show little
    shapes = Counter(s[:1] + s[-2:] for s in text.translate(_SHAPE).split())
    shapes.update({b"len%d" % k: c for k, c in Counter(min(len(w), 20) // 3 for w in found).items()})
    shapes[b"again"] = sum(map(operator.eq, found, found[1:]))
    shapes[b"function"] = sum(w in FUNCTION_WORDS for w in found)
    out: Counter = Counter()
    for k, c in shapes.items():
        out[zlib.crc32(k) % DIMENSIONS] += (c / n) ** 0.5
    return list(out), list(out.values())


def accuracies(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], float, np.ndarray]:
    """P(good) of every vote pattern, the share of good documents, and each labeller's P(vote good), P(vote bad) by class.

    Expectation-maximisation of a two-class model in which the labellers vote independently given the class; who doesn't
    vote says nothing. Each labeller knows one kind of fault, so it begins from the belief that a vote against a document
    outweighs votes for it. Counts have a light prior. Input and work depend on the number of patterns only.
    """
    keys = list(patterns)
    if not keys:
        return {}, 0.5, np.full((len(LABELLERS), 2, 2), 0.5)
    count = np.array([patterns[k] for k in keys], np.float64)
    vote = np.array([[(GOOD, BAD, NONE).index(c) for c in k] for k in keys])
    one = np.eye(3)[vote][:, :, :2]  # pattern, labeller, vote
    p = 0.95 * 0.2 ** (vote == 1).sum(1)
    for _ in range(rounds):
        share = (count @ p + 4) / (count.sum() + 5)
        both = np.stack([p, 1 - p]) * count
        table = np.einsum("cp,plv->lcv", both, one) + np.array([[9.0, 0.2], [3.0, 1.0]])
        table /= table.sum(2, keepdims=True)
        log = np.einsum("plv,lcv->pc", one, np.log(table)) + np.log([share, 1 - share])
        p = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
    return dict(zip(keys, p.tolist(), strict=True)), float(share), table


def fit(rows: list[tuple[list[int], list[float], float]], steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer on (buckets, values, P(good)); full gradient steps with momentum."""
    w, b = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return w, b
    at = np.concatenate([np.array(r[0], np.int64) for r in rows])
    value = np.concatenate([np.array(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    target = np.array([r[2] for r in rows])
    speed, speed_b = np.zeros(DIMENSIONS), 0.0
    for _ in range(steps):
        z = np.bincount(row, value * w[at], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        speed = 0.9 * speed + np.bincount(at, value * g[row], DIMENSIONS) + 1e-5 * w
        speed_b = 0.9 * speed_b + g.sum()
        w, b = w - 2.0 * speed, b - 2.0 * speed_b
    return w, b


def learn(texts: DataFrame):
    """From a table of one text column: (P(good) of vote patterns, weights, offset), as `classify` describes."""
    rows = texts.toDF("text")

    def voted(batch: pa.RecordBatch) -> dict:
        return {"votes": [votes(t, words(t)) for t in text_bytes(batch.column(0))]}

    def featured(batch: pa.RecordBatch) -> dict:
        both = [(t, words(t)) for t in text_bytes(batch.column(0))]
        pairs = [hashed(t, w) for t, w in both]
        return {"votes": [votes(t, w) for t, w in both], "at": [a for a, _ in pairs], "value": [v for _, v in pairs]}

    counted = arrow_rows(rows, "votes string", voted).groupBy("votes").agg(F.count("*").alias("n"))
    patterns = {r.votes: r.n for r in counted.collect()}  # at most 3^8
    patterns.pop(BAD * len(LABELLERS), None)
    posterior, _, _ = accuracies(patterns)
    chance = min(1.0, 2 * SAMPLE / max(1, sum(patterns.values())))  # some more than SAMPLE by hash, then exactly SAMPLE
    drawn = rows.select("text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull() & (F.pmod("h", F.lit(1 << 20)) <= int(chance * (1 << 20))))
    drawn = drawn.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).select("text")
    sample = arrow_rows(drawn, "votes string, at array<int>, value array<double>", featured).collect()
    labelled = [(r.at, r.value, posterior[r.votes]) for r in sample if r.votes in posterior]
    return posterior, *fit(labelled)


def _score(text: bytes, found: list[bytes], weights: np.ndarray, offset: float) -> float:
    if not found:
        return 0.0
    at, value = hashed(text, found)
    return float(1 / (1 + np.exp(-np.clip(np.dot(weights[at], value) + offset, -30, 30))))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, votes, posterior, score, keep) per row of docs, without any given labels.

    Eight heuristics vote on every document. Their vote patterns (at most 3^8) are counted over all documents, and
    expectation-maximisation estimates how accurate each is. The posteriors label at most SAMPLE documents (those with
    the smallest hashes of their texts), on which a logistic scorer over hashed word
    shapes is fitted. score is its probability that a document is good; keep is score >= 0.5.

    Null and empty texts, and texts of white space only, have score 0 and are not kept. Null keys and repeated rows are
    kept as rows; equal texts have equal scores. Whole texts are read; an empty table gives no rows; other columns of
    docs are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    posterior, weights, offset = learn(docs.select(text))

    def scored(batch: pa.RecordBatch) -> dict:
        both = [(t, words(t)) for t in text_bytes(batch.column(1))]
        vote = [votes(t, w) for t, w in both]
        score = [_score(t, w, weights, offset) for t, w in both]
        return {key: batch.column(0), "votes": vote, "posterior": [posterior.get(v, 0.0) for v in vote], "score": score, "keep": [s >= 0.5 for s in score]}

    return arrow_rows(docs.select(key, text), f"`{key}` {kind}, votes string, posterior double, score double, keep boolean", scored)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that `classify` keeps, with all their columns."""
    _, weights, offset = learn(docs.select(text))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        encoded = [(t or "").encode() for t in texts]
        return pd.Series([_score(t, words(t), weights, offset) >= 0.5 for t in encoded], dtype=bool)

    return docs.where(good(F.col(text)))
