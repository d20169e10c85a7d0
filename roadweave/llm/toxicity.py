"""Toxic passages: maximal scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.session import pin_table

PREFIXES = (4, 5)
PRIOR, LEAST_Z, TOP, DRIFT = 0.5, 4.0, 8.0, -0.05
ECHO = 50  # a word that came among so many words before adds nothing again
_STRIP = ".,;:!?()[]{}\"'«»„“”…*#%&$|-–—"
CACHE_WORDS = 1 << 20


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def features(word: str) -> list[int]:
    """64-bit hashes of the word and of its beginnings (inflected forms share them)."""
    found = [word] + [f"^{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in found]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, feature, n): in how many texts of a label a feature is; a feature may come several times, to be added up."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    known: dict[str, list[int]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for label, counts in seen.items():
            if counts:
                columns = [np.full(len(counts), label, np.int32), np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "feature", "n"])
                counts.clear()

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found: set[int] = set()
            for w in set(tokens(text.as_py() or "")):
                have = known.get(w)
                if have is None:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    have = known[w] = features(w)
                found.update(have)
            seen[label].update(found)
            if len(seen[0]) + len(seen[1]) > CACHE_WORDS:
                yield from out()
    yield from out()


def log_odds(labelled: DataFrame) -> DataFrame:
    """(feature, weight, rate) of the features that mark label 1 significantly, from different rows (label 0 or 1, text).

    Counts are numbers of texts that hold the feature; each row counts, so copies of a text must have been left out before.
    The log-odds compare a feature's share of the counts of all features by label (which takes out how long the texts are),
    with a Dirichlet prior of PRIOR in proportion to the totals; a feature stays if its log-odds are LEAST_Z
    standard deviations above zero, and its weight is at most TOP. The rate is its share in label 0.
    """
    counts = labelled.mapInArrow(_counts, "label int, feature long, n long").groupBy("feature")
    counts = pin_table(counts.agg(*[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]))
    totals = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")).first()
    t0, t1 = max(totals.t0 or 0, 1), max(totals.t1 or 0, 1)
    p0, p1 = PRIOR * max(1.0, t0 / t1), PRIOR * max(1.0, t1 / t0)
    n0, n1 = F.col("n0") + p0, F.col("n1") + p1
    delta = F.log(n1 / (t1 + 2 * p1 - n1)) - F.log(n0 / (t0 + 2 * p0 - n0))
    marks = delta > LEAST_Z * F.sqrt(1 / n1 + 1 / n0)
    return counts.where(marks).select("feature", F.least(delta, F.lit(TOP)).alias("weight"), (F.col("n0") / t0).alias("rate"))


def segments(places: list[int], weights: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) in linear time; words that are not listed weigh `drift` (below zero).

    A stretch between two listed words is one negative number, so only the listed words are visited.
    """
    stack: list[list[float]] = []  # begin, end, total before, total through the end
    total, last = 0.0, 0
    for place, weight in zip(places, weights, strict=True):
        total += drift * (place - last)
        one = [place, place + 1, total, total + weight]
        total, last = total + weight, place + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j -= 1
            if j < 0 or stack[j][3] >= one[3]:
                stack.append(one)
                break
            one = [stack[j][0], one[1], stack[j][2], one[3]]
            del stack[j:]
    return [(int(a), int(b), right - left) for a, b, left, right in stack]


class _Scorer:
    def __init__(self, model: dict[int, float]):
        self.model, self.known = model, {}

    def __call__(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words, places, weights, last = tokens(text), [], [], {}
        for i, w in enumerate(words):
            weight = self.known.get(w)
            if weight is None:
                if len(self.known) > CACHE_WORDS:
                    self.known.clear()
                weight = self.known[w] = max(self.model.get(b, 0.0) for b in features(w))
            if weight > 0:
                if i - last.get(w, -ECHO) >= ECHO:
                    places.append(i)
                    weights.append(weight)
                last[w] = i
        return len(words), segments(places, weights)


def passages(docs: DataFrame, model: dict[int, float], key: str, text: str, lam: float) -> DataFrame:
    """(key, h, n, x, found) per row: hash of the text, tokens, the best segment's extreme-value statistic, significant segments."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # significant features only
    schema = f"`{key}` {kind}, h long, n long, x double, found array<struct<begin:int,end:int,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(shared.value)
        for batch in batches:
            out = [score(t.as_py() or "") for t in batch.column(1)]
            xs = [lam * max([s for *_, s in found], default=0.0) - math.log(max(n, 1)) for n, found in out]
            found = [[{"begin": a, "end": b, "score": s} for a, b, s in found if lam * s > math.log(max(n, 1))] for n, found in out]
            kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, _ in out], pa.int64()), pa.array(xs, pa.float64()), pa.array(found, kinds)], names=[key, "h", "n", "x", "found"])

    return docs.select(key, text, F.xxhash64(text).alias("h")).mapInArrow(run, schema)


def _logistic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))) by Newton steps with halving on counts, with a light prior around a = 1, b = -2."""

    def loss(t: np.ndarray) -> float:
        z = t[0] * x + t[1]
        return float((n * np.logaddexp(0, z) - ones * z).sum() + 0.005 * ((t[0] - 1) ** 2 + (t[1] + 2) ** 2))

    t = np.array([1.0, -2.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(t[0] * x + t[1], -500, 500)))
        w = n * p * (1 - p)
        g = np.array([((n * p - ones) * x).sum() + 0.01 * (t[0] - 1), (n * p - ones).sum() + 0.01 * (t[1] + 2)])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-9 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if abs(size * step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted, n, found) per row of docs; found lists the significant toxic passages (token ranges).

    Rows whose crc32 of the key (as text) is 0 modulo 5 are held out; log-odds and calibration learn from the other
    labelled rows, all of them. A word weighs the log-odds of its most toxic significant feature, any other word, and
    one that is repeated within ECHO words, a little below zero; maximal scoring segments are found in linear time over the whole text. In clean text the best segment S
    of n words follows an extreme-value law, P(max > S) = 1 - exp(-K n exp(-lambda S)): lambda solves
    E[exp(lambda s)] = 1 for the smoothed weights of clean rows, and lambda S - ln n, the law's standard variable, is
    turned into the probability of label 1 by a logistic curve (its offset takes up K) fitted on counts per bin (copies of
    a text count once).

    The text is the only input of a score. Null and empty texts score like a text without toxic words; a null key is not
    held out and has no label; rows with equal keys are scored each, and several labels of a key count as their highest;
    null labels are none. Without any labels every score is the prior's. An empty table gives no rows; other columns of
    docs are not read.
    """
    out_of = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.where(~out_of & F.col("label").isin(0, 1))
    # labels grow with the documents, so they are not broadcast, however few there are
    train = docs.where(~out_of).select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    marked = train.select(key, "h").join(known.hint("merge"), key).select("h", "label").distinct()
    texts = train.groupBy("h").agg(F.first("text").alias("text"))
    rows = log_odds(texts.join(marked.hint("merge"), "h").select("label", "text")).collect()
    model = {r.feature: r.weight for r in rows}
    weights, rates = (np.array([r[i] for r in rows] or [d]) for i, d in ((1, 1.0), (2, 1e-6)))
    rates = rates + 1e-6 / len(rates)  # what clean rows happen not to hold is rare, not impossible
    rest, lam = max(0.0, 1 - float(rates.sum())), 1.0
    low, high = 1e-3, 10.0
    for _ in range(60):
        lam = (low + high) / 2
        low, high = (lam, high) if float((rates * np.exp(lam * weights)).sum()) + rest * math.exp(lam * DRIFT) < 1 else (low, lam)
    found = pin_table(passages(docs, model, key, text, lam).withColumn("held_out", out_of))
    bins = found.where(~F.col("held_out")).join(known, key).dropDuplicates(["h", "label"]).groupBy(F.round("x", 1).alias("x"), "label").agg(F.count("*").alias("n"))
    rows = bins.collect()  # bins of 0.1 of a bounded range
    x, ones, n = (np.array([f(r) for r in rows], np.float64) for f in (lambda r: r.x, lambda r: r.n * r.label, lambda r: r.n))
    a, b = _logistic(x, ones, n) if rows else (1.0, -2.0)
    p = 1 / (1 + F.exp(-(F.col("x") * a + b)))
    return found.select(key, "held_out", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "n", "found")
