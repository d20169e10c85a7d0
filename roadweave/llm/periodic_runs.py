"""Periodic runs of words by recompression: a run-length grammar whose levels answer extension queries.

Many documents are handled at once: their words become numbers in one array with a different separator (a negative
number) before, between and behind them, so that no repetition crosses a border. Block compression (copies of a symbol
in a row become one symbol) and pair compression (a symbol of the left class before one of the right class become one)
take turns until each document is a few symbols. Equal stretches are parsed alike but for a bounded number of symbols
at their ends on each level, so the longest common extension of two places is found by climbing the levels while both
stand at first children and going down again at the mismatch. All queries climb together, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadweave.llm.common import arrow_rows, text_bytes, words

CHUNK, GRID = 1 << 18, 1 << 21  # words compressed together (a longer document alone), candidates looked at together


@dataclass
class Level:
    """Symbols of one level; the rest leads to the next level, and is missing on the top one."""

    symbols: np.ndarray
    parent: np.ndarray | None = None  # index on the next level
    begin: np.ndarray | None = None  # first and last child of every symbol of the next level
    end: np.ndarray | None = None
    copies: bool = False  # whether parents are blocks of copies


def _step(symbols: np.ndarray, joined: np.ndarray, copies: bool, fresh: int) -> tuple[Level, np.ndarray, int]:
    """Join every symbol i with its successor where joined[i]; equal groups get equal new numbers from `fresh` on."""
    begin = np.flatnonzero(np.concatenate(([True], ~joined)))
    end = np.concatenate((begin[1:], [len(symbols)])) - 1
    parent = np.cumsum(np.concatenate(([0], ~joined)), dtype=np.int64)
    above, groups = symbols[begin].copy(), np.flatnonzero(end > begin)
    second = end[groups] - begin[groups] + 1 if copies else symbols[end[groups]]
    kinds, number = np.unique(above[groups] * (np.int64(1) << 31) + second, return_inverse=True)
    above[groups] = fresh + number
    return Level(symbols, parent, begin, end, copies), above, fresh + len(kinds)


def compress(symbols: np.ndarray) -> list[Level]:
    """Levels of the grammar of an array that begins and ends with a separator; separators are never joined."""
    levels, fresh, salt = [], int(symbols.max(initial=0)) + 1, 0
    symbols = symbols.astype(np.int64)
    while salt < 200:
        joined = symbols[1:] == symbols[:-1]
        if joined.any():
            level, symbols, fresh = _step(symbols, joined, True, fresh)
            levels.append(level)
        both = (symbols[1:] >= 0) & (symbols[:-1] >= 0)
        if not both.any():
            break
        salt += 1
        mixed = (symbols.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        right = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1
        joined = both & right[1:] & ~right[:-1]
        other = both & ~right[1:] & right[:-1]
        joined = other if other.sum() > joined.sum() else joined
        if joined.any():
            level, symbols, fresh = _step(symbols, joined, False, fresh)
            levels.append(level)
    return [*levels, Level(symbols)]


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from places a[k] < b[k] on (both included; to the left if back) agree, for every k."""
    start, a, b = a, a.copy(), b.copy()
    way, top = (-1 if back else 1), len(levels) - 1
    stop, rest = np.full(len(a), top), np.arange(len(a))
    for t, level in enumerate(levels[:-1]):
        x, y = a[rest], b[rest]
        edge = level.end if back else level.begin
        px, py = level.parent[x], level.parent[y]
        aligned = (edge[px] == x) & (edge[py] == y)
        same = np.flatnonzero(~aligned & (level.symbols[x] == level.symbols[y]))
        if len(same):
            far = _far(level, x[same], y[same], back)
            x[same] += way * far
            y[same] += way * far
            px[same], py[same] = level.parent[x[same]], level.parent[y[same]]
            aligned[same] = (edge[px[same]] == x[same]) & (edge[py[same]] == y[same])
        a[rest], b[rest] = np.where(aligned, px, x), np.where(aligned, py, y)
        stop[rest[~aligned]] = t
        rest = rest[aligned]
    symbols = levels[-1].symbols
    while len(rest := rest[symbols[a[rest]] == symbols[b[rest]]]):
        a[rest] += way
        b[rest] += way
    for t in range(top - 1, -1, -1):
        level = levels[t]
        rest = np.flatnonzero(stop > t)
        edge = level.end if back else level.begin
        x, y = edge[a[rest]], edge[b[rest]]
        same = np.flatnonzero(level.symbols[x] == level.symbols[y])
        far = _far(level, x[same], y[same], back)
        x[same] += way * far
        y[same] += way * far
        a[rest], b[rest] = x, y
    return (a - start) * way


def _far(level: Level, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray | int:
    """Of two places with the same symbol: the copies that both blocks still have in this direction (or one symbol)."""
    if not level.copies:
        return 1
    px, py = level.parent[x], level.parent[y]
    if back:
        return np.minimum(x - level.begin[px], y - level.begin[py]) + 1
    return np.minimum(level.end[px] - x, level.end[py] - y) + 1


def _candidates(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) on each document's harmonic grid (multiples of every period) that may lie in a run.

    A run holds at least `least` periods, so the first multiple of its period in it, x, and x + period, … x + (least - 1) *
    period lie in it; their words agree, and so do those half a period later but for the last.
    """
    most = size // least
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (size[doc] - 1) // period - least + 2
    total = np.cumsum(count)
    cut = 0
    while cut < len(doc):
        to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + GRID, "right")))
        n, q = count[cut:to], period[cut:to]
        place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (q := np.repeat(q, n)) + np.repeat(begin[doc[cut:to]], n)
        for k in range(1, least):
            keep = ids[place] == ids[place + k * q]
            place, q = place[keep], q[keep]
        for k in range(1, least - 1):
            keep = ids[place + q // 2] == ids[place + q // 2 + k * q]
            place, q = place[keep], q[keep]
        yield place, q
        cut = to


def runs_of(texts: list[list[bytes]], least: int = 4, shortest: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period.

    A run is a stretch with a smallest period, of at least `least` (2 or more) periods and `shortest` words, that no
    neighbouring word extends.
    """
    known: dict[bytes, int] = {}
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size
    ids = np.empty(int(size.sum()) + len(texts) + 1, np.int64)
    ids[np.concatenate(([0], begin + size))] = -1 - np.arange(len(texts) + 1)
    for at, n, text in zip(begin.tolist(), size.tolist(), texts, strict=True):
        ids[at : at + n] = np.fromiter((known.setdefault(w, len(known)) for w in text), np.int64, n)
    found, levels = [], None
    for place, q in _candidates(ids, begin, size, least):
        if not len(place):
            continue
        levels = levels or compress(ids)
        first = place - extensions(levels, place - 1, place + q - 1, back=True)
        last = place + q + extensions(levels, place, place + q)
        long = last - first >= np.maximum(shortest, least * q)
        found.append(np.stack([first, last, q])[:, long])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        first, last, q = np.concatenate(found, axis=1)
        order = np.lexsort((q, last, first))  # of several periods of a stretch the smallest counts
        first, last, q = first[order], last[order], q[order]
        new = np.ones(len(first), bool)  # there may be candidates and no run at all
        new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
        first, last, q = first[new], last[new], q[new]
        order = np.lexsort((q, first))
        doc = np.searchsorted(begin, first, "right") - 1
        for i in order.tolist():
            d = int(doc[i])
            out[d].append((int(first[i] - begin[d]), int(last[i] - first[i]), int(q[i])))
    return out


def collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return text
    change = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [text[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _chunks(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part, n = [], 0
    for text in texts:
        if part and n + len(text) > CHUNK:
            yield part
            part, n = [], 0
        part.append(text)
        n += len(text)
    if part:
        yield part


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 4, shortest: int = 6) -> DataFrame:
    """(key, n_words, runs array of (start, length, period), kept) per row of docs.

    Words are runs of bytes other than white space; `kept` joins with one space the words that no run contains after its
    first period. Nulls: a null text has no words; a null key is kept. Empty texts have no runs and an empty `kept`.
    Repeated rows stay repeated; a stretch with several periods is one run of the smallest. An empty table gives no rows;
    other columns of docs are not read. A row is handled in the task that reads it, a very long text alone: its memory
    grows with its length, and nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        n, runs, kept = [], [], []
        for part in _chunks([words(t) for t in text_bytes(batch.column(1))]):
            for found, rows in zip(part, runs_of(part, least, shortest), strict=True):
                n.append(len(found))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows])
                kept.append(b" ".join(collapse(found, rows)).decode())
        return {key: batch.column(0), "n_words": n, "runs": runs, "kept": kept}

    schema = f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
    return arrow_rows(docs.select(key, text), schema, make)
