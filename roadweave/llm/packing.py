"""Best-fit packing of token sequences: a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.llm.tokens import encoded
from roadweave.session import pin_table

Column = tuple[tuple[int, int], ...]  # a configuration: (length, copies), longest first


def _knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size up to capacity the best total value of lengths (any copies) and the length to take there, or 0.

    Of equal values the longest length is taken, which leaves the short ones for gaps.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    longest = lengths[::-1].copy()
    values, skip = value[longest], len(lengths) - np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for size in range(1, capacity + 1):
        best[size] = best[size - 1]
        if (n := skip[size]) < len(longest):
            total = values[n:] + best[size - longest[n:]]
            j = int(total.argmax())
            if total[j] > best[size] + 1e-12:
                best[size], take[size] = total[j], longest[n + j]
    return best, take


def _configuration(anchor: int, take: np.ndarray, capacity: int) -> Counter:
    """The anchor with the best filling of the rest."""
    found, left = Counter({anchor: 1}), capacity - anchor
    while left > 0:
        if take[left]:
            found[int(take[left])] += 1
            left -= int(take[left])
        else:
            left -= 1
    return found


def _best_fit(left: Counter, open_bins: list[tuple[Counter, int]], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts: bins of equal content are handled together."""
    room: dict[int, list[tuple[Counter, int]]] = {}
    for content, n in open_bins:
        room.setdefault(capacity - sum(k * v for k, v in content.items()), []).append((content, n))
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            space = min((r for r, bins in room.items() if r >= length and bins), default=None)
            content, many = room[space].pop() if space else (Counter(), n)
            space = space or capacity
            copies = min(space // length, n)
            used = min(many, n // copies)
            if many > used and content:
                room[space].append((content, many - used))
            room.setdefault(space - copies * length, []).append((content + Counter({length: copies}), used))
            n -= used * copies
    return [b for bins in room.values() for b in bins]


def plan(counts: np.ndarray, capacity: int, learn: int = 12, rounds: tuple[int, ...] = (1, 4, 32), rate: float = 0.5) -> tuple[list[tuple[Column, int]], int]:
    """Configurations with their whole multiplicities, and a lower bound on the number of bins.

    counts[l] items have length l. The linear program (fewest configurations that cover all counts) is solved by
    multiplicative weights: each round prices all configurations by one knapsack dynamic program, takes for every
    length its best configuration, and raises the weights of the lengths that lag behind the mean. Then it is rounded:
    in one or more sweeps, priced configurations enter with whole multiplicities within what is left, and what no
    configuration fits goes best-fit decreasing into the room that remains. The first and the learned prices are
    rounded in coarse and fine sweeps, and the fewest bins win. Work and result size depend on the capacity and the
    rounds only, not on the number of items. Any feasible prices bound the optimum from below.
    """
    sizes = np.arange(capacity + 1)
    total = counts.astype(np.float64)
    prices = sizes / capacity
    bound = float(total @ prices)

    def reweigh(prices: np.ndarray, left: np.ndarray, steps: int) -> np.ndarray:
        share = np.divide(left, total, out=np.zeros_like(total), where=total > 0)
        mean = float(left @ sizes) / max(1.0, float(total @ sizes))
        return prices * np.exp(rate * np.clip(share - mean, -1, 1) / steps)

    def sweep(left: np.ndarray, prices: np.ndarray, share: np.ndarray, whole: bool) -> tuple[list, float]:
        lengths = np.flatnonzero(left > (0 if whole else 1e-9))
        if not len(lengths):
            return [], 0.0
        best, take = _knapsack(prices, lengths, capacity)
        taken = []
        for anchor in lengths[::-1].tolist():
            if left[anchor] <= 0:
                continue
            column = _configuration(anchor, take, capacity)
            most = min(left[k] // v if whole else left[k] / v for k, v in column.items())
            times = min(most, share[anchor])
            if times > 0:
                for k, v in column.items():
                    left[k] -= times * v
                taken.append((column, times))
        return taken, best[capacity]

    def rounded(prices: np.ndarray, sweeps: int) -> list[tuple[Column, int]]:
        left, columns = counts.astype(np.int64), Counter()
        for i in range(sweeps):
            taken, _ = sweep(left, prices, -(-left // (sweeps - i)), True)
            for column, times in taken:
                columns[tuple(sorted(column.items(), reverse=True))] += int(times)
            prices = reweigh(prices, left.astype(np.float64), sweeps)
        size = lambda c: sum(k * v for k, v in c)
        spare = [(Counter(dict(c)), n) for c, n in columns.items() if size(c) < capacity]
        rest = _best_fit(Counter({int(k): int(left[k]) for k in np.flatnonzero(left)}), spare, capacity)
        full = [(c, n) for c, n in columns.items() if size(c) == capacity]
        return full + [(tuple(sorted(c.items(), reverse=True)), n) for c, n in rest]

    known, left = [prices], total.copy()
    for _ in range(learn):
        _, worth = sweep(left, prices, total / learn, False)
        if worth:
            bound = max(bound, float(total @ prices) / worth)  # prices / worth are feasible for the dual
        prices = reweigh(prices, left, learn)
    known.append(prices)
    best = min((rounded(p, n) for p in known for n in rounds), key=lambda columns: sum(n for _, n in columns))
    return best, int(np.ceil(bound - 1e-6))


def slots(columns: list[tuple[Column, int]]) -> dict[str, np.ndarray]:
    """For each length the intervals of ranks that share a configuration: where they begin, and their places."""
    rows, base, used = [], 0, Counter()
    for column, bins in columns:
        at = 0
        for length, copies in column:
            rows.append((length, used[length], base, copies, at))
            used[length] += copies * bins
            at += length * copies
        base += bins
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(["length", "rank", "base", "copies", "at"], table.T, strict=True))


def pieces(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Token pieces of at most `capacity` ids, each document closed by end_id; the first piece takes the remainder.

    `_task` and `_nth` number the pieces of one length within their task.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), *(T.StructField(n, t) for n, t in [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("_task", T.IntegerType()), ("_nth", T.LongType())])]
    out = T.StructType([*fields, *[T.StructField("ids", T.BinaryType())][: int(with_ids)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, task, seen = to_arrow_schema(out, prefers_large_types=False), TaskContext.get().partitionId(), Counter()
        last, rows = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            keys = last.column(0).take(pa.array(columns[0], pa.int64()))
            return pa.RecordBatch.from_arrays([keys.cast(target.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(target)[1:], strict=True))], schema=target)

        for batch, row, found in encoded(batches, 1, vocabulary):
            if rows and (batch is not last or len(rows) >= 4096):
                yield flush()
                rows = []
            last, ids = batch, np.append(found, np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            ends = range(first, len(ids) + 1, capacity)
            for piece, end in enumerate(ends):
                part = ids[max(0, end - capacity) if piece else 0 : end]
                own = (row, piece, end - len(part), len(part), zlib.crc32(part.tobytes()), task, seen[len(part)])
                rows.append((*own, part.tobytes()) if with_ids else own)
                seen[len(part)] += 1
        if rows:
            yield flush()

    return docs.select(key, text).mapInArrow(run, out)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: (key, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    The histogram of lengths (at most `capacity` rows) goes to the driver, which plans configurations; a piece finds
    its place by its rank among the pieces of its length, which is the number of such pieces in earlier tasks plus its
    own number within its task. The plan's table has at most sum(rounds) * capacity configurations plus the
    leftovers of one best-fit pass, whatever the number of documents.

    A null or empty text is one piece that holds end_id only; a null key is kept; repeated rows are packed each on its
    own; a long text is cut; an empty table gives no rows; other columns of docs are not read.
    """
    found = pin_table(pieces(docs, key, text, vocabulary, capacity, end_id, with_ids))
    per_task = found.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # one row per length
        counts[row.length] = row.n
    table = slots(plan(counts, capacity)[0])
    key_of = lambda length, rank: (length << 46) + rank
    begins = key_of(table["length"], table["rank"])
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = found.join(offsets, ["length", "_task"]).withColumn("_rank", F.col("_nth") + F.col("_before")).drop("_task", "_nth", "_before")
    columns = [key, "piece", "start", "length", "ids_crc32", "_rank", *["ids"][: int(with_ids)]]
    ranked = ranked.select(*columns)
    out = T.StructType([f for f in ranked.schema if f.name not in ("_rank", "ids")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())] + [f for f in ranked.schema if f.name == "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(begins, key_of(length, rank), "right") - 1
            nth = rank - table["rank"][at]
            sequence = pa.array(table["base"][at] + nth // table["copies"][at])
            offset = pa.array(table["at"][at] + nth % table["copies"][at] * length)
            columns = [*batch.columns[:5], sequence, offset, *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return ranked.mapInArrow(place, out)
