"""Language-model scores: smoothed n-grams as the states of a weighted automaton with failure arcs.

Documents are cut into blocks of some million tokens. A block sends the hashes of its different n-grams with their
training counts, sorted and packed, to ranges of the hash; a range adds up what all blocks sent and answers each with the
totals, in the order asked. So the counts cover the whole corpus, grow with it, and are nowhere together. A block then
builds the part of the automaton that its documents can meet and runs all of them through it from left to right.

Smoothing: p(w | v) = (c(vw) + mu * p(w | v')) / (c(v) + mu), v' being v without its first word, and at the root
(c(w) + 1) / (N + V + 1); the words of a context sum to one, with one share for all unknown words. An n-gram that was not
seen costs the failure arc log(mu / (c(v) + mu)) and goes on from v'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import text_bytes, words
from roadweave.session import pin_table

BLOCK, RANGE = 1 << 20, 1 << 19  # tokens of a block (a longer document alone), entries that a range is meant to hold
KNOWN = 1 << 18  # words whose hashes a task remembers
END = np.uint64(xxhash.xxh64_intdigest(b"\n", 42))  # of no word, as words hold no line feed


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


@dataclass
class Block:
    """Tokens of some documents: a leading end, then every document's words and its end."""

    tokens: np.ndarray
    size: np.ndarray  # tokens per document, its end included
    train: np.ndarray


def _block(texts: list[bytes], train: np.ndarray, known: _Hashes) -> Block:
    found = [words(t.lower()) for t in texts]  # bytes.lower() changes A-Z only
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    tokens, at = np.full(int(size.sum()) + 1, END), 1
    for text, n in zip(found, size.tolist(), strict=True):
        tokens[at : at + n - 1] = np.fromiter(map(known.__getitem__, text), np.uint64, n - 1)
        at += n
    return Block(tokens, size, train)


@dataclass
class Order:
    """The different n-grams of one length in a block."""

    hashes: np.ndarray  # sorted
    at: np.ndarray  # entry of the n-gram that ends at each token, -1 where none does
    some: np.ndarray  # a token where each entry ends


def _orders(block: Block, order: int) -> list[Order]:
    """An n-gram reaches back to the end before its document at most (the starting context), never beyond."""
    t, out = block.tokens, []
    ends = np.flatnonzero(t == END)
    since = np.arange(1, len(t)) - ends[np.searchsorted(ends, np.arange(1, len(t))) - 1]  # tokens back to the end before
    h = t.copy()
    for n in range(1, order + 1):
        if n > 1:
            h = np.concatenate(([END], _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + t[1:] + np.uint64(n))))
        fits = np.flatnonzero(np.concatenate(([n == 1], since >= n - 1)))
        hashes, first, number = np.unique(h[fits], return_index=True, return_inverse=True)
        at = np.full(len(t), -1)
        at[fits] = number
        out.append(Order(hashes, at, fits[first]))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the shuffle's compression finds the zeros."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _counts(block: Block, o: Order) -> np.ndarray:
    """Training occurrences of each entry in the block; the leading end is none."""
    trained = np.concatenate(([False], np.repeat(block.train, block.size)))
    return np.bincount(o.at[trained & (o.at >= 0)], minlength=len(o.hashes))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], pa.RecordBatch]]:
    """(block, rows, batch) of a task's rows (key, text, held): the same rows give the same blocks each time."""
    block = TaskContext.get().partitionId() << 24
    for batch in batches:
        texts, rows, n = text_bytes(batch.column("text")), [], 0
        for i, t in enumerate(texts):
            size = t.count(b" ") + 1
            if rows and n + size > BLOCK:
                yield block, rows, batch
                block, rows, n = block + 1, [], 0
            rows.append(i)
            n += size
        if rows:
            yield block, rows, batch
            block += 1


@dataclass
class Automaton:
    """States are contexts (0: none), arcs lead from a state by a word to a state with a log-probability."""

    arcs: np.ndarray  # sorted keys, state * words + word
    target: np.ndarray
    weight: np.ndarray
    fail: np.ndarray  # per state, the context without its first word
    fail_weight: np.ndarray
    unknown: float  # weight of a word that the root has no arc for
    words: int

    def run(self, word: np.ndarray, size: np.ndarray, start: int) -> np.ndarray:
        """Log-probability of each sequence of words (-1: unknown), one after another in `word`; all walk side by side."""
        order = np.argsort(-size, kind="stable")
        at, left = (np.cumsum(size) - size)[order], size[order]
        state, total = np.full(len(size), start), np.zeros(len(size))
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, "left"))  # those with a word left
            w, s, gained = word[at[:n] + step], state[:n].copy(), np.zeros(n)
            todo = np.arange(n)
            while len(todo):
                key = s[todo] * self.words + w[todo]
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = (self.arcs[arc] == key) & (w[todo] >= 0) if len(self.arcs) else np.zeros(len(todo), bool)
                gone = todo[hit]
                gained[gone] += self.weight[arc[hit]]
                s[gone] = self.target[arc[hit]]
                todo = todo[~hit]
                lost = s[todo] == 0
                gained[todo[lost]] += self.unknown
                todo = todo[~lost]
                gained[todo] += self.fail_weight[s[todo]]
                s[todo] = self.fail[s[todo]]
            state[:n] = s
            total[:n] += gained
        out = np.empty(len(size))
        out[order] = total
        return out


def automaton(block: Block, orders: list[Order], totals: list[np.ndarray], n: int, kinds: int, mu: float) -> tuple[Automaton, np.ndarray, int]:
    """The part of the model that the block can meet, its tokens as words of it, and the starting state."""
    first = orders[0]
    seen = totals[0] > 0
    arcs, target, weight = [], [], []
    p = [(totals[0] + 1) / (n + kinds + 1)]
    state = [np.zeros(0, np.int64)] * len(orders)
    fail, fail_weight, states = [np.zeros(1, np.int64)], [np.zeros(1)], 1
    size = len(first.hashes)
    for k, o in enumerate(orders):
        have = totals[k] > 0
        ends = o.some
        shorter = orders[k - 1].at[ends] if k else np.zeros(len(ends), np.int64)  # without its first word
        context = orders[k - 1].at[ends - 1] if k else None  # without its last word; entry 0 of some tokens of order 1 may be the leading end
        if k:
            p.append((totals[k] + mu * p[k - 1][shorter]) / (totals[k - 1][context] + mu))
        if k < len(orders) - 1:
            state[k] = np.where(have, states + np.cumsum(have) - 1, 0)
            fail.append((state[k - 1][shorter] if k else np.zeros(len(ends), np.int64))[have])
            fail_weight.append(np.log10(mu / (totals[k][have] + mu)))
            states += int(have.sum())
        source = state[k - 1][context] if k else np.zeros(len(ends), np.int64)
        goal = state[k] if k < len(orders) - 1 else (state[k - 1][shorter] if k else np.zeros(len(ends), np.int64))
        arcs.append((source * size + first.at[ends])[have])
        target.append(goal[have])
        weight.append(np.log10(p[k][have]))
    arcs, target, weight = np.concatenate(arcs), np.concatenate(target), np.concatenate(weight)
    order = np.argsort(arcs)
    machine = Automaton(arcs[order], target[order], weight[order], np.concatenate(fail), np.concatenate(fail_weight), -np.log10(n + kinds + 1), size)
    word = np.where(seen[first.at], first.at, -1)
    return machine, word[1:], int(state[0][first.at[0]]) if len(orders) > 1 else 0


def score(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", order: int = 2, mu: float = 1000.0) -> DataFrame:
    """(key, held, n_tokens, n_known, train_tokens, base_score, score) per row of docs (a table as read).

    held: a boolean column; rows where it is false teach, all are scored. Tokens are words in lower case (A-Z) and one end.
    base_score adds up log10 of (c + 1) / (N + V + 1), score is the model's log10 probability, with contexts of up to
    order - 1 words. n_known counts tokens that occur in training, train_tokens is N.

    Nulls: a null text is empty (one end), a null `held` is false, a null key is kept. Repeated rows each count and are
    scored alike. Without training rows all words are unknown (N and V 0); an empty table gives no rows; other columns of
    docs are not read. Words are told apart by 64-bit hashes. A block's memory is bounded but for one very long document.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    # a guess of the tokens is enough here: it only sets how many ranges share the work
    guess = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(guess / 6 * order / RANGE)).bit_length()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for number, ids, batch in _cut(batches):
            block = _block_of(batch, ids, known)
            out: list[list] = [[], [], [], [], [], []]
            for n, o in enumerate(_orders(block, order)):
                own = _counts(block, o)
                to = (o.hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(o.hashes), np.int64)
                edges = np.concatenate((np.flatnonzero(np.diff(to, prepend=-1)), [len(to)]))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    row = (number, n, int(to[a]), _pack(np.diff(o.hashes[a:b], prepend=np.uint64(0))), _pack(own[a:b]), b - a)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["block", "n", "range", "hashes", "counts", "size"])

    def add(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_unpack(x.as_py()), dtype=np.uint64) for x in table.column("hashes")]
        counts = np.concatenate([_unpack(x.as_py()) for x in table.column("counts")]).astype(np.int64)
        all_, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(all_), np.int64)
        np.add.at(total, number, counts)
        sizes = table.column("size").to_numpy()
        parts = np.split(total[number], np.cumsum(sizes)[:-1])
        # what the range knows of the corpus stands in its first row
        words_, tokens = (int((total > 0).sum()), int(total.sum())) if table.column("n")[0].as_py() == 0 else (0, 0)
        rest = [0] * (len(sizes) - 1)
        return pa.table({
            "block": table.column("block"), "n": table.column("n"), "range": table.column("range"),
            "totals": pa.array([_pack(x) for x in parts], pa.binary()), "words": pa.array([words_, *rest], pa.int64()), "tokens": pa.array([tokens, *rest], pa.int64()),
        })

    asked = rows.mapInArrow(ask, "block long, n int, range long, hashes binary, counts binary, size long")
    answers = pin_table(
        asked.groupBy("n", "range").applyInArrow(add, "block long, n int, range long, totals binary, words long, tokens long")
    )
    facts = answers.agg(F.sum("tokens"), F.sum("words")).first()
    tokens, kinds = int(facts[0] or 0), int(facts[1] or 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, batch in _cut(batches):
            part = batch.take(pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), *part.columns], names=["block", *part.schema.names])

    out = spark.createDataFrame([], f"`{key}` {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").schema

    def walk(docs_: pa.Table, totals_: pa.Table) -> pa.Table:
        block = _block_of(docs_, range(docs_.num_rows), _Hashes())
        orders = _orders(block, order)
        parts: list[list[tuple[int, np.ndarray]]] = [[] for _ in orders]
        for n, r, x in zip(*(totals_.column(c).to_pylist() for c in ("n", "range", "totals")), strict=True):
            parts[n].append((r, _unpack(x)))
        totals = [np.concatenate([x for _, x in sorted(p, key=lambda e: e[0])] or [np.zeros(0, np.uint64)]).astype(np.int64) for p in parts]
        machine, word, start = automaton(block, orders, totals, tokens, kinds, mu)
        at, first = np.cumsum(block.size) - block.size, orders[0].at[1:]
        add_up = lambda x: np.add.reduceat(x, at)  # no document is without a token
        columns = [
            docs_.column("key"), docs_.column("held"), pa.array(block.size), pa.array(add_up((totals[0][first] > 0).astype(np.int64))),
            pa.array(np.full(len(at), tokens)), pa.array(add_up(np.log10((totals[0][first] + 1) / (tokens + kinds + 1)))), pa.array(machine.run(word, block.size, start)),
        ]
        return pa.table(dict(zip(out.names, columns, strict=True)))

    dealt = rows.mapInArrow(deal, f"block long, key {kind}, text string, held boolean")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, out)


def _block_of(batch: pa.RecordBatch | pa.Table, rows: list[int] | range, known: _Hashes) -> Block:
    held = batch.column("held").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("held").to_numpy()
    column = batch.column("text")
    texts = text_bytes(column.take(pa.array(rows, pa.int64())))
    return _block(texts, ~held[list(rows)].astype(bool), known)
