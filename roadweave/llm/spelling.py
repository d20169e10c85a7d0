"""Spelling variants: all words one edit apart, found by integer pairs of trie nodes.

Words are sorted into a trie from the front and one from the back, and the nodes are numbered as they first appear. A
word cut at place i is the pair (node of what stands before i, node of what stands from i on). A pair that leaves out the
character at i is equal for two words that differ there only, and equal to an uncut pair of the word without it. So one
grouping by integer pairs gives exactly the words at one replaced, inserted or deleted character, each once; a pair names
all characters but one, so a group holds no more words than the alphabet has characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import arrow_rows
from roadweave.session import pin, pin_table

HEAD = 3  # code points: tries are dealt out by so many, and nodes of no greater depth are numbered by them
LONG, TOKENS = 64, 1 << 20  # bytes of a word whose CRC is not taken from tables, words handled together
_PARTS = 40  # bits of a node's number within its task


class _Known(dict):
    """Numbers of words as they first appear."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 (reversed polynomial 0xEDB88320)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x


def _dropped(known: _Known, ids: np.ndarray, keys: list[str | None], size: np.ndarray, rate: int) -> Iterator[tuple[int, str]]:
    """(number, word without a code point) of every place where `rate` divides h, the CRC-32 of `<key>:<word>`; h names the code point.

    The CRC of joined strings is that of the first, moved on by as many zero bytes as the second has, xor that of the second.
    """
    own = [w.encode() for w in known.words]
    length, crc = np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(map(zlib.crc32, own), np.uint32, len(own))
    begin = np.array([0 if k is None else zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
    moved, table = [begin], _crc_table()
    for _ in range(min(int(length.max(initial=0)), LONG)):
        moved.append(moved[-1] >> 8 ^ table[moved[-1] & 255])
    doc = np.repeat(np.arange(len(keys)), size)
    n = length[ids]
    h = np.stack(moved)[np.minimum(n, LONG), doc] ^ crc[ids]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = zlib.crc32(own[ids[i]], int(begin[doc[i]]))
    named = np.array([k is not None for k in keys], bool)
    for i in np.flatnonzero((h % np.uint32(rate) == 0) & named[doc]).tolist():
        word = known.words[ids[i]]
        at = int(h[i]) % len(word)
        yield int(ids[i]), word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", rate: int | None = None, least: int = 5) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, of at least so many code points, with their occurrences.

    rate: see _dropped; None, and a row without a key, leave words as they are. Counts are summed per batch before they
    are shuffled.
    """
    run = re.compile(f"[{letters}]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, extra = _Known(), Counter()
            total, at = np.zeros(0, np.int64), 0
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            while at < len(keys):
                ids, size = [], []
                while at + len(size) < len(keys) and len(ids) < TOKENS:
                    t = texts[at + len(size)].as_py()
                    found = run.findall(t.encode().lower().decode()) if t else []  # bytes.lower() changes A-Z only
                    ids += map(known.__getitem__, found)
                    size.append(len(found))
                numbers = np.array(ids, np.int64)
                total = np.bincount(numbers, minlength=len(known)) + np.pad(total, (0, len(known) - len(total)))
                if rate:
                    for number, word in _dropped(known, numbers, keys[at : at + len(size)], np.array(size), rate):
                        total[number] -= 1
                        extra[word] += 1
                at += len(size)
            some = [(w, n) for w, n in [*zip(known.words, total.tolist(), strict=True), *extra.items()] if n and len(w) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(key).cast("string"), text).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _number(words: DataFrame, name: str, back: bool) -> DataFrame:
    """words with an array column: entry d is the number of the trie node of the first d characters (the last d, if back).

    Words of a task come sorted, so what a word shares with the one before it are all its known nodes; the rest are new.
    Words that share more than HEAD characters are in one task; nodes up to that depth are numbered by their characters.
    """
    way = F.reverse("word") if back else F.col("word")
    dealt = words.withColumn("_way", way).repartition(F.substring("_way", 1, HEAD)).sortWithinPartitions("_way")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = (TaskContext.get().partitionId() + 1) << _PARTS
        last, nodes = "", [0]
        for batch in batches:
            out = []
            for word in batch.column("_way").to_pylist():
                same = 0
                for a, b in zip(last, word, strict=False):
                    if a != b:
                        break
                    same += 1
                nodes = nodes[: same + 1]
                for d in range(len(nodes), len(word) + 1):
                    if d <= HEAD:
                        nodes.append(-(nodes[-1] * -0x200000 + ord(word[d - 1]) + 1))
                    else:
                        nodes.append(fresh)
                        fresh += 1
                last = word
                out.append(nodes)
            kept = [c for c in batch.schema.names if c != "_way"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.list_(pa.int64()))], names=[*kept, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return dealt.mapInArrow(number, f"{kinds}, {name} array<bigint>")


def _pairs(batch: pa.RecordBatch) -> dict:
    """Every word's pairs: uncut (kind 0), and without one character (2; 1 if the one before it is the same).

    Of a stretch of equal characters only the first may be the missing one, so that a word and a longer one meet once.
    """
    found, p, s = batch.column("word").to_pylist(), batch.column("p"), batch.column("s")
    size = np.fromiter(map(len, found), np.int64, len(found))
    first = np.diff(np.frombuffer("".join(found).encode("utf-32-le"), np.uint32), prepend=0) != 0
    first[(np.cumsum(size) - size)[size > 0]] = True
    nodes, ends = p.flatten().to_numpy(), s.flatten().to_numpy()
    start = np.cumsum(size + 1) - size - 1  # of a word's nodes in both arrays
    of = np.repeat(np.arange(len(found)), size + 1)
    cut = np.arange(len(of)) - start[of]
    kept = np.repeat(np.arange(len(found)), size)
    out = np.arange(len(kept)) - (np.cumsum(size) - size)[kept]
    word = np.concatenate((of, kept))
    return {
        "p": pa.array(np.concatenate((nodes[start[of] + cut], nodes[start[kept] + out]))),
        "s": pa.array(np.concatenate((ends[start[of] + size[of] - cut], ends[start[kept] + size[kept] - out - 1]))),
        "kind": pa.array(np.concatenate((np.zeros(len(of), np.int8), 1 + first.astype(np.int8)))),
        "less": pa.array(-batch.column("n").to_numpy()[word]), "word": batch.column("word").take(pa.array(word)),
    }


def _meet(rows: pa.Table) -> pa.RecordBatch:
    """What the words of each pair learn of one another: (word, n_near, less, form); rows come by p, s, less, word."""
    p, s, kind = (rows.column(c).to_numpy() for c in ("p", "s", "kind"))
    group = np.cumsum(np.concatenate(([0], (p[1:] != p[:-1]) | (s[1:] != s[:-1]))))
    groups = int(group[-1]) + 1
    out, first, short = np.flatnonzero(kind > 0), np.flatnonzero(kind == 2), np.flatnonzero(kind == 0)
    g = group[out]
    count = np.bincount(g, minlength=groups)
    top = np.cumsum(count) - count  # place in `out` of the group's most frequent word
    replaced = count[g] > 1
    me, g = np.flatnonzero(replaced), g[replaced]
    best = out[top[g] + (me == top[g])]
    who, near, form = [out[replaced]], [count[g] - 1], [best]
    whole = np.full(groups, -1)
    whole[group[short]] = short
    longer = whole[group[first]] >= 0
    who.append(first[longer])
    near.append(np.ones(int(longer.sum()), np.int64))
    form.append(whole[group[first[longer]]])
    count = np.bincount(group[first], minlength=groups)
    top = np.cumsum(count) - count
    some = short[count[group[short]] > 0]
    who.append(some)
    near.append(count[group[some]])
    form.append(first[top[group[some]]])
    who, form = pa.array(np.concatenate(who)), pa.array(np.concatenate(form))
    columns = [rows.column("word").take(who), pa.chunked_array([pa.array(np.concatenate(near))]), rows.column("less").take(form), rows.column("word").take(form)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names=["word", "n_near", "less", "form"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_meet on whole groups; the last one of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        p, s = rows.column("p").to_numpy(), rows.column("s").to_numpy()
        other = np.flatnonzero((p != p[-1]) | (s != s[-1])) if len(p) else []
        cut = int(other[-1]) + 1 if len(other) else 0
        rest = rows.slice(cut).combine_chunks().to_batches()[0] if len(p) else rest
        if cut:
            yield _meet(rows.slice(0, cut))
    if rest is not None:
        yield _meet(pa.Table.from_batches([rest]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of all words with one near at least: how many are one edit away, and of those the most frequent one.

    words (word, n), distinct. Ties go to the smallest word in code-point order.
    """
    c = F.col
    nodes = _number(_number(words, "p", False), "s", True)
    pairs = arrow_rows(nodes, "p long, s long, kind byte, less long, word string", _pairs)
    met = pairs.repartition("p", "s").sortWithinPartitions("p", "s", "less", "word").mapInArrow(_grouped, "word string, n_near long, less long, form string")
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return found.select("word", "n_near", c("best.form").alias("form"), (-c("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms are followed to the last one.

    n doubles at least with each step, so chains are short; every round doubles the steps followed.
    """
    c = F.col
    root = pin(forms.select("word", c("form").alias("root")))
    while True:
        next_ = root.select(c("word").alias("root"), c("root").alias("_further"))
        further = pin(root.join(next_, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), c("_further").isNotNull().alias("_moved")))
        root = further.drop("_moved")
        if further.where("_moved").isEmpty():
            return root


def variants(counts: DataFrame, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with at least least_n occurrences.

    counts (word, n) of distinct words, as word_counts makes them; null words are ignored, an empty word is a word, and
    an empty table gives no rows. A word's form is the most frequent word one edit away (ties: the smallest in code-point
    order), if it occurs ratio times as often or more (ratio above 1), else null; root follows forms to the last.
    """
    c = F.col
    words = pin_table(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(c("n") >= least_n))
    near = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(c("form_n") >= ratio * c("n"), c(x)).alias(x) for x in ("form", "form_n")])
    near = pin_table(near)
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
