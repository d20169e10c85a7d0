"""Benchmark decontamination by templates: typed placeholders, a hash join of template windows, consistent slots.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweave.session import pin_table

WORDS, LITERALS, SHARE = 5, 3, 0.8
#: Diagonals on either side that belong to one place: so many words may be inserted or left out.
REACH = 4
WHOLE_DOCUMENT = -(1 << 62)
BROADCAST_ROWS = 1 << 20
#: Units that may follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal c f k percent "
    "degree degrees dollar dollars euro euros cent cents usd eur gbp kmh mph"
).split()
#: Numbers written as words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen twice"
).split()
_SPACE = " \t\n\x0b\f\r"


def _tidy(text: Column) -> Column:
    return F.trim(F.translate(F.coalesce(text, F.lit("")), "#" + _SPACE[1:], "~" + " " * 5))


def template(text: Column) -> Column:
    """The words of a text in lower case without punctuation, with #n for numbers, #u for units, #p for names, #s for symbols.

    A name is a capitalised word that doesn't begin a sentence. Every word gives exactly one element.
    """
    t = F.regexp_replace(_tidy(text), r"\p{Lu}(?<=[^ .!?:] {1,9}\p{Lu})[\p{L}\p{M}]*", "#p")
    t = F.regexp_replace(t, r"(?<!\S)[^\s0-9]*[0-9]\S*", "#n")
    t = F.lower(t)
    t = F.regexp_replace(t, r"(?<!\S)[^\p{L}\p{N}\s#]+(?!\S)", "#s")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s#]+", "")
    t = F.regexp_replace(t, rf"(?<!\S)(?:{'|'.join(NUMBER_WORDS)})(?!\S)", "#n")
    t = F.regexp_replace(t, rf"#n( +)(?:{'|'.join(UNITS)})(?!\S)", "#n$1#u")
    return F.split(t, " +")


def values(text: Column) -> Column:
    """The words of a text as they fill slots: lower case, without punctuation unless there is nothing else."""
    return F.transform(F.split(_tidy(text), " +"), lambda w: F.regexp_replace(F.lower(w), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+$|^[^\p{L}\p{N}]+(?=[\p{L}\p{N}])", ""))


def _at(words: Column, size: int) -> Column:
    """Places (from 1) of the windows of so many words of a word array; none in shorter arrays."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda x: ~x.startswith("#")))


def item_texts(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, c, v, key): the different texts of each item as templates and values; each has a key of its own."""
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), template(F.col(text)).alias("c"), values(F.col(text)).alias("v"))
    return rows.dropDuplicates(["item", "c", "v"]).withColumn("key", F.monotonically_increasing_id())


def item_windows(items: DataFrame) -> DataFrame:
    """(key, item, q, h, kinds, slots, total): the usable windows of each text of items, and their number; h is the template's hash."""
    rows = items.select("key", "item", "c", "v", F.explode(_at(F.col("c"), WORDS)).alias("q"))
    rows = rows.select("key", "item", "q", F.slice("c", F.col("q"), WORDS).alias("kinds"), F.slice("v", F.col("q"), WORDS).alias("slots"))
    rows = rows.where(_literals(F.col("kinds")) >= LITERALS).withColumn("h", F.xxhash64("kinds"))
    return rows.withColumn("total", F.count("*").over(W.partitionBy("key")))


def whole_items(items: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, item, h, kinds, slots, size, anchor, length, verbatim): texts without a usable window, to be met as a whole.

    anchor is the hash of the window of `length` (at most WORDS) words with the most literals. Texts shorter than a window
    and texts without any literal say too little for other parameters, so they are met verbatim.
    """
    c, n = F.col("c"), F.size("c")
    length = F.least(n, F.lit(WORDS))
    rows = items.join(windows.select("key").distinct(), "key", "leftanti").where(n >= LITERALS).withColumn("length", length)
    at = F.array_max(F.transform(F.sequence(F.lit(1), n - F.col("length") + 1), lambda i: F.struct(_literals(F.slice(c, i, F.col("length"))).alias("n"), (-i).alias("i"))))
    return rows.select(
        "key", "item", F.xxhash64("c").alias("h"), c.alias("kinds"), F.col("v").alias("slots"), n.alias("size"),
        F.xxhash64(F.slice(c, -at["i"], F.col("length"))).alias("anchor"), "length", ((n < WORDS) | (_literals(c) == 0)).alias("verbatim"),
    )


def _filled(there: str) -> Column:
    """(kind, value, there) of the typed slots of a met window."""
    met = F.zip_with("kinds", F.arrays_zip("slots", F.col(there).alias("v")), lambda k, x: F.struct(k.alias("kind"), x["slots"].alias("value"), x["v"].alias("there")))
    return F.filter(met, lambda s: s["kind"].isin("#n", "#u", "#p"))


def _windows_met(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, item, n_windows, n_matched) of texts met in SHARE of their windows with consistent slots.

    rows (row, p, h, v). A place of a text is judged on its own: around every diagonal p - q on which a window was met, each
    window of the item counts at its nearest place within REACH diagonals. A document is also judged as one place, for
    texts that are torn apart.
    """
    c, diagonal = F.col, F.col("p") - F.col("q")
    met = pin_table(rows.join(windows, "h").select("row", "key", "item", "total", "q", "p", _filled("v").alias("filled")))
    own = ["row", "key", "item", "total", "place"]
    enough = c("n") >= F.lit(SHARE) * c("total")
    near = met.withColumn("place", F.explode(F.sequence((diagonal - REACH).cast("long"), (diagonal + REACH).cast("long"))))
    near = near.join(met.select("row", "key", diagonal.cast("long").alias("place")).distinct(), ["row", "key", "place"], "leftsemi")
    near = near.groupBy(*own, "q").agg(F.min(F.struct(F.abs(diagonal - c("place")).alias("off"), "p", "filled")).alias("m"))
    near = near.withColumn("n", F.count("*").over(W.partitionBy("row", "key", "place"))).where(enough)
    near = near.select(*own, "q", "m.p", "m.filled")
    all_met = met.groupBy("row", "key", "total").agg(F.countDistinct("q").alias("n")).where(enough).select("row", "key")
    torn = met.join(all_met, ["row", "key"], "leftsemi").withColumn("place", F.lit(WHOLE_DOCUMENT)).select(*own, "q", "p", "filled")
    judged = pin_table(near.unionByName(torn))
    slots = judged.select("row", "key", "place", "q", "p", F.inline("filled"))
    usual = slots.groupBy("row", "key", "place", "kind", "value", "there").agg(F.count("*").alias("n"))
    usual = usual.groupBy("row", "key", "place", "kind", "value").agg(F.max(F.struct("n", "there")).alias("usual"))
    odd = slots.join(usual, ["row", "key", "place", "kind", "value"]).where("there != usual.there").select("row", "key", "place", "q", "p").distinct()
    good = judged.join(odd, ["row", "key", "place", "q", "p"], "leftanti")
    return good.groupBy(*own).agg(F.countDistinct("q").alias("n")).where(enough).select("row", "item", c("total").alias("n_windows"), c("n").alias("n_matched"))


def _whole_met(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """(row, item, n_windows, n_matched) of texts met from their first to their last word, as one window, with consistent slots.

    rows (row, h, v).
    """
    met = rows.join(whole, "h").withColumn("filled", _filled("v"))
    given = F.array_distinct(F.transform("filled", lambda s: F.struct(s["kind"], s["value"])))
    met = met.where(F.when(F.col("verbatim"), F.col("slots") == F.col("v")).otherwise(F.size(given) == F.size(F.array_distinct("filled"))))
    return met.select("row", "item", F.lit(1).cast("long").alias("n_windows"), F.lit(1).cast("long").alias("n_matched"))


def leaks(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, item, n_windows, n_matched) of every document and benchmark item of which it holds SHARE of the windows.

    `row` must name the rows of docs uniquely and stay the same when docs is read again. Windows of five template words
    (three of them literal) are joined by hash. Every window of the documents is looked up; only documents with a known one
    are read again with their slots. In one place of a document, every value of a typed slot must become the same value
    throughout: windows whose slot departs from the most frequent replacement there don't count. One place that holds
    SHARE of the windows suffices. A text without a usable window (fewer than five words, or mostly placeholders) is one
    window of its own length; below five words, or without a literal, its values must be the same too. The benchmark is
    broadcast if its windows were counted to be at most BROADCAST_ROWS, else shuffled; the different lengths of texts that
    are met as a whole are held on the driver.

    Null texts are empty; null items and items of fewer than three words are not found; rows of an item that repeats are
    alternatives, each judged by its own windows, and the best one is given; repeated documents are found each; null rows
    and empty tables give no result; other columns are not read.
    """
    c = F.col("c")
    items = pin_table(item_texts(benchmark, item, item_text))
    windows = pin_table(item_windows(items))
    whole = pin_table(whole_items(items, windows))
    bounded = F.broadcast if windows.count() <= BROADCAST_ROWS else (lambda df: df)
    lengths = [r[0] for r in whole.select("size").distinct().orderBy("size").collect()]
    anchors = [r[0] for r in whole.select("length").distinct().orderBy("length").collect()]
    known = windows.select("h").unionByName(whole.select(F.col("anchor").alias("h"))).distinct()
    rows = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    hashes_of = lambda n: F.transform(_at(c, n), lambda i: F.xxhash64(F.slice("c", i, n)))
    looked_up = rows.select("row", template(F.col("text")).alias("c")).select("row", F.explode(F.concat(*map(hashes_of, sorted({WORDS, *anchors})))).alias("h"))
    candidates = looked_up.join(bounded(known), "h").select("row").distinct()
    found = rows.join(pin_table(candidates), "row", "leftsemi").select("row", template(F.col("text")).alias("c"), values(F.col("text")).alias("v"))
    window = lambda n: F.transform(_at(c, n), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice("c", i, n)).alias("h"), F.slice("v", i, n).alias("v")))
    met = _windows_met(found.select("row", F.inline(window(WORDS))), bounded(windows))
    if lengths:
        met = met.unionByName(_whole_met(found.select("row", F.inline(F.concat(*map(window, lengths)))), bounded(whole)))
    best = met.groupBy("row", "item").agg(F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), "n_windows", "n_matched")).alias("b"))
    return best.select("row", "item", "b.n_windows", "b.n_matched")


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_windows, n_matched): the leaks of a table as read, by its own key, which may be null or repeat."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = leaks(rows, benchmark, "row", "text", item, item_text)
    return found.join(rows.select("row", "key"), "row").select(F.col("key").alias(key), F.col("item").alias(item), "n_windows", "n_matched")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs (a table as read) that hold no benchmark item, with all their columns."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    found = leaks(rows.select(name, F.col(text).alias("text")), benchmark, name, "text", item, item_text).select(F.col("row").alias(name)).distinct()
    return rows.join(found, name, "leftanti").drop(name)
