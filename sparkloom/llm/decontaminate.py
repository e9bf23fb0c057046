"""Benchmark decontamination by templates of words and typed placeholders, with DataFrame functions only.

Two readings of a text are compared with the benchmark, each by a hash join of windows:

* its template, in which numbers, names and units are placeholders, finds re-parameterised items;
* its plain words in lower case find exact copies, short and number-heavy items and copies in capitals.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut

#: Words that count as units, and words that count as numbers, as fixed lists.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ounce", "ounces", "pound", "pounds", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "watt", "watts", "volt", "volts", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
)
NUMBERS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
)
#: Placeholders of numbers, names and units: characters for private use, which no word holds.
NUM, NAME, UNIT = "\ue001", "\ue002", "\ue003"
TOKEN = r"[\p{L}\p{M}]++|[0-9]++(?:[.,:/][0-9]++)*+"
#: Windows of so many tokens; of a template window at least half must be words. Items below LEAST template tokens are not looked
#: for re-parameterised, and those below EXACT_LEAST words not at all: they are too short to prove anything.
WINDOW, LEAST, EXACT_LEAST = 13, 6, 5
#: Up to so many windows of the benchmark are broadcast (40 bytes each), and so many ids of documents (8 bytes each).
BROADCAST_WINDOWS, BROADCAST_IDS = 400_000, 2_000_000
TEMPLATE, WORDS = 0, 1


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def typed(token: Column) -> Column:
    """Numbers (in digits or words), names and units as placeholders, all else in lower case.

    A name is a word of two letters or more with a capital one. Where it stands does not matter, so that a sentence's
    first word is the same placeholder in an item and in a document.
    """
    low = F.lower(token)
    return (
        F.when(token < ":", F.lit(NUM)).when((low != token) & (F.length(token) > 1), F.lit(NAME))
        .when(low.isin(*UNITS), F.lit(UNIT)).when(low.isin(*NUMBERS), F.lit(NUM)).otherwise(low)
    )


def template(tokens: Column, value=lambda t: t) -> Column:
    """value of each typed token; names in a row are one placeholder."""
    name = value(F.lit(NAME))
    return bind(F.transform(tokens, lambda t: value(typed(t))), lambda v: F.filter(v, lambda x, i: (x != name) | (i == 0) | (F.get(v, i - 1) != name)))


def template_raw(tokens: Column) -> Column:
    """The text of each token of template, in the same places: a struct of its placeholder and its words in lower case."""
    pair = F.transform(tokens, lambda t: F.struct(typed(t).alias("k"), F.lower(t).alias("w")))

    def merged(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (F.get(v, i)["k"] != NAME) | (i == 0) | (F.get(v, i - 1)["k"] != NAME))
        return F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(v)), F.array(F.size(v))), lambda a, b: F.struct(F.get(v, a)["k"].alias("k"), F.array_join(F.transform(F.slice(v, a + 1, b - a), lambda x: x["w"]), " ").alias("w")))

    return F.when(F.size(tokens) > 0, bind(pair, merged))


def windows(hashes: Column, sizes: list[int], reading: Column) -> Column:
    """An array for each size (4 or more): the hash of each so many tokens in a row and the reading, by way of the hashes of each four."""

    def wide(a: Column, offsets: list[int], *salt: Column) -> Column:
        return F.transform(F.slice(a, 1, F.greatest(F.size(a) - offsets[-1], F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(a, i + o) for o in offsets[1:]], *salt))

    return bind(wide(hashes, [0, 1, 2, 3]), lambda g: F.array(*[wide(g, [*range(0, n - 4, 4), n - 4], reading) for n in sizes]))


def keyed_items(benchmark: DataFrame) -> DataFrame:
    """(ik, item_id, text) of the benchmark's distinct rows with a text; ik tells them apart, also rows without or with equal item_id."""
    b = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return b.select(F.xxhash64(F.coalesce("item_id", F.lit(-1)), F.col("item_id").isNull(), "text").alias("ik"), "item_id", "text").distinct()


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(ik, reading, size, item_pos, hash) of the windows of n tokens, or of the whole item where it is shorter, in both readings; of templates, those that are words by half."""
    tokens = raw_tokens(F.col("text"))
    both = keyed_items(benchmark).select("ik", F.posexplode(F.array(template(tokens), F.transform(tokens, F.lower))).alias("reading", "t"))
    b = both.where(F.size("t") >= F.when(F.col("reading") == TEMPLATE, LEAST).otherwise(EXACT_LEAST)).withColumn("size", F.least(F.size("t"), F.lit(n)))
    sizes = list(range(min(EXACT_LEAST, n), n + 1))
    w = bind(F.transform("t", lambda t: F.xxhash64(t)), lambda h: windows(h, sizes, F.col("reading")))
    rows = b.select("ik", "reading", "size", "t", F.posexplode(F.get(w, F.col("size") - sizes[0])).alias("item_pos", "hash"))
    words = F.size(F.filter(F.slice("t", F.col("item_pos") + 1, F.col("size")), lambda x: ~x.isin(NUM, NAME, UNIT)))
    return rows.where((F.col("reading") == WORDS) | (words * 2 >= F.col("size"))).select("ik", "reading", "size", "item_pos", "hash").distinct()


def runs(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, tk, ik, reading, shift, first, last, size): runs of windows without a gap that a text (tk) shares with an item; docs: (doc_id, tk, text).

    Each text is cut up and hashed once for both readings and all sizes. The windows of one shift are at most those of
    the item, so the set that is gathered is bounded by an item's length.
    """
    found = {(r["reading"], r["size"]) for r in bench.select("reading", "size").distinct().collect()}  # at most 2 * WINDOW pairs
    sizes = [sorted(n for r, n in found if r == k) for k in (TEMPLATE, WORDS)]

    def both(t: Column) -> Column:
        hashes = (template(t, lambda x: F.xxhash64(x)), F.transform(t, lambda x: F.xxhash64(F.lower(x))))
        return F.concat(*[bind(h, partial(windows, sizes=n, reading=F.lit(k))) for k, (h, n) in enumerate(zip(hashes, sizes)) if n])

    rows = docs.limit(0).select("doc_id", "tk", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("hash"))
    if found:
        rows = docs.select("doc_id", "tk", F.explode(bind(raw_tokens(F.col("text")), both)).alias("w")).select("doc_id", "tk", F.posexplode("w").alias("pos", "hash"))
    known = F.broadcast(bench) if bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else bench
    hits = rows.join(known, "hash").groupBy("doc_id", "tk", "ik", "reading", "size", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("pos").alias("at"))
    ends = lambda step: F.array_sort(F.filter("at", lambda p: ~F.array_contains("at", p + step)))  # noqa: E731  places whose neighbour is missing
    r = hits.select("doc_id", "tk", "ik", "reading", "size", "shift", F.explode(F.arrays_zip(ends(-1).alias("first"), ends(1).alias("last"))).alias("r"))
    return r.select("doc_id", "tk", "ik", "reading", "shift", "r.first", (F.col("r.last") + F.col("size")).alias("last"), "size")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_windows, exact): places where a document holds an item or a re-parameterised one.

    Exact ones are runs of n or more equal words, or the whole of a shorter item; start counts words, the case of letters
    does not matter. The others are runs of template tokens (start counts those) of which some slot has another value:
    between an item's slots (numbers, names, units) and the document's there must be a one-to-one mapping within the run,
    so one value of the item always stands for one value of the document, and back. A run that conflicts is left out,
    others of the same document stay. Null and empty texts and items hold nothing, an empty table gives an empty result.
    Documents without doc_id are not reported; of rows that share a doc_id with different texts all places are. Repeated
    rows of either table change nothing; items with a null item_id are looked for too and reported with null. No other
    column than doc_id, text and item_id is read.
    """
    if n < 4:
        raise ValueError("windows have 4 tokens or more")
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tk", F.xxhash64("text"))
    items = keyed_items(benchmark)
    found = cut(runs(d, cut(benchmark_windows(benchmark, n))))
    loose = found.where(F.col("reading") == TEMPLATE)
    ids = loose.select("doc_id").distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = d.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "tk"]).select("doc_id", "tk", template_raw(raw_tokens(F.col("text"))).alias("raw"))
    size = F.col("last") - F.col("first")
    pairs = F.arrays_zip(F.slice("item_raw", F.col("first") - F.col("shift") + 1, size).alias("x"), F.slice("raw", F.col("first") + 1, size).alias("y"))
    slots = F.transform(F.filter(pairs, lambda p: p["x"]["k"].isin(NUM, NAME, UNIT)), lambda p: F.struct(p["x"]["w"].alias("x"), p["y"]["w"].alias("y")))
    aligned = loose.join(items.select("ik", "item_id", template_raw(raw_tokens(F.col("text"))).alias("item_raw")), "ik").join(texts, ["doc_id", "tk"]).withColumn("pairs", F.array_distinct(slots))
    one = (F.size(F.array_distinct("pairs.x")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.y")) == F.size("pairs"))
    other = aligned.where(one & F.exists("pairs", lambda p: p["x"] != p["y"]))
    exact = found.where(F.col("reading") == WORDS).join(items.select("ik", "item_id"), "ik")
    cols = ("doc_id", "item_id", F.col("first").cast("bigint").alias("start"), size.cast("bigint").alias("n_tokens"), (size - F.col("size") + 1).cast("bigint").alias("n_windows"))
    return exact.select(*cols, F.lit(True).alias("exact")).unionByName(other.select(*cols, F.lit(False).alias("exact"))).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item of the benchmark; all columns, and rows without doc_id, stay."""
    bad = cut(contaminated(docs, benchmark).select("doc_id").distinct())
    small = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if small else bad, "doc_id", "left_anti").select(*docs.columns)


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated, which states the rules, over whole tables."""
    return contaminated(docs, benchmark)
