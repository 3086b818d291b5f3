"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's words are its runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. Of every `keep`
neighbouring hashes of `gram` words the least is kept as a fingerprint. With gram + keep - 1 = `window` words,
any shared span of that length or more has a fingerprint that both texts keep, so joining the fingerprints of
training and benchmark texts misses none. Each hit is then extended: the windows around it are compared word for
word with those of the items. Items shorter than the window are one window of their own length; their hashes are
looked up at every place.

A null text has no words and is not contaminated. Rows are judged each by its own text, whatever their doc_id, null and
repeated ones included. An item without an id contaminates, but can't be named. Item ids may be of any type. An empty
documents table gives no rows, an empty benchmark no hits. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, discard, only_columns, without, written

GRAM, KEEP = 5, 6
WINDOW = GRAM + KEEP - 1
#: Rows of the benchmark's side of a join up to which it is broadcast (a few MB of hashes, or some 40 MB of windows); larger sides are shuffled.
BROADCAST_ROWS = 200_000


def words(c):
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(h: str, m: int):
    """Hashes of all m neighbouring words, from the column h of the words' hashes."""
    n = F.size(h) - m
    hashed = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(m), *[F.get(F.col(h), i + k) for k in range(m)]))
    return F.when(n >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _with_grams(df: DataFrame) -> DataFrame:
    """Columns h and g: hashes of words and of their grams."""
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("g", _grams("h", GRAM))


def _fingerprints():
    n = F.size("g") - KEEP
    least = F.transform(F.sequence(F.lit(0), n), lambda i: F.least(*[F.get(F.col("g"), i + k) for k in range(KEEP)]))
    return F.when(n >= 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _bounded(df: DataFrame) -> DataFrame:
    return bounded(df, BROADCAST_ROWS)


def _window(start, length):
    return F.array_join(F.slice("words", start + 1, length), " ")


def _found(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: all rows (doc_id, doc_key, text_hash, n_words, prints); hits (doc_key, text_hash, start, length, window); windows of items.

    doc_key and text_hash tell rows of different content apart. Each hit is there once.
    """
    items = written(
        _with_grams(only_columns(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)),
        "benchmark-words",
    )
    n = F.size("words")
    length = F.least(n, F.lit(WINDOW))
    short = sorted(r["m"] for r in items.filter(n < WINDOW).select(n.alias("m")).distinct().collect())  # at most WINDOW - 1 numbers
    of_items = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n - length), lambda s: F.struct(length.alias("length"), _window(s, length).alias("window")))).alias("w"))
    windows = written(of_items.select("item_id", "w.length", "w.window").distinct(), "benchmark-windows")
    kept = items.filter(n >= WINDOW).select(F.lit(GRAM).alias("m"), F.explode(_fingerprints()).alias("print"))
    for m in short:
        kept = kept.union(items.filter(n == m).select(F.lit(m).alias("m"), F.explode(_grams("h", m)).alias("print")))
    kept = written(kept.distinct(), "benchmark-prints")
    known = _bounded(kept)

    docs = only_columns(documents, "doc_id", "text").withColumns({"text_hash": F.xxhash64("text"), "doc_key": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    own = _fingerprints()
    if short:
        own = F.array_distinct(F.concat(own, *[_grams("h", m) for m in short]))
    prints = written(
        _with_grams(docs.select("doc_id", "doc_key", "text_hash", words(F.col("text")).alias("words"))).select("doc_id", "doc_key", "text_hash", F.size("words").cast("long").alias("n_words"), own.alias("prints")),
        "document-prints",
    )
    met = prints.select("doc_key", "text_hash", F.explode("prints").alias("print")).join(_bounded(kept.select("print").distinct()), "print", "left_semi")
    keys = written(met.select("doc_key", "text_hash").distinct(), "hit-documents")
    near = docs.join(bounded(keys), ["doc_key", "text_hash"]).select("doc_key", "text_hash", words(F.col("text")).alias("words"))
    # with the hashes of words: what is made from them below would compute them anew for each element
    near = written(near.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))), "near-documents")

    # places of hits, one row for each gram of the documents that have any; then the windows around them
    grams = near.select("doc_key", "text_hash", F.size("words").alias("n"), "h", _grams("h", GRAM).alias("g"))
    # what a row carries is copied for each of its grams, so it carries no array but the one that is taken apart
    places = grams.select("doc_key", "text_hash", "n", "g").select("doc_key", "text_hash", "n", F.posexplode("g").alias("at", "print")).join(known.filter(F.col("m") == GRAM), "print")
    around = F.explode(F.sequence(F.greatest(F.col("at") - (KEEP - 1), F.lit(0)), F.col("at")))
    starts = places.select("doc_key", "text_hash", "n", around.alias("start")).filter(F.col("start") <= F.col("n") - WINDOW).select("doc_key", "text_hash", "start", F.lit(WINDOW).alias("length"))
    for m in short:
        own_grams = grams.select("doc_key", "text_hash", _grams("h", m).alias("g"))
        at = own_grams.select("doc_key", "text_hash", F.posexplode("g").alias("start", "print")).join(known.filter(F.col("m") == m), "print")
        starts = starts.union(at.select("doc_key", "text_hash", "start", F.lit(m).alias("length")))
    of_row = starts.groupBy("doc_key", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("starts"))
    tried = near.join(of_row, ["doc_key", "text_hash"]).select("doc_key", "text_hash", F.explode(F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), _window(s["start"], s["length"]).alias("window")))).alias("w"))
    hits = tried.select("doc_key", "text_hash", "w.*").join(_bounded(windows.select("length", "window").distinct()), ["length", "window"], "left_semi").distinct()
    hits = written(hits.select("doc_key", "text_hash", "start", "length", "window"), "document-hits")
    discard(items, kept, keys, near)
    return prints, hits, windows


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans array<struct<start, length>> of windows hit and items array: one row for each document."""
    prints, hits, windows = _found(documents, benchmark)
    rows = prints.select("doc_id", "doc_key", "text_hash", "n_words")
    key = ["doc_key", "text_hash"]
    spans = hits.groupBy(*key).agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    # of a row's windows each text counts once before it meets the items that have it
    items = hits.select(*key, "length", "window").distinct().join(_bounded(windows), ["length", "window"]).groupBy(*key).agg(F.collect_set("item_id").alias("items"))
    out = rows.join(spans.join(items, key, "left"), key, "left")
    kind = windows.schema["item_id"].dataType.simpleString()
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))


def covered(spans):
    """How many words the spans cover together."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long")


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, without those that hold a window of an item."""
    prints, hits, windows = _found(documents, benchmark)
    bad = bounded(hits.select("doc_key", "text_hash").distinct())
    keys = written(prints.join(bad, ["doc_key", "text_hash"]).select("doc_id", "text_hash").distinct(), "contaminated")
    discard(prints, hits, windows)
    return without(documents, keys)
