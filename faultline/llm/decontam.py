"""Benchmark decontamination by a prefix-filtered set join, all in DataFrame operations (op6).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  An item's windows are its
runs of ``window`` consecutive words; an item of fewer, but some, words is one window.  A
document contains a window only if it contains all of its words, so the necessary prefix is
one word: the rarest of the window by the counts over all documents.  Documents' words meet
those rarest words in a join; a match at position p proposes the window at p - offset, and
only where length and position leave room for it are its words compared one by one.

The item side is broadcast while it has at most ``BROADCAST_ROWS`` rows, counted first, and words are
compared inside the compiled join.  Beyond that places of words are shuffled alone (id, mark, place,
word), and a second join brings each text once to the windows proposed for it.  The side of the
documents is never grouped by a word; a frequent word makes a join larger, which Spark splits.  The word counts are one extra pass over the documents.

Defined results: null or wordless texts have no words and no hits; an item without words or
without id has no windows; equal windows of several items count for each; rows of one
``doc_id`` with different texts are judged each by itself, equal rows alike; an empty
benchmark leaves all documents clean; other columns do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import unused as words_unused
from faultline.session import broadcast_if_small, materialize

WINDOW = 10
#: Most rows of the item side that are broadcast, each below a kilobyte.
BROADCAST_ROWS = 100_000
#: Fixed value: separators between words; A-Z are letters here, as they are lowered later.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order, their case unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def lower_az(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def item_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """``item_id, words, size``: distinct windows of each item, their words joined by a blank."""
    w = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.transform(words(F.col(text)), lower_az).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    return w.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("words"),
        n.alias("size")).distinct()


def rare_words(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """``words, size, rare, place``: the rarest word of each distinct window and where it stands.

    Rarity is the count over all words of all documents; ties go to the smaller word."""
    vocab = windows.select(F.explode(F.split("words", " ")).alias("word")).distinct()
    seen = docs.select(F.explode("w").alias("raw")).select(F.lower("raw").alias("word"))
    counts = seen.join(_sent(vocab.select(F.lower("word").alias("word")).distinct(), small), "word").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place"))
    return windows.select("words", "size").distinct().select(
        "words", "size", F.posexplode(F.split("words", " ")).alias("place", "word")).join(
        counts.withColumnRenamed("word", "lowered"), F.lower("word") == F.col("lowered"), "left") \
        .groupBy("words", "size").agg(best.alias("best")).select("words", "size", F.lower("best.word").alias("rare"), "best.place")


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(places of windows in documents, items of windows).

    Places: doc_id, mark (hash of the text, tells rows of one id apart), start, size, words.
    Items: words, item_id."""
    items = materialize(item_windows(benchmark, window, item_id, text), "item-windows")
    small = items.count() * max(1, window) <= BROADCAST_ROWS * WINDOW
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), words(F.col(text)).alias("w"))
    rare = materialize(rare_words(items, rows, small), "rare-words")
    proposed = proposals(rows if small else rows.select("doc_id", "mark", "w"), rare, small)
    if not small:
        texts = rows.select(F.col("doc_id").alias("of"), F.col("mark").alias("by"), "w")
        proposed = proposed.join(texts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("by")))
    held = lower_az(F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " "))
    found = proposed.where(F.when(
        (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("w")), held == F.col("words")).otherwise(F.lit(False)))
    return materialize(found.select("doc_id", "mark", "start", "size", "words"), "window-places"), items


def proposals(rows: DataFrame, rare: DataFrame, small: bool) -> DataFrame:
    """Windows proposed by their rarest word: doc_id, mark, start, size, words, and, where the item side is
    broadcast, the text's words ``w``, which no shuffle carries."""
    # lower() of the library folds at least A-Z, so equal words stay equal; the comparison of all words is the exact one
    text = ["w"] if small else ["n"]
    seen = rows.withColumn("n", F.size("w")).select("doc_id", "mark", *text, F.posexplode("w").alias("at", "raw")).withColumn("rare", F.lower("raw"))
    # only functions that compile into the join's loop, so that a text's words are never copied per word
    start = F.col("at") - F.col("place")
    room = (start >= 0) & (start + F.col("size") <= (F.size("w") if small else F.col("n")))
    return seen.join(_sent(rare, small), "rare").where(room).select("doc_id", "mark", start.alias("start"), "size", "words", *(text if small else []))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    places, items = find_windows(docs, benchmark, window, doc_id, text, item_id)
    key = ["doc_id", "mark"]
    hit = places.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")) \
        .distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    of = places.select(*key, "words").distinct().join(items.select("words", "item_id"), "words").select(
        *key, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*key).agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    judged = hit.join(of, hit["doc_id"].eqNullSafe(of["doc_id"]) & (hit["mark"] == of["mark"])).select(
        hit["doc_id"].alias("of"), hit["mark"].alias("by"), "n_hit", "items")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"),
                       F.size(words(F.col(text))).cast("long").alias("n_words"))
    return rows.join(judged, rows["doc_id"].eqNullSafe(F.col("of")) & (rows["mark"] == F.col("by")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                      text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows in which a window occurs."""
    places, _ = find_windows(docs, benchmark, window, doc_id, text, item_id)
    id_, mark = words_unused(docs, "bad_id", "bad_mark")
    bad = materialize(places.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad), F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(mark)), "left_anti")
