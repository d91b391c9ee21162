"""Benchmark passages in documents, by a positional inverted index; DataFrame functions only.

The index holds (term, document, position) for every word of a document that a test item
uses.  Its counts rank the terms of each test window; the lists of a window's rarest terms,
shifted by their offsets, are intersected by joins, and what is left is compared word for
word with the document.  A window with a term that no document has is never looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import text_hash, written

WINDOW = 13
LISTS = 3  # lists intersected before words are compared
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words of a text: ASCII digits and letters in lower case, and everything beyond ASCII; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def n_words_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD_ANY_CASE)).cast("long")


def small(df: DataFrame, size: Column) -> DataFrame:
    """Marks a table for broadcast if the sum of ``size`` is within BROADCAST_BYTES; else the join shuffles."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def test_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(wid, words, item_id): every window of consecutive words of every item; equal windows share wid."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()
    named = each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id())
    named = written(named, "windows")
    return written(each.join(named, "words"), "item-windows"), named


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(_id, _h, pos, tid): where the terms of ``vocabulary`` (term, tid) stand in ``docs`` (_id, _h, text)."""
    each = docs.select("_id", "_h", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return each.join(small(vocabulary, F.length("term") + 48), "term").select("_id", "_h", "pos", "tid")


def candidates(index: DataFrame, windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(_id, _h, wid, start): places where the rarest terms of a window stand as in the window."""
    counts = index.groupBy("tid").agg(F.count("*").alias("n"))
    terms = windows.select("wid", F.posexplode("words").alias("offset", "term")).join(vocabulary, "term", "left").join(counts, "tid", "left")
    rarest = Window.partitionBy("wid").orderBy("n", "offset")  # at most WINDOW rows each
    whole = Window.partitionBy("wid")
    ranked = (
        terms.withColumn("present", F.min(F.coalesce("n", F.lit(0))).over(whole))
        .filter("present > 0")
        .withColumn("rank", F.row_number().over(rarest))
        .withColumn("length", F.count("*").over(whole))
    )
    ranked = written(ranked.filter(F.col("rank") <= LISTS).select("wid", "tid", "offset", "rank", "length"), "rarest")
    lists = lambda r: small(ranked.filter(F.col("rank") == r).select("wid", "tid", "offset", "length"), F.lit(40))
    found = index.join(lists(1), "tid").select("_id", "_h", "wid", (F.col("pos") - F.col("offset")).alias("start"), "length").filter("start >= 0")
    for r in range(2, LISTS + 1):
        shifted = index.join(lists(r), "tid").select("_id", "_h", "wid", (F.col("pos") - F.col("offset")).alias("start"))
        done = found.filter(F.col("length") < r)
        found = found.filter(F.col("length") >= r).join(shifted, ["_id", "_h", "wid", "start"], "left_semi").unionByName(done)
    return found.select("_id", "_h", "wid", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` the struct of its columns, _id, _h, n_words and hits (start, n, wid); and (wid, item_id).

    ``docs`` has row, _id, _h and text.
    """
    items, windows = test_windows(benchmark, window)
    vocabulary = windows.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    vocabulary = written(vocabulary, "vocabulary")
    index = written(postings(docs, vocabulary), "index")
    # Written, so that no plan has the lists' joins and those of the texts.
    places = written(candidates(index, windows, vocabulary), "candidates").join(small(windows, F.length(F.array_join("words", " ")) + 64), "wid")
    places = places.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "words", "wid")).alias("places"))
    tokens = F.when(F.col("places").isNotNull(), words_of(F.col("text")))
    joined = docs.join(places, ["_id", "_h"], "left").withColumn("w", tokens)
    same = F.filter("places", lambda p: F.slice("w", p["start"] + 1, F.size(p["words"])) == p["words"])
    hits = F.transform(same, lambda p: F.struct(p["start"].alias("start"), F.size(p["words"]).alias("n"), p["wid"].alias("wid")))
    return joined.select("row", "_id", "_h", n_words_of("text").alias("n_words"), hits.alias("hits")), items


def n_hit(hits: str = "hits") -> Column:
    """Number of word positions inside any hit."""
    each = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))
    return F.coalesce(F.size(F.array_distinct(F.flatten(each))), F.lit(0)).cast("long")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 1, misses: int = 2) -> DataFrame:
    """(doc_id, item_id, start, n_matched): places where a test window stands with words moved, put in, left out or changed.

    A window of n words matches at ``start`` (a position in the document, from 0) if at least n - m of its words stand within
    ``slop`` positions of their own: word i somewhere from start + i - slop to start + i + slop.  m is ``misses`` for a
    whole window and in proportion, rounded down, for the shorter window of a short item.  With slop and
    misses 0 these are the exact occurrences.  One row a document, item and start, n_matched from the item's best
    window there.  Items with a null item_id are left out; equal rows of documents give their matches once.

    At most m words are missing, so one of the window's m + 1 rarest stands near its place: the
    postings of those give the places that are looked at, 2 * slop + 1 starts each, and there the words of
    the document are compared.  While the rarest terms are few enough to be broadcast, postings stay where they lie.
    """
    items, windows = test_windows(benchmark.filter("item_id IS NOT NULL"), window)
    vocabulary = windows.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    vocabulary = written(vocabulary, "vocabulary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), text_hash().alias("_h"), "text")
    index = written(postings(keyed, vocabulary), "index").distinct()

    allowed = lambda n: F.floor(F.lit(misses) * n / window).cast("int")
    counts = index.groupBy("tid").agg(F.count("*").alias("n"))
    terms = windows.select("wid", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    terms = terms.join(vocabulary, "term").join(counts, "tid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("n", "offset"))  # at most ``window`` rows each
    rarest = terms.withColumn("rank", rank).filter((F.col("rank") <= allowed(F.col("length")) + 1) & (F.col("n") > 0))
    rarest = written(rarest.select("wid", "tid", "offset"), "rarest-terms")

    near = index.join(small(rarest, F.lit(32)), "tid").select("_id", "_h", "wid", (F.col("pos") - F.col("offset")).alias("at"))
    starts = near.select("_id", "_h", "wid", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)).alias("start")).distinct()
    placed = starts.join(small(windows, F.length(F.array_join("words", " ")) + 64), "wid").groupBy("_id", "_h")
    placed = placed.agg(F.collect_list(F.struct("wid", "start", "words")).alias("places"))
    tokens = keyed.join(placed, ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("doc_id", words_of(F.col("text")).alias("w"), "places")

    def stands(place: Column, word: Column, i: Column) -> Column:
        first = F.greatest(place["start"] + i - slop, F.lit(0))
        length = F.greatest(place["start"] + i + slop - first + 1, F.lit(0))
        return F.array_contains(F.slice("w", first + 1, length), word)

    n_matched = lambda p: F.size(F.filter(F.transform(p["words"], lambda word, i: stands(p, word, i)), lambda x: x))
    each = F.transform(
        "places", lambda p: F.struct(p["wid"].alias("wid"), p["start"].alias("start"), F.size(p["words"]).alias("length"), n_matched(p).alias("n_matched"))
    )
    found = tokens.select("doc_id", F.inline(each)).filter(F.col("n_matched") >= F.col("length") - allowed(F.col("length")))
    listed = items.select("wid", "item_id").distinct()
    named = found.join(small(listed, F.length("item_id") + 48), "wid")
    return named.groupBy("doc_id", "item_id", "start").agg(F.max("n_matched").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs`` (doc_id, text).

    A window is ``window`` consecutive words of an item of ``benchmark`` (item_id, text), or
    the whole item if it has fewer; a document's word inside any occurrence of a window is hit.
    contaminated: at least a twentieth of the words are hit, and one at least.  Null or blank
    texts have no words, in documents and items.  Items of one item_id count once; an item
    with a null item_id hits words but is not listed.  Repeated rows get equal results.
    """
    keyed = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"),
        text_hash().alias("_h"),
        "text",
    )
    found, items = contamination(keyed, benchmark, window)
    wids = F.array_distinct(F.transform("hits", lambda h: h["wid"]))
    slim = written(found.select("row.doc_id", "_id", "_h", "n_words", n_hit().alias("n_hit"), wids.alias("wids")), "hits")
    of_doc = slim.filter("n_hit > 0").select("_id", "_h", F.explode("wids").alias("wid")).distinct()
    listed = items.select("wid", "item_id").filter("item_id IS NOT NULL")
    of_doc = of_doc.join(small(listed, F.length("item_id") + 48), "wid").select("_id", "_h", "item_id").distinct()
    of_doc = of_doc.groupBy("_id", "_h").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    joined = slim.join(of_doc, ["_id", "_h"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that are not contaminated."""
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), text_hash().alias("_h"), "text")
    found, _ = contamination(keyed, benchmark, window)
    return found.withColumn("n_hit", n_hit()).filter(~is_contaminated()).select("row.*")
