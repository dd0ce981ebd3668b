"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.llm.common import fresh, hash_filter, let
from poremetry.llm.licenses import SEPARATORS
from poremetry.workspace import materialize

SHINGLE = 5  # words
CONTAINMENT = 80  # per cent of an item's shingles that a contaminated document holds


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SEPARATORS}]+"), lambda w: w != "")


def _gram(words: Column, i: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + k) for k in range(length)])


def _starts(words: Column, length: int) -> Column:
    """Positions where ``length`` words begin."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Written table (item_id, shingle, length, n, signature) of the distinct shingles of the test items.

    Items are partitioned by size: classes of the number n of shingles up to 1, 2, 4, 8, ... In a class with upper size u, the
    ``signature`` of an item is its floor(u / 5) + 1 smallest shingle hashes, a bottom-k MinHash. A document that holds 80 % of the
    n <= u shingles misses at most floor(u / 5) of them, so it holds a value of the signature: the search loses nothing.
    An item of fewer than five words is one shingle of all its words; an item without words is never found.
    """
    distinct = items.select(F.col(item_id).alias("item_id"), _words(F.col(text)).alias("w"))
    length = F.least(F.lit(SHINGLE), F.size("w"))
    grams = F.when(length < SHINGLE, F.array(F.array_join("w", " "))).otherwise(
        F.transform(_starts(F.col("w"), SHINGLE), lambda i: _gram(F.col("w"), i, SHINGLE)))
    rows = distinct.where(F.size("w") > 0).select("item_id", length.alias("length"), F.explode(grams).alias("shingle")).distinct()
    item = Window.partitionBy("item_id")
    counted = rows.withColumns({"n": F.count(F.lit(1)).over(item), "place": F.row_number().over(
        item.orderBy(F.xxhash64("shingle"), "shingle"))})
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("bigint")
    signature = F.col("place") <= F.floor(upper * (100 - CONTAINMENT) / 100) + 1
    return materialize(counted.select("item_id", "shingle", "length", "n", signature.alias("signature")))


def _held(words: Column, maybe: Callable[[Column], Column], length: int) -> Column:
    """Shingles of ``words`` that pass the filter: all that are in an item, and few others."""
    return F.filter(F.transform(_starts(words, length), lambda i: _gram(words, i, length)), maybe)


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment): documents that hold 80 % of the distinct shingles of an item.

    Shingles are five consecutive words, lower-cased, without punctuation. Documents are read once, row by row; only shingles
    that pass a hash filter leave a row. Candidate pairs share a value of an item's MinHash signature; they are verified with the shingles
    themselves. Null and empty texts hold nothing; rows with one id, or with a null id, count as one document and give one pair; empty
    tables give no pairs; further columns are ignored.
    """
    return _find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, item_id, item_text)


def _find(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, one_text: bool = False) -> DataFrame:
    """``find`` over (doc_id, text); with ``one_text`` rows with one id have one text, which is searched once."""
    shingles = item_shingles(items, item_id, item_text)
    maybe = hash_filter(shingles, "shingle")
    lengths = sorted(r.length for r in shingles.select("length").distinct().collect())  # five numbers at most
    held = let(_words(F.col("text")), lambda w: F.array_distinct(F.concat(
        *[_held(w, maybe, n) for n in lengths] or [F.array().cast("array<string>")])))
    holding = docs.select("doc_id", held.alias("held")).where(F.size("held") > 0)
    scanned = materialize(holding.dropDuplicates(["doc_id"]) if one_text else holding)
    shared = scanned.select("doc_id", F.explode("held").alias("shingle"))
    candidates = shared.join(shingles.where("signature").select("shingle", "item_id"), "shingle").select("doc_id", "item_id").distinct()
    common = shared.join(shingles.select("shingle", "item_id", "n"), "shingle").alias("c").join(
        candidates.alias("k"), F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.item_id") == F.col("k.item_id")), "left_semi")
    counted = common.groupBy("doc_id", "item_id", F.col("n").alias("n_shingles")).agg(F.countDistinct("shingle").alias("n_common"))
    return counted.where(100 * F.col("n_common") >= CONTAINMENT * F.col("n_shingles")).withColumn(
        "containment", F.col("n_common") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no test item. Every text is judged by itself, whatever its id, null ids included.

    Items of fewer than five words are too common to be evidence ("Yes"): ``find`` reports them, but no document is dropped for them alone.
    """
    name = F.xxhash64(F.col(text))
    leak, = fresh(docs, "_leak")
    texts = docs.select(name.alias("doc_id"), F.col(text).alias("text"))
    long = items.where(F.size(_words(F.col("text"))) >= SHINGLE)
    leaks = materialize(_find(texts, long, "item_id", "text", one_text=True).select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(leaks, name == F.col(leak), "left_anti")
