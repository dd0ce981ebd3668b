"""License scans with a positional index of rare words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.llm.common import let
from poremetry.workspace import materialize

# Characters that separate words, as a Java and RE2 class body; upper-case letters are word characters, compared without case.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

# Phrases whose every place is counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices that the index looks for: label, wording, phrases that must stand in the file.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use", "binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ["creative commons attribution sharealike"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
# Words of any English prose and bare digits: too common to be looked up, they are only read when a phrase is verified.
COMMON = set("a all and any are by for forms free in into is of or other person source terms that the this to under use with without 0 1 2 3 4".split())
PROBES = 4  # rarest words of a notice that are looked up
SHARE = 0.6  # of a notice's weight that must stand in place


def _postings() -> list[tuple[int, str, int, str]]:
    return [(t, label, place, word) for t, (label, wording, _) in enumerate(TEMPLATES)
            for place, word in enumerate(wording.split()) if word not in COMMON]


def vocabulary() -> list[str]:
    """Every word that the index holds."""
    phrases = {w for p in PHRASES for w in p.split()} - COMMON
    return sorted(phrases | {word for *_, word in _postings()})


def phrase_pattern(phrase: str) -> str:
    """Finds the words of ``phrase`` standing consecutively, with nothing else than separators between them."""
    between = f"[{SEPARATORS}]+"
    return f"(?i)(^|[{SEPARATORS}]){between.join(phrase.split())}([{SEPARATORS}]|$)"


def _phrase_places(words: Column, hits: Column, phrase: str, label: str) -> Column:
    """Places of one fixed phrase: every hit of its first indexed word, read around its position."""
    parts = phrase.split()
    anchor = next(i for i, w in enumerate(parts) if w not in COMMON)

    def stands(hit: Column) -> Column:
        ok = (hit["word"] == parts[anchor]) & (hit["place"] >= anchor)
        for i, word in enumerate(parts):
            ok = ok & F.coalesce(F.lower(F.get(words, hit["place"] + (i - anchor))) == word, F.lit(False))
        return ok

    return F.transform(F.filter(hits, stands), lambda hit: F.struct(
        F.lit(label).alias("label"), (hit["place"] - anchor).alias("start")))


def _places(words: Column, hits: Column) -> Column:
    return F.concat(*[_phrase_places(words, hits, phrase, label) for phrase, label in PHRASES.items()])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written positional index: one row per document with its length, places of licence words and of the fixed phrases.

    Only documents with an indexed word keep their text, for the verification of phrases.
    """
    words_in = vocabulary()
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SEPARATORS}]+"), lambda w: w != "")

    def of(ws: Column) -> Column:
        hits = F.when(F.exists(ws, lambda w: F.lower(w).isin(words_in)), F.filter(
            F.transform(ws, lambda w, i: F.when(F.lower(w).isin(words_in), F.struct(F.lower(w).alias("word"), i.alias("place")))),
            lambda h: h.isNotNull()))
        return F.struct(F.size(ws).cast("bigint").alias("n_words"),
                        let(hits, lambda h: F.struct(h.alias("hits"), F.when(h.isNotNull(), _places(ws, h)).alias("base"))).alias("found"))

    scanned = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), let(words, of).alias("s"))
    return materialize(scanned.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("s.n_words").alias("n_words"),
        F.col("s.found.hits").alias("hits"), F.col("s.found.base").alias("base"),
        F.when(F.col("s.found.hits").isNotNull(), F.col("text")).alias("text")))


def notices(scanned: DataFrame) -> DataFrame:
    """(row_id, label, share): notices that stand in a document, with the share of their weight in place.

    A word weighs its inverse document frequency over the whole table, in thousandths; where every document holds every word of a notice,
    that is 0 for all of them and they weigh alike instead. The rarest words of each notice are
    looked up; their places propose where the notice starts, the other words are intersected at the same relative
    positions, and the mandatory phrases are verified in the text.
    """
    spark = scanned.sparkSession
    n_docs = scanned.metrics["rows"]
    frequency = scanned.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count()
    postings = spark.createDataFrame(_postings(), "template int, label string, offset int, word string").join(
        frequency, "word", "left").select(
        "template", "label", "offset", "word",
        F.floor(1000 * F.log((n_docs + 1) / (F.coalesce("count", F.lit(0)) + 1))).cast("bigint").alias("weight"))
    silent = F.max("weight").over(Window.partitionBy("template")) <= 0
    postings = postings.withColumn("weight", F.when(silent, F.lit(1).cast("bigint")).otherwise(F.col("weight")))
    rarest = F.row_number().over(_by_rarity())
    postings = materialize(postings.withColumn("probe", rarest <= PROBES))  # at most as many rows as words in TEMPLATES
    totals = postings.groupBy("template").agg(F.sum("weight").alias("total"))

    hits = scanned.where("hits IS NOT NULL").select("row_id", F.inline("hits"))
    placed = hits.join(F.broadcast(postings), "word").select(
        "row_id", "template", "label", (F.col("place") - F.col("offset")).alias("start"), "weight", "probe")
    lined_up = placed.groupBy("row_id", "template", "label", "start").agg(
        F.sum("weight").alias("weight"), F.max("probe").alias("probe")).where("probe")
    shares = lined_up.join(F.broadcast(totals), "template").where(F.col("weight") >= SHARE * F.col("total")).groupBy(
        "row_id", "template", "label").agg(F.max(F.col("weight") / F.col("total")).alias("share"))
    required = F.lit(True)
    for t, (_, _, phrases) in enumerate(TEMPLATES):
        for phrase in phrases:
            required = required & ((F.col("template") != t) | F.col("text").rlike(phrase_pattern(phrase)))
    texts = scanned.where("hits IS NOT NULL").select("row_id", "text")
    return shares.join(texts, "row_id").where(required).groupBy("row_id", "label").agg(F.max("share").alias("share"))


def _by_rarity():
    return Window.partitionBy("template").orderBy(F.desc("weight"), "word", "offset")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence facts of every document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are runs of letters, digits and non-ASCII characters, compared without the case of A-Z. ``n_base`` counts every place of a
    fixed phrase; ``labels`` adds the notices found by the index; ``score`` is 1 with a fixed phrase, else the best share of
    a notice, else 0. Null and empty texts have no words, no labels and score 0; repeated rows are answered one by one; an
    empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    scanned = index(docs, doc_id, text)
    found = notices(scanned).groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = F.coalesce("base", F.array().cast("array<struct<label:string,start:int>>"))
    own = F.array_distinct(base["label"])
    joined = scanned.join(found, "row_id", "left")
    return joined.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base["start"]).cast("bigint").alias("first_word"), F.array_max(base["start"]).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
