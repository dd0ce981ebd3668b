"""Quality rules whose limits come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poremetry.llm.common import let, words_of
from poremetry.workspace import materialize

SPACE = r"[\x20\x09-\x0D]"
# Measures with an upper limit, and how many single occurrences are no evidence whatever the limit: two symbols, duplicate lines or capitals, one
# repeated window of three words.
OCCURRENCES = {"symbols": ("n_symbols", 2), "dup_lines": ("n_dup_lines", 2), "repeats": ("n_repeat_words", 6), "capitals": ("n_capitals", 2)}
# A limit lies this many times the distance from the median to the upper decile above the median.
SPREADS = 6
# The mean word length may lie this many times below the lower or above the upper quartile of its kind.
LENGTH_TIMES = 2
# A language and source counts against its language, and a language against all documents, as its own documents against this many.
PRIOR_DOCS = 20
EXACT_BINS = 64  # values below have a bin of their own; above, a bin is at most 1/32 wide


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that stand in the text at least twice."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda p, k: F.coalesce(p["h"] == F.get(s, k)["h"], F.lit(False))
            return F.sort_array(F.filter(
                F.transform(s, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])), lambda i: i.isNotNull()))

        total = lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ranked, starts), total))

    return F.coalesce(let(windows, covered), F.lit(0)).cast("bigint")


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Written table of counts, one row per document, computed row by row without a shuffle."""
    content = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length(content) - F.length(F.regexp_replace(content, pattern, ""))
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    duplicates = let(lines, lambda ls: F.struct(
        F.size(ls).cast("bigint").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dup")))
    words = let(words_of(F.col(text), SPACE), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("repeats")))
    counted = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), words.alias("w"), duplicates.alias("l"),
        F.length(F.regexp_replace(content, f"{SPACE}+", "")).cast("bigint").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("bigint").alias("n_symbols"), without("[A-Z]+").cast("bigint").alias("n_capitals"))
    kind = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rate = lambda part, whole: F.coalesce(F.expr(f"{part} div nullif({whole}, 0)"), F.lit(0)).cast("bigint")
    flat = counted.select(
        "doc_id", kind("lang").alias("lang"), kind("source").alias("source"), F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.dup").alias("n_dup_lines"), F.col("w.repeats").alias("n_repeat_words"), "n_capitals", F.col("l.n").alias("n_lines"))
    return materialize(flat.select(
        *flat.columns, rate("1000 * n_symbols", "n_words").alias("symbols"), rate("1000 * n_dup_lines", "n_lines").alias("dup_lines"),
        rate("1000 * n_repeat_words", "n_words").alias("repeats"), rate("1000 * n_capitals", "word_chars").alias("capitals"),
        rate("100 * word_chars", "n_words").alias("length")))


def bin_of(value: Column) -> Column:
    """Lower edge of the sketch bin of a non-negative integer: its six leading binary digits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): histogram sketches of every measure per language and source.

    Sketches of two parts of the data, or of two kinds, are merged by adding the counts of equal bins. A sketch has at most
    64 + 32 * 58 bins whatever the number of documents; tasks add up their own counts before anything is shuffled.
    """
    names = [*OCCURRENCES, "length"]
    values = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in names])
    return measured.select("lang", "source", F.inline(values)).groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def limits(sketched: DataFrame) -> DataFrame:
    """(lang, source, n_docs, limits): limits of every kind, of every language (source null) and of all documents (both null), each from its own sketch."""
    nothing = F.lit(None).cast("string")
    of_langs = sketched.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")).withColumn("source", nothing)
    of_all = sketched.groupBy("measure", "bin").agg(F.sum("n").alias("n")).withColumns({"lang": nothing, "source": nothing})
    wide = sketched.unionByName(of_langs).unionByName(of_all)
    kind = Window.partitionBy("lang", "source", "measure")
    ranked = wide.select("*", F.sum("n").over(kind.orderBy("bin")).alias("upto"), F.sum("n").over(kind).alias("total"))
    quantile = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bin")))
    per_measure = ranked.groupBy("lang", "source", "measure").agg(
        *[quantile(p).alias(f"q{p}") for p in (25, 50, 75, 90)], F.max("total").alias("total"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return per_measure.groupBy("lang", "source").agg(F.max("total").alias("n_docs"), F.struct(
        *[(of(m, "q50") + SPREADS * (of(m, "q90") - of(m, "q50"))).alias(m) for m in OCCURRENCES],
        F.expr(f"max(CASE WHEN measure = 'length' THEN q25 END) div {LENGTH_TIMES}").alias("shortest"),
        (LENGTH_TIMES * of("length", "q75")).alias("longest")).alias("limits"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    Words are runs without ASCII white space. A document is kept if it passes the base rule (50 words at least, at most half of
    them in repeated windows) and stays within the limits of its language and source, which are read off the sketches of all
    documents: no measure has a fixed cutoff. Limits of small kinds lean on their language and those of small languages on all documents, by the number
    of documents. Null or empty text has no words and fails the base rule; null languages and sources are kinds of
    their own; repeated rows are judged one by one; an empty table gives an empty result; further columns are ignored.
    """
    measured = measures(docs, doc_id, text, lang, source)
    found = materialize(limits(materialize(sketches(measured))))
    names = [*OCCURRENCES, "shortest", "longest"]
    level = lambda where, *keys: found.where(where).select(*keys, F.col("n_docs").alias("n"), F.col("limits"))

    def leaning(own: DataFrame, wider: DataFrame, on) -> DataFrame:
        """Limits of ``own`` drawn towards those of ``wider``, as whole numbers."""
        both = own.join(wider.select(*[c for c in wider.columns if c == "lang"], F.col("limits").alias("wider")), on, "left")
        mixed = [F.expr(f"(n * limits.{m} + {PRIOR_DOCS} * wider.{m}) div (n + {PRIOR_DOCS})").alias(m) for m in names]
        return both.withColumn("limits", F.struct(*mixed)).drop("wider")

    # one row for all documents, one for every language
    of_lang = materialize(leaning(level("lang IS NOT NULL AND source IS NULL", "lang"), F.broadcast(level("lang IS NULL")), F.lit(True)))
    own = level("source IS NOT NULL", "lang", "source")
    chosen = materialize(leaning(own, of_lang, "lang").select("lang", "source", F.col("limits").alias("limit")))
    within = F.col("length").between(F.col("limit.shortest"), F.col("limit.longest"))
    for m, (count, few) in OCCURRENCES.items():
        within = within & ((F.col(m) <= F.col("limit")[m]) | (F.col(count) <= few))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(chosen, ["lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & within).alias("kept"))
