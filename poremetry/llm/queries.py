"""Queries of the language-model operators over the driver tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from poremetry.llm import (
    bpe, chat_quotes, decontaminate, html_extract, language_id, licenses, ngram_join, quality_classifier, quality_rules, suffix_dedup,
    token_alignment, url_filters, whitening)
from poremetry.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op2_html_extract(spark, folder):
    return html_extract.extract(table(spark, folder, "pages"))


@query
def op3_ngram_jaccard(spark, folder):
    return ngram_join.join(table(spark, folder, "documents"))


@query
def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@query
def op5_bpe(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_chat_format(spark, folder):
    return chat_quotes.format_chats(table(spark, folder, "conversations"))


@query
def op7_quality_rules(spark, folder):
    return quality_rules.judge(table(spark, folder, "documents"))


@query
def op8_url_filter(spark, folder):
    return url_filters.judge(table(spark, folder, "pages"))


@query
def op9_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, folder, "labels")))


@query
def op10_decontaminate(spark, folder):
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_token_alignment(spark, folder):
    return token_alignment.align(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_suffix_dedup(spark, folder):
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
