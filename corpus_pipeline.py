"""A corpus pipeline over ``documents``; each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, langid, mixing, queries
from tallyforge.llm.exact_dedup import exact_dedup, text_sha256
from tallyforge.llm.ngram_join import ngram_join
from tallyforge.llm.stages import free_name, keep_rows
from tallyforge.storage import Scratch, passing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; text without a letter goes, and text far from all of them.

    The classifier is fitted on the documents' own labels, a bounded sample; close calls
    between two languages stay, as both are languages of the corpus.  Far is above a bound on
    the decoding's loss, learned from labelled texts; with labels of fewer than three languages
    there is no bound, and all text with a letter stays.
    """
    model = langid.train(docs.where(~langid.held_out("doc_id")), bound=True)
    names = tuple(free_name(docs, x) for x in ("lang_pred", "score", "ambiguous", "near"))
    return langid.predict(docs, model, names).where(names[3]).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, by the operator's rule; equal rows count once.

    Null texts are empty ones and so one group, null ids match null ids, an empty table stays empty, and other columns
    stay whatever their names.
    """
    found = exact_dedup(docs)
    return keep_rows(docs, found.where("kept").select("doc_id", "n_chars", "text_sha256"), text_sha256("text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id (null last) of each group that links of five-word shingles, 0.8 alike, join.

    Rows are told apart by a key of their own, written with them, so rows without a doc_id or
    with the same one go and stay by their texts.
    """
    key = free_name(docs, "key")
    keyed = Scratch(spark, "near").table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = ngram_join(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, num=80, den=100).withColumnRenamed("doc_id", key)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(key).alias("key"))
    ranked = found.select(key, "component_id").join(keyed.select(key, rank.alias("rank")).hint("merge"), key)
    stay = ranked.groupBy("component_id").agg(F.min("rank").alias("least")).select(F.col("least.key").alias(key))
    return keyed.join(stay.hint("merge"), key, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; texts without a doc_id draw on their own.

    A null text has size 0 and a null source is one; an empty table stays empty, and columns with the operator's names go.
    """
    drawn = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    return mixing.emit(mixing.mix(docs, key=drawn))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids of each row and the digest of what they decode to; the other columns end here.

    A null text has no tokens, rows that repeat stay, an empty table stays empty.
    """
    ids = bpe.encode(docs, *queries.byte_bpe(), decode=True)
    return ids.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mix_sources", mixture), ("byte_bpe", tokens)]

#: The classifier and the encoder have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage wrote on its way goes once its result is written, and a result once the next one is."""
    docs = queries.documents(spark, sf_dir)
    keep, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with passing():
            docs = keep.table(stage(spark, docs, sf_dir), name)
        if last:
            keep.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
