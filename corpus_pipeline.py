"""A corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut, the rest is packed.

Each stage takes and returns documents (``doc_id, text, lang, source, n_chars``); the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelsift.llm import common, jaccard, packing, substrings, toxicity

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the lexicon is learned from the labelled documents that are not held out."""
    labels = common.table(spark, sf_dir, "labels")
    scored = toxicity.measure(docs, toxicity.learn_from_tables(docs, labels), keep=DOCUMENT)
    return scored.where("score < 0.5").select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    classes, _ = jaccard.join(docs, n=5, num=80, den=100)
    gone = common.settled(classes.where("doc_id <> component_id").select("doc_id"), "gone")
    return common.rows_of(docs.select(*DOCUMENT), gone, without=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that also start in a document with a smaller id."""
    return substrings.without_repeats(docs.select(*DOCUMENT), length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, "word_bpe_49k.json", end_id=1)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack_sequences)]

#: No stage but the packing of equal lengths could be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.table(spark, sf_dir, "documents").select(*DOCUMENT)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = common.settled(out, name)
    return out
