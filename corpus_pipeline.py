"""A corpus pipeline over ``documents``: toxic documents go, repeated lines go, near copies go, sources are mixed, texts are encoded."""

import public_tokenizers
from pyspark.sql import functions as F

from quadrat.llm import common, linededup, mixing, pieces, simhash, toxicity

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark, docs, sf_dir):
    """Documents that the machine, fitted on ``labels``, scores below 0.5."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark, docs, sf_dir):
    """All documents, without the later occurrences of three-line windows; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; the smallest id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """The mix: each document as often as its source's target has it."""
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """Ids, their number and the decoded text of each row of the mix."""
    return pieces.encode(docs, public_tokenizers.path(PIECES)).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mixing", mix_sources), ("encoding", encode)]

ORACLE_SQL = None  # the machine, XXH64 shingles and the tokenizer are beyond SQL; tests hold each stage to a brute-force version


def run(spark, sf_dir):
    """All stages over documents, one after another, each over the table that the one before wrote.

    Tables are in the shared folder; one that the next stage no longer needs is deleted. The last stage
    is returned as it is, to be computed by its reader.
    """
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs, path = common.written(docs)
            if done:
                common.remove(spark, done)
            done = path
    return docs
