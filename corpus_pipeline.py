"""Corpus pipeline (counted as part of the training-data subpackage).

Language ID, near-duplicates, repeated passages, personal data, packing: each stage works on all
rows that its predecessor kept, is written as Parquet in the shared folder, and is read again. All
stages but the last return the columns of documents, whatever columns those are.

Defined results: null texts and texts without letters go with the first stage. Rows that repeat an id
and its text stay once; rows with a null id, or with one id and different texts, are documents of their
own, and of a group of near-duplicates without any id all stay. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import langid, minhash, packing, pii, repeats
from keyloom.llm.queries import END_ID, SEQUENCE, WORD_BPE
from keyloom.llm.runtime import Scratch, table

#: Score below which a document's language counts as unknown (with four languages, chance is 0.25).
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Null texts and texts without letters go; a null ``lang`` takes the prediction."""
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs, model)
    pred, score = out.columns[-2:]
    kept = out.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of 0.8 on five-word shingles); repeated rows stay once."""
    return minhash.keep_one(docs, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occur earlier; bytes of a character that is cut go with it."""
    done = repeats.remove_repeats(docs, as_text=True)
    return done.withColumn("text", F.col(done.columns[-4])).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    pieces = packing.token_pieces(docs, WORD_BPE, END_ID, SEQUENCE).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, SEQUENCE, ["doc_id", "start", "ids_crc32"])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        known = set(Scratch.roots)
        docs = scratch.save(stage(spark, docs, sf_dir))
        Scratch.forget(known)  # the stage's own tables have been read
        scratch.drop(before)
        before = docs
    return docs
