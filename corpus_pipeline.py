"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of ``docs``, whatever they are
called. ``run`` applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.llm import language_id, minhash_dedup, mixing, packing, toxicity
from telewarden.llm.queries import BYTE_VOCABULARY, PACKED_END_ID, SEQUENCE_TOKENS, table
from telewarden.session import cut_lineage

#: A text is taken to be in no known language if its best one has less than this share of its n-grams.
LEAST_LANGUAGE_SCORE = 0.2
#: Seed of the mix and of the order in which its copies are rounded.
MIX_SEED = 7


def _whole_row(docs: DataFrame) -> Column:
    """The row under one name, so that its columns never clash with an operator's."""
    return F.struct(*[F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns])


def _rows(found: DataFrame) -> DataFrame:
    return found.select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; a null or empty text and repeated rows are scored like others. Labels of all folds may be learned from.

    Where only one class is labelled, all documents are judged by its share; without labels, or without documents, nothing goes. Texts of any
    length are read whole.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return _rows(toxicity.score(docs, model, keep=_whole_row(docs)).where("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts, too), or in no language that the table names, go.

    Repeated rows are judged alike; if no row names a language, all stay, as an empty table does. Texts of any length are read whole.
    """
    model = language_id.fit(docs, F.lit(True))
    found = language_id.identify(docs, model, keep=_whole_row(docs))
    if not model.languages:
        return _rows(found)  # nothing to compare with
    return _rows(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id; of equal ids that of smallest text, once if rows repeat.

    All null texts stay; texts without words are near their equals only; an empty table stays empty. Texts of any length are compared whole.
    """
    decided = cut_lineage(minhash_dedup.near_duplicates(docs), "decided")
    kept = decided.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    once = kept.distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("id"), minhash_dedup.text_key().alias("key"), _whole_row(docs).alias("row"))
    stays = source.join(once, source["id"].eqNullSafe(once["kept_id"]) & source["key"].eqNullSafe(once["kept_key"]), "left_semi")
    if kept.count() == once.count():
        return _rows(stays)
    return _rows(stays.where("key is null").unionByName(stays.where("key is not null").dropDuplicates(["id", "key"])))  # a row is repeated


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words, rounded up or down along its source's streams.

    A null source is a source; texts without words are never taken; repeated rows count again; an empty table stays empty.
    """
    mixed = mixing.whole_copies(mixing.mix(docs, seed=MIX_SEED, row=_whole_row(docs)), MIX_SEED)
    return _rows(mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in the training sequences."""
    return packing.pack(docs, public_tokenizers.path(BYTE_VOCABULARY), PACKED_END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't state these stages; tests/llm compares their operators and the mix's copies with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
