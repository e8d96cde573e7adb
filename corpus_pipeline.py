"""Corpus pipeline: quality filter, near-duplicate removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows to the
shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekrank.llm import catalog, common, jaccard, packing, pseudonyms, quality
from seekrank.session import ship_package
from seekrank.sources.tables import load

#: A document is rejected when its score lies below this: lower than one half, so that doubtful documents stay.
LEAST_QUALITY = 0.3
#: Near-duplicates: word shingles of this length, of this similarity (a fraction).
SHINGLE, SIMILAR = 5, (80, 100)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; fitted on the labelled rows among ``docs``."""
    ship_package(spark)
    model = quality.fit(docs, load(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs.select(*COLUMNS), model, LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id, and of its texts the one with the least key.

    Texts are told apart by (doc_id, text key): different texts under one doc_id
    are documents of their own. Texts without words are no one's near-duplicate;
    of rows alike in doc_id and text the least by the other columns stays. Rows
    without doc_id stay.
    """
    ship_package(spark)
    groups = jaccard.rooted(docs, SHINGLE, *SIMILAR).filter("doc_id is not null")
    first = groups.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.*")
    stay = first.unionByName(groups.filter("n_shingles = 0").select("doc_id", "text_key"))
    docs = docs.select(*COLUMNS)
    kept = docs.withColumn("text_key", jaccard.text_key()).join(stay, ["doc_id", "text_key"], "left_semi")
    least = F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")
    return kept.groupBy("doc_id", "text_key").agg(least).select("doc_id", "row.*").select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced by pseudonyms of their format; n_chars follows the new text."""
    ship_package(spark)
    rows = pseudonyms.pseudonymise(docs.select(*COLUMNS), catalog.DEMO_KEY, found=None)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document as pieces of packed sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path(catalog.WORD_TOKENIZER), end_id=0, capacity=2048)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
