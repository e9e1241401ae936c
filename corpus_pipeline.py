"""From raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of ``documents``.

What every stage does with odd rows: further columns, clashing names too, are carried by all stages but the last; an empty table stays
empty; very long texts are worked on whole. Null and empty texts: scored as texts without words by the classifier; copies of each other
in near-dedup; without leaks and personal data; the end id alone in packing. Null doc_ids are kept, and in near-dedup are
the last of a group to stay. Of repeated rows one stays after near-dedup, the least doc_id of each group; ties go to the least hash of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import decontamination, packing, quality_model, simhash_dedup, surrogates
from folioforge.llm.common import cut, table
from folioforge.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    return simhash_dedup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return surrogates.pseudonymised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", distinct_texts),
    ("benchmark decontamination", decontaminated),
    ("PII surrogates", without_personal_data),
    ("packing", packed),
]

#: No SQL for the classifier, the union of near-duplicates or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
