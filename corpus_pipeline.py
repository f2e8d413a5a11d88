"""A training corpus from ``documents``: five stages, each of one operator.

``run`` applies the stages in turn. Each writes its rows to the shared folder
and the next reads them, so a lost executor costs a task of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import minhash_dedup, mixing, packing, pii, toxicity
from lodestone.llm.common import table
from lodestone.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a lexicon learned from ``labels``; a tie with it goes.

    Null and empty texts have no hit and stay; repeated rows stay or go
    together; without labels, or with none of either kind, all stay. All
    columns, whatever their names, stay as they are.
    """
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts stay. Rows that share an id stay or go together. All
    columns, whatever their names, stay as they are.
    """
    return minhash_dedup.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of personal data become the name of their kind and ``n_chars`` follows.

    Null texts stay null, empty ones empty; a table without ``n_chars`` will do.
    """
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix of their sources.

    A null source is one of its own; null and repeated ids keep their places,
    and so do null and empty texts. All columns stay as they are; an empty
    table gives an empty one.
    """
    return mixing.laid_out(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence, with its token ids; partitions of sequences follow the mix.

    Null and empty texts are their end id alone; repeated rows are packed each
    by itself; an empty table gives no row.
    """
    return packing.pack(mixing.as_laid(docs), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned and hashed stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
