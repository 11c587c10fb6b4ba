"""The corpus pipeline: documents in, a cleaned and mixed corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm import decontaminate, linededup, mixing, neardup, toxicity
from telesift.llm.common import cut, packed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, with all their columns.

    Each row is judged for itself, so repeated rows stay or go together.  Null and empty texts have no features and stay;
    so does everything where labels lack one of the grades.  A null doc_id is no label, but its row is judged.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), split=True)
    return toxicity.score(packed(docs).select("_row", "_row.text"), model).where("p_toxic <= 0.5").select("_row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that they share with an earlier one; n_chars is counted again.

    Null and empty texts, rows with a null doc_id and rows that share a doc_id lose nothing.  A copy of an earlier
    document keeps its row, with an empty text.
    """
    out = linededup.dedup_lines(packed(docs).select("_row.doc_id", "_row.text", F.col("_row").alias("own")))
    own = {c: F.col("own")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(own["n_chars"])
    return out.select(*[x.alias(c) for c, x in own.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class, by the smallest doc_id, with all rows that have it.

    Documents without words are alike: of null, empty and wordless texts, those that line dedup has emptied among them,
    the first one stays.  Rows with a null doc_id are not judged and stay.
    """
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows share their fate; with an empty benchmark all stay.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken.

    Null and empty texts have size 0 and are not taken.  Null is a source of its own.  Rows equal in doc_id, text and
    source are taken or left together.  The result for an empty table is empty.
    """
    return mixing.mix(docs).where(F.col("copies") > 0)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("mix", mix_sources)]
#: The stages fit models and align texts, which SQL cannot say; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied in turn to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
