"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing of ``documents``, in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.langid import UNDETERMINED, with_language
from wattline.llm.linededup import remove_repeated_lines
from wattline.llm.mixing import mixed
from wattline.llm.neardup import keep_one_of_each
from wattline.llm.packing import pack_by_powers_of_two
from wattline.llm.runtime import documents, rewritten, spare
from wattline.llm.slots import with_layout

#: Settings of ``schedule_mix``, such as the sources' target weights.
MIXTURE: dict = {}

#: A document stays in the language stage if its language is likelier than all others together.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: those whose posterior is below ``LEAST_SCORE`` go, and those without a letter.

    Null and empty texts have no letter. Where no language could be learned, all
    texts with letters stay. Repeated rows are judged alike; an empty table gives
    no rows; a very long text counts whole; other columns pass through.
    """
    (own,) = spare([*docs.columns, "lang_pred", "score", "has_letters"], "_row")
    told = with_language(docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own)))
    stays = F.col("has_letters") & ((F.col("lang_pred") == UNDETERMINED) | (F.col("score") >= LEAST_SCORE))
    return told.where(stays).select(f"{own}.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one; odd rows as in ``remove_repeated_lines``."""
    (own,) = spare(docs.columns, "_removed")  # a column of that name is not the operator's
    out = remove_repeated_lines(docs.withColumnRenamed("removed", own)).drop("removed").withColumnRenamed(own, "removed")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; odd rows as in ``keep_one_of_each``."""
    return keep_one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order that keeps the sources at their target weights; odd rows as in ``schedule_mix``."""
    return mixed(docs, **MIXTURE)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, one sequence each, in buckets of equal length, within a bucket in the order in which the documents lie.

    That is the order of the files that the stage before has written, the
    mixture. Odd rows are packed as ``pack_by_powers_of_two`` says.
    """
    (place,) = spare(docs.columns, "_place")
    placed, places = with_layout(docs, place)
    return pack_by_powers_of_two(placed, position=place, positions=places)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Similarity joins and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what each returns is written to the shared folder and read again for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
