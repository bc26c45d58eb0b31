"""A corpus pipeline of training-data operators over ``documents``, from raw texts to token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versetime.llm.common import read_table, rolling
from versetime.llm.decontaminate import clean
from versetime.llm.jaccard import deduplicated_by_jaccard
from versetime.llm.language import identify, train
from versetime.llm.mixing import mix
from versetime.llm.queries import DOMAIN, LANGUAGES, WEIGHTS, packed_tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the corpus; the rest, such as other languages and texts without letters, go.

    Null, empty and wordless texts go; null languages and sources are no evidence; repeated rows and null ids are judged
    row by row; other columns stay as they are; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    found = identify(rows, train(docs, LANGUAGES), text=F.col("text"), declared=F.col("lang"), host=F.col("source"), keep=["row"], stage_rows=False)
    return found.where("accepted").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 5-word shingles of 0.8 or more links.

    Links come from SimHash fingerprints in the vantage-point tree of operator 1, and a complete search among prefixes for
    those whose fingerprints are further apart; each is verified.
    """
    return deduplicated_by_jaccard(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay, as do null ids; each repeated row is judged alike; null or empty items are
    in no document; other columns stay as they are; an empty table, or benchmark, takes nothing away.
    """
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of the target weights with four fifths of the tokens, each document once at most.

    Null languages and sources are ``und`` and ``unknown``; null texts have no tokens; ties of the seeded order go by id
    and tokens; repeated rows each count; null ids are ordered by their text; other columns stay as they are; an empty
    table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    return mix(rows, F.expr(DOMAIN), WEIGHTS, budget_percent=80, max_epochs=1, keep=["row"], stage_rows=False).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files of the mixture, as read back: ``(doc_id, start, n_tokens, ids_crc32)`` of each row.

    Null and empty texts are one end id; null ids come first; repeated rows and ties are each written; other columns are
    not read; an empty table gives no rows.
    """
    return packed_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL cannot express the fingerprints, the trained model or the tokenizer; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's table goes when the next one's is written."""
    docs, stage_table = read_table(spark, sf_dir, "documents"), rolling(spark)
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
