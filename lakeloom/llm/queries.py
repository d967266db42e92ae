"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from lakeloom.llm import bpe, chat, decontaminate, html, licenses, lines, media, quality, simhash, suffixes

#: Name of the vocabulary file in the folder of public tokenizers.
BPE_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(BPE_FILE))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labels that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.classify(documents, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), bpe_path())


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV payload, with digests of what is read back and its spectral fingerprint."""
    return media.digests(table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, or nearly repeat, a line that stays."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of every document and the least document that links of at most four bits reach."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(rows.unionByName(extra)))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and declarations in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item and the place."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 200-byte strings that start anywhere else too."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_media": op3_media,
    "op4_lines": op4_lines,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_licenses": op7_licenses,
    "op8_decontaminate": op8_decontaminate,
    "op9_html": op9_html,
    "op10_suffixes": op10_suffixes,
}

SQL: dict[str, str] = {}
