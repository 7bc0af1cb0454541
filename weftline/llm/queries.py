"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.llm.decontaminate import LEAKS_SQL, contaminated_windows
from weftline.llm.hard_negatives import NEGATIVES_SQL, mined
from weftline.llm.hidden_markov import score_documents
from weftline.llm.html_text import extract
from weftline.llm.jaccard_join import JACCARD_SQL, jaccard_components
from weftline.llm.line_quality import QUALITY_SQL, line_quality
from weftline.llm.packing import pack
from weftline.llm.quality_fm import quality_scores
from weftline.llm.sanitise import PERSONAL_SQL, personal_spans
from weftline.llm.token_counts import token_counts
from weftline.llm.transcripts import recovered_turns
from weftline.llm.vector_codes import CODES_SQL, compressed
from weftline.llm.warc import ROUND_TRIP_SQL, round_trip

#: Name of the vocabulary file of op3; queries look its path up where they run.
VOCABULARY = "byte_bpe_50k.json"


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the line rules on every document; null texts fail, repeated rows each have theirs."""
    return line_quality(table(spark, sf_dir, "documents")).withColumn("n_removed_lines", F.size("removed").cast("long")).drop("removed")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into archives and resolved again; a null html is an empty payload."""
    return round_trip(table(spark, sf_dir, "pages"))


def op3_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document from its stored prefix table; null texts have none."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under the hidden Markov model; a null text is the end token alone."""
    return score_documents(table(spark, sf_dir, "documents"))


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for null and textless pages."""
    return extract(table(spark, sf_dir, "pages"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document; null texts have length 0."""
    return pack(table(spark, sf_dir, "documents"))


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered turns of every conversation; rows without conversation or turn number are left out."""
    return recovered_turns(table(spark, sf_dir, "conversations"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar window of every document and benchmark item that it leaks; null texts have none."""
    return contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document; null and empty texts link with nothing."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; null and empty texts have one too."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that give it away; a null text has none."""
    return personal_spans(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector; others are left out."""
    return compressed(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive; rows without id, label or a usable vector take no part."""
    return mined(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_line_frequency, op2_warc_revisits, op3_prefix_tokens, op4_hidden_markov, op5_line_blocks, op6_length_buckets, op7_transcripts, op8_decontaminate, op9_jaccard_groups, op10_factorisation_machine, op11_personal_data, op12_vector_codes, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": QUALITY_SQL, "op2_warc_revisits": ROUND_TRIP_SQL, "op8_decontaminate": LEAKS_SQL, "op9_jaccard_groups": JACCARD_SQL, "op11_personal_data": PERSONAL_SQL, "op12_vector_codes": CODES_SQL, "op13_hard_negatives": NEGATIVES_SQL}
