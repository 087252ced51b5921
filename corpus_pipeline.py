"""A corpus made ready for training: toxic texts out, near duplicates out, benchmark texts
out, personal data redacted, and what is left packed into windows of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.llm.decontaminate import remove_contaminated
from rinseworks.llm.jaccard_join import one_per_component
from rinseworks.llm.learning import fold
from rinseworks.llm.pii import redact
from rinseworks.llm.queries import packed, table
from rinseworks.llm.toxicity import learn_lexicon, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon scores 0.5 or more; without text none is toxic."""
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return score_toxicity(docs, lexicon).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard of 0.8, whatever its key."""
    return one_per_component(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold at least half of a benchmark item's words in step."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text."""
    out = redact(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1,024 tokens."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: Learned scores, similarity components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
