"""From raw documents to token ids: five stages, each one operator of `ipvigil.llm`, each written and read again.

Every stage takes and returns the columns of `documents`, but for the last, which returns the encoded documents. Rows,
extra columns and nulls are handled as the operators' modules say.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ipvigil.llm import alike, decontaminate, lines, pieces, simhash, toxicity
from ipvigil.llm.frames import cut_lineage, free_name, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (8): documents scored 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (1): later copies of runs of lines, and of one or two lines of over 50 words, are deleted; documents left
    without a line go."""
    return lines.dedup_lines(docs, words=lines.WORDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (10): the document with the smallest doc_id of each group stays; texts whose five-word shingles have
    a Jaccard similarity of 0.8 are linked, and so are fingerprints that differ in three bits."""
    return simhash.one_per_group(docs, alike.SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (6): ids instead of the text, and whether they decode to it."""
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    made = pieces.encoded(docs, pieces.model_bytes(), keep)
    ids = made.columns[len(keep)]
    return made.withColumn(free_name(made, "n_tokens"), F.size(ids))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_passages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Trees, suffix arrays and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
