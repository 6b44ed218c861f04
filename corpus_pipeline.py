"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars) of the rows they keep; the
last returns the packed pieces. n_chars follows the text where a stage changes it.

Rows without text are rejected by the first stage. Each stage works on all rows that the one before kept; an empty table
passes through as one. Columns beside those of documents are left out, whatever their names. Rows that repeat a doc_id with the same text are the same document for the stages that keep one; rows that
share an id (or have none) but not the text are different documents, and each goes or stays by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from tidepool.llm._shared import ROW_KEY, row_key, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Stages on word shingles take five words; 80 % of them in common makes two documents copies of one.
SHINGLE, PERCENT = 5, 80
#: Members of a cell that are compared without further pivots; at 80 % most of a large cell is linked by a few pivots.
LEAF = 500
#: Keys of rows to leave out (32 bytes each) up to this many are sent to every executor.
BROADCAST_IDS = 2_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; the model learns from the labelled rows of the input. Without a labelled
    row nothing can be told apart and every text with a letter stays."""
    known = language_id.identify(docs, language_id.train(docs), carry=COLUMNS[1:])
    return known.where("accepted").select(*COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines, short ones where they repeat exactly; documents of which only blanks are left go."""
    cut = line_dedup.dedup_lines(docs, carry=("lang", "source"), exact_chars=1).where(F.col("kept_text").rlike(r"\S"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id (and text hashes, where ids repeat) of each class of near copies."""
    classes = jaccard_join.jaccard_classes(docs, shingle=SHINGLE, percent=PERCENT, leaf=LEAF)
    return _without(docs, classes.where(F.struct(*ROW_KEY) != F.col("first")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark passage."""
    return _without(docs, decontamination.overlapping_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_length=True))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose key is not one of rows; a bounded number of keys is sent to every executor, more meet them in a shuffle."""
    gone = written(rows.select(*(F.col(c).alias(f"_{c}") for c in ROW_KEY)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = [c == F.col(f"_{k}") for k, c in zip(ROW_KEY, row_key("doc_id", "text"), strict=True)]
    return docs.select(*COLUMNS).join(gone, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express the trained model, the edit join and the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
