"""The corpus pipeline: toxicity, line, near-duplicate and passage removal, then packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all
but the last return the columns of ``documents``. ``run`` applies them in memory,
a caller may also write each stage's result and read it again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.line_dedup import drop_boilerplate
from attesta.llm.prob_minhash import BROADCAST_IDS, near_duplicate_documents
from attesta.llm.queries import packed_digest
from attesta.llm.session import cut, table
from attesta.llm.suffix_dedup import remove_repeats
from attesta.llm.toxicity_chain import drop_toxic, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain trained on the labelled ones rejects go; texts stay as they are."""
    docs = docs.select(COLUMNS)
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; every document stays."""
    return _with_text(drop_boilerplate(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    gone = cut(near_duplicate_documents(docs).where("not kept").select("doc_id"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has go; every document stays. A character cut in two goes whole."""
    left = remove_repeats(docs, carry=["lang", "source"], whole_characters=True)
    return _with_text(left.select("doc_id", F.decode("kept", "UTF-8").alias("text"), "rest.lang", "rest.source"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packed_digest(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("minhash_dedup", remove_near_duplicates),
    ("suffix_dedup", remove_passages),
    ("packing", pack_sequences),
]
#: A trained classifier and hashing are among the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
