"""A training-data pipeline: quality rules, line dedup, near-duplicates, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents;
the last returns tokens. Stages are written to the shared folder, so that a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import Written
from cohortry.llm.line_dedup import drop_common_lines
from cohortry.llm.mixing import mix
from cohortry.llm.ngram_join import ngram_classes
from cohortry.llm.pieces import encode
from cohortry.llm.quality import BASE_RULES, Rule, quality_cascade
from cohortry.llm.queries import piece_table

#: Fewer words tell nothing; the other rule of the base is taken as it is.
MIN_WORDS = 3
FIRST_RULES = (Rule("too_short", lambda t: t.n_words < MIN_WORDS), *(r for r in BASE_RULES if r.name != "too_short"))
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A short text is no junk: of the base the stage takes repetition, and asks for a few words only.

    Null and empty texts have no words and go; so do all copies of a text that is rejected, as repeated rows get equal verdicts. Null ids
    are judged like others, very long texts whole. A text exactly at a rule's bound stays. An empty table gives an empty one; other columns than ``COLUMNS`` are left out,
    so that their names do not matter.
    """
    return quality_cascade(docs, first=FIRST_RULES, keep=COLUMNS, measures=False).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more hold; ``n_chars`` follows the text.

    No row goes: a text all of whose lines go, and a null one, become empty. Rows of one id are one document, rows without an id
    count as none but lose lines as well. Lines that ten documents hold exactly go. Very long texts are read whole; an empty table gives an
    empty one. Other columns than ``COLUMNS`` are left out, so that their names do not matter.
    """
    got = drop_common_lines(docs.select(*COLUMNS))
    return got.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id, once.

    A document is an id with a text, so that rows without an id, and different texts of one id, are told apart; rows with
    an id come before those without. Of rows equal in both one stays. Texts without words link with nothing and stay, null ones too;
    pairs at the threshold itself are near-duplicates. Very long texts are compared whole; an empty table gives an empty one. Other columns than ``COLUMNS`` are
    left out, so that their names do not matter.
    """
    # cast to what it is read back as, so that texts are dealt by it once
    kind = f"struct<none:boolean,doc_id:{docs.schema['doc_id'].dataType.simpleString()},text:bigint>"
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")).cast(kind).alias("key")
    keyed = docs.select(*COLUMNS, key)
    first = ngram_classes(keyed, id_col="key").where("key = component_id").select("key").distinct()
    # keys of the documents that stay, of some bytes each, against their texts: hashed, so that texts are not sorted
    kept = keyed.join(first.hint("shuffle_hash"), "key", "left_semi")
    return kept.dropDuplicates(["key"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics are raked to tempered shares.

    Null sources and languages are values like others. Texts without words take their cell's probability, or 1 in a cell without any.
    Repeated rows are drawn alike, rows without an id by their text. A draw equal to the probability does not take the document. Very long texts count by all their words. An empty
    table gives an empty one; other columns than ``COLUMNS`` are left out, so that their names do not matter.
    """
    return mix(docs.select(*COLUMNS)).where("sampled").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of pieces of each document: ``doc_id``, ``n_tokens``, ``ids``. Null and empty texts have none; null ids and repeated rows stay; an empty table
    gives an empty one. Paths of equal scores are told apart as the format's library does. Very long texts are encoded whole. Other columns are not read, so that their names do not
    matter."""
    return encode(docs, piece_table())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL cannot express n-gram classes and segmentation; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), "stage").df
    return STAGES[-1][1](spark, docs, sf_dir)
