"""A corpus pipeline of five of the operators, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, near, packing, secrets
from tessera.llm.common import read, table
from tessera.ship import shipped

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if this share of its letters is in the language it is labelled with by the model.
LEAST_SHARE = 0.5


@shipped
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or holds less than half of their letters.

    Null and empty texts, and those without letters, are undetermined and go; long texts are labelled whole.
    Repeated rows are judged alike and stay or go together; an empty table gives an empty table.
    """
    docs = docs.select(*COLUMNS)
    model = language.learned(docs)
    found = language.label(docs, spark, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


@shipped
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least doc_id, of each group of near copies.

    Repeated rows are copies: one stays. Rows that share a doc_id but not their text are documents of their
    own. Rows without a doc_id, null and empty texts stay. An empty table gives an empty table.
    """
    return near.one_of_each(docs.select(*COLUMNS), spark, COLUMNS)


@shipped
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text.

    Null and empty texts have none and stay as they are; long texts are scanned whole; repeated rows give
    repeated rows, in one way; an empty table gives an empty table.
    """
    found = secrets.scan_secrets(docs.select(*COLUMNS), keep=COLUMNS)
    text = F.when(F.col("n_spans") > 0, F.col("redacted")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_spans") > 0, F.length("redacted")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"))


@shipped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it; those it takes no times go.

    A null or empty text has no words: it changes no sum and is repeated like others of its source. A null source
    is a source of its own. Rows of one doc_id are taken alike, those without one by source and text. An empty
    table gives an empty table.
    """
    return mixing.repeated(docs.select(*COLUMNS), spark)


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of at most 4096 tokens: a row for each piece, with its ids.

    A null or empty text is its end token alone; a long text is cut into pieces; repeated rows are packed each
    by itself; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", by_language),
    ("near copies", without_copies),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pack", packed),
]
#: No SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
