"""Article sources: corpora and text folders to article rows, validation, derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.schemas import ARTICLE


def read_articles(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Article records from Parquet or JSON files, always with the explicit schema."""
    return spark.read.schema(ARTICLE).format(format).load(path)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Map a corpus ``(doc_id, text, lang, source)`` to article rows."""
    doc = F.col("doc_id")
    published = F.lit(1704067200) + (doc * 37) % 43200 * 60  # from 2024-01-01 00:00 UTC, 30 days
    topic = F.array(F.struct(F.concat(F.lit("topic_"), F.col("lang")).alias("id"), F.col("lang").alias("name")))

    def tag(base: int, modulus: int):
        number = doc % modulus
        return F.struct((F.lit(base) + number).alias("id"), F.concat(F.lit("tag"), number.cast("string")).alias("name"))

    return documents.select(
        doc.cast("string").alias("article_id"),
        tx.derive_title(F.col("text"), doc.cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.timestamp_seconds(published).alias("publish_time"),
        "source",
        (doc % 3).cast("int").alias("state"),
        F.when(doc % 10 == 0, 1).otherwise(0).alias("top"),
        F.array(tag(1000, 7), tag(2000, 5)).alias("tags"),
        F.when(doc % 4 == 3, F.array().cast("array<struct<id:string,name:string>>")).otherwise(topic).alias("topic"),
        F.timestamp_seconds(published + 2).alias("created_at"),
        F.timestamp_seconds(published + 2).alias("updated_at"),
    )


def read_text_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A tree ``<folder>/doc_group<N>/<name>.txt`` as ``(article_id, group, title, content)``.

    Files of length 0 give no row: Spark does not read them.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(folder, wholetext=True)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    )
    group = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return files.where(F.regexp_extract("path", r"/(doc_group[^/]*)/[^/]+$", 1) != "").select(
        F.concat_ws("_", group, stem).alias("article_id"),
        group.alias("group"),
        tx.derive_title(F.col("content"), stem).alias("title"),
        "content",
    )


def with_id_lists(articles: DataFrame) -> DataFrame:
    """Add ``tag_ids`` and ``topic_ids``, the plain id lists that searches filter on."""
    return articles.withColumns(
        {
            "tag_ids": F.transform(F.coalesce("tags", F.array()), lambda t: t["id"].cast("string")),
            "topic_ids": F.transform(F.coalesce("topic", F.array()), lambda t: t["id"]),
        }
    )


def check_articles(articles: DataFrame) -> DataFrame:
    """Add ``reasons``, the list of rules a row breaks; empty for a valid row."""
    required = ["title", "content", "publish_time", "source", "state", "top"]
    rules = [(~tx.is_article_id(F.col("article_id")), "article_id")]
    rules += [(F.col(name).isNull(), f"{name}_missing") for name in required]
    rules += [
        (F.length("content") > tx.MAX_TEXT, "content_too_long"),
        (~F.col("state").between(0, 2), "state_range"),
        (~F.col("top").between(0, 1), "top_range"),
    ]
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))
    return articles.withColumn("reasons", reasons)


def validate_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejected rows with their ``reasons``."""
    checked = check_articles(articles)
    valid = checked.where(F.size("reasons") == 0).drop("reasons")
    return valid, checked.where(F.size("reasons") > 0)
