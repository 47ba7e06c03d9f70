"""Article features: one fingerprint row per article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import fingerprints as fp
from twinfold.functions import similarity as sim
from twinfold.functions import text as tx
from twinfold.params import DEFAULT, Params


def with_normalized(articles: DataFrame) -> DataFrame:
    return articles.withColumn("normalized", tx.normalize_text(tx.full_text()))


def extract_features(articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Articles without their text, plus ``text_key, simhash, n_shingles, buckets, sketch``.

    ``simhash`` is a signed 64-bit number, ``buckets`` the 20 (band, hash) numbers,
    ``text_key`` the md5 of the normalised text; ``sketch`` bounds what two texts have in common. No shuffle.
    """
    keep = [c for c in articles.columns if c not in ("title", "content")]
    rows = with_normalized(articles).select(
        *keep, "title",
        F.unhex(F.md5("normalized")).alias("text_key"),
        fp.fingerprint(F.col("normalized"), params).alias("f"),
    )
    return rows.select(*keep, "title", "text_key", "f.simhash", "f.n_shingles", "f.buckets", "f.sketch")


def public_features(features: DataFrame) -> DataFrame:
    """Fingerprints in the stored form: 16 hex digits, and 8 hex digits per band."""
    return features.withColumns(
        {
            "simhash": sim.simhash_hex(F.col("simhash")),
            "minhash_signature": F.transform("buckets", sim.band_hex),
        }
    ).drop("buckets", "text_key", "sketch")


def text_groups(features: DataFrame) -> DataFrame:
    """One row per distinct text: its smallest article id, copy count and fingerprint.

    Copies share every fingerprint, so all later pair work runs on distinct texts.
    The minimum is combined before the shuffle, so a text with very many copies is cheap.
    """
    first = F.min(F.struct("article_id", "simhash", "n_shingles", "buckets", "sketch")).alias("first")
    return (
        features.groupBy("text_key")
        .agg(first, F.count("*").alias("copies"))
        .select("text_key", "first.*", "copies")
    )


def simhash_groups(texts: DataFrame) -> DataFrame:
    """One row per SimHash value: smallest article id, number of articles and of distinct texts."""
    return texts.groupBy("simhash").agg(
        F.min("article_id").alias("root"),
        F.sum("copies").alias("articles"),
        F.count("*").alias("texts"),
    )
