"""Explicit schemas of the article and cluster tables; nothing is inferred."""

from pyspark.sql import types as T

TAG = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
TOPIC = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

# What a producer sends.
ARTICLE = T.StructType(
    [
        T.StructField("article_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("publish_time", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("state", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("tags", T.ArrayType(TAG)),
        T.StructField("topic", T.ArrayType(TOPIC)),
    ]
)

# What the engine keeps once an article has gone through clustering.
STORED_ARTICLE = T.StructType(
    ARTICLE.fields
    + [
        T.StructField("tag_ids", T.ArrayType(T.StringType())),
        T.StructField("topic_ids", T.ArrayType(T.StringType())),
        T.StructField("simhash", T.StringType()),
        T.StructField("minhash_signature", T.ArrayType(T.StringType())),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("cluster_status", T.StringType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# One record per cluster; its members are rows of the article table.
CLUSTER = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("representative_article_id", T.StringType()),
        T.StructField("top_terms", T.ArrayType(TERM)),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
