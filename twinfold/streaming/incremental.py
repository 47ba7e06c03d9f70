"""Incremental clustering: each micro-batch is clustered against everything stored before.

State is a folder of append-only tables, one ``batch=<id>`` partition per batch:

  articles  new articles with text          updates  changed fields of known articles
  features  fingerprint and first label     texts    texts not seen before, with buckets and sketch
  scores    similarity scores               aliases  labels that were merged into another
  rejects   invalid rows with their reasons

A score holds for the label it names, or for good if it names none (equal SimHash): a batch scores
its own articles and those of clusters that it merged into another. A label is the smallest article id of a component when the row was written;
``aliases`` maps it to the present one, so merging two clusters of any size costs a
few alias rows. Batch k reads partitions below k only and overwrites its own, so a
replayed batch gives the same state. Matches may reach back without limit, hence
state lives in tables and not behind a watermark.

What a batch needs of earlier ones it finds by key in ``index`` (see ``key_index``), so the stored files that it opens
grow with its matches and not with the history; only filters (two to four bytes per key) and ``aliases`` (a row per merged
label) are read whole. Texts are read from the batches that hold a candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinfold.operators import candidates as cand
from twinfold.operators.clusters import cluster_name, verified_edges
from twinfold.operators.components import connected_components
from twinfold.operators.features import extract_features, text_groups
from twinfold.operators.joins import join_groups, keep_ids
from twinfold.params import DEFAULT, Params
from twinfold.schemas import ARTICLE
from twinfold.session import materialize, scratch
from twinfold.sources.articles import validate_articles
from twinfold.sources.tables import latest_per_key
from twinfold.streaming.key_index import KeyIndex, key_hash


def _columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in types.items()])


_ID, _LONG = T.StringType(), T.LongType()
TABLES = {
    "articles": ARTICLE,
    "updates": ARTICLE,
    "features": _columns(article_id=_ID, simhash=_LONG, label=_ID),
    "texts": _columns(
        article_id=_ID, text_key=T.BinaryType(), simhash=_LONG, n_shingles=T.IntegerType(), buckets=T.ArrayType(_LONG),
        sketch=T.BinaryType(),  # null in a state from before sketches were kept
    ),
    "scores": _columns(article_id=_ID, label=_ID, score=T.DoubleType()),
    "aliases": _columns(label=_ID, present=_ID),
    "rejects": T.StructType([*ARTICLE.fields, T.StructField("reasons", T.ArrayType(T.StringType()))]),
}
# What the index keeps of a batch, by kind of row: ``article`` and ``label`` (an article by id and by first label),
# ``simhash`` (the articles of a value), ``text`` and ``bucket`` (a text not seen before), ``settled`` (a score for good).
INDEXED = _columns(
    article_id=_ID, label=_ID, simhash=_LONG, articles=_LONG, text_key=T.BinaryType(), bucket=_LONG, n_shingles=T.IntegerType()
)


class IncrementalClusters:
    """Clusters that grow with every batch of articles."""

    def __init__(self, spark: SparkSession, path: str, params: Params = DEFAULT):
        self.spark, self.path, self.params = spark, path.rstrip("/"), params
        for name, schema in TABLES.items():  # an empty first partition, so that every table can be read
            spark.createDataFrame([], schema).write.mode("ignore").parquet(self._folder(name, -1))
        self.index = KeyIndex(spark, f"{self.path}/index", INDEXED)
        runs = self.index.runs()
        for batch in self._finished():  # of a state without an index, or of a job that died before its last step
            if not any(run.first <= batch <= run.last for run in runs):
                self._index(batch)

    def _finished(self) -> list[int]:
        """The batches whose tables are all written; ``texts`` is the last one."""
        context = self.spark.sparkContext
        done = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/texts/batch=*/_SUCCESS")
        found = done.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(done) or []
        return sorted(b for b in (int(s.getPath().getParent().getName().split("=")[1]) for s in found) if b >= 0)

    def _index(self, batch: int) -> None:
        """Add the stored rows of a batch to the index."""
        features, texts, scores = (
            self.spark.read.schema(TABLES[name]).parquet(self._folder(name, batch)) for name in ("features", "texts", "scores")
        )
        values = features.groupBy("simhash").agg(
            F.count("*").alias("articles"), F.min("article_id").alias("article_id"), F.min("label").alias("label")
        )
        kinds = [
            ("article", "article_id", features), ("label", "label", features), ("simhash", "simhash", values),
            ("text", "text_key", texts.select("text_key")),
            ("bucket", "bucket", cand.bucket_rows(texts)),
            ("settled", "article_id", scores.where("label IS NULL").select("article_id")),
        ]
        none = self.spark.createDataFrame([], INDEXED)
        for kind, key, rows in kinds:
            none = none.unionByName(rows.select(F.lit(kind).alias("kind"), key_hash(kind, key), *rows.columns), allowMissingColumns=True)
        self.index.add(none, batch)

    def _find(self, kind: str, keys: DataFrame, batch: int) -> DataFrame:
        """What earlier batches hold of one kind under the values of the only column of ``keys``, stored."""
        [key] = keys.columns
        return self.index.find(keys.select(key_hash(kind, key)), batch).where(F.col("kind") == kind)

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _write(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        schema = TABLES[name]
        rows.select(*schema.names).write.mode("overwrite").parquet(self._folder(name, batch))
        return self.spark.read.schema(schema).parquet(self._folder(name, batch))

    def table(self, name: str, before: int | None = None) -> DataFrame:
        schema = T.StructType([*TABLES[name].fields, T.StructField("batch", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _present(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Replace ``label`` by the present label."""
        aliases = latest_per_key(self.table("aliases", before), "label", [F.desc("batch")]).drop("batch")
        return rows.join(aliases, "label", "left").withColumn("label", F.coalesce("present", "label")).drop("present")

    def apply(self, incoming: DataFrame, batch: int) -> None:
        """Cluster one batch; the last copy of a repeated id counts."""
        with scratch(self.spark):
            self._apply(incoming, batch)

    def _apply(self, incoming: DataFrame, batch: int) -> None:
        valid, rejected = validate_articles(incoming.select(*ARTICLE.names))
        self._write("rejects", batch, rejected)
        order = [F.desc("publish_time"), F.xxhash64("title", "content")]
        latest = materialize(latest_per_key(valid, "article_id", order))
        known = materialize(self._find("article", latest.select("article_id"), batch).select("article_id"))
        self._write("updates", batch, keep_ids(latest, known))
        articles = self._write("articles", batch, latest.join(known, "article_id", "left_anti"))

        features = materialize(
            extract_features(articles, self.params).select("article_id", "text_key", "simhash", "n_shingles", "buckets", "sketch")
        )
        texts = materialize(text_groups(features))
        groups = materialize(
            texts.groupBy("simhash").agg(F.min("article_id").alias("root"), F.sum("copies").alias("articles"))
        )
        buckets = materialize(cand.bucket_rows(texts).select("bucket").distinct())
        asked = groups.select(key_hash("simhash", "simhash")).union(texts.select(key_hash("text", "text_key")))
        hits = self.index.find(asked.union(buckets.select(key_hash("bucket", "bucket"))), batch)
        earlier = self._earlier(hits.where("kind = 'simhash'"), batch)
        old_rows = keep_ids(hits.where("kind = 'bucket'"), buckets, "bucket")
        old_rows = materialize(old_rows.select("bucket", "article_id", "simhash", "n_shingles", F.lit(False).alias("fresh"), "batch"))
        old = self._find("article", old_rows.select("article_id").distinct(), batch).select("article_id", "label")
        old = materialize(self._present(old, batch))
        edges = self._edges(texts, articles, old_rows, old, batch)
        self._label(features, groups, earlier, edges, old, batch)
        seen = materialize(hits.where("kind = 'text'").select("text_key"))
        self._write("texts", batch, texts.join(seen, "text_key", "left_anti"))
        self._index(batch)

    def _earlier(self, hits: DataFrame, batch: int) -> DataFrame:
        """Stored articles with a SimHash of this batch: count, smallest id, present label."""
        hits = hits.groupBy("simhash").agg(
            F.sum("articles").alias("stored"), F.min("article_id").alias("stored_id"), F.min("label").alias("label")
        )
        return materialize(self._present(hits, batch))

    def _edges(self, texts: DataFrame, articles: DataFrame, old_rows: DataFrame, old: DataFrame, batch: int) -> DataFrame:
        """Verified pairs with at least one text of this batch; ``old`` has the present labels of ``old_rows``."""
        fresh = texts.select("*", F.lit(True).alias("fresh"), F.lit(batch).alias("batch"))
        rows = cand.bucket_rows(fresh, "fresh", "batch")
        both = self.table("articles", batch).select("article_id", "title", "content", "batch").unionByName(
            articles.select("article_id", "title", "content", F.lit(batch).alias("batch"))
        )
        links = old.select(F.col("article_id").alias("u"), F.col("label").alias("v"))
        asked = materialize(old_rows.select("article_id", "batch").distinct())
        stored = self.table("texts", batch).select("article_id", "batch", "sketch").join(asked, ["article_id", "batch"], "left_semi")
        sketches = materialize(texts.select("article_id", "sketch").unionByName(stored.select("article_id", "sketch")))
        return verified_edges(rows.unionByName(old_rows), both, self.params, links, None, sketches)

    def _label(
        self, features: DataFrame, groups: DataFrame, earlier: DataFrame, edges: DataFrame, old: DataFrame, batch: int
    ) -> None:
        """Merge labels along the new edges; write labels, scores and aliases."""
        # Nodes: the smallest new id of each new SimHash value, and present labels of stored articles.
        ends = F.array(*[
            F.struct(F.col(f"article_id_{e}").alias("article_id"), F.col(f"simhash_{e}").alias("simhash"), F.col(f"fresh_{e}").alias("fresh"))
            for e in "ab"
        ])
        end = edges.select(F.explode(ends).alias("e")).select("e.*").distinct()
        new_node = end.where("fresh").join(groups, "simhash").select("article_id", F.col("root").alias("node"))
        old_node = keep_ids(old, materialize(end.where("NOT fresh").select("article_id"))).select("article_id", F.col("label").alias("node"))
        node = new_node.unionByName(old_node)
        across = (
            edges.join(node.select(F.col("article_id").alias("article_id_a"), F.col("node").alias("u")), "article_id_a")
            .join(node.select(F.col("article_id").alias("article_id_b"), F.col("node").alias("v")), "article_id_b")
            .select("u", "v")
        )
        same = groups.join(earlier, "simhash").select(F.col("root").alias("u"), F.col("label").alias("v"))
        labels = connected_components(across.unionByName(same))

        named = groups.join(labels, groups["root"] == labels["node"], "left").select(
            "simhash", "articles", F.coalesce("component", "root").alias("label")
        )
        fresh = self._write("features", batch, join_groups(features, named, ["simhash"], "articles"))

        merged = materialize(
            labels.where("node <> component").select(F.col("node").alias("label"), F.col("component").alias("target"))
        )
        present = latest_per_key(self.table("aliases", batch), "label", [F.desc("batch")])
        moved = present.join(merged.withColumnRenamed("label", "present"), "present").select("label", F.col("target").alias("present"))
        direct = merged.withColumnRenamed("target", "present")
        changed = self._write("aliases", batch, direct.unionByName(moved))
        roots = labels.select(F.col("component").alias("article_id")).distinct()
        self._score(fresh, groups, earlier, changed, roots, batch)

    def _score(
        self, fresh: DataFrame, groups: DataFrame, earlier: DataFrame, changed: DataFrame, roots: DataFrame, batch: int
    ) -> None:
        """Scores of new articles and of the articles whose label was merged into another one."""
        exact = groups.join(earlier.select("simhash", "stored", "stored_id"), "simhash", "left").where(
            "articles + coalesce(stored, 0) > 1"
        ).select("simhash", "articles", "stored_id")
        always = materialize(
            join_groups(fresh, exact, ["simhash"], "articles").select("article_id")
            .unionByName(exact.where("stored_id IS NOT NULL").select(F.col("stored_id").alias("article_id")))
        )
        old = self._find("label", changed.select("label"), batch).select("article_id", "label", "batch")
        wanted = fresh.select("article_id", F.col("label").alias("rep_id"), F.lit(batch).alias("batch")).unionByName(
            old.join(changed, "label").select("article_id", F.col("present").alias("rep_id"), "batch")
        ).where("article_id <> rep_id")
        wanted = materialize(wanted.join(always, "article_id", "left_anti"))
        settled = self._find("settled", wanted.select("article_id"), batch).select("article_id")
        wanted = materialize(wanted.join(settled, "article_id", "left_anti"))
        reps = materialize(wanted.select(F.col("rep_id").alias("article_id")).distinct())
        where = self._find("article", reps, batch).select(F.col("article_id").alias("rep_id"), F.col("batch").alias("rep_batch")).unionByName(
            keep_ids(fresh, reps).select(F.col("article_id").alias("rep_id"), F.lit(batch).alias("rep_batch"))
        )
        pairs = materialize(wanted.join(where, "rep_id"))
        compared = cand.scores_against(pairs, self.table("articles", batch + 1), self.params)
        one = F.lit(1.0).alias("score")
        self._write("scores", batch, (
            always.select("article_id", F.lit(None).cast("string").alias("label"), one)
            .unionByName(roots.select("article_id", F.col("article_id").alias("label"), one))
            .unionByName(compared.select("article_id", F.col("rep_id").alias("label"), "score"))
        ))

    def assigned(self) -> DataFrame:
        """Present state: ``article_id, cluster_id, cluster_status, similarity_score``."""
        scores = self.table("scores").select("article_id", F.col("label").alias("scored"), "score")
        holds = F.col("scored").isNull() | (F.col("scored") == F.col("label"))
        rows = self._present(self.table("features").select("article_id", "label")).join(scores, "article_id", "left")
        rows = rows.groupBy("article_id", "label").agg(F.max(F.when(holds, F.col("score"))).alias("similarity_score"))
        matched = F.col("similarity_score").isNotNull()
        return rows.select(
            "article_id",
            F.when(matched, cluster_name(F.col("label"))).alias("cluster_id"),
            F.when(matched, "matched").otherwise("unique").alias("cluster_status"),
            "similarity_score",
        )

    def articles(self) -> DataFrame:
        """Stored articles with the latest submitted fields."""
        every = self.table("articles").unionByName(self.table("updates"))
        return latest_per_key(every, "article_id", [F.desc("batch")]).drop("batch")

    def run(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start clustering a streaming source of articles; stops when it is drained."""
        return (
            source.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def article_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000, format: str = "parquet") -> DataFrame:
    """Articles from files as they appear in ``folder``."""
    reader = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(format).load(folder)
