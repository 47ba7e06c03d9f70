"""Article search: filters, sort, page, collapse by cluster, and the members shown with a hit."""

from __future__ import annotations

from datetime import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.operators.joins import keep_ids
from twinfold.operators.lookups import cluster_members
from twinfold.session import materialize

# What a search may be sorted by.
SORT_FIELDS = ("publish_time", "created_at", "updated_at")
SORT_ORDERS = ("asc", "desc")
DEFAULT_SORT = "publish_time:desc"
MAX_PAGE_SIZE = 100
# Rows before a page that tasks may keep; it decides on the way, not on the result.
DEEP = 10_000


def sort_order(sort: str | None = None) -> list[Column]:
    """Order columns for ``field:asc`` or ``field:desc``; ties go by article id."""
    field, colon, order = (sort or DEFAULT_SORT).partition(":")
    if not colon or field not in SORT_FIELDS or order not in SORT_ORDERS:
        raise ValueError(f"sort must be one of {SORT_FIELDS} and one of {SORT_ORDERS}, as 'field:order'")
    column = F.col(field)
    return [column.desc() if order == "desc" else column.asc(), F.col("article_id").asc()]


def title_contains(title: Column, query: str | Column) -> Column:
    """Every token of the query occurs in the title; a query without tokens matches nothing."""
    wanted = tx.title_tokens(F.lit(query) if isinstance(query, str) else query)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tx.title_tokens(title))) == 0)


def search_articles(
    articles: DataFrame,
    *,
    state: int | None = None,
    top: int | None = None,
    title: str | None = None,
    source: str | None = None,
    start_time: datetime | str | None = None,
    end_time: datetime | str | None = None,
    tag_id: str | None = None,
    topic_ids: list[str] | None = None,
) -> DataFrame:
    """All articles that meet every given condition; 0 is a value, empty text and lists are not."""
    conditions: list[Column] = []
    if state is not None:
        conditions.append(F.col("state") == state)
    if top is not None:
        conditions.append(F.col("top") == top)
    if source:
        conditions.append(F.col("source") == source)
    if tag_id:
        conditions.append(F.array_contains("tag_ids", tag_id))
    if topic_ids:
        conditions.append(F.arrays_overlap("topic_ids", F.array(*[F.lit(t) for t in topic_ids])))
    if start_time:
        conditions.append(F.col("publish_time") >= F.lit(start_time).cast("timestamp"))
    if end_time:
        conditions.append(F.col("publish_time") <= F.lit(end_time).cast("timestamp"))
    if title:
        conditions.append(title_contains(F.col("title"), title))
    for condition in conditions:
        articles = articles.where(condition)
    return articles


def check_page(page: int, page_size: int) -> None:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")


class RankedRows:
    """Rows laid out in ``order``, which must be total, so that any page is read from its own place.

    Rows are range-partitioned, sorted and numbered within their partition while they are written. A partition's first
    position is the number of rows in earlier ones: one number per partition. A page is a
    range of stored numbers, which the scan skips to by the files' statistics: no row before the page is sorted or sent.
    """

    def __init__(self, rows: DataFrame, order: list[Column], parts: int | None = None):
        self.columns = rows.columns
        by = order if parts is None else [parts, *order]
        placed = rows.repartitionByRange(*by).sortWithinPartitions(*order)
        self.rows = materialize(placed.withColumn("_place", F.monotonically_increasing_id()))  # partition * 2^33 + number
        counts = self.rows.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        starts = accumulate((r.n for r in counts), initial=0)
        self.parts = [(first, r.p << 33, r.n) for first, r in zip(starts, counts)]
        self.total = sum(r.n for r in counts)

    def page(self, page: int = 1, page_size: int = 20) -> DataFrame:
        """One page, with its 1-based ``position`` in the whole result."""
        check_page(page, page_size)
        low, high = (page - 1) * page_size, page * page_size
        wanted, position = F.lit(False), F.lit(None).cast("bigint")
        for first, place, n in self.parts:
            if first < high and low < first + n:  # at most page_size partitions
                here = F.col("_place").between(place + max(low - first, 0), place + min(high - first, n) - 1)
                wanted, position = wanted | here, F.when(here, F.col("_place") + (first - place + 1)).otherwise(position)
        return self.rows.where(wanted).select(*[F.col(f"`{c}`") for c in self.columns], position.alias("position"))


def page_after(rows: DataFrame, sort: str | None = None, after: tuple | None = None, page_size: int = 20) -> DataFrame:
    """The ``page_size`` rows that follow ``after``, the sort field and article id of the last row seen, or the first ones.

    Each task keeps ``page_size`` rows, however far the page is. Null is the smallest value.
    """
    check_page(1, page_size)
    order = sort_order(sort)
    if after is not None:
        field, _, way = (sort or DEFAULT_SORT).partition(":")
        value, article_id = after
        column = F.col(field)
        if value is None:
            further = column.isNotNull() if way == "asc" else F.lit(False)
            same = column.isNull()
        else:
            value = F.lit(value).cast(rows.schema[field].dataType)
            further = column > value if way == "asc" else (column < value) | column.isNull()
            same = column == value
        rows = rows.where(further | (same & (F.col("article_id") > article_id)))
    return rows.orderBy(*order).limit(page_size)


def paginate(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of ``rows`` in ``order``, with its 1-based ``position`` in the whole result.

    For early pages each task keeps its first ``page * page_size`` rows and only those are merged; pages beyond
    ``DEEP`` rows are read from ranked rows, so that no task holds all rows before them.
    """
    check_page(page, page_size)
    skipped = (page - 1) * page_size
    if skipped > DEEP:
        return RankedRows(rows, order).page(page, page_size)
    hits = rows.orderBy(*order).offset(skipped).limit(page_size)
    position = F.row_number().over(Window.orderBy(*order))  # at most page_size rows
    return hits.withColumn("position", (position + skipped).cast("bigint"))


def page_totals(rows: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One row: total, page, page_size, total_pages."""
    check_page(page, page_size)
    return rows.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total") / page_size).alias("total_pages"),
    )


def collapse(hits: DataFrame) -> DataFrame:
    """First hit of each cluster on the page; articles without a cluster stand alone."""
    group = F.coalesce("cluster_id", "article_id")
    first = F.row_number().over(Window.partitionBy(group).orderBy("position"))
    return hits.withColumn("_first", first).where("_first = 1").drop("_first")


def with_similar_ids(hits: DataFrame, articles: DataFrame, size: int | None = None) -> DataFrame:
    """Each stored hit with a row for itself (``rank`` 0) and one per other article of its cluster.

    ``rank`` is the place in the cluster, newest first; with ``size`` only the first ones are read.
    """
    wanted = hits.where("cluster_id IS NOT NULL").select("cluster_id").distinct()
    members = cluster_members(keep_ids(articles, materialize(wanted), "cluster_id"), size).select(
        "cluster_id", "rank", F.col("article_id").alias("similar_article_id")
    )
    others = hits.join(members, "cluster_id").where("article_id <> similar_article_id")
    own = hits.select("*", F.lit(0).alias("rank"), F.col("article_id").alias("similar_article_id"))
    names = ["position", "article_id", "cluster_id", "rank", "similar_article_id"]
    return own.select(*names).unionByName(others.select(*names))


def search_page(
    articles: DataFrame, *, page: int = 1, page_size: int = 20, sort: str | None = None, **conditions
) -> DataFrame:
    """A search result page: collapsed by cluster, each hit with its similar article ids, a row for each."""
    if page_size > MAX_PAGE_SIZE:
        raise ValueError(f"page_size is at most {MAX_PAGE_SIZE}")
    found = search_articles(articles, **conditions)
    hits = paginate(found, sort_order(sort), page, page_size)
    page_rows = materialize(hits.select("position", "article_id", "cluster_id"))
    return with_similar_ids(materialize(collapse(page_rows)), articles)
