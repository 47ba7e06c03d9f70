"""Time the headline jobs; prints one JSON line.

Every job starts without derived tables from earlier ones, so each time is the full
way from the documents to the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinfold.plans import queries  # noqa: E402
from twinfold.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
JOBS = [
    "simhash_duplicates", "minhash_bands", "shingles", "top_terms", "similar_pairs", "lsh_topk", "simhash_near",
    "classify_articles", "cluster_articles", "clusters", "search_similar_ids", "title_self_search",
]


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    # One small run, so that the first job does not pay for starting the workers.
    queries.QUERIES["minhash_bands"](spark, SF_DIR.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in JOBS:
        queries.forget()
        start = time.perf_counter()
        queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    articles = queries.table(spark, SF_DIR, "documents").count()
    result = {
        "metric": "total_seconds_of_headline_jobs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "articles": articles,
        "articles_per_second_clustered": round(articles / times["cluster_articles"], 1),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
