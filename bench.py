"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_REPEAT the
timed runs per query after one warm-up of the session (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("BENCH_SF_DIR", "/root/testdata/sf0.1")

from versegrid.plans.catalog import QUERIES  # noqa: E402
from versegrid.session import build_session  # noqa: E402

HEADLINE = [
    "inline_text", "fold_ascii", "slug_dash", "build_urls", "route_pages", "track_links", "track_keys",
    "crawl_tracks", "page_bodies_text", "page_bodies_paragraphs", "extract_lyrics", "best_genre",
    "tag_tracks", "labelled_corpus", "tokens_no_stop", "stems", "term_freq", "tfidf", "tfidf_plain",
    "top_terms", "split_parts", "naive_bayes", "classification_report", "eps_neighbours", "dbscan", "kmeans",
]


def run(query, spark, folder) -> float:
    start = time.time()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    folder = os.environ["BENCH_SF_DIR"]
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["tokens"], spark, folder)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, folder) for _ in range(repeat)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
