"""Benchmark the headline jobs.

Runs each job over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each job is written to the
``noop`` sink, so every row is computed and nothing is gathered on the
driver. Besides seconds per job it reports the match volume (requests,
candidate pairs, hits) and the dedupe effect the reference claims.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from onoma.plans import catalog  # noqa: E402
from onoma.plans.match import match  # noqa: E402
from onoma.session import local_session  # noqa: E402

HEADLINE = [
    "normalize_documents",
    "gram_index",
    "dedupe_documents",
    "dedupe_members",
    "candidates",
    "match_topk",
    "match_dedupe",
    "match_parts",
    "match_payload",
    "mode_comparison",
    "metrics_summary",
    "stream_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="onoma-bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        # building the result counts: some jobs run their scans there
        start = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    # volume of the flagship match (one extra pass, not timed)
    res = match(catalog.doc_names(spark, sf_dir), catalog.bench_requests(spark, sf_dir))
    vol = res.summary.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("candidate_count").alias("candidate_pairs"),
        F.sum("n_hits").alias("hits"),
    ).collect()[0]
    names = catalog.doc_names(spark, sf_dir).count()
    match_secs = times["match_topk"]
    out = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "names": names,
        "requests": vol["requests"],
        "candidate_pairs": vol["candidate_pairs"],
        "hits": vol["hits"],
        "pairs_per_sec_match": round((vol["candidate_pairs"] or 0) / match_secs, 1) if match_secs else None,
        "dedupe_speedup": round(times["match_topk"] / times["match_dedupe"], 3) if times["match_dedupe"] else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
