"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "segment_gap_or_cap", "merge_tiny_segments", "threshold_runs_with_gap", "snap_simple_grid", "event_stream_clamp",
    "moving_upper_median", "hopping_rms_db", "running_boundaries", "trimmed_mean_by_supplier", "interval_overlap_join",
    "point_in_interval", "nearest_asof", "subtract_intervals", "fill_gaps_complement", "derived_key_join",
    "manifest_upsert", "clean_text", "tokenize_letters", "unknown_tokens", "majority_sequence",
)
RUNS = 4


def main() -> None:
    from catalog import QUERIES
    from tidemark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            at = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - at)
        # the first run also compiles; of the others the middle one counts
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
