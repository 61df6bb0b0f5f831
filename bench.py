"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line.

Every query runs once to warm up and then three times; the best wall time counts,
planning and any scratch files included. Results go to the no-op sink, so all rows
and columns are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "g4_profile_lineitem", "g5_profile_many", "g5_profile_by_dataset", "a13_profile_of_csv", "l0_whole_record",
    "d1_to_string", "d6_datetime_part", "e1_parse_date_formats", "e3_date_columns", "b1_flatten_json",
    "b5_drop_empty_cells", "b7_inventory", "i1_sample20", "i1_sample20_per_dataset", "i10_duplicate_suffix",
    "a3_delimiter_sniff", "a5_json_array", "a7_unwrap", "h1_code_uri", "h5_relevant_any_word", "h7_knn",
    "v6_geo_cascade", "h8_merge_steps", "h9_override", "h14_record_diff", "l4_upsert_fold", "l6_finalize",
    "k2_k8_validate", "k11_validity", "m1_m4_triples", "m5_triples_to_fields", "m7_ntriples_round_trip",
    "g9_budget_sets", "p1_stream_profile",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE

    from metaloom.plans import catalog
    from metaloom.session import local_session

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names:
        run(name)
        times[name] = round(min(run(name) for _ in range(RUNS)), 4)
    spark.stop()
    print(json.dumps({
        "metric": "sum of best wall times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
