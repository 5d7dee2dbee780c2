"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "q00_contingency_fdr", "p02_variant_flags", "p25_translate_sequence", "j02_locus_by_position", "j07_anchor_search_ascending", "j10_carrier_scan", "j11_spatial_contacts",
    "a02b_duplicate_status", "a14_contingency_alt", "a23_compartment_summary", "w01_bh_fdr", "w02_pct_rank_within", "w04_rank_all", "m06_column_entropy",
    "t05_mann_whitney", "g02_closure", "g07_propagate_changes", "s04_read_fasta", "q02_classify", "q07_prioritise", "m07_mutual_information",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cladewise.catalog import QUERIES
    from cladewise.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["q00_contingency_fdr"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
