"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from occurra import catalog
from occurra.session import build_session

HEADLINE = (
    "search_flagship",
    "search_by_name",
    "dataset_stats",
    "clade_stats",
    "taxon_descendants",
    "compounds_by_taxon",
    "enriched",
    "dedup_entries",
    "result_digest",
    "tanimoto_pairs",
    "substructure_screen",
    "rdf_triples",
    "new_occurrences",
    "resolve_taxa",
    "decode_share_params",
    "append_unique",
    "curate",
    "second_pass",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = catalog.queries()
    # start the JVM paths every query uses, so that the first is not charged for them
    runs["compounds_by_taxon"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
