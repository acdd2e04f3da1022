"""Headline timings on the driver's tables: one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clickloom.operators.clone import CloneSchedule, batch_manifest, clone_batches  # noqa: E402
from clickloom.plans.build import build  # noqa: E402
from clickloom.plans.incremental import run_incremental  # noqa: E402
from clickloom.session import build_session  # noqa: E402
from clickloom.sources.batches import write_batches  # noqa: E402
from clickloom.sources.loading import load_events  # noqa: E402
from clickloom.sources.tables import table_partitions  # noqa: E402
from contract.adapter import OPTIONS, as_events, read_table  # noqa: E402
from contract.queries import QUERIES, new_path, new_zones  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
SINGLE = [
    "page_views",
    "sessions",
    "users",
    "normalize_events",
    "context_repair",
    "dedup_events",
    "clone_batches",
    "partition_audit",
    "seed_enrichment",
]


def session():
    scratch = tempfile.mkdtemp(prefix="clickloom-bench-")
    return build_session(
        "bench",
        f"local[{CPUS}]",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=str(CPUS),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"{scratch}/shared",
        spark__sql__warehouse__dir=f"{scratch}/warehouse",
        # on one machine: list files in the driver, and let small writes use every core
        spark__sql__sources__parallelPartitionDiscovery__threshold="10000",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="1m",
    )


def timed(action) -> tuple[float, object]:
    start = time.perf_counter()
    result = action()
    return time.perf_counter() - start, result


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    QUERIES["sessions"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # the JVM warms up untimed
    for name in SINGLE:
        seconds[name], _ = timed(lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    # (a) load everything, then a full build
    template = as_events(read_table(spark, SF_DIR, "events"))
    rows = template.count()
    zones = new_zones(spark)
    seconds["load"], _ = timed(lambda: load_events(spark, template, zones.events, "all"))
    seconds["full_build"], _ = timed(lambda: build(spark, zones, OPTIONS))

    # (b) one initial and five incremental batches of a day each
    batches = new_path(spark)
    schedule = CloneSchedule.for_template(template, batches=6, window=timedelta(hours=24))
    seconds["clone_write"], _ = timed(lambda: write_batches(clone_batches(template, schedule), batches))
    manifest = batch_manifest(spark, schedule, spark.read.parquet(batches), batches)
    cloned = new_zones(spark)
    steps = run_incremental(spark, cloned, manifest, initial=1, options=OPTIONS)
    incremental = steps[1:]
    seconds["batch_load"] = sum(s.load_seconds for s in incremental) / len(incremental)
    seconds["batch_refresh"] = sum(s.refresh_seconds for s in incremental) / len(incremental)

    seconds["rebuild_of_batches"], _ = timed(lambda: build(spark, cloned, OPTIONS))

    # (c) a keyed update of one row per user, and the refresh fed by a stream
    seconds["merge"], _ = timed(lambda: QUERIES["merge_update"](spark, SF_DIR))
    seconds["stream"], _ = timed(lambda: QUERIES["streamed_sessions"](spark, SF_DIR))

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "events": rows,
                "full_build_rows_per_sec": round(rows / seconds["full_build"]),
                "batch_rows_per_sec": round(rows / (seconds["batch_load"] + seconds["batch_refresh"])),
                "event_partitions": table_partitions(spark, cloned.events, ["batch_id"]).count(),
                "state_partitions": table_partitions(spark, cloned.session_state, ["session_day"]).count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
