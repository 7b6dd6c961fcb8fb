"""Time the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`python bench.py [name ...]` times only the named queries.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forecourt.queries import QUERIES  # noqa: E402
from forecourt.session import build_session  # noqa: E402

# Training takes long; one timed run is enough there.
ONCE = {"train_and_score", "scoring_audit", "compare_models"}


def run(query, spark, sf_dir: str) -> tuple[float, int]:
    """Seconds for the whole result, and the exchanges in the plan that ran."""
    start = time.perf_counter()
    df = query(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    return seconds, len(re.findall(r"\bExchange ", plan))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds, exchanges = {}, {}
    for name in sys.argv[1:] or QUERIES:
        run(QUERIES[name], spark, sf_dir)
        runs = [run(QUERIES[name], spark, sf_dir) for _ in range(1 if name in ONCE else 3)]
        seconds[name] = round(statistics.median(s for s, _ in runs), 3)
        exchanges[name] = runs[-1][1]
        print(f"{name}: {seconds[name]} s, {exchanges[name]} exchanges", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
        "exchanges": exchanges,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
