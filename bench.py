"""Time the headline queries; prints one JSON line.

Every query starts from the source tables and computes its whole result, every column, for a sink
that drops it. One untimed pass warms the JVM; then the median of three is taken.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mailscope import catalog  # noqa: E402
from mailscope.session import local_session  # noqa: E402

HEADLINE = (
    "corpus_exchange", "kpis", "external_exchanges", "external_subject_overlap", "monthly_volume",
    "daily_status_stats_sent", "daily_status_anova_sent", "daily_status_pairwise_received", "daily_status_box_sent",
    "per_person_ratio_stats_sent", "per_person_ratio_stats_received", "active_people_stats", "flow_by_year",
    "yearly_status_stats_received", "topic_flags_received", "topic_month_long_sent", "topic_year_stats",
    "topic_status_long_received", "keyword_subject", "keyword_text", "keyword_total_sent", "keyword_top_status_sent",
    "top_senders", "top_recipients_dedupe_first", "compare_stats_sent", "compare_welch_received", "person_topics_received",
    "word_count_stats", "profile_match_counts", "profile_alias_coverage",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    found = catalog.queries()
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        run(found[name], spark, sf_dir)
        times[name] = round(statistics.median(run(found[name], spark, sf_dir) for _ in range(repeats)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    result = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": cores,
        "spark": spark.version,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
