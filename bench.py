"""Time the registered headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query is built and run twice with all columns written to
the no-op sink; the second time counts, so class loading does not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.plans import QUERIES  # noqa: E402
from threadloom.session import local_session  # noqa: E402

HEADLINE = (
    "toxicity_prevalence", "sentiment_distribution", "model_agreement_sentiment", "model_agreement_toxicity",
    "agreement_report_lines", "top_topics", "topic_frequencies", "narrative_matrix", "clean_posts_dedupe",
    "clean_comments_purge", "clean_metrics_comments", "timestamp_epoch", "timestamp_mixed", "log_export",
    "log_parse_strict", "log_parse_loose", "log_quarantine", "marker_sessions", "session_counts",
    "feed_projection_posts", "harvest_caps", "harvest_select_top", "harvest_document", "harvest_report_text",
    "batch_assign", "row_prompts", "corpus_prompt", "response_decode", "align_by_key", "align_by_position",
    "macro_decode", "resolve_full_sweep", "resolve_slice", "annotate_rows_rule", "audit_log", "csv_round_trip",
    "json_document_round_trip", "log_file_round_trip", "header_drift_sheets", "segment_tables", "stream_log",
    "stream_sessions", "stream_audit",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over the headline queries (warm run)",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
