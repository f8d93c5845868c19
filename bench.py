"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed over its full result (noop sink). Bridge tables that several queries
share are written by the first that needs them, and that query's time includes it; the
`inputs_*` entries make those costs visible. One untimed pass over the flagship query
starts the JVM's compilers.
"""

from __future__ import annotations

import json
import os
import time

from trialweave.plans import inputs
from trialweave.plans.queries import QUERIES
from trialweave.session import get_spark

HEADLINE = (
    "criteria_counts",
    "explode_criteria",
    "tag_sections",
    "pair_documents",
    "parse_mentions_fragments",
    "parse_mentions_envelope",
    "all_relations",
    "assign_to_lines",
    "nest_entities",
    "candidate_pairs",
    "label_pairs",
    "inject_markers_train",
    "pair_statistics",
    "stratified_split",
    "multilabel_split",
    "tokenize_offsets",
    "build_vocab",
    "align_bio",
    "bio_spans_lenient",
    "group_tokens",
    "span_metrics",
    "token_metrics",
    "classification_report",
    "lexicon_tagger",
    "tag_entities",
    "score_relations",
    "nest_relations",
    "extraction_full",
    "encode_tokens",
    "train_tagger",
    "train_relation_model",
    "tune",
)
INPUTS = (
    "documents",
    "line_mentions",
    "relations",
    "line_entities",
    "labelled_pairs",
    "re_label_map",
    "split_pairs",
    "tagged_lines",
    "tagger_rows",
    "sentences",
    "entity_sentences",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("criteria_counts")
    times = {f"inputs_{n}": timed(lambda n=n: getattr(inputs, n)(spark, sf_dir)) for n in INPUTS}
    times |= {name: timed(lambda name=name: run(name)) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
