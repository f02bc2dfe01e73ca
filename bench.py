"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from lexigrain.storage import local_session

HEADLINE = (
    "corpus_stats",
    "byte_budget_prefix",
    "byte_budget_prefix_scaled",
    "heldout_slice",
    "progress_marks",
    "word_type_counts",
    "pair_counts",
    "bpe_train_small",
    "bpe_train_exact",
    "bpe_encode_words",
    "doc_token_counts",
    "doc_token_ids",
    "token_totals",
    "tokenizer_comparison",
    "compression_ratios",
    "prefix_sweep",
    "prefix_sweep_documents",
    "prefix_sweep_large",
)


#: Text tables and their order columns.
TEXTS = {"documents": "doc_id", "conversations": "conv_id"}


def spread(spark, folder: str, cores: int) -> str:
    """A copy of the tables whose texts lie in as many files as there are cores.

    The given files hold one row group each, so one task would read all of a table. Operators do not shuffle text
    to mend that; whoever calls them lays it out.
    """
    copy = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        if table in TEXTS:
            df = spark.read.parquet(f"{folder}/{name}")
            df.repartitionByRange(cores, TEXTS[table]).write.parquet(f"{copy}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{copy}/{name}")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        "bench", cores, partitions=int(cores), **{"spark.ui.showConsoleProgress": "false"}
    )
    from lexigrain.checks.queries import QUERIES, trained

    # Laying out the texts brings up the JVM; then the model that encoding queries share is trained. Both are timed.
    started = time.perf_counter()
    given, folder = folder, spread(spark, folder, int(cores))
    timings = {"spread_input": round(time.perf_counter() - started, 3)}
    started = time.perf_counter()
    trained(spark, folder)
    timings["train_model"] = round(time.perf_counter() - started, 3)
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
