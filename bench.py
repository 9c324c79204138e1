"""Headline queries at one size: prints one JSON line. `queries` has each query's first run, `warm` its second."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "tokenize_words", "kwic_word", "kwic_limit", "kwic_sort_right1", "collocates_sym", "collocates_asym", "freq_word", "doc_freq_per_million",
    "hit_density", "dispersion", "corpus_stats", "vocabulary_size", "pos_frequency", "kwic_pos", "lexicon_tag_argmax",
    "english_tokenize", "viterbi_tag",
]
#: Over a corpus that is stored first; building it is timed by itself.
STORED = ["kwic_persisted", "kwic_persisted_rare", "kwic_persisted_limit", "collocates_persisted_all", "freq_persisted", "dispersion_persisted"]


def main() -> None:
    from pyspark.sql import SparkSession

    from verbatim.plans.registry import QUERIES, stored

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.files.maxPartitionBytes", "2m")  # as many tasks as cores on a table of some MB
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["corpus_stats"](spark, sf_dir).count()  # start the session

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINE}
    start = time.perf_counter()
    stored(spark, sf_dir)
    cold["corpus_build"] = round(time.perf_counter() - start, 3)
    cold |= {name: run(name) for name in STORED}
    warm = {name: run(name) for name in HEADLINE + STORED}
    print(json.dumps({"metric": "headline_total", "value": round(sum(cold.values()), 3), "unit": "sec", "queries": cold, "warm": warm, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
