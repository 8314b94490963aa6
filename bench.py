"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON: the median of RUNS runs
of each query, and between the least and the most of them, the spread."""

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from chunkwell import queries as core

NAMES = ["split_sentences", "tokenize", "normalize_abbreviations", "detect_language_default", "stem_tokens", "sentence_tfidf", "cohesion_tfidf", "segment_default", "segment_threshold", "segment_dense_table", "dense_cosine_adjacent"]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, spread = core.queries(), {}, {}
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()  # warm the page cache
    for name in sys.argv[1:] or NAMES:
        runs = []
        for _ in range(RUNS):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name], spread[name] = round(median(runs), 3), round(max(runs) - min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "spread": spread, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
