"""Time the headline queries once each, end to end, and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

The given tables are files of one row group, which one task reads alone. So the tables are landed
first as several files, and 105,000 profiles (seven for each customer, with ids of their own) as
JSON lines; neither is timed with the queries. ``ranking_105k`` ranks these lines, from the read to
the explained best 100: the size that the published figure is for.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import catalog  # noqa: E402
from checks.parameters import LEXICON, SETTINGS  # noqa: E402
from rosterlens import rank_pool  # noqa: E402
from rosterlens.sources.candidates import read_jsonl  # noqa: E402

HEADLINE = ("topk_ranking", "nested_ranking", "tfidf_similarity", "percentile_scaling",
            "domain_vector", "row_parts", "jd_spec", "rank_all",
            "validate_broken", "ranking_105k")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
COPIES = 7


def landed(spark: SparkSession, sf: str, folder: str, files: int) -> str:
    for name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def land_profiles(spark: SparkSession, sf: str, path: str) -> int:
    many = catalog.nested(spark, sf).withColumn("copy", F.explode(F.sequence(
        F.lit(0), F.lit(COPIES - 1))))
    row = F.substring("candidate_id", 6, 7).cast("int") * COPIES + F.col("copy")
    out = many.withColumn("candidate_id", F.format_string("CAND_%07d", row)).drop("copy")
    out.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return spark.read.text(path).count()


def rank_lines(spark: SparkSession, path: str, text: str) -> DataFrame:
    run = rank_pool(read_jsonl(spark, path), text, LEXICON, SETTINGS, at_least=100)
    return run.top(100).select("candidate_id", "rank", "score", "reasoning")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.files.minPartitionNum", 4 * cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        began = time.time()
        tables = landed(spark, sf, f"{folder}/tables", cpus)
        lines = f"{folder}/profiles"
        many = land_profiles(spark, tables, lines) if "ranking_105k" in names else 0
        print(f"landing {time.time() - began:.1f}", file=sys.stderr, flush=True)
        catalog.jd_title(spark, tables).count()  # start the workers before timing
        text = catalog.role_text(spark, tables)
        times = {}
        for name in names:
            catalog.forget()  # every query pays for its whole run
            began = time.time()
            found = rank_lines(spark, lines, text) if name == "ranking_105k" else \
                catalog.QUERIES[name](spark, tables)
            found.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        pool = spark.read.parquet(f"{sf}/customer.parquet").count()
        out = {"metric": "total wall time of headline queries",
               "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
               "sf": os.path.basename(sf.rstrip("/")), "profiles": pool}
        if "topk_ranking" in times:
            out["profiles_per_sec"] = round(pool / times["topk_ranking"], 1)
        if many:
            out["profiles_105k"] = many
            out["profiles_per_sec_105k"] = round(many / times["ranking_105k"], 1)
        print(json.dumps(out))
        spark.stop()


if __name__ == "__main__":
    main()
