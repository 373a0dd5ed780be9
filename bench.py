"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"


def session(cpus: str, folder: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "12g", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from memlake.functions import text as T
    from memlake.operators import facts, lifecycle, search
    from memlake.plans.fixtures import table
    from memlake.plans.store_queries import FINGERPRINTED, _held, _wanted

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = session(cpus, folder)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def timed(run: Callable[[], DataFrame]) -> float:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # a store's tables are made once; the queries read them
    start = time.perf_counter()
    chunks, known, entities, judged = (kept(table(spark, sf_dir, n), n) for n in ("chunks", "facts", "entity_index", "judged_pairs"))
    queries = kept(table(spark, sf_dir, "queries").orderBy("query_id").limit(100), "queries")
    index, lengths = kept(search.term_index(chunks), "term_index"), kept(search.doc_lengths(chunks), "lengths")
    wanted, held = kept(_wanted(chunks), "wanted"), kept(_held(chunks), "held")
    # the store's metadata as (id, key, string_value) rows, and its lexical index
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("string_value")) for c in FINGERPRINTED])
    eav, indexed = kept(chunks.select(F.col("chunk_id").alias("id"), F.inline(pairs)), "eav"), kept(chunks.select("chunk_id"), "indexed")

    def reconciled() -> DataFrame:
        meta = lifecycle.pivot_metadata(eav, tuple(FINGERPRINTED)).select(F.col("id").alias("chunk_id"), T.fingerprint(*map(F.col, FINGERPRINTED)).alias("fingerprint"))
        return lifecycle.churn(lifecycle.reconcile_plan(meta, lifecycle.fts_cardinality(wanted.select("chunk_id", "fingerprint"), indexed)))

    built = round(time.perf_counter() - start, 3)

    runs = {
        "hybrid_search": lambda: search.hybrid_search(queries, chunks, entities, 10, index=index, lengths=lengths),
        "vector_topk": lambda: search.vector_topk(queries, chunks, 10),
        "bm25": lambda: search.bm25(queries, index, lengths, 10),
        "reconcile_noop": reconciled,
        "reconcile_plan": lambda: lifecycle.reconcile_plan(wanted, held),
        "supersession_candidates": lambda: facts.supersession_candidates(known, judged),
        "entity_fact_groups": lambda: facts.entity_fact_groups(known),
    }
    timed(lambda: search.vector_topk(queries.limit(1), chunks.limit(100), 1))
    found = {name: timed(run) for name, run in runs.items()}
    print(json.dumps({"metric": "wall seconds of all headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": Path(sf_dir).name.removeprefix("sf"), "store_built": built, "n_queries": queries.count(), "chunks": chunks.count(), "facts": known.count()}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
