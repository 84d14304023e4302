"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS (default 8) the
cores. The derived tables are stored first, packed, as a user would store them; each
query then reads its files and runs to a no-op sink. A time is the median of three runs
after one warm-up.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.fixtures import POPULATIONS, fixture
from checks.registry import flat_calls
from checks.scratch import new_path
from siteweave import operators as op
from siteweave import plans, sources
from siteweave.operators.filters import VariantFilter
from siteweave.schema import GENOTYPES, SAMPLES_KEY

RUNS = 3
WIDTH = 1252


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored(spark: SparkSession, sf_dir: str, root: str) -> dict:
    """Write the inputs once and open them again."""
    tables = {}
    for name in ("half1", "half2"):
        sources.write_binned(op.pack_samples(fixture(spark, sf_dir, name)), f"{root}/{name}")
        tables[name] = sources.read_variants(spark, f"{root}/{name}")
    for name in ("ann", "gnomad_raw", "raw", "dbsnp", "pop_arrays", "genes", "metadata"):
        spread = fixture(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)
        sources.write_result(spread, f"{root}/{name}")
        tables[name] = sources.read_lookup(spark, f"{root}/{name}")
    sources.write_result(flat_calls(spark, sf_dir, "half2"), f"{root}/flat")
    tables["flat"] = sources.read_lookup(spark, f"{root}/flat")
    # One row per customer, as wide as half of the largest known cohort.
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = "c_custkey"
    cells = [
        F.expr(
            f"CASE WHEN ({k} * 7 + {j * 31}) % 53 = 0 THEN '0|1' "
            f"WHEN ({k} + {j}) % 97 = 0 THEN '.' ELSE '0|0' END"
        ).alias(f"p{j:04d}")
        for j in range(WIDTH)
    ]
    sites = people.select(
        F.lit("1").alias("reference_name"),
        F.col(k).alias("start_position"),
        (F.col(k) + 1).alias("end_position"),
        F.concat(F.lit("rs"), k).alias("id"),
        F.lit("A").alias("reference_bases"),
        F.lit("C").alias("alternate_bases"),
        *cells,
    )
    sources.write_result(sites.repartition(spark.sparkContext.defaultParallelism), f"{root}/wide")
    sources.write_result(sources.read_variants(spark, f"{root}/wide"), f"{root}/packed")
    tables["wide"] = f"{root}/wide"
    tables["packed"] = sources.read_variants(spark, f"{root}/packed")
    # The other half: the same sites under other sample names.
    names = {SAMPLES_KEY: [f"q{j:04d}" for j in range(WIDTH)]}
    sources.write_result(tables["packed"].withMetadata(GENOTYPES, names), f"{root}/packed2")
    tables["packed2"] = sources.read_variants(spark, f"{root}/packed2")
    for name in ("packed", "packed2"):
        compact = name.replace("packed", "compact")
        sources.write_result(op.compact_genotypes(tables[name]), f"{root}/{compact}")
        tables[compact] = sources.read_variants(spark, f"{root}/{compact}")
    people = [
        (pop, ",".join(f"p{j:04d}" for j in range(i, WIDTH, 5)), ",".join(f"q{j:04d}" for j in range(i, WIDTH, 5)))
        for i, pop in enumerate(POPULATIONS)
    ]
    tables["people"] = spark.createDataFrame(people, "SuperPopulation string, Half1 string, Half2 string")
    return tables


def queries(spark: SparkSession, t: dict) -> dict:
    halves = {n: t[n] for n in ("half1", "half2")}
    chromosome = VariantFilter("1", 0)
    return {
        "variants": lambda: plans.variants(halves, gene="GENE0", genes=t["genes"]),
        "variants_of_chromosome": lambda: plans.variants(halves, chromosome),
        "count": lambda: plans.count(halves),
        "annotate": lambda: plans.annotate(t["half1"], t["ann"], chromosome),
        "annotate_variants": lambda: op.annotate_variants(t["half1"], t["ann"]),
        "annotate_allele_match": lambda: op.annotate_allele_match(t["half1"], t["ann"], True),
        "allele_frequencies": lambda: op.allele_frequencies(t["half1"]),
        "merge_halves": lambda: op.merge_halves(t["half1"], t["half2"]),
        "pooled_frequencies": lambda: op.pooled_frequencies(halves),
        "superpopulation_counts": lambda: op.superpopulation_counts(t["half1"], t["metadata"]),
        "carriers_by_population": lambda: op.carriers_by_population(t["flat"]),
        "reconcile_counts": lambda: op.reconcile_counts(t["pop_arrays"]),
        "variants_by_gene": lambda: op.variants_by_gene(t["half1"], t["genes"]),
        "variants_by_rsid": lambda: op.variants_by_rsid(t["half1"], t["dbsnp"]),
        "standardise_keyed_info": lambda: op.standardise_keyed_info(t["gnomad_raw"]).records,
        "validate_variants": lambda: op.validate_variants(op.normalise_raw(t["raw"])).clean,
        "chromosome_profile": lambda: op.chromosome_profile(t["half1"]),
        "wide_pack_and_count": lambda: op.allele_counts(sources.read_variants(spark, t["wide"])),
        "wide_count_packed": lambda: op.allele_counts(t["packed"]),
        "wide_superpopulation_counts": lambda: op.superpopulation_counts(t["packed"], t["people"]),
        "wide_merge": lambda: op.merge_halves(t["packed"], t["packed2"]),
        "wide_count_compact": lambda: op.allele_counts(t["compact"]),
        "wide_merge_compact": lambda: op.merge_halves(t["compact"], t["compact2"]),
    }


def timed(build) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    root = new_path(spark)
    tables = stored(spark, sf_dir, root)
    seconds = {name: timed(build) for name, build in queries(spark, tables).items()}
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
