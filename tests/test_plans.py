"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture
from conftest import plan_of
from siteweave import operators as op
from siteweave import sources
from siteweave.operators.ranges import covering_ranges, starts_in_ranges
from siteweave.schema import KEY5

SF = "/root/testdata/sf0.001"

# Small enough that a few thousand rows of one key count as skew.
SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2.0",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Packed halves and an annotation table as Parquet."""
    out = {}
    for name in ("half1", "half2", "ann"):
        path = str(tmp_path_factory.mktemp("stored") / name)
        df = fixture(spark, SF, name)
        (df if name == "ann" else op.pack_samples(df)).write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


@pytest.fixture
def settings(spark):
    changed = {}

    def set_conf(**conf):
        for k, v in conf.items():
            k = k.replace("__", ".")
            changed[k] = spark.conf.get(k)
            spark.conf.set(k, v)

    yield set_conf
    for k, v in changed.items():
        spark.conf.set(k, v)


def test_allele_counts_do_not_shuffle(stored):
    for plan in (
        plan_of(op.allele_frequencies(stored["half1"])),
        plan_of(op.allele_report(stored["half1"])),
    ):
        assert "Exchange" not in plan and "Python" not in plan


def test_superpopulation_counts_do_not_shuffle(spark, stored):
    plan = plan_of(op.superpopulation_counts(stored["half1"], fixture(spark, SF, "metadata")))
    assert "Exchange" not in plan and "Generate" not in plan


def test_the_calls_of_a_site_are_gathered_once(spark):
    """Not once for each call that is looked up, where the table is wide."""
    wide = spark.range(4).selectExpr(
        "'1' AS reference_name", "id AS start_position", "id + 1 AS end_position", "'r' AS id", "'A' AS reference_bases",
        "'C' AS alternate_bases", "'1' AS qual", "'PASS' AS filter", *[f"string(id % {100 + k}) AS n{k}" for k in range(1, 9)],
    )
    people = spark.createDataFrame(
        [("EUR", f"n{k}", "x") for k in (1, 2, 3, 4)] + [("AFR", f"n{k}", "x") for k in (5, 6, 7, 8)],
        "SuperPopulation string, Half1 string, Half2 string",
    )
    found = [
        op.superpopulation_counts(wide, people),
        op.superpopulation_counts(wide, people, haploid=False),
        op.superpopulation_counts(wide, people, ["EUR"], snp_only=False),
        op.carriers_of_packed(wide, people),
        op.carriers_of_packed(wide, people, populations=["EUR"]),
    ]
    for df in found:
        assert plan_of(df, "simple").count("% 101)") == 1
    assert [r["EUR_alleleCount"] for r in found[0].orderBy("start_position").collect()] == [0, 4, 4, 4]
    assert [r["EUR_alleleCount"] for r in found[1].collect()] == [0] * 4
    assert [r["AFR"] for r in found[3].orderBy("start_position").collect()] == [None, [4], None, None]


def test_unused_genotypes_are_not_read(stored):
    plan = plan_of(op.count_variants({"h": stored["half1"]}, op.VariantFilter("1", 0, 10)))
    assert "genotypes" not in plan
    assert "GreaterThanOrEqual(start_position,0)" in plan


def test_pooling_shuffles_counts_only(stored):
    plan = plan_of(op.pooled_frequencies({k: stored[k] for k in ("half1", "half2")}), "simple")
    assert plan.count("Exchange hashpartitioning") == 1
    exchanged = plan.split("Exchange hashpartitioning")[0]
    assert "genotypes" not in exchanged and "partial_sum" in plan


def test_outer_joins_run_no_job_and_shuffle_a_table_once(spark, stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        merged = op.merge_halves(stored["half1"], stored["half2"])
        annotated = op.annotate_variants(stored["half1"], stored["ann"])
        for df in (merged, annotated):
            plan_of(df, "simple")
        assert list(tracker.getJobIdsForGroup("plan")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in (merged, annotated):
        df.collect()
        final, first = plan_of(df, "simple").split("Initial Plan")
        # without a hot key nothing is left of the search for them
        assert final.count("SortMergeJoin") == 1 and final.count("FileScan") <= 4
        assert first.count("Exchange hashpartitioning(reference_name") == 2 and first.count("SortMergeJoin") == 1
        assert "NestedLoop" not in first and first.count("BroadcastExchange") == first.count("limit=1000")
    one = plan_of(op.merge_halves(stored["half1"], stored["half2"], plain=True), "simple")
    assert one.count("Join") == 1 and one.count("Exchange") == 2 and "Union" not in one


def test_large_sides_are_not_broadcast(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    genes = stored["ann"].select(F.lit("G").alias("name2"), *KEY5[:3])
    for df in (
        op.variants_by_gene(stored["half1"], genes),
        op.annotate_allele_match(stored["half1"], stored["ann"], insertion=True),
    ):
        plan = plan_of(df, "simple")
        assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_gene_join_meets_on_bins(stored):
    genes = stored["ann"].select(F.lit("G").alias("name2"), *KEY5[:3])
    plan = plan_of(op.variants_by_gene(stored["half1"], genes))
    assert "NestedLoop" not in plan and "_bin" in plan


def test_hot_key_is_dealt_out(spark, stored, settings):
    settings(**SKEW)

    def sites(ids, start, note):
        return ids.select(
            F.lit("1").alias("reference_name"),
            start.alias("start_position"),
            (start + 1).alias("end_position"),
            F.lit("A").alias("reference_bases"),
            F.lit("C").alias("alternate_bases"),
            F.sha2(F.col("id").cast("string"), 256).alias(note),
        )

    ids = spark.range(0, 60_000, 1, 16)
    third_is_one_key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    hot = sites(ids, third_is_one_key, "note")
    few = sites(ids.where("id % 3 <> 0"), F.col("id"), "other")
    joined = op.join_variants(few, hot, "full", hot_rows=1_000)
    joined.collect()
    final = plan_of(joined, "simple").split("Initial Plan")[0]
    # what the two tables are told of hot keys comes from one search
    assert final.count("ReusedExchange") == 1 and final.count("Exchange hashpartitioning(start_position") == 2
    for left, right, how in ((few, hot, "full"), (hot, few, "full"), (few, hot, "left"), (hot, few, "left"), (hot, few, "right")):
        joined = op.join_variants(left, right, how, hot_rows=1_000)
        plain = op.join_variants(left, right, how, plain=True)
        assert joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0
        sizes = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[1] == plain.count() and (how == "right" or sizes[0] < 20_000)


def chromosome(hot):
    """Not one constant, which Spark would drop from the join keys."""
    return F.when(hot, "1").otherwise((F.col("id") % 22 + 1).cast("string"))


def crowded(spark):
    """A third of the sites share one position, so one bin and one rsid."""
    hot = F.col("id") % 3 == 0
    start = F.when(hot, 7).otherwise(F.col("id") * 100)
    return spark.range(0, 60_000, 1, 16).select(
        chromosome(hot).alias("reference_name"),
        start.alias("start_position"),
        (start + 1).alias("end_position"),
        F.concat(F.lit("rs"), start).alias("id"),
        F.lit("A").alias("reference_bases"),
        F.lit("C").alias("alternate_bases"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"),
    )


def test_hot_bin_of_a_gene_join_is_split(spark, settings):
    settings(**SKEW)
    genes = spark.range(0, 600 * 22).select(
        F.concat(F.lit("G"), "id").alias("name2"),
        (F.col("id") % 22 + 1).cast("string").alias("reference_name"),
        (F.floor(F.col("id") / 22) * 10_000).alias("start_position"),
        (F.floor(F.col("id") / 22) * 10_000 + 9_999).alias("end_position"),
    )
    joined = op.variants_by_gene(crowded(spark), genes)
    assert len(joined.collect()) == 60_000
    assert "skew=true" in plan_of(joined)


def test_hot_rsid_is_split(spark, settings):
    settings(**SKEW)
    sites = crowded(spark)
    dbsnp = sites.dropDuplicates(["id"]).select(
        F.col("reference_name").alias("chrm"),
        F.col("start_position").alias("start"),
        F.col("end_position").alias("end"),
        F.col("id").alias("ID"),
    )
    joined = op.variants_by_rsid(sites, dbsnp)
    assert len(joined.collect()) == 60_000
    assert "skew=true" in plan_of(joined)


def test_published_join_is_split(spark, settings):
    settings(**SKEW)
    sites = crowded(spark)
    published = sites.select(
        "reference_name",
        F.col("start_position").alias("start"),
        F.col("end_position").alias("end"),
        "reference_bases",
        F.array("alternate_bases").alias("alternate_bases"),
        F.col("note").alias("AC"),
    )
    half = spark.range(0, 60_000, 1, 16).where("id % 3 <> 0 OR id = 0").select(
        chromosome(F.col("id") == 0).alias("reference_name"),
        F.when(F.col("id") == 0, 7).otherwise(F.col("id") * 100).alias("start_position"),
        F.when(F.col("id") == 0, 8).otherwise(F.col("id") * 100 + 1).alias("end_position"),
        F.lit("A").alias("reference_bases"),
        F.lit("C").alias("alternate_bases"),
        *[F.col("id").alias(p) for p in ("AMR", "EUR", "AFR", "SAS", "EAS")],
    )
    joined = op.join_published_counts(published, half, half)
    assert len(joined.collect()) == 60_000
    assert "skew=true" in plan_of(joined)


def scans_of_last_write(spark, write):
    """File scans in the plan of what `write` writes."""
    seen = []
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    write()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = store.executionsList(before, 100)
    for k in range(rows.size()):
        seen.append(rows.apply(k).physicalPlanDescription())
    return [text for text in seen if "InsertIntoHadoopFsRelationCommand" in text]


def test_outcomes_and_counted_answers_read_their_source_once(spark, stored, tmp_path):
    raw = str(tmp_path / "raw")
    fixture(spark, SF, "gnomad_odd").write.parquet(raw)
    outcomes = op.standardise_keyed_info(spark.read.parquet(raw)).outcomes
    plans_ = scans_of_last_write(spark, lambda: sources.write_outcomes(outcomes, f"{tmp_path}/out"))
    assert len(plans_) == 1 and plans_[0].split("(1)")[0].count("Scan parquet") == 1
    assert sources.read_records(spark, f"{tmp_path}/out").count() > 0
    assert sources.read_rejected(spark, f"{tmp_path}/out").count() > 0
    answer = []
    half = stored["half1"]
    write = lambda: answer.append(sources.write_counted_json(half, f"{tmp_path}/json", "h", "t"))
    plans_ = scans_of_last_write(spark, write)
    assert len(plans_) == 1 and plans_[0].split("(1)")[0].count("Scan parquet") == 1
    assert "Scan parquet" not in plan_of(answer[0]) and answer[0].first()["data_count"] == half.count()
    empty = sources.write_counted_json(half.limit(0), f"{tmp_path}/none", "h", "t")
    assert empty.first()["data_count"] == 0


def test_pruned_annotation_reads_fewer_files(spark, stored, tmp_path):
    path = f"{tmp_path}/ann"
    sources.write_binned(stored["ann"], path, partitions=12)
    table = sources.read_annotation(spark, path)
    few = stored["half1"].where("reference_name IN ('3', '5') AND start_position < 5000000")
    pruned, full = (op.annotate_variants(few, table, plain=True, prune=p) for p in (True, False))
    assert pruned.exceptAll(full).count() == full.exceptAll(pruned).count() == 0

    def files(df):
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return leaf.metrics().apply("numFiles").value()

    near = table.where(starts_in_ranges(table, covering_ranges(few, "start_position", "start_position")))
    assert 0 < files(near) <= files(table) / 4
    clauses = plan_of(pruned).split("score")[1]
    assert "reference_name" in clauses.split("PartitionFilters:")[1].split("\n")[0]
    assert "start_position" in clauses.split("PushedFilters:")[1].split("\n")[0]


def test_stored_profile_reads_footers_only(spark, stored, tmp_path):
    path = f"{tmp_path}/v"
    sources.write_binned(stored["half1"], path)
    found = sources.stored_profile(spark, path)
    plan = plan_of(found)
    assert "PushedAggregation: [COUNT(*), MAX(start_position)]" in plan and "PushedGroupBy: [reference_name]" in plan
    assert sorted(found.collect()) == sorted(op.chromosome_profile(stored["half1"]).collect())
    # the session that asked reads as before
    assert "PushedAggregation" not in plan_of(op.chromosome_profile(spark.read.parquet(path)))
