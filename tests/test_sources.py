"""Readers, writers and layouts on files."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture
from conftest import plan_of
from siteweave import operators as op
from siteweave import sources
from siteweave.operators.columns import bin_width
from siteweave.operators.filters import VariantFilter
from siteweave.schema import KEY5
from siteweave.sources import layout

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "reference_name string, start_position long, end_position long, id string, "
    "reference_bases string, alternate_bases string, qual string, filter string, s1 string, s2 string"
)


def variants(spark, n=200, chroms=("1", "2", "7")):
    rows = [
        (chroms[i % len(chroms)], i * 1000, i * 1000 + 1, f"rs{i}", "A", "C", "1", "PASS", "0|1", "0|0")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(
        map(repr, b.select(*sorted(b.columns)).collect())
    )


def test_numeric_chromosomes_stay_text(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark)
    sources.write_binned(df, path, width=5000)
    back = sources.read_variants(spark, path)
    assert back.schema["reference_name"].dataType.typeName() == "string"
    assert bin_width(back) == 5000
    assert op.packed_samples(back) == ["s1", "s2"]
    assert same(op.wide(back).drop("bin_id"), df)


def test_packed_table_keeps_its_samples_on_disk(spark, tmp_path):
    path = str(tmp_path / "v")
    sources.write_binned(op.pack_samples(variants(spark)), path)
    back = sources.read_variants(spark, path)
    assert op.packed_samples(back) == ["s1", "s2"]
    assert same(op.wide(op.drop_layout(back)), variants(spark))


def test_layout_prunes_chromosome_position_and_bin(spark, tmp_path):
    path = str(tmp_path / "v")
    sources.write_binned(variants(spark), path, width=5000)
    df = sources.read_variants(spark, path)
    found = op.filter_variants(df, VariantFilter("7", 20_000, 60_000))
    plan = plan_of(found)
    assert "reference_name" in plan.split("PartitionFilters:")[1].split("\n")[0]
    pushed = plan.split("PushedFilters:")[1].split("\n")[0]
    for clause in (
        "GreaterThanOrEqual(start_position,20000)",
        "LessThanOrEqual(start_position,60000)",
        "GreaterThanOrEqual(bin_id,4)",
        "LessThanOrEqual(bin_id,12)",
    ):
        assert clause in pushed
    assert found.count() == len([i for i in range(20, 61) if i % 3 == 2])


def test_bins_as_directories(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark, 60)
    sources.write_binned(df, path, width=20_000, partition_by_bin=True)
    back = sources.read_variants(spark, path)
    assert bin_width(back) == 20_000
    found = op.filter_variants(back, VariantFilter("1", 21_000, 30_000))
    assert "bin_id" in plan_of(found).split("PartitionFilters:")[1].split("\n")[0]
    assert sorted(r["start_position"] for r in found.collect()) == [21_000, 24_000, 27_000, 30_000]
    foreign = sources.read_variants(spark, path, bin_width=777)
    assert bin_width(foreign) == 777


def test_append_replaces_and_keeps_other_chromosomes(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark)
    sources.append_chromosome(df.where("reference_name <> '7'"), path)
    sources.append_chromosome(df.where("reference_name = '7'"), path)
    sources.append_chromosome(df.where("reference_name = '7'"), path)
    assert same(op.wide(sources.read_variants(spark, path)), df)


def test_append_inserts_by_key(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark)
    sources.append_chromosome(df, path)
    some = df.where("start_position % 2 = 0 AND reference_name <> '7'").withColumn("qual", F.lit("7"))
    fresh = df.limit(3).withColumns({"start_position": F.col("start_position") + 1, "id": F.lit(None).cast("string")})
    delta = some.unionByName(fresh).unionByName(fresh)
    want = df.join(some.select(*KEY5), KEY5, "left_anti").select(*df.columns).unionByName(delta)
    for _ in range(2):
        sources.append_chromosome(delta, path)
        assert same(op.wide(sources.read_variants(spark, path)).select(*df.columns), want)
    assert not glob.glob(f"{path}/_staged*")
    # the old way: what comes takes the place of the chromosome
    sources.replace_chromosome(some.where("reference_name = '1'"), path)
    left = op.wide(sources.read_variants(spark, path)).where("reference_name = '1'")
    assert left.count() == some.where("reference_name = '1'").count()


def test_append_reads_only_its_chromosomes(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark, chroms=("1", "7", None, "Y"))
    sources.append_chromosome(df, path)
    others = glob.glob(f"{path}/reference_name=Y/*.parquet")
    assert others
    for file in others:
        with open(file, "wb") as f:
            f.write(b"no Parquet")
    some = df.where("reference_name = '7' OR reference_name IS NULL").where("start_position % 3000 = 0")
    delta = some.withColumn("qual", F.lit("7"))
    for _ in range(2):
        sources.append_chromosome(delta, path)
    back = op.wide(sources.read_variants(spark, path)).select(*df.columns)
    mine = "coalesce(reference_name, '') <> 'Y'"
    want = df.where(mine).withColumn(
        "qual", F.when(F.expr("coalesce(reference_name, '7') = '7' AND start_position % 3000 = 0"), "7").otherwise("1")
    )
    assert want.where("qual = '7'").count() == delta.count() > 10
    assert same(back.where(mine), want)
    assert sorted(glob.glob(f"{path}/reference_name=Y/*.parquet")) == sorted(others)


def test_layouts_are_written_by_compiled_code(spark, tmp_path, monkeypatch):
    name, limit = layout.COMPILED
    df = fixture(spark, SF, "half1")
    code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    # what Spark makes of this source is more than HotSpot compiles, and less than Spark splits
    assert int(limit) < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 65535
    seen = []
    given = layout._by_position

    def noted(*args):
        seen.append(spark.conf.get(name, None))
        return given(*args)

    monkeypatch.setattr(layout, "_by_position", noted)
    for _ in range(2):
        sources.append_chromosome(df, str(tmp_path / "append"))
    sources.write_binned(df, str(tmp_path / "binned"))
    sources.write_clustered(df, str(tmp_path / "clustered"))
    with pytest.raises(Exception, match="(?i)exists"):
        sources.write_clustered(df, str(tmp_path / "clustered"))
    assert seen == [limit] * 5 and spark.conf.get(name, None) is None
    spark.conf.set(name, "9000")  # the user's own stays
    try:
        sources.append_chromosome(df, str(tmp_path / "append"))
        assert seen[-1] == "9000" == spark.conf.get(name, None)
    finally:
        spark.conf.unset(name)


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = variants(spark)
    other = df.select(*KEY5, F.col("id").alias("note"))
    for name, rows in (("bucketed_a", op.pack_samples(df)), ("bucketed_b", other)):
        sources.write_bucketed(rows, name, 4)
    a, b = (sources.read_bucketed(spark, n) for n in ("bucketed_a", "bucketed_b"))
    assert op.packed_samples(a) == op.sample_columns(df)
    annotated = op.annotate_variants(a, b, plain=True)
    merged = op.join_variants(a, b, "full", plain=True)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (annotated, merged):
            plan = plan_of(found, "simple")
            assert "Exchange" not in plan and plan.count("SortMergeJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert annotated.where("note = id").count() == df.count() == merged.count()
    for n in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE {n}")


def test_buckets_follow_the_rows(spark, monkeypatch):
    """Ten times the rows make ten times the buckets, and the tables of a join have equally many."""
    from checks import registry
    from siteweave.sources import layout

    df = op.pack_samples(variants(spark))
    assert sources.bucket_count(df) == layout.LEAST_BUCKETS
    monkeypatch.setattr(layout, "BUCKET_BYTES", 8_000)
    few = sources.bucket_count(df)
    tenfold = df.crossJoin(spark.range(10).select(F.col("id").alias("n")))
    assert few > layout.LEAST_BUCKETS and 9 * few <= sources.bucket_count(df.limit(1), tenfold) <= 11 * few
    asked, write = [], sources.write_bucketed
    monkeypatch.setattr(sources, "write_bucketed", lambda df, name, n: asked.append(n) or write(df, name, n))
    for name in ("merge_halves_bucketed", "annotate_variants_bucketed"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(asked) == 4 and asked[0] == asked[1] > 20 and asked[2] == asked[3] > 20


def test_levels_prune_what_begins_too_far_away(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [("1", k * 1000, k * 1000 + (250_000_000 if k == 5 else 1 << 60 if k == 6 else 1)) for k in range(20_000)]
    rows += [("1", 19_900_000, 19_899_000), ("1", None, 5), ("1", 5, None)]
    df = spark.createDataFrame(rows, "reference_name string, start_position long, end_position long")
    sources.write_binned(df, path, partitions=40, levels=True)
    stored = sources.read_variants(spark, path, pack=False)
    found = op.filter_overlap(stored, "1", 19_899_500, 19_901_000)
    want = op.filter_overlap(df, "1", 19_899_500, 19_901_000)
    starts = lambda x: sorted(r["start_position"] for r in x.collect())
    assert starts(found) == starts(want) == [5_000, 6_000, 19_900_000, 19_901_000]
    plan = found._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 2_500
    assert "span_level" in plan_of(found).split("PushedFilters:")[1].split("\n")[0]
    assert "span_level" not in op.drop_layout(stored).columns


def test_one_hot_position_fills_several_files(spark, tmp_path):
    path = str(tmp_path / "v")
    hot = variants(spark, 4000, ("1",)).withColumn("start_position", F.lit(5).cast("long"))
    sources.write_binned(hot, path, partitions=8)
    files = glob.glob(f"{path}/reference_name=1/*.parquet")
    rows = [spark.read.parquet(f).count() for f in files]
    assert sum(rows) == 4000 and max(rows) < 1500


def test_files_cover_short_stretches(spark, tmp_path):
    path = str(tmp_path / "v")
    sources.write_binned(variants(spark, 4000, ("1",)).repartition(5), path, partitions=4)
    spans = []
    for f in glob.glob(f"{path}/reference_name=1/*.parquet"):
        lo, hi = spark.read.parquet(f).agg(F.min("start_position"), F.max("start_position")).first()
        spans.append((lo, hi))
    spans.sort()
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_raw_directory_skips_other_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Reference_Name,POS,INFO\n1,5,x\n")
    (tmp_path / "b.csv").write_text("reference_name,pos,info\n2,6,y\n")
    (tmp_path / "c.txt").write_text("reference_name,pos,info\n3,7,z\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text("reference_name,pos,info\n4,8,w\n")
    df = sources.read_raw_vcf_csv(spark, str(tmp_path))
    assert df.columns == ["reference_name", "pos", "info"]
    assert sorted(r["info"] for r in df.collect()) == ["x", "y"]


def test_raw_directory_refuses_mixed_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("reference_name,pos,info\n1,5,x\n")
    (tmp_path / "b.csv").write_text("pos,reference_name,info\n6,2,y\n")
    with pytest.raises(Exception):
        sources.read_raw_vcf_csv(spark, str(tmp_path)).collect()


def test_gzip_export_and_import(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark)
    sources.write_result(df.repartition(3), path, "csv")
    assert len(glob.glob(path + "/*.csv.gz")) == 3
    assert same(sources.read_import_csv(spark, path, df.columns), df)
    assert same(sources.read_sharded_dir(spark, path, "csv", inferSchema=False).select(
        *[F.col(c).cast(df.schema[c].dataType) for c in df.columns]), df)


def test_text_positions_become_bigint(spark, tmp_path):
    path = str(tmp_path / "v")
    df = variants(spark, 5).withColumn("start_position", F.col("start_position").cast("string"))
    df.union(df.withColumn("start_position", F.lit("12a"))).write.parquet(path)
    back = sources.read_annotation(spark, path)
    assert back.schema["start_position"].dataType.typeName() == "long"
    assert back.where("start_position IS NULL").count() == 5


def test_result_table_at_a_location(spark, tmp_path):
    path = str(tmp_path / "t")
    df = variants(spark, 5)
    sources.write_result(df, "kept_result", "table", mode="overwrite", location=path)
    assert os.path.isdir(path) and same(spark.table("kept_result"), df)
    spark.sql("DROP TABLE kept_result")
    with pytest.raises(ValueError):
        sources.write_result(df, path, "orc")


def test_envelope_counts_source_rows(spark):
    df = variants(spark, 5).withColumn("alternate_bases", F.lit("C,T"))
    row = sources.variant_envelope(df, "half1", "v").first()
    assert row["data_count"] == 5 and row["headers"][-2:] == ["allele_count", "af"]


def test_standard_csv_prints_plain_decimals(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame(
        [("1", 1, 2, "A", "C", 1e-05, 3), ("1", 2, 3, "A", "C", 1.0, 3), ("1", 3, 4, "A", "C", None, 3)],
        "reference_name string, start_position long, end_position long, "
        "reference_bases string, alternate_bases string, minor_af double, allele_count long",
    )
    sources.write_standard_csv(df.coalesce(1), path)
    text = open(glob.glob(path + "/*.csv")[0]).read().split("\n")
    assert text[0] == "REFERENCE_NAME,START_POSITION,END_POSITION,REFERENCE_BASES,ALTERNATE_BASES,MINOR_AF,ALLELE_COUNT"
    assert text[1:4] == ["1,1,2,A,C,0.00001,3", "1,2,3,A,C,1,3", "1,3,4,A,C,,3"]


def test_raw_names_clash_is_an_error(spark):
    df = spark.createDataFrame([("1", 5, 5)], "reference_name string, POS long, start_position long")
    with pytest.raises(ValueError):
        op.normalise_raw(df)


def test_quotes_and_commas_survive_csv(spark, tmp_path):
    path = str(tmp_path / "q")
    text = 'say "AC=1,2", then \\ more'
    df = variants(spark, 3).withColumn("id", F.lit(text))
    sources.write_result(df, path, "csv")
    assert {r["id"] for r in sources.read_import_csv(spark, path, df.columns).collect()} == {text}
    (tmp_path / "raw.csv").write_text('INFO,pos\n"a ""b"", c",5\n')
    assert sources.read_raw_vcf_csv(spark, str(tmp_path)).first()["info"] == 'a "b", c'


def test_positions_that_are_no_numbers_stop_the_read(spark, tmp_path):
    path = str(tmp_path / "text")
    rows = [("1", "5", "6", "A", "C"), ("1", "7x", None, "A", "C")]
    spark.createDataFrame(rows, ", ".join(f"{k} string" for k in KEY5)).write.parquet(path)
    with pytest.raises(Exception, match="start_position is no number: 7x"):
        sources.read_annotation(spark, path, bad_positions="raise").collect()
    found = sources.read_annotation(spark, path).collect()
    assert sorted((r["start_position"] is None, r["end_position"] is None) for r in found) == [(False, False), (True, True)]
    with pytest.raises(ValueError):
        sources.read_variants(spark, path, bad_positions="skip")
