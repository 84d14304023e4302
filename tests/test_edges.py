"""Hand-made rows that the derived tables do not hold, against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from siteweave import operators as op
from siteweave import plans
from siteweave.functions.genotypes import CARRIED
from siteweave.operators.filters import VariantFilter
from siteweave.operators.ranges import covering_ranges
from siteweave.schema import KEY5

SITE = (
    "reference_name string, start_position long, end_position long, id string, "
    "reference_bases string, alternate_bases string, qual string, filter string"
)


def table(spark, rows, samples):
    schema = SITE + "".join(f", {s} string" for s in samples)
    return spark.createDataFrame(rows, schema)


def site(start, ref="A", alt="C", chrom="1", id=None):
    return (chrom, start, start + len(ref), id or f"rs{start}", ref, alt, "100", "PASS")


def java_alternates(text):
    """Comma split that loses trailing empty entries."""
    parts = text.split(",")
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    return [] if parts == [""] and text else parts


def brute_counts(rows):
    """(start, alternate) -> count, called, bad; the plain loop over genotypes."""
    out = []
    for row in rows:
        alts = java_alternates(row[5])
        seen = Counter()
        for gt in row[8:]:
            for part in (gt or "").split("|"):
                # A number beyond 64 bits does not parse, so it is ignored.
                if re.fullmatch(r"[+-]?[0-9]+", part) and -(2**63) <= int(part) < 2**63:
                    seen[int(part)] += 1
        called = sum(n for i, n in seen.items() if 0 <= i <= len(alts))
        bad = sum(seen.values()) - called
        for i, alt in enumerate(alts, 1):
            out.append((row[1], alt, seen[i], seen[0], called, bad))
    return sorted(out)


def spark_counts(df):
    columns = ["start_position", "alternate_bases", "allele_count", "reference_count"]
    return sorted(
        tuple(r) for r in op.allele_counts(df).select(*columns, "allele_number", "bad_calls").collect()
    )


GENOTYPES = ["0|0", "0|1", "1|0", "1|1", "0", "1", ".", ".|.", ".|1", "0/1", "3|0", "2|1", "",
             None, "01|0", "+1|0", "-1|0", " 1|0", "1.0|0", "x", "10|0", "99999999999999999999|0", "|", "1|"]
ALTERNATES = ["C", "C,T", "A,T,", "A,,T", "<CN2>", "", ",", "A,C,G,T,AA,AC,AG,AT,CA,CC"]


def test_allele_counts_of_odd_genotypes(spark):
    samples = [f"g{i}" for i in range(len(GENOTYPES))]
    rows = [site(i, alt=a) + tuple(GENOTYPES) for i, a in enumerate(ALTERNATES)]
    assert spark_counts(table(spark, rows, samples)) == brute_counts(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(ALTERNATES),
            st.lists(st.sampled_from(GENOTYPES), min_size=4, max_size=4),
        ),
        min_size=1,
        max_size=8,
    )
)
def test_allele_counts_equal_the_plain_loop(spark, data):
    rows = [site(i, alt=alt) + tuple(gts) for i, (alt, gts) in enumerate(data)]
    df = table(spark, rows, ["p", "q", "r", "s"])
    assert spark_counts(df) == brute_counts(rows)
    packed = op.pack_samples(df)
    assert op.packed_samples(packed) == ["p", "q", "r", "s"]
    assert op.wide(packed).collect() == df.collect()


def test_counts_add_up(spark):
    rows = [site(i, alt="C,T") + ("0|1", "1|2", ".", "0|0", "3|1") for i in range(5)]
    df = op.tally_alleles(table(spark, rows, list("abcde")))
    for r in df.collect():
        assert sum(r["allele_counts"]) + r["reference_count"] == r["allele_number"]
        assert r["bad_calls"] == 1 and r["n_samples"] == 5


def test_table_without_samples(spark):
    df = op.allele_frequencies(table(spark, [site(1)], []))
    row = df.first()
    assert (row["allele_count"], row["n_samples"], row["af"]) == (0, 0, None)


def test_merge_keeps_right_only_rows_and_missing_calls(spark):
    a = table(spark, [site(1) + ("0|1",), site(2) + ("1|1",)], ["s1"])
    b = table(spark, [site(2) + ("0|0",), site(3) + (".",)], ["s2"])
    merged = {r["start_position"]: r for r in op.merge_halves(a, b).collect()}
    assert {k: r["genotypes"] for k, r in merged.items()} == {
        1: ["0|1", None],
        2: ["1|1", "0|0"],
        3: [None, "."],
    }
    assert merged[3]["id"] == "rs3"
    old = op.merge_halves(a, b, parity_keys=True).where("start_position IS NULL").collect()
    assert len(old) == 1 and old[0]["genotypes"] == [None, "."]
    counted = op.allele_counts(op.merge_halves(a, b)).collect()
    assert {r["start_position"]: (r["allele_count"], r["n_samples"]) for r in counted} == {
        1: (1, 2), 2: (2, 2), 3: (0, 2),
    }


def test_merge_keeps_every_call_of_a_shared_sample(spark):
    a = table(spark, [site(1) + ("0|1", "1|1")], ["s1", "s2"])
    b = table(spark, [site(1) + ("0|0", "1|0"), site(2) + ("1|1", ".")], ["s2", "s3"])
    merged = op.merge_halves(a, b)
    assert op.packed_samples(merged) == ["s1", "s2", "s3"]
    calls = {r["start_position"]: r["genotypes"] for r in merged.collect()}
    assert calls == {1: ["0|1", "1|1", "1|0"], 2: [None, "1|1", "."]}


def test_merge_without_end(spark):
    a = table(spark, [site(1) + ("0|1",)], ["s1"])
    other = ("1", 1, 9, None, "A", "C", None, "q10", "1|1")
    b = table(spark, [other], ["s2"])
    assert op.merge_halves(a, b).count() == 2
    row = op.merge_halves_without_end(a, b).collect()
    assert len(row) == 1
    assert (row[0]["end_position"], row[0]["id"], row[0]["filter"]) == (2, "rs1", "PASS")


def key_rows(n_hot, prefix):
    """A third of the rows share one key; some keys are null."""
    rows = [("1", 5, 6, "A", "C", f"{prefix}{i}") for i in range(n_hot)]
    rows += [("1", 10 + i, 11 + i, "A", "C", f"{prefix}x{i}") for i in range(n_hot)]
    rows += [("1", None, 1, "A", "C", f"{prefix}n{i}") for i in range(n_hot)]
    return rows


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("sizes", [(30, 4), (4, 30), (9, 9), (30, 0)])
def test_hot_keys_are_joined_apart_with_the_same_result(spark, how, sizes):
    schema = (
        "reference_name string, start_position long, end_position long, "
        "reference_bases string, alternate_bases string, {} string"
    )
    left = spark.createDataFrame(key_rows(sizes[0], "l"), schema.format("a"))
    right = spark.createDataFrame(
        key_rows(sizes[1], "r") + [("2", 1, 2, "G", "T", "lone")], schema.format("b")
    )
    plain = left.join(right, KEY5, how).select(*KEY5, "a", "b")
    want = sorted(map(repr, plain.collect()))
    for one_join in (False, True):
        got = op.join_variants(left, right, how, plain=one_join)
        assert sorted(map(repr, got.collect())) == want


def test_duplicate_annotation_rows_multiply(spark):
    v = table(spark, [site(1), site(2)], [])
    ann = spark.createDataFrame(
        [("1", 1, 2, "A", "C", "x"), ("1", 1, 2, "A", "C", "y")],
        "reference_name string, start_position long, end_position long, "
        "reference_bases string, alternate_bases string, note string",
    )
    notes = [(r["start_position"], r["note"]) for r in op.annotate_variants(v, ann).collect()]
    assert sorted(notes, key=str) == [(1, "x"), (1, "y"), (2, None)]


def test_merge_columns_rules():
    assert op.merge_columns(["A", "b"], ["B", "c"]) == [("left", "a"), ("left", "b"), ("right", "c")]
    with pytest.raises(ValueError):
        op.merge_columns(["a", "A"], ["b"])


def test_pooled_splits_alternates_first(spark):
    a = table(spark, [site(1, alt="A,T") + ("1|2",)], ["s1"])
    b = table(spark, [site(1, alt="T,A") + ("1|1",)], ["s2"])
    pooled = {
        r["alternate_bases"]: (r["allele_count"], r["af"], r["samples_present"])
        for r in op.pooled_frequencies({"a": a, "b": b}).collect()
    }
    assert pooled == {"A": (1, 0.5, 2), "T": (3, 1.5, 2)}


def test_pooled_counts_the_samples_of_a_table_once(spark):
    a = table(spark, [site(1, alt="C") + ("1|0", "0|1"), site(1, alt="C,T") + ("1|2", ".")], ["s1", "s2"])
    rows = {r["alternate_bases"]: r for r in op.pooled_frequencies({"a": a}).collect()}
    assert rows["C"]["samples_present"] == 2 and rows["C"]["af"] == rows["C"]["af_present"] == 1.5
    with pytest.raises(ValueError):
        op.pooled_frequencies({"a": a, "b": a})


def test_pooled_equals_counts_of_the_merge(spark):
    a = table(spark, [site(i) + ("0|1", "1|1") for i in range(6)], ["s1", "s2"])
    b = table(spark, [site(i) + ("1", ".") for i in range(3, 9)], ["s3", "s4"])
    merged = op.allele_frequencies(op.merge_halves(a, b)).select(*KEY5, "allele_count", "af")
    pooled = op.pooled_frequencies({"a": a, "b": b}).select(*KEY5, "allele_count", "af")
    assert sorted(merged.collect()) == sorted(pooled.collect())


def test_superpopulation_code_table(spark):
    codes = [*CARRIED, ".", "0/1", ".|1", "4|1", "12", "01", None]
    names = [f"n{i}" for i in range(len(codes))]
    df = table(spark, [site(1) + tuple(codes), site(2, ref="AC") + tuple(codes)], names)
    people = spark.createDataFrame(
        [("EUR", n, "absent") for n in names[::2]] + [("AFR", n, "absent") for n in names[1::2]],
        "SuperPopulation string, Half1 string, Half2 string",
    )
    rows = op.superpopulation_counts(df, people).collect()
    assert len(rows) == 1  # the second site is no SNP
    assert rows[0]["EUR_alleleCount"] == sum(CARRIED.get(c, 0) for c in codes[::2])
    assert rows[0]["AFR_alleleCount"] == sum(CARRIED.get(c, 0) for c in codes[1::2])
    only = op.superpopulation_counts(df, people, ["EUR"])
    assert "AFR_alleleCount" not in only.columns


def test_gene_with_two_transcripts_and_wide_bins(spark):
    genes = spark.createDataFrame(
        [("G1", "1", 100, 200), ("G1", "1", 150, 400_000), ("G2", "1", 300_000, 300_001), ("G1", "X", 5, 9)],
        "name2 string, reference_name string, start_position long, end_position long",
    )
    starts = [99, 100, 62_500, 300_000, 400_000, 400_001]
    df = table(spark, [site(s) for s in starts] + [site(7, chrom="X")], [])
    hits = defaultdict(list)
    for r in op.variants_by_gene(df, genes).collect():
        hits[r["gene"]].append(r["start_position"])
    assert sorted(hits["G1"]) == [7, 100, 62_500, 300_000, 400_000] and hits["G2"] == [300_000]
    binned = op.with_bin(df, 1000)
    assert op.variants_by_gene(binned, genes).count() == 6
    assert op.variants_by_gene(df, genes, ["no-such gene"]).count() == 0
    assert [c.reference_name for c in op.gene_coordinates(genes, "G1")] == ["1", "X"]
    found = plans.variants({"t": df}, gene="G1", genes=genes).collect()
    assert len(found) == 5


def test_overlap_counts_a_pair_once(spark):
    genes = spark.createDataFrame(
        [("G1", "1", 50, 300_000)],
        "name2 string, reference_name string, start_position long, end_position long",
    )
    long = ("1", 10, 250_000, "del", "A", "C", "1", "PASS")
    df = table(spark, [long, site(49), site(48)], [])
    found = op.variants_by_gene(df, genes, overlap=True).collect()
    assert sorted(r["start_position"] for r in found) == [10, 49]


def test_overlap_of_reversed_intervals(spark):
    genes = spark.createDataFrame(
        [("G1", "1", 0, 400_000), ("G2", "1", 200_000, 100_000)],
        "name2 string, reference_name string, start_position long, end_position long",
    )
    spans = [(300_000, 100_000), (90_000, 210_000), (None, 5), (5, None), (150_000, 160_000)]
    rows = [("1", a, b, "x", "A", "C", "1", "PASS") for a, b in spans]
    found = op.variants_by_gene(table(spark, rows, []), genes, overlap=True).collect()
    expected = [
        (g, a)
        for g, lo, hi in (("G1", 0, 400_000), ("G2", 200_000, 100_000))
        for a, b in spans
        if a is not None and b is not None and a <= hi and b >= lo
    ]
    assert sorted((r["gene"], r["start_position"]) for r in found) == sorted(expected)


def test_merge_of_different_bin_widths(spark):
    a = op.with_bin(table(spark, [site(150_000) + ("0|1",)], ["s1"]), 1000)
    b = op.with_bin(table(spark, [site(250_000) + ("0|1",)], ["s2"]), 50)
    merged = op.merge_halves(a, b)
    assert sorted(r["bin_id"] for r in merged.collect()) == [150, 250]
    where = VariantFilter("1", 240_000, 260_000)
    assert op.filter_variants(merged, where).count() == 1
    unknown = table(spark, [site(1) + ("0|1",)], ["s3"]).withColumn("bin_id", F.lit(0))
    assert "bin_id" not in op.merge_halves(unknown, a).columns


def test_rsid_rules(spark):
    dbsnp = spark.createDataFrame(
        [("1", 5, 6, "A", "C", "rs5"), ("1", 5, 6, "A", "G", "rs5"), ("1", 7, 8, "A", "C", "rs7"),
         ("2", 7, 8, "A", "C", "rs7"), ("1", 9, 10, "A", "C", ".")],
        "chrm string, start long, end long, base string, alt string, ID string",
    )
    df = table(spark, [site(5), site(7), site(9, id="rs5")], [])
    assert op.rsid_location(dbsnp, "rs5") == ("1", 5, 6)
    with pytest.raises(ValueError):
        op.rsid_location(dbsnp, "rs5", strict=True)
    for bad in ("rs7", "rs404"):
        with pytest.raises(ValueError):
            op.rsid_location(dbsnp, bad)
    assert [r["start_position"] for r in op.variants_by_rsid(df, dbsnp, ["rs5", "rs7"]).collect()] == [5]
    assert [r["start_position"] for r in op.variants_by_rsid(df, dbsnp).collect()] == [5]
    assert [r["id"] for r in op.ambiguous_rsids(dbsnp).collect()] == ["rs7"]
    assert plans.variants({"t": df}, rsid="rs5", dbsnp=dbsnp).count() == 1


def test_large_set_of_rsids(spark):
    places = [("1", k * 1000, k * 1000 + 1, "A", "C", f"rs{k}") for k in range(0, 3000)]
    dbsnp = spark.createDataFrame(places, "chrm string, start long, end long, base string, alt string, ID string")
    df = table(spark, [site(k * 1000, id=f"rs{k}") for k in range(0, 3000, 3)] + [site(7, id="rs1")], [])
    wanted = [f"rs{k}" for k in range(0, 3000, 2)]
    small = op.variants_by_rsid(df, dbsnp, wanted[:150])
    large = op.variants_by_rsid(df, dbsnp, wanted)
    assert sorted(r["start_position"] for r in large.collect()) == [k * 1000 for k in range(0, 3000, 6)]
    assert sorted(r["start_position"] for r in small.collect()) == [k * 1000 for k in range(0, 300, 6)]
    sizes = [len(plan_of(x, "simple").splitlines()) for x in (small, large)]
    assert sizes[0] == sizes[1]
    assert op.variants_by_rsid(df, dbsnp, []).count() == 0
    ids = spark.createDataFrame([("rs3",), ("rs3",), (None,), ("rs404",)], "id string")
    assert [r["id"] for r in op.variants_by_rsid(df, dbsnp, ids).collect()] == ["rs3"]
    named = df.withColumns({c: F.lit("x") for c in ("lookup_start", "lookup_end", "locations")})
    assert op.variants_by_rsid(named, dbsnp, wanted).count() == 500


def test_covering_ranges(spark):
    rows = [("1", k, k + 2) for k in (5, 6, 9_000_000, 90_000_000)] + [("2", 7, 8), ("X", None, 3), (None, 4, 5)]
    places = spark.createDataFrame(rows, "reference_name string, a long, b long")
    assert covering_ranges(places, "a", "b") == [
        ("1", 5, 8), ("1", 9_000_000, 9_000_002), ("1", 90_000_000, 90_000_002), ("2", 7, 8),
    ]
    assert covering_ranges(places, "a", "b", 3) == [("1", 5, 9_000_002), ("1", 90_000_000, 90_000_002), ("2", 7, 8)]
    assert covering_ranges(places, "a", "b", 1) is None
    assert covering_ranges(places.limit(0), "a", "b") == []


def test_gene_names_and_absurd_genes(spark):
    genes = spark.createDataFrame(
        [("G1", "1", 50, 2**60), ("G2", "1", 50, 60), ("G3", None, 5, 9), ("G4", "1", None, None)],
        "name2 string, reference_name string, start_position long, end_position long",
    )
    df = table(spark, [site(49), site(55), site(2**59)], []).withColumn("gene", F.lit("mine"))
    for overlap in (False, True):
        found = op.variants_by_gene(df, genes, overlap=overlap).collect()
        got = sorted((r["start_position"], r["gene"], r["lookup_gene"]) for r in found)
        first = [(49, "mine", "G1"), (49, "mine", "G2")] if overlap else []
        assert got == first + [(55, "mine", "G1"), (55, "mine", "G2"), (2**59, "mine", "G1")]
    assert "symbol" in op.variants_by_gene(df, genes, gene_column="symbol").columns
    with pytest.raises(ValueError):
        op.variants_by_gene(df, genes, gene_column="Gene")


def test_filter_arguments_are_checked():
    for bad in (
        {"reference_name": "1 OR 1"}, {"reference_name": ""}, {"reference_bases": "N"},
        {"alternate_bases": "C,,T"}, {"alternate_bases": "<CN2"},
        {"start_position": "12"}, {"end_position": 2**63}, {"start_operator": "~"},
        {"minor_af": 0.1, "minor_af_margin": 2.0},
    ):
        with pytest.raises(ValueError):
            VariantFilter(**bad)


def test_workflow_argument_rules(spark):
    df = table(spark, [site(1)], [])
    with pytest.raises(ValueError):
        plans.variants({"t": df})
    with pytest.raises(ValueError):
        plans.variants({"t": df}, VariantFilter("1"))
    with pytest.raises(ValueError):
        plans.variants({"t": df}, VariantFilter("1", 1), gene="G", genes=df)
    with pytest.raises(ValueError):
        plans.annotate(df, df, VariantFilter("1", 1), rsid="rs1")
    with pytest.raises(ValueError):
        op.join_variants(df, df, "cross")


def test_binned_and_unbinned_filters_agree(spark):
    df = table(spark, [site(s) for s in range(0, 1_000_000, 9973)], [])
    binned = op.with_bin(df)
    for where in (
        VariantFilter("1", 100_000, 400_000),
        VariantFilter(end_position=62_500),
        VariantFilter(start_position=9973, position_range=False),
        VariantFilter(start_position=62_499, position_range=False, start_operator=">"),
        VariantFilter(start_position=62_500, position_range=False, start_operator="<"),
        VariantFilter(start_position=9973, position_range=False, start_operator="<>"),
    ):
        plain = op.filter_variants(df, where)
        pruned = op.filter_variants(binned, where).drop("bin_id")
        assert sorted(plain.collect()) == sorted(pruned.collect())


def test_validation_splits_every_row(spark):
    rows = [
        ("1", "10", "11", "A", "C"), ("MT", "10", "11", "A", "C"), ("chr1", "10", "11", "A", "C"),
        ("1 ", "10", "11", "A", "C"), ("1", "12a", "11", "A", "C"), ("1", "10", " 11", "A", "C"),
        ("1", "10", "11", "N", "C"), ("1", "10", "11", "A", "A,C"), ("", "10", "11", "", ""),
        (None, "10", "11", None, None), ("X", None, "11", "A", "C"),
        ("X", "99999999999999999999", "11", "A", "C"), ("Y", "+7", "-1", "ACTG", "T"),
    ]
    df = spark.createDataFrame(
        rows,
        "reference_name string, start_position string, end_position string, "
        "reference_bases string, alternate_bases string",
    )
    clean, rejected = op.validate_variants(df)
    assert clean.count() + rejected.count() == len(rows)
    assert clean.schema["start_position"].dataType.typeName() == "long"
    assert clean.count() == 4
    errors = {(r["reference_name"], r["start_position"]): r["errors"] for r in rejected.collect()}
    assert errors[("1", "12a")] == ["start_position"]
    assert errors[("X", None)] == ["start_position"]


def raw(spark, rows):
    return spark.createDataFrame(
        [("1", str(i), str(i + 1), "A", alt, info) for i, (alt, info) in enumerate(rows)],
        "reference_name string, start_position string, END_POSITION string, "
        "reference_bases string, alternate_bases string, INFO string",
    )


def records(result):
    rows = result.records.select("start_position", "alternate_bases", "minor_af", "allele_count")
    return sorted(tuple(r) for r in rows.collect())


def reasons(result):
    return {int(r["start_position"]): r["reason"] for r in result.rejected.collect()}


def test_keyed_info(spark):
    df = raw(
        spark,
        [
            ("C", "AC=3;AF=1.5e-03;AN=9"),
            ("C, T", "AC=3,4;AF=0.1,0.2"),
            ("C", "AC=3;AF=."),
            ("C,T", "AC=3,4;AF=0.1,."),
            ("C", "XAF=0.9;AC=1;AF=0.5"),
            ("C", "AC=1"),
            ("C", "AF=0.5"),
            ("C,T", "AC=1;AF=0.5,0.5"),
            ("C,T", "AC=1;AF=0.5"),
            ("C", "AC=99999999999;AF=1.2E-05"),
            ("C", "AC=1;AF=1e"),
            ("C", "AC=1;AF=1.2X-05;AN=3"),
        ],
    )
    result = op.standardise_keyed_info(df)
    assert records(result) == [
        (0, "C", 0.0015, 3), (1, "C", 0.1, 3), (1, "T", 0.2, 4), (4, "C", 0.9, 1), (9, "C", 1.2e-05, 99999999999),
    ]
    assert sorted(reasons(result)) == [5, 6, 7, 8, 10, 11]
    assert (4, "C", 0.5, 1) in records(op.standardise_keyed_info(df, anchored=True))


def test_positional_info(spark):
    terms = "a;b;c;d;e;f;g;"
    df = raw(
        spark,
        [
            ("C", terms + "A-0.75,C-0.25;A-150,C-50"),
            ("-,T", terms + "A-0.5,--0.3,T-0.2;A-5,--3,T-2"),
            ("T", terms + "A-0.9,T-1e-05;A-9,T-1"),
            ("T", "a;b"),
            ("T", terms + "A-0.9,T-0.1;A-9"),
            ("T,G", terms + "A-0.9,T-0.1;A-9,T-1"),
            ("T", terms + "A-0.9,-0.1;A-9,T-1"),
        ],
    )
    result = op.standardise_positional_info(df)
    assert records(result) == [
        (0, "C", 0.25, 50), (1, "-", 0.3, 3), (1, "T", 0.2, 2), (2, "T", 5.0, 1),
    ]
    assert sorted(reasons(result)) == [3, 4, 5, 6]


def test_plain_columns(spark):
    df = spark.createDataFrame(
        [("1", 1, 2, "A", "C", "0.5", "7"), ("1", 2, 3, "A", " <CN2> ", "0.5", "7"),
         ("1", 3, 4, "A", "C", "x", "7"), ("1", 4, 5, "A", "C", None, None)],
        "reference_name string, start_position long, end_position long, "
        "reference_bases string, alternate_bases string, AF string, AC string",
    )
    result = op.standardise_columns(df)
    assert [r[0] for r in records(result)] == [1, 4]
    assert list(reasons(result)) == [3]


def test_carriers_are_null_without_carriers(spark):
    calls = spark.createDataFrame(
        [("Y", 1, 2, "A", "C", "100", "PASS", f"s{i}", "EUR", g) for i, g in enumerate("1101")]
        + [("Y", 1, 2, "A", "C", "100", "PASS", "t", "AFR", "0"), ("1", 1, 2, "A", "C", "100", "PASS", "t", "AFR", "1")],
        "reference_name string, start_position long, end_position long, reference_bases string, "
        "alternate_bases string, quality string, filters string, call_set_name string, "
        "SuperPopulation string, genotype string",
    )
    assert op.carriers_by_population(calls).count() == 2
    rows = op.carriers_by_population(calls, reference_name="Y").collect()
    assert len(rows) == 1 and rows[0]["EUR"] == [3] and rows[0]["AFR"] is None


def test_reconcile_unnests_every_array(spark):
    names = [p + h for h in "12" for p in ("AMR", "EUR", "AFR", "SAS", "EAS")]
    schema = "start long, end long, reference_bases string, alternate_bases string" + "".join(
        f", {n} array<long>" for n in [*names, "AC"]
    )
    ones = [[1]] * 9
    df = spark.createDataFrame(
        [
            (1, 2, "A", "C", *ones, [1], [10]),
            (2, 3, "A", "C", *ones, [1, 2], [10]),
            (3, 4, "A", "C", *ones, [], [99]),
            (0, 4, "A", "C", *ones, [1], [99, 10]),
        ],
        schema,
    )
    rows = op.reconcile_counts(df).collect()
    assert [(r["start"], r["AC_Fake"], r["AC"]) for r in rows] == [(0, 10, 99), (2, 11, 10)]


def test_json_round_trip(spark):
    df = spark.createDataFrame(
        [("1", 1, 2, "A", "C", 0.0015, 3), ("1", 2, 3, "A", "C", None, None)],
        "reference_name string, start_position long, end_position long, "
        "reference_bases string, alternate_bases string, minor_af double, allele_count long",
    )
    back = op.standard_from_json(op.standard_to_json(df))
    assert back.select(*df.columns).collect() == df.collect()


def test_rank_orders_ties_by_key(spark):
    df = table(spark, [site(s) for s in (3, 1, 2)], []).withColumn("n", F.col("start_position") % 2)
    assert [r["start_position"] for r in op.rank_by_population_count(df, "n").collect()] == [1, 3]


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_salted_joins_equal_plain_ones(spark, how):
    """Keys hot on either side, on both, without a partner, repeated as whole rows, and null."""
    def rows(parts, note):
        out = [
            (chrom, start, start + 1, "A", "C", f"{note}{k % distinct}")
            for chrom, start, n, distinct in parts
            for k in range(n)
        ]
        df = spark.createDataFrame(out, f"{', '.join(c + (' long' if 'position' in c else ' string') for c in KEY5)}, {note} string")
        return df.repartition(5)

    a = rows([("1", 1, 90, 90), ("1", 2, 3, 3), ("1", 3, 40, 40), ("1", 4, 70, 1), (None, 5, 60, 60), ("2", 6, 1, 1)], "x")
    b = rows([("1", 1, 2, 2), ("1", 2, 80, 80), ("1", 3, 30, 1), ("1", 7, 50, 50), (None, 5, 45, 1), ("2", 6, 1, 1)], "y")
    salted = op.join_variants(a, b, how, hot_rows=20)
    plain = op.join_variants(a, b, how, plain=True)
    assert salted.count() == plain.count()
    assert salted.exceptAll(plain).count() == 0
    assert op.join_variants(a.limit(0), b, how, hot_rows=20).count() == (0 if how == "left" else 208)


CALLS = ["0|0", "0|1", "1|0", "1|1", ".", "0", "1", None, "2|3", ".|1", "0/1", "", "?", "-", "10|1", "+1|-1", "1|2"]


def test_compact_genotypes_keep_every_call(spark):
    samples = [f"s{k}" for k in range(len(CALLS))]
    turns = [CALLS[k:] + CALLS[:k] for k in range(len(CALLS))] + [["0|0"] * len(CALLS), [None] * len(CALLS)]
    rows = [site(k, alt=("A", "A,T", "", ",", "<CN0>,G,T")[k % 5]) + tuple(own) for k, own in enumerate(turns)]
    df = op.pack_samples(table(spark, rows, samples)).withColumn("note", F.lit(1))
    nothing = op.packed_samples(df)
    df = df.unionByName(df.limit(1).withColumn("genotypes", F.lit(None).cast("array<string>")).withColumn("id", F.lit("n")))
    df = df.withMetadata("genotypes", {"samples": nothing})
    compact = op.compact_genotypes(df)
    assert op.packed_samples(compact) == samples and "genotypes" not in compact.columns
    columns = df.columns
    key = lambda r: repr(r)
    assert sorted(op.expand_genotypes(compact).select(*columns).collect(), key=key) == sorted(df.collect(), key=key)
    known = df.where("genotypes IS NOT NULL")
    for of in (op.tally_alleles, op.allele_frequencies):
        want = of(known)
        got = of(op.compact_genotypes(known)).select(*want.columns)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    some = spark.createDataFrame([site(1) + ("0|0", "9|9"), site(99) + (None, "1")], SITE + ", s1 string, z string")
    shared = op.merge_halves(compact.drop("note"), some)
    plain = op.merge_halves(df.drop("note"), some)
    for other in ("z", "y"):
        own = some.withColumnsRenamed({"s1": "x", "z": other})
        a, b = op.merge_halves(compact.drop("note"), own), op.merge_halves(df.drop("note"), own)
        assert op.packed_samples(a) == op.packed_samples(b) and "compact_genotypes" in a.columns
        assert sorted(op.wide(a).collect(), key=key) == sorted(op.wide(b).collect(), key=key)
    assert sorted(op.wide(shared).collect(), key=key) == sorted(op.wide(plain).collect(), key=key)


def test_compact_counts_have_no_lambda_over_calls(spark):
    df = op.compact_genotypes(table(spark, [site(1) + ("0|0", "9|9")], ["s1", "s2"]))
    plan = plan_of(op.allele_counts(df))
    assert "Exchange" not in plan and "length(replace(" in plan
