"""Inputs of the registered queries, derived from the driver's tables.

Each fixture is one SELECT that Spark and DuckDB both accept. `{orders}` and the like
stand for the source table; `{q}` quotes a name and `{array}` builds an array, the two
spots where the dialects differ. See FIXTURES.md.
"""

from pyspark.sql import DataFrame, SparkSession

SAMPLES1 = [f"s{j:02d}" for j in range(1, 11)]
SAMPLES2 = [f"s{j:02d}" for j in range(11, 21)]
POPULATIONS = ["AMR", "EUR", "AFR", "SAS", "EAS"]
POPULATION_OF = ["AFR", "AMR", "EAS", "EUR", "SAS"]
ARRAY_NAMES = [p + h for h in ("1", "2") for p in POPULATIONS]


def chrom(c: str) -> str:
    return (
        f"CASE WHEN {c} % 24 < 22 THEN CAST({c} % 24 + 1 AS STRING) "
        f"WHEN {c} % 24 = 22 THEN 'X' ELSE 'Y' END"
    )


def genotype(j: int) -> str:
    a1 = f"CASE WHEN (k + {j * 3}) % 4 = 0 THEN 1 ELSE 0 END"
    a2 = (
        f"CASE WHEN (k * 5 + {j}) % 6 = 0 THEN "
        "(CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END) ELSE 0 END"
    )
    return (
        f"CASE WHEN (k + {j}) % 13 = 0 THEN '.' "
        f"WHEN k % 24 = 23 THEN CAST({a1} AS STRING) "
        f"ELSE concat(CAST({a1} AS STRING), '|', CAST({a2} AS STRING)) END"
    )


SITE = f"""
SELECT k, priority, status, reference_name, start_position,
       start_position + length(reference_bases) AS end_position,
       concat('rs', CAST(k AS STRING)) AS id, reference_bases, alternate_bases,
       '100' AS qual, 'PASS' AS filter,
       CAST(floor(start_position / 62500) AS INT) AS bin_id
FROM (
  SELECT o_orderkey AS k, o_orderpriority AS priority, o_orderstatus AS status,
         {chrom("o_orderkey")} AS reference_name,
         CAST(o_orderkey * 7919 % 250000000 AS BIGINT) AS start_position,
         CASE WHEN o_orderkey % 10 = 9 THEN 'AC'
              ELSE substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) END AS reference_bases,
         CASE WHEN o_orderkey % 7 = 0 THEN 'GA,T' WHEN o_orderkey % 11 = 0 THEN '<CN2>'
              ELSE substr('CGTA', CAST(o_orderkey % 4 + 1 AS INT), 1) END AS alternate_bases
  FROM {{orders}}
) AS base"""

KEY = "reference_name, start_position, end_position, reference_bases, alternate_bases"
SITE_COLUMNS = (
    "reference_name, start_position, end_position, id, reference_bases, "
    "alternate_bases, qual, filter"
)


def half(samples: list[str], absent: str) -> str:
    cells = ", ".join(f"{genotype(int(s[1:]))} AS {s}" for s in samples)
    return (
        f"SELECT {SITE_COLUMNS}, {cells}, bin_id FROM ({SITE}) AS site "
        f"WHERE priority <> '{absent}'"
    )


def gnomad_info() -> str:
    def frequency(o: int) -> str:
        at = f"(k + {o}) % 4"
        return (
            f"CASE WHEN {at} = 0 THEN '0.25' WHEN {at} = 1 THEN '1.5e-03' "
            f"WHEN {at} = 2 THEN '0.5' WHEN k % 3 = 0 THEN '.' ELSE '0.75' END"
        )

    multi = "k % 7 = 0"
    return (
        f"concat('AC=', CAST(k % 50 AS STRING), "
        f"CASE WHEN {multi} THEN concat(',', CAST(k % 30 AS STRING)) ELSE '' END, "
        f"';AF=', {frequency(0)}, "
        f"CASE WHEN {multi} THEN concat(',', {frequency(1)}) ELSE '' END, ';AN=100')"
    )


def wellderly_info() -> str:
    multi = "k % 7 = 0"
    return (
        "concat('t0;t1;t2;t3;t4;t5;t6;', reference_bases, '-0.75,', "
        f"CASE WHEN {multi} THEN 'GA-0.15,T-0.10' ELSE concat(alternate_bases, '-0.25') END, "
        "';', reference_bases, '-150,', "
        f"CASE WHEN {multi} THEN 'GA-30,T-20' ELSE concat(alternate_bases, '-50') END)"
    )


def pop_arrays() -> str:
    counts = [f"(k + {i}) % 3" for i in range(5)] * 2
    arrays = ", ".join(
        f"{{array}}({c}) AS {n}" for c, n in zip(counts, ARRAY_NAMES, strict=True)
    )
    total = " + ".join(counts)
    return (
        "SELECT start_position AS {q}start{q}, end_position AS {q}end{q}, "
        f"reference_bases, alternate_bases, {arrays}, "
        f"{{array}}({total} + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS {{q}}AC{{q}} "
        f"FROM ({SITE}) AS site"
    )


def hot(parts: int, own: int, name: str) -> str:
    """Sites keyed by number; the rows whose number leaves `own` share the key of site 1 or 2."""
    shared = own + 1
    other = 2 - own
    return (
        f"SELECT CASE WHEN k % 7 = 6 THEN NULL ELSE '1' END AS reference_name, "
        f"CAST(CASE WHEN k % {parts} = {own} THEN {shared} WHEN k % 1000 = 5 THEN {other} + k - k "
        f"ELSE k + 10 END AS BIGINT) AS start_position, CAST(1 AS BIGINT) AS end_position, "
        f"'A' AS reference_bases, 'C' AS alternate_bases, k AS {name} FROM ({SITE}) AS site "
        f"WHERE k % {parts} = {own} OR k % 1000 <> 5 OR k = 5"
    )


def samples() -> str:
    """One row per customer: a family with two members in each half."""
    label = " ".join(
        f"WHEN c_nationkey % 5 = {i} THEN '{p}'" for i, p in enumerate(POPULATION_OF)
    )
    name = "CAST(c_custkey AS STRING)"
    return (
        f"SELECT CASE {label} END AS {{q}}SuperPopulation{{q}}, "
        f"concat('a', {name}, ',b', {name}) AS {{q}}Half1{{q}}, "
        f"concat('c', {name}, ',d', {name}) AS {{q}}Half2{{q}} FROM {{customer}}"
    )


def metadata() -> str:
    """One row per region: the samples of the two halves."""
    label = " ".join(f"WHEN r_regionkey = {i} THEN '{p}'" for i, p in enumerate(POPULATION_OF))

    def pair(first: int, second: int) -> str:
        one = " ".join(
            f"WHEN r_regionkey = {r} THEN 's{r + first:02d},s{r + second:02d}'" for r in range(5)
        )
        return f"CASE {one} END"

    return (
        f"SELECT CASE {label} END AS {{q}}SuperPopulation{{q}}, {pair(1, 6)} AS {{q}}Half1{{q}}, "
        f"{pair(11, 16)} AS {{q}}Half2{{q}} FROM {{region}}"
    )


FIXTURES = {
    "site": SITE,
    "half1": half(SAMPLES1, "5-LOW"),
    "half2": half(SAMPLES2, "1-URGENT"),
    "ann": f"SELECT {KEY}, CAST(k % 100 AS DOUBLE) / 100 AS score, "
    f"concat('note', CAST(k AS STRING)) AS note FROM ({SITE}) AS site WHERE status = 'F'",
    # The empty-reference form of every two-base site, for insertions.
    "ann_ins": f"SELECT {KEY}, CAST(k % 100 AS DOUBLE) / 100 AS score FROM ({SITE}) AS site "
    "WHERE status = 'F' UNION ALL "
    "SELECT reference_name, start_position, end_position, '' AS reference_bases, "
    f"'TT' AS alternate_bases, 0.5 AS score FROM ({SITE}) AS site",
    # Variants whose alternate repeats the reference and adds two bases.
    "insertions": "SELECT reference_name, start_position, end_position, id, reference_bases, "
    f"CASE WHEN status = 'P' THEN concat(reference_bases, 'TT') ELSE alternate_bases END "
    f"AS alternate_bases FROM ({SITE}) AS site",
    "dbsnp": "SELECT reference_name AS chrm, start_position AS {q}start{q}, "
    "end_position AS {q}end{q}, reference_bases AS base, alternate_bases AS alt, id AS {q}ID{q} "
    f"FROM ({SITE}) AS site WHERE status <> 'O' UNION ALL "
    "SELECT reference_name AS chrm, start_position + 5 AS {q}start{q}, "
    "end_position + 5 AS {q}end{q}, reference_bases AS base, alternate_bases AS alt, id AS {q}ID{q} "
    f"FROM ({SITE}) AS site WHERE status = 'F' UNION ALL "
    # Other alternates at the same place, and rows without an id.
    "SELECT reference_name AS chrm, start_position AS {q}start{q}, end_position AS {q}end{q}, "
    "reference_bases AS base, 'TTT' AS alt, CASE WHEN priority = '2-HIGH' THEN '.' ELSE id END AS {q}ID{q} "
    f"FROM ({SITE}) AS site WHERE status = 'P'",
    # A third of the rows of each side share a key that the other side holds but once, and
    # some keys are null.
    "hot_left": hot(3, 0, "x"),
    "hot_right": hot(3, 1, "y"),
    "half2_shared": half(["s10", *SAMPLES2], "1-URGENT"),
    # The `T` of the alternate lists, in rows of their own.
    "half1_t": f"SELECT {SITE_COLUMNS.replace('alternate_bases', chr(39) + 'T' + chr(39) + ' AS alternate_bases')}, "
    f"{', '.join(SAMPLES1)}, bin_id FROM ({half(SAMPLES1, '5-LOW')}) AS h WHERE alternate_bases = 'GA,T'",
    "far": f"SELECT {KEY.replace('start_position', 'start_position + 1125899906842624 AS start_position', 1)} "
    f"FROM ({SITE}) AS site",
    # Variants of up to a chromosome's length, and ends that no chromosome has.
    "long": "SELECT reference_name, start_position, CASE WHEN k % 13 = 0 THEN start_position + 250000000 "
    "WHEN k % 17 = 0 THEN start_position + 3000000 WHEN k % 19 = 0 THEN 1152921504606846976 "
    f"ELSE end_position END AS end_position, id, reference_bases, alternate_bases FROM ({SITE}) AS site",
    "gnomad_odd": "SELECT reference_name, start_position, end_position, reference_bases, "
    "'C' AS alternate_bases, k, CASE k % 9 WHEN 0 THEN 'AC=3000000000;AF=1.2E-05' "
    "WHEN 1 THEN 'XAF=0.9;AC=1;AF=0.5' WHEN 2 THEN 'AC=1' WHEN 3 THEN 'AF=0.5' "
    "WHEN 4 THEN 'AC=1;AF=0.5,0.5' WHEN 5 THEN 'AC=1;AF=0.5x' WHEN 6 THEN 'AC=1.5;AF=0.5' "
    f"WHEN 7 THEN 'AC=1,2;AF=0.1,0.2' ELSE 'AC=1;AF=.' END AS info FROM ({SITE}) AS site",
    # Two transcripts per gene; a gene covers four million bases.
    "genes": "SELECT concat('GENE', CAST(n_nationkey AS STRING)) AS name2, "
    f"{chrom('n_nationkey')} AS reference_name, "
    "CAST(n_nationkey AS BIGINT) * 4000000 AS start_position, "
    "CAST(n_nationkey AS BIGINT) * 4000000 + 2500000 AS end_position FROM {nation} UNION ALL "
    "SELECT concat('GENE', CAST(n_nationkey AS STRING)) AS name2, "
    f"{chrom('n_nationkey')} AS reference_name, "
    "CAST(n_nationkey AS BIGINT) * 4000000 + 2000000 AS start_position, "
    "CAST(n_nationkey AS BIGINT) * 4000000 + 3999999 AS end_position FROM {nation} UNION ALL "
    # A gene with a dash that is also known on a haplotype contig.
    "SELECT 'HLA-A' AS name2, CASE n_nationkey WHEN 0 THEN '6' ELSE '6_apd_hap1' END AS reference_name, "
    "CAST(29000000 AS BIGINT) AS start_position, CAST(99000000 AS BIGINT) AS end_position "
    "FROM {nation} WHERE n_nationkey < 2",
    "samples": samples(),
    "metadata": metadata(),
    "gnomad_raw": f"SELECT {KEY}, qual, {gnomad_info()} AS info FROM ({SITE}) AS site",
    "wellderly_raw": f"SELECT {KEY}, qual, {wellderly_info()} AS info FROM ({SITE}) AS site",
    "thousand_raw": f"SELECT {KEY}, CAST(k % 100 AS DOUBLE) / 100 AS af, "
    f"CAST(k % 200 AS BIGINT) AS ac FROM ({SITE}) AS site",
    "standard": f"SELECT {KEY}, CAST(k % 100 AS DOUBLE) / 100 AS minor_af, "
    f"CAST(k % 200 AS BIGINT) AS allele_count FROM ({SITE}) AS site",
    "pop_arrays": pop_arrays(),
    "published": "SELECT reference_name, start_position AS {q}start{q}, "
    "end_position AS {q}end{q}, reference_bases, {split}(alternate_bases, ',') AS alternate_bases, "
    f"CAST(k % 200 AS BIGINT) AS {{q}}AC{{q}} FROM ({SITE}) AS site",
    # Raw VCF text, with the mistakes that validation looks for.
    "raw": "SELECT CASE WHEN priority = '3-MEDIUM' AND status = 'F' THEN concat('chr', reference_name) "
    "ELSE reference_name END AS reference_name, "
    "CASE WHEN priority = '2-HIGH' AND status = 'P' THEN concat(CAST(start_position AS STRING), 'a') "
    "ELSE CAST(start_position AS STRING) END AS pos, id, "
    "CASE WHEN priority = '5-LOW' AND status = 'O' THEN 'N' ELSE reference_bases END AS ref, "
    f"alternate_bases AS alt, qual, filter FROM ({SITE}) AS site",
}
TABLES = ["orders", "customer", "nation", "region"]
SPARK = {"q": "`", "array": "array", "split": "split"}
DUCKDB = {"q": '"', "array": "list_value", "split": "string_split"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the parquet tables in `sf_dir`."""
    text = FIXTURES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    for key, value in SPARK.items():
        text = text.replace(f"{{{key}}}", value)
    return spark.sql(text, **used)


def duckdb_sql(name: str) -> str:
    """The fixture as DuckDB SQL over the registered views."""
    return FIXTURES[name].format(**DUCKDB, **{t: t for t in TABLES})


def ctes(*names: str) -> str:
    """A WITH clause that defines the named fixtures."""
    return "WITH " + ", ".join(f"{n} AS ({duckdb_sql(n)})" for n in names)
