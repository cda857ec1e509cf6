"""Readers. Schemas are given, never inferred; columns that a dump may lack are filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRESENT, ABSENT = ("t", "true", "TRUE", "1"), ("f", "false", "FALSE", "0")
DELTA = "work_id string, name string, version string, outcome string, nodes bigint, edges bigint, graph_hash string, tier string, error string"
FRESHNESS = "name string, storage_name string, version string, parsed_at timestamp, parser_revision string, schema_version int, graph_hash string, nodes bigint, edges bigint"


def packages_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, name, downloads; an empty or missing number is 0."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    downloads = F.coalesce(F.nullif("downloads", F.lit("")), F.lit("0")) if "downloads" in raw.columns else F.lit("0")
    return raw.select(F.col("id").cast("bigint").alias("id"), "name", downloads.cast("bigint").alias("downloads"))


def versions_csv(spark: SparkSession, path: str, packages: DataFrame) -> DataFrame:
    """Versions of known packages. A yanked flag that is none of the known words is an error."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    yanked = F.when(F.col("yanked").isin(*PRESENT), True).when(F.col("yanked").isin(*ABSENT), False).otherwise(F.raise_error(F.concat(F.lit("yanked is "), F.coalesce("yanked", F.lit("null")))))
    column = lambda c, kind: F.nullif(c, F.lit("")).cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    rows = raw.select(F.col("package_id").cast("bigint").alias("package_id"), "num", yanked.alias("yanked"), column("created_at", "timestamp").alias("created_at"), F.coalesce(column("downloads", "bigint"), F.lit(0)).alias("downloads"))
    return rows.join(packages.select(F.col("id").alias("package_id")), "package_id", "left_semi")


def run_deltas(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a run's logs, in order of files and then of lines (seq); blank lines are skipped and a bad one is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parsed = lines.select("file", "line", F.from_json("value", DELTA, {"mode": "FAILFAST"}).alias("d"))
    return parsed.select("d.*", F.struct("file", "line").alias("seq"))


def freshness_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRESHNESS).json(path)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file, one a line, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")


def version_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The newest versions of each index file: the last lines first, without malformed and yanked ones. A small limit is applied in each task
    before a file's lines come together."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.from_json("value", "name string, vers string, yanked boolean").alias("v"))
    good = lines.where("v.vers is not null and not coalesce(v.yanked, false)")
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"), F.desc("line")))
    return good.select("v.name", F.col("v.vers").alias("version"), place.alias("place")).where(F.col("place") <= limit)


def catalog(spark: SparkSession, path: str, schema_version: int) -> DataFrame:
    rows = spark.read.schema("schema_version int, name string, version string").json(path)
    return rows.where((F.col("schema_version") == schema_version) & (F.length("version") > 0))


def workspace_nodes(members: DataFrame, externals: DataFrame) -> DataFrame:
    """One node for each id: external stubs are looked at after members, and the later wins."""
    both = members.withColumn("__o", F.lit(0)).unionByName(externals.withColumn("__o", F.lit(1)))
    return both.groupBy(F.col("id").alias("__id")).agg(F.max_by(F.struct(*members.columns), "__o").alias("r")).select("r.*")


def resolve_versions(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """requests (storage_name, wanted) to version and hash by refs (storage_name, alias_or_version, version, graph_hash)."""
    good = refs.where("trim(version) <> '' and trim(graph_hash) <> ''").select("storage_name", F.col("alias_or_version").alias("wanted"), "version", "graph_hash")
    return requests.join(good, ["storage_name", "wanted"])


def aggregate_index(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The shards that a manifest (path, rows) names; a shard that is missing or short is an error."""
    named = [r["path"] for r in manifest.select("path").collect()]  # a row for each shard file
    rows = spark.read.parquet(*named)
    wanted, found = manifest.agg(F.sum("rows")).first()[0], rows.count()
    if wanted != found:
        raise ValueError(f"the manifest names {wanted} rows; its shards hold {found}")
    return rows
