"""Candidates, staleness, priorities, the order of work, and merging run results into the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.fixed import GOOD_OUTCOMES, LANE_PATTERNS, PRIORITY_TIERS, TIER_LANES, TOP_RANK
from weftline.functions import scalars as S


def candidates(corpus: DataFrame, snapshot: DataFrame, forced: DataFrame) -> DataFrame:
    """Corpus names (name, place) found in the snapshot, at their first place, with forced names beside them."""
    key = S.normal_name(F.col("name"))
    first = corpus.groupBy(key.alias("key")).agg(F.min("place").alias("place"))
    wanted = first.join(forced.select(key.alias("key"), F.lit(True).alias("forced")).distinct(), "key", "full").select("key", "place", F.coalesce("forced", F.lit(False)).alias("forced"))
    return snapshot.withColumn("key", key).join(wanted, "key")


def staleness(wanted: DataFrame, recorded: DataFrame, revision: str, schema: int, latest: bool = False) -> DataFrame:
    """wanted (name, version) with the state of the record of that very version: never, revision, schema or fresh, looked at in this
    order. latest: of the name's newest record, which may also be of another version (newer)."""
    r = recorded.select("name", F.col("version").alias("recorded_version"), "parser_revision", "schema_version")
    if latest:
        newest = F.max(F.struct(S.semver(F.col("recorded_version")).alias("key"), F.struct("recorded_version", "parser_revision", "schema_version").alias("r")))
        joined = wanted.join(r.groupBy("name").agg(newest.alias("m")).select("name", "m.r.*"), "name", "left")
    else:
        joined = wanted.join(r.withColumn("version", F.col("recorded_version")), ["name", "version"], "left")
    state = (
        F.when(F.col("recorded_version").isNull(), "never")
        .when(F.col("recorded_version") != F.col("version"), "newer")
        .when(F.col("parser_revision") != revision, "revision")
        .when(F.col("schema_version") != schema, "schema")
        .otherwise("fresh")
    )
    return joined.withColumn("state", state)


def priority(state: Column, forced: Column, rank: Column, mode: str = "daily") -> Column:
    """The tier of an item; null for fresh ones. Only backfill plans tell the long tail from other packages never parsed."""
    top = F.coalesce(rank <= TOP_RANK, F.lit(False))
    never = F.when(top, "never-parsed-backfill").otherwise("long-tail-backfill") if mode == "backfill" else F.lit("never-parsed-backfill")
    return (
        F.when(forced, "forced")
        .when(state.isin("revision", "schema"), F.when(top, "top-download-stale").otherwise("catalog-stale"))
        .when(state == "newer", F.when(top, "newer-version").otherwise("catalog-newer"))
        .when(state == "never", never)
    )


def tier_order(tier: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in PRIORITY_TIERS]), tier), F.lit(99)).cast("int")


def lane(tier: Column) -> Column:
    """popular 0, catalog 1, backfill 2; forced ones are in none, -1."""
    return F.coalesce(*[F.when(tier == t, k) for t, k in TIER_LANES.items()])


def _keyed(work: DataFrame) -> DataFrame:
    """With the lane (forced ones in one of their own, -1) and what items of a lane are ordered by, before name and version."""
    return work.withColumns({"lane": lane(F.col("tier")), "tier_rank": tier_order(F.col("tier")), "rank_key": F.coalesce("download_rank", F.lit(2**31 - 1))})


def first_of_lanes(work: DataFrame, cap: int) -> DataFrame:
    """work without most of what can't be among the first ``cap`` of its lane. Items are counted by steps of the order (combined before
    the shuffle); steps beyond the one in which a lane's count reaches the cap go, so that no more than the cap and a
    step of any lane is ever brought together. Items without a rank are counted by the first characters of their names."""
    keyed = _keyed(work).withColumn("step", F.struct("tier_rank", (F.col("rank_key") / 256).cast("int").alias("ranks"), F.when(F.col("download_rank").isNull(), F.substring("name", 1, 4)).alias("names")))
    counts = keyed.groupBy("lane", "step").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lane").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where(F.col("before") < cap).groupBy("lane").agg(F.max("step").alias("last"))
    return keyed.join(F.broadcast(last), "lane").where(F.col("step") <= F.col("last")).select(*work.columns)  # a row for each lane


def fair_order(work: DataFrame, mode: str = "daily") -> DataFrame:
    """work (name, version, tier, download_rank) with its place: forced ones first, then the lanes by their slots in
    a repeating pattern. An empty lane's slots are skipped, which never reorders the others, so the place of a lane's r-th
    item is known alone: (r div slots, slot[r mod slots])."""
    order = Window.partitionBy("lane").orderBy("tier_rank", "rank_key", "name", "version")
    ranked = _keyed(work).withColumn("r", F.row_number().over(order) - 1).drop("rank_key")
    cycle, slot = F.when(F.col("lane") < 0, F.col("r")), F.lit(-1)
    for k in sorted(set(LANE_PATTERNS[mode])):
        slots = [i for i, x in enumerate(LANE_PATTERNS[mode]) if x == k]
        cycle = cycle.when(F.col("lane") == k, F.floor(F.col("r") / len(slots)))
        slot = F.when(F.col("lane") == k, F.get(F.array(*map(F.lit, slots)), F.pmod("r", F.lit(len(slots))).cast("int"))).otherwise(slot)
    return ranked.withColumns({"forced_first": F.when(F.col("lane") < 0, 0).otherwise(1), "cycle": cycle.cast("bigint"), "slot": slot})


def select_work(work: DataFrame, cap: int, mode: str = "daily") -> DataFrame:
    """The first ``cap`` of the fair order. No lane can give more than that, so lanes are cut to about as many before they are ranked."""
    return fair_order(first_of_lanes(work, cap), mode).where(F.col("r") < cap).orderBy("forced_first", "cycle", "slot", "lane").limit(cap)


def satisfied(plan: DataFrame, freshness: DataFrame) -> DataFrame:
    """plan (name, version, reason, planned_at, tier) with whether the record of that very version meets it. Without one it is open. A parser or
    schema that the reason names is met by a record of it, or one parsed since the plan was made; a first parse or a newer
    version by any record; all else by one parsed since, or by any if the plan has no time."""
    f = freshness.select("name", "version", F.col("parser_revision").alias("f_revision"), F.col("schema_version").alias("f_schema"), F.col("parsed_at").alias("f_parsed"), F.lit(True).alias("there"))
    revision, schema = S.parser_target(F.col("reason")), S.schema_target(F.col("reason"))
    since = F.coalesce(F.col("f_parsed") >= F.col("planned_at"), F.lit(False))
    any_record = F.col("tier").isin("never-parsed-backfill", "newer-version") | F.col("reason").contains("never parsed") | F.col("reason").contains("crates.io")
    met = (
        F.when(F.col("there").isNull(), False)
        .when(revision.isNotNull(), S.revision_matches(F.col("f_revision"), revision) | since)
        .when(schema.isNotNull(), F.coalesce(F.col("f_schema") == schema, F.lit(False)) | since)
        .when(F.coalesce(any_record, F.lit(False)) | F.col("planned_at").isNull(), True)
        .otherwise(since)
    )
    return plan.join(f, ["name", "version"], "left").withColumn("satisfied", met).drop("there")


def shard_counts(work: DataFrame, shards: int) -> DataFrame:
    """Items by shard, empty shards included."""
    n = work.groupBy(S.work_bucket(F.col("work_id"), shards).alias("shard")).count()
    all_ = work.sparkSession.range(shards).select(F.col("id").alias("shard"))
    return all_.join(n, "shard", "left").select("shard", F.coalesce("count", F.lit(0)).alias("n"))


def run_summary(deltas: DataFrame) -> DataFrame:
    """By shard and in all: items, those published or bumped to a new parser, fresh, failed."""
    return deltas.rollup("shard").agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("outcome").isin("published", "parser-bumped")).alias("published"),
        F.count_if(F.col("outcome") == "fresh").alias("fresh"),
        F.count_if(~F.col("outcome").isin(*GOOD_OUTCOMES)).alias("failed"),
    )


def merge_deltas(index: DataFrame, deltas: DataFrame) -> DataFrame:
    """index (name, version, graph_hash, nodes, tier) with a run's deltas (same and outcome, error, seq) folded in: any success
    clears the failure, and the last values that successes know win; a failure keeps the old values and sets itself. Tiers come from either. Keys that are
    new get what the deltas know, or an empty hash; a failure without a text has an empty one."""
    good = F.col("outcome").isin(*GOOD_OUTCOMES)
    last = lambda c, of: F.max_by(c, F.when(F.col(c).isNotNull() & of, F.col("seq")))
    d = deltas.groupBy("name", "version").agg(
        F.max(F.when(good, F.col("seq"))).alias("ok_seq"), F.max("seq").alias("last_seq"), F.max_by("outcome", "seq").alias("outcome"), F.max_by("error", "seq").alias("error"),
        *[last(c, good).alias(f"d_{c}") for c in ("graph_hash", "nodes")], last("tier", F.lit(True)).alias("d_tier"),
    )
    merged = index.join(d, ["name", "version"], "full")
    failed = F.coalesce(F.col("last_seq").isNotNull() & ((F.col("ok_seq").isNull()) | (F.col("ok_seq") < F.col("last_seq"))), F.lit(False))
    return merged.select(
        "name", "version",
        F.coalesce("d_graph_hash", "graph_hash", F.lit("")).alias("graph_hash"), F.coalesce("d_nodes", "nodes").alias("nodes"), F.coalesce("d_tier", "tier").alias("tier"),
        F.when(failed, F.col("outcome")).alias("failure"), F.when(failed, F.coalesce("error", F.lit(""))).alias("failure_error"),
    )


def stale_failures(failed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Failed entries without a current record."""
    return failed.join(fresh.select("name", "version"), ["name", "version"], "left_anti")



def already_handled(plan: DataFrame, status: DataFrame) -> DataFrame:
    """plan (name, version, reason, planned_at, satisfied) with handled: under way, met, failed since, or ready since if the plan doesn't name
    a parser or schema to get to. A status counts as later where one of the times isn't known. status: name, version, status, updated_at."""
    newer = F.coalesce(F.col("updated_at") >= F.col("planned_at"), F.lit(True))
    target = S.parser_target(F.col("reason")).isNotNull() | S.schema_target(F.col("reason")).isNotNull()
    is_ = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    handled = is_("processing") | F.col("satisfied") | is_("failed") & newer | is_("ready") & newer & ~target
    return plan.join(status, ["name", "version"], "left").withColumn("handled", handled)


def latest_plan(plans: DataFrame) -> DataFrame:
    """The plan (key, run, uploaded) uploaded last; of equals the one of the higher run and attempt (numbers before other names), then key."""
    number = lambda i: F.regexp_extract("run", r"^(\d+)-(\d+)$", i).try_cast("bigint")
    return plans.orderBy(F.desc_nulls_last("uploaded"), F.desc_nulls_last(number(1)), F.desc_nulls_last(number(2)), F.desc("run"), F.desc("key")).limit(1)


def manifest_choice(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, name) to the path of its manifest: the shortest that names the package, else the shortest of any package, else the root's.
    manifests: source, path, package."""
    rule = F.when(F.col("package") == F.col("name"), 0).when(F.col("package").isNotNull(), 1).when(F.col("path") == "Cargo.toml", 2).otherwise(3)
    return manifests.join(wanted, "source").groupBy("source", "name").agg(F.min_by("path", F.struct(rule, F.length("path"), "path")).alias("path"))


def root_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """source and the first of its candidates that is a file: the library's path, the binaries', or else the usual two. manifests: source, folder,
    lib, bins (array of paths); files: source, path."""
    under = lambda x: F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), x)
    usual = F.when(F.col("lib").isNull() & (F.size("bins") == 0), F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))).otherwise(F.array().cast("array<string>"))
    candidates = F.concat(F.array_compact(F.array("lib")), "bins", usual)
    tries = manifests.select("source", "folder", F.posexplode(candidates).alias("place", "file")).select("source", "place", under(F.col("file")).alias("path"))
    return tries.join(files, ["source", "path"], "left_semi").groupBy("source").agg(F.min_by("path", "place").alias("path"))
