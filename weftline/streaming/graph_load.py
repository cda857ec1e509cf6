"""A graph that arrives in batches of node and edge rows, and the tree index that is kept meanwhile.

Every batch is a partition of a log, named by its number, so a batch that is run again replaces itself. What the log says doesn't
depend on how rows were cut into batches or in what order those came: of a node the row with the highest sequence number
counts, of equal edges the one with the lowest, and an edge between packages finds its ends whenever they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftline.functions import scalars as S
from weftline.shared import staged

NODE = "package string, version string, id string, name string, kind string, visibility string, is_external boolean, node_seq long"
EDGE = "package string, version string, from_id string, to_id string, kind string, confidence string, is_glob boolean, edge_seq long"
NODE_KEY, EDGE_KEY = ["package", "version", "id"], ["package", "version", "from_id", "to_id", "kind"]
BUCKETS = 16


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """One batch of the log; what an earlier attempt at it wrote is replaced."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def load(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that appends each trigger's rows to the log at ``path``; ``then`` is called with rows and number of each batch."""

    def run(rows: DataFrame, batch: int) -> None:
        if not then:
            return write_batch(rows, path, batch)
        rows.persist()
        write_batch(rows, path, batch)
        then(rows, batch)
        rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def _one(rows: DataFrame, key: list[str], choose: Callable, order: str) -> DataFrame:
    plain = [c for c in rows.columns if c != "batch"]
    values = [c for c in plain if c not in key]  # keys aren't carried twice
    return rows.groupBy(*key).agg(choose(F.struct(*values), order).alias("r")).select(*[c if c in key else F.col(f"r.{c}") for c in plain])


def loaded_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node: the last by its sequence number."""
    return _one(rows, NODE_KEY, F.max_by, "node_seq")


def loaded_edges(rows: DataFrame) -> DataFrame:
    """One row for each edge: the first by its sequence number; variants by glob or confidence are the same edge."""
    return _one(rows, EDGE_KEY, F.min_by, "edge_seq")


def is_cross() -> Column:
    return S.package_of(F.col("from_id")) != S.package_of(F.col("to_id"))


def cross_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between packages with name, kind and visibility of both ends; of an end that hasn't come yet, what its id tells."""
    found = edges.where(is_cross())
    for end in ("from", "to"):
        known = nodes.select("package", "version", *[F.col(c).alias(f"{end}_{c}") for c in ("id", "name", "kind", "visibility", "is_external")])
        found = found.join(known, ["package", "version", f"{end}_id"], "left").withColumns({
            f"{end}_known": F.col(f"{end}_name").isNotNull(), f"{end}_name": F.coalesce(f"{end}_name", S.last_segment(F.col(f"{end}_id"))),
            f"{end}_kind": F.coalesce(f"{end}_kind", F.lit("ExternCrate")), f"{end}_is_external": F.coalesce(f"{end}_is_external", F.lit(True)),
        })
    return found


def batch_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, batch: rows, those that were new when the batch came, and edges between packages. nodes, edges: logs."""
    out = []
    for part, rows, key in (("nodes", nodes, NODE_KEY), ("edges", edges, EDGE_KEY)):
        first = rows.groupBy(*key).agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new"))
        cross = F.count_if(is_cross()) if part == "edges" else F.lit(0).cast("long")
        out.append(rows.groupBy("batch").agg(F.count("*").alias("rows"), cross.alias("cross_edges")).join(first, "batch", "left").select(F.lit(part).alias("part"), "batch", "rows", F.coalesce("new", F.lit(0)).alias("new"), "cross_edges"))
    return out[0].unionByName(out[1])


# ---- tree index


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, is_node, parent, edge_seq of all ids that rows of nodes or tree edges name: the parent is that of the first edge."""
    named = nodes.select("id", F.lit(True).alias("is_node"), F.lit(None).cast("struct<edge_seq: long, parent: string>").alias("first"))
    held = edges.where("kind in ('Contains', 'Defines')").select(F.col("to_id").alias("id"), F.lit(False).alias("is_node"), F.struct(F.col("edge_seq").cast("long").alias("edge_seq"), F.col("from_id").alias("parent")).alias("first"))
    return _merged(named.unionByName(held))


def _merged(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("id").agg(F.bool_or("is_node").alias("is_node"), F.min("first").alias("first"))
    return found.select("id", "is_node", F.col("first.parent").alias("parent"), F.col("first.edge_seq").alias("edge_seq"))


def with_batch(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The index after a batch of places. Only ids of the batch are merged; a late edge that comes before the one known takes its
    place. The merge is a minimum, so batches may come in any order, twice, or cut otherwise."""
    shape = lambda df: df.select("id", "is_node", F.when(F.col("parent").isNotNull(), F.struct("edge_seq", "parent")).alias("first"))
    touched = index.join(batch.select("id"), "id", "left_semi")
    return index.join(batch.select("id"), "id", "left_anti").unionByName(_merged(shape(touched).unionByName(shape(batch))))


def roots(index: DataFrame) -> DataFrame:
    """Nodes that no tree edge leads to."""
    return index.where("is_node and parent is null").select("id")


def children(index: DataFrame) -> DataFrame:
    """parent and child, also of children whose node hasn't come yet."""
    return index.where("parent is not null").select("parent", F.col("id").alias("child"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, before, after: whose parent a batch changed; null stands for a root or an id that was unknown."""
    old = before.select("id", F.col("parent").alias("before"))
    return after.select("id", F.col("parent").alias("after")).join(old, "id", "left").where("not before <=> after").select("id", "before", "after")


def update_index(spark: SparkSession, folder: str, batch: DataFrame) -> None:
    """Write the index below ``folder`` with a batch of places: buckets that the batch doesn't touch stay as they are."""
    keyed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    touched = [r.bucket for r in keyed(batch).select("bucket").distinct().collect()]  # BUCKETS at most
    now = read_index(spark, folder).where(F.col("bucket").isin(touched)).drop("bucket")
    after = staged(keyed(with_batch(now, batch)), "index")
    after.repartition("bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    schema = "id string, is_node boolean, parent string, edge_seq long, bucket int"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
