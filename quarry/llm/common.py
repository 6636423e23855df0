"""Helpers shared by the corpus operators: stored tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_local_root: list[str] = []
_marked: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder will do if executors are threads of
    the driver; on a cluster, where each would write to its own disk, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="quarry-"))
    return "file://" + _local_root[0]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a cut in the lineage that outlives executors.

    The application's folder is deleted when it ends, and before by scratch or release.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/quarry-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        _marked.add(folder)
        system, at = _file_system(spark, folder)
        system.mkdirs(at)
        system.deleteOnExit(at)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quarry_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _written.remove(path)
    system, at = _file_system(spark, path)
    system.delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    if (path := getattr(df, "quarry_path", None)) in _written:
        _delete(df.sparkSession, path)


def release(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete every stored table of this process but those to keep; results that still read them must be written first."""
    for path in [p for p in _written if p not in set(keep)]:
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """with scratch(spark): what operators store within is deleted at the end; write results before."""
    before = list(_written)
    try:
        yield
    finally:
        release(spark, before)


def unused(columns: Iterable[str], name: str) -> str:
    """The name, with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is the component_id of groups (id_col, component_id), one an id: the one with the least hash of all columns; and those without an id."""
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    rows = docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi")
    if not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        rows = rows.groupBy(F.col(id_col).alias("__kept")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")).select("__row.*")
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels 0..n-1 of the components of the graph with edges a-b; each label is the smallest member."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la[apart], lb[apart]), np.minimum(la[apart], lb[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


class Union:
    """Edges over n nodes, kept as a spanning forest whatever their number."""

    def __init__(self, n: int, room: int = 1 << 20):
        self.n, self.room, self.held, self.edges = n, room, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.edges.append((a, b))
            self.held += len(a)
            if self.held > self.room + self.n:
                label = self.labels()
                rest = np.flatnonzero(label != np.arange(self.n))
                self.edges, self.held = [(rest, label[rest])], len(rest)

    def labels(self) -> np.ndarray:
        if not self.edges:
            return np.arange(self.n)
        return forest(self.n, np.concatenate([x for x, _ in self.edges]), np.concatenate([y for _, y in self.edges]))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until
    the edges stay the same. Each step is a join and a min aggregation with a
    map-side combine; a hub's rows can be split by the skew join.
    """
    current = stored(edges.where("a <> b and a is not null and b is not null").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or state[0] == 0:
            break
        mark = tuple(state)
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        small = stored(small, name)
        discard(current)
        discard(large)
        current = small
    # at the fixed point every node but the root points at its root
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
