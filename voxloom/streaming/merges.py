"""Merge tables and block metrics that grow while blocks finish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from voxloom.operators.graph import connected_components
from voxloom.plans.durable import durable

#: Runs of a level that make one of the next.
FAN = 8
ROWS = "node bigint, component bigint, v int"


def levels(end: int, fan: int = FAN) -> list[tuple[int, int]]:
    """[0, ``end``) in aligned blocks of batches, (first, last), the largest before: at most ``fan`` - 1 of a size."""
    out, at, width = [], 0, 1
    while width * fan <= end:
        width *= fan
    while at < end:
        while at + width > end:
            width //= fan
        out.append((at, at + width - 1))
        at += width
    return out


class MergeTable:
    """The current (node, component) table under ``path``, as a log of what each batch changed.

    A batch looks up the roots of the nodes that its edges touch, finds components of those
    alone, and writes the new rows of the components that changed; a node's row of the latest
    batch holds. A batch that runs again writes its rows again, from the batches before it.

    The log is kept in levels: a batch writes a run, and before batch k the runs before it are merged into
    those of ``levels(k)``, each with a node's latest row alone. So a table of k batches is read from
    O(log k) runs, and a row is written again O(log k) times. A run is laid out twice, by hash buckets of the
    node and of the component; a batch reads the buckets that its nodes and roots fall into. A run counts
    when its ``_SUCCESS`` is there, and hides those it covers, which are deleted before the batch after; only
    batches before the present one, which a stream has committed, are ever merged.

    ``read(before=k)`` gives the table as it was before a batch while no run reaches across k.
    Opened again, a table keeps the number of ``buckets`` that it was made with, or raises.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, fan: int = FAN):
        self.spark, self.path, self.buckets, self.fan = spark, path.rstrip("/"), buckets, fan
        other = {n for n in self._names(self.path) if n.startswith("of=")} - {f"of={buckets}"}
        if other:
            raise ValueError(f"the table at {path} has other buckets: {sorted(other)}")

    # Folders, by the file system that Spark itself uses for the path.

    def _fs(self, folder: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _base(self, by: str) -> str:
        return f"{self.path}/of={self.buckets}/by={by}"

    def _folder(self, by: str, run: tuple[int, int]) -> str:
        return f"{self._base(by)}/run={run[0]:012d}-{run[1]:012d}"

    def _whole(self, run: tuple[int, int]) -> bool:
        """Both layouts are there to the end; the one by component is written last."""
        fs, p = self._fs(f"{self._folder('component', run)}/_SUCCESS")
        return fs.exists(p)

    def runs(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(runs that count, runs that those cover): batches (first, last), ascending."""
        named = [tuple(int(x) for x in n.removeprefix("run=").split("-")) for n in self._names(self._base("component")) if n.startswith("run=")]
        found = sorted((r for r in named if self._whole(r)), key=lambda r: (r[0], -r[1]))
        count, covered = [], []
        for r in found:
            (covered if count and r[1] <= count[-1][1] else count).append(r)
        return count, covered

    def _rows(self, by: str, runs: list[tuple[int, int]], touched: list[int] | None = None) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], ROWS)
        out = self.spark.read.schema(f"{ROWS}, run string, bucket int").option("basePath", self._base(by)).parquet(*(self._folder(by, r) for r in runs))
        if touched is not None:
            out = out.where(F.col("bucket").isin(touched))
        return out.select("node", "component", "v")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that ``rows`` fall into: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self._bucket(key)).distinct().collect())

    def _drop(self, by: str, run: tuple[int, int]) -> None:
        fs, p = self._fs(self._folder(by, run))
        fs.delete(p, True)

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        """A bucket is as many files as its size asks for: one component may hold most rows."""
        self._drop("component", run)  # what told that the run is whole
        rows = rows.select(F.col("node").cast("bigint"), F.col("component").cast("bigint"), F.col("v").cast("int"))
        for by in ("node", "component"):
            laid = rows.withColumn("bucket", self._bucket(by)).hint("rebalance", "bucket")
            laid.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(by, run))

    # The table.

    def log(self, before: int | None = None) -> DataFrame:
        """(node, component, v): the rows of all runs, or of those of batches before one."""
        return self._rows("node", [r for r in self.runs()[0] if before is None or r[1] < before])

    @staticmethod
    def latest(rows: DataFrame) -> DataFrame:
        """(node, component) of each node's latest batch."""
        return rows.groupBy("node").agg(F.max_by("component", "v").alias("component"))

    def read(self, before: int | None = None) -> DataFrame:
        """The table now, or as it was before a batch."""
        if before is not None and any(first < before <= last for first, last in self.runs()[0]):
            raise ValueError(f"batches before {before} are merged with later ones")
        return self.latest(self.log(before))

    def compact(self, end: int) -> None:
        """Merge the runs of batches before ``end`` into those of ``levels(end)``; what was covered goes."""
        count, covered = self.runs()
        for r in covered:
            self._drop("node", r)
            self._drop("component", r)
        for block in levels(end, self.fan):
            own = [r for r in count if block[0] <= r[0] and r[1] <= block[1]]
            if len(own) > 1:
                both = self._rows("node", own).groupBy("node").agg(F.max_by("component", "v").alias("component"), F.max("v").alias("v"))
                self._write(both, block)

    def _of_nodes(self, runs: list[tuple[int, int]], nodes: DataFrame) -> DataFrame:
        """The latest rows of ``nodes``, from the buckets that they fall into."""
        rows = self._rows("node", runs, self._touched(nodes, "node"))
        return self.latest(rows.join(nodes, "node", "left_semi"))

    def apply(self, edges: DataFrame, batch: int) -> None:
        """Merge a batch's edges into the table; one that is merged with later batches already has nothing to add."""
        if any(first <= batch <= last and first < last for first, last in self.runs()[0]):
            return
        self.compact(batch)
        runs = [r for r in self.runs()[0] if r[1] < batch]
        ends = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
        ends = durable(ends.where("src is not null and dst is not null"))
        met = durable(self._of_nodes(runs, ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct()))
        rooted = ends
        for c in ("src", "dst"):
            rooted = rooted.join(met.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        moved = durable(connected_components(rooted))
        # A root that moves takes along all that hang on it; those that once did may hang elsewhere by now.
        changed = moved.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("_new"))
        hung = self._rows("component", runs, self._touched(changed, "component"))
        maybe = durable(hung.join(changed.select("component"), "component", "left_semi").select("node").distinct())
        old = self._of_nodes(runs, maybe).join(changed, "component").select("node", F.col("_new").alias("component"))
        new = moved.join(met.select("node"), "node", "left_anti").join(old.select("node"), "node", "left_anti").select("node", "component")
        # A root that stays is in the table already, unless it is new itself.
        known = self._of_nodes(runs, new.select("node")).select("node")
        out = old.unionByName(new.join(known, "node", "left_anti")).withColumn("v", F.lit(batch))
        self._write(durable(out), (batch, batch))

    def stream(self, edges: DataFrame, checkpoint: str) -> DataStreamWriter:
        """``edges``: a streaming (src, dst)."""
        return edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: self.apply(df, batch))


def stream_performance(blocks: DataFrame, path: str, checkpoint: str, threshold: float = 0.5) -> DataStreamWriter:
    """Metrics of each arriving batch of scored voxels (p, t), written under its batch."""
    from voxloom.operators.metrics import performance

    def one(df: DataFrame, batch: int) -> None:
        performance(df, threshold).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return blocks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
