"""What the operators share: tables, the shared folder, sized joins, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a table's rows, as text, and rows that are broadcast at most (a hashed relation of some 32 MB).
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session (one JVM, as in tests) may leave it unset; a folder under /tmp then takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster sees")
        root = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/gridloom/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, codec: str = "zstd", parts: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and survives executors.

    ``parts`` bounds the files of tables that are small by nature (rows for sources, benchmark items).
    """
    path = scratch(df.sparkSession, label)
    df = df.coalesce(parts) if parts else df
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a file of a table that may be small.
FILE_ROWS = 200_000


def compact(df: DataFrame, label: str) -> DataFrame:
    """``stored`` in as few files as its rows need: computed in parallel and cached, counted, then written."""
    df = df.persist()
    parts = -(-df.count() // FILE_ROWS)
    out = stored(df, label, parts=max(1, parts))
    df.unpersist()
    return out


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (a written table) has at most so many rows, and bytes of them written out as text, arrays included."""
    n, text = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= rows and text <= size


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows and bytes allow it, else left to a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def ranged(df: DataFrame, order: list[str], label: str = "ranged") -> DataFrame:
    """``df`` dealt by ranges of ``order`` (nulls last) and stored, with the range's number: range_."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(ranges, *(F.col(c).asc_nulls_last() for c in order)).withColumn("range_", F.spark_partition_id()), label)


def beside(df: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``per``, which has one row for each value of ``keys``; nulls are equal."""
    per = per.select(*(F.col(c).alias(f"{c}__") for c in keys), *(c for c in per.columns if c not in keys))
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"{c}__"))
    return df.join(sized(per), same).drop(*(f"{c}__" for c in keys))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``df`` (of ``ranged`` by ``by`` and ``order``) with running sums along ``order``, unique inside ``by``, up to each row.

    Rows are summed inside their range; a range then adds what the ranges before it have, a row for
    each range and group that it touches. So no task gets more than a range, however many rows a group has.
    """
    by = by or []
    along = [F.col(c).asc_nulls_last() for c in order]
    inside = Window.partitionBy(*by, "range_").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "range_").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    totals = stored(totals.select(*by, "range_", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in sums)), "range-sums", parts=4)
    out = beside(df.select("*", *(F.sum(c).over(inside).alias(n) for n, c in sums.items())), totals, [*by, "range_"])
    return out.select(*df.columns, *((F.col(n) + F.col(f"before_{n}")).alias(n) for n in sums))


def components(edges: DataFrame, label: str = "components", max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node.

    Rounds in which every node's grandparent label is offered to its neighbours and to their
    parents (so whole trees are hooked at once); the number of rounds grows with the logarithm of
    the longest path. Each round is written to the shared folder. Nothing is gathered at the
    driver but whether something changed. Null ends are ignored, loops and repeated edges are harmless,
    and an empty table gives an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = compact(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    state = compact(least.select("node", F.least("node", "m").alias("component")), label)
    for _ in range(max_rounds):
        up = state.select(F.col("node").alias("component"), F.col("component").alias("g"))
        grand = state.join(up, "component").select("node", "component", "g")
        offers = both.join(grand.select(F.col("node").alias("b"), F.col("g")), "b").groupBy("a").agg(F.min("g").alias("g"))
        offers = offers.join(state.select(F.col("node").alias("a"), "component"), "a")
        heard = offers.select(F.explode(F.array("a", "component")).alias("node"), "g").unionByName(grand.select("node", "g"))
        heard = heard.groupBy("node").agg(F.min("g").alias("g"))
        nxt = state.join(heard, "node").select("node", F.least("component", "g").alias("component"), (F.col("g") < F.col("component")).alias("moved"))
        nxt = compact(nxt, label)
        dropped(edges.sparkSession, state)
        state = nxt.select("node", "component")
        state.scratch_path = nxt.scratch_path
        if not nxt.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    dropped(edges.sparkSession, both)
    return state
