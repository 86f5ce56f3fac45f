"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.session import ensure_checkpoint_dir

#: A side of a join is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 32 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` as a query, with SQL where there is one."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm/{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint only where ``rows`` times ``row_bytes`` stays below the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def other_columns(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of ``df`` without those of the given names, in any case."""
    gone = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in gone]


def hash_of(fields: list[T.StructField], *first: Column) -> Column:
    """A hash of a row's columns, as far as their types can be hashed."""
    return F.xxhash64(*first, *[F.col(f"`{f.name}`") for f in fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an undirected graph of integer ids.

    ``component`` is the smallest id reachable. Each round hooks every node onto
    its smallest neighbour and lets it take over what that neighbour hooked onto,
    then renames the ends of all edges; edges inside one component vanish. Both
    sides of the joins are aggregates or edge lists, so that adaptive execution
    can split a hub's rows, and minima combine before the shuffle. One table is
    written per round into the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    base = shared_folder(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    edge = keep(
        edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct(),
        "edges",
    )
    maps = []
    while not edge.isEmpty():
        n = len(maps)
        both = edge.select(F.col("x").alias("node"), F.col("y").alias("near")).union(edge.select("y", "x"))
        hook = keep(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")), f"hook{n}")
        jump = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
        hook = keep(
            hook.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"map{n}"
        )
        maps.append(hook)
        to_x = hook.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        to_y = hook.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edge = keep(
            edge.join(to_x, "x")
            .join(to_y, "y")
            .select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"))
            .where("x < y")
            .distinct(),
            f"edges{n}",
        )
    if not maps:
        return edge.select(F.col("x").alias("node"), F.col("y").alias("component"))
    # a round's roots are the nodes of the next one; unfold from the last round to the first
    found = maps[-1].select("node", F.col("root").alias("component"))
    for n, hook in reversed(list(enumerate(maps[:-1]))):
        after = found.select(F.col("node").alias("root"), "component")
        found = keep(
            hook.join(after, "root", "left").select("node", F.coalesce("component", "root").alias("component")),
            f"found{n}",
        )
    return found
