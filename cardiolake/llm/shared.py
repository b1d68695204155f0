"""Helpers of the corpus operators: shared tables, ordered ranges, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# Rows up to which Spark may broadcast a table by its own estimate; above, tables are merged.
_BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for local sessions that set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    folder = tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; whatever reads it must be written by then."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def merged(table: DataFrame) -> DataFrame:
    """``table`` for one side of a join that sorts and merges: neither side is broadcast.

    Spark sizes a table by its compressed files and by the widths of its columns. It knows neither what
    compression saves nor how long the arrays are that ``explode`` turns into rows, so a table of 8 MB
    that explodes to 2 GB would be sent whole to the driver.
    """
    return table.hint("merge")


def position(cuts: Sequence, value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by binary search; 0 for NULL."""
    if not cuts:
        return F.lit(0)
    levels = len(cuts).bit_length()
    padded = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(levels))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(padded, at + step - 1) <= value, at + step).otherwise(at),
    )


def range_cuts(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` values of an integer ``key`` that split its rows about evenly."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def fold(doc_id: Column, modulus: int, residue: int) -> Column:
    """True where crc32 of the id's text leaves ``residue``: the held-out fold; false for NULL ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == residue, F.lit(False))


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) of every node of an undirected edge list (u, v), one root per component.

    Each round maps every node to the neighbour (or itself) that comes first in a new random order
    and replaces nodes by their images, so the edge list shrinks by a constant factor a round
    whatever its shape. Work per round is two joins and two combinable aggregates; a node with
    any number of links is reduced on the map side. Edges, labels and roots never leave the cluster,
    but for maps of few nodes (by their count, not by Spark's estimate) that a join may broadcast.
    Links to itself or to NULL are ignored.
    """
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), name)
    maps: list[DataFrame] = []
    turn = 0
    while not edges.isEmpty():
        side = merged if 2 * edges.count() > _BROADCAST_ROWS else lambda table: table
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("node"))  # noqa: E731, B023
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy(F.col("u").alias("node")).agg(F.min(rank(F.col("v"))).alias("other"))
        image = written(
            first.select("node", F.least(rank(F.col("node")), F.col("other"))["node"].alias("image")),
            f"{name}-map",
        )
        maps.append(side(image))
        left = side(image.select(F.col("node").alias("u"), F.col("image").alias("a")))
        right = side(image.select(F.col("node").alias("v"), F.col("image").alias("b")))
        edges = written(
            edges.join(left, "u")
            .join(right, "v")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .filter("u <> v")
            .distinct(),
            name,
        )
        turn += 1
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root"))
    # Every node of a later round is an image of an earlier one, so roots resolve from the last map back.
    roots = maps[-1].select("node", F.col("image").alias("root"))
    for image in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("image"), "root")
        roots = image.join(later, "image", "left").select("node", F.coalesce("root", "image").alias("root"))
    return roots
