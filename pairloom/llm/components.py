"""Connected components of a link table, by large-star and small-star rounds over forests of stretches of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.steps import written

# Links that a task joins at once.
LINKS_AT_ONCE = 250_000


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    """Per node of (``u``, ``v``), the smallest of itself and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def _hung(most: int):
    """Each stretch of ``most`` links as stars: every node but the smallest of its component hangs on that."""

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars(kind: pa.DataType) -> pa.RecordBatch:
            hung = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in hung], kind) for i in (0, 1)], names=["u", "v"])

        held, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                low, high = sorted((root(u), root(v)))
                parent[high] = low
                held += 1
                if held == most:
                    yield stars(kind)
                    held = 0
        if held:
            yield stars(kind)

    return hang


def _are_stars(edges: DataFrame) -> bool:
    """Does every larger end ``u`` hang on one ``v`` only, and nothing on it? One aggregate of both ends."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"))
    )
    met = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("n"))
    return met.filter((F.col("hangs") > 0) & (F.col("n") > 1)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links (``u``, ``v``): ``root`` is the smallest in its component.

    Stretches of ``LINKS_AT_ONCE`` links are turned into stars by themselves, which are no more rows. Then
    every round hangs neighbours onto the smallest node near them (large star: the larger
    neighbours; small star: the smaller ones and the node itself) until all links are stars, which may be at once; the number of
    rounds grows with the logarithm of the longest chain. Neighbourhoods are only ever aggregated to a minimum,
    never gathered. Links of a node to itself and null ends are ignored.
    """
    edges = written(links.select("u", "v").filter(F.col("u") != F.col("v")), "links")
    stretches = -(-edges.count() // LINKS_AT_ONCE)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    forests = edges.coalesce(max(1, stretches)).mapInArrow(_hung(LINKS_AT_ONCE), kinds)
    edges = written(forests.distinct() if stretches > 1 else forests, "links")
    # Links of one stretch are stars by now.
    while stretches > 1 and not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest_neighbour(edges)
        # Large star: every larger neighbour of u hangs on the smallest node around u. No more rows than edges.
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.filter(F.col("u") != F.col("v")), "links")
        # Small star: u and its smaller neighbours hang on the smallest of them; u is the larger end.
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(least.select("u", F.col("low").alias("v")))
        edges = written(small.filter(F.col("u") != F.col("v")).distinct(), "links")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
