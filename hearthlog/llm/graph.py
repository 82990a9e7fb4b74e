"""Connected components of an edge table, as a chain of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, comp: the smallest node of each node's component, for every node of `edges` (columns a, b).

    Alternates the large star (each node hands its larger neighbours to its smallest one) and the small star
    (each node hands its smaller neighbours and itself to the smallest of them) until no edge changes. The
    number of rounds grows with the logarithm of the longest path. Links stay in tables; the driver sees two
    numbers a round. Raises where edges still change after `most_rounds`. Edges to itself and repeated ones don't matter; no edges give an empty result.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    seen = _mark(now)
    for _ in range(most_rounds):
        # As many tasks as the edges need; links are often few among many documents.
        few = lambda df: df.coalesce(1 + seen[0] // _EDGES)  # noqa: B023, E731
        now = few(now)
        both = now.union(now.select("lo", "hi")).toDF("u", "v").coalesce(1 + seen[0] // _EDGES)
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.join(least, "u")).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
        low = few(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = few(large.join(low, "hi")).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        now = cut(few(small.select("e.*").filter("hi <> lo").distinct()))
        before, seen = seen, _mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


#: Edges of a task.
_EDGES = 250_000


def _mark(edges: DataFrame) -> tuple:
    """Count and hash of an edge set."""
    one = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")).first()
    return one["n"], one["h"]
