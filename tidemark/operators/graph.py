"""Payment graphs as edge lists. A node is a (bank, account) pair; both fields are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import storage
from tidemark.schema import EDGE

Keys = tuple[str, ...]
#: Paths through one intermediary that a task makes, about.
PATHS = 4_000_000
SRC, DST = EDGE[:2], EDGE[2:]


def edges(rows: DataFrame, by: Keys = ()) -> DataFrame:
    """Distinct directed edges; several payments between two accounts are one edge, and self-loops stay."""
    return rows.select(*by, F.col("from_bank").alias("src_bank"), F.col("from_account").alias("src_account"), F.col("to_bank").alias("dst_bank"), F.col("to_account").alias("dst_account")).distinct()


def high_out(graph: DataFrame, k: int, by: Keys = ()) -> DataFrame:
    """Sources with at least k different successors."""
    return graph.groupBy(*by, *SRC).agg(F.count("*").alias("degree")).filter(F.col("degree") >= k)


def high_in(graph: DataFrame, k: int, by: Keys = ()) -> DataFrame:
    """Destinations with at least k different predecessors."""
    return graph.groupBy(*by, *DST).agg(F.count("*").alias("degree")).filter(F.col("degree") >= k)


def neighbours(graph: DataFrame, by: Keys = ()) -> DataFrame:
    """Numbers of predecessors and successors of each node."""
    out = graph.select(*by, F.col("src_bank").alias("bank"), F.col("src_account").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = graph.select(*by, F.col("dst_bank").alias("bank"), F.col("dst_account").alias("account"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    return out.union(into).groupBy(*by, "bank", "account").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def first_hops(graph: DataFrame, k: int, by: Keys = ()) -> DataFrame:
    """Edges out of nodes that can begin a pair: a pair with k intermediaries needs k successors."""
    return graph.join(high_out(graph, k, by).select(*by, *SRC), [*by, *SRC], "left_semi")


def second_hops(graph: DataFrame, k: int, by: Keys = ()) -> DataFrame:
    """Edges into nodes that can end a pair."""
    return graph.join(high_in(graph, k, by).select(*by, *DST), [*by, *DST], "left_semi")


def hubs(left: DataFrame, right: DataFrame, on: list[str], paths: int) -> DataFrame:
    """Intermediaries with more than `paths` paths through them, and over how many tasks these are dealt."""
    into, out = left.groupBy(*on).agg(F.count("*").alias("n_in")), right.groupBy(*on).agg(F.count("*").alias("n_out"))
    return into.join(out, on).filter(F.col("n_in") * F.col("n_out") > paths).select(*on, F.ceil(F.least(F.col("n_in") * F.col("n_out") / paths, F.col("n_in"))).alias("_parts"))


def pair_counts(graph: DataFrame, k: int, by: Keys = (), prune: bool = True, salt: int | None = None, paths: int = PATHS) -> DataFrame:
    """(origin, destination, n) of different nodes with n >= k different intermediaries.

    Pruning by degree loses no pair and comes before the join that multiplies rows. The edges into a
    hub, an intermediary with more than `paths` paths, are dealt to as many tasks as these take, and the
    edges out of it are repeated for each: its product is made in several places. `salt` deals all of them to
    as many tasks instead. The edges and the hubs are written.
    """
    if salt is None:
        graph = storage.written(graph, "edges")[0]
    first = first_hops(graph, k, by) if prune else graph
    second = second_hops(graph, k, by) if prune else graph
    left = first.select(*by, F.col("src_bank").alias("a_bank"), F.col("src_account").alias("a_account"), F.col("dst_bank").alias("b_bank"), F.col("dst_account").alias("b_account"))
    right = second.select(*by, F.col("src_bank").alias("b_bank"), F.col("src_account").alias("b_account"), F.col("dst_bank").alias("c_bank"), F.col("dst_account").alias("c_account"))
    on = [*by, "b_bank", "b_account"]
    parts = F.lit(salt or 1)
    if salt is None:
        known = storage.written(hubs(left, right, on, paths), "hubs")[0]
        some = not known.isEmpty()
        if some:
            known = storage.small(known)
            left, right, parts = left.join(known, on, "left"), right.join(known, on, "left"), F.coalesce("_parts", F.lit(1))
    if salt is None and some or (salt or 1) > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64("a_bank", "a_account"), parts)).drop("_parts")
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("_parts")
        on.append("_salt")
    paired = left.join(right, on).filter((F.col("a_bank") != F.col("c_bank")) | (F.col("a_account") != F.col("c_account")))
    return paired.groupBy(*by, "a_bank", "a_account", "c_bank", "c_account").agg(F.count("*").alias("n_paths")).filter(F.col("n_paths") >= k)


def endpoints(pairs: DataFrame, by: Keys = ()) -> DataFrame:
    """Distinct nodes at either end of a pair."""
    return pairs.select(*by, F.col("a_bank").alias("bank"), F.col("a_account").alias("account")).union(pairs.select(*by, "c_bank", "c_account")).distinct()


def both_ends(graph: DataFrame, k: int) -> DataFrame:
    """Nodes with k successors and k predecessors."""
    out, into = high_out(graph, k).select(*SRC), high_in(graph, k).select(*DST)
    return out.intersect(into).toDF("bank", "account")
