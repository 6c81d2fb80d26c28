"""Greedy matching and components over edge tables, in rounds that end when nothing is left to decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Stages


def greedy_matching(st: Stages, pairs: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """The pairs that a greedy pass by ascending ``order`` (unique) would take, each end being used once.

    A pair that comes first among all pairs of both its ends is taken by any such pass, so each round takes all of
    these at once and drops what they touch. Ends of the two columns are apart unless the columns share values."""
    left, taken = st.write(pairs), []
    while True:
        ends = left.select(F.col(a).alias("e"), order).unionByName(left.select(F.col(b).alias("e"), order)).groupBy("e").agg(F.min(order).alias("first"))
        first = lambda c: ends.select(F.col("e").alias(c), F.col("first").alias(f"_{c}"))
        hit = st.write(left.join(first(a), a).join(first(b), b).where((F.col(order) == F.col(f"_{a}")) & (F.col(order) == F.col(f"_{b}"))).select(left.columns))
        taken.append(hit)
        if hit.isEmpty():
            break
        used = hit.select(F.col(a).alias("e")).unionByName(hit.select(F.col(b).alias("e"))).distinct()
        gone = lambda c: used.select(F.col("e").alias(c))
        rest = st.write(left.join(gone(a), a, "left_anti").join(gone(b), b, "left_anti").select(left.columns))
        st.drop(left)
        left = rest
    return reduce(DataFrame.unionByName, taken)


def labelled_components(st: Stages, edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node) by minimum labels that jump over their own labels."""
    both = st.write(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    label = st.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        own = label.select(F.col("node").alias("v"), F.col("component").alias("c"))
        near = both.join(own, "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("cc"))
        step = label.join(near, "node").join(up, "component").select("node", F.least("c", "cc", "component").alias("new"), "component")
        now = st.write(step.select("node", F.col("new").alias("component"), (F.col("new") < F.col("component")).alias("moved")))
        st.drop(label)
        label = now
        if label.where("moved").isEmpty():
            return label.select("node", "component")
