"""Connected groups of pairwise matches over billions of pairs.

The graph is reduced until nothing is left, and every removed vertex keeps a pointer to one that stays longer. A round
takes the vertices of degree two and one that it finds:

1. chains of degree-two vertices shrink to one edge between their ends, found by list ranking (pointer doubling over
   the directed arcs of the chain), so a chain of n vertices takes log n steps;
2. degree-one vertices are stripped, which also empties stars, whatever the size of the hub, in one step;
3. a core without either, in which every vertex has three neighbours or more, is contracted: each vertex points to its
   smallest neighbour, pointers are doubled to their roots, and edges between roots remain for the next round.

Labels return to the removed vertices layer by layer in reverse. Vertices are numbered once, so that all rounds carry
eight bytes a vertex. Every step is a join or a partial aggregate on a vertex; a hub with a third of all edges is a hot
key only on the edge side of such joins, which adaptive execution splits. Each step is written to the shared folder, so
neither lineage nor a lost executor reaches back further, and is counted as it is written.

Cases: null ends, self pairs, repeats and both directions of a pair change nothing; vertices without a valid pair get
no row; an empty edge table gives an empty result; extra columns of the edges are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Stages


def _canonical(edges: DataFrame) -> DataFrame:
    pair = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pair.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _double(st: Stages, arcs: DataFrame) -> DataFrame:
    """arcs: u, v, inner, ev (where it leads), nu, nv (next arc, null at the end), low. Pointer doubling until every
    arc knows where its chain ends; an arc on a ring ends with the ring's smallest vertex in ``low``.

    Each round ends at least one more arc while a chain is open, and lowers some ``low`` while a ring is not covered;
    a round that does neither is the last."""
    before = None
    while True:
        left, right = arcs.alias("a"), arcs.alias("b")
        on = (F.col("a.nu") == F.col("b.u")) & (F.col("a.nv") == F.col("b.v"))
        moves = F.col("b.nu").isNotNull()
        ended = F.col("a.nu").isNull()
        step = left.join(right, on, "left").select(
            "a.u", "a.v", "a.inner",
            F.when(ended, F.col("a.ev")).otherwise(F.col("b.ev")).alias("ev"),
            F.col("b.nu").alias("nu"), F.col("b.nv").alias("nv"),
            F.least("a.low", "b.low").alias("low"),
            F.coalesce(F.col("b.low") < F.col("a.low"), F.lit(False)).alias("lower"),
        )
        done, now = st.counted(step, open=F.count_if(F.expr("nu IS NOT NULL")), lowered=F.count_if(F.expr("lower AND nu IS NOT NULL")))
        st.drop(arcs)
        arcs = done.drop("lower")
        arcs._tidemark_path = done._tidemark_path
        if now["open"] == 0 or (before == now["open"] and now["lowered"] == 0):
            return arcs
        before = now["open"]


def _compress(st: Stages, edges: DataFrame, degree: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Without degree-two vertices: the smaller edge table, its size, and (v, parent) of the vertices taken out."""
    two = degree.where("degree = 2").select(F.col("u").alias("x"), "a", "b")
    both = _both(edges)
    # The arc (u, v) continues as (v, w), w being the other neighbour of v, where v has degree two.
    hop = both.join(two, F.col("v") == F.col("x"), "left").select("u", "v", F.when(F.col("x").isNotNull(), F.when(F.col("a") == F.col("u"), F.col("b")).otherwise(F.col("a"))).alias("w"))
    arcs = hop.join(two.select(F.col("x").alias("y")), F.col("u") == F.col("y"), "left").select("u", "v", "w", F.col("y").isNotNull().alias("inner"))
    arcs = arcs.where("inner OR w IS NOT NULL")
    more = F.col("w").isNotNull()
    arcs = _double(st, st.write(arcs.select("u", "v", "inner", F.col("v").alias("ev"), F.when(more, F.col("v")).alias("nu"), F.col("w").alias("nv"), F.least("u", "v").alias("low"))))
    # From an outer start the last arc ends at the chain's other end: one edge replaces the chain.
    chain = arcs.where("NOT inner AND nu IS NULL").select("u", F.col("ev").alias("v"))
    # An inner vertex points to the smaller end that its two arcs reach; on a ring to the ring's smallest vertex.
    parents = arcs.where("inner").groupBy("u").agg(F.min(F.when(F.col("nu").isNull(), F.col("ev")).otherwise(F.col("low"))).alias("parent"))
    layer = st.write(parents.where("u <> parent").select(F.col("u").alias("v"), "parent"))
    out = two.select("x")
    rest = edges.join(out.select(F.col("x").alias("u")), "u", "left_anti").join(out.select(F.col("x").alias("v")), "v", "left_anti").select("u", "v")
    kept, n = st.counted(_canonical(rest.union(chain.select("u", "v"))), n=F.count(F.lit(1)))
    st.drop(arcs)
    return kept, n["n"], layer


def _strip(st: Stages, edges: DataFrame, degree: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Without the vertices that had degree one, whose one edge may have become that of a chain: the smaller edge table,
    its size, and (v, parent) of the vertices taken out."""
    one = degree.where("degree = 1").select(F.col("u").alias("leaf"))
    # Of two such vertices that have only each other, the smaller stays as the root.
    ends = edges.join(one.select(F.col("leaf").alias("lu")), F.col("u") == F.col("lu"), "left").join(one.select(F.col("leaf").alias("lv")), F.col("v") == F.col("lv"), "left")
    marked = st.write(ends.select("u", "v", F.col("lu").isNotNull().alias("a"), F.col("lv").isNotNull().alias("b")))
    gone = F.when(F.col("b"), F.struct(F.col("v").alias("v"), F.col("u").alias("parent"))).when(F.col("a"), F.struct(F.col("u").alias("v"), F.col("v").alias("parent")))
    layer = marked.where("a OR b").select(gone.alias("g")).select("g.v", "g.parent")
    kept, n = st.counted(marked.where("NOT a AND NOT b").select("u", "v"), n=F.count(F.lit(1)))
    return kept, n["n"], layer


def _contract(st: Stages, edges: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """One round on the core: every vertex goes to the root of its pointers to smaller neighbours."""
    point = _both(edges).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("parent"))
    parents = st.write(point)
    while True:
        p = parents.select(F.col("v").alias("q"), F.col("parent").alias("up"))
        jumped, now = st.counted(parents.join(p, F.col("parent") == F.col("q"), "left").select("v", F.coalesce("up", "parent").alias("parent"), (F.col("up") < F.col("parent")).alias("moved")), moved=F.count_if("moved"))
        st.drop(parents)
        parents = jumped.drop("moved")
        parents._tidemark_path = jumped._tidemark_path
        if not now["moved"]:
            break
    p = parents.select(F.col("v").alias("x"), "parent")
    half = edges.join(p, F.col("u") == F.col("x")).select(F.col("parent").alias("u"), "v")
    full = half.join(p, F.col("v") == F.col("x")).select("u", F.col("parent").alias("v"))
    kept, n = st.counted(_canonical(full), n=F.count(F.lit(1)))
    return kept, n["n"], parents.where("v <> parent")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: u, v of any ordered type. Result: v, root for every vertex of a valid edge; one root a group, which is
    some vertex of it."""
    st = Stages(spark, "components")
    # Written with their numbers, so that these stay what they are.
    plain = st.write(_canonical(edges.select("u", "v")))
    names = st.write(_both(plain).select("u").distinct().withColumn("k", F.monotonically_increasing_id()))
    number = lambda c: names.select(F.col("u").alias(c), F.col("k").alias(f"{c}_k"))
    numbered = plain.join(number("u"), "u").join(number("v"), "v").select(F.col("u_k").alias("u"), F.col("v_k").alias("v"))
    # Different pairs of names are different pairs of numbers; only the smaller goes first again.
    work, size = st.counted(numbered.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), n=F.count(F.lit(1)))
    st.drop(plain)
    labels = _labels(st, work, size["n"])
    named = names.join(labels.select(F.col("v").alias("k"), "root"), "k", "left").select("u", F.coalesce("root", "k").alias("root"))
    return named.join(names.select(F.col("k").alias("root"), F.col("u").alias("name")), "root").select(F.col("u").alias("v"), F.col("name").alias("root"))


def _labels(st: Stages, edges: DataFrame, left: int) -> DataFrame:
    """v, root of every vertex that was taken out; the others are their own roots."""
    layers: list[DataFrame] = []

    def reduced(kept: DataFrame, n: int, layer: DataFrame) -> None:
        nonlocal edges, left
        layers.append(layer)
        st.drop(edges)
        edges, left = kept, n

    while left:
        degree, low = st.counted(_both(edges).groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("a"), F.max("v").alias("b")), two=F.count_if(F.col("degree") == 2), one=F.count_if(F.col("degree") == 1))
        if low["two"]:
            reduced(*_compress(st, edges, degree))
        if low["one"] and left:
            reduced(*_strip(st, edges, degree))
        if not low["two"] and not low["one"]:
            reduced(*_contract(st, edges))
        st.drop(degree)
    parts: list[DataFrame] = []
    for layer in reversed(layers):
        mine = layer.select("v", F.col("parent").alias("root"))
        if parts:
            up = reduce(DataFrame.unionByName, parts).select(F.col("v").alias("p"), F.col("root").alias("r"))
            mine = st.write(mine.join(up, F.col("root") == F.col("p"), "left").select("v", F.coalesce("r", "root").alias("root")))
        parts.append(mine)
    return reduce(DataFrame.unionByName, parts) if parts else edges.select(F.col("u").alias("v"), F.col("v").alias("root")).limit(0)


def groups(spark: SparkSession, pairs: DataFrame, members: DataFrame, keys: DataFrame) -> DataFrame:
    """pairs: a, b. members: id, hub (ids with the same hub are linked). keys: id, the ids that exist.

    Result: id, group_id for the ids in a group of at least two; group_id is the group's smallest id. A hub is a
    vertex of its own, prefixed so that it equals no id, so a hub of any size costs its members one edge each."""
    known = keys.select("id").where("id IS NOT NULL")
    links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(False).alias("hub")).where("u <> v")
    star = members.where("hub IS NOT NULL").select(F.col("id").alias("u"), F.concat(F.lit("~"), "hub").alias("v"), F.lit(True).alias("hub"))
    all_edges = links.unionByName(star).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    valid = all_edges.join(known.withColumnRenamed("id", "u"), "u", "left_semi")
    ends = valid.where("hub").unionByName(valid.where("NOT hub").join(known.withColumnRenamed("id", "v"), "v", "left_semi"))
    labels = components(spark, ends.select("u", "v")).where(~F.col("v").startswith("~"))
    smallest = labels.groupBy("root").agg(F.min("v").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return labels.join(smallest, "root").select(F.col("v").alias("id"), "group_id")
