"""Containment and order between the elements of a page, for selectors that the parse doesn't foresee.

Input is `dom.dom_nodes`: elements in document order whose descendants are the numbers from their own, exclusive, to
their end. Such intervals nest or are apart, so one walk over a page's starts and ends answers what a join on ranges
would: how many chosen elements are open at a place, and which. No element meets another that it isn't inside of, and
all windows are partitioned by page, so there is one shuffle. `page` names the columns that tell pages apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which of the elements around another one are meant.
WHICH = ("all", "nearest", "outermost")


def _events(nodes: DataFrame, outer: Column, inner: Column, page: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """A row where a chosen element starts and one where an outer element ends, at the place where it does."""
    chosen = nodes.select(*page, "id", "end", F.struct("id", *(c for c in carry if c != "id")).alias("node"), F.coalesce(outer, F.lit(False)).alias("is_outer"), F.coalesce(inner, F.lit(False)).alias("is_inner"))
    both = F.when(F.col("is_outer"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = chosen.filter("is_outer or is_inner").select("*", F.explode(both).alias("ends"))
    return rows.withColumn("at", F.when(F.col("ends") == 1, F.col("end")).otherwise(F.col("id")))


def within(nodes: DataFrame, outer: Column, inner: Column, which: str = "all", page: tuple[str, ...] = ("seq",), carry: tuple[str, ...] = ("tag",)) -> DataFrame:
    """(page, outer, level, node): inner elements with the outer elements that they are inside of; an element isn't inside itself.

    outer and node are structs of id and the carried columns; level counts the outer elements around `outer`. which: all
    of them, a row for each pair; the nearest or the outermost, a row for each inner element that is inside of any.
    """
    if which not in WHICH:
        raise ValueError(f"which must be one of {', '.join(WHICH)}")
    before = Window.partitionBy(*page).orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("ends") == 1, -1).when(F.col("is_outer"), 1).otherwise(0)
    starts = _events(nodes, outer, inner, page, carry).withColumn("around", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int")).filter("ends = 0")
    # An outer element stands at its own level; an inner one asks at the levels around it. The last element of a level
    # before a place with more than that many open ones is the open one.
    wanted = {"all": F.sequence(F.lit(0), F.col("around") - 1), "nearest": F.array(F.col("around") - 1), "outermost": F.array(F.lit(0))}[which]
    none = F.array().cast("array<int>")
    asks = F.transform(F.when(F.col("is_inner") & (F.col("around") > 0), wanted).otherwise(none), lambda x: F.struct(x.alias("level"), F.lit(False).alias("stands")))
    stands = F.transform(F.when(F.col("is_outer"), F.array("around")).otherwise(none), lambda x: F.struct(x.alias("level"), F.lit(True).alias("stands")))
    dealt = starts.select(*page, "id", "node", F.explode(F.concat(stands, asks)).alias("l")).select(*page, "id", "node", "l.*")
    last = F.last(F.when(F.col("stands"), F.col("node")), ignorenulls=True).over(Window.partitionBy(*page, "level").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("outer", last).filter(~F.col("stands")).select(*page, "outer", "level", "node")


def holding(nodes: DataFrame, outer: Column, inner: Column, page: tuple[str, ...] = ("seq",), carry: tuple[str, ...] = ("tag",)) -> DataFrame:
    """(page, node, n): every outer element with the number of inner elements inside it, itself not counted."""
    so_far = Window.partitionBy(*page).orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = (F.col("is_inner") & (F.col("ends") == 0)).cast("long")
    counted = _events(nodes, outer, inner, page, carry).withColumn("seen", F.sum(one).over(so_far)).filter("is_outer")
    return counted.groupBy(*page, "id").agg(F.any_value("node").alias("node"), (F.max("seen") - F.min("seen")).alias("n")).drop("id")


def next_siblings(nodes: DataFrame, page: tuple[str, ...] = ("seq",), carry: tuple[str, ...] = ("tag",)) -> DataFrame:
    """(page, node, next): every element with the next element of the same parent, or null."""
    node = F.struct("id", *(c for c in carry if c != "id"))
    in_order = Window.partitionBy(*page, "parent").orderBy("id")
    return nodes.select(*page, "parent", "id", node.alias("node")).withColumn("next", F.lead("node").over(in_order)).select(*page, "node", "next")


def below_siblings(nodes: DataFrame, head: Column, page: tuple[str, ...] = ("seq",), carry: tuple[str, ...] = ("tag",)) -> DataFrame:
    """(page, head, node): elements that aren't heads with the last head before them under the same parent: a heading's section."""
    node = F.struct("id", *(c for c in carry if c != "id"))
    in_order = Window.partitionBy(*page, "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.select(*page, "parent", "id", node.alias("node"), F.coalesce(head, F.lit(False)).alias("is_head"))
    rows = rows.withColumn("head", F.last(F.when(F.col("is_head"), F.col("node")), ignorenulls=True).over(in_order))
    return rows.filter("head is not null and not is_head").select(*page, "head", "node")
