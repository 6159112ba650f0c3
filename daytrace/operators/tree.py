"""Reading trees of elements within a budget: breadth first, by joins of a frontier with its children.

A tree is rows (tree, node, parent, pos, kind, name, hidden); a root has no parent. All trees are
read together, a level at a time. A level's elements are numbered behind those of the levels before it
within their tree, so that the budgets hold for each tree as if it were read alone:

* elements: so many are looked at, hidden ones included;
* children: so many of an element's children, by their place, follow it;
* depth: only levels that name something count, so that scaffolding costs nothing;
* lines: reading stops once so many elements of writing were found.

Nothing below a hidden element is looked at, nor below a control that holds a label. A frontier has at most
`elements` rows of a tree, so no tree is gathered, whatever its size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import checkpointed
from .capture import CONTENT, FURNITURE, FURNITURE_CONTROLS, FURNITURE_SUBTREES, WRITING, WRITING_CONTROLS

# Controls with nothing to read below them.
LEAVES = ("button", "splitbutton", "menuitem", "checkbox", "radiobutton", "combobox", "scrollbar", "slider", "spinner", "thumb", "progressbar", "tooltip", "separator", "image")


class Budget(NamedTuple):
    depth: int
    elements: int
    children: int
    lines: int


# What is read of any window, and of those that are read deeply.
GLANCE, STUDY = Budget(4, 80, 24, 12), Budget(8, 900, 40, 28)


def walk(elements: DataFrame, budget: Budget = GLANCE) -> DataFrame:
    """(tree, node, place, depth, surface, shown, name): the elements looked at, in the order in which they are met; shown: not hidden.

    surface: 0 writing, 1 content, 2 furniture. An element without a node is none; several roots of a tree follow each other.
    """
    e = elements.select("tree", "node", "parent", "pos", F.lower("kind").alias("kind"), "name", F.coalesce("hidden", F.lit(False)).alias("hidden")).filter("tree IS NOT NULL AND node IS NOT NULL")
    order = W.partitionBy("tree").orderBy("after", "pos", "node")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    siblings = W.partitionBy("tree", "parent").orderBy("pos", "node")
    children = checkpointed(e.filter("parent IS NOT NULL").withColumn("nth", F.row_number().over(siblings)).filter(F.col("nth") <= budget.children).drop("nth"))
    level = e.filter("parent IS NULL").drop("parent").select("*", F.lit(0).alias("after"), F.lit(0).alias("depth"), F.lit(False).alias("below"), F.lit(0).alias("seen"), F.lit(0).alias("written"))
    found = None
    while True:
        below = F.col("below") | F.coalesce(F.col("kind").isin(*FURNITURE_SUBTREES), F.lit(False))
        own = F.when(below | F.col("kind").isin(*FURNITURE_CONTROLS), FURNITURE).when(F.col("kind").isin(*WRITING_CONTROLS), WRITING).otherwise(CONTENT)
        named = F.coalesce(F.trim("name") != "", F.lit(False))
        level = level.withColumn("below", below).withColumn("surface", own).withColumn("named", named)
        writes = (~F.col("hidden") & F.col("named") & (F.col("surface") == WRITING)).cast("int")
        level = level.withColumn("writes", writes).withColumn("place", F.col("seen") + F.row_number().over(order)).withColumn("had", F.col("written") + F.coalesce(F.sum("writes").over(before), F.lit(0)))
        level = level.filter((F.col("place") <= budget.elements) & (F.col("had") < budget.lines))
        whole = W.partitionBy("tree")
        level = checkpointed(level.withColumn("seen", F.max("place").over(whole)).withColumn("written", F.max(F.col("had") + F.col("writes")).over(whole)))
        if level.isEmpty():
            break
        looked = level.select("tree", "node", F.col("place").cast("int").alias("place"), "depth", "surface", (~F.col("hidden")).alias("shown"), "name")
        found = looked if found is None else found.union(looked)
        goes_on = ~F.col("hidden") & (F.col("depth") < budget.depth) & ~F.coalesce(F.col("kind").isin(*LEAVES), F.lit(False))
        up = level.filter(goes_on).select("tree", F.col("node").alias("parent"), F.col("place").alias("after"), (F.col("depth") + F.col("named").cast("int")).alias("depth"), "below", "seen", "written")
        level = children.join(up, ["tree", "parent"]).drop("parent")
    return found if found is not None else looked_at_nothing(elements)


def looked_at_nothing(elements: DataFrame) -> DataFrame:
    return elements.limit(0).select("tree", "node", F.lit(0).alias("place"), F.lit(0).alias("depth"), F.lit(0).alias("surface"), F.lit(True).alias("shown"), "name")
