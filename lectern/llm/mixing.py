"""Mixing sources to target weights by systematic sampling.

The target of a source is its share of all sizes by weight, stopped at ``most`` times its own size, with the excess
reshared by weight among the others until none is above. Each document expects copies; the documents of a source stand in
one order, and the prefix sum of their expected copies, moved by one random offset a source, emits a copy of a document
for each whole number that it crosses there.

The order is by size, the larger first, so copies are spread over sizes evenly: what a source takes is off its target by
about one of its largest documents at most. Documents above ``LARGE`` of their source's target therefore come first and
expect target by size copies each; the others then expect what is left of the target by their size, under the same offset.
The expectation of every document is the same as before, and the source is off by about ``LARGE`` of its target.

The prefix sum has two levels, so no task sees a source as a whole: documents fall in cells (source, range of the order)
of bounded size, cells are counted and summed up, and ranks inside a cell start at the cell's first rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.store import table

CELL = 5_000
#: Share of its source's target above which a document is large.
LARGE = 0.03


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _bits(digest: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``k``, its place from 0 on in an order of all rows, without a task that sees all of them."""
    runs = table(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    first = runs.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order)
    return runs.withColumn("k", F.row_number().over(inside) - 1).join(F.broadcast(first), "part").withColumn("k", F.col("k") + F.col("first")).drop("part", "first")


def targets(sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target. One row a source; nulls come last.

    Resharing goes round by round: a round stops the sources whose share is above their cap. A later round only raises
    the shares of the rest, so what is stopped stays, and the rounds end with the first that stops none.
    """
    ranked = numbered(sizes, F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = table(ranked.select("source", "source_size", pick.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    level, stopped = 0.0, -1
    free = lambda level: F.col("cap") >= F.lit(level) * F.col("weight")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        # sources alike in cap and weight are alike here too, so a level tells which are stopped
        capped, weight, n = ranked.agg(F.sum(F.when(~free(level), F.col("cap")).otherwise(0.0)), F.sum(F.when(free(level), F.col("weight"))), F.count(F.when(~free(level), 1))).first()
        if n == stopped or not weight:
            break
        level, stopped = (total - capped) / weight, n
    return ranked.select("source", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """One row for each row of ``df``: id, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken``.

    A null or empty text has size 0 and takes nothing; a null source is a source of its own, the last. The order of a
    source is by size, then by a hash of id and text, so rows that repeat an id, or have none, have places of their own;
    rows that repeat id and text stand side by side, and share their copies out in any order. Equal tables give equal
    results, however they are cut into partitions. An empty table gives an empty result.
    """
    size = word_count(F.col(f"`{text}`"))
    content = F.sha2(F.concat_ws(",", F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("-")), F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)), 256)
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{source}`").cast("string").alias("_source"), size.alias("size"), _bits(content, 15).alias("h"))
    rows = table(rows, "sizes")
    by_source = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(by_source.select("source", "source_size"), most, weights)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
    goal = goal.withColumn("offset", _bits(F.sha2(F.concat(F.lit(f"{seed},"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))), 256), 13) / F.lit(float(1 << 52)))
    goal = table(goal, "targets")

    # a place in the order: large documents first, then the size's length and ten more bits of it, the hash for the rest
    length = F.length(F.bin("size")) - 1
    lead = F.call_function("shiftright", F.shiftleft("size", 10), length).bitwiseAND(F.lit(1023))
    bits = 17 + max(0, min(30, math.ceil(math.log2(max(1, rows.count() / CELL)))))
    rows = rows.join(goal.select(F.col("source").alias("g_source"), F.col("target").alias("g_target")), F.col("_source").eqNullSafe(F.col("g_source")))
    rows = rows.withColumn("large", F.col("size") > F.lit(LARGE) * F.col("g_target")).drop("g_source", "g_target")
    place = F.lit((1 << 16) - 1) - F.shiftleft(length.cast("bigint"), 10).bitwiseOR(lead)
    place = F.when(F.col("large"), F.lit(0)).otherwise(F.lit(1 << 16)).cast("bigint") + place
    cell = F.shiftleft(place, bits - 17).bitwiseOR(F.shiftright("h", 60 - (bits - 17)))
    rows = table(rows.withColumn("cell", cell), "ordered")
    cells = table(rows.groupBy("_source", "large", "cell").agg(F.count("*").alias("n")), "cells")

    # cells of a source are summed in two steps, so that no task gets more than a square root of them
    cells = cells.withColumn("range", F.shiftright("cell", bits // 2))
    ranges = cells.groupBy("_source", "large", "range").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("_source", "large").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_source").alias("r_source"), F.col("large").alias("r_large"), F.col("range").alias("r_range"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("range_first"))
    inside = Window.partitionBy("_source", "large", "range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = cells.join(ranges, F.col("_source").eqNullSafe(F.col("r_source")) & (F.col("large") == F.col("r_large")) & (F.col("range") == F.col("r_range")))
    starts = starts.select(F.col("_source").alias("s_source"), F.col("large").alias("s_large"), F.col("cell").alias("s_cell"), (F.col("cell_first") + F.col("range_first")).alias("start"))
    local = Window.partitionBy("_source", "large", "cell").orderBy(F.col("size").desc(), "h", "_id")
    ranked = rows.withColumn("k", F.row_number().over(local) - 1)
    placed = ranked.join(starts, F.col("_source").eqNullSafe(F.col("s_source")) & (F.col("large") == F.col("s_large")) & (F.col("cell") == F.col("s_cell")))
    placed = table(placed.select("_id", "_source", "size", "large", (F.col("start") + F.col("k")).alias("rank")), "placed")

    def copies(rate: Column) -> Column:
        """Whole numbers that the moved prefix sum crosses; the whole part of the rate is set apart, so it is exact."""
        part = rate - F.floor(rate)
        crossed = F.floor(F.col("offset") + part * (F.col("rank") + 1)) - F.floor(F.col("offset") + part * F.col("rank"))
        return F.least(F.floor(rate) + crossed, F.lit(int(most))).cast("int")

    large = placed.where("large").join(goal, F.col("_source").eqNullSafe(F.col("source"))).withColumn("copies", copies(F.col("rate")))
    taken = large.groupBy(F.col("_source").alias("t_source")).agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.sum("size").alias("of"))
    goal = goal.join(taken, F.col("source").eqNullSafe(F.col("t_source")), "left")
    left = F.col("source_size") - F.coalesce("of", F.lit(0))
    rest = F.when(left > 0, F.least(F.greatest((F.col("target") - F.coalesce("got", F.lit(0))) / left, F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
    goal = goal.select("source", "source_size", "target", "rate", "offset", rest.alias("rest"))
    out = placed.join(goal, F.col("_source").eqNullSafe(F.col("source")))
    out = out.withColumn("copies", copies(F.when(F.col("large"), F.col("rate")).otherwise(F.col("rest"))))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    return out.select(F.col("_id").alias(id), "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))
