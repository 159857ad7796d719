"""Filling fixed-capacity containers with items of varying length.

``harmonic`` is harmonic packing: sizes are partitioned into reciprocal-capacity classes (an item of class k has
between C/(k+1) and C/k) and every bin of a class takes k items, so workers fill bins independently of each other.
Its waste inside a class can't be avoided by the method, so ``by_patterns`` fills containers closely: token counts are
whole numbers up to the capacity, hence the input is described by one count per size; best-fit decreasing over those
counts gives bin patterns with multiplicities (a plan whose size depends on the capacity alone), and every item finds
its bin from its size and its rank among the items of that size, again independently of all others.

An item larger than the capacity is split into full pieces, each its own container, and a rest that is packed like an
item; no other item is split. Ranks are numbered within salted groups of a size, so a size that holds a third of all
rows is no task of its own.

Defined results: null and empty texts have no tokens and go to the first container; every doc_id comes out, once per
piece; repeated doc_ids are repeated items; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

#: Items of one size that one task numbers at most, on average.
RANKED = 200_000


def pieces(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(doc_id, tokens)`` x the budgets (a handful of rows by contract) -> one row per piece: budget_id, capacity,
    doc_id, piece, pieces, tokens."""
    caps = [(r["budget_id"], r["capacity_tokens"]) for r in budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().collect()]
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in caps]))
    count = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    cut = sizes.select("doc_id", "tokens", each.alias("x")).select("doc_id", "tokens", "x.*").withColumn("pieces", count)
    return cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn(
        "tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity"))
    ).select("budget_id", "capacity", "doc_id", "piece", "pieces", "tokens")


def ranked(items: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Number the items of each group from 0 (column ``rank``), group counts beside: salted row numbers plus the
    counts of the salts before, so a hot group is spread over tasks."""
    n = items.count()
    salts = max(4, n // RANKED + 1)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy(*group, "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("salt")) - F.col("n")).drop("n")
    row = F.row_number().over(Window.partitionBy(*group, "salt").orderBy("doc_id", "piece"))
    numbered = salted.withColumn("row", row).join(before, [*group, "salt"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    return numbered.drop("salt", "row", "before"), counts.groupBy(*group).agg(F.sum("n").alias("n"))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over size counts: segments ``(size, first rank, first bin, items per bin, bins)`` and the
    number of bins. Bins with equal contents are handled as one group throughout."""
    room: dict[int, list[tuple[int, int]]] = {}  # residual -> groups of bins (first bin, number)
    order: list[int] = []
    segments, bins = [], 0

    def put(residual: int, first: int, number: int) -> None:
        if number > 0 and residual > 0:
            if residual not in room:
                room[residual] = []
                insort(order, residual)
            room[residual].append((first, number))

    for size in sorted((s for s in counts if 0 < s <= capacity), reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(order, size)
            if i < len(order):
                residual = order[i]
                first, number = room[residual].pop()
                if not room[residual]:
                    del room[residual]
                    order.pop(i)
            else:
                residual, first = capacity, bins
                number = -(-left // (capacity // size))
                bins += number
            fit = residual // size
            full = min(number, left // fit)
            if full:
                segments.append((size, rank, first, fit, full))
                put(residual - fit * size, first, full)
                rank, left = rank + fit * full, left - fit * full
            if full < number:
                if left:
                    segments.append((size, rank, first + full, left, 1))
                    put(residual - left * size, first + full, 1)
                    rank, full, left = rank + left, full + 1, 0
                put(residual, first + full, number - full)
    return segments, bins


def by_patterns(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(doc_id, tokens)`` -> budget_id, doc_id, piece, pieces, tokens, container: closely filled containers."""
    spark = sizes.sparkSession
    cut = pieces(sizes, budgets)
    numbered, counts = ranked(cut.where("tokens < capacity"), ["budget_id", "capacity", "tokens"])
    plans = {}
    # one count per size below the capacity: as many rows as the capacities have tokens, whatever the corpus
    table: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts.collect():
        table.setdefault((r["budget_id"], r["capacity"]), {})[r["tokens"]] = r["n"]
    for (b, c), by_size in table.items():
        segments, bins = plan(by_size, c)
        at: dict[int, np.ndarray] = {}
        for s in by_size:
            own = [x for x in segments if x[0] == s]
            at[s] = np.array(own, np.int64).reshape(-1, 5)
        plans[b] = (at, bins)
    sent = spark.sparkContext.broadcast(plans)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = np.zeros(len(b), np.int64)
            for (budget, size), idx in b.groupby(["budget_id", "tokens"]).indices.items():
                if size > 0:
                    seg = sent.value[budget][0][size]
                    rank = b["rank"].to_numpy()[idx]
                    k = np.searchsorted(seg[:, 1], rank, "right") - 1
                    where[idx] = seg[k, 2] + (rank - seg[k, 1]) // seg[k, 3]
            yield pd.DataFrame({"budget_id": b["budget_id"], "doc_id": b["doc_id"], "piece": b["piece"], "pieces": b["pieces"], "tokens": b["tokens"], "container": [f"p{x}" for x in where]})

    packed = numbered.mapInPandas(place, "budget_id int, doc_id long, piece int, pieces int, tokens long, container string")
    # a full piece is a container of its own; by rank, as a doc_id may be repeated
    full, _ = ranked(cut.where("tokens >= capacity"), ["budget_id"])
    return packed.unionByName(full.select("budget_id", "doc_id", "piece", "pieces", "tokens", F.concat(F.lit("f"), F.col("rank").cast("string")).alias("container")))


def harmonic(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Harmonic packing of ``(doc_id, tokens)``: same columns as ``by_patterns``."""
    cut = pieces(sizes, budgets).withColumn("class", F.when(F.col("tokens") > 0, F.floor(F.col("capacity") / F.col("tokens"))).otherwise(0))
    numbered, _ = ranked(cut, ["budget_id", "class"])
    spot = F.when(F.col("class") > 0, F.floor(F.col("rank") / F.col("class"))).otherwise(0)
    return numbered.select("budget_id", "doc_id", "piece", "pieces", "tokens", F.concat(F.lit("h"), F.col("class").cast("string"), F.lit("-"), spot.cast("string")).alias("container"))


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers, tokens and the share of the containers' room that is filled."""
    used = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("tokens")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    return used.join(budgets.select("budget_id", "capacity_tokens"), "budget_id").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def sizes_table(counts: DataFrame) -> DataFrame:
    """The token counts, written once: packing reads them several times."""
    return stored(counts.sparkSession, counts, "sizes")
