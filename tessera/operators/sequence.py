"""Order-sensitive operators: stitching of message rows, islands, captured lines, batching, copied runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(pos: str, tie: str | None) -> list[str]:
    return [pos, tie] if tie else [pos]


def stitch(commands: DataFrame, group: list[str], pos: str, opens: str, text: str, closes: str | None = None, tie: str | None = None) -> DataFrame:
    """Dialogue blocks: a row that opens starts one, rows that don't open follow the block before them (rows
    before any opening belong to none), a closing row ends it. Rows of one position are in the order of ``tie``.
    Returns group, block (the position that opened it), n, lines in order."""
    place = F.struct(*_order(pos, tie))
    seen = Window.partitionBy(*group).orderBy(*_order(pos, tie)).rowsBetween(Window.unboundedPreceding, 0)
    marked = commands.withColumn("_open", F.last(F.when(F.col(opens) & F.col(pos).isNotNull(), place), ignorenulls=True).over(seen))
    if closes:
        last_close = F.last(F.when(F.col(closes), place), ignorenulls=True).over(seen)
        marked = marked.withColumn("_open", F.when(last_close.isNull() | (last_close < F.col("_open")), F.col("_open"))).where(~F.col(closes))
    blocks = marked.where("_open is not null").groupBy(*group, "_open").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*_order(pos, tie), text))).alias("rows"))
    return blocks.select(*group, F.col("_open")[pos].alias("block"), "n", F.array_join(F.transform("rows", lambda x: x[text]), "\n").alias("lines"))


def islands(rows: DataFrame, group: list[str], pos: str, keep) -> DataFrame:
    """Maximal runs of consecutive positions among the rows to keep, rows of one position in the same run: group,
    first, last, n."""
    kept = rows.where(keep)
    run = F.col(pos) - F.dense_rank().over(Window.partitionBy(*group).orderBy(pos))
    return kept.withColumn("run", run).groupBy(*group, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).drop("run")


def following(rows: DataFrame, group: list[str], pos: str, anchor, tie: str | None = None) -> DataFrame:
    """Rows that follow an anchor without a gap, with the anchor's position. Rows of one position are in the order
    of ``tie``."""
    w = Window.partitionBy(*group).orderBy(*_order(pos, tie))
    place = F.struct(*_order(pos, tie))
    marked = rows.withColumn("_anchor", F.last(F.when(anchor & F.col(pos).isNotNull(), place), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy(*group, "_anchor")
    counted = marked.where("_anchor is not null").withColumn("step", F.dense_rank().over(after.orderBy(pos)) - 1).withColumn("_row", F.row_number().over(after.orderBy(*_order(pos, tie))))
    counted = counted.withColumn("anchor", F.col("_anchor")[pos])
    return counted.where((F.col(pos) - F.col("anchor") == F.col("step")) & (F.col("_row") > 1)).drop("step", "_row", "_anchor")


def numbered(rows: DataFrame, group: list[str], order: str, name: str, parts: int = 16) -> DataFrame:
    """Number the rows of each group from 1 in order. A group is cut into ranges of the order (their bounds
    by quantiles of all rows' keys), numbered within and shifted by the sizes of the ranges before, so that a group
    with a third of all rows is spread over tasks."""
    h = rows.withColumn("_key", F.col(order).cast("string"))
    bounds = sorted({r["_key"] for r in h.select("_key").where(F.rand(7) < _share(h, 200 * parts)).collect()})
    cuts = bounds[:: max(1, len(bounds) // parts)][1:]
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("_key") >= c).cast("int")
    cut = h.withColumn("_part", bucket)
    sizes = cut.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).drop("_n")
    row = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_key"))
    return cut.withColumn("_row", row).join(before, [*group, "_part"]).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_key", "_part", "_row", "_before")


def _share(rows: DataFrame, wanted: int) -> float:
    return min(1.0, wanted / max(1, rows.count()))


NARRATION = "旁白"


def batches(items: DataFrame, group: list[str], order: str, size: str, role: str, limit: int, factor: float = 1.0, extend: int = 5) -> DataFrame:
    """Fold the rows of each group in order into batches and number the rows of each from 1. ``size`` is
    the length of a row's prompt without its two numbers. A batch is full once its length over ``factor`` reaches
    ``limit``. A full batch whose last row is nobody's (no role, or narration) closes there; otherwise up to ``extend``
    rows more join it, as long as they are nobody's or that last row's speaker's. Adds batch and sequence."""
    if limit <= 0 or factor <= 0 or extend <= 0:
        raise ValueError("limit, factor and extend must be positive")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, speaker = object(), None
        batch = total = seq = left = 0
        full = closed = False
        for b in parts:
            keys = list(zip(*[b[g].astype(object).where(b[g].notna(), None) for g in group], strict=True))
            out = []
            for k, who, n in zip(keys, b[role], b[size], strict=True):
                nobody = who is None or who != who or who == NARRATION
                if k != key:
                    key, batch, total, seq, full, closed = k, 0, 0, 0, False, False
                elif closed or (full and not (left > 0 and (nobody or who == speaker))):
                    batch, total, seq, full, closed = batch + 1, 0, 0, False, False
                seq += 1
                total += int(n) + 2 * len(str(seq))
                if full:
                    left -= 1
                elif int(total / factor) >= limit:
                    full, closed, speaker, left = True, nobody, who, extend
                out.append((batch, seq))
            yield b.assign(batch=[x for x, _ in out], sequence=[x for _, x in out])

    # the fold runs over sorted rows as they stream by: no group is ever held in memory
    kinds = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return items.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(fold, f"{kinds}, batch int, sequence int")


_WORD = re.compile(r"[A-Za-z][A-Za-z0-9'’_-]*")


def copied_runs(original: str, answer: str, min_words: int = 4, min_letters: int = 12) -> list[str]:
    """The longest runs of at least so many words and letters that an answer copies from its original, greedily
    from left to right."""
    src = [w.casefold() for w in _WORD.findall(original)]
    have = {tuple(src[i : i + min_words]): None for i in range(len(src) - min_words + 1)}
    tokens = list(_WORD.finditer(answer))
    low = [t.group().casefold() for t in tokens]
    out, i = [], 0
    while i + min_words <= len(low):
        if tuple(low[i : i + min_words]) not in have:
            i += 1
            continue
        best = 0
        for s in range(len(src)):
            n = 0
            while s + n < len(src) and i + n < len(low) and src[s + n] == low[i + n]:
                n += 1
            best = max(best, n)
        if sum(c.isalpha() for w in low[i : i + best] for c in w) >= min_letters:
            out.append(answer[tokens[i].start() : tokens[i + best - 1].end()])
            i += best
        else:
            i += 1
    return out


def token_runs(text: str) -> list[str]:
    """Runs of words that only soft gaps (blanks and ASCII signs) part."""
    out, start, end = [], None, 0
    for m in _WORD.finditer(text):
        gap = text[end : m.start()]
        if start is not None and any(ord(c) > 127 or c.isalnum() for c in gap if not c.isspace()):
            out.append(text[start:end])
            start = None
        start = m.start() if start is None else start
        end = m.end()
    return out + ([text[start:end]] if start is not None else [])


def copied_rows(rows: DataFrame, key: str, original: str, answer: str) -> DataFrame:
    """Rows whose answer copies English from its original: key and the copied runs."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            out = [(k, r) for k, o, a in zip(b[key], b[original], b[answer], strict=True) if (r := copied_runs(o or "", a or ""))]
            yield pd.DataFrame(out, columns=["key", "runs"])

    four = r"(?s)[A-Za-z].*[A-Za-z].*[A-Za-z]"
    return rows.select(key, original, answer).where(F.col(answer).rlike(four)).mapInPandas(step, "key string, runs array<string>")
