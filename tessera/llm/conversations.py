"""Rebuilding ordered conversations from message rows by keyed streaming state.

Every message row is reduced on the JVM side to ``(game_id, conv, fact_id, position, speaker, sound, event time)``.
``assemble`` buffers the messages of a conversation in keyed state under an event-time watermark; late arrivals join
the buffer, and when the watermark passes the conversation's last message by ``timeout`` it is validated and emitted
whole, in order, or left out. State and validation stay in the JVM. ``assemble_backlog`` runs a stored table through the
same operator in micro-batches of bounded size. Its rows lie in no order of time, so the delay and the timeout are the
time the table spans: no row is late, whichever batch it comes in. Once all batches are taken the end of the input is
streamed as one event beyond all others, at which every open conversation times out.

Defined results: rows whose path is no message's are left out; a null game_id is a game of its own; rows stored twice
count once; a null or non-numeric position, two messages at one position, an invisible message, a message without
speaker, a line count that differs from the path count, or fewer than two speakers leave the whole conversation out;
a message without any time takes the earliest time of the table; an empty input gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.forms import CONTROL, form_table
from tessera.session import remove, scratch

NARRATION = "旁白"
PLAYER = "\x00player"
_PATH = r"(?i)^(?:.*/)?(map[0-9]+|troops|commonevents)\.json((?:/[0-9]+)+)/([^/]*)$"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "game_id long, conv string, turn int, fact_id string"


def _fold(text: Column, spark: SparkSession) -> Column:
    """The consistent form without recomposition, which names and visibility don't need: one ``translate`` for the
    one-to-one mappings (those to nothing included)."""
    table = {k: v for k, v in form_table(spark).items() if len(v) <= 1 and k < 0x10000}
    one = [(chr(k), v) for k, v in table.items() if v]
    gone = [chr(k) for k, v in table.items() if not v]
    return F.translate(text, "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one))


def _fold_names(table: dict[int, str]):
    from tessera.llm.forms import fold

    @F.pandas_udf("string")
    def names(s: pd.Series) -> pd.Series:
        seen = {x: fold(x, table).strip() for x in s.dropna().unique()}
        return s.map(seen).astype(object).where(s.notna(), None)

    return names


def event_time(otherwise: Column | None = None) -> Column:
    """When a message was said: saved, else loaded, else the time given."""
    return F.coalesce("saved_at", "loaded_at", *([] if otherwise is None else [otherwise])).cast("timestamp")


def message_rows(items: DataFrame, otherwise: Column | None = None) -> DataFrame:
    """``translation_items`` rows -> one row per message with what validation needs (no texts); a message without any
    time takes ``otherwise``."""
    spark = items.sparkSession
    path = F.regexp_replace(F.translate(F.trim("location_path"), "\\", "/"), "/+", "/")
    stem = F.regexp_extract(path, _PATH, 1)
    file = F.when(F.lower(stem).startswith("map"), F.concat(F.lit("Map"), F.substring(stem, 4, 100))).when(F.lower(stem) == "troops", "Troops").otherwise("CommonEvents")
    middle = F.regexp_extract(path, _PATH, 2)
    depth = F.length(middle) - F.length(F.replace(middle, F.lit("/"), F.lit("")))
    is_message = (F.lower(stem).isin("commonevents") & (depth == 1)) | ((stem != "") & (F.lower(stem) != "commonevents") & (depth == 2))
    last = F.trim(F.regexp_extract(path, _PATH, 3))
    lines = F.coalesce(F.filter("original_lines", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    text = _fold(F.array_join(lines, "\n"), spark)
    visible = F.regexp_replace(text, CONTROL, "").rlike(r"[^\s\p{Z}\p{C}]")
    # leading control codes other than the name code
    first = F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), r"^(?:\\(?![nN]<)(?:[A-Za-z]+(?:\[[^\]]*\])?|[^A-Za-z])|\s)*", "")
    marked = F.coalesce(
        *[
            F.nullif(F.regexp_extract(first, p, 1), F.lit(""))
            for p in (r"^\\[nN]<([^<>]+)>", r"^【([^【】]+)】", r"^([^\s「」『』。、，,！？!?（）()]+) ?[「『]", r"^([^\s:：。、，,！？!?「」\\]+)[:：]")
        ]
    )
    blank = r"[^\s\p{Z}\p{C}]"
    role = F.when(F.regexp_replace(F.coalesce(_fold(F.col("role"), spark), F.lit("")), CONTROL, "").rlike(blank), F.col("role"))
    speaker = F.when(F.col("item_type") == "array", PLAYER).otherwise(_fold_names(form_table(spark))(F.coalesce(role, marked)))
    counts = (F.coalesce("item_type", F.lit("")) != "long_text") | (F.coalesce(F.size("original_lines"), F.lit(0)) == F.coalesce(F.size("source_line_paths"), F.lit(0)))
    return (
        items.where(is_message & F.col("fact_id").isNotNull())
        .select(
            "game_id",
            F.concat(file, F.lit(".json"), middle).alias("conv"),
            "fact_id",
            F.when(last.rlike(r"^[0-9]{1,18}$"), last).try_cast("long").alias("pos"),
            F.nullif(speaker, F.lit("")).alias("speaker"),
            (visible & counts).alias("sound"),
            event_time(otherwise).alias("at"),
        )
    )


def assemble(messages: DataFrame, delay: str = "7 days", timeout: str = "30 days") -> DataFrame:
    """The streaming operator: messages (see ``message_rows``) -> turns of validated conversations, in append mode.

    The state of a conversation is the buffer of its messages, kept per session: a conversation is closed once the
    watermark (``delay`` behind the latest event time) is ``timeout`` past its last message, so messages that arrive
    out of order or late still find their buffer. Closed conversations are validated and emitted as a whole.
    """
    row = F.struct("pos", "fact_id", "speaker", "sound")
    closed = messages.withWatermark("at", delay).groupBy(F.session_window("at", timeout), "game_id", "conv").agg(F.array_sort(F.collect_list(row)).alias("all"))
    return turns(closed)


def turns(closed: DataFrame) -> DataFrame:
    """Validate whole conversations ``(game_id, conv, all: messages in order)`` and number the turns of the sound ones.
    Everything is judged between neighbours of the ordered buffer, so its cost grows with its length only."""
    once = F.filter("all", lambda x, i: (i == 0) | ~x.eqNullSafe(F.col("all")[F.greatest(i - 1, F.lit(0))]))
    one = closed.select("game_id", "conv", once.alias("rows"))
    sound = F.forall("rows", lambda x: x["sound"] & x["pos"].isNotNull() & x["speaker"].isNotNull())
    apart = ~F.exists(F.transform("rows", lambda x, i: (i > 0) & (x["pos"] == F.col("rows")[F.greatest(i - 1, F.lit(0))]["pos"])), lambda same: same)
    voices = F.transform(F.filter("rows", lambda x: x["speaker"] != NARRATION), lambda x: x["speaker"])
    several = F.array_min(voices) < F.array_max(voices)
    kept = one.where(sound).where(apart).where(several)
    return kept.select("game_id", "conv", F.posexplode("rows").alias("turn", "x")).select("game_id", "conv", "turn", F.col("x.fact_id").alias("fact_id"))


def assemble_backlog(spark: SparkSession, path: str, batch_bytes: int | None = None) -> DataFrame:
    """All conversations of the stored table at ``path``: a stream of micro-batches of at most ``batch_bytes`` of files
    (by default what the cores take in one wave of splits), then of the end of the input, written to the shared folder,
    from which the result is read."""
    home = scratch(spark, "conversations")
    table = spark.read.parquet(path)
    first, last = table.select(F.min(event_time()), F.max(event_time())).head()
    if last is None:  # no row has a time: any one will do
        first = last = dt.datetime(2000, 1, 1)
    span = f"{(last - first).days + 1} days"
    if batch_bytes is None:
        batch_bytes = 128 * 2**20 * spark.sparkContext.defaultParallelism
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is as good a source as a folder
    ends = f"{home}/ends"
    end = spark.range(1, numPartitions=1).select(
        F.lit(None).cast("long").alias("game_id"), F.lit("").alias("conv"), F.lit("").alias("fact_id"), F.lit(None).cast("long").alias("pos"),
        F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("sound"), (F.lit(last).cast("timestamp") + F.expr(f"interval {3 * ((last - first).days + 2)} days")).alias("at"),
    )
    end.limit(0).write.parquet(ends)
    # state on disk, not in the heap: a backlog may be larger than the executors' memory
    provider = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", batch_bytes).parquet(glob)
        messages = message_rows(rows, F.lit(first).cast("timestamp_ntz")).unionByName(spark.readStream.schema(end.schema).parquet(ends))
        query = assemble(messages, span, span).writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").start()
        try:
            query.processAllAvailable()
            end.write.mode("append").parquet(ends)
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.unset(_PROVIDER) if provider is None else spark.conf.set(_PROVIDER, provider)
    remove(spark, f"{home}/state")
    return spark.read.schema(_OUT).parquet(f"{home}/out")
