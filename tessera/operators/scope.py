"""Which facts are pending, stale, translated or covered: joins, set operations and counts over identities.

Every operator is a plain equi, semi or anti join or a grouped count, left to Catalyst to place; nothing is
collected and no side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["fact_id", "raw_hash", "translatable_hash"]
PLACE = ["game_id", "location_path"]


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row per key, the one with the greatest ``by`` (nulls last): rows stored twice count once.

    Each column is its own aggregate, so columns that a query doesn't use are never read. Rows of one key that are
    equal in ``by`` are taken to be equal.
    """
    order = F.struct(F.col(by).isNotNull(), F.col(by))
    picked = [F.max_by(c, order).alias(c) for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(*picked).select(*rows.columns)


def in_index(facts: DataFrame, index: DataFrame) -> DataFrame:
    """Facts with what the index says of their place."""
    return facts.join(index, PLACE)


def translated(facts: DataFrame, translations: DataFrame) -> DataFrame:
    """Facts joined to translations of the same full identity."""
    return facts.join(translations.drop(*[c for c in PLACE if c in translations.columns]), IDENTITY)


def writable_facts(facts: DataFrame, index: DataFrame) -> DataFrame:
    return facts.join(index.where("writable"), PLACE, "left_semi")


def pending(facts: DataFrame, index: DataFrame, translations: DataFrame) -> DataFrame:
    """Writable facts without a translation of the same identity."""
    return writable_facts(facts, index).join(translations, IDENTITY, "left_anti")


def stale(translations: DataFrame, facts: DataFrame, index: DataFrame) -> DataFrame:
    """Translations that match no current writable fact."""
    return translations.join(writable_facts(facts, index), IDENTITY, "left_anti")


def pending_places(index: DataFrame, translations: DataFrame) -> DataFrame:
    """The form keyed by place alone, blind to hashes."""
    return index.where("writable").join(translations, PLACE, "left_anti")


def open_errors(errors: DataFrame, facts: DataFrame, index: DataFrame, translations: DataFrame) -> DataFrame:
    """Quality errors of current indexed facts that are still untranslated."""
    live = facts.join(index, PLACE, "left_semi").join(translations, IDENTITY, "left_anti")
    return errors.where("fact_id <> ''").join(live.select("fact_id"), "fact_id", "left_semi")


def unresolved(translations: DataFrame, facts: DataFrame) -> DataFrame:
    """Translations whose identity no fact has; a write-back refuses to run unless this is empty."""
    return translations.join(facts, IDENTITY, "left_anti")


def write_back_rows(translations: DataFrame, facts: DataFrame, index: DataFrame) -> DataFrame:
    """Translations with their current fact at a writable place."""
    return translated(writable_facts(facts, index), translations)


def domain_summary(facts: DataFrame, index: DataFrame, hits: DataFrame) -> DataFrame:
    """Per domain the items, writable and unwritable ones and rule hits; a domain may have hits only."""
    a = facts.join(index, PLACE, "left").groupBy("domain").agg(
        F.count("*").alias("items"), F.count_if(F.coalesce("writable", F.lit(False))).alias("writable"), F.count_if(~F.coalesce("writable", F.lit(False))).alias("unwritable")
    )
    b = hits.groupBy("domain").agg(F.count("*").alias("hits"), F.count_if(~F.col("extractable")).alias("inactive_hits"))
    return a.join(b, "domain", "full_outer").na.fill(0)


def rule_hit_summary(hits: DataFrame) -> DataFrame:
    """A04."""
    return hits.groupBy("domain", "rule_key").agg(
        F.count("*").alias("hits"), F.countDistinct("location_path").alias("places"), F.count_if("extractable").alias("extractable"),
        F.count_if("writable").alias("writable"), F.count_if(~F.col("writable")).alias("unwritable"),
    )


def gate(facts: DataFrame, index: DataFrame, translations: DataFrame, errors: DataFrame, required: DataFrame) -> DataFrame:
    """Pending counts writable facts, translated counts active ones, missing required places keep duplicates."""
    spark_one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        spark_one(pending(facts, index, translations), "pending"),
        spark_one(facts.join(translations, IDENTITY, "left_semi"), "translated"),
        spark_one(errors.join(facts, "fact_id", "left_semi"), "errors"),
        spark_one(required.join(index, PLACE, "left_anti"), "missing_required"),
    ]
    rows = None
    for p in parts:
        one = p.select(F.lit(p.columns[0]).alias("measure"), F.col(p.columns[0]).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order of ``order`` (nulls first), then of its other columns: a least value,
    pre-aggregated before the shuffle however often a key occurs."""
    rest = [c for c in rows.columns if c not in key]
    least = F.min(F.struct(F.struct(*order).alias("_o"), F.struct(*rest).alias("_r"))).alias("_m")
    return rows.groupBy(*key).agg(least).select(*key, "_m._r.*").select(*rows.columns)


def first_n(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key (a sampling operator: the bound is the feature). Every task keeps but ``n``
    rows of a key before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rn") <= n)


def total_and_samples(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """How many there are, and the first ``n`` as an ordered list."""
    top = rows.orderBy(*order).limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[0]]), "|").alias("samples"))
    one = F.lit(1).alias("one")
    return rows.agg(F.count("*").alias("total")).select(one, "total").join(top.select(one, "samples"), "one").drop("one")


def limited(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Ordered rows, at most ``limit`` (None for all); a limit that isn't positive is an error."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def set_fingerprint(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """A fingerprint of each group's members whatever their order: their number and the sum of 60 bits of their
    hashes, so that it is pre-aggregated before the shuffle however large a group is."""
    part = F.conv(F.substring(F.sha2(member, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def canonical_fingerprint(rows: DataFrame, group: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The hash of each group's members as one JSON list, ordered and with sorted keys. A hash over a list reads it
    whole, so groups are a file's or a project's by contract; ``set_fingerprint`` is for groups of any size."""
    member = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in sorted(fields)]).alias("_m"))
    whole = F.to_json(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["_m"]), {"ignoreNullFields": "false"})
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.sha2(whole, 256).alias("fingerprint"))


def first_keys(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The least ``order`` of each key, pre-aggregated before the shuffle however often a key occurs."""
    return rows.groupBy(*key).agg(F.min(order).alias(order))


def answers_by_prompt(items: DataFrame, responses: DataFrame, batch: str, prompt: str) -> DataFrame:
    """The answer of each item ``(batch, prompt)``: unknown prompts are left out; a batch in which a known prompt is
    answered twice fails as a whole. Adds ``error``: null, missing or duplicate_prompt."""
    known = responses.join(items.select(batch, prompt).distinct(), [batch, prompt], "left_semi")
    bad = known.groupBy(batch, prompt).agg(F.count("*").alias("_n")).where("_n > 1").select(batch).distinct().withColumn("_bad", F.lit(True))
    rest = known.join(bad, batch, "left_anti").withColumn("_got", F.lit(True))
    out = items.join(rest, [batch, prompt], "left").join(bad, batch, "left")
    return out.withColumn("error", F.when(F.col("_bad"), "duplicate_prompt").when(F.col("_got").isNull(), "missing")).drop("_bad", "_got")


def glossary_for(items: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms of an item ``(key, game_id, role, display_name, owner, system)`` by exact match: its role, the display
    name of its place, the terms of its owner, and of a system text all system terms. Glossary: ``(game_id, term, owner,
    system)``."""
    g = glossary.select("game_id", "term", F.col("owner").alias("t_owner"), F.col("system").alias("t_system")).distinct()
    terms = g.select("game_id", "term").distinct()
    named = items.select("key", "game_id", F.explode(F.array_distinct(F.array_compact(F.array("role", "display_name")))).alias("term")).join(terms, ["game_id", "term"])
    owned = items.where("not system").join(g.where("not t_system").withColumnRenamed("t_owner", "owner"), ["game_id", "owner"])
    system = items.where("system").join(g.where("t_system").select("game_id", "term"), "game_id")
    out = [x.select("key", "term") for x in (named, owned, system)]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def risk(candidates: DataFrame, by: str) -> DataFrame:
    """How much of a project's scripts is shown to players: active candidates, strong ones weighing three, by file."""
    strong, medium = (F.count_if(F.col("strength") == k) for k in ("strong", "medium"))
    files = candidates.where("active").groupBy(by).agg(strong.alias("strong"), medium.alias("medium")).withColumn("score", 3 * F.col("strong") + F.col("medium"))
    one = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("strong", "medium", "score")], F.count_if(F.col("score") >= 250).alias("files_over_250"), F.coalesce(F.max("score"), F.lit(0)).alias("max_score"), F.count_if((F.col("score") >= 300) & (F.col("strong") >= 80)).alias("heavy"))
    return one.select("strong", "medium", "score", "files_over_250", "max_score", ((F.col("strong") >= 300) | (F.col("score") >= 2000) | (F.col("files_over_250") >= 3) | (F.col("heavy") > 0)).alias("high_risk"))


def fan_out(results: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """A representative's result for every item of its key."""
    return items.join(results, key)
