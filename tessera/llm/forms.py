"""One consistent form for text that looks the same but differs in its characters.

``canonical_texts`` explodes texts to positioned code points, broadcast-joins the mapping of every code point
(decomposition, width, look-alike, invisible), orders combining marks by class, recomposes and rebuilds the strings.

Defined results: a null text stays null, an empty one stays empty; repeated keys are a caller's error (keys are
unique by contract); texts of any length are processed whole.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stored

#: Invisible code points that Unicode does not class as format characters (fixed values).
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2065, 0x3164, 0xFFA0]
#: Signs that are drawn alike (fixed values): the first of each string stands for the others.
SIGNS = ["'’‘ʼ′`´", '"“”„″', "-‐‑‒–−﹣", "~〜～", "·・･•∙‧", ",‚", ".․", ":∶ː", ";;", "/∕⁄", "|∣ǀ", "*∗", "…⋯"]
#: Code points of the Latin, kana and Han look-alikes that differ to a reader (fixed values).
DISTINCT = "ſıɩɪʟ"


def _icu_skeletons(spark: SparkSession, points: list[int]) -> dict[int, str]:
    """Look-alike skeleton (Unicode TR 39) of each code point, by one call of the ICU that Spark ships."""
    jvm = spark.sparkContext._jvm
    checker = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    text = "\n".join(map(chr, points))
    return dict(zip(points, checker.getSkeleton(text).split("\n"), strict=True))


def _decompose(c: str) -> str:
    """Canonical decomposition, plus the compatibility mappings that keep the look: width and single signs."""
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        tag, *parts = d.split()
        to = "".join(chr(int(x, 16)) for x in parts)
        keep = tag in ("<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and len(to) == 1) or 0xFB00 <= ord(c) <= 0xFB06
        if not keep or c in DISTINCT:
            return c
        return "".join(_decompose(x) for x in to)
    return unicodedata.normalize("NFD", c)


@functools.lru_cache(maxsize=2)
def _table(app: str, spark: SparkSession) -> dict[int, str]:
    points = [
        p
        for p in [*range(0x20, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x11000), *range(0x1D000, 0x1F000), *range(0x2F800, 0x2FA20)]
        if unicodedata.category(chr(p)) not in ("Cs", "Co", "Cn")
    ]
    han = [0x4E00, 0x4E8C, 0x516B, 0x529B, 0x535C, 0x53E3, 0x5915, 0x5DE5, 0x56D7, 0x4E36, 0x4E3F, 0x5343, 0x5C71, 0x4E93, 0x5DDB, 0x722A, 0x6BDB, 0x624D, 0x53C8, 0x5200, 0x706B, 0x5342, 0x53E5, 0x4E86, 0x5DF1]
    skeleton = _icu_skeletons(spark, points + han)
    cat = unicodedata.category
    latin: dict[tuple[str, str], str] = {}
    for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)]):
        latin[skeleton[ord(c)], cat(c)] = c
    kana: dict[str, str] = {}
    for p in [*range(0x30A1, 0x30FB), 0x30FC]:
        kana.setdefault(skeleton[p], chr(p))
    alike: dict[str, str] = {}
    for p in points + han:
        c, s = chr(p), skeleton[p]
        if p < 0x80 or c in DISTINCT or unicodedata.normalize("NFD", c) != c:
            continue
        kind = cat(c)
        if kind in ("Lu", "Ll") and (t := latin.get((s, kind))):
            alike[c] = t
        elif (kind == "Lo" and (p in han or 0x3041 <= p < 0x3100 or 0x2E80 <= p < 0x2FE0 or 0x31F0 <= p < 0x3200)) and (t := kana.get(s)) and t != c:
            alike[c] = t
    for first, *rest in SIGNS:
        alike |= {c: first for c in rest}
    table: dict[int, str] = {}
    for p in points + han:
        c, kind = chr(p), cat(chr(p))
        if kind == "Cf" or p in INVISIBLE or 0xFE00 <= p <= 0xFE0F or 0x180B <= p <= 0x180D:
            to = ""
        elif kind == "Zs" or c == "\t":
            to = " "
        else:
            to = unicodedata.normalize("NFC", "".join(alike.get(x, x) for x in _decompose(c)))
        if to != c:
            table[p] = to
    table |= {p: "" for p in [*range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)]}
    table |= {9: " ", 13: ""}
    return table


def form_table(spark: SparkSession) -> dict[int, str]:
    """Code point -> what stands for it in the consistent form; usable with ``str.translate``."""
    return _table(spark.sparkContext.applicationId, spark)


def fold(text: str, table: dict[int, str]) -> str:
    """The consistent form of one text: the definition that ``canonical_texts`` computes on columns."""
    return unicodedata.normalize("NFC", text.translate(table))


def form_rows(spark: SparkSession) -> DataFrame:
    """The mapping as a table ``(ch, to, ccc)``: every code point that maps or is a combining mark; ``ccc`` is its
    class, -1 for the vowels and finals of decomposed Hangul. A few thousand rows, fixed by Unicode."""
    table = form_table(spark)
    marks = {p for p in range(0x300, sys.maxunicode) if p < 0x20000 and unicodedata.combining(chr(p))}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    rows = []
    for p in sorted(table.keys() | marks | jamo):
        to = table.get(p, chr(p))
        ccc = unicodedata.combining(to) if len(to) == 1 else 0
        rows.append((chr(p), to, -1 if p in jamo and to else ccc))
    return spark.createDataFrame(rows, "ch string, to string, ccc int")


@functools.cache
def _pairs() -> dict[str, str]:
    """Starter and mark -> composed character, by Unicode's primary compositions."""
    out = {}
    for p in [*range(0xC0, 0x3400), *range(0x11000, 0x12000)]:
        d = unicodedata.normalize("NFD", chr(p))
        if len(d) > 1 and unicodedata.combining(d[-1]):
            head = unicodedata.normalize("NFC", d[:-1])
            if len(head) == 1 and unicodedata.normalize("NFC", head + d[-1]) == chr(p):
                out[head + d[-1]] = chr(p)
    return out


def _compose(parts: Column) -> Column:
    """Join an ordered array of ``(pos, ccc, to)`` to a string, with marks ordered by class and composed."""
    flat = _pairs()
    pairs = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    apart = F.create_map(*[F.lit(x) for c in flat.values() for x in (c, unicodedata.normalize("NFD", c))])
    order = {m: unicodedata.combining(m) for c in flat.values() for m in unicodedata.normalize("NFD", c)[1:]}
    ccc = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])

    def with_marks(start: Column, marks: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            made = F.element_at(pairs, F.concat(s["s"], m["to"]))
            fits = made.isNotNull() & (s["last"] < m["ccc"])
            return F.struct(
                F.when(fits, made).otherwise(s["s"]).alias("s"),
                F.when(fits, s["rest"]).otherwise(F.concat(s["rest"], m["to"])).alias("rest"),
                F.when(fits, s["last"]).otherwise(m["ccc"]).alias("last"),
            )

        # a composed starter gives its own marks back first, before those that follow
        loose = F.element_at(apart, start)
        own = F.transform(F.split(F.substr(loose, F.lit(2)), ""), lambda m: F.struct(F.element_at(ccc, m).alias("ccc"), F.lit(-1).alias("pos"), m.alias("to")))
        both = F.when(loose.isNotNull(), F.concat(own, marks)).otherwise(marks)
        zero = F.struct(F.coalesce(F.substr(loose, F.lit(1), F.lit(1)), start).alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        made = F.aggregate(F.array_sort(both), zero, step, lambda s: F.concat(s["s"], s["rest"]))
        return F.when(F.size(marks) > 0, made).otherwise(start)

    none = F.array().cast("array<struct<ccc:int,pos:int,to:string>>")

    def hangul(start: Column, v: Column) -> Column:
        a, b = F.ascii(start), F.ascii(v)
        first = (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)
        second = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b <= 0x11C2)
        code = F.when(first, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28).when(second, a + b - 0x11A7)
        return F.when(code.isNotNull(), F.decode(F.unhex(F.hex(code)), "UTF-16BE"))

    def step(acc: Column, x: Column) -> Column:
        is_mark = x["ccc"] > 0
        joined = F.when((x["ccc"] == -1) & (F.size(acc["marks"]) == 0), hangul(acc["start"], x["to"]))
        invisible = x["to"] == ""
        return (
            F.when(invisible, acc)
            .when(is_mark, F.struct(acc["out"].alias("out"), acc["start"].alias("start"), F.concat(acc["marks"], F.array(F.struct(x["ccc"].alias("ccc"), x["pos"].alias("pos"), x["to"].alias("to")))).alias("marks")))
            .when(joined.isNotNull(), F.struct(acc["out"].alias("out"), joined.alias("start"), acc["marks"].alias("marks")))
            .otherwise(F.struct(F.concat(acc["out"], with_marks(acc["start"], acc["marks"])).alias("out"), x["to"].alias("start"), none.alias("marks")))
        )

    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("start"), none.alias("marks"))
    return F.aggregate(parts, zero, step, lambda a: F.concat(a["out"], with_marks(a["start"], a["marks"])))


def canonical_texts(texts: DataFrame, key: list[str], text: str = "text", to: str = "form") -> DataFrame:
    """``texts`` (unique ``key`` columns and ``text``) -> key columns and the consistent form of each text.

    Where ``texts`` is already hash-partitioned by ``key`` nothing is shuffled: exploding, the broadcast join (a
    table of a few thousand rows, fixed by Unicode) and the regrouping all keep that partitioning.
    """
    rows = F.broadcast(form_rows(texts.sparkSession))
    chars = texts.select(*key, F.posexplode_outer(F.split(text, "")).alias("pos", "ch"))
    mapped = chars.join(rows, "ch", "left").select(*key, "pos", F.coalesce("ccc", F.lit(0)).alias("ccc"), F.coalesce("to", "ch").alias("to"))
    parts = mapped.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "ccc", "to"))).alias("parts"),
        F.max(F.col("ccc") != 0).alias("marked"),
        F.count("to").alias("n"),
    )
    plain = F.array_join(F.transform("parts", lambda x: x["to"]), "")
    return parts.select(*key, F.when(F.col("n") == 0, None).when(F.col("marked"), _compose(F.col("parts"))).otherwise(plain).alias(to))


#: Control codes of the message language: a backslash with a name and an optional argument, or with one sign.
CONTROL = r"\\(?:[A-Za-z]+(?:\[[^\]]*\]|<[^>]*>)?|[^A-Za-z])"


def visible(text: Column) -> Column:
    """Whether a text in its consistent form has anything to see once control codes and spaces are gone."""
    return F.regexp_replace(text, CONTROL, "").rlike(r"[^\s\p{Z}\p{C}]")


#: Parts that the rows of one text are joined in, so that a text which a third of all rows hold is no task of its own.
SALTS = 16


def look_alikes(items: DataFrame, fields: list[str], key: str = "fact_id") -> DataFrame:
    """Rows ``(field, fact, h, form)`` whose joined lines belong to a class of several spellings: ``form`` tells classes
    apart, ``h`` spellings.

    Every distinct text is brought to its form once, and classes with one spelling end there. Rows stored twice count
    once; null lines are dropped, a null or invisible text has no class.
    """
    long = None
    for f in fields:
        part = items.select(F.col(key).alias("fact"), F.lit(f).alias("field"), F.array_join(F.col(f), "\n").alias("text"))
        long = part if long is None else long.unionByName(part)
    long = long.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("fact").isNotNull()).withColumn("h", F.unhex(F.md5("text")))
    texts = long.groupBy("h").agg(F.first("text").alias("text"))
    forms = canonical_texts(texts, ["h"]).where(visible(F.col("form"))).select("h", F.unhex(F.md5("form")).alias("form"))
    spelled = stored(items.sparkSession, forms, "forms")
    several = spelled.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    spellings = spelled.join(several, "form", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = long.select("field", "fact", "h", F.pmod(F.xxhash64("fact"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(spellings, ["h", "salt"]).groupBy("field", "fact", "h").agg(F.first("form").alias("form"))


def same_looking_classes(items: DataFrame, fields: list[str], key: str = "fact_id") -> DataFrame:
    """One row per field and row of a class of several spellings in that field: class and spelling (hashes), and
    ``links``, the rows of the class that are spelled otherwise. No pair is made."""
    rows = stored(items.sparkSession, look_alikes(items, fields, key), "alike")
    spelling = rows.groupBy("field", "form", "h").agg(F.count("*").alias("own"))
    whole = spelling.groupBy("field", "form").agg(F.sum("own").alias("all"), F.count("*").alias("spellings")).where("spellings > 1")
    counts = spelling.join(whole, ["field", "form"]).select("field", "form", "h", (F.col("all") - F.col("own")).alias("links"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("fact"), F.lit(SALTS)).cast("int")).join(salted, ["field", "form", "h", "salt"])
    return placed.select("field", F.col("fact").alias(key), F.hex("form").alias("class"), F.hex("h").alias("spelling"), "links")


def same_looking_pairs(items: DataFrame, fields: list[str], key: str = "fact_id") -> DataFrame:
    """Pairs ``(field, fact_a, fact_b)`` of rows whose joined lines look the same but are not the same characters.

    A view on ``look_alikes``: spellings of a class are paired with each other, never the rows within one spelling,
    and rows meet along those pairs of spellings.
    """
    rows = stored(items.sparkSession, look_alikes(items, fields, key), "alike")
    spelled = rows.groupBy("field", "form", "h").agg(F.count("*").alias("n"))
    other = spelled.select("field", "form", F.col("h").alias("other"))
    pairs = spelled.join(other, ["field", "form"]).where("h <> other").select("field", "h", "other")
    left = rows.join(pairs, ["field", "h"]).select("field", F.col("fact").alias("fact_a"), F.col("other").alias("h"))
    right = rows.select("field", F.col("fact").alias("fact_b"), "h")
    return left.join(right, ["field", "h"]).where("fact_a < fact_b").select("field", "fact_a", "fact_b")
