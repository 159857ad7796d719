"""Terms in texts: containment joins without comparing every term to every text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a term that find its candidates.
GRAM = 3


def _gram(at, n: int):
    return lambda _, i: F.concat(*[at(i, k) for k in range(n)])


def contained(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``(key, term)`` of every term that a text contains. Texts and terms meet on the term's first
    characters (an equi join that shuffles and splits like any other), the whole term is checked where it would
    start; terms shorter than that meet on what they have."""
    t = terms.select(F.col(term).alias("term")).where(F.length(term) > 0).distinct()
    t = t.withColumn("n", F.least(F.length("term"), F.lit(GRAM))).withColumn("gram", F.substring("term", 1, GRAM))
    lengths = [r["n"] for r in t.select("n").distinct().collect()]  # at most GRAM values
    if not lengths:
        return texts.select(key).limit(0).withColumn("term", F.lit(None).cast("string"))

    # characters once as an array, so that each place costs the same however long the text is
    some = texts.where(F.length(text) > 0).select(key, text, F.split(text, "").alias("_chars"))
    at = lambda i, k: F.coalesce(F.try_element_at(F.col("_chars"), i + F.lit(k + 1)), F.lit(""))
    grams = [F.transform("_chars", _gram(at, n)) for n in sorted(lengths)]
    some = some.select(key, F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("gram"))
    # candidates travel without the text, which only they meet again
    candidates = some.join(t.select("gram", "term"), "gram").select(key, "term").distinct()
    return candidates.join(texts.select(key, text), key).where(F.contains(F.col(text), F.col("term"))).select(key, "term").distinct()


def tagged_by_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits ``(tag, file_name)`` with the rules of their tag whose file pattern (``*`` globs) fits."""
    regex = F.concat(F.lit("^"), F.replace(F.regexp_replace("file_pattern", r"[.\\+?^$()\[\]{}|]", r"\\$0"), F.lit("*"), F.lit(".*")), F.lit("$"))
    r = rules.select("rule_id", "tag", regex.alias("file_regex"))
    return hits.join(r, "tag").where(F.expr("file_name rlike file_regex")).drop("file_regex")


def commands_by_rules(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """Commands ``(code, parameters)`` with the rules ``(code, filters: index -> value)`` of their code whose
    filters all hold; a parameter that isn't there holds for none."""
    holds = F.forall(F.map_entries("filters"), lambda f: F.coalesce(F.try_element_at(F.col("parameters"), f["key"] + 1) == f["value"], F.lit(False)))
    return commands.join(rules, "code").where(holds).drop("filters")
