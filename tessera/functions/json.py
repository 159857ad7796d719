"""JSON documents as leaf relations, and their paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\['((?:[^'\\]|\\.)*)'\]|\[(\d+)\]|\[(\*)\]")


def quote_key(key: str) -> str:
    """X24."""
    return "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse_path(path: str) -> list[str | int | None]:
    """The steps of ``$['k'][0][*]`` (keys, indices, None for the wildcard); anything else is an error."""
    if not path.startswith("$"):
        raise ValueError("path_template_invalid")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError("path_template_invalid")
        out.append(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else int(m[2]) if m[2] else None)
        at = m.end()
    return out


def template_regex(template: str) -> str:
    """A template as an anchored regular expression; the wildcard stands for an index only."""
    return "^" + re.escape(template).replace(re.escape("[*]"), r"\[[0-9]+\]") + "$"


def slash_path(path: Column) -> Column:
    """``$['a'][0]`` as ``a/0``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^\$\['?", ""), r"'?\]\['?", "/"), r"'?\]$", "")


def generalise(path: Column) -> Column:
    """A path with its indices as wildcards, so that templates join by equality."""
    return F.regexp_replace(path, r"\[[0-9]+\]", "[*]")


def matched_templates(leaves: DataFrame, templates: DataFrame) -> DataFrame:
    """Leaves with the templates ``(template)`` their path fits. They meet where both are equal with all indices as
    wildcards; an index that a template fixes is then compared."""
    t = templates.select("template", generalise(F.col("template")).alias("_general"), F.regexp_extract_all("template", F.lit(r"\[([0-9]+|\*)\]"), F.lit(1)).alias("_wanted"))
    own = leaves.withColumn("_general", generalise(F.col("path"))).withColumn("_has", F.regexp_extract_all("path", F.lit(r"\[([0-9]+|\*)\]"), F.lit(1)))
    fits = F.forall(F.zip_with("_wanted", "_has", lambda w, h: (w == "*") | (w == h)), lambda x: x)
    return own.join(t, "_general").where(fits).drop("_general", "_wanted", "_has")


def walk(value, path: str = "$", into_strings: bool = False) -> Iterator[tuple[str, str | None, str]]:
    """``(path, text, type)`` of every leaf in document order; with ``into_strings`` strings that hold JSON
    containers are walked into."""
    if isinstance(value, str) and into_strings and value.strip()[:1] in ("{", "["):
        try:
            inner = json.loads(value)
        except ValueError:
            inner = None
        if isinstance(inner, (dict, list)):
            value = inner
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}[{quote_key(k)}]", into_strings)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]", into_strings)
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
        yield path, value if isinstance(value, str) or value is None else json.dumps(value), kind


def leaves(docs: DataFrame, key: str, doc: str, into_strings: bool = False) -> DataFrame:
    """One row per leaf: key columns, path, value, value_type; a document that isn't JSON has none."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, d in zip(b[key], b[doc], strict=True):
                try:
                    v = json.loads(d) if d else None
                except ValueError:
                    continue
                if d:
                    out += [(k, *leaf) for leaf in walk(v, "$", into_strings)]
            yield pd.DataFrame(out, columns=["key", "path", "value", "value_type"])

    return docs.select(F.col(key).cast("string").alias(key), doc).mapInPandas(step, "key string, path string, value string, value_type string")


def set_path(value, steps: list[str | int], new: str):
    """The document with the string at a path replaced; shells (JSON inside strings) are opened and closed."""
    if not steps:
        return new
    if isinstance(value, str):
        return json.dumps(set_path(json.loads(value), steps, new), ensure_ascii=False)
    value[steps[0]] = set_path(value[steps[0]], steps[1:], new)
    return value


def apply_edits(docs: DataFrame, edits: DataFrame, key: str, doc: str) -> DataFrame:
    """Edits ``(key, path, new)`` put into their documents; only changed documents come out: key, content. An
    edit of a document that isn't JSON is an error, one of an unknown document is left out."""

    def apply(k: tuple, d: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not d.empty and not e.empty and d[doc].iloc[0]:
            value = json.loads(d[doc].iloc[0])
            before = json.dumps(value, ensure_ascii=False)
            for path, new in zip(e["path"], e["new"], strict=True):
                value = set_path(value, parse_path(path), new)
            after = json.dumps(value, ensure_ascii=False)
            if after != before:
                rows.append((k[0], after))
        return pd.DataFrame(rows, columns=["key", "content"])

    return docs.select(F.col(key).cast("string").alias("key"), doc).groupBy("key").cogroup(edits.groupBy("key")).applyInPandas(apply, "key string, content string")


def fingerprint(doc: str) -> str:
    """sha256 of the canonical JSON (keys sorted, no white space, non-ASCII kept)."""
    import hashlib

    return hashlib.sha256(json.dumps(json.loads(doc), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fingerprints(docs: DataFrame, key: str, doc: str) -> DataFrame:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda d: fingerprint(d) if d else None).astype(object)

    return docs.select(key, f(doc).alias("fingerprint"))
