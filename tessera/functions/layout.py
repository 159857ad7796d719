"""Fitting lines to a width and matching wrapping punctuation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.controls import all_spans

#: Signs after which a line breaks well, and pairs of wrapping signs (fixed values).
BREAKS = "。！？…，、；：,.!?;: "
WRAPS = {"「": "」", "『": "』", "“": "”", "‘": "’", "（": "）", "【": "】"}
#: A break is taken from this share of the width on; continued lines are indented by this.
FLOOR, INDENT = 0.45, "\u3000"


def width(text: str) -> int:
    """Visible characters outside control sequences."""
    out, at = 0, 0
    for s, e, _, _ in [*all_spans(text), (len(text), len(text), "", 0)]:
        out += sum(not c.isspace() for c in text[at:s])
        at = e
    return out


def split_line(line: str, limit: int) -> list[str]:
    """A line as lines of at most ``limit``: at the last good sign past the floor, else hard, never inside a
    control sequence; lines after the first are indented where the whole is wrapped."""
    if width(line) <= limit:
        return [line]
    spans = all_spans(line)
    inside = set()
    for s, e, _, _ in spans:
        inside |= set(range(s, e))
    out, start, used, best = [], 0, 0, None
    i = 0
    while i < len(line):
        if i not in inside and not line[i].isspace():
            used += 1
        if used > limit:
            cut = best if best is not None else i
            out.append(line[start:cut])
            start = i = cut
            used, best = 0, None
            continue
        i += 1
        if i not in inside and line[i - 1] in BREAKS and (i - 1) not in inside and used >= FLOOR * limit:
            best = i
    out.append(line[start:])
    wrapped = line[:1] in WRAPS
    return [x if n == 0 or not wrapped else INDENT + x for n, x in enumerate(out) if x or n == 0]


def repair_wraps(original: str, answer: str) -> str:
    """Wrapping pairs of an answer in the signs of its original, slot by slot."""
    pairs = "".join(WRAPS) + "".join(WRAPS.values())
    want = [c for c in original if c in pairs]
    have = [i for i, c in enumerate(answer) if c in pairs]
    if len(want) != len(have):
        return answer
    out = list(answer)
    for i, c in zip(have, want, strict=True):
        if (answer[i] in WRAPS) == (c in WRAPS):
            out[i] = c
    return "".join(out)


def wrapped_rows(rows: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """The lines of each text fitted to the width: key, lines."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, [p for line in (t or "").split("\n") for p in split_line(line, limit)]) for k, t in zip(b[key], b[text], strict=True)]
            yield pd.DataFrame(out, columns=["key", "lines"])

    return rows.select(key, text).mapInPandas(step, "key string, lines array<string>")


def mask_terms(text: str, terms: list[str], ignore_case: bool = False) -> str:
    """Allowed terms blanked, longest first; without case they need word boundaries."""
    for t in sorted(terms, key=len, reverse=True):
        p = rf"(^|[^A-Za-z0-9_]){re.escape(t)}([^A-Za-z0-9_]|$)" if ignore_case else re.escape(t)
        text = re.sub(p, r"\1 \2" if ignore_case else " ", text, flags=re.I if ignore_case else 0)
    return text


def render(template: str, **fields: str) -> str:
    """``{name}`` fields put in; an unknown or missing one is an error."""
    names = re.findall(r"\{([A-Za-z_]\w*)\}", template)
    if set(names) != set(fields):
        raise ValueError("render_template_invalid")
    return re.sub(r"\{([A-Za-z_]\w*)\}", lambda m: fields[m[1]], template)


def edit_commands(commands: list[dict], lines: list[str], anchors: list[int], code: int) -> list[dict]:
    """The text rows of one block set to ``lines``: surplus rows deleted from the end, extra ones inserted
    behind the last anchor with its indent; the anchors must be rows of the expected code."""
    if any(commands[i]["code"] != code for i in anchors):
        raise ValueError("anchor_code_mismatch")
    out = list(commands)
    for i, line in zip(anchors, lines, strict=False):
        out[i] = out[i] | {"parameters": [line]}
    for i in sorted(anchors[len(lines) :], reverse=True):
        del out[i]
    last = anchors[min(len(anchors), len(lines)) - 1] if lines else None
    if last is not None:
        for n, line in enumerate(lines[len(anchors) :], 1):
            out.insert(last + n, {"code": code, "indent": commands[last].get("indent", 0), "parameters": [line]})
    return out


def covered(candidates, spans):
    """Whether a span ``(start, stop)`` lies within one of an array of spans, as a column expression."""
    return F.exists(spans, lambda s: (s["start"] <= candidates["start"]) & (s["stop"] >= candidates["stop"]))


def masked_terms(text: Column, terms: list[str], ignore_case: bool = False) -> Column:
    """X37 on columns: allowed terms blanked, longest first; without case they need word boundaries."""
    out = text
    for t in sorted((t for t in terms if t), key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?i)(^|[^A-Za-z0-9_]){re.escape(t)}([^A-Za-z0-9_]|$)", "$1 $2") if ignore_case else F.regexp_replace(out, re.escape(t), " ")
    return out


def rendered(template: str, **fields: Column) -> Column:
    """X52 on columns: a template with its ``{name}`` marks filled; a mark without a field, or the other way round, is an
    error."""
    names = re.findall(r"\{([^{}]*)\}", template)
    if set(names) != set(fields):
        raise ValueError("render_template_invalid")
    parts = re.split(r"\{[^{}]*\}", template)
    return F.concat(F.lit(parts[0]), *[x for n, p in zip(names, parts[1:], strict=True) for x in (fields[n], F.lit(p))])
