"""Speakers written into the first line of a message: rules that take a line apart, and the line put together again.

A rule is ``(name, pattern, speaker group, body group or "", policy, template)``. It holds for a line if its first match
spans the whole trimmed line. Two rules for one line are a conflict and name no speaker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame


class Rule(NamedTuple):
    name: str
    pattern: str
    speaker: str
    body: str = ""
    policy: str = "translate"
    template: str = "{speaker}"


_ACTOR = re.compile(r"\\[Nn]\[(\d+)\]")
SCHEMA = "key string, rule string, speaker string, source_speaker string, body string, rendered string, parts array<struct<kind:string,text:string>>, error string"


def split_colon(speaker: str, body: str) -> tuple[str, str] | None:
    """The speaker without the colons that set it off from a body; None where nobody is named."""
    who, said = speaker.strip(), body.strip()
    bare = who.rstrip(":：").rstrip()
    if not who or (bare != who and said and not bare):
        return None
    return (bare if said else who), said


def parts(line: str, m: re.Match, rule: Rule) -> list[tuple[str, str]]:
    """Shell, speaker and body of a line in order; put together they are the line again."""
    spans = sorted((m.span(g), kind) for g, kind in ((rule.speaker, "speaker"), (rule.body, "body")) if g and m[g] is not None)
    out, at = [], 0
    for (a, b), kind in spans:
        if a < at:
            raise ValueError("groups_overlap")
        out += [("shell", line[at:a]), (kind, line[a:b])]
        at = b
    return [(k, t) for k, t in [*out, ("shell", line[at:])] if t]


def take_apart(text: str, rules: list[Rule], actors: dict[int, str]) -> tuple | None:
    """``(rule, speaker, source speaker, body, rendered, parts, error)`` of a line, or None where no rule holds."""
    line = text.strip()
    held = [(r, m) for r in rules if (m := re.search(r.pattern, line)) and m.span() == (0, len(line))]
    if not held:
        return None
    if len(held) > 1:
        return ("|".join(r.name for r, _ in held), None, None, None, None, [], "rules_conflict")
    rule, m = held[0]
    meant = split_colon(m[rule.speaker] or "", (m[rule.body] or "") if rule.body else "")
    if meant is None:
        return (rule.name, None, None, None, None, [], "speaker_empty")
    source, body = meant
    speaker = source
    if rule.policy == "actor_name":
        code = _ACTOR.fullmatch(source)
        speaker = actors.get(int(code[1])) if code else None
        if not speaker:
            return (rule.name, None, source, body, None, [], "actor_unknown")
    rendered = rule.template.replace("{speaker}", m[rule.speaker] or "").replace("{body}", (m[rule.body] or "") if rule.body else "")
    return (rule.name, speaker, source, body, rendered, parts(line, m, rule), None)


def boxes(rows: DataFrame, key: str, text: str, rules: list[Rule], actors: dict[int, str] | None = None) -> DataFrame:
    """The rows that a rule holds for, taken apart (see SCHEMA). ``rules`` and ``actors`` are a project's, a few by
    contract."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *x[:5], [{"kind": a, "text": t} for a, t in x[5]], x[6]) for k, t in zip(b[key], b[text], strict=True) if t and (x := take_apart(t, rules, actors or {}))]
            yield pd.DataFrame(out, columns=["key", "rule", "speaker", "source_speaker", "body", "rendered", "parts", "error"])

    return rows.select(key, text).mapInPandas(step, SCHEMA)
