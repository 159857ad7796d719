"""Control sequences of message texts: spans with offsets, placeholders, masking, verification and restoring.

Offsets and per-row state don't fit column expressions, so these run as Arrow-batched functions; texts without a
backslash, percent sign or bracket never need them (callers filter on that first).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes with a number and their placeholder names; signs and theirs (fixed values).
INDEXED = {"V": "VARIABLE", "N": "ACTOR_NAME", "P": "PARTY_MEMBER_NAME", "C": "TEXT_COLOR", "I": "ICON", "PX": "TEXT_X_POSITION", "PY": "TEXT_Y_POSITION", "FS": "FONT_SIZE"}
SYMBOLS = {"{": "FONT_LARGER", "}": "FONT_SMALLER", "\\": "BACKSLASH", "$": "SHOW_GOLD_WINDOW", ".": "WAIT_SHORT", "|": "WAIT_LONG", "!": "WAIT_INPUT", ">": "INSTANT_TEXT_ON", "<": "INSTANT_TEXT_OFF", "^": "NO_WAIT"}
#: Escapes that a text spells out, and their placeholder names (fixed values).
LITERALS = {'"': "DOUBLE_QUOTE", "'": "SINGLE_QUOTE", "/": "SLASH", "?": "QUESTION_MARK", "a": "BELL", "b": "BACKSPACE", "f": "FORM_FEED", "n": "LINE_BREAK", "r": "CARRIAGE_RETURN", "t": "TAB", "v": "VERTICAL_TAB"}
LINE_BREAK = "[RMMZ_LITERAL_LINE_BREAK]"
_STANDARD = re.compile(
    r"\\(?P<code>(?i:V|N|P|C|I|PX|PY|FS))\[(?P<num>\d+)\]|\\(?P<gold>[Gg])(?![A-Za-z\[])|\\(?P<sign>[{}\\$.|!><^])|%(?P<arg>\d+)"
    r"|(?P<UNICODE>\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}))|(?P<HEX>\\x[0-9A-Fa-f]{2})|(?P<OCTAL>\\[0-7]{1,3}+(?!\[))|\\(?P<literal>[\"'/?abfnrtv])"
)
PLACEHOLDER = re.compile(r"\[(?:RMMZ|CUSTOM)_[A-Z0-9_]+\]", re.I)
#: What may be a control sequence that no rule knows (fixed values).
_RAW = [re.compile(r"\\[A-Za-z]+\d*\[[A-Za-z0-9_./:-]{1,32}[^\]\w\s\[\]\\]|\\[A-Za-z]+\d*\[[^\]\r\n]{0,64}\]"), re.compile(r"\\[{}\\$.\|!><^]"), re.compile(r"\\(?P<code>[A-Za-z]+)\d*")]


def raw_candidates(text: str) -> list[tuple[int, int]]:
    """X11: where a text holds what may be a control sequence: with an argument, a sign, or a bare code that is short or
    has a capital; none overlaps another."""
    out: list[tuple[int, int]] = []
    for kind in _RAW:
        for m in kind.finditer(text):
            code = m.groupdict().get("code")
            if code and len(code) > 3 and code.islower():
                continue
            if not any(m.start() < e and s < m.end() for s, e in out):
                out.append(m.span())
    return sorted(out)


def standard_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, placeholder, priority)`` of the standard control sequences and spelled-out escapes; X14: none
    that only begins a longer control sequence."""
    ends = dict(raw_candidates(text))
    out = []
    for m in _STANDARD.finditer(text):
        if m.end() < ends.get(m.start(), 0):
            continue
        if m["code"]:
            name = f"[RMMZ_{INDEXED[m['code'].upper()]}_{m['num']}]"
        elif m["gold"]:
            name = "[RMMZ_CURRENCY_UNIT]"
        elif m["sign"]:
            name = f"[RMMZ_{SYMBOLS[m['sign']]}]"
        elif m["arg"]:
            name = f"[RMMZ_MESSAGE_ARGUMENT_{m['arg']}]"
        elif m["literal"]:
            name = f"[RMMZ_LITERAL_{LITERALS[m['literal']]}]"
        else:
            name = f"[RMMZ_LITERAL_{m.lastgroup}_ESCAPE_{m.group().encode().hex().upper()}]"
        out.append((m.start(), m.end(), name, 0))
    return out


def custom_spans(text: str, rules: list[tuple[str, str]]) -> list[tuple[int, int, str, int]]:
    """Spans of user rules ``(pattern, name)``; the number of a placeholder follows when texts are masked."""
    return [(m.start(), m.end(), f"[CUSTOM_{name}_", 1) for p, name in rules for m in re.finditer(p, text) if m.end() > m.start()]


class RuleError(ValueError):
    """A paired rule whose groups don't fit the text it matches."""


def paired_spans(text: str, rules: list[tuple]) -> list[tuple[int, int, str, int]]:
    """Shells of paired rules ``(pattern, name)``, of which everything a match holds but its group ``text`` is
    protected, or ``(pattern, text group, {protected group: name})``, of which the named groups are. A protected group
    that is missing, empty, or overlaps the text or another one is an error."""
    out = []
    for p, *rule in rules:
        for m in re.finditer(p, text):
            if len(rule) == 1:
                a, b = m.span("text")
                out += [(s, e, f"[CUSTOM_{rule[0]}_", 2) for s, e in ((m.start(), a), (b, m.end())) if e > s]
                continue
            held, groups = rule
            if m[held] is None:
                raise RuleError(f"group_missing:{held}")
            taken = [m.span(held)]
            for group, name in groups.items():
                if m[group] is None:
                    raise RuleError(f"group_missing:{group}")
                a, b = m.span(group)
                if a == b:
                    raise RuleError(f"group_empty:{group}")
                if any(a < e and s < b for s, e in taken):
                    raise RuleError(f"group_overlaps:{group}")
                taken.append((a, b))
                out.append((a, b, f"[CUSTOM_{name}_", 2))
    return out


def select_spans(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """By start, higher priority, greater length; kept greedily where they don't overlap."""
    kept, end = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[3], -(s[1] - s[0]))):
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


def all_spans(text: str, custom: list[tuple[str, str]] = (), paired: list[tuple[str, str]] = ()) -> list[tuple[int, int, str, int]]:
    return select_spans(standard_spans(text) + custom_spans(text, list(custom)) + paired_spans(text, list(paired)))


def mask(text: str, custom: list[tuple[str, str]] = (), paired: list[tuple[str, str]] = (), known: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """The text with placeholders, and what each stands for; custom ones count by first occurrence."""
    known = {} if known is None else known
    by_text = {v: k for k, v in known.items() if k.startswith("[CUSTOM_")}
    out, at = [], 0
    for start, end, name, _ in all_spans(text, custom, paired):
        original = text[start:end]
        if not name.endswith("]"):
            if original not in by_text:
                by_text[original] = f"{name}{sum(k.startswith(name) for k in known) + 1}]"
            name = by_text[original]
        known.setdefault(name, original)
        out += [text[at:start], name]
        at = end
    return "".join([*out, text[at:]]), known


def unprotected(text: str, custom: list[tuple[str, str]] = (), paired: list[tuple[str, str]] = ()) -> list[str]:
    """Possible control sequences of a text that no span protects."""
    spans = all_spans(text, custom, paired)
    free = [(a, b) for a, b in raw_candidates(text) if not any((s <= a and b <= e) if p == 0 else (a < e and s < b) for s, e, _, p in spans)]
    return [text[a:b] for a, b in free]


def verify(original: str, answer: str, custom: list[tuple[str, str]] = (), paired: list[tuple[str, str]] = ()) -> list[str]:
    """What is wrong with the placeholders of a masked answer to a masked original: unknown ones, a wrong number (of
    spelled-out line breaks only too few is wrong), and other controls than the original's."""
    want, have = (Counter(x.upper() for x in PLACEHOLDER.findall(t)) for t in (original, answer))
    out = [f"unknown:{k}" for k in sorted(have) if k not in want]
    out += [f"number:{k}" for k, n in sorted(want.items()) if (have[k] < n if k == LINE_BREAK else have[k] != n)]
    if Counter(unprotected(original, custom, paired)) != Counter(unprotected(answer, custom, paired)):
        out.append("other_controls")
    return out


def restore(text: str, known: dict[str, str]) -> str:
    """Originals back in place of placeholders, longest first, whatever their case."""
    for name in sorted(known, key=len, reverse=True):
        text = re.sub(re.escape(name), lambda _, o=known[name]: o, text, flags=re.I)
    return text


def masked_rows(rows: DataFrame, key: str = "fact_id", text: str = "raw_text", answer: str = "answer", custom: list[tuple[str, str]] = (), paired: list[tuple[str, str]] = ()) -> DataFrame:
    """``key, masked, placeholders (JSON), restored, problems`` of each row; ``restored`` must equal the text."""
    rules = (list(custom), list(paired))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, a in zip(b[key], b[text], b[answer], strict=True):
                m, known = mask(t or "", *rules)
                am, _ = mask(a or "", *rules, known=dict(known))
                out.append((k, m, json.dumps(known, ensure_ascii=False, sort_keys=True), restore(m, known), verify(m, am, *rules)))
            yield pd.DataFrame(out, columns=["key", "masked", "placeholders", "restored", "problems"])

    return rows.select(key, text, answer).mapInPandas(step, "key string, masked string, placeholders string, restored string, problems array<string>")


def spans_of(rows: DataFrame, key: str = "fact_id", text: str = "raw_text") -> DataFrame:
    """One row per control sequence: key, start, stop, original, placeholder."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, s, e, t[s:e], n) for k, t in zip(b[key], b[text], strict=True) if t for s, e, n, _ in all_spans(t)]
            yield pd.DataFrame(out, columns=["key", "start", "stop", "original", "placeholder"])

    return rows.select(key, text).where(F.col(text).rlike(r"[\\%]")).mapInPandas(step, "key string, start int, stop int, original string, placeholder string")


def candidates_of(rows: DataFrame, key: str = "fact_id", text: str = "raw_text") -> DataFrame:
    """X11: one row per possible control sequence: key, start, stop, candidate."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, s, e, t[s:e]) for k, t in zip(b[key], b[text], strict=True) if t for s, e in raw_candidates(t)]
            yield pd.DataFrame(out, columns=["key", "start", "stop", "candidate"])

    return rows.select(key, text).where(F.contains(F.col(text), F.lit("\\"))).mapInPandas(step, "key string, start int, stop int, candidate string")
