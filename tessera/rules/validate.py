"""A rules DataFrame -> violations ``(rule_index, code, field)``; all issues of an import are reported, and
an import with any is taken as a whole or not at all.

A rule is ``(rule_index int, domain string, payload string)`` with the domain's JSON object as payload.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$")


def _text(p: dict, k: str) -> bool:
    return isinstance(p.get(k), str) and bool(p[k].strip())


def _list(p: dict, k: str, prefix: str, empty: str) -> Iterator[tuple[str, str]]:
    v = p.get(k)
    if not isinstance(v, list) or not v:
        yield f"{prefix}_invalid", k
    else:
        yield from ((empty, f"{k}[{i}]") for i, x in enumerate(v) if not isinstance(x, str) or not x.strip())


def _pattern(p: dict, k: str, domain: str) -> Iterator[tuple[str, str]]:
    if not _text(p, k):
        yield f"{domain}_pattern_empty", k
        return
    try:
        if re.compile(p[k]).match(""):
            yield f"{domain}_pattern_matches_empty", k
    except re.error:
        yield f"{domain}_pattern_invalid", k


def _groups(pattern: str | None) -> set[str]:
    try:
        return set(re.compile(pattern or "").groupindex)
    except re.error:
        return set()


def plugin_config(p: dict) -> Iterator[tuple[str, str]]:
    if not _text(p, "plugin_name"):
        yield "plugin_config_plugin_name_empty", "plugin_name"
    yield from _list(p, "paths", "plugin_config_paths", "plugin_config_path_empty")


def event_commands(p: dict) -> Iterator[tuple[str, str]]:
    if not isinstance(p.get("code"), int) or isinstance(p.get("code"), bool):
        yield "event_command_code_invalid", "code"
    yield from _list(p, "paths", "event_command_paths", "event_command_path_empty")


def note_tags(p: dict) -> Iterator[tuple[str, str]]:
    if not _text(p, "file_name"):
        yield "note_tag_file_name_empty", "file_name"
    yield from _list(p, "tags", "note_tag_names", "note_tag_name_empty")


def nonstandard_data(p: dict) -> Iterator[tuple[str, str]]:
    if not _text(p, "file_name"):
        yield "nonstandard_data_file_name_empty", "file_name"
    yield from _list(p, "paths", "nonstandard_data_paths", "nonstandard_data_path_empty")


def plugin_source(p: dict) -> Iterator[tuple[str, str]]:
    if not _text(p, "file"):
        yield "plugin_source_file_empty", "file"
    yield from _list(p, "selectors", "plugin_source_selectors", "plugin_source_selector_empty")


def placeholders(p: dict) -> Iterator[tuple[str, str]]:
    yield from _pattern(p, "pattern", "placeholder")
    if not _text(p, "name") or not _NAME.match(p["name"]):
        yield "placeholder_template_invalid", "name"


def structured_placeholders(p: dict) -> Iterator[tuple[str, str]]:
    yield from _pattern(p, "pattern", "structured_placeholder")
    have = _groups(p.get("pattern"))
    if p.get("translatable_group") not in have:
        yield "structured_placeholder_translatable_capture_missing", "translatable_group"
    yield from (("structured_placeholder_protected_capture_missing", f"protected_groups[{i}]") for i, g in enumerate(p.get("protected_groups") or []) if g not in have)


def source_residual(p: dict) -> Iterator[tuple[str, str]]:
    if "pattern" in p:
        yield from _pattern(p, "pattern", "source_residual")
        if p.get("check_group") not in _groups(p.get("pattern")):
            yield "source_residual_check_group_missing", "check_group"
    else:
        if not _text(p, "location_path"):
            yield "source_residual_path_empty", "location_path"
        yield from _list(p, "terms", "source_residual_terms", "source_residual_term_empty")
    if not _text(p, "reason"):
        yield "source_residual_reason_empty", "reason"


def mv_virtual_namebox(p: dict) -> Iterator[tuple[str, str]]:
    yield from _pattern(p, "pattern", "mv_virtual_namebox")
    have = _groups(p.get("pattern"))
    for k in ("speaker", "body"):
        if p.get(f"{k}_group") not in have:
            yield f"mv_virtual_namebox_{k}_capture_missing", f"{k}_group"
    if not all(f"{{{k}}}" in (p.get("template") or "") for k in ("speaker", "body")):
        yield "mv_virtual_namebox_render_template_invalid", "template"


def config_patterns(p: dict) -> Iterator[tuple[str, str]]:
    for k in ("required", "residual", "width", "wrapping"):
        if k in p:
            yield from _pattern(p, k, f"config_{k}")


DOMAINS: dict[str, Callable[[dict], Iterator[tuple[str, str]]]] = {
    f.__name__: f for f in (plugin_config, event_commands, note_tags, nonstandard_data, plugin_source, placeholders, structured_placeholders, source_residual, mv_virtual_namebox, config_patterns)
}


def check(domain: str, payload: str) -> list[tuple[str, str]]:
    """The issues of one rule."""
    if domain not in DOMAINS:
        return [("rule_domain_unknown", "domain")]
    try:
        p = json.loads(payload or "")
    except ValueError:
        p = None
    if not isinstance(p, dict):
        return [(f"{domain}_rule_invalid", "payload")]
    return list(DOMAINS[domain](p))


def violations(rules: DataFrame) -> DataFrame:
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, d, c, f) for i, d, p in zip(b["rule_index"], b["domain"], b["payload"], strict=True) for c, f in check(d, p)]
            yield pd.DataFrame(rows, columns=["rule_index", "domain", "code", "field"])

    return rules.select("rule_index", "domain", "payload").mapInPandas(step, "rule_index long, domain string, code string, field string")


def accepted(rules: DataFrame) -> DataFrame:
    """The rules of the domains without any violation; a domain with one is refused as a whole."""
    return rules.join(violations(rules).select("domain").distinct(), "domain", "left_anti")


def plan_token(rules: DataFrame) -> DataFrame:
    """A fingerprint per domain, whatever the order of its rules; a commit whose token differs from the stored
    rules' is refused as stale."""
    part = F.conv(F.substring(F.sha2("payload", 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rules.groupBy("domain").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(part).cast("string")), 256).alias("token"))


def prepare(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K06, first phase: for every domain of ``new`` the token of what is stored of it now (null for none), and the number
    of violations."""
    domains = new.select("domain").distinct()
    bad = violations(new).groupBy("domain").agg(F.count("*").alias("violations"))
    return domains.join(plan_token(stored), "domain", "left").join(bad, "domain", "left").na.fill(0, ["violations"])


def commit(stored: DataFrame, new: DataFrame, plan: DataFrame) -> DataFrame:
    """K06, second phase: the stored rules with each domain of the plan replaced as a whole by its new rules, where the
    plan has no violation and its token is still that of the stored rules; all other domains stay as they are."""
    now = plan_token(stored).withColumnRenamed("token", "now")
    taken = plan.where("violations = 0").join(now, "domain", "left").where(F.col("token").eqNullSafe(F.col("now"))).select("domain")
    return stored.join(taken, "domain", "left_anti").unionByName(new.join(taken, "domain", "left_semi"))
