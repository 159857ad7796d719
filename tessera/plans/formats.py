"""Sources, sinks, rule validation, shells, spans and run control as queries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import controls, javascript, layout
from tessera.functions import json as J
from tessera.functions import text as X
from tessera.plans import relations as R
from tessera.plans.relations import sql
from tessera.plans.textual import BOXED, FILES, _boxes, _cands, _files, _masked, _q, x20_nested_leaves
from tessera.rules import validate
from tessera.session import scratch
from tessera.sources import files
from tessera.streaming import runs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add




@query("select fact_id,raw_hash from facts")
def k01_versioned_tables(spark, sf):
    root = scratch(spark, "scope")
    facts = R.facts(spark, sf).select("fact_id", "raw_hash")
    files.replace_tables(spark, root, "old", {"facts": facts.limit(0), "index": R.index(spark, sf).limit(0)})
    files.replace_tables(spark, root, "new", {"facts": facts, "index": R.index(spark, sf)})
    return files.current_table(spark, root, "facts")


@query("select game_id,location_path,writable from idx")
def s08_read_only_snapshot(spark, sf):
    root = scratch(spark, "scope")
    files.replace_tables(spark, root, "v1", {"index": R.index(spark, sf)})
    return files.current_table(spark, root, "index")


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    c = _cands(spark, sf).select("file_id", "selector", "start_index", "active", "text").distinct()
    return c.select(F.concat_ws("|", F.col("file_id").cast("string"), "selector").alias("rule_id"), F.lit("plugin_source").alias("domain"), F.col("start_index").alias("rule_order"), F.col("active").alias("enabled"), "text")


@query("select distinct concat_ws('|',file_id::varchar,selector) as rule_id,start_index as rule_order,text from plugin_source_candidates where active order by 2,1")
def s09_rules_of_a_domain(spark, sf):
    return files.rules_of(_rules(spark, sf), "plugin_source").select("rule_id", "rule_order", "text")


@query("select concat_ws('|',file_id::varchar,selector) as rule_id,to_json({'text':text,'start_index':start_index})::varchar as payload from (select distinct file_id,selector,start_index,text from plugin_source_candidates where active and text is not null)")
def s10_rule_payloads(spark, sf):
    r = _rules(spark, sf).where("enabled and text is not null")
    return r.select("rule_id", F.to_json(F.struct("text", F.col("rule_order").alias("start_index"))).alias("payload"))


@query("select fact_id,raw_text,speaker from items where item_type='short_text'")
def s11_strict_json_inputs(spark, sf):
    path = scratch(spark, "inputs")
    files.report(R.items(spark, sf).where("item_type = 'short_text'").select("fact_id", "raw_text", "speaker"), path)
    return spark.read.schema("fact_id string, raw_text string, speaker string").option("mode", "FAILFAST").json(path)


@query("select run_id,fact_id,error_type from errors union all select run_id,fact_id,'later' from errors where run_id<3")
def k03_appended_runs(spark, sf):
    path = scratch(spark, "runs")
    e = R.errors(spark, sf).select("run_id", "fact_id", "error_type")
    files.append_run(e, path)
    files.append_run(e.where("run_id < 3").withColumn("error_type", F.lit("later")), path)
    return spark.read.parquet(path).select(F.col("run_id").cast("long").alias("run_id"), "fact_id", "error_type")


@query("select run_id,fact_id,case when run_id<3 then 'later' else error_type end as error_type from errors")
def k04_replaced_runs(spark, sf):
    path = scratch(spark, "runs")
    e = R.errors(spark, sf).select("run_id", "fact_id", "error_type")
    files.append_run(e, path)
    files.replace_runs(spark, e.where("run_id < 3").withColumn("error_type", F.lit("later")), path)
    return spark.read.parquet(path).select(F.col("run_id").cast("long").alias("run_id"), "fact_id", "error_type")


@query("select fact_id,strpos(raw_text,'\\C[')-1 as start,strpos(raw_text,'\\C[')-1<=length(raw_text)//2 and strpos(raw_text,'\\C[')+2<=length(raw_text)//2 as covered from items where contains(raw_text,'\\C[')")
def j23_covered_candidates(spark, sf):
    i = R.items(spark, sf).where(F.contains(F.col("raw_text"), F.lit("\\C["))).select("fact_id", "raw_text", (F.instr("raw_text", "\\C[") - 1).cast("long").alias("start"))
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.floor(F.length("raw_text") / 2).alias("stop")))
    one = F.struct(F.col("start"), (F.col("start") + 3).alias("stop"))
    return i.select("fact_id", "start", layout.covered(one, span).alias("covered"))


@query("select fact_id,(length(fact_id)%5)::int as depth,trim(raw_text,' ') as text,to_json(raw_text)::varchar as shell from items")
def x07_encoded_shells(spark, sf):
    depth = F.length("fact_id") % 5
    wrapped = F.aggregate(F.sequence(F.lit(0), depth), F.trim("raw_text"), lambda t, i: F.when(i == 0, t).otherwise(X.encode_shell(t)))
    i = R.items(spark, sf).withColumn("like", X.encode_like(F.trim("raw_text"), wrapped))
    return i.select("fact_id", X.shell_depth(F.col("like")).alias("depth"), X.decode_shells(F.col("like")).alias("text"), X.encode_shell(F.col("raw_text")).alias("shell"))


@query("select fact_id,case when length(fact_id)%3=0 then 'shell_depth' when len(regexp_extract_all(answer,'\\\\\\\\[A-Za-z]+\\['))>len(regexp_extract_all(raw_text,'\\\\\\\\[A-Za-z]+\\[')) then 'doubled_controls' end as problem from items where not starts_with(trim(raw_text,' '),'\"') and not starts_with(trim(answer,' '),'\"')")
def x08_encoding_problems(spark, sf):
    i = R.items(spark, sf).where("not startswith(trim(raw_text), '\"') and not startswith(trim(answer), '\"')")
    written = F.when(F.length("fact_id") % 3 == 0, X.encode_shell(F.col("answer"))).otherwise(F.col("answer"))
    return i.select("fact_id", X.encoding_problem(F.col("raw_text"), written).alias("problem"))


def _spans_udf(rows: DataFrame, custom=(), paired=()) -> DataFrame:
    def step(batches):
        for b in batches:
            out = [(k, t[s:e]) for k, t in zip(b["fact_id"], b["raw_text"], strict=True) for s, e, n, p in controls.all_spans(t or "", custom, paired) if p > 0]
            yield pd.DataFrame(out, columns=["fact_id", "original"])

    return rows.select("fact_id", "raw_text").mapInPandas(step, "fact_id string, original string")


@query("select fact_id,unnest(regexp_extract_all(raw_text,'【[^】]*】')) as original from items")
def x12_custom_spans(spark, sf):
    return _spans_udf(R.items(spark, sf), custom=[("【[^】]*】", "NAME")])


@query("select fact_id,m as original from (select fact_id,unnest(regexp_extract_all(raw_text,'「[^」]*」')) as x from items),(select unnest(['「','」']) as m)")
def x13_paired_spans(spark, sf):
    return _spans_udf(R.items(spark, sf), paired=[("(?P<a>「)(?P<text>[^」]*)(?P<z>」)", "text", {"a": "QUOTE_OPEN", "z": "QUOTE_CLOSE"})])


@query(f"select fact_id,{_masked('answer')} as masked,answer as restored from items where contains(answer,'\\')")
def x17_masked_answers(spark, sf):
    def step(batches):
        for b in batches:
            out = []
            for k, o, a in zip(b["fact_id"], b["raw_text"], b["answer"], strict=True):
                _, known = controls.mask(o)
                masked, known = controls.mask(a, known=known)
                out.append((k, masked, controls.restore(masked, known)))
            yield pd.DataFrame(out, columns=["fact_id", "masked", "restored"])

    rows = R.items(spark, sf).where(F.contains(F.col("answer"), F.lit("\\")))
    return rows.select("fact_id", "raw_text", "answer").mapInPandas(step, "fact_id string, masked string, restored string")


@query("select file_id||':'||start_index as id from (select distinct file_id,start_index,ast_context from plugin_source_candidates)")
def x22_template_matches(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context").distinct().withColumn("id", F.concat_ws(":", "file_id", "start_index"))
    return J.leaves(c, "id", "ast_context").where(F.col("path").rlike(J.template_regex("$['call_name']"))).select(F.col("key").alias("id"))


@query("select o_orderkey,count(*) as leaves from orders join lineitem on l_orderkey=o_orderkey group by 1")
def x25_descendants(spark, sf):
    leaves = x20_nested_leaves(spark, sf)
    return leaves.where(X.is_ancestor(F.lit("$['lines']"), F.col("path"))).groupBy("o_orderkey").agg(F.count("*").alias("leaves"))


@query(None)
def x32_repaired_wraps(spark, sf):
    @F.pandas_udf("string")
    def repair(o: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([layout.repair_wraps(x, y) for x, y in zip(o, a, strict=True)], dtype=object)

    return R.items(spark, sf).select("fact_id", repair("raw_text", "answer").alias("answer"))


@query("select fact_id,replace(replace(answer,'OLD MAP',' '),'HP',' ') as masked from items")
def x37_masked_terms(spark, sf):
    return R.items(spark, sf).select("fact_id", layout.masked_terms(F.col("answer"), ["HP", "OLD MAP"]).alias("masked"))


@query(f"select fact_id,who as speaker,said as body,true as whole from {BOXED} where not conflict and not actor")
def x41_render_parts(spark, sf):
    line = R.items(spark, sf).select("fact_id", X.strip(F.substring_index("raw_text", "\n", 1)).alias("line"))
    b = _boxes(spark, sf).where("error is null and rule <> 'actor'").join(line, F.col("key") == F.col("fact_id"))
    part = lambda kind: F.coalesce(F.try_element_at(F.transform(F.filter("parts", lambda x: x["kind"] == kind), lambda x: x["text"]), F.lit(1)), F.lit(""))
    return b.select("fact_id", part("speaker").alias("speaker"), part("body").alias("body"), (F.array_join(F.transform("parts", lambda x: x["text"]), "") == F.col("line")).alias("whole"))


@query("select file_id,start_index,text from (select distinct file_id,start_index,text from plugin_source_candidates where raw_text is not null)")
def x47_unescaped_literals(spark, sf):
    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(javascript.unescape).astype(object)

    return _cands(spark, sf).where("raw_text is not null").select("file_id", "start_index", "raw_text").distinct().select("file_id", "start_index", plain("raw_text").alias("text"))


@query(f"select distinct c.file_id,c.start_index,strlen(substr(f.source_text,1,c.start_index))::bigint as byte_offset from plugin_source_candidates c join {FILES} f on f.file_id=c.file_id")
def x48_byte_offsets(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index").distinct()
    return c.join(_files(spark, sf), "file_id").select("file_id", "start_index", F.octet_length(F.substr("source_text", F.lit(1), "start_index")).cast("long").alias("byte_offset"))


@query("select fact_id,concat(speaker,'「',raw_text,'」') as line from items where speaker<>''")
def x52_rendered_lines(spark, sf):
    return R.items(spark, sf).where("speaker <> ''").select("fact_id", layout.rendered("{speaker}「{body}」", speaker=F.col("speaker"), body=F.col("raw_text")).alias("line"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    f = R.facts(spark, sf).where("item_type = 'short_text'").select((F.col("game_id") % 40).alias("batch_id"), "fact_id", F.array("raw_text").alias("lines"))
    return f.repartition("batch_id")


def _half(rows: list[dict]) -> list[dict]:
    return [{"id": r["id"], "translation_lines": r["lines"]} for r in rows if r["id"][3] in "01234567"]


@query("select count(*) as sent,count_if(substr(fact_id,4,1)<'8')::bigint as succeeded,count_if(not substr(fact_id,4,1)<'8')::bigint as failed,'finished' as stop_reason from facts where item_type='short_text'")
def t04_run_counters(spark, sf):
    state = runs.run(spark, _batches(spark, sf), _half, lambda df: None, slices=3, stop_rate=0.999)
    return spark.createDataFrame([(state["sent"], state["succeeded"], state["failed"], state["stop_reason"])], "sent long, succeeded long, failed long, stop_reason string")


@query("select fact_id from facts where item_type='short_text' and not substr(fact_id,4,1)<'8'")
def t06_still_pending_after_a_run(spark, sf):
    path = scratch(spark, "saved")
    pending = _batches(spark, sf)
    runs.run(spark, pending, _half, lambda df: df.where("error is null").write.mode("append").parquet(path), slices=2, stop_rate=0.999)
    return pending.join(spark.read.parquet(path), "fact_id", "left_anti").select("fact_id")


def _checked(df: DataFrame, domain: str, payload) -> DataFrame:
    rules = df.select("rule_index", F.lit(domain).alias("domain"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
    return validate.violations(rules).select("rule_index", "code", "field")


NUMBERED = "(select distinct file_id*1000000+start_index as rule_index,context,text,selector,file_name from plugin_source_candidates)"


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select((F.col("file_id") * 1000000 + F.col("start_index")).alias("rule_index"), "context", "text", "selector", "file_name").distinct()


BLANK = r"regexp_full_match({0},'\s*')"


@query(f"select rule_index,'plugin_config_plugin_name_empty' as code,'plugin_name' as field from {NUMBERED} where context is null or {BLANK.format('context')} union all select rule_index,'plugin_config_path_empty','paths[0]' from {NUMBERED} where text is null or {BLANK.format('text')}")
def r01_plugin_config_rules(spark, sf):
    return _checked(_numbered(spark, sf), "plugin_config", F.struct(F.col("context").alias("plugin_name"), F.array("text").alias("paths")))


@query(f"select rule_index,'event_command_paths_invalid' as code,'paths' as field from {NUMBERED} where rule_index%2=0 union all select rule_index,'event_command_path_empty','paths[0]' from {NUMBERED} where rule_index%2=1 and (text is null or {BLANK.format('text')})")
def r02_event_command_rules(spark, sf):
    paths = F.when(F.col("rule_index") % 2 == 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    return _checked(_numbered(spark, sf), "event_commands", F.struct(F.lit(101).alias("code"), paths.alias("paths")))


@query(f"select rule_index,'note_tag_file_name_empty' as code,'file_name' as field from {NUMBERED} where context is null or {BLANK.format('context')}")
def r03_note_tag_rules(spark, sf):
    return _checked(_numbered(spark, sf), "note_tags", F.struct(F.col("context").alias("file_name"), F.array("selector").alias("tags")))


@query(f"select rule_index,'nonstandard_data_path_empty' as code,'paths[1]' as field from {NUMBERED} where text is null or {BLANK.format('text')}")
def r04_nonstandard_data_rules(spark, sf):
    return _checked(_numbered(spark, sf), "nonstandard_data", F.struct("file_name", F.array("selector", "text").alias("paths")))


@query(f"select rule_index,'plugin_source_selectors_invalid' as code,'selectors' as field from {NUMBERED} where rule_index%3=0")
def r05_plugin_source_rules(spark, sf):
    selectors = F.when(F.col("rule_index") % 3 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("selector"))
    return _checked(_numbered(spark, sf), "plugin_source", F.struct(F.col("file_name").alias("file"), selectors.alias("selectors")))


def _fixed(spark: SparkSession, domain: str, payloads: list[dict]) -> DataFrame:
    rows = [(i, domain, json.dumps(p)) for i, p in enumerate(payloads)]
    return validate.violations(spark.createDataFrame(rows, "rule_index long, domain string, payload string")).select("rule_index", "code", "field")


@query("select * from (values (1::bigint,'structured_placeholder_translatable_capture_missing','translatable_group'),(2,'structured_placeholder_protected_capture_missing','protected_groups[1]')) t(rule_index,code,field)")
def r07_structured_placeholder_rules(spark, sf):
    p = r"(?P<a><b>)(?P<t>.+?)(?P<z></b>)"
    return _fixed(spark, "structured_placeholders", [{"pattern": p, "translatable_group": "t", "protected_groups": ["a", "z"]}, {"pattern": p, "translatable_group": "x"}, {"pattern": p, "translatable_group": "t", "protected_groups": ["a", "q"]}])


@query("select * from (values (1::bigint,'source_residual_check_group_missing','check_group'),(2,'source_residual_path_empty','location_path'),(2,'source_residual_reason_empty','reason')) t(rule_index,code,field)")
def r08_source_residual_rules(spark, sf):
    return _fixed(spark, "source_residual", [{"pattern": "(?P<n>a+)", "check_group": "n", "reason": "r"}, {"pattern": "a+", "check_group": "n", "reason": "r"}, {"location_path": "", "terms": ["a"], "reason": " "}])


@query("select * from (values (1::bigint,'mv_virtual_namebox_body_capture_missing','body_group'),(1,'mv_virtual_namebox_render_template_invalid','template')) t(rule_index,code,field)")
def r09_name_box_rules(spark, sf):
    p = "(?P<s>.+?)「(?P<b>.+)」"
    return _fixed(spark, "mv_virtual_namebox", [{"pattern": p, "speaker_group": "s", "body_group": "b", "template": "{speaker}「{body}」"}, {"pattern": p, "speaker_group": "s", "body_group": "q", "template": "{speaker}"}])


@query("select * from (values (1::bigint,'config_width_pattern_invalid','width'),(2,'config_required_pattern_matches_empty','required')) t(rule_index,code,field)")
def r10_config_patterns(spark, sf):
    return _fixed(spark, "config_patterns", [{"required": "[ぁ-ん]+", "width": r"\S"}, {"width": "("}, {"required": "a*"}])


CODE = "'" + r"\\[A-Za-z]+\[[0-9]+\]" + "'"


@query(f"select fact_id,list_sort(regexp_extract_all(answer,{CODE}))=list_sort(regexp_extract_all(raw_text,{CODE})) as equal from items")
def u08_equal_control_multisets(spark, sf):
    p = F.lit(r"\\[A-Za-z]+\[[0-9]+\]")
    counts = lambda c: F.array_sort(F.regexp_extract_all(c, p, F.lit(0)))
    return R.items(spark, sf).select("fact_id", (counts("answer") == counts("raw_text")).alias("equal"))


@query(r"select fact_id,(len(regexp_extract_all(raw_text,'\\n'))-len(regexp_extract_all(raw_text,'\\n[A-Za-z<\[]')))::bigint as marks from items")
def x14_line_break_marks(spark, sf):
    return R.items(spark, sf).select("fact_id", X.line_break_marks(F.col("raw_text")).alias("marks"))


@query("select fact_id,regexp_replace(raw_text,'【([^】]*[^】\\s\\p{Z}][^】]*)】',' \\1 ','g') as masked from items")
def x38_masked_structures(spark, sf):
    masked = X.mask_structures(F.col("raw_text"), "【(?P<name>[^】]*)】", "name", ["【", "】"])
    return R.items(spark, sf).select("fact_id", masked.alias("masked"))


@query("""select doc_id,case when answer is null then 'no_answer' when trim(answer)='' then 'empty_answer' when n=0 then 'no_tag' when n>1 then 'tag_repeated' end as problem from (select doc_id,case when doc_id%7=0 then null when doc_id%7=1 then ' ' else '译' end as answer,len(list_filter(regexp_extract_all(text,'<([^<>:\r\n]+):[^<>]*>',1),lambda x: trim(x)='desc')) as n from documents where text is not null)""")
def x44_note_write_protocol(spark, sf):
    d = R.table(spark, sf, "documents").where("text is not null")
    answer = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 7 == 1, " ").otherwise("译")
    return d.select("doc_id", X.note_problem(F.col("text"), F.lit("desc"), answer).alias("problem"))


@query("""select file_id,start_index,case when json_extract_string(ast_context,'$.call_name') is null then 'no_key' when text is null or trim(text,' ')='' then 'empty_answer' end as problem from (select distinct file_id,start_index,ast_context,text from plugin_source_candidates)""")
def x44_nested_write_protocol(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context", "text").distinct()
    return c.select("file_id", "start_index", F.when(F.get_json_object("ast_context", "$.call_name").isNull(), "no_key").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_answer").alias("problem"))


@query("select o_orderkey,count(*) as valid from orders join lineitem on l_orderkey=o_orderkey group by 1")
def x21_valid_paths(spark, sf):
    return x20_nested_leaves(spark, sf).where(X.valid_path(F.col("path"))).groupBy("o_orderkey").agg(F.count("*").alias("valid"))


@query("""select file_id||':'||start_index as key,replace(ast_context,'"call_name": "Error"','"call_name": "Warning"') as content from (select distinct file_id,start_index,ast_context from plugin_source_candidates) where contains(ast_context,'"call_name": "Error"')""")
def x50_nested_set(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context").distinct().withColumn("id", F.concat_ws(":", "file_id", "start_index"))
    hit = F.contains(F.col("ast_context"), F.lit('"call_name": "Error"'))
    edits = c.where(hit).select(F.col("id").alias("key"), F.lit("$['call_name']").alias("path"), F.lit("Warning").alias("new"))
    return J.apply_edits(c, edits, "id", "ast_context")


@query("select fact_id,array_to_string(list_filter(translation_lines,lambda x: x is not null),chr(10)) as lines from items where item_type='long_text' and len(original_lines)>0 and len(list_filter(translation_lines,lambda x: x is not null))>0")
def x51_edited_commands(spark, sf):
    def step(batches):
        for b in batches:
            out = []
            for k, o, t in zip(b["fact_id"], b["original_lines"], b["translation_lines"], strict=True):
                rows = [{"code": 101}, *({"code": 401, "parameters": [x]} for x in o)]
                done = layout.edit_commands(rows, [x for x in t if x is not None], list(range(1, len(o) + 1)), 401)
                out.append((k, "\n".join(r["parameters"][0] for r in done[1:])))
            yield pd.DataFrame(out, columns=["fact_id", "lines"])

    lines = F.filter("translation_lines", lambda x: x.isNotNull())
    i = R.items(spark, sf).where((F.col("item_type") == "long_text") & (F.size("original_lines") > 0) & (F.size(lines) > 0))
    return i.select("fact_id", "original_lines", "translation_lines").mapInPandas(step, "fact_id string, lines string")


@query(None)
def w13_word_runs(spark, sf):
    from tessera.operators.sequence import token_runs

    @F.pandas_udf("array<string>")
    def soft(s: pd.Series) -> pd.Series:
        return s.map(token_runs)

    return R.items(spark, sf).where(F.col("answer").rlike("[A-Za-z]")).select("fact_id", F.array_join(soft("answer"), "|").alias("runs"))


@query("select fact_id,answer as restored from items")
def x19_restored_answers(spark, sf):
    i = R.items(spark, sf)
    masked = controls.masked_rows(i, text="answer", answer="raw_text")
    return masked.select(F.col("key").alias("fact_id"), "restored")


@query("select fact_id,raw_text,speaker from items where item_type='short_text'")
def k10_pretty_json(spark, sf):
    i = R.items(spark, sf).where("item_type = 'short_text'")
    pretty = i.select(F.to_json(F.struct("fact_id", "raw_text", "speaker"), {"pretty": "true"}).alias("doc"))
    return pretty.select(F.from_json("doc", "fact_id string, raw_text string, speaker string").alias("x")).select("x.*")


@query("select run_id,fact_id from errors where run_id=1")
def t08_cleared_errors(spark, sf):
    path = scratch(spark, "errors")
    e = R.errors(spark, sf).select("run_id", "fact_id")
    e.write.parquet(path)
    files.clear_runs(spark, e.schema, path)
    e.where("run_id = 1").write.mode("append").parquet(path)
    return spark.read.schema(e.schema).parquet(path)
