"""Rules, terms, shells, layout, runs and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import controls, layout
from tessera.functions import text as X
from tessera.operators import terms
from tessera.plans import relations as R
from tessera.plans.relations import sql
from tessera.plans.textual import _cands, _q
from tessera.rules import validate
from tessera.streaming import events, runs

RAW_SIGN = r"\\[{}\\$.|!><^]"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


@query("select d.doc_id,t.term from documents d join (select distinct raw_text as term from items where path like '%/name' and raw_text<>'') t on contains(d.text,t.term)")
def j20_names_in_documents(spark, sf):
    names = R.items(spark, sf).where("path like '%/name'")
    return terms.contained(R.table(spark, sf, "documents"), "doc_id", "text", names, "raw_text")


@query("select i.fact_id,t.term from items i join (select distinct speaker as term from items where trim(speaker,' ')<>'') t on contains(i.raw_text,t.term)")
def j15_speakers_in_texts(spark, sf):
    i = R.items(spark, sf)
    who = i.where("trim(speaker) <> ''")
    return terms.contained(i, "fact_id", "raw_text", who, "speaker")


RULES = [("r1", "pad", "map_*"), ("r2", "pad", "*-0*"), ("r3", "/s", "*"), ("r4", "none", "*")]


@query("select distinct doc_id,rule_id from (select doc_id,coalesce(source,'') as source,unnest(regexp_extract_all(text," + _q(X.NOTE_TAG) + ",1)) as tag from documents) join (values " + ",".join(f"('{a}','{b}','{c}')" for a, b, c in RULES) + ") r(rule_id,rtag,pat) on rtag=tag and source like replace(pat,'*','%')")
def j12_tags_by_rules(spark, sf):
    hits = R.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("file_name"), F.explode(F.regexp_extract_all("text", F.lit(X.NOTE_TAG), F.lit(1))).alias("tag"))
    return terms.tagged_by_rules(hits, spark.createDataFrame(RULES, "rule_id string, tag string, file_pattern string")).select("doc_id", "rule_id").distinct()


CODES = [("c1", "array", "話を聞く"), ("c2", "array", "Stay here"), ("c3", "short_text", "HP")]


COMMAND_RULES = [("long", "long_text", {}), ("asked", "array", {0: "話を聞く"}), ("two", "array", {0: "はい", 1: "いいえ"}), ("far", "array", {9: "x"})]


@query("""select fact_id,rule_id from items,(values ('long','long_text',null,null),('asked','array','話を聞く',null),('two','array','はい','いいえ')) r(rule_id,code,p0,p1) where item_type=code and (p0 is null or original_lines[1]=p0) and (p1 is null or original_lines[2]=p1)""")
def j14_commands_by_rules(spark, sf):
    rules = spark.createDataFrame(COMMAND_RULES, "rule_id string, code string, filters map<int,string>")
    return terms.commands_by_rules(R.items(spark, sf).select("fact_id", F.col("item_type").alias("code"), F.col("original_lines").alias("parameters")), rules).select("fact_id", "rule_id")


@query(r"select fact_id,code,id,n_name as name,case when n_name is null then 'name_unknown' end as error from (select fact_id,upper(regexp_extract(m,'^\\([A-Za-z])',1)) as code,regexp_extract(m,'([0-9]+)',1) as id from (select fact_id,unnest(regexp_extract_all(raw_text,'\\[NnCcVv]\[[0-9]+\]')) as m from items)) left join nation on n_nationkey=try_cast(id as integer)")
def j24_names_of_numbers(spark, sf):
    m = R.items(spark, sf).select("fact_id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"\\[NnCcVv]\[[0-9]+\]"), F.lit(0))).alias("m"))
    k = m.select("fact_id", F.upper(F.substring("m", 2, 1)).alias("code"), F.regexp_extract("m", "([0-9]+)", 1).alias("id"))
    names = R.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("key"), F.col("n_name").alias("name"))
    return k.join(names, F.col("id").try_cast("int") == F.col("key"), "left").select("fact_id", "code", "id", "name", F.when(F.col("name").isNull(), "name_unknown").alias("error"))


@query("""with r as (select distinct file_id,case when start_index%7=0 then selector||'x' else selector end as selector from plugin_source_candidates where confidence='high'), c as (select distinct file_id,selector from plugin_source_candidates), f as (select distinct file_id from plugin_source_files where coalesce(source_text,'')<>'')
select r.file_id,r.selector,case when f.file_id is null then 'file_missing' when c.selector is null then 'selector_missing' end as stale_reason from r left join f on f.file_id=r.file_id left join c on c.file_id=r.file_id and c.selector=r.selector""")
def j25_selector_facts(spark, sf):
    c = _cands(spark, sf)
    r = c.where("confidence = 'high'").select("file_id", F.when(F.col("start_index") % 7 == 0, F.concat("selector", F.lit("x"))).otherwise(F.col("selector")).alias("selector")).distinct()
    f = R.table(spark, sf, "plugin_source_files").where("coalesce(source_text, '') <> ''").select("file_id", F.lit(True).alias("f")).distinct()
    known = c.select("file_id", "selector", F.lit(True).alias("c")).distinct()
    j = r.join(f, "file_id", "left").join(known, ["file_id", "selector"], "left")
    return j.select("file_id", "selector", F.when(F.col("f").isNull(), "file_missing").when(F.col("c").isNull(), "selector_missing").alias("stale_reason"))


@query("select fact_id,trim(raw_text,' ') as text from items where raw_text<>''")
def x05_shells_off(spark, sf):
    i = R.items(spark, sf).where("raw_text <> ''")
    return i.select("fact_id", X.decode_shells(X.encode_shell(X.encode_shell(F.trim("raw_text")))).alias("text"))


@query(rf"select fact_id,candidate from (select fact_id,unnest(regexp_extract_all(raw_text,{_q(X.RAW_CONTROL + '|' + RAW_SIGN + '|' + X.RAW_BARE)})) as candidate from items) where not regexp_full_match(candidate,'\\[a-z]{{4,}}[0-9]*')")
def x11_control_candidates(spark, sf):
    return controls.candidates_of(R.items(spark, sf)).select(F.col("key").alias("fact_id"), "candidate")


@query(None)
def x31_wrapped_lines(spark, sf):
    return layout.wrapped_rows(R.items(spark, sf), "fact_id", "answer", 26).select(F.col("key").alias("fact_id"), F.array_join("lines", "\n").alias("text"))


@query(f"select fact_id,len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(answer,{_q(X.CONTROLS)},' ','g'),{_q(X.RAW_CONTROL)},' ','g'),{_q(X.RAW_BARE)},' ','g'),'(?s)\\\\.?'))::bigint as stray from items")
def x34_stray_escapes(spark, sf):
    return R.items(spark, sf).select("fact_id", F.size(X.stray_escapes(F.col("answer"))).cast("long").alias("stray"))


_SHOWN = " or ".join(f"ends_with(call,{_q(x)})" for x in X.STRONG_CALLS)
_REGEX = " or ".join(f"contains(raw,{_q(x)})" for x in X.REGEX_CLASSES + X.REGEX_GROUPS)


@query(f"""select file_id,start_index,class,case when class='user_visible_candidate' then 'blocking' else 'warning' end as severity from (select file_id,start_index,case when call='eval' or ends_with(call,'.eval') then 'eval_code'
 when contains(flat,'function(p,a,c,k,e') or contains(flat,'function(p,h,e') or (contains(flat,'eval(function(') and contains(flat,'.split(''|'')')) then 'packer_code'
 when {_REGEX} or (contains(raw,'[') and contains(raw,']') and regexp_matches(raw,'[*+?{{]')) then 'regex_pattern' when key in ({",".join(map(_q, X.STRONG_KEYS))}) or {_SHOWN} then 'user_visible_candidate' else 'unknown' end as class
 from (select distinct file_id,start_index,raw_text as raw,lower(regexp_replace(raw_text,'\\s','','g')) as flat,coalesce(json_extract_string(ast_context,'$.call_name'),'') as call,coalesce(json_extract_string(ast_context,'$.property_key'),'') as key from plugin_source_candidates where raw_text is not null))""")
def x45_literal_class(spark, sf):
    at = lambda k: F.coalesce(F.get_json_object("ast_context", f"$.{k}"), F.lit(""))
    c = _cands(spark, sf).where("raw_text is not null").select("file_id", "start_index", "raw_text", at("call_name").alias("call"), at("property_key").alias("key")).distinct()
    kind = c.select("file_id", "start_index", X.literal_class(F.col("raw_text"), F.col("call"), F.col("key")).alias("class"))
    return kind.withColumn("severity", F.when(F.col("class") == "user_visible_candidate", "blocking").otherwise("warning"))


@query(r"select distinct file_id,start_index,regexp_replace(text,'(^|[^A-Za-z0-9_.\-])fonts/main-15\.woff($|[^A-Za-z0-9_\-])','\1fonts/new.woff\2','g') as text from plugin_source_candidates where contains(text,'fonts/')")
def x49_font_references(spark, sf):
    return _cands(spark, sf).where(F.contains(F.col("text"), F.lit("fonts/"))).select("file_id", "start_index", X.replace_fonts(F.col("text"), "fonts/main-15.woff", "fonts/new.woff").alias("text")).distinct()


@query("select fact_id as id,unnest(original_lines) as line from items where item_type='array' and len(original_lines)>0")
def x53_parsed_answers(spark, sf):
    i = R.items(spark, sf).where("item_type = 'array' and size(original_lines) > 0")
    response = i.select(F.concat(F.lit("Answer: "), F.to_json(F.array(F.struct(F.col("fact_id").alias("id"), F.col("original_lines").alias("translation_lines"))))).alias("r"))
    return response.select(F.explode(X.parsed_answer(F.col("r"))).alias("x")).select("x.id", F.explode("x.translation_lines").alias("line"))


@query("select fact_id,'译:'||raw_text as answer from facts where item_type='short_text'")
def t01_dispatched_batches(spark, sf):
    f = R.facts(spark, sf).where("item_type = 'short_text'").select((F.col("game_id") % 50).alias("batch_id"), "fact_id", F.array("raw_text").alias("lines"))

    def translate(rows: list[dict]) -> list[dict]:
        return [{"id": r["id"], "translation_lines": ["译:" + (x or "") for x in r["lines"]]} for r in rows]

    done = runs.dispatch(f, translate)
    return done.where("error is null").select("fact_id", F.array_join("translation_lines", "\n").alias("answer"))


@query("select run_id as index_key,case when run_id%4=0 then 'missing' when run_id%4=1 then 'source_changed' when run_id%4=2 then 'count_changed' else 'current' end as reason from runs")
def t07_rebuild_reasons(spark, sf):
    now = R.runs(spark, sf).select(F.col("run_id").alias("index_key"), F.lit("a").alias("source_hash"), F.lit("b").alias("rules_hash"), F.col("total").alias("item_count"))
    k = F.col("index_key") % 4
    old = now.where(k != 0).select("index_key", F.when(k == 1, "x").otherwise("a").alias("source_hash"), "rules_hash", F.when(k == 2, F.col("item_count") + 1).otherwise(F.col("item_count")).alias("item_count"))
    return runs.rebuild_reasons(old, now)


@query("select date_trunc('hour',ts) as start,event_type,count(*) as n from events group by all")
def t09_windowed_stream(spark, sf):
    return events.drain(spark, f"{sf}/events.parquet", events.windowed_counts, time="ts")


@query("select distinct event_id,event_type from events")
def t09_deduplicated_stream(spark, sf):
    return events.drain(spark, f"{sf}/events.parquet", lambda e: events.deduplicated(e).select("event_id", "event_type"))


@query(None)
def r06_placeholder_rules(spark, sf):
    c = _cands(spark, sf).where("text is not null").select("file_id", "start_index", "text").distinct()
    rules = c.select((F.col("file_id") * 100000 + F.col("start_index")).alias("rule_index"), F.lit("placeholders").alias("domain"), F.to_json(F.struct(F.col("text").alias("pattern"), F.lit("TEXT").alias("name"))).alias("payload"))
    return validate.violations(rules).select("rule_index", "code", "field")


@query("select source_file as domain,sha256(count(*)::varchar||'|'||sum(('0x'||substr(sha256(raw_text),1,15))::bigint)::varchar) as token from items group by 1")
def k06_plan_tokens(spark, sf):
    i = R.items(spark, sf).select(F.col("source_file").alias("domain"), F.col("raw_text").alias("payload"))
    return validate.plan_token(i)
