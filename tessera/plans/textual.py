"""Text predicates, identities, measures, JSON paths and order-sensitive operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import controls, javascript, namebox
from tessera.functions import json as J
from tessera.functions import text as X
from tessera.operators import scope, sequence
from tessera.plans import relations as R
from tessera.plans.relations import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def _q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


BARE = f"regexp_replace(raw_text,{_q(X.CONTROLS)},'','g')"


def _cands(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "plugin_source_candidates")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    t = R.table(spark, sf, "plugin_source_files")
    return t.where("source_text is not null").groupBy("file_id").agg(F.max_by("source_text", "loaded_at").alias("source_text"), F.max_by("file_name", "loaded_at").alias("file_name"), F.max("game_id").alias("game_id"))


FILES = "(select file_id,arg_max(source_text,loaded_at) as source_text,arg_max(file_name,loaded_at) as file_name,max(game_id) as game_id from plugin_source_files where source_text is not null group by 1)"


def _unwrapped(x: str) -> str:
    for a, b in X.PAIRS:
        x = f"trim(regexp_replace({x},'(?s)^{a}(.*){b}$','\\1'),' ')"
    return x


def _noise(x: str) -> str:
    s = f"trim(regexp_replace({x},{_q(X.CONTROLS)},'','g'),' ')"
    parts = [f"{s}=''", f"lower({s}) in ({','.join(map(_q, X.KEYWORDS))})", f"regexp_matches({s},{_q(X.NUMBER_LIKE)})"]
    parts += [f"regexp_matches({'lower(' + s + ')' if n.startswith('asset') else s},{_q(p)})" for n, p in X.PROTOCOL_NOISE.items()]
    parts.append(f"(regexp_matches({s},{_q(X.OPERATOR)}) and len(regexp_extract_all({s},'[A-Za-z]{{2,}}'))<2)")
    parts.append(f"((contains({s},'/') or contains({s},'\\')) and regexp_matches({s},{_q(X.PATH_ONLY)}))")
    return "(" + " or ".join(parts) + ")"


@query(f"select fact_id from (select fact_id,{_unwrapped(chr(32) + 'trim(raw_text,chr(32))')} as t from items) where t<>'' and regexp_matches(regexp_replace(t,{_q(X.CONTROLS)},'','g'),{_q(X.JA_REQUIRED)})")
def f07_needs_translation(spark, sf):
    return R.items(spark, sf).where(X.needs_translation(F.col("raw_text"))).select("fact_id")


@query(f"select fact_id from items where trim(raw_text,' ')<>'' and regexp_matches(raw_text,{_q(X.JA_REQUIRED)})")
def f08_extractable(spark, sf):
    return R.items(spark, sf).where(X.extractable(F.col("raw_text"))).select("fact_id")


@query(f"select file_id,start_index,{_noise('text')} as noise from (select distinct file_id,start_index,text from plugin_source_candidates where text is not null)")
def f09_protocol_noise(spark, sf):
    return _cands(spark, sf).where("text is not null").select("file_id", "start_index", "text").distinct().select("file_id", "start_index", X.protocol_noise(F.col("text")).alias("noise"))


@query(f"""select file_id,start_index,coalesce(lower(trim(key,' ')) in ({','.join(map(_q, X.STRUCTURAL_FIELDS))}),false) or lower(trim(text,' ')) in ({','.join(map(_q, X.STRUCTURAL_VALUES))}) or regexp_matches(trim(text,' '),{_q(X.NUMBER)})
 or regexp_matches(lower(trim(text,' ')),{_q(X.PROTOCOL_NOISE['asset_path'])}) or regexp_matches(lower(trim(text,' ')),{_q(X.PROTOCOL_NOISE['asset_file'])}) as structural from (select distinct file_id,start_index,key,text from plugin_source_candidates where text is not null)""")
def f10_structural(spark, sf):
    c = _cands(spark, sf).where("text is not null").select("file_id", "start_index", "key", "text").distinct()
    return c.select("file_id", "start_index", X.structural(F.coalesce("key", F.lit("")), F.col("text")).alias("structural"))


@query("select fact_id from items where coalesce(original_lines[1],'')='話を聞く' and len(original_lines)>=1")
def f11_parameter_filter(spark, sf):
    return R.items(spark, sf).where(X.parameters_match(F.col("original_lines"), {0: "話を聞く"})).select("fact_id")


@query("select distinct file_name from plugin_source_files where file_name like 'Quest%.js'")
def f12_file_pattern(spark, sf):
    return R.table(spark, sf, "plugin_source_files").where(F.col("file_name").rlike(X.glob_regex("Quest*.js"))).select("file_name").distinct()


@query("select distinct raw_text as term from items where item_type='short_text' and regexp_matches(raw_text,'[0-9A-Za-z_ぁ-んァ-ヶ一-龯]')")
def f14_terms(spark, sf):
    return R.items(spark, sf).where("item_type = 'short_text'").where(F.col("raw_text").rlike("[0-9A-Za-z_ぁ-んァ-ヶ一-龯]")).select(F.col("raw_text").alias("term")).distinct()


@query(f"select fact_id from items where item_type='short_text' and trim(raw_text,' ')<>'' and not {_noise('raw_text')}")
def f15_term_eligible(spark, sf):
    return R.items(spark, sf).where("item_type = 'short_text'").where((F.trim("raw_text") != "") & ~X.protocol_noise(F.col("raw_text"))).select("fact_id")


@query("select distinct source_file from items where regexp_matches(source_file,'^Map[0-9]+\\.json$')")
def f17_map_files(spark, sf):
    return R.items(spark, sf).where(F.col("source_file").rlike(r"^Map[0-9]+\.json$")).select("source_file").distinct()


@query("select fact_id,sha256(raw_text) as hash,sha256(raw_text)=source_fact_raw_hash as same from items")
def x01_hash(spark, sf):
    return R.items(spark, sf).select("fact_id", X.sha(F.col("raw_text")).alias("hash"), (X.sha(F.col("raw_text")) == F.col("source_fact_raw_hash")).alias("same"))


IDENT = "concat('14:schema_version=1:2',chr(10),'6:domain=',strlen(domain)::varchar,':',domain,chr(10),'13:location_path=',strlen(location_path)::varchar,':',location_path,chr(10),'8:selector=',strlen(location_path)::varchar,':',location_path,chr(10),'8:raw_hash=64:',raw_hash,chr(10))"


@query(f"select fact_id,{IDENT} as ident from facts")
def x02_stable_identity(spark, sf):
    c = F.col
    return R.facts(spark, sf).select("fact_id", X.stable_identity(schema_version=F.lit("2"), domain=c("domain"), location_path=c("location_path"), selector=c("location_path"), raw_hash=c("raw_hash")).alias("ident"))


@query(f"select fact_id,concat('tf:',substr(raw_hash,1,12),':',sha256({IDENT})) as built from facts")
def x03_fact_id(spark, sf):
    c = F.col
    return R.facts(spark, sf).select("fact_id", X.fact_id(c("domain"), c("location_path"), c("location_path"), c("raw_hash")).alias("built"))


@query("select file_id,start_index,sha256(concat('{\"call_name\":',json_extract(ast_context,'$.call_name')::varchar,',\"property_key\":',json_extract(ast_context,'$.property_key')::varchar,',\"return_function_name\":',json_extract(ast_context,'$.return_function_name')::varchar,'}')) as fingerprint from (select distinct file_id,start_index,ast_context from plugin_source_candidates)")
def x04_json_fingerprint(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context").distinct().withColumn("k", F.concat_ws(":", "file_id", "start_index"))
    return J.fingerprints(c, "k", "ast_context").select(F.split("k", ":")[0].cast("long").alias("file_id"), F.split("k", ":")[1].cast("int").alias("start_index"), "fingerprint")


@query("select file_id,start_index,json_type(ast_context) in ('OBJECT','ARRAY') as container from (select distinct file_id,start_index,ast_context from plugin_source_candidates)")
def x06_json_container(spark, sf):
    kind = F.schema_of_variant(F.try_parse_json("ast_context"))
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context").distinct()
    return c.select("file_id", "start_index", F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False)).alias("container"))


@query(f"select fact_id,{_unwrapped('trim(raw_text,chr(32))')} as bare from items")
def x09_unwrapped(spark, sf):
    return R.items(spark, sf).select("fact_id", X.unwrap(F.col("raw_text"), X.PAIRS).alias("bare"))


#: Control sequences and spelled-out escapes for the SQL side, longest form first.
SPANS = r"(?i:\\(?:V|N|P|C|I|PX|PY|FS)\[[0-9]+\])|\\[{}\\$.|!><^]|%[0-9]+|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-7]{1,3}|\\[\"'/?abfnrtvGg]"


def _masked(x: str) -> str:
    """The text with placeholders as SQL: one replacement a control sequence; a backslash pair comes first."""
    x = f"replace({x},'\\\\','[RMMZ_BACKSLASH]')"
    for code, name in controls.INDEXED.items():
        x = f"regexp_replace({x},'(?i)\\\\{code}\\[([0-9]+)\\]','[RMMZ_{name}_\\1]','g')"
    for sign, name in controls.SYMBOLS.items():
        x = x if sign == "\\" else f"replace({x},'\\{sign}','[RMMZ_{name}]')"
    for sign, name in controls.LITERALS.items():
        x = f"replace({x},'\\{sign if sign != chr(39) else chr(39) * 2}','[RMMZ_LITERAL_{name}]')"
    x = f"regexp_replace({x},'\\\\[Gg]','[RMMZ_CURRENCY_UNIT]','g')"
    return f"regexp_replace({x},'%([0-9]+)','[RMMZ_MESSAGE_ARGUMENT_\\1]','g')"


@query(f"select fact_id,unnest(regexp_extract_all(raw_text,{_q(SPANS)})) as original from items")
def x10_control_spans(spark, sf):
    return controls.spans_of(R.items(spark, sf)).select(F.col("key").alias("fact_id"), "original")


@query(f"select fact_id,{BARE} as bare from items")
def x15_without_controls(spark, sf):
    return R.items(spark, sf).select("fact_id", X.without_controls(F.col("raw_text")).alias("bare"))


@query(f"select fact_id,{_masked('raw_text')} as masked,raw_text as restored from items")
def x16_mask_and_restore(spark, sf):
    return controls.masked_rows(R.items(spark, sf)).select(F.col("key").alias("fact_id"), "masked", "restored")


@query(None)
def x18_placeholder_problems(spark, sf):
    return controls.masked_rows(R.items(spark, sf)).where(F.size("problems") > 0).select(F.col("key").alias("fact_id"), F.array_join("problems", "|").alias("problems"))


@query("""select file_id||':'||start_index as id,'$['''||k||''']' as path,json_extract_string(ast_context,'$.'||k) as value from (select distinct file_id,start_index,ast_context from plugin_source_candidates),(select unnest(['call_name','property_key','return_function_name']) as k)""")
def x20_json_leaves(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context").distinct().withColumn("id", F.concat_ws(":", "file_id", "start_index"))
    return J.leaves(c, "id", "ast_context").select(F.col("key").alias("id"), "path", "value")


@query("""select o_orderkey,'$[''lines'']['||(row_number() over (partition by o_orderkey order by l_linenumber,l_partkey)-1)||'][''part'']' as path,l_partkey::varchar as value from orders join lineitem on l_orderkey=o_orderkey""")
def x20_nested_leaves(spark, sf):
    l = R.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(x["l_partkey"].alias("part"))).alias("lines"))
    docs = R.table(spark, sf, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.to_json(F.struct("lines")).alias("doc"))
    return J.leaves(docs, "o_orderkey", "doc").select(F.col("key").cast("long").alias("o_orderkey"), "path", "value")


@query("""select template,count(*) as hits from (select row_number() over (partition by o_orderkey order by l_linenumber,l_partkey)-1 as n from orders join lineitem on l_orderkey=o_orderkey),(values ('$[''lines''][*][''part'']',-1),('$[''lines''][0][''part'']',0),('$[''lines''][2][''part'']',2),('$[''lines''][*][''none'']',-2)) t(template,fixed) where fixed=-1 or fixed=n group by 1""")
def j13_template_hits(spark, sf):
    templates = spark.createDataFrame([("$['lines'][*]['part']",), ("$['lines'][0]['part']",), ("$['lines'][2]['part']",), ("$['lines'][*]['none']",)], "template string")
    return J.matched_templates(x20_nested_leaves(spark, sf), templates).groupBy("template").agg(F.count("*").alias("hits"))


@query("select event_id,'k' as slash,try_cast(json_extract_string(props,'$.k') as bigint) as value from events")
def x23_slash_paths(spark, sf):
    leaves = J.leaves(R.table(spark, sf, "events"), "event_id", "props")
    return leaves.select(F.col("key").cast("long").alias("event_id"), J.slash_path(F.col("path")).alias("slash"), F.col("value").try_cast("long").alias("value"))


@query(r"select distinct file_name,chr(39)||replace(replace(file_name,'\','\\'),chr(39),'\'||chr(39))||chr(39) as quoted from plugin_source_files")
def x24_quoted_keys(spark, sf):
    return R.table(spark, sf, "plugin_source_files").select("file_name", X.quoted_key(F.col("file_name")).alias("quoted")).distinct()


@query("select fact_id,(case when item_type in ('long_text','array') then len(string_split(raw_text,chr(10))) else 1 end)::bigint as lines from items")
def x26_lines(spark, sf):
    return R.items(spark, sf).select("fact_id", F.size(X.lines_of(F.col("raw_text"), F.col("item_type"))).cast("long").alias("lines"))


@query("select fact_id,case when length(raw_text)>20 then concat(substr(raw_text,1,19),'…') else raw_text end as sample from items")
def x27_sample(spark, sf):
    return R.items(spark, sf).select("fact_id", X.sample(F.col("raw_text"), 20).alias("sample"))


@query(f"select fact_id,len(regexp_extract_all({BARE},{_q(X.WIDE)}))::bigint as width from items")
def x28_width(spark, sf):
    return R.items(spark, sf).select("fact_id", X.width(F.col("raw_text")).alias("width"))


@query(r"select fact_id,unnest(string_split(replace(answer,'\n',chr(10)),chr(10))) as line from items")
def x29_display_lines(spark, sf):
    return R.items(spark, sf).select("fact_id", F.explode(F.split(F.replace("answer", F.lit("\\n"), F.lit("\n")), "\n")).alias("line"))


def _width(x: str) -> str:
    return f"len(regexp_extract_all(regexp_replace(regexp_replace({x},{_q(X.CONTROLS)},'','g'),{_q(X.PLACEHOLDER)},'','g'),{_q(X.WIDE)}))::bigint"


_SHOWN = "string_split(replace({0},'\\n',chr(10)),chr(10))"


@query(f"""select fact_id,i-1 as line_no,{_width('line')} as width,allowed from (select fact_id,unnest(shown) as line,generate_subscripts(shown,1) as i,allowed from (
 select fact_id,case when item_type='long_text' then list_transform(translation_lines,lambda x: coalesce(x,'')) else {_SHOWN.format("coalesce(translation_lines[1],'')")} end as shown,
 case when item_type='short_text' and len(original_lines)>0 then greatest(26,list_max(list_transform({_SHOWN.format("coalesce(original_lines[1],'')")},lambda x: {_width('x')}))) else 26 end as allowed
 from items where item_type='long_text' or (item_type='short_text' and len(translation_lines)>0 and (regexp_matches(array_to_string(original_lines,chr(10)),'\\n|\\\\n') or regexp_matches(coalesce(translation_lines[1],''),'\\n|\\\\n')))
 )) where {_width('line')}>allowed""")
def x30_over_wide_lines(spark, sf):
    wide = X.over_wide(F.col("original_lines"), F.col("translation_lines"), F.col("item_type"), 26)
    return R.items(spark, sf).select("fact_id", F.explode(wide).alias("x")).select("fact_id", "x.*")


def _strip(x: str) -> str:
    return f"regexp_replace({x},'^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$','','g')"


def _empty(x: str) -> str:
    return f"len(list_filter({x},lambda l: {_strip('l')}=''))"


_STRAY = f"list_filter(list_transform(a,lambda l: regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(l,{_q(X.CONTROLS)},' ','g'),{_q(X.RAW_CONTROL)},' ','g'),{_q(X.RAW_BARE)},' ','g'),'(?s)\\\\.?')),lambda l: len(l)>0)"
_COUNT = "(length({0})-length(replace({0},{1},'')))"


@query(f"""select fact_id,array_to_string(list_filter([
 case when location_path<>'' and contains(t,location_path) then 'location_leak' end, f,
 case when item_type='long_text' and {_empty('a')}>{_empty('o')} then 'unexpected_empty_line' end,
 case when item_type='long_text' and len(list_filter(a,lambda l: regexp_matches(regexp_replace(l,'^[\\s\\p{{Z}}\\x{{85}}]+',''),{_q(X.BROKEN_N)})))>0 then 'broken_n_prefix' end,
 case when item_type='long_text' and len(list_filter(flatten(s),lambda l: length(l)>1))>0 then 'stray_escape' end,
 case when item_type='long_text' and len(list_filter(flatten(s),lambda l: length(l)=1))>0 then 'trailing_backslash' end,
 case when item_type='short_text' and len(a)<>1 then 'line_count' end,
 case when item_type='short_text' and len(a)=1 and {_COUNT.format("array_to_string(o,chr(10))", "chr(10)")}<>{_COUNT.format("t", "chr(10)")} then 'real_line_breaks' end,
 case when item_type='short_text' and len(a)=1 and {_COUNT.format("array_to_string(o,chr(10))", "chr(92)||'n'")}<>{_COUNT.format("t", "chr(92)||'n'")} then 'literal_line_breaks' end
 ],lambda l: l is not null),'|') as codes from (select *,array_to_string(a,chr(10)) as t,{_STRAY} as s,list_filter(list_transform(a,lambda l: case when regexp_matches({_strip('l')},{_q(X.EXPLAINING)}) then 'explaining_prefix' when contains(l,{_q(X.EXPLAINED)}) then 'explaining_text' when regexp_matches({_strip('l')},{_q(X.PROTOCOL_KEY)}) then 'protocol_key' end),lambda l: l is not null)[1] as f
 from (select fact_id,item_type,location_path,list_filter(translation_lines,lambda l: l is not null) as a,list_filter(coalesce(original_lines,[]),lambda l: l is not null) as o from items where translation_lines is not null))""")
def x33_structure_errors(spark, sf):
    lines = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    e = X.structure_errors(lines(F.col("original_lines")), lines(F.col("translation_lines")), F.col("item_type"), F.col("location_path"))
    return R.items(spark, sf).where("translation_lines is not null").select("fact_id", F.array_join(e, "|").alias("codes"))


_BAREJ = f"regexp_replace(regexp_replace(l,{_q(X.CONTROLS)},' ','g'),'\\\\[A-Za-z]+\\[[^\\]]*\\]',' ','g')"
_OTHER = f"regexp_matches(regexp_replace({_BAREJ},{_q(X.JA_RESIDUAL)},'','g'),'[\\p{{L}}\\p{{N}}]')"
_RESTJ = f"regexp_replace(s,'[{X.JA_ALLOWED_CHARS}]','','g')"
_BADJ = f"case when {_RESTJ}='' then not {_OTHER} else not ({_OTHER} and regexp_replace({_RESTJ},'[{X.JA_ALLOWED_TAIL}]','','g')='') end"


@query(f"""select fact_id,array_to_string(segments,'|') as segments from (select fact_id,list_filter(list_transform(list_filter(translation_lines,lambda l: l is not null),lambda l: list_filter(regexp_extract_all({_BAREJ},{_q(X.JA_RESIDUAL)}),lambda s: {_BADJ})),lambda x: len(x)>0)[1] as segments from items) where segments is not null""")
def x35_japanese_residual(spark, sf):
    lines = F.filter("translation_lines", lambda x: x.isNotNull())
    r = R.items(spark, sf).where(F.col("answer").rlike(X.JA_RESIDUAL)).select("fact_id", X.japanese_residual(lines).alias("segments"))
    return r.where("segments is not null").select("fact_id", F.array_join("segments", "|").alias("segments"))


@query(None)
def x36_english_copy(spark, sf):
    return sequence.copied_rows(R.items(spark, sf), "fact_id", "raw_text", "answer").select(F.col("key").alias("fact_id"), F.array_join("runs", "|").alias("runs"))


@query(f"select fact_id,case when regexp_matches({BARE},{_q(X.JA_REQUIRED)}) and regexp_matches({BARE},{_q(X.EN_REQUIRED)}) then 'mixed' when regexp_matches({BARE},{_q(X.JA_REQUIRED)}) then 'ja' when regexp_matches({BARE},{_q(X.EN_REQUIRED)}) then 'en' else 'other' end as class from items")
def x39_language_class(spark, sf):
    return R.items(spark, sf).select("fact_id", X.language_class(F.col("raw_text")).alias("class"))


@query(f"""select *,case when visible=0 or e+j=0 or (en=0 and ja=0) then 'uncertain' when e>=greatest(5,3*j) or (j<greatest(5,3*e) and e>=greatest(3,2*j)) then 'en' when j>=greatest(5,3*e) or j>=greatest(3,2*e) then 'ja' else 'uncertain' end as language,
 case when visible=0 or e+j=0 or (en=0 and ja=0) then 'low' when e>=greatest(5,3*j) or j>=greatest(5,3*e) then 'high' when e>=greatest(3,2*j) or j>=greatest(3,2*e) then 'medium' else 'low' end as confidence from (select *,en+mixed as e,ja+mixed as j from (
 select game_id,count(*) as visible,count_if(class='ja')::bigint as ja,count_if(class='en')::bigint as en,count_if(class='mixed')::bigint as mixed from (select game_id,case when regexp_matches({BARE},{_q(X.JA_REQUIRED)}) and regexp_matches({BARE},{_q(X.EN_REQUIRED)}) then 'mixed' when regexp_matches({BARE},{_q(X.JA_REQUIRED)}) then 'ja' when regexp_matches({BARE},{_q(X.EN_REQUIRED)}) then 'en' else 'other' end as class from items where trim(raw_text,' ')<>'') group by 1))""".replace("select *,case", "select game_id,visible,ja,en,mixed,case", 1))
def a13_language_probe(spark, sf):
    visible = R.items(spark, sf).where(F.trim("raw_text") != "").select("game_id", X.language_class(F.col("raw_text")).alias("class"))
    counts = visible.groupBy("game_id").agg(F.count("*").alias("visible"), *[F.count_if(F.col("class") == c).alias(c) for c in ("ja", "en", "mixed")])
    language, confidence = X.recommended_language(*map(F.col, ("visible", "ja", "en", "mixed")))
    return counts.select("game_id", "visible", "ja", "en", "mixed", language.alias("language"), confidence.alias("confidence"))


BOXES = [
    namebox.Rule("bracket", r"【(?P<who>[^【】]+)】(?P<said>[^「」]*)", "who", "said", "translate", "【{speaker}】{body}"),
    namebox.Rule("quote", r"(?P<who>[^\s「」【】\\]{1,20})「(?P<said>.*)」", "who", "said", "translate", "{speaker}「{body}」"),
    namebox.Rule("actor", r"(?P<who>\\[Nn]\[\d+\])(?P<said>「.*」)", "who", "said", "actor_name", "{speaker}{body}"),
    namebox.Rule("speech", r"(?P<who>[^\s「」【】\\]+)「(?P<said>[^」]*[!！])」", "who", "said", "keep", "{speaker}「{body}」"),
]
#: The first lines of messages and what the rules make of them, for the SQL side.
BOXED = r"""(select fact_id,path,case when b then 'bracket' when q and x then 'quote|speech' when q then 'quote' when a then 'actor' else 'speech' end as rule,case when b then regexp_extract(t,'^【([^【】]+)】',1) when a then regexp_extract(t,'^(\\[Nn]\[[0-9]+\])',1) else regexp_extract(t,'^([^「]+)「',1) end as who,
 case when b then regexp_extract(t,'^【[^【】]+】(.*)$',1) when a then regexp_extract(t,'^\\[Nn]\[[0-9]+\](.*)$',1) else regexp_extract(t,'^[^「]+「(.*)」$',1) end as said,q and x as conflict,a as actor from (select fact_id,path,t,regexp_full_match(t,'【([^【】]+)】([^「」]*)') as b,regexp_full_match(t,'([^\s「」【】\\]{1,20})「(.*)」') as q,regexp_full_match(t,'(\\[Nn]\[[0-9]+\])(「.*」)') as a,regexp_full_match(t,'([^\s「」【】\\]+)「([^」]*[!！])」') as x
 from (select fact_id,path,regexp_replace(split_part(raw_text,chr(10),1),'^[\s\p{Z}]+|[\s\p{Z}]+$','','g') as t from items)) where b or q or a or x)"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    first = R.items(spark, sf).select("fact_id", F.substring_index("raw_text", "\n", 1).alias("line"))
    return namebox.boxes(first, "fact_id", "line", BOXES, {1: "Harold"})


_SPOKEN = r"(select case when actor then 'Harold' when trim(said,' ')<>'' then rtrim(rtrim(trim(who,' '),':：'),' ') else trim(who,' ') end as source_text,rule,case when actor then 'actor_name' when rule='speech' then 'keep' else 'translate' end as policy,path,fact_id,nullif(trim(said,' '),'') as line from " + BOXED + r" where not conflict and (not actor or who in ('\N[1]','\n[1]')))"


@query(f"""select source_text,rule,policy,policy<>'keep' as requires_speaker_name,places,samples from (select source_text,rule,policy,count(distinct path) as places from {_SPOKEN} group by all)
 left join (select source_text,rule,policy,string_agg(line,'|' order by first,line) as samples from (select *,row_number() over (partition by source_text,rule,policy order by first,line) as n from (select source_text,rule,policy,line,min(fact_id) as first from {_SPOKEN} where line is not null group by all)) where n<=3 group by all) using(source_text,rule,policy)""")
def a25_speaker_requirements(spark, sf):
    policy = F.create_map(*[F.lit(x) for r in BOXES for x in (r.name, r.policy)])
    b = _boxes(spark, sf).where("error is null").join(R.items(spark, sf).select(F.col("fact_id").alias("key"), "path"), "key")
    b = b.withColumn("policy", policy[F.col("rule")]).withColumn("source_text", F.when(F.col("policy") == "actor_name", F.col("speaker")).otherwise(F.col("source_speaker")))
    key = ["source_text", "rule", "policy"]
    lines = b.where(X.strip(F.col("body")) != "").groupBy(*key, X.strip(F.col("body")).alias("line")).agg(F.min("key").alias("first"))
    first = scope.first_n(lines, key, [F.col("first"), F.col("line")], 3)
    samples = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "|").alias("samples"))
    places = b.groupBy(*key).agg(F.countDistinct("path").alias("places"))
    return places.join(samples, key, "left").select(*key, (F.col("policy") != "keep").alias("requires_speaker_name"), "places", "samples")


@query(f"""select fact_id,rule,case when conflict then 'rules_conflict' when actor and who not in ('\\N[1]','\\n[1]') then 'actor_unknown' end as error,case when conflict or (actor and who not in ('\\N[1]','\\n[1]')) then null when actor then 'Harold' when trim(said)<>'' then rtrim(rtrim(trim(who),':：')) else trim(who) end as speaker from {BOXED}""")
def x40_name_boxes(spark, sf):
    return _boxes(spark, sf).select(F.col("key").alias("fact_id"), "rule", "error", "speaker")


@query(f"select doc_id,regexp_extract(tag,{_q(X.NOTE_TAG)},1) as tag,nullif(regexp_extract(tag,{_q(X.NOTE_TAG)},2),'') as value from (select doc_id,unnest(regexp_extract_all(text,{_q(X.NOTE_TAG)})) as tag from documents)")
def x42_note_tags(spark, sf):
    tags = R.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(X.NOTE_TAG), F.lit(0))).alias("t"))
    return tags.select("doc_id", F.regexp_extract("t", X.NOTE_TAG, 1).alias("tag"), F.nullif(F.regexp_extract("t", X.NOTE_TAG, 2), F.lit("")).alias("value"))


@query(r"select doc_id,regexp_replace(text,'<pad>','<pad:1>') as text from documents where len(regexp_extract_all(text,'<pad>'))=1")
def x43_replace_unique_tag(spark, sf):
    return R.table(spark, sf, "documents").where(F.regexp_count("text", F.lit("<pad>")) == 1).select("doc_id", F.regexp_replace("text", "<pad>", "<pad:1>").alias("text"))


_ENDS = " or ".join(f"ends_with(coalesce(api,''),{_q(x)})" for x in X.STRONG_CALLS)
_KEYS = ",".join(map(_q, X.STRONG_KEYS))
_PLACED = " or ".join(f"coalesce(json_extract_string(ast_context,'$.{k}'),'') not in ('','[]')" for k in ("return_function_name", "assignment_name", "property_path"))


@query(f"""select file_id,start_index,array_to_string(list_filter([case when num then 'number_like' end,case when res then 'resource_path_like' end,case when ident then 'identifier_or_path_like' end],lambda x: x is not null),'|') as flags,
 case when num or res then 'weak' when {_ENDS} or coalesce(key,'') in ({_KEYS}) then 'strong' when ({_PLACED}) or (length(text)>=8 and not ident) then 'medium' else 'weak' end as strength
 from (select distinct file_id,start_index,api,key,text,ast_context,regexp_matches(text,{_q(X.NUMBER_LIKE)}) as num,regexp_matches(text,{_q(X.RESOURCE_FILE)}) as res,regexp_matches(text,{_q(X.IDENTIFIER_OR_PATH)}) and (contains(text,'_') or contains(text,'/')) as ident from plugin_source_candidates where text is not null)""")
def x46_literal_confidence(spark, sf):
    c = _cands(spark, sf).where("text is not null").select("file_id", "start_index", "api", "key", "text", "ast_context").distinct()
    placed = F.lit(False)
    for k in ("return_function_name", "assignment_name", "property_path"):
        placed = placed | ~F.coalesce(F.get_json_object("ast_context", f"$.{k}"), F.lit("")).isin("", "[]")
    return c.select("file_id", "start_index", F.array_join(X.structural_flags(F.col("text")), "|").alias("flags"), X.literal_confidence(F.col("text"), F.col("api"), F.col("key"), placed).alias("strength"))


@query("""select o_orderkey,case when o_orderstatus='F' then 'timeout' when o_orderkey%7=0 then 'rate_limit' when o_orderkey%7=1 then 'conflict' when o_orderkey%7=2 then 'server' when o_orderkey%7=3 then 'fatal' when o_orderkey%7=4 then 'unknown' else 'fatal' end as class,
 o_orderstatus='F' or o_orderkey%7 in (0,1,2,4) as retryable from orders""")
def x54_failure_class(spark, sf):
    status = F.element_at(F.array(*[F.lit(x).cast("int") for x in (429, 409, 503, 400, 425, None, None)]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "F", "timeout")
    return R.table(spark, sf, "orders").select("o_orderkey", X.failure_class(kind, status).alias("class"), X.retryable(kind, status).alias("retryable"))


@query("select fact_id,floor(length(raw_text)/3.5)::bigint as tokens from items")
def x55_token_estimate(spark, sf):
    return R.items(spark, sf).select("fact_id", F.floor(F.length("raw_text") / F.lit(3.5)).alias("tokens"))


_BLOCK = "'## '||{0}||chr(10)||chr(10)||'id: '||{0}||chr(10)||'type: '||item_type||chr(10)||'role: '||coalesce(role,'')||chr(10)||case when item_type='array' then 'line_count: '||coalesce(len(original_lines),0)::varchar||chr(10) else '' end||chr(10)||{1}||chr(10)||chr(10)"


def _block(number, text):
    return X.prompt_block(number, F.col("item_type"), F.col("role"), text, F.coalesce(F.size("original_lines"), F.lit(0)))


@query(f"select fact_id,{_BLOCK.format(chr(39) + '1' + chr(39), 'raw_text')} as block from items")
def x56_prompt_block(spark, sf):
    return R.items(spark, sf).select("fact_id", _block(F.lit("1"), F.col("raw_text")).alias("block"))


@query(r"select distinct translate(location_path,'\/:*?','_____') as name from items")
def x57_file_names(spark, sf):
    return R.items(spark, sf).select(F.translate("location_path", "\\/:*?", "_____").alias("name")).distinct()


@query(f"select file_id,sha256(source_text) as sha256,strlen(source_text)::bigint as bytes from {FILES}")
def s06_manifest(spark, sf):
    return javascript.manifest(_files(spark, sf))


@query("select fact_id,game_id,item_type from translation_items")
def s07_table_scan(spark, sf):
    return R.table(spark, sf, "translation_items").select("fact_id", "game_id", "item_type")


@query("select distinct file_id,start_index,end_index,quote,line,raw_text,text from plugin_source_candidates c where exists (select 1 from plugin_source_files f where f.file_id=c.file_id and f.source_text is not null)")
def s13_string_literals(spark, sf):
    lit = javascript.string_literals(_files(spark, sf))
    # a template literal's candidate text keeps its substitutions as they are written
    return lit.select("file_id", "start_index", "end_index", "quote", "line", "raw_text", "text")


@query("select distinct file_id,start_index,raw_text from plugin_source_candidates c where exists (select 1 from plugin_source_files f where f.file_id=c.file_id and f.source_text is not null)")
def s14_scan_with_cache(spark, sf):
    files = _files(spark, sf)
    half, old = files.where("file_id % 2 = 0"), files.where("file_id % 4 = 1")
    # scans of another version hold what must not come back
    cached = javascript.as_cache(javascript.string_literals(half), files).unionByName(javascript.as_cache(javascript.string_literals(old).withColumn("raw_text", F.lit("stale")), files, {"rules_version": 0}))
    return javascript.with_cache(files, cached, javascript.string_literals).select("file_id", "start_index", "raw_text")


@query("select fact_id,count(*) as tokens,count(distinct marker) as kinds from (select fact_id,unnest(regexp_extract_all(raw_text,'\\\\[A-Za-z]+\\[[0-9]+\\]')) as marker from items) group by 1".replace("\\\\\\\\", "\\\\"))
def a20_token_counts(spark, sf):
    m = R.items(spark, sf).select("fact_id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"\\[A-Za-z]+\[[0-9]+\]"), F.lit(0))).alias("marker"))
    return m.groupBy("fact_id").agg(F.count("*").alias("tokens"), F.countDistinct("marker").alias("kinds"))


@query("""select fact_id,len(list_distinct(list_filter(a,lambda x: not list_contains(o,x))))::bigint as extra,list_sort(a)=list_sort(o) as same from (select fact_id,regexp_extract_all(answer,'\\\\[A-Za-z]+\\[[0-9]+\\]') as a,regexp_extract_all(raw_text,'\\\\[A-Za-z]+\\[[0-9]+\\]') as o from items)""".replace("\\\\\\\\", "\\\\"))
def u07_extra_controls(spark, sf):
    p = F.lit(r"\\[A-Za-z]+\[[0-9]+\]")
    a, o = (F.regexp_extract_all(c, p, F.lit(0)) for c in ("answer", "raw_text"))
    return R.items(spark, sf).select("fact_id", F.size(F.array_except(a, o)).cast("long").alias("extra"), (F.array_sort(a) == F.array_sort(o)).alias("same"))


_CLEAN = "regexp_replace(replace(trim(location_path,' '),'\\','/'),'/+','/','g')"
_PART = "regexp_extract(clean,'(?i)^(?:.*/)?(map[0-9]+|troops|commonevents)\\.json((?:/[0-9]+)+)/([^/]*)$',{0})"
#: The command rows for the SQL side: paths of any folder and spelling, the list they belong to and their position.
MSG = f"""(select game_id,case when stem like 'map%' then 'Map'||substr(stem,4) when stem='troops' then 'Troops' else 'CommonEvents' end||'.json'||middle as list_key,pos,speaker,raw_text,item_type,fact_id,{{'p':pos,'f':fact_id}} as place
 from (select *,lower({_PART.format(1)}) as stem,{_PART.format(2)} as middle,try_cast(case when regexp_matches(trim({_PART.format(3)},' '),'^[0-9]+$') then trim({_PART.format(3)},' ') end as bigint) as pos from (select *,{_CLEAN} as clean from items))
 where stem<>'' and pos is not null and length(middle)-length(replace(middle,'/',''))=case when stem='commonevents' then 1 else 2 end)"""
_SEEN = "over (partition by game_id,list_key order by pos,fact_id rows between unbounded preceding and current row)"


_COMMAND = r"(?i)^(?:.*/)?(map[0-9]+|troops|commonevents)\.json((?:/[0-9]+)+)/([^/]*)$"


def _commands(items: DataFrame) -> DataFrame:
    """Rows of the command lists with their list and position: of a map's or troop's page, or of a common event, in any
    folder and spelling of the path."""
    path = F.regexp_replace(F.translate(F.trim("location_path"), "\\", "/"), "/+", "/")
    stem, middle, last = (F.regexp_extract(path, _COMMAND, k) for k in (1, 2, 3))
    file = F.when(F.lower(stem).startswith("map"), F.concat(F.lit("Map"), F.substring(stem, 4, 100))).when(F.lower(stem) == "troops", "Troops").otherwise("CommonEvents")
    depth = F.length(middle) - F.length(F.replace(middle, F.lit("/"), F.lit("")))
    listed = (stem != "") & (depth == F.when(F.lower(stem) == "commonevents", 1).otherwise(2))
    pos = F.when(F.trim(last).rlike("^[0-9]+$"), F.trim(last)).try_cast("long")
    return items.where(listed & pos.isNotNull()).withColumn("list_key", F.concat(file, F.lit(".json"), middle)).withColumn("pos", pos)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return _commands(R.items(spark, sf)).select("game_id", "list_key", "pos", "speaker", "raw_text", "item_type", "fact_id")


@query(f"""select game_id,list_key,opened.p as block,count(*) as n,string_agg(raw_text,chr(10) order by pos,fact_id) as lines from (select *,last_value(case when speaker<>'' and item_type<>'array' then place end ignore nulls) {_SEEN} as opened,last_value(case when item_type='array' then place end ignore nulls) {_SEEN} as closed from {MSG} where length(trim(raw_text,' '))>0 or item_type='array')
 where item_type<>'array' and opened is not null and (closed is null or closed<opened) group by game_id,list_key,opened""")
def w01_dialogue_blocks(spark, sf):
    m = _messages(spark, sf).withColumn("choice", F.col("item_type") == "array")
    m = m.where((F.length(F.trim("raw_text")) > 0) | F.col("choice")).withColumn("opens", (F.col("speaker") != "") & ~F.col("choice"))
    return sequence.stitch(m, ["game_id", "list_key"], "pos", "opens", "raw_text", closes="choice", tie="fact_id")


@query(f"""select game_id,list_key,min(pos) as first,max(pos) as last,count(*) as n from (select *,pos-dense_rank() over (partition by game_id,list_key order by pos) as run from {MSG} where item_type='long_text') group by game_id,list_key,run""")
def w02_consecutive_runs(spark, sf):
    return sequence.islands(_messages(spark, sf), ["game_id", "list_key"], "pos", "item_type = 'long_text'")


@query(f"""select game_id,list_key,pos,anchor.p as anchor from (select *,dense_rank() over (partition by game_id,list_key,anchor order by pos)-1 as step,row_number() over (partition by game_id,list_key,anchor order by pos,fact_id) as nth from (select *,last_value(case when speaker<>'' then place end ignore nulls) {_SEEN} as anchor from {MSG}) where anchor is not null) where pos-anchor.p=step and nth>1""")
def w03_following_lines(spark, sf):
    return sequence.following(_messages(spark, sf), ["game_id", "list_key"], "pos", F.col("speaker") != "", tie="fact_id").select("game_id", "list_key", "pos", "anchor")


@query(f"""select speaker,row_number() over (partition by speaker order by fact_id)::bigint as seq,fact_id,raw_text as line from {MSG} where speaker<>''""")
def a16_lines_by_speaker(spark, sf):
    return sequence.numbered(_messages(spark, sf).where("speaker <> ''"), ["speaker"], "fact_id", "seq").select("speaker", "seq", "fact_id", F.col("raw_text").alias("line"))


@query(f"""with recursive o as (select game_id,source_file,fact_id,role,length({_BLOCK.format("''", _masked('raw_text'))}) as size,row_number() over (partition by game_id,source_file order by fact_id) as n from items where game_id is not null and source_file is not null),
r as (select game_id,source_file,fact_id,n,0 as batch,1 as sequence,size+2 as total,(size+2)//2>=300 as full_,(size+2)//2>=300 and (role is null or role='旁白') as closed,role as speaker,5 as remaining from o where n=1
 union all select game_id,source_file,fact_id,n,batch+fresh::int,seq,total,full_ or total//2>=300,case when full_ then closed_ else total//2>=300 and nobody end,case when full_ then speaker else role end,case when full_ then remaining-1 else 5 end from (
 select *,case when fresh then 1 else sequence+1 end as seq,case when fresh then size else total_+size end+2*length((case when fresh then 1 else sequence+1 end)::varchar) as total,was_full and not fresh as full_,closed_ and not fresh as closed__ from (
 select o.game_id,o.source_file,o.fact_id,o.n,o.role,o.size,r.batch,r.sequence,r.total as total_,r.full_ as was_full,r.closed as closed_,r.speaker,r.remaining,(o.role is null or o.role='旁白') as nobody,r.closed or (r.full_ and not (r.remaining>0 and (o.role is null or o.role='旁白' or coalesce(o.role=r.speaker,false)))) as fresh from r join o on o.game_id=r.game_id and o.source_file=r.source_file and o.n=r.n+1)))
select fact_id,batch,sequence from r""".replace("with recursive o as", "select * from (with recursive o as") + ")")
def w06_context_batches(spark, sf):
    masked = controls.masked_rows(R.items(spark, sf)).select(F.col("key").alias("fact_id"), "masked")
    i = R.items(spark, sf).where("game_id is not null and source_file is not null").join(masked, "fact_id")
    sized = i.select("game_id", "source_file", "fact_id", "role", F.length(_block(F.lit(""), F.col("masked"))).alias("size"))
    return sequence.batches(sized, ["game_id", "source_file"], "fact_id", "size", "role", 300, 2.0, 5).select("fact_id", "batch", "sequence")


@query(None)
def w12_copied_runs(spark, sf):
    return sequence.copied_rows(R.items(spark, sf), "fact_id", "raw_text", "answer").select(F.col("key").alias("fact_id"), F.size("runs").alias("runs"))


_MARK = "'\\[RMMZ_[A-Z0-9_]+\\]'"


@query(f"""select fact_id,len(names)::bigint as spans,(length(raw_text)-length(regexp_replace(masked,{_MARK},'','g')))::bigint as chars,array_to_string(names,'|') as placeholders from (select fact_id,raw_text,masked,regexp_extract_all(masked,{_MARK}) as names from (select fact_id,raw_text,{_masked('raw_text')} as masked from items)) where len(names)>0""")
def w14_selected_spans(spark, sf):
    spans = controls.spans_of(R.items(spark, sf)).groupBy("key").agg(F.count("*").alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.array_sort(F.collect_list(F.struct("start", "placeholder"))).alias("all"))
    return spans.select(F.col("key").alias("fact_id"), "spans", "chars", F.array_join(F.transform("all", lambda x: x["placeholder"]), "|").alias("placeholders"))


@query("""select * from (select file_id||':'||start_index as key,ast_context as before,regexp_replace(ast_context,'"call_name": "[^"]*"','"call_name": "Warning"') as content from (select distinct file_id,start_index,ast_context from plugin_source_candidates) where contains(ast_context,'Error')) where content<>before""".replace("select * from (", "select key,content from (", 1))
def k07_document_edits(spark, sf):
    c = _cands(spark, sf).select("file_id", "start_index", "ast_context").distinct().withColumn("id", F.concat_ws(":", "file_id", "start_index"))
    edits = c.where("ast_context like '%Error%'").select(F.col("id").alias("key"), F.lit("$['call_name']").alias("path"), F.lit("Warning").alias("new"))
    return J.apply_edits(c, edits, "id", "ast_context")


@query(f"""select file_id,failure,changed,(length(source_text)+changed)::bigint as chars from (select f.file_id,any_value(f.source_text) as source_text,null::varchar as failure,count(*) as changed from {FILES} f join (select distinct file_id,start_index,raw_text from plugin_source_candidates where raw_text<>'' and regexp_matches(text,{_q(X.JA_REQUIRED)}) and not contains(raw_text,'\\') and not contains(raw_text,'$')) c on c.file_id=f.file_id group by 1)""")
def k11_source_splice(spark, sf):
    files = _files(spark, sf)
    lit = javascript.string_literals(files).where(F.col("text").rlike(X.JA_REQUIRED) & (F.length("raw_text") > 0) & ~F.col("raw_text").contains("\\") & ~F.col("raw_text").contains("$"))
    edits = lit.select("file_id", "start_index", "end_index", "raw_text", F.concat(F.lit("译"), F.col("text")).alias("new_text"))
    done = javascript.splice(files.join(edits.select("file_id").distinct(), "file_id", "left_semi"), edits)
    return done.select("file_id", "failure", F.col("changed").cast("long").alias("changed"), F.length("content").cast("long").alias("chars"))
