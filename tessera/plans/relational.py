"""Joins, aggregations, windows, sorts and set operations over facts, index, translations and quality errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import scope, sequence
from tessera.plans import relations as R
from tessera.plans.relations import sql
from tessera.streaming import runs

TAG = "'" + X.NOTE_TAG + "'"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def _all(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return R.facts(spark, sf), R.index(spark, sf), R.translations(spark, sf)


ID = "f.fact_id=t.fact_id and f.raw_hash=t.raw_hash and f.translatable_hash=t.translatable_hash"
PENDING = f"select f.* from facts f join idx i on i.game_id=f.game_id and i.location_path=f.location_path and i.writable where not exists (select 1 from tr t where {ID})"


@query("select f.fact_id,i.location_path,i.writable from facts f join idx i using(game_id,location_path)")
def j01_facts_in_index(spark, sf):
    f, i, _ = _all(spark, sf)
    return scope.in_index(f, i).select("fact_id", "location_path", "writable")


@query(f"select f.fact_id,f.domain,t.answer from facts f join tr t on {ID}")
def j02_translated_facts(spark, sf):
    f, _, t = _all(spark, sf)
    return scope.translated(f, t).select("fact_id", "domain", "answer")


@query(f"select fact_id,location_path,domain from ({PENDING})")
def j03_pending_facts(spark, sf):
    return scope.pending(*_all(spark, sf)).select("fact_id", "location_path", "domain")


@query(f"select t.fact_id,t.location_path from tr t where not exists (select 1 from facts f join idx i on i.game_id=f.game_id and i.location_path=f.location_path and i.writable where {ID})")
def j04_stale_translations(spark, sf):
    f, i, t = _all(spark, sf)
    return scope.stale(t, f, i).select("fact_id", "location_path")


@query("select game_id,location_path from idx i where writable and not exists (select 1 from tr t where t.game_id=i.game_id and t.location_path=i.location_path)")
def j05_pending_places(spark, sf):
    _, i, t = _all(spark, sf)
    return scope.pending_places(i, t).select("game_id", "location_path")


@query(f"select e.run_id,e.fact_id,e.error_type from errors e where e.fact_id<>'' and exists (select 1 from facts f join idx i using(game_id,location_path) where f.fact_id=e.fact_id and not exists (select 1 from tr t where {ID}))")
def j06_open_quality_errors(spark, sf):
    f, i, t = _all(spark, sf)
    return scope.open_errors(R.errors(spark, sf), f, i, t).select("run_id", "fact_id", "error_type")


@query("select fact_id,answer from tr t where exists (select 1 from idx i where i.writable and i.game_id=t.game_id and i.location_path=t.location_path)")
def j07_translated_writable(spark, sf):
    _, i, t = _all(spark, sf)
    return t.join(i.where("writable"), scope.PLACE, "left_semi").select("fact_id", "answer")


@query("select distinct f.location_path from facts f where exists (select 1 from idx i where i.game_id=f.game_id and i.location_path=f.location_path)")
def j08_indexed_places(spark, sf):
    f, i, _ = _all(spark, sf)
    return f.join(i, scope.PLACE, "left_semi").select("location_path").distinct()


@query(f"select f.fact_id,f.location_path,t.answer from tr t join facts f on {ID} join idx i on i.game_id=f.game_id and i.location_path=f.location_path where i.writable")
def j09_write_back_rows(spark, sf):
    f, i, t = _all(spark, sf)
    return scope.write_back_rows(t, f, i).select("fact_id", "location_path", "answer")


@query(f"select t.fact_id from tr t where not exists (select 1 from facts f where {ID})")
def j10_unresolved_translations(spark, sf):
    f, _, t = _all(spark, sf)
    return scope.unresolved(t, f).select("fact_id")


@query("select i.fact_id,e.error_type as position_rule from items i left join errors e on e.fact_id=i.fact_id")
def j11_items_to_position_rules(spark, sf):
    return R.items(spark, sf).select("fact_id").join(R.errors(spark, sf).select("fact_id", F.col("error_type").alias("position_rule")), "fact_id", "left")


_OWNER = "split_part(path,'/',1)||'/'||split_part(path,'/',2)"
_GLOSS = f"select distinct game_id,raw_text as term,{_OWNER} as owner,starts_with(path,'System.json/') as system from items where (path like '%/name' or starts_with(path,'System.json/')) and raw_text<>''"


@query(f"""select distinct * from (select i.fact_id,g.term from items i join ({_GLOSS}) g on g.game_id=i.game_id and g.term=i.role
 union all select i.fact_id,g.term from items i join (select game_id,source_file,min(raw_text) as name from items where path like '%/displayName' group by all) d on d.game_id=i.game_id and d.source_file=i.source_file join ({_GLOSS}) g on g.game_id=i.game_id and g.term=d.name
 union all select i.fact_id,g.term from (select *,{_OWNER} as owner from items) i join ({_GLOSS}) g on g.game_id=i.game_id and g.owner=i.owner and not g.system where not starts_with(i.path,'System.json/')
 union all select i.fact_id,g.term from items i join ({_GLOSS}) g on g.game_id=i.game_id and g.system where starts_with(i.path,'System.json/'))""")
def j16_glossary_terms(spark, sf):
    i = R.items(spark, sf).withColumn("owner", F.concat(F.split("path", "/")[0], F.lit("/"), F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(2)), F.lit("")))).withColumn("system", F.col("path").startswith("System.json/"))
    shown = i.where("path like '%/displayName'").groupBy("game_id", "source_file").agg(F.min("raw_text").alias("display_name"))
    gloss = i.where("(path like '%/name' or system) and raw_text <> ''").select("game_id", F.col("raw_text").alias("term"), "owner", "system")
    asked = i.join(shown, ["game_id", "source_file"], "left").select(F.col("fact_id").alias("key"), "game_id", "role", "display_name", "owner", "system")
    return scope.glossary_for(asked, gloss).select(F.col("key").alias("fact_id"), "term")


@query("""with o as (select distinct game_id,split_part(path,'/',1)||'/'||split_part(path,'/',2) as owner,raw_text as owner_name from items where path like '%/name') select i.fact_id,o.owner_name from items i join o on o.game_id=i.game_id and o.owner=split_part(i.path,'/',1)||'/'||split_part(i.path,'/',2)""".replace("with o as", "select * from (with o as") + ")")
def j17_owner_names(spark, sf):
    i = R.items(spark, sf).select("game_id", "fact_id", "path", "raw_text", F.substring_index("path", "/", 2).alias("owner"))
    named = i.where("path like '%/name'").select("game_id", "owner", F.col("raw_text").alias("owner_name")).distinct()
    return i.join(named, ["game_id", "owner"]).select("fact_id", "owner_name")


@query("""select i.fact_id,d.display_name from items i left join (select game_id,source_file,min(raw_text) as display_name from items where path like '%/displayName' group by all) d on d.game_id=i.game_id and d.source_file=i.source_file""")
def j18_display_names(spark, sf):
    i = R.items(spark, sf)
    d = i.where("path like '%/displayName'").groupBy("game_id", "source_file").agg(F.min("raw_text").alias("display_name"))
    return i.join(d, ["game_id", "source_file"], "left").select("fact_id", "display_name")


@query("""with c as (select distinct file_id,selector,text from plugin_source_candidates), w as (select file_id,selector,max(text) as text from plugin_source_candidates where confidence='high' group by all)
select c.file_id,c.selector,case when w.selector is null then 'unmapped' when sha256(w.text)=sha256(c.text) then 'mapped' else 'moved' end as status from c left join w on w.file_id=c.file_id and w.selector=c.selector""")
def j19_runtime_literal_status(spark, sf):
    c = R.table(spark, sf, "plugin_source_candidates")
    w = c.where("confidence = 'high'").groupBy("file_id", "selector").agg(F.max("text").alias("mapped_text"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "unmapped").when(F.sha2("mapped_text", 256) == F.sha2("text", 256), "mapped").otherwise("moved")
    return c.select("file_id", "selector", "text").distinct().join(w, ["file_id", "selector"], "left").select("file_id", "selector", status.alias("status"))


@query("""with k as (select *,min(fact_id) over (partition by translatable_hash,item_type,speaker) as rep from facts) select k.fact_id,t.answer from k join tr t on t.fact_id=k.rep""".replace("with k as", "select * from (with k as") + ")")
def j21_fan_out_duplicates(spark, sf):
    f, _, t = _all(spark, sf)
    key = ["translatable_hash", "item_type", "speaker"]
    rep = f.groupBy(*key).agg(F.min("fact_id").alias("rep"))
    results = rep.join(t.select(F.col("fact_id").alias("rep"), "answer"), "rep").drop("rep")
    return scope.fan_out(results, f.select("fact_id", *key), key).select("fact_id", "answer")


_ANSWERS = "(select l_orderkey as batch,case when l_partkey%11=0 then 99 when l_linenumber=2 and l_orderkey%5=0 then 1 else l_linenumber end as prompt,l_partkey as answer from lineitem)"


@query(f"""with p as (select distinct l_orderkey as batch,l_linenumber as prompt from lineitem), k as (select a.* from {_ANSWERS} a join p using(batch,prompt)), d as (select distinct batch from (select batch,prompt from k group by all having count(*)>1))
select p.batch,p.prompt,k.answer,case when p.batch in (select batch from d) then 'duplicate_prompt' when k.answer is null then 'missing' end as error from p left join (select * from k where batch not in (select batch from d)) k using(batch,prompt)""".replace("with p as", "select * from (with p as") + ")")
def j22_answers_by_prompt(spark, sf):
    l = R.table(spark, sf, "lineitem")
    given = F.when(F.col("l_partkey") % 11 == 0, 99).when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 5 == 0), 1).otherwise(F.col("l_linenumber"))
    asked = l.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("prompt")).distinct()
    answers = l.select(F.col("l_orderkey").alias("batch"), given.alias("prompt"), F.col("l_partkey").alias("answer"))
    return scope.answers_by_prompt(asked, answers, "batch", "prompt").select("batch", "prompt", "answer", "error")


@query("""select f.fact_id,case when t.fact_id is null then 'missing' when t.raw_hash<>f.raw_hash then 'hash_mismatch' else 'ok' end as state from facts f left join tr t on t.fact_id=f.fact_id""")
def j26_rehydration_state(spark, sf):
    f, _, t = _all(spark, sf)
    t = t.select("fact_id", F.col("raw_hash").alias("stored_hash"))
    return f.join(t, "fact_id", "left").select("fact_id", F.when(F.col("stored_hash").isNull(), "missing").when(F.col("stored_hash") != F.col("raw_hash"), "hash_mismatch").otherwise("ok").alias("state"))


@query("""with v as (select trim(raw_text,' ') as term,min(answer) as translated from items where path like '%/name' group by 1) select i.fact_id,coalesce(v.translated,i.raw_text) as value from items i left join v on v.term=trim(i.raw_text,' ') where i.item_type='short_text'""".replace("with v as", "select * from (with v as") + ")")
def j27_field_terms(spark, sf):
    i = R.items(spark, sf)
    v = i.where("path like '%/name'").groupBy(F.trim("raw_text").alias("term")).agg(F.min("answer").alias("translated"))
    return i.where("item_type = 'short_text'").withColumn("term", F.trim("raw_text")).join(v, "term", "left").select("fact_id", F.coalesce("translated", "raw_text").alias("value"))


@query(f"""select 'facts' as measure,count(*) as n from facts union all select 'translations',count(*) from tr union all select 'index',count(*) from idx union all select 'writable',count(*) from idx where writable
union all select 'pending',count(*) from ({PENDING}) union all select 'errors',count(*) from errors union all select 'rule_hits',count(*) from facts where domain<>'standard_data'""")
def a01_scope_counts(spark, sf):
    f, i, t = _all(spark, sf)
    parts = {"facts": f, "translations": t, "index": i, "writable": i.where("writable"), "pending": scope.pending(f, i, t), "errors": R.errors(spark, sf), "rule_hits": f.where("domain <> 'standard_data'")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select error_type,count(*) as n from errors group by 1")
def a02_error_type_counts(spark, sf):
    return R.errors(spark, sf).groupBy("error_type").agg(F.count("*").alias("n"))


@query("""with a as (select domain,count(*) as items,count_if(coalesce(writable,false)) as writable,count_if(not coalesce(writable,false)) as unwritable from facts left join idx using(game_id,location_path) group by 1),
b as (select domain,count(*) as hits,count_if(not extractable) as inactive_hits from hits group by 1) select coalesce(a.domain,b.domain) as domain,coalesce(items,0)::bigint as items,coalesce(writable,0)::bigint as writable,coalesce(unwritable,0)::bigint as unwritable,coalesce(hits,0)::bigint as hits,coalesce(inactive_hits,0)::bigint as inactive_hits from a full join b on a.domain=b.domain""".replace("with a as", "select * from (with a as") + ")")
def a03_domain_summary(spark, sf):
    f, i, _ = _all(spark, sf)
    return scope.domain_summary(f, i, R.hits(spark, sf))


@query("select domain,rule_key,count(*) as hits,count(distinct location_path) as places,count_if(extractable)::bigint as extractable,count_if(writable)::bigint as writable,count_if(not writable)::bigint as unwritable from hits group by all")
def a04_rule_hit_summary(spark, sf):
    return scope.rule_hit_summary(R.hits(spark, sf))


@query("select count(*) as items,count_if(extractable)::bigint as active,count_if(writable)::bigint as writable,count_if(extractable and writable)::bigint as both_flags,count_if(not extractable)::bigint as inactive from hits")
def a05_scope_summary(spark, sf):
    return R.hits(spark, sf).agg(F.count("*").alias("items"), F.count_if("extractable").alias("active"), F.count_if("writable").alias("writable"), F.count_if(F.col("extractable") & F.col("writable")).alias("both_flags"), F.count_if(~F.col("extractable")).alias("inactive"))


@query(f"""select 'pending' as measure,count(*) as n from ({PENDING}) union all select 'translated',count(*) from facts f where exists (select 1 from tr t where {ID}) union all select 'errors',count(*) from errors union all
select 'missing_required',count(*) from items r where r.item_type='long_text' and not exists (select 1 from idx i where i.game_id=r.game_id and i.location_path=r.path)""")
def a06_gate(spark, sf):
    f, i, t = _all(spark, sf)
    # required are the places as rules would write them; a place that is stored in another spelling is missing
    need = R.items(spark, sf).where("item_type = 'long_text'").select("game_id", F.col("path").alias("location_path"))
    return scope.gate(f, i, t, R.errors(spark, sf), need)


_TAGS = f"(select doc_id,coalesce(source,'') as file,regexp_extract(m,{TAG},1) as tag,nullif(regexp_extract(m,{TAG},2),'') as value from (select doc_id,source,unnest(regexp_extract_all(text,{TAG})) as m from documents))"
_FILE = "case when regexp_matches(file,'^map_script-[0-9]+$') then 'map_script-*' else file end"


@query(f"""select file_pattern,tag,hits,value_hits,translatable_hits,samples from (select {_FILE} as file_pattern,tag,count(*) as hits,count(value) as value_hits,coalesce(count_if(coalesce(regexp_matches(value,'{X.JA_REQUIRED}'),false)),0)::bigint as translatable_hits from {_TAGS} group by all)
 left join (select file_pattern,tag,string_agg(value,'|' order by first) as samples from (select *,row_number() over (partition by file_pattern,tag order by first,value) as n from (select {_FILE} as file_pattern,tag,value,min(doc_id) as first from {_TAGS} where value is not null group by all)) where n<=3 group by all) using(file_pattern,tag)""")
def a07_tag_candidates(spark, sf):
    tags = R.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("file"), F.explode(F.regexp_extract_all("text", F.lit(X.NOTE_TAG), F.lit(0))).alias("m"))
    file = F.when(F.col("file").rlike("^map_script-[0-9]+$"), "map_script-*").otherwise(F.col("file"))
    t = tags.select("doc_id", file.alias("file_pattern"), F.regexp_extract("m", X.NOTE_TAG, 1).alias("tag"), F.nullif(F.regexp_extract("m", X.NOTE_TAG, 2), F.lit("")).alias("value"))
    key = ["file_pattern", "tag"]
    counts = t.groupBy(*key).agg(F.count("*").alias("hits"), F.count("value").alias("value_hits"), F.count_if(F.col("value").rlike(X.JA_REQUIRED)).alias("translatable_hits"))
    first = scope.first_n(t.where("value is not null").groupBy(*key, "value").agg(F.min("doc_id").alias("first")), key, [F.col("first"), F.col("value")], 3)
    samples = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]), "|").alias("samples"))
    return counts.join(samples, key, "left")


_CANDIDATE = "'" + X.RAW_CONTROL + r"|\\[{}\\$.|!><^]|" + X.RAW_BARE + "'"


@query(rf"""select marker,count(*) as n,count(distinct raw_text) as sources,regexp_full_match(marker,'{X.CONTROLS}') as standard,marker in ('\!','\.') as custom,min(fact_id) as first_seen from (select fact_id,raw_text,unnest(regexp_extract_all(raw_text,{_CANDIDATE})) as marker from items) where not regexp_full_match(marker,'\\[a-z]{{4,}}[0-9]*') group by 1 order by standard,custom,lower(marker),first_seen""")
def a08_placeholder_candidates(spark, sf):
    from tessera.functions import controls

    i = R.items(spark, sf)
    m = controls.candidates_of(i).select(F.col("key").alias("fact_id"), F.col("candidate").alias("marker")).join(i.select("fact_id", "raw_text"), "fact_id")
    counts = m.groupBy("marker").agg(F.count("*").alias("n"), F.countDistinct("raw_text").alias("sources"), F.min("fact_id").alias("first_seen"))
    marked = counts.withColumn("standard", F.col("marker").rlike(f"^(?:{X.CONTROLS})$")).withColumn("custom", F.col("marker").isin("\\!", "\\."))
    return marked.orderBy("standard", "custom", F.lower("marker"), "first_seen")


@query("""select regexp_replace(path,'[0-9]+','*','g') as template,count(*) as hits,count(distinct game_id) as games from items group by 1""")
def a09_template_hits(spark, sf):
    return R.items(spark, sf).groupBy(F.regexp_replace("path", "[0-9]+", "*").alias("template")).agg(F.count("*").alias("hits"), F.countDistinct("game_id").alias("games"))


@query("""select i.domain,count(*) as candidates,count(t.fact_id) as translated,count_if(t.fact_id is null and e.fact_id is not null)::bigint as reviewed,count_if(t.fact_id is null and e.fact_id is null)::bigint as unreviewed from items i left join tr t on t.fact_id=i.fact_id left join errors e on e.fact_id=i.fact_id group by 1""")
def a10_review_coverage(spark, sf):
    i, t, e = R.items(spark, sf), R.translations(spark, sf).select("fact_id", F.lit(True).alias("t")), R.errors(spark, sf).select("fact_id", F.lit(True).alias("e"))
    j = i.join(t, "fact_id", "left").join(e, "fact_id", "left")
    return j.groupBy("domain").agg(F.count("*").alias("candidates"), F.count("t").alias("translated"), F.count_if(F.col("t").isNull() & F.col("e").isNotNull()).alias("reviewed"), F.count_if(F.col("t").isNull() & F.col("e").isNull()).alias("unreviewed"))


@query("""select strong,medium,score,over_250 as files_over_250,max_score,strong>=300 or score>=2000 or over_250>=3 or heavy>0 as high_risk from (select coalesce(sum(strong),0)::bigint as strong,coalesce(sum(medium),0)::bigint as medium,coalesce(sum(score),0)::bigint as score,count_if(score>=250)::bigint as over_250,coalesce(max(score),0)::bigint as max_score,count_if(score>=300 and strong>=80)::bigint as heavy
 from (select file_id,count_if(confidence='high') as strong,count_if(confidence='medium') as medium,3*count_if(confidence='high')+count_if(confidence='medium') as score from plugin_source_candidates where active group by 1))""")
def a11_risk_score(spark, sf):
    return scope.risk(R.table(spark, sf, "plugin_source_candidates").withColumn("strength", F.when(F.col("confidence") == "high", "strong").otherwise(F.col("confidence"))), "file_id")


@query("""select coalesce(role,'unreviewed') as role,count(*) as n,count_if(stale)::bigint as stale from (select case when file_id%4=0 then null when flagged then 'filtered' when not active then 'excluded' else 'translated' end as role,file_id%4<>0 and gone as stale from (select distinct c.file_id,c.selector,coalesce(c.active,false) as active,coalesce(len(c.structural_flags),0)>0 as flagged,f.file_id is null as gone from plugin_source_candidates c left join (select distinct file_id from plugin_source_files where source_text is not null) f on f.file_id=c.file_id)) group by 1""")
def a12_review_summary(spark, sf):
    now = R.table(spark, sf, "plugin_source_files").where("source_text is not null").select("file_id", F.lit(True).alias("here")).distinct()
    c = R.table(spark, sf, "plugin_source_candidates").select("file_id", "selector", F.coalesce("active", F.lit(False)).alias("active"), (F.coalesce(F.size("structural_flags"), F.lit(0)) > 0).alias("flagged")).distinct()
    reviewed = F.col("file_id") % 4 != 0
    role = F.when(~reviewed, "unreviewed").when(F.col("flagged"), "filtered").when(~F.col("active"), "excluded").otherwise("translated")
    return c.join(now, "file_id", "left").groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.count_if(reviewed & F.col("here").isNull()).alias("stale"))


@query(None)
def a14_quality_counts(spark, sf):
    from tessera.functions import controls

    lines = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    i = R.items(spark, sf).where("translation_lines is not null")
    o, a = lines(F.col("original_lines")), lines(F.col("translation_lines"))
    residual = (F.col("answer").rlike(X.JA_RESIDUAL) & X.japanese_residual(a).isNotNull()).alias("residual")
    plain = i.agg(F.count_if(residual).alias("source_residual"), F.count_if(F.size(X.structure_errors(o, a, F.col("item_type"), F.col("location_path"))) > 0).alias("text_structure"), F.count_if(F.size(X.over_wide(o, a, F.col("item_type"), 26)) > 0).alias("overwide_line"))
    marks = controls.masked_rows(i).agg(F.count_if(F.size("problems") > 0).alias("placeholder_risk"))
    one = F.lit(1).alias("one")
    return plain.select(one, "*").join(marks.select(one, "*"), "one").select("source_residual", "text_structure", "placeholder_risk", "overwide_line")


@query("""select i.game_id,i.source_file,count(*) as n,sum(('0x'||substr(sha256(fact_id),1,15))::bigint)::varchar as ids,max(d.name) as display_name,case when max(d.names)>1 then 'display_name_conflict' end as error from items i left join (select game_id,source_file,min(raw_text) as name,count(distinct raw_text) as names from items where path like '%/displayName' group by all) d on d.game_id=i.game_id and d.source_file=i.source_file where i.game_id is not null group by 1,2""")
def a15_items_by_file(spark, sf):
    i = R.items(spark, sf).where("game_id is not null")
    key = ["game_id", "source_file"]
    shown = i.where("path like '%/displayName'").groupBy(*key).agg(F.min("raw_text").alias("display_name"), F.countDistinct("raw_text").alias("names"))
    whole = scope.set_fingerprint(i, key, "fact_id").withColumnRenamed("fingerprint", "ids")
    return whole.join(shown, key, "left").select(*key, "n", "ids", "display_name", F.when(F.col("names") > 1, "display_name_conflict").alias("error"))


@query("select trim(raw_text,' ') as term,count(distinct answer) as variants,count(distinct answer)>1 as conflict from items where item_type='short_text' group by 1")
def a17_term_conflicts(spark, sf):
    return R.items(spark, sf).where("item_type = 'short_text'").groupBy(F.trim("raw_text").alias("term")).agg(F.countDistinct("answer").alias("variants"), (F.countDistinct("answer") > 1).alias("conflict"))


@query("select source_file,count_if(length(trim(answer,' '))>0)::bigint as filled,count(*) as total from items where item_type='short_text' group by 1")
def a18_registry_fill(spark, sf):
    return R.items(spark, sf).where("item_type = 'short_text'").groupBy("source_file").agg(F.count_if(F.length(F.trim("answer")) > 0).alias("filled"), F.count("*").alias("total"))


@query("select run_id,error_type,count(*) as n from errors group by all")
def a19_error_categories(spark, sf):
    return R.errors(spark, sf).groupBy("run_id", "error_type").agg(F.count("*").alias("n"))


@query("select domain,count(*) as n from facts group by 1")
def a21_domain_fact_counts(spark, sf):
    return R.facts(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))


@query("""select domain,count_if(enabled)::bigint as enabled,count(*) as n from (select 'plugin_source' as domain,active as enabled from (select distinct file_id,selector,active from plugin_source_candidates)
 union all select 'note_tags',tag<>'pad' from (select distinct unnest(regexp_extract_all(text,'<([^<>:\\r\\n]+)(?::([^<>]*))?>',1)) as tag from documents) union all select 'event_commands',item_type<>'array' from (select distinct item_type,source_file from items where domain='event_commands')) group by 1""")
def a22_enabled_rule_counts(spark, sf):
    return R.rules(spark, sf).groupBy("domain").agg(F.count_if("enabled").alias("enabled"), F.count("*").alias("n"))


@query("""select run_id,count(*) as batches,sum(n)::bigint as sent,sum(good)::bigint as succeeded,sum(case when fate=1 then n when fate=0 then n-good else 0 end)::bigint as failed,sum(case when fate=2 then n else 0 end)::bigint as retryable,count_if(good=0)::bigint as failed_batches
 from (select *,case when fate=0 then told else 0 end as good from (select game_id%10 as run_id,game_id,case when game_id%7=1 then 1 when game_id%7=2 then 2 else 0 end as fate,count(*) as n,count_if(raw_text<>'') as told from items where game_id is not null group by 1,2,3)) group by 1""")
def a23_run_counters(spark, sf):
    i = R.items(spark, sf).where("game_id is not null").select(F.col("game_id").alias("batch_id"), "fact_id", F.array("raw_text").alias("lines"), (F.col("game_id") % 7).alias("fate"))
    marked = i.withColumn("lines", F.concat(F.array(F.col("fate").cast("string")), "lines"))

    def translate(rows: list[dict]) -> list[dict]:
        fate = rows[0]["lines"][0]
        if fate == "1":
            raise ValueError("refused")
        if fate == "2":
            raise runs.Recoverable("busy")
        return [{"id": r["id"], "translation_lines": ["译"]} for r in rows if r["lines"][1]]

    done = runs.dispatch(marked, translate)
    return runs.counters(done.withColumn("run_id", F.col("batch_id") % 10))


@query("select domain,count(*) as n,sum(('0x'||substr(sha256(fact_id),1,15))::bigint)::varchar as fingerprint from facts group by 1")
def a24_set_fingerprint(spark, sf):
    return scope.set_fingerprint(R.facts(spark, sf), ["domain"], "fact_id")


@query("""select file_id,count(*) as n,sha256(to_json(list(m order by start_index,selector))::varchar) as fingerprint from (select distinct file_id,start_index,selector,{'active':active,'selector':selector,'text':text} as m from plugin_source_candidates where text is not null) group by 1""")
def a24_candidate_list_fingerprint(spark, sf):
    c = R.table(spark, sf, "plugin_source_candidates").where("text is not null").select("file_id", "start_index", "selector", "active", "text").distinct()
    return scope.canonical_fingerprint(c, ["file_id"], ["start_index", "selector"], ["active", "selector", "text"])


_SCOPE = "sum(('0x'||substr(sha256(fact_id),1,15))::bigint)::varchar"


@query(f"""with c as (select domain,count(*) as candidates,{_SCOPE} as now,count_if(not exists (select 1 from tr t where {ID}))::bigint as uncovered from facts f group by 1), h as (select domain,{_SCOPE} as stored,count(*) as reviewed from facts where game_id%3<>1 or domain<>'note_tags' group by 1)
select c.domain,c.uncovered,case when h.stored is null then 'missing' when h.stored=c.now then 'confirmed' else 'stale' end as confirmation,case when c.uncovered=0 then 'ok' when h.stored=c.now and h.reviewed=c.candidates then 'warning' else 'error' end as decision from c left join h on h.domain=c.domain""".replace("with c as", "select * from (with c as") + ")")
def a26_review_decision(spark, sf):
    f, _, t = _all(spark, sf)
    covered = f.join(t.select(*scope.IDENTITY, F.lit(True).alias("t")), scope.IDENTITY, "left").groupBy("domain").agg(F.count_if(F.col("t").isNull()).alias("uncovered"))
    now = scope.set_fingerprint(f, ["domain"], "fact_id").select("domain", F.col("n").alias("candidates"), F.col("fingerprint").alias("now"))
    stored = scope.set_fingerprint(f.where("game_id % 3 <> 1 or domain <> 'note_tags'"), ["domain"], "fact_id").select("domain", F.col("n").alias("reviewed"), F.col("fingerprint").alias("stored"))
    j = covered.join(now, "domain").join(stored, "domain", "left")
    same = F.coalesce(F.col("stored") == F.col("now"), F.lit(False))
    return j.select(
        "domain", "uncovered", F.when(F.col("stored").isNull(), "missing").when(same, "confirmed").otherwise("stale").alias("confirmation"),
        F.when(F.col("uncovered") == 0, "ok").when(same & (F.col("reviewed") == F.col("candidates")), "warning").otherwise("error").alias("decision"),
    )


@query("select * from (select game_id,location_path,domain,fact_id from facts qualify row_number() over (partition by game_id,location_path order by domain,raw_text,fact_id)=1)")
def w04_first_row_per_place(spark, sf):
    return scope.first_by(R.facts(spark, sf), scope.PLACE, [F.col("domain"), F.col("raw_text"), F.col("fact_id")]).select("game_id", "location_path", "domain", "fact_id")


@query("select fact_id,row_number() over (partition by translatable_hash,item_type,speaker order by fact_id)=1 as representative from facts")
def w05_first_seen_dedup(spark, sf):
    f = R.facts(spark, sf)
    first = scope.first_keys(f, ["translatable_hash", "item_type", "speaker"], "fact_id").select("fact_id", F.lit(True).alias("first"))
    return f.select("fact_id").join(first, "fact_id", "left").select("fact_id", F.coalesce("first", F.lit(False)).alias("representative"))


@query("select fact_id,row_number() over (partition by game_id,source_file order by fact_id)::bigint as seq from facts")
def w07_sequence_ids(spark, sf):
    return sequence.numbered(R.facts(spark, sf).select("game_id", "source_file", "fact_id"), ["game_id", "source_file"], "fact_id", "seq").select("fact_id", "seq")


@query("select run_id,total from runs order by started_at desc,run_id desc limit 5")
def w08_recent_runs(spark, sf):
    return R.runs(spark, sf).orderBy(F.desc("started_at"), F.desc("run_id")).limit(5).select("run_id", "total")


@query("select run_id from runs order by started_at desc,run_id desc limit 1")
def w09_current_scope(spark, sf):
    return R.runs(spark, sf).orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).select("run_id")


@query("select * from (select speaker,raw_text,fact_id from facts qualify row_number() over (partition by speaker,raw_text order by fact_id)=1)")
def w10_first_seen_entries(spark, sf):
    return scope.first_keys(R.facts(spark, sf), ["speaker", "raw_text"], "fact_id").select("speaker", "raw_text", "fact_id")


@query("select * from (select domain,fact_id,row_number() over (partition by domain order by fact_id)::bigint as rn from facts) where rn<=12")
def w11_first_samples(spark, sf):
    return scope.first_n(R.facts(spark, sf), ["domain"], [F.col("fact_id")], 12).select("domain", "fact_id", F.col("rn").cast("long").alias("rn"))


@query("select location_path,domain,fact_id from facts order by location_path,domain,fact_id")
def o01_ordered_facts(spark, sf):
    return R.facts(spark, sf).select("location_path", "domain", "fact_id").orderBy("location_path", "domain", "fact_id")


@query("select fact_id,location_path from facts order by location_path,fact_id limit 50")
def o02_limited_facts(spark, sf):
    return scope.limited(R.facts(spark, sf).select("fact_id", "location_path"), [F.col("location_path"), F.col("fact_id")], 50)


@query(f"select fact_id from ({PENDING}) order by source_file,location_path,fact_id limit 100")
def o03_run_cap(spark, sf):
    return scope.pending(*_all(spark, sf)).orderBy("source_file", "location_path", "fact_id").limit(100).select("fact_id")


@query("select * from (select fact_id,dense_rank() over (order by game_id)::bigint as batch_no from facts) where batch_no<=20")
def o04_batch_cap(spark, sf):
    f = R.facts(spark, sf)
    games = f.select("game_id").distinct().orderBy("game_id").limit(20)
    # the batch numbers of one row per game: as many rows as there are games in the cap
    numbered = games.withColumn("batch_no", F.row_number().over(Window.orderBy("game_id")).cast("long"))
    return f.join(numbered, "game_id").select("fact_id", "batch_no")


@query("select (select count(*) from errors) as total,string_agg(fact_id,'|' order by fact_id) as samples from (select fact_id from errors order by fact_id limit 20)")
def o05_total_and_samples(spark, sf):
    return scope.total_and_samples(R.errors(spark, sf), ["fact_id"], 20)


@query("select fact_id,coalesce(try_cast(regexp_extract(path,'([0-9]+)$',1) as bigint),-1) as line_index from items order by location_path,2")
def o06_detail_order(spark, sf):
    last = F.coalesce(F.regexp_extract("path", "([0-9]+)$", 1).try_cast("long"), F.lit(-1))
    return R.items(spark, sf).select("location_path", "fact_id", last.alias("line_index")).orderBy("location_path", "line_index").select("fact_id", "line_index")


@query("select raw_text as term,length(raw_text) as n from (select distinct raw_text from items where item_type='short_text') order by n desc,term")
def o07_terms_by_length(spark, sf):
    return R.items(spark, sf).where("item_type = 'short_text'").select(F.col("raw_text").alias("term")).distinct().withColumn("n", F.length("term").cast("long")).orderBy(F.desc("n"), "term")


@query("select fact_id,row_number() over (partition by game_id,source_file order by location_path desc,fact_id desc)::bigint as write_order from facts")
def o08_reverse_write_order(spark, sf):
    f = R.facts(spark, sf).select("game_id", "source_file", "fact_id", F.concat("location_path", F.lit("\x00"), "fact_id").alias("place"))
    up = sequence.numbered(f, ["game_id", "source_file"], "place", "up")
    n = f.groupBy("game_id", "source_file").agg(F.count("*").alias("n"))
    return up.join(n, ["game_id", "source_file"]).select("fact_id", (F.col("n") - F.col("up") + 1).alias("write_order"))


@query("select location_path from tr union select location_path from errors")
def u01_reviewed_places(spark, sf):
    return R.translations(spark, sf).select("location_path").union(R.errors(spark, sf).select("location_path")).distinct()


@query("select fact_id from facts except select fact_id from tr except select fact_id from errors")
def u02_unreviewed(spark, sf):
    return R.facts(spark, sf).select("fact_id").subtract(R.translations(spark, sf).select("fact_id")).subtract(R.errors(spark, sf).select("fact_id"))


@query("select fact_id from tr intersect select fact_id from errors")
def u03_translated_and_excluded(spark, sf):
    return R.translations(spark, sf).select("fact_id").intersect(R.errors(spark, sf).select("fact_id"))


@query("select 'pending' as side,fact_id,raw_hash from (select fact_id,raw_hash from facts except select fact_id,raw_hash from tr) union all select 'stale',fact_id,raw_hash from (select fact_id,raw_hash from tr except select fact_id,raw_hash from facts)")
def u04_identity_differences(spark, sf):
    f, t = R.facts(spark, sf).select("fact_id", "raw_hash"), R.translations(spark, sf).select("fact_id", "raw_hash")
    return f.subtract(t).select(F.lit("pending").alias("side"), "*").unionByName(t.subtract(f).select(F.lit("stale").alias("side"), "*"))


@query("select location_path from facts f where not exists (select 1 from tr t where t.location_path=f.location_path)")
def u05_missing_places(spark, sf):
    return R.facts(spark, sf).join(R.translations(spark, sf), "location_path", "left_anti").select("location_path")


@query("select 'fact' as branch,fact_id from facts union all select 'translation',fact_id from tr union all select 'error',fact_id from errors")
def u06_append_branches(spark, sf):
    out = None
    for name, df in (("fact", R.facts(spark, sf)), ("translation", R.translations(spark, sf)), ("error", R.errors(spark, sf))):
        one = df.select(F.lit(name).alias("branch"), "fact_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("select fact_id,domain,item_type from facts")
def f01_projection(spark, sf):
    return R.facts(spark, sf).select("fact_id", "domain", "item_type")


@query("select fact_id from facts where game_id=1 and domain='event_commands'")
def f02_equality(spark, sf):
    return R.facts(spark, sf).where((F.col("game_id") == 1) & (F.col("domain") == "event_commands")).select("fact_id")


@query("select fact_id from facts where fact_id in (select fact_id from errors)")
def f03_in_list(spark, sf):
    return R.facts(spark, sf).join(R.errors(spark, sf), "fact_id", "left_semi").select("fact_id")


@query("select fact_id,location_path from facts where starts_with(location_path,'Map001.json/')")
def f04_prefix(spark, sf):
    return R.facts(spark, sf).where(F.col("location_path").startswith("Map001.json/")).select("fact_id", "location_path")


@query("select fact_id,location_path from facts where location_path ilike 'map_01%'")
def f04_prefix_like(spark, sf):
    return R.facts(spark, sf).where(F.col("location_path").ilike("map_01%")).select("fact_id", "location_path")


@query("select fact_id from facts where domain<>'standard_data'")
def f05_not_equal(spark, sf):
    return R.facts(spark, sf).where("domain <> 'standard_data'").select("fact_id")


@query("select f.fact_id from facts f left join idx i on i.game_id=f.game_id and i.location_path=f.location_path where coalesce(i.writable,false)<>true")
def f06_unwritable(spark, sf):
    f, i, _ = _all(spark, sf)
    return f.join(i, scope.PLACE, "left").where(~F.coalesce("writable", F.lit(False))).select("fact_id")


@query("select fact_id,coalesce(raw_hash=stored,false) as current from (select f.fact_id,f.raw_hash,t.raw_hash as stored from facts f left join tr t on t.fact_id=f.fact_id)")
def f13_stale_rules(spark, sf):
    f, _, t = _all(spark, sf)
    return f.join(t.select("fact_id", F.col("raw_hash").alias("stored")), "fact_id", "left").select("fact_id", F.coalesce(F.col("raw_hash") == F.col("stored"), F.lit(False)).alias("current"))


@query("select fact_id,answer from tr where fact_id not in (select fact_id from errors) union all select fact_id,error_type from errors")
def k02_upsert(spark, sf):
    new = R.errors(spark, sf).select("fact_id", F.col("error_type").alias("answer"))
    return scope.upsert(R.translations(spark, sf).select("fact_id", "answer"), new, ["fact_id"])


@query("select fact_id from tr where not starts_with(location_path,'Map001') and fact_id not in (select fact_id from errors where run_id=1)")
def k05_deletes(spark, sf):
    gone = R.errors(spark, sf).where("run_id = 1")
    return R.translations(spark, sf).where(~F.col("location_path").startswith("Map001")).join(gone, "fact_id", "left_anti").select("fact_id")
