"""Sources and sinks of project folders as queries: the tables are written out as projects and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import terminology
from tessera.plans import relations as R
from tessera.plans.relations import sql
from tessera.plans.textual import FILES, _files
from tessera.rules import validate
from tessera.session import scratch
from tessera.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


def _data(spark: SparkSession, sf: str) -> DataFrame:
    """One document a game and file: a list of objects with a name and a note, in the order of their facts."""
    i = R.items(spark, sf).where("game_id is not null and source_file like '%.json'")
    note = F.when(F.col("path").contains("/note/"), F.concat(F.lit("<fact:"), "fact_id", F.lit(">"))).otherwise("")
    entry = lambda name: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", F.col(name).alias("name"), note.alias("note")))), lambda x: F.struct(x["name"].alias("name"), x["note"].alias("note"))))
    return i.groupBy("game_id", "source_file").agg(entry("raw_text").alias("raw"), entry("answer").alias("translated"))


def _project(spark: SparkSession, sf: str) -> DataFrame:
    """The files of all games: every third has ``www``, every fifth keeps its untranslated files beside translated ones."""
    key = ("folders", spark.sparkContext.applicationId, f"{sf}", R._version(spark, f"{sf}/translation_items.parquet"))
    if R.built(spark, key) is None:
        root = scratch(spark, "projects")
        home = F.concat(F.lit("g"), F.col("game_id").cast("string"), F.when(F.col("game_id") % 3 == 0, "/www").otherwise(""))
        d = _data(spark, sf)
        kept = F.col("game_id") % 5 == 0
        data = d.select(F.concat(home, F.lit("/data/"), "source_file").alias("path"), F.when(kept, F.col("translated")).otherwise(F.col("raw")).alias("text"))
        origin = d.where(kept).select(F.concat(home, F.lit("/data_origin/"), "source_file").alias("path"), F.col("raw").alias("text"))
        s = _scripts(spark, sf)
        scripts = s.select(F.concat(home, F.lit("/js/plugins/"), "name", F.lit(".js")).alias("path"), F.col("source_text").alias("text"))
        entries = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("name", (F.col("file_id") % 3 != 0).alias("status")))), lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"))))
        lists = s.groupBy("game_id").agg(F.concat(F.lit("// generated\nvar $plugins =\n"), entries, F.lit(";\n")).alias("text")).select(F.concat(home, F.lit("/js/plugins.js")).alias("path"), "text")
        files.write_files(data.unionByName(origin).unionByName(scripts).unionByName(lists), root).write.format("noop").mode("overwrite").save()
        R._BUILT[key] = root
    return files.project_files(spark, R._BUILT[key])


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).where("file_name is not null and game_id is not null")
    return f.withColumn("name", F.concat(F.col("file_id").cast("string"), F.lit("_"), F.regexp_replace("file_name", r"\.js$", "")))


GAMES = "(select distinct game_id,source_file from items where game_id is not null and source_file like '%.json')"
#: Games of every third number have their files under www, but only those with scripts too are read from there.
_READ = f"(game_id%3<>0 or game_id in (select game_id from {FILES} where file_name is not null))"
_NAME = "file_id::varchar||'_'||regexp_replace(file_name,'\\.js$','')"
STANDARD = "('Actors.json','Animations.json','Armors.json','Classes.json','CommonEvents.json','Enemies.json','Items.json','MapInfos.json','Skills.json','States.json','System.json','Tilesets.json','Troops.json','Weapons.json')"


@query(f"select 'g'||game_id as project,source_file as file_name from {GAMES} where {_READ} and (source_file in {STANDARD} or regexp_matches(source_file,'^Map[0-9]+\\.json$'))")
def s01_standard_files(spark, sf):
    return files.standard_files(_project(spark, sf)).select("project", "file_name")


@query(f"select 'g'||game_id as project,source_file as file_name from {GAMES} where {_READ} and ((source_file='System.json' and game_id%4<>0) or (source_file='Items.json' and game_id%2=0))")
def s02_files_named_by_rules(spark, sf):
    games = R.items(spark, sf).where("game_id is not null").select("game_id").distinct()
    rule = lambda name, skipped, some: F.struct(F.lit(name).alias("file_name"), skipped.alias("skipped"), F.when(some, F.array(F.lit("$[*]"))).otherwise(F.array().cast("array<string>")).alias("paths"))
    g = F.col("game_id")
    each = F.explode(F.array(rule("System.json", g % 4 == 0, F.lit(True)), rule("Items.json", F.lit(False), g % 2 == 0), rule("Absent.json", F.lit(False), F.lit(True))))
    rules = games.select(F.concat(F.lit("g"), g.cast("string")).alias("project"), each.alias("r")).select("project", "r.*")
    return files.nonstandard_files(_project(spark, sf), rules).select("project", "file_name")


@query(f"select 'g'||game_id as project,{_NAME} as name,file_id%3<>0 as enabled from {FILES} where file_name is not null and game_id is not null and (game_id%3<>0 or game_id in (select game_id from {GAMES}))")
def s03_plugin_list(spark, sf):
    return files.plugins(_project(spark, sf)).select("project", "name", "enabled")


@query(f"select 'g'||game_id as project,{_NAME}||'.js' as file_name,sha256(source_text) as hash from {FILES} where file_name is not null and game_id is not null and file_id%3<>0 and (game_id%3<>0 or game_id in (select game_id from {GAMES}))")
def s04_enabled_scripts(spark, sf):
    return files.plugin_sources(_project(spark, sf)).select("project", "file_name", F.sha2("text", 256).alias("hash"))


@query(f"select 'g'||game_id as project,'data' as kind,count(*) as n from {GAMES} where {_READ} group by game_id union all select 'g'||game_id,k,case k when 'list' then 1 else count(*) end from {FILES},(select unnest(['list','plugins']) as k) where file_name is not null and game_id is not null and (game_id%3<>0 or game_id in (select game_id from {GAMES})) group by game_id,k")
def s05_project_layout(spark, sf):
    return _project(spark, sf).groupBy("project", "kind").agg(F.count("*").alias("n"))


@query(f"select 'g'||game_id||'/'||source_file as place,'<fact:'||fact_id||'>' as note from items where game_id is not null and source_file like 'Map%.json' and contains(path,'/note/') and {_READ}")
def s12_note_sources(spark, sf):
    f = _project(spark, sf).where("kind = 'data'").withColumn("place", F.concat_ws("/", "project", "file_name"))
    return files.note_sources(f, "Map*.json", "place").select(F.col("key").alias("place"), F.col("value").alias("note"))


@query(f"select 'g'||game_id as project,source_file as file_name,raw_text as value from items where game_id is not null and {_READ} and source_file in ('Actors.json','Armors.json','Classes.json','Enemies.json','Items.json','Skills.json','States.json','Weapons.json') and trim(raw_text,' ')<>''")
def s16_visible_texts(spark, sf):
    return files.visible_texts(_project(spark, sf).where("kind = 'data'"), F.col("project")).select(F.col("key").alias("project"), "file_name", "value")


@query("select 'run_id='||run_id as game,null::varchar as problem from runs union all select 'broken','unreadable' union all select 'note.txt','no_folder'")
def s15_registry(spark, sf):
    root = scratch(spark, "registry")
    R.runs(spark, sf).write.partitionBy("run_id").parquet(root)
    files.write_files(spark.createDataFrame([("broken/part-0.parquet", "no table"), ("note.txt", "x")], "path string, text string"), root).count()
    return files.registry(spark, root).where("game not like '\\_%'")


@query(f"select file_id::varchar||'/'||file_id::varchar||'.js' as path,strlen(source_text)::bigint as bytes,sha256(source_text) as hash from {FILES}")
def k10_written_files(spark, sf):
    root = scratch(spark, "written")
    path = F.concat_ws("/", F.col("file_id").cast("string"), F.concat(F.col("file_id").cast("string"), F.lit(".js")))
    files.write_files(_files(spark, sf).select(path.alias("path"), F.col("source_text").alias("text")), root).write.format("noop").mode("overwrite").save()
    back = files.snapshot(spark, f"{root}/*/*.js")
    return back.select(F.regexp_extract("path", r"([0-9]+/[0-9]+\.js)$", 1).alias("path"), "bytes", F.col("sha256").alias("hash"))


@query("select (select count(*) from errors) as total,(select string_agg(fact_id,'|' order by fact_id) from (select fact_id from errors order by fact_id limit 20)) as samples,(select count(*) from errors) as details")
def k09_report(spark, sf):
    path = scratch(spark, "report")
    files.report_summary(R.errors(spark, sf).select("fact_id", "error_type"), path, ["fact_id"])
    summary = spark.read.schema("total long, samples array<struct<fact_id:string,error_type:string>>").json(f"{path}/summary")
    details = spark.read.schema("fact_id string").json(f"{path}/details").agg(F.count("*").alias("details"))
    one = summary.select(F.lit(1).alias("one"), "total", F.array_join(F.transform("samples", lambda x: x["fact_id"]), "|").alias("samples"))
    return one.join(details.select(F.lit(1).alias("one"), "details"), "one").drop("one")


@query("""select domain,rule_id from (select 'note_tags' as domain,'stored' as rule_id union all select 'event_commands',source_file||'|'||item_type from (select distinct item_type,source_file from items where domain='event_commands') union all select 'plugin_source','kept')""")
def k06_two_phase_import(spark, sf):
    kind = "domain string, rule_index long, rule_id string, payload string"
    stored = spark.createDataFrame([("note_tags", 0, "stored", '{"file_name":"a","tags":["b"]}'), ("event_commands", 0, "old", '{"code":101,"paths":["x"]}'), ("plugin_source", 0, "kept", '{"file":"a.js","selectors":["b"]}')], kind)
    new = R.rules(spark, sf).where("domain = 'event_commands'").select("domain", F.xxhash64("rule_id").alias("rule_index"), "rule_id", F.lit('{"code":101,"paths":["parameters[0]"]}').alias("payload"))
    bad = new.withColumn("domain", F.lit("note_tags")).withColumn("payload", F.lit("{}"))
    plan = validate.prepare(stored, new)
    after = validate.commit(stored, new, plan)
    # a plan made before another commit is stale, one with violations is refused: both leave the stored rules as they are
    after = validate.commit(after, new.withColumn("rule_id", F.lit("late")), plan)
    after = validate.commit(after, bad, validate.prepare(after, bad))
    return after.select("domain", "rule_id")


_CATEGORY = "case source_file when 'Actors.json' then 'actor_names' when 'Classes.json' then 'class_names' when 'Skills.json' then 'skill_names' when 'Items.json' then 'item_names' when 'Weapons.json' then 'weapon_names' when 'Armors.json' then 'armor_names' when 'Enemies.json' then 'enemy_names' when 'States.json' then 'state_names' end"


@query(f"""with n as (select *,{_CATEGORY} as category from items where game_id is not null), t as (select game_id,category,trim(raw_text,' ') as source,min(answer) as new from n where category is not null and trim(raw_text,' ')<>'' and trim(answer,' ')<>'' group by all)
select 'g'||n.game_id as project,'g'||n.game_id||'/'||source_file as key,raw_text as value,new from n join t on t.game_id=n.game_id and t.category=n.category and t.source=trim(n.raw_text,' ') where {_READ.replace('game_id%3', 'n.game_id%3').replace('or game_id in', 'or n.game_id in')}""".replace("with n as", "select * from (with n as") + ")")
def k12_terminology_edits(spark, sf):
    f = _project(spark, sf).where("kind = 'data'").withColumn("doc", F.concat_ws("/", "project", "file_name"))
    key = F.col("key")
    leaves = files.leaves(f.select(F.col("doc").alias("file_name"), "text")).select(F.substring_index(key, "/", 1).alias("project"), key.alias("key"), F.substring_index(key, "/", -1).alias("file_name"), "path", "value")
    kinds = F.create_map(*[F.lit(x) for name, k, kind in terminology.FIELDS if k == "name" for x in (name, kind)])
    i = R.items(spark, sf).where("game_id is not null and trim(answer) <> '' and trim(raw_text) <> ''")
    terms = i.select(F.concat(F.lit("g"), F.col("game_id").cast("string")).alias("project"), kinds[F.col("source_file")].alias("category"), F.col("raw_text").alias("source"), F.col("answer").alias("translated")).where("category is not null")
    return terminology.edits(leaves, terms, ["project"]).select("project", "key", "value", "new")
