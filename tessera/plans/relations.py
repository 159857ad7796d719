"""The relations that the operators run on, derived from the tables: DataFrames and, for the SQL side, named views.

A fact is a stored item, its domain follows from the file of its place; a place is writable if it has source lines;
a translation is an item with a visible translation, and one that was loaded more than a day late carries an outdated
hash (a stale translation); a quality error is an empty, copied or explained translation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import NOTE_TAG
from tessera.operators.scope import latest
from tessera.session import scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_BUILT: dict[tuple, str] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """What tells whether the files under ``path`` have changed: their number, bytes and last change."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    s = fs.getContentSummary(p)
    newest = max([f.getModificationTime() for f in fs.listStatus(p)], default=0)
    return s.getFileCount(), s.getLength(), newest


def built(spark: SparkSession, key: tuple) -> str | None:
    """Where what ``key`` names was stored in this session, if it is still there."""
    path = _BUILT.get(key)
    if path is None:
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def items(spark: SparkSession, sf: str) -> DataFrame:
    """The current items: the stored table of the source's present version, built at the first use. Queries read it with
    pushed filters and pruned columns, instead of looking for the latest row of every key each time."""
    source = f"{sf}/translation_items.parquet"
    key = (spark.sparkContext.applicationId, source, _version(spark, source))
    if built(spark, key) is None:
        path = scratch(spark, "items")
        build_items(spark, sf).write.parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def build_items(spark: SparkSession, sf: str) -> DataFrame:
    t = latest(table(spark, sf, "translation_items"), ["fact_id"], "loaded_at")
    path = F.translate("location_path", "\\", "/")
    file = F.regexp_extract(path, r"([^/]+\.(?:json|js))", 1)
    domain = (
        F.when(F.lower(file) == "plugins.js", "plugin_config")
        .when(path.contains("/note/"), "note_tags")
        .when(file == "System.json", "nonstandard_data")
        .when(F.lower(file).rlike(r"^(map[0-9]+|commonevents|troops)\.json$"), "event_commands")
        .otherwise("standard_data")
    )
    return t.select(
        "*", path.alias("path"), file.alias("source_file"), domain.alias("domain"), F.coalesce(F.array_join("original_lines", "\n"), F.lit("")).alias("raw_text"),
        F.coalesce(F.array_join("translation_lines", "\n"), F.lit("")).alias("answer"), F.coalesce("role", F.lit("")).alias("speaker"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("game_id", "fact_id", "location_path", "domain", "source_file", "item_type", "speaker", "raw_text", F.col("source_fact_raw_hash").alias("raw_hash"), F.col("source_fact_translatable_hash").alias("translatable_hash"))


def index(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy("game_id", "location_path").agg(F.bool_or(F.coalesce(F.size("source_line_paths"), F.lit(0)) > 0).alias("writable"))


def translations(spark: SparkSession, sf: str) -> DataFrame:
    late = F.col("loaded_at") > F.col("saved_at") + F.expr("interval 1 day")
    t = items(spark, sf).where(F.length(F.trim("answer")) > 0)
    return t.select("game_id", "fact_id", "location_path", "answer", F.when(late, F.sha2("source_fact_raw_hash", 256)).otherwise(F.col("source_fact_raw_hash")).alias("raw_hash"), F.col("source_fact_translatable_hash").alias("translatable_hash"))


def errors(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.length(F.trim("answer")) == 0, "empty").when(F.col("answer") == F.col("raw_text"), "copy").when(F.col("answer").startswith("译文"), "explained")
    return items(spark, sf).select((F.col("game_id") % 10).alias("run_id"), "fact_id", "location_path", kind.alias("error_type")).where("error_type is not null")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy((F.col("game_id") % 10).alias("run_id")).agg(F.max("saved_at").alias("started_at"), F.count("*").alias("total"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    f = F.coalesce
    extractable = F.length(F.trim("raw_text")) > 0
    return items(spark, sf).select("game_id", "domain", F.col("item_type").alias("rule_key"), "location_path", extractable.alias("extractable"), (f(F.size("source_line_paths"), F.lit(0)) > 0).alias("writable"))


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of three domains: selectors of scripts, tags of notes, and command texts by file."""
    selectors = table(spark, sf, "plugin_source_candidates").select("file_id", "selector", "active").distinct().select(F.lit("plugin_source").alias("domain"), F.concat_ws("|", F.col("file_id").cast("string"), "selector").alias("rule_id"), F.col("active").alias("enabled"))
    tags = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(NOTE_TAG), F.lit(1))).alias("tag")).distinct().select(F.lit("note_tags").alias("domain"), F.col("tag").alias("rule_id"), (F.col("tag") != "pad").alias("enabled"))
    commands = items(spark, sf).where("domain = 'event_commands'").select("item_type", "source_file").distinct().select(F.lit("event_commands").alias("domain"), F.concat_ws("|", "source_file", "item_type").alias("rule_id"), (F.col("item_type") != "array").alias("enabled"))
    return selectors.unionByName(tags).unionByName(commands)


#: The same relations for the SQL side, to be put in front of a query.
VIEWS = {
    "items": r"""select *, replace(location_path,'\','/') as path, regexp_extract(replace(location_path,'\','/'),'([^/]+\.(?:json|js))',1) as source_file,
 case when lower(regexp_extract(replace(location_path,'\','/'),'([^/]+\.(?:json|js))',1))='plugins.js' then 'plugin_config'
 when contains(replace(location_path,'\','/'),'/note/') then 'note_tags'
 when regexp_extract(replace(location_path,'\','/'),'([^/]+\.(?:json|js))',1)='System.json' then 'nonstandard_data'
 when regexp_matches(lower(regexp_extract(replace(location_path,'\','/'),'([^/]+\.(?:json|js))',1)),'^(map[0-9]+|commonevents|troops)\.json$') then 'event_commands'
 else 'standard_data' end as domain, coalesce(array_to_string(original_lines,chr(10)),'') as raw_text, coalesce(array_to_string(translation_lines,chr(10)),'') as answer, coalesce(role,'') as speaker
 from translation_items qualify row_number() over (partition by fact_id order by loaded_at desc nulls last)=1""",
    "facts": "select game_id,fact_id,location_path,domain,source_file,item_type,speaker,raw_text,source_fact_raw_hash as raw_hash,source_fact_translatable_hash as translatable_hash from items",
    "idx": "select game_id,location_path,bool_or(coalesce(len(source_line_paths),0)>0) as writable from items group by all",
    "tr": "select game_id,fact_id,location_path,answer,case when loaded_at>saved_at+interval 1 day then sha256(source_fact_raw_hash) else source_fact_raw_hash end as raw_hash,source_fact_translatable_hash as translatable_hash from items where length(trim(answer,' '))>0",
    "errors": "select * from (select game_id%10 as run_id,fact_id,location_path,case when length(trim(answer,' '))=0 then 'empty' when answer=raw_text then 'copy' when starts_with(answer,'译文') then 'explained' end as error_type from items) where error_type is not null",
    "runs": "select game_id%10 as run_id,max(saved_at) as started_at,count(*) as total from items group by 1",
    "hits": "select game_id,domain,item_type as rule_key,location_path,length(trim(raw_text,' '))>0 as extractable,coalesce(len(source_line_paths),0)>0 as writable from items",
}


def sql(query: str) -> str:
    """A query over the views above as one statement."""
    import re

    names = list(VIEWS)
    used: set[str] = set()
    todo = [n for n in names if re.search(rf"\b{n}\b", query)]
    while todo:
        n = todo.pop()
        if n not in used:
            used.add(n)
            todo += [m for m in names if re.search(rf"\b(from|join) {m}\b", VIEWS[n])]
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names if n in used) + "\n" + query if used else query
