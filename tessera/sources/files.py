"""Sources and sinks of project files: JSON trees, the plugin list, scripts, manifests, versioned tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.functions.text import glob_regex
from tessera.rules.validate import DOMAINS

#: Standard data files besides the maps (fixed values).
STANDARD = ["Actors", "Animations", "Armors", "Classes", "CommonEvents", "Enemies", "Items", "MapInfos", "Skills", "States", "System", "Tilesets", "Troops", "Weapons"]


#: Where a project keeps what its files were before anything was translated (fixed values).
ORIGIN = {"data": "data_origin", "plugins": "plugins_source_origin", "list": "plugins_origin.js"}

_PLACE = r"^(?:.*/)?((?!www/)[^/]+)/(www/)?(data|data_origin|js|js/plugins|js/plugins_source_origin)/([^/]+)$"


def whole_files(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Every file as one row: path, file_name, text."""
    path = F.col("_metadata.file_path")
    return spark.read.text(pattern, wholetext=True).select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), F.col("value").alias("text"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of every project folder under ``root`` that are read from: project, kind (data, plugins, list),
    file_name, text. ``www`` is the content root of a project that has both ``www/data`` and ``www/js``; a backup of the
    untranslated files takes the place of the files themselves."""
    at = lambda k: F.regexp_extract("path", _PLACE, k)
    every = spark.read.option("pathGlobFilter", "*.js*").option("recursiveFileLookup", True).text(root, wholetext=True)
    rows = every.select(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text")).where(at(1) != "")
    rows = rows.select(at(1).alias("project"), (at(2) != "").alias("www"), at(3).alias("folder"), at(4).alias("file_name"), "text")
    kind = (
        F.when(F.col("folder").isin("data", ORIGIN["data"]), "data").when(F.col("folder").isin("js/plugins", f"js/{ORIGIN['plugins']}"), "plugins")
        .when((F.col("folder") == "js") & F.col("file_name").isin("plugins.js", ORIGIN["list"]), "list")
    )
    origin = F.col("folder").isin(ORIGIN["data"], f"js/{ORIGIN['plugins']}") | (F.col("file_name") == ORIGIN["list"])
    rows = rows.withColumn("kind", kind).withColumn("origin", origin)
    # one row a project and kind decides where it is read from
    roots = rows.groupBy("project").agg((F.bool_or(F.col("www") & F.col("folder").startswith("data")) & F.bool_or(F.col("www") & F.col("folder").startswith("js"))).alias("use_www"))
    here = rows.join(roots, "project").where("www = use_www and kind is not null")
    backed = here.groupBy("project", "kind").agg(F.bool_or("origin").alias("use_origin"))
    return here.join(backed, ["project", "kind"]).where("origin = use_origin").select("project", "kind", "file_name", "text")


def standard_files(files: DataFrame) -> DataFrame:
    """The standard data files and maps of projects (see ``project_files``)."""
    return files.where("kind = 'data'").where(F.col("file_name").rlike(rf"^(?:(?:{'|'.join(STANDARD)})|Map[0-9]+)\.json$"))


def nonstandard_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The data files that rules ``(project, file_name, skipped, paths)`` name, but for skipped rules and those
    without paths."""
    named = rules.where("not skipped and size(paths) > 0").select("project", "file_name").distinct()
    return files.where("kind = 'data'").join(named, ["project", "file_name"], "left_semi")


def plugins(files: DataFrame) -> DataFrame:
    """The entries of each project's ``var $plugins = [...]``: project, pos, name, enabled, parameters."""
    array = F.regexp_extract("text", r"(?s)\$plugins\s*=\s*(\[.*\])\s*;?", 1)
    rows = files.where("kind = 'list'").select("project", F.posexplode(F.from_json(array, "array<struct<name:string,status:boolean,description:string,parameters:map<string,string>>>")).alias("pos", "p"))
    return rows.select("project", "pos", F.col("p.name").alias("name"), F.col("p.status").alias("enabled"), F.col("p.parameters").alias("parameters"))


def plugin_sources(files: DataFrame) -> DataFrame:
    """The scripts of enabled plugins."""
    on = plugins(files).where("enabled").select("project", F.concat("name", F.lit(".js")).alias("file_name")).distinct()
    return files.where("kind = 'plugins'").join(on, ["project", "file_name"], "left_semi")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Every row ``(path, text)`` as a file under ``root``, written by the tasks that hold them; returns path and
    bytes of each. A file is written whole under another name and then moved, so a task that runs again harms nothing."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        local = root.startswith(("file:", "/"))
        fs, base = (pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if local else pafs.FileSystem.from_uri(root)
        for b in batches:
            done = []
            for path, text in zip(b["path"], b["text"], strict=True):
                whole, data = f"{base}/{path}", text.encode()
                fs.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                part = f"{whole}.{uuid.uuid4().hex}.new"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, whole)
                done.append((path, len(data)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return rows.where("path is not null and text is not null").select("path", "text").mapInPandas(step, "path string, bytes long")


def snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, sha256 and size of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def report_summary(rows: DataFrame, path: str, order: list[str], samples: int = 20) -> None:
    """A report: how many rows there are, the first ``samples`` of them, and all of them as JSON lines beside."""
    whole = rows.withColumn("_n", F.lit(1))
    first = rows.orderBy(*order).limit(samples).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in [*order, *[c for c in rows.columns if c not in order]]]))).alias("samples"))
    total = whole.agg(F.count("*").alias("total")).select(F.lit(1).alias("one"), "total").join(first.select(F.lit(1).alias("one"), "samples"), "one").drop("one")
    total.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    report(rows, f"{path}/details")


def leaves(files: DataFrame, into_strings: bool = False) -> DataFrame:
    """The leaf relation of JSON files."""
    return J.leaves(files, "file_name", "text", into_strings)


def note_sources(files: DataFrame, pattern: str = "*", key: str = "file_name") -> DataFrame:
    """The notes of JSON files whose name fits ``pattern`` (``*`` globs), however deep: key, path, value. Empty ones
    and those within a note are none."""
    named = files.where(F.col("file_name").rlike(glob_regex(pattern)))
    return J.leaves(named, key, "text").where(F.col("path").rlike(r"\['note'\]$") & (F.col("value_type") == "string") & (F.col("value") != "")).where(~F.col("path").rlike(r"\['note'\]."))


#: Fields of the standard files that players see (fixed values).
VISIBLE = {
    "Actors.json": ["name", "nickname", "profile"], "Armors.json": ["name", "description"], "Classes.json": ["name"], "Enemies.json": ["name"], "Items.json": ["name", "description"],
    "Skills.json": ["name", "description", "message1", "message2"], "States.json": ["name", "message1", "message2", "message3", "message4"], "Weapons.json": ["name", "description"],
}
_SYSTEM = r"^\$\['gameTitle'\]$|^\$\['terms'\]\['(?:basic|commands|params)'\]\[[0-9]+\]$|^\$\['terms'\]\['messages'\]\['[^\]]*'\]$|^\$\['(?:elements|skillTypes|weaponTypes|armorTypes|equipTypes)'\]\[[0-9]+\]$"


def visible_texts(files: DataFrame, key: Column) -> DataFrame:
    """What players see in the database, system and map files, by the fields that are shown: key, file_name, path,
    value. Resource names, formulas and scripts are left out."""
    keyed = files.withColumn("_k", F.to_json(F.struct(key.alias("k"), "file_name")))
    at = J.leaves(keyed, "_k", "text").where("value_type = 'string'").select(F.get_json_object("key", "$.k").alias("key"), F.get_json_object("key", "$.file_name").alias("file_name"), "path", "value")
    shown = (F.col("file_name") == "System.json") & F.col("path").rlike(_SYSTEM)
    for name, fields in VISIBLE.items():
        shown = shown | ((F.col("file_name") == name) & F.col("path").rlike(rf"^\$\[[0-9]+\]\['(?:{'|'.join(fields)})'\]$"))
    shown = shown | (F.col("file_name").rlike(r"^Map[0-9]+\.json$") & (F.col("path") == "$['displayName']"))
    return at.where(shown & (F.trim("value") != ""))


def _is_table(fs, file) -> bool:
    """Whether a file begins as a table does."""
    if file.getLen() < 12:
        return False
    stream = fs.open(file.getPath())
    try:
        return bytes(stream.read() for _ in range(4)) == b"PAR1"
    finally:
        stream.close()


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The games that have a table folder under ``root``: game, and why it can't be read (null if it can)."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for entry in fs.listStatus(base):  # one folder a game
        problem = None if entry.isDirectory() else "no_folder"
        if entry.isDirectory():
            tables = [f for f in fs.listStatus(entry.getPath()) if f.getPath().getName().endswith(".parquet")]
            if not tables or not all(_is_table(fs, f) for f in tables):
                problem = "unreadable"
        rows.append((entry.getPath().getName(), problem))
    return spark.createDataFrame(rows, "game string, problem string")


def rules_of(rules: DataFrame, domain: str) -> DataFrame:
    """The enabled rules of a domain in order."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown rule domain {domain}")
    return rules.where((F.col("domain") == domain) & F.col("enabled")).orderBy("rule_order", "rule_id")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """External JSON in a fixed schema; anything else is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def replace_tables(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables of a scope into a new version folder, then move the pointer, so readers see all or none."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_current")
    return version


def current_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version the pointer names; versions never change once written."""
    version = spark.read.parquet(f"{root}/_current").head()["version"]
    return spark.read.parquet(f"{root}/{version}/{name}")


def append_run(df: DataFrame, path: str) -> None:
    """Run records, failures and quality errors, partitioned by run."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def replace_runs(spark: SparkSession, df: DataFrame, path: str) -> None:
    """The runs of ``df`` in place of what is stored of them, other runs untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def replace_files(contents: dict[str, str], backup: str) -> None:
    """New contents in place of files (on the driver's machine, where projects lie): each old file is kept under
    ``backup``; if any write fails, all files are put back as they were."""
    os.makedirs(backup, exist_ok=True)
    done: list[tuple[str, str | None]] = []
    try:
        for n, (path, text) in enumerate(contents.items()):
            kept = None
            if os.path.exists(path):
                kept = os.path.join(backup, f"{n}-{os.path.basename(path)}")
                with open(path, "rb") as old, open(kept, "wb") as new:
                    new.write(old.read())
            done.append((path, kept))
            with open(f"{path}.new", "w", encoding="utf-8", newline="") as f:
                f.write(text)
            os.replace(f"{path}.new", path)
    except OSError:
        for path, kept in reversed(done):
            if kept:
                os.replace(kept, path)
            elif os.path.exists(path):
                os.remove(path)
        raise


def clear_runs(spark: SparkSession, schema, path: str) -> None:
    """Starting a run clears what earlier runs reported."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
