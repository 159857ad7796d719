"""Names replaced by their terms throughout a project's data files: which leaf takes which translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that hold names, and the category of terms each belongs to (fixed values).
FIELDS = [
    ("Actors.json", "name", "actor_names"), ("Actors.json", "nickname", "actor_nicknames"), ("Classes.json", "name", "class_names"), ("Skills.json", "name", "skill_names"), ("Items.json", "name", "item_names"),
    ("Weapons.json", "name", "weapon_names"), ("Armors.json", "name", "armor_names"), ("Enemies.json", "name", "enemy_names"), ("States.json", "name", "state_names"),
]
SYSTEM = [("elements", "system_elements"), ("skillTypes", "system_skill_types"), ("weaponTypes", "system_weapon_types"), ("armorTypes", "system_armor_types"), ("equipTypes", "system_equip_types")]
#: The command that opens a message, and where it names its speaker (fixed values).
SPEAKER_CODE, SPEAKER_PARAMETER = "101", r"\['parameters'\]\[4\]$"


def category(file_name: Column, path: Column) -> Column:
    """The category of the names at a place, or null where it holds none (speakers aside, see ``edits``)."""
    out = F.when(file_name.rlike(r"^Map[0-9]+\.json$") & (path == "$['displayName']"), "map_display_names")
    for name, key, kind in FIELDS:
        out = out.when((file_name == name) & path.rlike(rf"^\$\[[0-9]+\]\['{key}'\]$"), kind)
    for key, kind in SYSTEM:
        out = out.when((file_name == "System.json") & path.rlike(rf"^\$\['{key}'\]\[[0-9]+\]$"), kind)
    return out


def edits(leaves: DataFrame, terms: DataFrame, scope: list[str]) -> DataFrame:
    """The edits that write ``terms`` (scope columns, category, source, translated) into leaves (scope columns,
    key, file_name, path, value): scope columns, key, path, value, new. Names meet terms trimmed; of several translations
    of one source the least counts. Speakers are those of message commands in maps, common events and troops."""
    told = leaves.where(F.col("file_name").rlike(r"^(?:Map[0-9]+|CommonEvents|Troops)\.json$"))
    opens = told.where((F.col("value") == SPEAKER_CODE) & F.col("path").rlike(r"\['code'\]$")).select("key", F.regexp_replace("path", r"\['code'\]$", "").alias("_command")).distinct()
    speakers = told.where(F.col("path").rlike(SPEAKER_PARAMETER)).withColumn("_command", F.regexp_replace("path", SPEAKER_PARAMETER, "")).join(opens, ["key", "_command"], "left_semi").drop("_command")
    named = leaves.withColumn("category", category(F.col("file_name"), F.col("path"))).where("category is not null").unionByName(speakers.withColumn("category", F.lit("speaker_names")))
    one = terms.groupBy(*scope, "category", F.trim("source").alias("source")).agg(F.min("translated").alias("new"))
    return named.withColumn("source", F.trim("value")).join(one, [*scope, "category", "source"]).select(*scope, "key", "path", "value", "new")
