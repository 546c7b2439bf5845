"""Artifacts and catalogs from JSON: a VARIANT for each artifact, and the relational views that the gates read.

Values of another type than a field asks for count as missing in the views; the schema gate reports them. Elements that
are no objects are left out, and positions are those of the raw lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .views import Views, compat_table

#: Categories of a catalog file in their order, and the entity type of each.
CATEGORIES = {"npcs": "npc", "locations": "location", "items": "item", "factions": "faction", "enemies": "enemy", "objects": "object"}


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null), or a number's type; null if the value is missing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    """Whether the value is an object; its members are not read, as they are for its kind."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def text(v: Column) -> Column:
    """The value if it is a string."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def shown(v: Column) -> Column:
    """The value as text: JSON null is None; null if it is missing."""
    return F.when(F.schema_of_variant(v) == "VOID", "None").otherwise(v.cast("string"))


def items_of(v: Column) -> Column:
    """A list's elements; null if the value is no list."""
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    """An object's members by key; null if the value is no object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """A list's elements; none if the value is no list."""
    return F.coalesce(items_of(v), F.expr("cast(array() as array<variant>)"))


def numbered(v: Column) -> Column:
    """A list's objects as structs: pos (in the raw list), k (1-based, among the objects), v."""
    placed = F.transform(elements(v), lambda x, i: F.struct(i.alias("pos"), x.alias("v")))
    return F.transform(F.filter(placed, lambda s: is_object(s["v"])), lambda s, i: F.struct(s["pos"].alias("pos"), (i + 1).alias("k"), s["v"].alias("v")))


def objects(v: Column, keys: tuple[str, ...]) -> Column:
    """A list's objects as structs of the values at keys, as text; read in one go, unlike numbered. None if the value is no list."""
    fields = ", ".join(f"{k}: string" for k in keys)
    read = F.coalesce(F.try_variant_get(v, "$", f"array<struct<{fields}>>"), F.expr(f"cast(array() as array<struct<{fields}>>)"))
    return F.array_compact(read)


def from_texts(raw: DataFrame, key: str = "quests") -> DataFrame:
    """file, ord, v of rows (file, value), a row for a file: the elements of its top list or of its list at key; else its value itself."""
    parsed = raw.select("file", F.try_parse_json("value").alias("v"))
    listed = at(F.col("v"), key)
    items = F.when(kind(F.col("v")) == "ARRAY", elements(F.col("v"))).when(kind(listed) == "ARRAY", elements(listed)).otherwise(F.array("v"))
    return parsed.where("v is not null").select("file", F.posexplode(items).alias("ord", "v"))


def read_files(spark: SparkSession, path: str, key: str = "quests") -> DataFrame:
    """file, ord, v: the elements of each file's top list or of its list at key; else the file's value itself.

    A file is one row while it is parsed; collections beyond some 100 MB a file belong in lines (read_lines)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return from_texts(raw, key)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, v: a JSON value for each line; ord is the line's place as far as ids of rows keep it."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.try_parse_json("value").alias("v"))
    return raw.where("v is not null")


def catalog(worlds: DataFrame) -> DataFrame:
    """entity_id (stripped), entity_type of the catalogs in column v; entities without a usable id are left out."""
    def entities(category: str, type_: str) -> Column:
        name = lambda s: F.regexp_replace(text(at(s["v"], "id")), r"(?U)^\s+|\s+$", "")
        return F.transform(numbered(at(F.col("v"), category)), lambda s: F.struct(name(s).alias("entity_id"), F.lit(type_).alias("entity_type")))

    one = [entities(c, t) for c, t in CATEGORIES.items()]
    return worlds.select(F.inline(F.concat(*one))).where("entity_id != ''")


def require_unique(entity: DataFrame) -> DataFrame:
    """entity, or an error if an id occurs twice."""
    twice = entity.groupBy("entity_id").count().where("count > 1").orderBy("entity_id").limit(5).collect()
    if twice:
        raise ValueError(f"ids that occur more than once in the catalog: {', '.join(r.entity_id for r in twice)}")
    return entity


def keyed(artifacts: DataFrame) -> DataFrame:
    """quest_id, ord, v of the objects, each under a name of its own: an artifact without a quest_id is called by its place (its file, where
    artifacts have one, and ord), and so are, behind their id, all but the first of those that share an id."""
    place = [c for c in ("file", "ord") if c in artifacts.columns]
    at_place = F.concat(F.lit("#"), F.concat_ws(":", *[F.col(c).cast("string") for c in place]))
    rows = artifacts.where(is_object(F.col("v"))).select(text(at(F.col("v"), "quest_id")).alias("own"), at_place.alias("place"), "v", *place)
    nth = F.row_number().over(Window.partitionBy(F.coalesce("own", "place")).orderBy(*place))
    name = F.when(F.col("own").isNull(), F.col("place")).when(F.col("nth") == 1, F.col("own")).otherwise(F.concat("own", "place"))
    return rows.withColumn("nth", nth).select(name.alias("quest_id"), F.col("ord").cast("long").alias("ord"), "v")


def from_json(artifacts: DataFrame, entity: DataFrame, compat: dict[str, tuple[str, ...]]) -> Views:
    """Views of keyed artifacts. Steps are named step_001... where they have no id; where no objective lists its
    dependencies, each depends on the one before."""
    spark = artifacts.sparkSession
    v = F.col("v")
    artifact = artifacts.select(
        "quest_id", F.coalesce(shown(at(v, "quest_type")), F.lit("unknown")).alias("quest_type"), text(at(v, "giver_npc")).alias("giver"),
        text(at(v, "start_location")).alias("start"), F.lit(0).alias("set_id"), "ord", F.transform(elements(at(v, "reusable_tags")), shown).alias("tags"),
    )
    listed = artifacts.select("quest_id", numbered(at(v, "objectives")).alias("o"))
    own = lambda s: F.try_variant_get(s["v"], "$.step_id", "string")
    named = lambda s: F.coalesce(own(s), F.lit("")) != ""
    step = lambda s: F.when(named(s), own(s)).otherwise(F.format_string("step_%03d", s["k"]))
    steps = listed.select("quest_id", F.inline(F.transform("o", lambda s: F.struct(s["pos"].cast("long").alias("pos"), step(s).alias("step_no"), named(s).alias("named"), text(at(s["v"], "action")).alias("action"), shown(at(s["v"], "action")).alias("shown"), text(at(s["v"], "target")).alias("target")))))
    given = lambda s: at(s["v"], "depends_on")
    odd = F.filter("o", lambda s: F.coalesce(~kind(given(s)).isin("ARRAY", "VOID"), F.lit(False)))
    unlisted = listed.select("quest_id", F.explode(F.transform(odd, lambda s: s["pos"].cast("long"))).alias("pos"))
    explicit = F.exists("o", lambda s: F.coalesce(kind(at(s["v"], "depends_on")) == "ARRAY", F.lit(False)))
    stated = F.flatten(F.transform("o", lambda s: F.transform(elements(at(s["v"], "depends_on")), lambda d: F.struct(s["pos"].cast("long").alias("pos"), step(s).alias("step_no"), d.cast("string").alias("dep_no"), F.lit(True).alias("explicit")))))
    chain = F.filter(F.transform("o", lambda s, i: F.struct(s["pos"].cast("long").alias("pos"), step(s).alias("step_no"), F.when(i > 0, step(F.get(F.col("o"), i - 1))).alias("dep_no"), F.lit(False).alias("explicit"))), lambda s: s["dep_no"].isNotNull())
    dependency = listed.select("quest_id", F.inline(F.when(explicit, stated).otherwise(chain)))
    reward = artifacts.select("quest_id", F.inline(F.transform(numbered(at(v, "rewards")), lambda s: F.struct(s["pos"].cast("long").alias("pos"), text(at(s["v"], "type")).alias("type"), text(at(s["v"], "value")).alias("value")))))
    return Views(artifact, steps, reward, entity, compat_table(spark, compat), "npc", "location", ("item",), dependency, unlisted)
