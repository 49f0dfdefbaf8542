"""Reference tables: a gazetteer from name and geography tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.names import bounded


def cleaned(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), r"(?i)^the ", ""))


#: Entities of the name tables that are no ordinary member states, with their number and kind.
SPECIAL = {"Holy See": ("336", "observer-state"), "State of Palestine": ("275", "observer-state"), "Cook Islands": ("184", "specialized-agency-member"), "Niue": ("570", "specialized-agency-member")}


def build_gazetteer(names: DataFrame, geography: DataFrame, previous: DataFrame | None = None, checked_on: str | None = None, strict: bool = False) -> DataFrame:
    """names (formal_en, short_en, short_zh) with the id of geography (id, name_en, name_zh): by the English short name,
    else the Chinese, else the formal one; kind (SPECIAL entities have ids of their own) and checked_on. Aliases of the
    previous table (id, aliases) are kept. strict: reading the result fails on what gazetteer_problems would report."""
    by = lambda column, alias: geography.select(cleaned(F.col(column)).alias("_k"), F.col("id").alias(alias)).where("_k is not null").dropDuplicates(["_k"])
    df = names
    for left, right, alias in (("short_en", "name_en", "_1"), ("short_zh", "name_zh", "_2"), ("formal_en", "name_en", "_3")):
        df = df.withColumn("_k", cleaned(F.col(left))).join(bounded(by(right, alias)), "_k", "left").drop("_k")
    entity, own = F.regexp_replace(F.trim("short_en"), r"\s*(?:\(the\)|\*+)\s*$", ""), lambda k: F.coalesce(*[F.when(entity == name, F.lit(value[k])) for name, value in SPECIAL.items()])
    df = df.withColumns({"id": F.coalesce(own(0), "_1", "_2", "_3"), "kind": F.coalesce(own(1), F.lit("member-state")), "checked_on": F.lit(checked_on).cast("date")})
    df = df.drop("_1", "_2", "_3").withColumn("formal_en", F.regexp_replace("formal_en", r"(?i)^the ", ""))
    if strict:
        said = F.coalesce("short_en", "formal_en", F.lit("?"))
        missing = F.col("id").isNull() | (F.coalesce("formal_en", F.lit("")) == "")
        doubled = F.count("*").over(Window.partitionBy("id")) > 1
        fault = F.when(missing, F.concat(F.lit("missing id or formal name: "), said)).when(doubled, F.concat(F.lit("id given twice: "), "id"))
        # a filter is evaluated for every row, whatever columns are read
        df = df.withColumn("_fault", fault).where(F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault")).cast("boolean")).otherwise(F.lit(True))).drop("_fault")
    return df if previous is None else df.join(previous.select("id", "aliases").hint("merge"), "id", "left")


def gazetteer_problems(gazetteer: DataFrame) -> DataFrame:
    """Records without id or formal name, and ids that occur twice."""
    missing = gazetteer.where("id is null or formal_en is null or formal_en = ''").select("id", F.lit("missing").alias("problem"))
    return missing.union(gazetteer.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem")))


def policy_tables(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(phrases: language, kind, phrase, rank; labels: field, alias, rank) of a policy JSON file.

    The file has prefixes.<language>.<kind>: [phrase] and metadata.<field>.aliases: [label].
    """
    policy = spark.read.option("multiLine", True).json(path)
    languages = {f.name: [g.name for g in f.dataType.fields] for f in policy.schema["prefixes"].dataType.fields}
    phrases = [policy.select(F.lit(lang).alias("language"), F.lit(kind).alias("kind"), F.posexplode(f"prefixes.{lang}.{kind}").alias("rank", "phrase")) for lang, kinds in languages.items() for kind in kinds]
    labels = [policy.select(F.lit(f.name).alias("field"), F.posexplode(f"metadata.`{f.name}`.aliases").alias("rank", "alias")) for f in policy.schema["metadata"].dataType.fields]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(phrases), union(labels)
