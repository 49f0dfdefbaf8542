"""Names against a gazetteer: resolution, duplicates, order, parties."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirelake.functions.text import NAME_BLANKS, trim_name
from quirelake.functions.treaty import label_party, party_key

#: Fixed value: the kind of gazetteer records whose names resolve.
MEMBER = "member-state"

#: A gazetteer index of at most this many spellings is broadcast; a larger one is joined by sort-merge.
INDEX_ROWS = 200_000

#: The keys of an index of at most this many, such as the states of the world, are looked up without a join.
INDEX_LITERALS = 1_000


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    """Compatibility forms composed; there is no built-in function for it."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.arrow_udf(StringType())
def _nfkc_each(arrays: pa.Array) -> pa.Array:
    """The same for arrays in JSON: Spark sizes a batch of lists anew for each of its rows."""
    if arrays.null_count == len(arrays):
        return arrays
    return pa.array([a and json.dumps([x and unicodedata.normalize("NFKC", x) for x in json.loads(a)]) for a in arrays.to_pylist()], arrays.type)


def _key(composed: Column) -> Column:
    straight = F.translate(composed, "’‘", "''")
    blanks = F.translate(straight, NAME_BLANKS, " " * len(NAME_BLANKS))
    return F.lower(F.trim(F.regexp_replace(blanks, " +", " ")))


def name_key(value: Column) -> Column:
    """Lookup key: compatibility forms composed, straight apostrophes, blanks folded, lower case."""
    return _key(_nfkc(value))


def with_name_keys(df: DataFrame, names: str, keys: str) -> DataFrame:
    """df with the lookup keys of an array of names. Names of ASCII alone are their own compatibility forms: rows without
    others send nothing to Python."""
    odd = lambda x: F.octet_length(x) > F.length(x)
    df = df.withColumn("_odd", F.coalesce(odd(F.array_join(names, "")), F.lit(False)))
    others = F.to_json(F.transform(names, lambda x: F.when(odd(x), x)))
    df = df.withColumn("_forms", F.from_json(_nfkc_each(F.when(F.col("_odd"), others)), "array<string>"))
    # a blank alone stays as it is
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, "[\\t-\\r ]{2,}|[\\t-\\r]", " ")))
    mixed = F.transform(names, lambda x, i: F.when(odd(x), _key(F.get("_forms", i))).otherwise(plain(x)))
    return df.withColumn(keys, F.when(F.col("_odd"), mixed).otherwise(F.transform(names, plain))).drop("_odd", "_forms")


def name_index(gazetteer: DataFrame, spellings: list[str]) -> DataFrame:
    """key, id, display and kind for each distinct spelling; `ids` counts the records that share a key.

    gazetteer: id, display, the columns of spellings (strings or arrays), and kind (all member states where absent).
    """
    array = F.flatten(F.array(*[F.col(c) if dict(gazetteer.dtypes)[c].startswith("array") else F.array(c) for c in spellings]))
    kind = F.col("kind") if "kind" in gazetteer.columns else F.lit(MEMBER)
    rows = gazetteer.select("id", "display", kind.alias("kind"), F.explode_outer(array).alias("spelling")).where("spelling is not null")
    rows = rows.select(name_key(F.col("spelling")).alias("key"), "id", "display", "kind").distinct()
    return rows.groupBy("key").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("id"), F.min("display").alias("display"), F.min("kind").alias("kind"))


def bounded(table: DataFrame, rows: int = INDEX_ROWS) -> DataFrame:
    """The table with a join hint: broadcast if it has at most so many rows, else sort-merge."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def resolve_names(names: DataFrame, index: DataFrame, value: str = "name", review: DataFrame | None = None, formal: list[str] | None = None) -> DataFrame:
    """names with status, id and display; only resolved ones get an id.

    status: the review list's (key, listed), else ambiguous (several records), unknown (none), resolved (a member state)
    or entity. Names are looked up once per distinct value. formal: columns of the index with spellings that stay as
    they are although their record has another display.
    """
    own = names.select(value).distinct().withColumn("key", name_key(F.col(value)))
    df = own.join(bounded(index), "key", "left")
    status = F.when(F.col("ids") > 1, "ambiguous").when(F.col("ids").isNull(), "unknown").when(F.col("kind") == MEMBER, "resolved").otherwise("entity")
    if review is not None:
        df = df.join(bounded(review), "key", "left")
        status = F.coalesce("listed", status)
    df = df.withColumn("status", status)
    ok = F.col("status") == "resolved"
    kept = F.lit(False)
    for c in formal or []:
        kept = kept | F.coalesce(F.col(value) == F.col(c), F.lit(False))
    df = df.select(value, "status", F.when(ok, F.col("id")).alias("id"), F.when(ok, F.when(kept, F.col(value)).otherwise(F.col("display"))).alias("display"))
    back = names.withColumn("_v", F.col(value)).join(df.withColumnRenamed(value, "_w").hint("merge"), F.col("_v").eqNullSafe(F.col("_w")), "left")
    return back.drop("_v", "_w")


def dedupe_names(resolved: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each id; unresolved rows (null id) all stay."""
    w = Window.partitionBy(*keys, "id").orderBy(pos)
    return resolved.withColumn("_n", F.when(F.col("id").isNotNull(), F.row_number().over(w)).otherwise(1)).where("_n = 1").drop("_n")


def sort_names(resolved: DataFrame, keys: list[str], sort_key: str, pos: str, display: str) -> DataFrame:
    """One row per key with the displays in the order of their sort keys; equal ones keep their order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(sort_key).alias("k"), F.col(pos).alias("p"), F.col(display).alias("d"))))
    return resolved.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x.d), ", ").alias("names"))


def missing_fields(models: DataFrame, required: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field) of required fields without a value. required: doc_type, field. Row by row but for the small table."""
    filled = F.filter(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    have = models.select("doc_id", "doc_type", filled.alias("_have"))
    wanted = have.join(bounded(required.select("doc_type", "field").distinct()), "doc_type")
    return wanted.where(~F.array_contains("_have", F.col("field"))).select("doc_id", "field")


def match_parties(parties: DataFrame, entries: DataFrame, keys: list[str], name: str, pos: str, language: str = "en") -> DataFrame:
    """Each party with its n-th unused entry of the same party key, in party order; entries without a party follow.

    Both sides hold `name` (a party, or an entry's label) and `pos`. Result: keys, party, label, party_pos, entry_pos.
    """
    nth = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_p")))
    p = nth(parties.select(*keys, F.col(name).alias("party"), F.col(pos).alias("_p"), party_key(F.col(name)).alias("_k"))).withColumnRenamed("_p", "party_pos")
    e = nth(entries.select(*keys, F.col(name).alias("label"), F.col(pos).alias("_p"), party_key(label_party(F.col(name), language)).alias("_k"))).withColumnRenamed("_p", "entry_pos")
    return p.join(e.hint("merge"), [*keys, "_k", "_n"], "full_outer").drop("_n", "_k")


def nearest_candidates(names: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """The label of the block whose centre is nearest to each name's, the earlier column on ties. Blocks are small."""
    both = names.join(labels.hint("merge"), keys).withColumn("distance", F.abs(F.col("name_at") - F.col("label_at")))
    w = Window.partitionBy(*keys, "name_id").orderBy("distance", "label_id")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ordered_columns(names: Column, labels: Column) -> Column:
    """For each name the column (from 0) of its label, so that names keep their order and distances sum up to the least.

    names and labels: centres (array<double>) of one block from left to right. A dynamic program over both: for each
    name and column the cheapest way to set the names so far at or before that column; of equal ways the one with the
    earlier columns. Null where there are more names than labels or a centre is null.
    """
    way = "struct<cost:double,picks:array<int>>"
    begin = F.transform(labels, lambda _: F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("picks")).cast(way))

    def place(ways: Column, name: Column) -> Column:
        """ways[c]: the cheapest way with the names before at columns before c + 1 (null if there is none)."""

        def column(acc: Column, c: Column) -> Column:
            # the names before end left of c: the way of c - 1; for the first name nothing stands before
            before = F.when(F.size(F.get(ways, 0).picks) == 0, F.get(ways, 0)).otherwise(F.when(c > 0, F.get(ways, c - 1)))
            here = F.when(before.isNotNull(), F.struct((before.cost + F.abs(F.get(labels, c) - name)).alias("cost"), F.concat(before.picks, F.array(c)).alias("picks")).cast(way))
            left = F.when(c > 0, F.get(acc, c - 1))
            return F.concat(acc, F.array(F.when(left.isNull() | (here.cost < left.cost), here).otherwise(left)))

        return F.aggregate(F.sequence(F.lit(0), F.size(labels) - 1), F.array().cast(f"array<{way}>"), column)

    fits = (F.size(names) <= F.size(labels)) & (F.size(names) > 0) & ~F.exists(names, lambda x: x.isNull()) & ~F.exists(labels, lambda x: x.isNull())
    return F.when(fits, F.element_at(F.aggregate(names, begin, place), -1).picks)


def ordered_candidates(names: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Each name of a block with its label under `ordered_columns`: keys, name_id, label_id, distance.

    names: keys, name_id, name_at; labels: keys, label_id, label_at. Both are taken from left to right (then by id).
    Blocks with more names than labels give nothing. A block is the few names and labels at a paper's end.
    """
    side = lambda df, at, one: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col(one).alias("id")))).alias(f"_{one}"))
    both = side(names, "name_at", "name_id").join(side(labels, "label_at", "label_id").hint("merge"), keys)
    centres = lambda c: F.transform(c, lambda x: x.at)
    both = both.withColumn("_to", ordered_columns(centres(F.col("_name_id")), centres(F.col("_label_id")))).where("_to is not null")
    rows = both.select(*keys, "_name_id", "_label_id", F.posexplode_outer("_to").alias("_i", "_c")).where("_c is not null")
    n, m = F.get("_name_id", F.col("_i")), F.get("_label_id", F.col("_c"))
    return rows.select(*keys, n["id"].alias("name_id"), m["id"].alias("label_id"), F.abs(n["at"] - m["at"]).alias("distance"))


def sort_key(value: Column, language: str, phrases: dict[str, str] | None = None, chars: dict[str, str] | None = None) -> Column:
    """Array to order names by: lower case, or for zh the reading of each longest listed phrase or character.

    phrases and chars: readings, syllables of a phrase divided by blanks. Both are bounded policy tables.
    """
    if language != "zh":
        return F.array(F.lower(value))
    phrases, chars = phrases or {}, chars or {}
    readings = F.create_map(*[F.lit(x) for kv in (chars | phrases).items() for x in kv]) if chars or phrases else F.create_map().cast("map<string,string>")
    longest = "|".join(sorted(map(re.escape, phrases), key=len, reverse=True))
    pieces = F.regexp_extract_all(value, F.lit(f"(?s)({longest}|.)" if longest else "(?s)(.)"), F.lit(1))
    return F.flatten(F.transform(pieces, lambda x: F.split(F.coalesce(F.try_element_at(readings, x), F.lower(x)), " ")))


def plan_names(values: DataFrame, index: DataFrame, keys: list[str], pos: str, key: Column, review: DataFrame | None = None, preserve: bool = False) -> DataFrame:
    """One row per list: names in order, changed and removed counts. values: keys, pos, name.

    Unresolved names keep their input; of a resolved record the first stays. key: sort key over `display` (their sort
    name); preserve keeps the source order.
    """
    done = resolve_names(values.where(trim_name(F.col("name")) != ""), index, "name", review).withColumn("display", F.coalesce("display", "name"))
    firsts = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(pos))
    done = done.withColumn("_keep", F.col("id").isNull() | (firsts == 1)).withColumn("_key", key)
    order = F.struct(F.col(pos).alias("p"), F.col("display").alias("d")) if preserve else F.struct(F.col("_key").alias("k"), F.col(pos).alias("p"), F.col("display").alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_keep"), order))), lambda x: x.d)
    return done.groupBy(*keys).agg(listed.alias("names"), F.count_if(F.col("_keep") & (F.col("display") != F.col("name"))).alias("changed"), F.count_if(~F.col("_keep")).alias("removed"))


#: Why a name is left to a person.
REASONS = {"ambiguous": "称呼有歧义", "historical": "历史国家或历史名称", "entity": "组织、观察员或其他非会员国实体", "unknown": "资料表未确认的名称"}


def name_warnings(resolved: DataFrame, keys: list[str], pos: str, name: str = "name") -> DataFrame:
    """One row per list and distinct unresolved name, in the order of its first place, with status and reason."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    open_ = resolved.where("status <> 'resolved'").groupBy(*keys, name, "status").agg(F.min(pos).alias(pos))
    return open_.withColumn("reason", F.element_at(reason, F.col("status")))


def name_list_audit(before: DataFrame, after: DataFrame, index: DataFrame, keys: list[str], pos: str, key: Column, review: DataFrame | None = None, preserve: bool = False) -> DataFrame:
    """Findings (keys, code, name) where lists of names are not what the plan makes of the original ones.

    The plan is derived anew from `before` (keys, pos, name) by plan_names and compared with `after` as multisets and then
    in order, blanks aside. Codes: missing-name, added-name, doubled-name, re-ordered (with the first name out of place).
    """
    squash = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    planned = plan_names(before, index, keys, pos, key, review, preserve).select(*keys, "names")
    found = after.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "name"))), lambda x: x["name"]).alias("_found"))
    both = planned.join(found.hint("merge"), keys, "full_outer")
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), squash)
    both = both.select(*keys, names(F.col("names")).alias("_want"), names(F.col("_found")).alias("_have"))
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    each = F.transform(F.array_union("_want", "_have"), lambda x: F.struct(F.when(count(F.col("_have"), x) < count(F.col("_want"), x), "missing-name").when(count(F.col("_have"), x) > count(F.col("_want"), x), F.when(count(F.col("_want"), x) == 0, "added-name").otherwise("doubled-name")).alias("code"), x.alias("name")))
    wrong = F.filter(each, lambda x: x.code.isNotNull())
    moved = F.get(F.filter(F.zip_with("_want", "_have", lambda a, b: F.when(~a.eqNullSafe(b), b)), lambda x: x.isNotNull()), 0)
    order = F.when((F.size(wrong) == 0) & moved.isNotNull(), F.array(F.struct(F.lit("re-ordered").alias("code"), moved.alias("name")))).otherwise(F.array().cast("array<struct<code:string,name:string>>"))
    return both.select(*keys, F.explode_outer(F.concat(wrong, order)).alias("_x")).where("_x is not null").select(*keys, "_x.*")
