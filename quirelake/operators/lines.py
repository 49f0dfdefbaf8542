"""Edits that create or remove lines: where a paper's blank lines belong, signing lines, and how such edits are applied.

An edit names the line it stands behind (at_idx, -1: before the first) and its place among the lines created there
(nth), so order keys of new lines lie between those of old ones and all edits apply in one pass; lines are then
numbered anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles of header and body lines.
HEADER = ("title", "committee", "topic", "country", "delegate", "sponsors", "signatories", "header")
TITLE_BLOCK = ("title", "committee", "topic")
BODY = ("preamble", "item", "prose", "reference")

EDIT = "doc_id, at_idx, nth, kind, text"


@dataclass(frozen=True)
class BlankRules:
    """Which lines one blank line follows: the last line of these roles (title_block and header stand for several; of
    sponsors and signatories every line), the one before the first operative line, and those between body lines other
    than items and references of one kind."""

    after: tuple[str, ...] = ()
    before_operative: bool = False
    between_prose: bool = False
    every: tuple[str, ...] = field(default=("sponsors", "signatories"))


def blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def blank_lines(p: DataFrame, rules: BlankRules) -> DataFrame:
    """p (doc_id, idx, text, role, operative, optional protected) with `island`: the index of the last line with text
    (-1: none yet), `place`: a blank line's place behind it, and `wanted`: whether a blank line belongs behind it.

    Blank lines that are protected (list members, marked or hidden content) count as text.
    """
    kept = F.coalesce(F.col("protected"), F.lit(False)) if "protected" in p.columns else F.lit(False)
    order = Window.partitionBy("doc_id").orderBy("idx")
    whole = Window.partitionBy("doc_id")
    p = p.withColumn("_live", ~blank(F.col("text")) | kept)
    live = lambda condition: F.col("_live") & ~blank(F.col("text")) & F.coalesce(condition, F.lit(False))
    wanted = F.lit(False)
    for role in rules.after:
        one = F.col("role").isin(*{"title_block": TITLE_BLOCK, "header": HEADER}.get(role, (role,)))
        if role in rules.every:
            wanted = wanted | live(one)
        else:
            wanted = wanted | (F.col("idx") == F.max(F.when(live(one), F.col("idx"))).over(whole))
    texts = p.where("_live").withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    if rules.before_operative:
        first = F.min(F.when(live(F.col("operative") & F.col("role").isin("item", "prose")), F.col("idx"))).over(whole)
        texts = texts.withColumn("_wanted", F.col("_wanted") | F.coalesce(F.lead("idx").over(order) == first, F.lit(False)))
    if rules.between_prose:
        body = live(F.col("role").isin(*BODY, "part"))
        texts = texts.withColumn("_body", F.coalesce(body, F.lit(False)))
        within = Window.partitionBy("doc_id", "_body").orderBy("idx")
        following = F.lead("role").over(within)
        alike = (F.col("role") == following) & F.col("role").isin("item", "reference")
        texts = texts.withColumn("_wanted", F.col("_wanted") | (F.col("_body") & F.coalesce(following.isNotNull() & ~alike, F.lit(False))))
    flags = texts.select("doc_id", "idx", "_wanted").hint("merge")
    p = p.join(flags, ["doc_id", "idx"], "left")
    p = p.withColumn("island", F.coalesce(F.last(F.when(F.col("_live"), F.col("idx")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(-1)))
    group = Window.partitionBy("doc_id", "island")
    p = p.withColumn("place", F.when(~F.col("_live"), F.row_number().over(Window.partitionBy("doc_id", "island", "_live").orderBy("idx"))))
    p = p.withColumns({"wanted": F.coalesce(F.bool_or("_wanted").over(group), F.lit(False)), "_blanks": F.count_if(~F.col("_live")).over(group)})
    return p.drop("_wanted")


def plan_blank_lines(p: DataFrame, rules: BlankRules) -> DataFrame:
    """Edits (doc_id, at_idx, nth, kind, text): `blank` creates a blank line behind at_idx, `empty-line` removes line at_idx."""
    lined = blank_lines(p, rules)
    add = F.col("_live") & F.col("wanted") & (F.col("_blanks") == 0) & (F.col("idx") == F.col("island"))
    drop = ~F.col("_live") & (F.col("place") > F.col("wanted").cast("int"))
    made = lined.where(add).select("doc_id", F.col("idx").alias("at_idx"), F.lit(1).alias("nth"), F.lit("blank").alias("kind"), F.lit("").alias("text"))
    gone = lined.where(drop).select("doc_id", F.col("idx").alias("at_idx"), F.lit(0).alias("nth"), F.lit("empty-line").alias("kind"), F.lit(None).cast("string").alias("text"))
    return made.union(gone)


def blank_audit(p: DataFrame, rules: BlankRules) -> DataFrame:
    """Findings (doc_id, idx, code): missing-blank (behind idx), doubled-blank, misplaced-blank (line idx)."""
    lined = blank_lines(p, rules)
    missing = F.col("_live") & F.col("wanted") & (F.col("_blanks") == 0) & (F.col("idx") == F.col("island"))
    code = F.when(missing, "missing-blank").when(~F.col("_live") & F.col("wanted") & (F.col("place") > 1), "doubled-blank").when(~F.col("_live") & ~F.col("wanted"), "misplaced-blank")
    return lined.withColumn("code", code).where("code is not null").select("doc_id", "idx", "code")


def plan_signing_lines(p: DataFrame, kept_roles: tuple[str, ...] = ("sponsors", "signatories")) -> DataFrame:
    """Edits that put each name of a sponsors' or signatories' line on a line of its own behind its label.

    p: doc_id, idx, text, role, label (what the line keeps, null if it is a name's line already), names array<string>.
    The line keeps its label; its names follow as `signature` lines in order. Lines with a label and no names, and
    lines that hold one name and no label, stay.
    """
    listed = p.where(F.col("role").isin(*kept_roles) & (F.size("names") > 0) & (F.col("label").isNotNull() | (F.size("names") > 1)))
    head = listed.select("doc_id", F.col("idx").alias("at_idx"), F.lit(0).alias("nth"), F.lit("signature-label").alias("kind"), F.coalesce("label", F.get("names", 0)).alias("text"))
    rest = F.when(F.col("label").isNotNull(), F.col("names")).otherwise(F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))))
    lines = listed.select("doc_id", F.col("idx").alias("at_idx"), F.posexplode_outer(rest).alias("_n", "text")).where("text is not null")
    return head.union(lines.select("doc_id", "at_idx", (F.col("_n") + 1).alias("nth"), F.lit("signature").alias("kind"), "text"))


def apply_lines(p: DataFrame, edits: DataFrame) -> DataFrame:
    """p with the edits applied and idx numbered anew: removals, replacements (nth 0) and created lines, which take the
    other columns of the line they stand behind, but for a blank line's role, which is null."""
    own = edits.where("nth = 0").select("doc_id", F.col("at_idx").alias("idx"), F.col("kind").alias("_kind"), F.col("text").alias("_text")).hint("merge")
    stay = p.join(own, ["doc_id", "idx"], "left").where("_kind is null or _kind <> 'empty-line'")
    stay = stay.withColumn("text", F.coalesce("_text", "text")).withColumn("_nth", F.lit(0)).drop("_kind", "_text")
    new = edits.where("nth > 0").select("doc_id", F.col("at_idx").alias("idx"), F.col("nth").alias("_nth"), F.col("kind").alias("_kind"), F.col("text").alias("_text"))
    made = new.join(p.hint("merge"), ["doc_id", "idx"]).withColumn("text", F.col("_text"))
    if "role" in p.columns:
        made = made.withColumn("role", F.when(F.col("_kind") != "blank", F.col("role")))
    rows = stay.select(*p.columns, "_nth").unionByName(made.select(*p.columns, "_nth"))
    order = Window.partitionBy("doc_id").orderBy("idx", "_nth")
    return rows.withColumn("idx", (F.row_number().over(order) - 1).cast(dict(p.dtypes)["idx"])).drop("_nth").select(p.columns)
