"""Deterministic damage of correct papers, for robustness tests of recognition, planning and audits.

Every choice is drawn from a hash of the operation, the seed and the row's keys, so it is the same at any partitioning,
in any order and after any retry. Words and their order stay; labels, markers, list numbers, run borders and layout go.

Paragraphs: doc_id, idx, text and what an operation names. Operations that remove rows number the rest anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of a position paper's header, the lines they may stand on, section markers and deep sub-clause markers.
LABELS = r"^\s*(?:委员会|议题|国家/席位|国家|代表)\s*[:：]\s*"
HEADER_LINES = 8
FIRST_SECTION, SECOND_SECTION = r"^\s*[（(]一[）)]", r"^\s*[（(]二[）)]"
DEEP = r"^[（(](?:[子丑寅卯辰巳午未申酉戌亥]{1,3}|[甲乙丙丁戊己庚辛壬癸])[）)]"
#: How many sub-clauses are merged and list numbers dropped in a paper, and the longest fragment of a run.
MOST_MERGED, MOST_DROPPED, FRAGMENT = 3, 2, 4
#: The structural operations of each document type.
STRUCTURAL = {"position-paper": ("strip_labels", "drop_first_section"), "draft-resolution": ("merge_subclauses", "drop_list_number"), "working-paper": ("drop_list_number",)}


def draw(operation: str, seed: int, *keys: Column | str) -> Column:
    """A number below 2^32 for these keys (null counts as an empty text)."""
    said = F.concat_ws(":", F.lit(operation), F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("long")


def hit(operation: str, seed: int, share: int, *keys: Column | str) -> Column:
    """True for about one key in `share`; for all if share is 1."""
    return draw(operation, seed, *keys) % share == 0 if share > 1 else F.lit(True)


def _doc(order: str = "idx"):
    return Window.partitionBy("doc_id").orderBy(order)


def renumbered(p: DataFrame, idx: str = "idx", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return p.withColumn(idx, (F.row_number().over(Window.partitionBy(*keys).orderBy(idx)) - 1).cast(dict(p.dtypes)[idx]))


def strip_labels(p: DataFrame, seed: int = 0, share: int = 1, labels: str = LABELS) -> DataFrame:
    """The first lines of a paper without their labels."""
    header = F.row_number().over(_doc()) <= HEADER_LINES
    return p.withColumn("text", F.when(header & hit("strip_labels", seed, share, "doc_id", "idx"), F.regexp_replace("text", labels, "")).otherwise(F.col("text")))


def drop_first_section(p: DataFrame, seed: int = 0, share: int = 1) -> DataFrame:
    """The last first-section heading before the first second-section heading without its marker."""
    whole = Window.partitionBy("doc_id")
    p = p.withColumn("_second", F.min(F.when(F.col("text").rlike(SECOND_SECTION), F.col("idx"))).over(whole))
    p = p.withColumn("_first", F.max(F.when(F.col("text").rlike(FIRST_SECTION) & (F.col("idx") < F.col("_second")), F.col("idx"))).over(whole))
    at = (F.col("idx") == F.col("_first")) & hit("drop_first_section", seed, share, "doc_id")
    return p.withColumn("text", F.when(F.coalesce(at, F.lit(False)), F.regexp_replace("text", FIRST_SECTION, "")).otherwise(F.col("text"))).drop("_first", "_second")


def merge_subclauses(p: DataFrame, seed: int = 0, share: int = 1, most: int = MOST_MERGED) -> DataFrame:
    """Deep sub-clauses put back into the line that introduces them, at most `most` in a paper.

    The line behind a merged one stays, so of sub-clauses that follow each other every second one is merged. `complex`
    (optional): lines that take no part. Lines are numbered anew.
    """
    simple = ~F.coalesce(F.col("complex"), F.lit(False)) if "complex" in p.columns else F.lit(True)
    upto = _doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # every window has the same order, so one sort serves them all
    p = p.withColumns({"_simple": simple, "_opens": F.col("text").rlike(r"(?U)：\s*\z") & simple, "_n": F.row_number().over(_doc())})
    p = p.withColumn("_fits", F.coalesce(F.col("text").rlike(DEEP) & F.lag("_opens").over(_doc()) & F.col("_simple") & hit("merge_subclauses", seed, share, "doc_id", "idx"), F.lit(False)))
    # islands of lines that fit: the odd ones of each are merged
    place = F.col("_n") - F.coalesce(F.max(F.when(~F.col("_fits"), F.col("_n"))).over(upto), F.lit(0))
    p = p.withColumn("_odd", F.col("_fits") & (place % 2 == 1))
    p = p.withColumn("_goes", F.col("_odd") & (F.sum(F.col("_odd").cast("int")).over(upto) <= most))
    taken = F.when(F.lead("_goes").over(_doc()), F.lead("text").over(_doc()))
    p = p.withColumn("text", F.concat("text", F.coalesce(taken, F.lit("")))).where("not _goes")
    return renumbered(p.drop("_simple", "_opens", "_n", "_fits", "_odd", "_goes"))


def drop_list_number(p: DataFrame, seed: int = 0, share: int = 1, most: int = MOST_DROPPED) -> DataFrame:
    """The first item of a list, behind a colon and before another item, loses its list and stays where its number was;
    at most `most` in a paper. p: also num_id, left, first (indents)."""
    opens = F.regexp_replace(F.lag("text").over(_doc()), r"(?U)\s+$", "").endswith("：")
    listed = Window.partitionBy("doc_id", "num_id").orderBy("idx")
    fits = F.col("num_id").isNotNull() & opens & (F.lead("num_id").over(_doc()) == F.col("num_id")) & (F.row_number().over(listed) == 1)
    p = p.withColumn("_fits", F.coalesce(fits & hit("drop_list_number", seed, share, "doc_id", "idx"), F.lit(False)))
    p = p.withColumn("_goes", F.col("_fits") & (F.sum(F.col("_fits").cast("int")).over(_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= most))
    place = F.greatest(F.coalesce("left", F.lit(0)) + F.coalesce("first", F.lit(0)), F.lit(0))
    p = p.withColumns({"left": F.when(F.col("_goes"), place).otherwise(F.col("left")), "first": F.when(F.col("_goes"), 0).otherwise(F.col("first")), "num_id": F.when(~F.col("_goes"), F.col("num_id"))})
    return p.drop("_fits", "_goes")


def fragment(runs: DataFrame, seed: int = 0, longest: int = FRAGMENT) -> DataFrame:
    """runs (doc_id, para_idx, run_idx, start, len, text) of three characters or more split into pieces of one to
    `longest` characters; all properties stay. Runs of a paragraph are numbered anew."""
    size = F.length("text")
    piece = lambda i: (draw("fragment", seed, "doc_id", "para_idx", "run_idx", i) % longest + 1).cast("int")
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int>>").alias("cuts"))

    def cut(a: Column, i: Column) -> Column:
        n = F.least(piece(i), size - a.end)
        return F.when(a.end >= size, a).otherwise(F.struct((a.end + n).alias("end"), F.concat(a.cuts, F.array(F.struct(a.end.alias("at"), n.alias("n")))).alias("cuts")))

    whole = F.array(F.struct(F.lit(0).alias("at"), size.alias("n")))
    cuts = F.when(size < 3, whole).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(size, F.lit(1))), begin, cut, lambda a: a.cuts))
    rows = runs.withColumn("_cuts", cuts).select("*", F.posexplode_outer("_cuts").alias("_k", "_c"))
    rows = rows.withColumns({"text": F.substr("text", F.col("_c.at") + 1, F.col("_c.n")), "start": F.col("start") + F.col("_c.at"), "len": F.col("_c.n")})
    order = Window.partitionBy("doc_id", "para_idx").orderBy("run_idx", "_k")
    return rows.withColumn("run_idx", (F.row_number().over(order) - 1).cast(dict(runs.dtypes)["run_idx"])).select(runs.columns)


def scatter(rows: DataFrame, operation: str, choices: dict[str, list], keys: list[str], seed: int = 0, share: int = 4, where: Column | None = None) -> DataFrame:
    """Properties set to one of their choices in about one row of `share`, each property drawn on its own: indents,
    spacing, alignment, fonts, sizes, emphasis or pages, as `choices` names them."""
    changed = {}
    for column, values in choices.items():
        this = f"{operation}.{column}"
        picked = F.get(F.array(*[F.lit(v) for v in values]), (draw(f"{this}.value", seed, *keys) % len(values)).cast("int"))
        chosen = hit(this, seed, share, *keys) & (F.lit(True) if where is None else where)
        changed[column] = F.when(chosen, picked.cast(dict(rows.dtypes)[column])).otherwise(F.col(column))
    return rows.withColumns(changed)


#: Layout damage as (operation, choices, share).
LAYOUT = (
    ("zero_indent", {"left": [0], "first": [0]}, 2),
    ("extreme_indent", {"left": [3000, 4400, 6000, -800], "first": [-1800, 2200, 0]}, 4),
    ("paragraph_noise", {"jc": ["center", "right", "distribute"], "before": [600, 960, 1200], "after": [600, 960, 1200], "line": [160, 720]}, 2),
)


def damaged(p: DataFrame, document_type: str, seed: int = 0) -> DataFrame:
    """All structural operations of the type one after the other, then the layout damage of the columns that p has."""
    for name in STRUCTURAL.get(document_type, ()):
        if name == "drop_list_number" and not {"num_id", "left", "first"} <= set(p.columns):
            continue
        p = {"strip_labels": strip_labels, "drop_first_section": drop_first_section, "merge_subclauses": merge_subclauses, "drop_list_number": drop_list_number}[name](p, seed)
    for operation, choices, share in LAYOUT:
        own = {c: v for c, v in choices.items() if c in p.columns}
        p = scatter(p, operation, own, ["doc_id", "idx"], seed, share) if own else p
    return p
