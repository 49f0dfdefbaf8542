"""Operators over ordered rows of a document: numbering, endings, scopes, latest events. Always keyed by a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions.numerals import native_numeral, paren_token, reads_roman, short_roman


#: So many different levels get a running sum each.
FEW_LEVELS = 64
#: So few levels are counted in the order of their list.
SORTED_LEVELS = 4


def _by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def paragraphs(df: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of a text: id, para_idx from 0, text; lines end at CRLF, CR or LF. A null text has none."""
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n")
    ids = [id_col] if isinstance(id_col, str) else id_col
    return df.where(F.col(text_col).isNotNull()).select(*ids, F.posexplode_outer(lines).alias("para_idx", "text"))


def shallower_rows(items: DataFrame, level: str, counted: Column, upto) -> Column:
    """How many counted rows up to each one have a smaller level, for levels of any depth.

    Where a table has few different levels (the rule), there is one running sum for each; else the levels before each
    row are gathered, which is exact too but grows with the square of a document's rows.
    """
    few = items.select(level).distinct().limit(FEW_LEVELS + 1).collect()
    if len(few) > FEW_LEVELS:
        return F.size(F.filter(F.collect_list(F.when(counted, F.col(level))).over(upto), lambda x: x < F.col(level)))
    out = F.lit(0).cast("long")
    for (own,) in few:
        if own is not None:
            out = F.when(F.col(level) == own, F.sum(F.when(counted & (F.col(level) < own), 1).otherwise(0)).over(upto)).otherwise(out)
    return out


def sequence_issues(items: DataFrame, keys: list[str], order: str = "idx", level: str = "level", family: str = "family", value: str = "value") -> DataFrame:
    """Numbered rows whose value is not their predecessor's plus one in the same level, family and scope.

    A shallower number closes deeper series; a row with reset true closes all. A restart at 1 is allowed after a
    row that is unnumbered and ends in a colon, or shallower.
    """
    w = _by(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = F.col(family).isNotNull() & F.col(value).isNotNull()
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in items.columns else F.lit(False)
    df = items.withColumns({
        "_section": F.sum(reset.cast("int")).over(upto),
        "_restart": (F.col(value) == 1) & ((F.lag(family).over(w).isNull() & F.lag("text").over(w).rlike("[:：]\\s*$")) | (F.lag(level).over(w) < F.col(level))) if "text" in items.columns else (F.col(value) == 1) & (F.lag(level).over(w) < F.col(level)),
    })
    df = df.withColumn("_scope", shallower_rows(items, level, numbered, upto))
    df = df.where(numbered).withColumn("previous", F.lag(value).over(Window.partitionBy(*keys, "_section", level, family, "_scope").orderBy(order)))
    issue = F.col("previous").isNotNull() & (F.col(value) != F.col("previous") + 1) & ~F.coalesce("_restart", F.lit(False))
    return df.where(issue).drop("_section", "_restart", "_scope")


def list_labels(items: DataFrame, keys: list[str], order: str, list_key: str, level: str, start: Column | None = None) -> DataFrame:
    """items with number: the running count in the list and level since the last shallower row, from start (1)."""
    upto = _by([*keys, list_key], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = (F.lit(1) if start is None else start) - 1
    few = items.select(level).distinct().limit(SORTED_LEVELS + 1).collect()
    if len(few) <= SORTED_LEVELS and all(v is not None for (v,) in few):
        # counts of a few levels keep the order of the list, so no sort by level is needed
        own = [(i, v) for i, (v,) in enumerate(few)]
        df = items.withColumns({f"_c{i}": F.count_if(F.col(level) == v).over(upto) for i, v in own})
        df = df.withColumns({f"_b{i}": F.last(F.when(F.col(level) < v, F.col(f"_c{i}")), ignorenulls=True).over(upto) for i, v in own})
        number = F.lit(None).cast("int")
        for i, v in own:
            number = F.when(F.col(level) == v, (F.col(f"_c{i}") - F.coalesce(f"_b{i}", F.lit(0))).cast("int")).otherwise(number)
        return df.withColumn("number", number + first).drop(*[f"_{x}{i}" for i, _ in own for x in "cb"])
    df = items.withColumn("_scope", shallower_rows(items, level, F.lit(True), upto))
    number = F.row_number().over(Window.partitionBy(*keys, list_key, level, "_scope").orderBy(order)) + first
    return df.withColumn("number", number).drop("_scope")


#: Marks at the end of a clause that introduces others, of the last one, of others, and of preambles.
CLAUSE_MARKS = {"zh": ("：", "。", "；", "，"), "en": (":", ".", ";", ",")}
BARE_ARTICLE = r"^\s*第[一二三四五六七八九十百]+条\s*$"


def plan_endings(blocks: DataFrame, keys: list[str], order: str, language: Column) -> DataFrame:
    """blocks (role, level, operative, uncertain, text) with ending, null where none is planned.

    Subject and preamble lines end in a comma. Of the operative items and prose (bare article numbers aside) one before
    a deeper one ends in a colon, the last in a full stop, others in a semicolon; uncertain ones are left alone but
    count for their neighbours.
    """
    clause = F.col("operative") & F.col("role").isin("item", "prose") & ~F.col("text").rlike(BARE_ARTICLE)
    df = blocks.withColumn("_clause", F.coalesce(clause, F.lit(False)))
    following = F.lead("level").over(Window.partitionBy(*keys, "_clause").orderBy(order))
    marks = [F.when(language == "zh", zh).otherwise(en) for zh, en in zip(*CLAUSE_MARKS.values(), strict=True)]
    of_clause = F.when(following.isNull(), marks[1]).when(following > F.col("level"), marks[0]).otherwise(marks[2])
    ending = F.when(F.col("role").isin("subject", "preamble"), marks[3]).when(F.col("_clause") & ~F.coalesce("uncertain", F.lit(False)), of_clause)
    return df.withColumn("ending", ending).drop("_clause")


def roman_context(items: DataFrame, keys: list[str], order: str, token: str) -> DataFrame:
    """items with previous_token: the last token of an earlier row."""
    before = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("previous_token", F.last(token, ignorenulls=True).over(before))


def quote_depth(df: DataFrame, keys: list[str], order: list[str], step: Column) -> DataFrame:
    """df with depth: the running sum of step, never below 0 (a drop below 0 is forgotten)."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_sum", F.sum(step).over(upto))
    return df.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))).drop("_sum")


def list_texts(labelled: DataFrame, keys: list[str], order: str, list_key: str, level: str, lvl_text: str, formats: str) -> DataFrame:
    """list_labels' rows with label: the level's text with %1 to %9 replaced by the numbers of that level and those above,
    each in its level's format. lvl_text: a column such as '%1.%2'; formats: an array of number formats by level.

    A level above that has not been counted yet shows 1.
    """
    upto = _by([*keys, list_key], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.col(lvl_text)
    # placeholders go to nine, so nine running numbers are all there can be
    df = labelled.withColumns({f"_n{d}": F.last(F.when(F.col(level) == d, F.col("number")), ignorenulls=True).over(upto) for d in range(9)})
    for d in range(9):
        shown = native_numeral(F.coalesce(f"_n{d}", F.lit(1)).cast("int"), F.get(formats, F.lit(d)))
        text = F.replace(text, F.lit(f"%{d + 1}"), F.coalesce(shown, F.lit("")))
    return df.withColumn("label", text).drop(*[f"_n{d}" for d in range(9)])


def roman_items(items: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """items with is_roman: whether a parenthesised token is a numeral, from the token of the last item that had one."""
    df = roman_context(items.withColumn("_token", paren_token(F.col(text))), keys, order, "_token")
    df = df.withColumn("_value", F.when(F.col("_token").isNotNull(), short_roman(F.col("_token"))))
    before = F.when(F.col("_value").isNotNull(), short_roman(F.col("previous_token")))
    return df.withColumn("is_roman", reads_roman(F.col("_token"), F.col("_value"), F.col("previous_token"), before)).drop("_token", "_value")


def latest_wins(events: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """The newest row of each session; order breaks all ties."""
    w = Window.partitionBy(*session).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def header_bounds(p: DataFrame, document_type: str | None = None) -> DataFrame:
    """One row per document: title_idx, header_end (first body paragraph after the title) and first_label."""
    w = Window.partitionBy("doc_id")
    title = F.lit(False) if document_type is None else T.looks_like_title(F.col("text"), document_type)
    df = p.withColumn("title_idx", F.min(F.when(title, F.col("para_idx"))).over(w))
    after = F.col("para_idx") > F.coalesce("title_idx", F.lit(-1))
    body = F.min(F.when(after & T.starts_body(F.col("text")), F.col("para_idx")))
    return df.groupBy("doc_id").agg(F.first("title_idx").alias("title_idx"), F.coalesce(body, F.count("*")).cast("int").alias("header_end"), F.min(F.when(T.label_value(F.col("text")).isNotNull(), F.col("para_idx"))).alias("first_label"))


def header_fields(p: DataFrame, document_type: str | None = None) -> DataFrame:
    """Labelled header values before the body, one row per document and field; the last one wins."""
    bounds = header_bounds(p, document_type)
    rows = p.join(bounds.hint("merge"), "doc_id").where("para_idx < header_end").withColumn("_l", T.label_value(F.col("text"))).where("_l is not null")
    return rows.groupBy("doc_id", F.col("_l.key").alias("field")).agg(F.max_by("_l.value", "para_idx").alias("value"), F.count("*").alias("lines"))


def statement_numbers(p: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Numbers for statements if none of a document has one; a mixture is only reported."""
    w, whole = _by(keys, order), Window.partitionBy(*keys)
    has = F.count(number).over(whole)
    df = p.withColumn("status", F.when(has == 0, "numbered").when(has == F.count("*").over(whole), "kept").otherwise("mixed"))
    return df.withColumn("planned", F.when(F.col("status") == "numbered", F.row_number().over(w)))


def suspect_dropped_items(p: DataFrame, keys: list[str], order: str, numbered: Column) -> DataFrame:
    """Unnumbered rows after a line that ends in a colon and before a numbered row."""
    w = _by(keys, order)
    df = p.withColumns({"_n": numbered, "_colon": F.lag("text").over(w).rlike("[:：]\\s*$")})
    return df.withColumn("_next", F.lead("_n").over(w)).where("_colon and not _n and _next").drop("_n", "_colon", "_next")


def reference_section(p: DataFrame) -> DataFrame:
    """p with in_references: from the first line that starts with [1] on."""
    upto = _by(["doc_id"], "para_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.withColumn("in_references", F.coalesce(F.max(F.col("text").rlike(r"^\s*\[1\]")).over(upto), F.lit(False)))


def signature_start(p: DataFrame, is_signature: Column, reach: int = 8) -> DataFrame:
    """Per document the first line of the closing block: of the last `reach` non-blank lines, those after the last other one."""
    last = Window.partitionBy("doc_id").orderBy(F.col("para_idx").desc())
    rows = p.where(F.col("text").rlike(r"\S")).withColumns({"_n": F.row_number().over(last), "_sig": is_signature}).where(F.col("_n") <= reach)
    stop = F.max((~F.col("_sig")).cast("int")).over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_stop", stop).where("_stop = 0").groupBy("doc_id").agg(F.min("para_idx").alias("start"))
