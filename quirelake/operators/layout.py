"""Effective properties, list plans, edit plans and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.numerals import valid_marker_change
from quirelake.functions.text import label_value, let, squeeze, starts_body, without_ending
from quirelake.operators.names import bounded
from quirelake.operators.scratch import cut
from quirelake.operators.snapshots import snapshot_kinds


def resolve_styles(styles: DataFrame, properties: list[str]) -> DataFrame:
    """Per style (doc_id, style, based_on) the nearest value of each property along its chain; the first row of a style counts.

    Pointer doubling: each round a style takes what it lacks from the style it points to and then points where that one
    does, so a chain of n styles needs log2(n) rounds of a join of narrow rows, and no row carries a document's
    definitions. A cycle goes round without changing anything, as the nearest value is there already.
    """
    nearest = F.struct("based_on", *properties)
    now = cut(styles.groupBy("doc_id", "style").agg(F.first(nearest, ignorenulls=True).alias("_x")).select("doc_id", "style", "_x.*"))
    longest = now.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, (longest - 1).bit_length())):
        if now.where("based_on is not null").isEmpty():
            break
        onward = now.select("doc_id", F.col("style").alias("based_on"), F.col("based_on").alias("_next"), *[F.col(p).alias(f"_{p}") for p in properties])
        joined = now.join(onward.hint("merge"), ["doc_id", "based_on"], "left")
        now = cut(joined.select("doc_id", "style", F.col("_next").alias("based_on"), *[F.coalesce(p, f"_{p}").alias(p) for p in properties]))
    return now.select("doc_id", "style", *properties)


def effective_properties(rows: DataFrame, resolved: DataFrame, properties: list[str], levels: DataFrame | None = None, defaults: DataFrame | None = None, default_styles: DataFrame | None = None, default_passes: list[str] | None = None) -> DataFrame:
    """rows (doc_id, style, own properties, and with levels num_id, ilvl) with their effective properties.

    Nearest first: the row's own value, its list level's (levels: doc_id, num_id, ilvl), its style's (resolved), the
    document's default (defaults: doc_id). A row without a list of its own is in that of its style (num_id and ilvl of
    `resolved`; ilvl 0 if none is given); num_id '0' is no list. A row without a style has its document's default style
    (default_styles: doc_id, style), which passes on only `default_passes` (all if None).
    """
    linked = [c for c in ("num_id", "ilvl") if levels is not None and c in resolved.columns]
    s = resolved.select("doc_id", "style", *[F.col(p).alias(f"_s_{p}") for p in dict.fromkeys([*properties, *linked])])
    if default_styles is not None:
        rows = rows.join(default_styles.select("doc_id", F.col("style").alias("_default")).hint("merge"), "doc_id", "left").withColumn("_plain", F.col("style").isNull()).withColumn("style", F.coalesce("style", "_default")).drop("_default")
    out = rows.join(s.hint("merge"), ["doc_id", "style"], "left")
    values = {p: F.col(f"_s_{p}") for p in properties}
    if default_styles is not None:
        if default_passes is not None:
            values = {p: c if p in default_passes else F.when(~F.col("_plain"), c) for p, c in values.items()}
        out = out.withColumn("style", F.when(~F.col("_plain"), F.col("style")))
    if levels is not None:
        number = F.coalesce("num_id", "_s_num_id") if "num_id" in linked else F.col("num_id")
        level = F.when(F.col("num_id").isNotNull(), F.coalesce("ilvl", F.lit(0))).otherwise(F.coalesce("_s_ilvl", F.lit(0))) if "ilvl" in linked else F.coalesce("ilvl", F.lit(0))
        out = out.withColumns({"_number": F.when(number != "0", number), "_level": level})
        of_list = levels.select("doc_id", F.col("num_id").alias("_number"), F.col("ilvl").alias("_level"), *[F.col(p).alias(f"_l_{p}") for p in properties if p in levels.columns])
        out = out.join(of_list.hint("merge"), ["doc_id", "_number", "_level"], "left")
        values = {p: F.coalesce(f"_l_{p}", c) if p in levels.columns else c for p, c in values.items()}
    if defaults is not None:
        own = [p for p in properties if p in defaults.columns]
        out = out.join(defaults.select("doc_id", *[F.col(p).alias(f"_d_{p}") for p in own]).hint("merge"), "doc_id", "left")
        values = {p: F.coalesce(c, F.col(f"_d_{p}")) if p in own else c for p, c in values.items()}
    return out.withColumns({p: F.coalesce(p, c) for p, c in values.items()}).select(*[c for c in rows.columns if c != "_plain"])


def list_field_lines(p: DataFrame, is_label: Column, is_stop: Column) -> DataFrame:
    """Lines of a multi-line list: after a label up to the first stop line. Adds label_idx."""
    upto = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = p.withColumns({"_label": is_label, "_stop": is_stop})
    df = df.withColumn("label_idx", F.last(F.when(F.col("_label"), F.col("para_idx")), ignorenulls=True).over(upto))
    group = Window.partitionBy("doc_id", "label_idx").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_stopped", F.max((F.col("_stop") & ~F.col("_label")).cast("int")).over(group))
    return df.where("label_idx is not null and _stopped = 0 and not _label").drop("_label", "_stop", "_stopped")


def plan_native_lists(items: DataFrame, outside: DataFrame) -> DataFrame:
    """Per list: null if it can be renumbered as a whole, else the reason. outside: list keys used elsewhere."""
    per = items.groupBy("doc_id", "list_key").agg(F.countDistinct("level").alias("levels"), F.bool_or("unsafe").alias("unsafe"), F.max("value").alias("most"))
    used = outside.select("doc_id", "list_key").distinct().withColumn("_out", F.lit(True))
    reason = F.when(F.col("levels") > 1, "several-levels").when(F.col("_out"), "used-outside").when(F.col("unsafe"), "unsafe-definition").when(F.col("most") > 99, "out-of-range")
    return per.join(used.hint("merge"), ["doc_id", "list_key"], "left").select("doc_id", "list_key", reason.alias("reason"))


def integrity_audit(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings for changes of paragraphs (doc_id, para_key, text) that no edit (doc_id, para_key, kind, expected) covers.

    A paragraph may have several edits; its change is right if it fits one of them, and there is one finding at most.
    Texts travel only for paragraphs whose hashes differ.
    """
    keys = ["doc_id", "para_key"]
    changed = snapshot_kinds(before, after, keys, "text").where("kind <> 'unchanged'").withColumnRenamed("kind", "change")
    logged = edits.groupBy(*keys).agg(F.collect_set(F.struct("kind", "expected")).alias("_edits"))
    side = lambda df, name: df.select(*keys, F.col("text").alias(name)).hint("merge")
    j = changed.join(logged.hint("merge"), keys, "left").join(side(before, "before"), keys, "left").join(side(after, "after"), keys, "left")

    # worked out once a row, outside the test of each edit
    j = j.withColumns({
        "_ending": without_ending(F.col("before")) == without_ending(F.col("after")), "_marker": valid_marker_change(F.col("before"), F.col("after")),
        "_dropped": let(squeeze(F.col("before")), lambda t: label_value(t)["value"]) == squeeze(F.col("after")), "_restored": let(squeeze(F.col("after")), lambda t: label_value(t)["value"]) == squeeze(F.col("before")),
    })

    def allowed(e: Column) -> Column:
        return (
            F.when(e.kind == "ending", F.col("_ending"))
            .when(e.kind.isin("marker", "dr-marker", "list-marker"), F.col("_marker"))
            .when(e.kind == "label-drop", F.col("_dropped"))
            .when(e.kind == "label-restore", F.col("_restored"))
            .when(e.kind.isin("blank", "empty-line"), squeeze(F.coalesce("before", F.lit(""))) == squeeze(F.coalesce("after", F.lit(""))))
            .when(e.kind == "statement-number", F.regexp_replace("after", r"^\s*[0-9]+[.、．]\s*", "") == squeeze(F.col("before")))
            .when(e.kind.isin("country-name", "countries"), squashed(F.col("after")) == squashed(e.expected))
            .otherwise(F.col("after").eqNullSafe(e.expected))
        )

    kinds = F.array_sort(F.transform("_edits", lambda e: e.kind))
    right = F.exists("_edits", lambda e: F.coalesce(allowed(e), F.lit(False)))
    code = F.when(F.col("_edits").isNull(), F.concat(F.lit("unauthorised-"), F.col("change"))).when(~right, F.concat(F.lit("wrong-"), F.array_join(F.array_distinct(kinds), "-")))
    return j.withColumn("code", code).where("code is not null").select(*keys, "code")


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def marks_audit(before: DataFrame, after: DataFrame, mark: str) -> DataFrame:
    """Blocks (doc_id, block) whose marked characters are not all there, in order, afterwards."""
    text = lambda df, name: df.where(F.col(mark)).groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text), "").alias(name))
    j = text(before, "was").join(text(after, "now").hint("merge"), ["doc_id", "block"], "left").withColumn("now", F.coalesce("now", F.lit("")))
    state = F.aggregate(F.filter(F.split("was", ""), lambda c: c != ""), F.struct(F.col("now").alias("rest"), F.lit(True).alias("ok")), lambda a, c: F.struct(F.substr(a.rest, F.position(c, a.rest) + 1).alias("rest"), (a.ok & (F.position(c, a.rest) > 0)).alias("ok")), lambda a: a.ok)
    return j.where(~state).select("doc_id", "block")


def verb_coverage(spans: DataFrame, runs: DataFrame, style: Column) -> DataFrame:
    """Spans (doc_id, para_idx, start, length) that styled runs (start, len) do not cover as a whole.

    Runs may touch, overlap or lie in one another: they are swept by their starts, and each adds what lies behind the
    furthest end so far.
    """
    r = runs.where(style).select("doc_id", "para_idx", F.col("start").alias("_s"), (F.col("start") + F.col("len")).alias("_e"))
    keys = ["doc_id", "para_idx", "start", "length"]
    sweep = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    j = spans.join(r.hint("merge"), ["doc_id", "para_idx"], "left")
    begin = F.greatest("_s", "start", F.coalesce(F.max("_e").over(sweep), F.col("start")))
    j = j.withColumn("_new", F.greatest(F.lit(0), F.least(F.col("_e"), F.col("start") + F.col("length")) - begin))
    covered = j.groupBy(*keys).agg(F.sum(F.coalesce("_new", F.lit(0))).alias("covered"))
    return covered.where("covered < length").select("doc_id", "para_idx", "start")


def geometry_audit(p: DataFrame, spec: DataFrame, tolerance: int = 10) -> DataFrame:
    """Paragraphs (role, jc, indent, pitch) that differ from the specification (role, jc, indent, pitch)."""
    s = bounded(spec.select("role", *[F.col(c).alias(f"_{c}") for c in ("jc", "indent", "pitch")]))
    j = p.join(s, "role")
    wrong = {"alignment": ~F.col("jc").eqNullSafe(F.col("_jc")), "indent": F.abs(F.col("indent") - F.col("_indent")) > tolerance, "pitch": F.abs(F.col("pitch") - F.col("_pitch")) > tolerance}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in wrong.items()]))
    return j.select("doc_id", "para_idx", F.explode_outer(found).alias("code")).where("code is not null")


def marker_audit(levels: DataFrame, size: float, font: str) -> DataFrame:
    """Findings (doc_id, num_id, ilvl, code) of list markers that don't look like the text: marker-size, and, bullets
    aside, marker-font and marker-emphasis. levels: doc_id, num_id, ilvl, fmt, sz, font, b, i, u (null: not set)."""
    other = ~F.coalesce(F.col("fmt") == "bullet", F.lit(False))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    wrong = {"marker-size": ~F.coalesce(F.col("sz") == size, F.lit(False)), "marker-font": other & ~F.coalesce(F.col("font") == font, F.lit(False)), "marker-emphasis": other & (on("b") | on("i") | on("u"))}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in wrong.items()]))
    return levels.select("doc_id", "num_id", "ilvl", F.explode_outer(found).alias("code")).where("code is not null")


def section_marker_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose section markers, in order, are not those of the source; a missing first marker may be restored.
    Both: doc_id, para_idx, text. Result: doc_id, before, after (markers joined)."""
    marker = F.regexp_extract("text", r"^\s*(（[一二三四五六七八九十]+）)", 1)
    listed = lambda df, name: df.select("doc_id", "para_idx", marker.alias("m")).where("m <> ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "m"))), lambda x: x.m), "").alias(name))
    j = listed(before, "before").join(listed(after, "after").hint("merge"), "doc_id", "full_outer").select("doc_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    restored = F.col("before").startswith("（二）") & (F.col("after") == F.concat(F.lit("（一）"), "before"))
    return j.where((F.col("before") != F.col("after")) & ~restored)


def paragraph_audit(p: DataFrame, pitch: dict[str, float], limit: float, tables: DataFrame | None = None, tolerance: float = 0.05) -> DataFrame:
    """Findings (doc_id, para_idx, code) over paragraphs' direct layout: page-break, pitch, indent-limit, and table-in-signature
    (para_idx null) for documents with a table where lines are signed.

    p: doc_id, para_idx, role, page_break_before, line (points; null or multiple: not set), left (points). pitch: role ->
    points, '' for all others. Headings (role part) are free. tables: doc_id of documents that hold tables.
    """
    expected = F.coalesce(*[F.when(F.col("role") == r, F.lit(v)) for r, v in pitch.items() if r], F.lit(pitch.get("")))
    wrong = {"page-break": F.coalesce(F.col("page_break_before"), F.lit(False)), "pitch": F.coalesce(F.abs(F.col("line") - expected) > tolerance, F.lit(True)), "indent-limit": F.coalesce(F.abs(F.col("left")) > limit, F.lit(False))}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in wrong.items()]))
    rows = p.where("role <> 'part'").select("doc_id", "para_idx", F.explode_outer(found).alias("code")).where("code is not null")
    if tables is None:
        return rows
    signed = p.where(F.col("role").isin("sponsors", "signatories")).select("doc_id").distinct()
    return rows.union(signed.join(tables.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", F.lit(None).cast(dict(p.dtypes)["para_idx"]), F.lit("table-in-signature")))


def validate_overrides(rows: DataFrame, lists: list[str], scalars: list[str]) -> DataFrame:
    """rows (request, field, values array<string>) that are not allowed, with the error."""
    snake = F.lower(F.regexp_replace("field", "(?<!^)(?=[A-Z])", "_"))
    bad_text = F.exists("values", lambda v: v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"))
    error = (
        F.when(~snake.isin(*lists, *scalars, "language"), "unknown-field")
        .when(bad_text, "invalid-text")
        .when(snake.isin(*lists) & ((F.size("values") > 300) | F.exists("values", lambda v: F.length(v) > 200)), "list-too-long")
        .when(snake.isin(*scalars) & ((F.size("values") != 1) | (F.length(F.get("values", 0)) > 5000)), "value-too-long")
        .when((snake == "language") & ~F.coalesce(F.get("values", 0), F.lit("")).isin("zh", "en"), "bad-language")
    )
    return rows.withColumn("error", error).where("error is not null").select("request", snake.alias("field"), "error")


def required_phrases(spans: DataFrame, required: DataFrame) -> DataFrame:
    """Phrases that no italic span of the document contains. required: doc_id, phrase."""
    have = spans.where("italic").groupBy("doc_id").agg(F.collect_list("text").alias("_texts"))
    j = required.join(have.hint("merge"), "doc_id", "left")
    return j.where(~F.exists(F.coalesce("_texts", F.array().cast("array<string>")), lambda t: F.contains(t, F.col("phrase")))).select("doc_id", "phrase")


def embedded_markers(p: DataFrame, marker: str = r"[：:；;]\s*([（(](?:[一二三四五六七八九十百]{1,3}|[子丑寅卯辰巳午未申酉戌亥]{1,4}|[甲乙丙丁戊己庚辛壬癸]{1,4})[）)])") -> DataFrame:
    """Sub-clause markers inside a line: doc_id, para_idx, occurrence, marker."""
    return p.select("doc_id", "para_idx", F.posexplode_outer(F.regexp_extract_all("text", F.lit(marker), F.lit(1))).alias("occurrence", "marker")).where("marker is not null")


def missing_first_section(p: DataFrame) -> DataFrame:
    """Documents with a second section heading but no first before it: the nearest short heading that is followed by
    text, with a confidence (repaired from 0.9 on)."""
    heading, ends = F.regexp_extract("text", r"^\s*[（(]([一二三四五六七八九十百]+)[）)]", 1), r"[。；;！？!?]$"
    rows = p.where(F.col("text").rlike(r"\S")).select("doc_id", "para_idx", squeeze(F.col("text")).alias("text"), heading.alias("_h"))
    # what is asked of a text is judged before the shuffle: texts stay behind
    text = F.col("text")
    bare = squeeze(F.regexp_replace("text", r"^\s*[（(][一二三四五六七八九十百]+[）)]", ""))
    alike = (bare != "") & (F.length(bare) <= 30) & ~bare.rlike("[。；;！？!?：:]$")
    short = (F.length("text") <= 30) & ~text.rlike(ends) & label_value(text).isNull() & ~F.lower("text").rlike("立场文件|position paper")
    rows = rows.select(
        "doc_id", "para_idx", F.when(F.col("_h").isin("一", "二"), F.col("_h")).alias("_h"), short.alias("_short"), (F.length("text") >= 25).alias("_long"), text.rlike("[：:]$").alias("_colon"), F.when(F.col("_h") == "二", F.struct(bare.alias("bare"), alike.alias("alike"))).alias("_second"),
    )
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_next": F.lead("_long").over(w), "_next_idx": F.lead("para_idx").over(w), "_previous": F.lag("_colon").over(w),
        "second": F.min(F.when(F.col("_h") == "二", F.col("para_idx"))).over(whole), "_first": F.min(F.when(F.col("_h") == "一", F.col("para_idx"))).over(whole),
    })
    rows = rows.withColumn("_alike", F.max(F.when(F.col("para_idx") == F.col("second"), F.col("_second"))).over(whole)["alike"])
    rows = rows.where("para_idx < second and (_first is null or _first > second)")
    rows = rows.where(F.col("_short") & F.col("_next") & (F.col("_next_idx") < F.col("second")))
    near = F.col("second") - F.col("para_idx") <= 3
    more = F.when(F.col("_previous"), 0.12).otherwise(0.0) + F.when(F.col("_alike"), 0.08).otherwise(0.0)
    rows = rows.withColumn("confidence", F.round(F.when(near, 0.94).otherwise(0.72 + more), 2))
    return rows.groupBy("doc_id", "second").agg(F.max("para_idx").alias("candidate"), F.max_by("confidence", "para_idx").alias("confidence"))


def blank_balance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blank lines per document on both sides."""
    blank = lambda df, name: df.groupBy("doc_id").agg(F.count_if(~F.col("text").rlike(r"\S")).alias(name))
    return blank(a, "blank_a").join(blank(b, "blank_b").hint("merge"), "doc_id", "full_outer")


def distinct_warnings(rows: DataFrame) -> DataFrame:
    """Distinct warnings of a document in first-seen order. rows: doc_id, pos, warning."""
    first = rows.groupBy("doc_id", "warning").agg(F.min("pos").alias("pos"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "warning"))), lambda x: x.warning).alias("warnings"))


def stripped_header(p: DataFrame) -> DataFrame:
    """The four lines after a position paper's title as committee, topic, country and delegate, if none of them has a
    label or opens the body; with a confidence (repaired from 0.9 on)."""
    whole, w = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("para_idx")
    rows = p.where(F.col("text").rlike(r"\S")).select("doc_id", "para_idx", squeeze(F.col("text")).alias("text"))
    rows = rows.withColumn("_title", F.min(F.when(F.lower("text").rlike("立场文件|position paper"), F.col("para_idx"))).over(whole))
    rows = rows.where("para_idx > _title").withColumn("_n", F.row_number().over(w)).where("_n <= 4")
    open_ = label_value(F.col("text")).isNull() & ~starts_body(F.col("text"))
    fine = (F.length("text") <= 80) & ~F.col("text").rlike("[。；;！？!?]")
    rows = rows.withColumns({"_open": F.bool_and(open_).over(whole), "_fine": F.bool_and(fine).over(whole), "_all": F.count("*").over(whole)})
    fields = F.array(*map(F.lit, ("committee", "topic", "country", "delegate")))
    confidence = F.when(F.col("_fine"), 0.97).otherwise(0.58)
    return rows.where("_open and _all = 4").select("doc_id", "para_idx", F.get(fields, F.col("_n") - 1).alias("field"), "text", confidence.alias("confidence"))
