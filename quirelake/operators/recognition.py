"""Recognition of documents: header fields, clauses with their levels and kinds, roles, parties of treaties.

Input rows are paragraphs: doc_id, para_idx, text and, where a source has them, native_level (level of a native list
item by its format, null outside lists), indent_left and indent_hanging (twentieths of a point). Everything is windows
over a document's rows and joins on doc_id; levels, which depend on the level before, are one fold over the document's
clauses. Vocabularies (language -> kind -> phrases) are parameters, as policy_tables gives them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import clauses as C
from quirelake.functions import numerals as N
from quirelake.functions import text as T
from quirelake.functions import treaty as Y
from quirelake.functions.text import let
from quirelake.operators import names as M
from quirelake.operators.names import bounded

Vocabulary = dict[str, dict[str, list[str]]]

#: Fields by kind, those that unlabelled lines give by type, and lines that name an organ.
SCALARS, LISTS = ("committee", "topic", "country", "delegate"), ("sponsors", "signatories")
UNLABELLED = {"position-paper": ("committee", "topic", "country", "delegate"), **dict.fromkeys(("working-paper", "draft-directive", "draft-resolution", "friendly-amendment", "unfriendly-amendment"), ("committee", "topic"))}
ORGAN = r"(?i)委员会|理事会|大会|议会|\b(?:committee|council|assembly|commission)\b"
#: Part headings, markers of top-level clauses and of those right below, and how names of states end.
PART = r"(?i)^PART\s+[IVXLC]+\b"
TOP_NUMBER = r"^\s*(?:第[一二三四五六七八九十百]+条|[0-9]+[.、．)])"
SUBCLAUSE = r"(?i)^\s*(?:\([a-zivx]+\)|[（(][一二三四五六七八九十]+[）)])"
STATE_ZH, STATE_EN = r"(?:国|联邦|联盟|教廷)$", r"(?i)\b(?:Republic|Kingdom|Federation|States?|Emirates)\b"
SUBJECTS = ("联合国大会", "the committee", "the general assembly")
#: Markers and the level each gives, in the order they are tried.
LEVELS = (
    (r"^\s*(?:第[一二三四五六七八九十百]+条|\d+[.、．])", 0),
    (r"(?i)^\s*[（(](?:[a-z]|[一二三四五六七八九十]+)[）)]", 1),
    (r"(?i)^\s*[a-hj-uw-z][.)）]", 1),
    (r"^\s*[（(][子丑寅卯辰巳午未申酉戌亥]{2,3}[）)]", 3),
    (r"^\s*[（(][子丑寅卯辰巳午未申酉戌亥][）)]", 2),
    (r"(?i)^\s*(?:[ivxlcdm]+\.|[（(][甲乙丙丁戊己庚辛壬癸]+[）)])", 3),
)
#: Deeper indents (points) are damage; words of treaty titles; how parties stand in a title.
DEEPEST_INDENT = 96
TITLE_WORDS = {
    "zh": "联合声明|共同声明|联合公报|声明|宣言|协定|协议|条约|公约|议定书|备忘录|换文",
    "en": r"\b(?:Joint Statement|Joint Declaration|Joint Communiqu[eé]|Statement|Declaration|Communiqu[eé]|Agreement|Treaty|Convention|Protocol|Memorandum of Understanding|Memorandum|Exchange of Notes)\b",
}
SUBJECT_START = {"zh": "关于|就|有关", "en": r"\s+(?:on|concerning|regarding|relating to|in respect of|with respect to)\s+"}
SEPARATORS = {"zh": "[、，,；;]|以及|及|与|同|(?<!共)和(?!平)", "en": r"\s*,\s*(?:and\s+)?|\s+and\s+"}
ZH_TRAILING = "(?:之间|间|双方|三方|四方|各方)$"
EN_LEAD = r"\b(?:between|among|amongst|of|by)\s+"


def _doc(order: str | None = None, upto: bool = False):
    w = Window.partitionBy("doc_id")
    w = w.orderBy(order) if order else w
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if upto else w


def _cjk(text: Column) -> Column:
    """How many CJK characters a text has; texts of ASCII alone need no pattern."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(text) - F.length(F.regexp_replace(text, T.CJK, "")))


def _latin(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))


def _language(cjk: Column, latin: Column) -> Column:
    return F.when((cjk >= 2) & (cjk >= F.floor(latin / 4)), "zh").otherwise("en")


def with_language(p: DataFrame) -> DataFrame:
    """p with the language of the whole document, from sums of its rows' characters."""
    text = F.coalesce("text", F.lit(""))
    # sorted by place from the first window on, so that the windows that follow need no sort of their own
    whole = _doc("para_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # only where there are two such characters do Latin letters matter
    df = p.withColumn("_cjk", F.sum(_cjk(text)).over(whole))
    latin = F.sum(F.when(F.col("_cjk") >= 2, _latin(text)).otherwise(0)).over(whole)
    return df.withColumn("language", _language(F.col("_cjk"), latin)).drop("_cjk")


def _part(line: Column) -> Column:
    """Whether a trimmed line is a part heading."""
    return F.when(F.substr(line, F.lit(1), F.lit(1)).isin("P", "p"), line.rlike(PART)).otherwise(False)


def opens_with(text: Column, vocabulary: Vocabulary, kind: str, language: Column | None = None) -> Column:
    """Whether the text opens with a phrase of the kind in the document's language (in any language where none is given)."""
    tried = [C.starts_with_any(text, vocabulary[lang][kind]) if language is None else (language == lang) & C.starts_with_any(text, vocabulary[lang][kind]) for lang in vocabulary]
    found = tried[0]
    for other in tried[1:]:
        found = found | other
    return found


def is_name_continuation(text: Column, regions: list[str] = ()) -> Column:
    """Whether a line goes on with a list of states: no clause marks or digits, every name a short formal one or a region."""
    bare = lambda v: F.lower(T.squeeze(F.regexp_replace(v, r"(?i)^The\s+", "")))
    known = lambda v: F.array_contains(F.array(*map(F.lit, regions)), bare(v)) if regions else F.lit(False)
    state = lambda v: F.when(v.rlike("[㐀-鿿]"), (F.length(v) <= 24) & v.rlike(STATE_ZH)).otherwise((F.length(v) <= 80) & (v.rlike(STATE_EN) | known(v)))
    # one kind of mark between names, so that they are split without a pattern
    names = F.split(F.translate(F.regexp_replace(text, r"[、，,\s]+$", ""), "，、;；/|\n\r\t", "," * 9), ",", -1)
    parts = let(F.filter(F.transform(names, T.trim_name), lambda x: x != ""), lambda x: (F.size(x) > 0) & F.forall(x, state))
    # few lines hold the name of a state at all; when keeps the rest from being worked out for the others
    may = F.lit(True) if regions else text.rlike(STATE_EN) | text.rlike(r"国|联邦|联盟|教廷")
    return F.when(text.rlike(r"[：:。！？!?；;\d]"), False).when(text.rlike(r"\.\s*$"), False).when(~may, False).otherwise(parts)


def is_committee_subject(line: Column, committee: Column, vocabulary: Vocabulary) -> Column:
    """Whether a trimmed line addresses the body: the committee itself, a usual form, or an organ line."""
    return _is_subject(line, F.lower(C.bare(line)), committee, vocabulary)


def _is_subject(line: Column, clean: Column, committee: Column, vocabulary: Vocabulary) -> Column:
    """is_committee_subject() with clean, the line without commas and capitals."""
    verbs = [v for kinds in vocabulary.values() for phrases in kinds.values() for v in phrases]
    own = F.when(F.coalesce(committee, F.lit("")) != "", C.without_prefix(C.bare(clean)) == F.lower(C.without_prefix(C.bare(committee)))).otherwise(False)
    # the usual forms end in a comma
    usual = F.when(C.ends_in_comma(line), line.rlike(r"^The [A-Z][A-Z\s]*,$") | C.is_subject_line(line, verbs)).otherwise(False)
    return F.when(own, True).when(clean.isin(*SUBJECTS), True).otherwise(usual)


def header(p: DataFrame, document_type: str, vocabulary: Vocabulary, regions: list[str] = ()) -> DataFrame:
    """p with language, line (trimmed), role (title, a field, header for continuations, else null), value, committee and
    body_start.

    Labels count up to the first body paragraph after the title; of a repeated label the last counts. Unlabelled lines
    between title and first label are the type's fields in order if there are as many, or if a single one names an organ.
    Lists go on over lines that continue them.
    """
    fields = UNLABELLED.get(document_type, ())
    everything = _doc("para_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda condition: F.min(F.when(condition, F.col("para_idx")))
    never = F.lit(2**31 - 1)
    # windows of one order share one sort, and those that need nothing of each other one pass
    df = p.withColumn("line", T.trimmed(F.coalesce("text", F.lit(""))))
    line = F.col("line")
    df = df.withColumns({"_some": line != "", "_is_title": F.when(T.may_be_title(line, document_type), T.looks_like_title(F.lower(line), document_type)).otherwise(False), "_l": T.label_value(line), "_marker": F.when(T.unmarked(line), False).otherwise(T.has_marker(line))})
    df = df.withColumns({"_cjk": F.sum(_cjk(line)).over(everything), "_title": first(F.col("_some") & F.col("_is_title")).over(everything), "_labelled": first(F.col("_l").isNotNull()).over(everything)})
    native = F.col("native_level").isNotNull() if "native_level" in p.columns else F.lit(None).cast("boolean")
    opens = F.when(F.col("para_idx") > F.coalesce("_title", F.lit(-1)), T.opens_body(line, F.col("_l"), native))
    df = df.withColumns({"_latin": F.sum(F.when(F.col("_cjk") >= 2, _latin(line)).otherwise(0)).over(everything), "_limit": F.coalesce(first(opens).over(everything), never)})
    # labels count above the limit
    above = F.col("para_idx") < F.col("_limit")
    df = df.withColumns({"language": _language(F.col("_cjk"), F.col("_latin")), "_l": F.when(above, F.col("_l")), "_labelled": F.when(F.col("_labelled") < F.col("_limit"), F.col("_labelled")).otherwise(never)}).drop("_cjk", "_latin")
    above = F.col("_some") & (F.col("para_idx") > F.col("_title")) & (F.col("para_idx") < F.least("_labelled", "_limit")) & (F.length(line) <= 80)
    plain = F.when(above, F.when(F.col("_marker"), False).when(line.rlike("[。！？!?；;]|[,，]$"), False).otherwise(~opens_with(line, vocabulary, "preambulatory", F.col("language"))))
    df = df.withColumn("_plain", F.coalesce(plain, F.lit(False))).drop("_title", "_limit")
    # of more plain lines than fields the first ones count
    organ = F.bool_or(F.when(F.col("_plain"), line.rlike(ORGAN)).otherwise(False))
    df = df.withColumns({"_nth": F.sum(F.col("_plain").cast("int")).over(_doc("para_idx", True)), "_count": F.sum(F.col("_plain").cast("int")).over(everything), "_organ": organ.over(everything)})
    enough = (F.col("_count") >= len(fields)) | ((F.col("_count") == 1) & ((F.col("_labelled") < never) & F.col("_organ") | F.lit(document_type == "draft-directive")))
    by_place = F.get(F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"), F.col("_nth") - 1)
    df = df.withColumn("_field", F.coalesce(F.col("_l.key"), F.when(F.col("_plain") & (F.col("_nth") <= len(fields)) & enough, by_place)))
    value = F.coalesce(F.col("_l.value"), T.squeeze(F.regexp_replace(line, r"^\s*[:：]\s*", "")))
    # the last label of a field counts, else its unlabelled line; there are few fields, so each has a maximum of its own
    rank = F.when(F.col("_l").isNotNull(), F.lit(2**32)).otherwise(F.lit(0)) + F.col("para_idx").cast("long")
    df = df.withColumns({"_rank": F.when(F.col("_field").isNotNull(), rank), "_value": F.when(F.col("_field").isNotNull(), value)}).drop("_labelled", "_plain", "_nth", "_count", "_organ")
    of_field = lambda f, of: F.max(F.when(F.col("_field") == f, of)).over(everything)
    df = df.withColumns({f"_best_{f}": of_field(f, F.col("_rank")) for f in (*SCALARS, *LISTS)} | {"committee": of_field("committee", F.struct("_rank", "_value"))})
    best = F.lit(False)
    for f in (*SCALARS, *LISTS):
        best = F.when(F.col("_field") == f, F.col("_rank") == F.col(f"_best_{f}")).otherwise(best)
    df = df.withColumns({"_wins": best, "committee": F.col("committee._value")})
    df = df.drop(*[f"_best_{f}" for f in (*SCALARS, *LISTS)])
    # the cheap tests first; when keeps the others from being worked out beforehand, which & and | do not
    marked = F.when(F.col("_l").isNotNull() | F.col("_is_title") | F.col("_marker"), True).otherwise(_part(line))
    opening = opens_with(line, vocabulary, "preambulatory", F.col("language")) | opens_with(line, vocabulary, "operative", F.col("language"))
    stop = F.when(marked, True).when(opening, True).when(~is_name_continuation(line, regions), True).otherwise(is_committee_subject(line, F.col("committee"), vocabulary))
    # a row goes on with the list of the last label above it if nothing in between stops it; labels stop, and unlabelled
    # fields stand above all labels, so a list counts if its label does
    df = df.withColumn("_stops", F.when(F.col("_some"), stop).otherwise(False))
    df = df.withColumn("_stop", F.last(F.when(F.col("_stops"), F.struct(F.when(F.col("_l.key").isin(*LISTS), F.col("_l.key")).alias("of"), F.col("_wins").alias("wins"))), ignorenulls=True).over(_doc("para_idx", True)))
    listed = F.col("_some") & F.col("_stop.of").isNotNull() & ~F.col("_stops") & F.coalesce("_stop.wins", F.lit(False))
    role = F.when(F.col("_wins"), F.col("_field")).when(listed, F.concat(F.lit("+"), "_stop.of")).when(F.col("_some") & F.col("_is_title"), "title")
    df = df.withColumns({"role": role, "value": F.when(F.col("_wins"), F.col("_value")).when(listed, line)})
    ends = F.col("role").isNotNull() | F.col("_field").isNotNull()
    df = df.withColumn("body_start", F.coalesce(F.max(F.when(ends, F.col("para_idx"))).over(everything) + 1, F.lit(0)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def models(headed: DataFrame) -> DataFrame:
    """One row per document from header(): language, title, the four scalar fields, and the two lists of names."""
    scalar = [F.max(F.when(F.col("role") == f, F.col("value"))).alias(f) for f in SCALARS]
    title = F.max_by(F.when(F.col("role") == "title", F.col("line")), F.when(F.col("role") == "title", F.col("para_idx"))).alias("title")
    bare = F.regexp_replace("value", r"^[^:：]+[:：]\s*", "")

    def names(field: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("role").isin(field, f"+{field}"), F.struct("para_idx", T.split_names(bare).alias("names")))))
        return F.flatten(F.transform(rows, lambda x: x.names)).alias(field)

    return headed.groupBy("doc_id").agg(F.first("language").alias("language"), title, *scalar, *map(names, LISTS))


def _levels_fold(rows: Column) -> Column:
    """Levels of a document's rows (array of structs in order); headings end a list and get null."""
    start = F.struct(
        F.lit(0).alias("level"), F.lit(False).alias("in_list"), F.lit(False).alias("paren"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("int").alias("numeral"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, r: Column) -> Column:
        x = r.x
        below = F.least(F.lit(3), s.level + 1)
        of_digit = F.when(s.paren, s.level).when(s.in_list, below).otherwise(0)
        of_indent = F.when(s.in_list, x.indent_level).otherwise(0)
        roman = F.when(x.token.isNull(), False).otherwise(N.reads_roman(x.token, x.numeral, s.token, s.numeral))
        level = F.when(roman, F.when(s.level >= 1, 2).otherwise(1)).when(x.digit, of_digit).otherwise(F.coalesce(x.fixed, x.native_level, of_indent)).cast("int")
        has = x.token.isNotNull()
        item = let(level, lambda v: F.struct(v.alias("level"), ((v > 0) | x.opens).alias("in_list"), x.digit.alias("paren"), F.when(has, x.token).otherwise(s.token).alias("token"), F.when(has, x.numeral).otherwise(s.numeral).alias("numeral"), F.concat(s.out, F.array(v)).alias("out")))
        heading = F.struct(s.level.alias("level"), F.lit(False).alias("in_list"), s.paren.alias("paren"), s.token.alias("token"), s.numeral.alias("numeral"), F.concat(s.out, F.array(F.lit(None).cast("int"))).alias("out"))
        return F.when(x.heading, heading).otherwise(item)

    return F.aggregate(rows, start, step, lambda s: s.out)


def clauses(headed: DataFrame, document_type: str, vocabulary: Vocabulary, indents: dict[str, list[tuple[int, int]]] | None = None) -> DataFrame:
    """Body paragraphs of header() as clauses: doc_id, para_idx, text (without marker), kind, level and confidence.

    kind: heading, preambulatory, operative, body or unknown. indents: language -> (left, hanging) of each list level.
    """
    body = headed.where((F.col("line") != "") & (F.col("para_idx") >= F.col("body_start")) & F.col("role").isNull())
    df = _judged(body, F.lit(True), document_type, vocabulary, indents, [])
    return df.select("doc_id", "para_idx", F.when(F.col("_heading"), F.col("line")).otherwise(F.col("_clean")).alias("text"), "_k.kind", "level", "_k.confidence", F.col("_subject").alias("is_subject"), "language", "line")


def _judged(headed: DataFrame, body: Column, document_type: str, vocabulary: Vocabulary, indents: dict[str, list[tuple[int, int]]] | None, carried: list[str]) -> DataFrame:
    """Rows of header() that are not blank, with level, _heading, _subject, _clean (without marker) and _k (kind and
    confidence) where body holds; rows where it doesn't stand above the body. carried: further columns to keep."""
    line = F.col("line")
    optional = lambda c, kind: F.col(c).cast(kind) if c in headed.columns else F.lit(None).cast(kind)
    df = headed.withColumns({"_body": body, "_bare": F.lower(C.bare(line)), "_begin": F.substr(line, F.lit(1), F.lit(1))})
    # columns that others name stand in projections of their own, so they are worked out once
    df = df.withColumn("_part", F.when(F.col("_body"), _part(line)).otherwise(False))
    df = df.withColumn("_subject", F.when(F.col("_body") & ~F.col("_part"), _is_subject(line, F.col("_bare"), F.col("committee"), vocabulary)).otherwise(False))
    df = df.withColumns({"_heading": F.col("_part") | F.col("_subject"), "_native": optional("native_level", "int"), "_paren": F.col("_begin").isin("(", "（")})
    fixed = F.lit(None).cast("int")
    for pattern, level in reversed(LEVELS):
        fixed = F.when(line.rlike(pattern), level).otherwise(fixed)
    # what a line begins with decides which patterns can match it
    fixed = F.when(T.unmarked(line), F.when(F.col("_begin").isin(*"ivxlcdmIVXLCDM"), fixed)).otherwise(fixed)
    df = df.withColumns({"_token": F.when(F.col("_body") & ~F.col("_heading") & F.col("_paren"), N.paren_token(line)), "_fixed": fixed, "_digit": F.when(F.col("_paren"), N.paren_digit(line)).otherwise(False)})
    left, hanging = F.coalesce(optional("indent_left", "int"), F.lit(0)), F.coalesce(optional("indent_hanging", "int"), F.lit(0))
    rounded = F.when((left > 0) & (left <= DEEPEST_INDENT * 20), F.least(F.lit(3), F.bround(left / 1440 / 0.3).cast("int"))).otherwise(0)
    of_indent = rounded
    for language, levels in (indents or {}).items():
        for level, (a, b) in reversed(list(enumerate(levels))):
            if level:
                of_indent = F.when((F.col("language") == language) & (left == a) & (hanging == b), level).otherwise(of_indent)
    opens = F.col("_native").isNotNull() | F.col("_token").isNotNull() | F.col("_digit") | F.col("_fixed").isNotNull() | line.endswith(":") | line.endswith("：")
    x = F.struct(
        (F.col("_heading") | ~F.col("_body")).alias("heading"), F.col("_token").alias("token"), F.when(F.col("_token").isNotNull(), N.short_roman(F.col("_token"))).alias("numeral"), F.col("_digit").alias("digit"), F.col("_fixed").alias("fixed"),
        F.col("_native").alias("native_level"), of_indent.alias("indent_level"), F.coalesce(opens, F.lit(False)).alias("opens"),
    )
    resolution = document_type == "draft-resolution"
    number = F.when(F.col("_begin").between("0", "9") | (F.col("_begin") == "第"), line.rlike(TOP_NUMBER)).otherwise(False)
    top, under = F.col("_body") & (number | F.coalesce(F.col("_native") == 0, F.lit(False))), F.when(F.col("_paren"), line.rlike(SUBCLAUSE)).otherwise(False)
    # rows travel with what the fold needs, so they are worked out once
    kept = ["para_idx", "line", "language", "_heading", "_subject", "_body", *carried]
    df = df.select("doc_id", F.struct("para_idx", x.alias("x"), under.alias("under"), F.struct(*kept).alias("row")).alias("_r"), F.when(top, F.col("para_idx")).alias("_first"), F.when(F.col("_subject"), F.col("para_idx")).alias("_after"))
    df = df.groupBy("doc_id").agg(F.sort_array(F.collect_list("_r")).alias("_r"), F.min("_first").alias("_first"), F.min("_after").alias("_after"))
    df = operative_boundary(df, vocabulary) if resolution else df.withColumn("_top", F.lit(None).cast("int"))
    # only resolutions ask whether a subject came before
    after = F.col("_after") if resolution else F.lit(None).cast("int")
    zipped = F.arrays_zip(F.transform("_r", lambda a: a.row).alias("row"), _levels_fold(F.col("_r")).alias("level"))
    df = df.select("doc_id", "_top", after.alias("_after"), F.explode_outer(zipped).alias("z")).select("doc_id", "_top", "_after", *[F.col(f"z.row.{c}") for c in kept], "z.level")
    df = df.withColumn("_clean", F.when(T.unmarked(line), line).otherwise(T.strip_marker(line)))
    seen = F.coalesce(F.col("para_idx") > F.col("_after"), F.lit(False))
    guess = F.lit(None).cast("struct<kind:string,confidence:double>")
    for language, kinds in vocabulary.items():
        guess = F.when(F.col("language") == language, C.classify_clause(F.col("_clean"), document_type, kinds["preambulatory"], kinds["operative"], seen)).otherwise(guess)
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).cast("double").alias("confidence"))
    by_place = F.when(F.col("para_idx") < F.col("_top"), pair("preambulatory", 0.98)).otherwise(pair("operative", 0.98))
    judged = F.when(F.col("_heading"), pair("heading", 1.0)).when(F.col("_top").isNotNull(), by_place).otherwise(guess)
    df = df.withColumn("_k", F.when(F.col("_body"), judged))
    level = F.when(F.col("_heading") | (F.col("_k.kind") == "preambulatory") & F.col("_top").isNotNull(), 0).otherwise(F.col("level"))
    return df.withColumn("level", F.when(F.col("_body"), level).cast("int"))


def operative_boundary(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """documents (doc_id, their rows in order, _r, and _first, the first row with a top-level number) with _top, the first
    operative row of a resolution: _first, or an earlier one that opens with an operative verb right before a sub-clause."""
    opens = lambda row: F.when(row._body, opens_with(T.strip_marker(row.line), vocabulary, "operative", row.language))
    before = lambda a, i: F.when((i > 0) & a.under & (a.para_idx < F.col("_first")), let(F.get("_r", i - 1), lambda b: F.when(opens(b.row), b.para_idx)))
    early = F.array_min(F.transform("_r", before))
    return documents.withColumn("_top", F.when(F.col("_first").isNotNull(), F.coalesce(early, "_first"))).drop("_first")


def max_level(clause_rows: DataFrame) -> DataFrame:
    """doc_id and the number of levels of its clauses."""
    # a filter on kind would be pushed below it and work it out twice
    counted = F.col("kind") != "heading"
    return clause_rows.groupBy("doc_id").agg((F.max(F.when(counted, F.col("level"))) + 1).alias("levels"), F.count_if(counted).alias("_n")).where("_n > 0").drop("_n")


def roles(headed: DataFrame, clause_rows: DataFrame, document_type: str, with_subject: bool = True) -> DataFrame:
    """doc_id, para_idx, role, level, group and operative of every non-blank paragraph.

    headed may hold list_key (list and list level of native list items): such items nest by nest_native_items.
    """
    kinds = clause_rows.select("doc_id", "para_idx", "kind", F.col("level").alias("_level"), "is_subject")
    return _roles(headed.where(F.col("line") != "").join(kinds.hint("merge"), ["doc_id", "para_idx"], "left"), document_type, with_subject)


def document_roles(headed: DataFrame, document_type: str, vocabulary: Vocabulary, indents: dict[str, list[tuple[int, int]]] | None = None, with_subject: bool = True) -> DataFrame:
    """roles() of header() and its clauses in one pass: clauses are not joined back to their rows."""
    body = (F.col("para_idx") >= F.col("body_start")) & F.col("role").isNull()
    carried = ["role", "body_start", *[c for c in ("native_level", "list_key") if c in headed.columns]]
    df = _judged(headed.where(F.col("line") != ""), body, document_type, vocabulary, indents, carried)
    return _roles(df.withColumns({"kind": F.col("_k.kind"), "_level": F.col("level"), "is_subject": F.when(F.col("_body"), F.col("_subject"))}), document_type, with_subject)


def _roles(df: DataFrame, document_type: str, with_subject: bool) -> DataFrame:
    """Roles of rows of header() that have their clause's kind, _level and is_subject."""
    operative_type = document_type in ("draft-directive", "draft-resolution") or "amendment" in document_type
    native = F.col("native_level").isNotNull() if "native_level" in df.columns else F.lit(False)
    marked = F.when(T.unmarked(F.col("line")), False).otherwise(T.has_marker(F.col("line")))
    listed = F.when((F.col("_level") > 0) | native, True).otherwise(marked)
    if document_type == "position-paper":
        level = F.when(F.col("line").rlike(r"^\s*\d+\s*[.、．)]"), 0).when(F.col("line").rlike(r"(?i)^\s*(?:[a-h]|[j-u]|[w-z])\s*[.)]"), 1).when(F.col("line").rlike(r"(?i)^\s*[ivx]+\s*[.)]"), 2)
        listed = level.isNotNull()
    else:
        level = F.col("_level")
    reference = F.max(F.when((F.col("para_idx") >= F.col("body_start")) & F.col("line").rlike(r"^\s*\[1\]"), 1)).over(_doc("para_idx", True)) if document_type == "position-paper" else F.lit(None)
    continued = F.col("role").startswith("+")
    role = (
        F.when(continued, "header").when(F.col("role").isNotNull(), F.col("role")).when(F.col("para_idx") < F.col("body_start"), "header").when(reference == 1, "reference")
        .when((F.col("kind") == "heading") & F.col("is_subject"), "subject" if with_subject else "prose").when(F.col("kind") == "heading", "part")
        .when((F.col("kind") == "preambulatory") & F.lit(document_type == "draft-resolution"), "preamble").when(listed, "item").otherwise("prose")
    )
    df = df.withColumn("_role", role)
    operative = F.when(F.col("_role") == "item", operative_type).when(F.col("_role") == "prose", F.lit(operative_type) & F.coalesce(F.col("kind") == "operative", F.lit(False))).otherwise(False)
    group = F.when(continued, F.substr("role", F.lit(2))).when(F.col("role").isin(*LISTS), F.col("role"))
    listed_by = ["list_key"] if "list_key" in df.columns else []
    df = df.select("doc_id", "para_idx", F.col("_role").alias("role"), F.when(F.col("_role").isin("item", "prose"), F.coalesce(level, F.lit(0))).otherwise(0).cast("int").alias("level"), group.alias("group"), operative.alias("operative"), F.col("line").alias("text"), "language", *listed_by)
    return nest_native_items(df) if listed_by else df


def nest_native_items(rows: DataFrame) -> DataFrame:
    """rows (doc_id, para_idx, role, level, text, list_key) with the levels of native list items without a typed marker.

    A native list that begins right behind an item ending in a colon, and is not that item's own list, is one level below
    it; its later items stay at that level. list_key: list and list level, null outside native lists.
    """
    own = [c for c in rows.columns if c not in ("doc_id", "level")]
    x = F.struct("para_idx", (F.col("role") == "item").alias("item"), F.col("level").cast("int").alias("level"), F.when(~T.has_marker(F.col("text")), F.col("list_key")).alias("native"), F.col("list_key").alias("key"), F.coalesce(F.col("text").rlike("[：:]\\s*$"), F.lit(False)).alias("opens"), F.struct(*own).alias("row"))
    documents = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias("_x"))
    start = F.struct(F.create_map().cast("map<string,int>").alias("lists"), F.lit(None).cast("int").alias("under"), F.lit(None).cast("string").alias("of"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, a: Column) -> Column:
        key = F.coalesce(a.native, F.lit(""))
        known = F.when(a.native.isNotNull(), F.try_element_at(s.lists, key))
        begins = a.item & a.native.isNotNull() & known.isNull() & s.under.isNotNull() & ~a.native.eqNullSafe(s.of)
        level = F.when(~a.item, a.level).otherwise(F.coalesce(known, F.when(begins, s.under + 1), a.level))
        lists = F.when(begins, F.map_concat(s.lists, F.create_map(key, level))).otherwise(s.lists)
        opens = a.item & a.opens
        return F.struct(lists.alias("lists"), F.when(opens, level).alias("under"), F.when(opens, a.key).alias("of"), F.concat(s.out, F.array(level)).alias("out"))

    zipped = F.arrays_zip(F.transform("_x", lambda a: a.row).alias("row"), F.aggregate("_x", start, step, lambda s: s.out).alias("level"))
    out = documents.select("doc_id", F.explode_outer(zipped).alias("z")).select("doc_id", "z.row.*", "z.level")
    return out.select(*rows.columns)


def repeated_header_fields(headed: DataFrame) -> DataFrame:
    """doc_id and field of country-like labels that a header has more than once: such fields are left to a person."""
    key = T.label_value(F.col("line"))["key"]
    return headed.where(F.col("para_idx") < F.col("body_start")).groupBy("doc_id", key.alias("field")).agg(F.count("*").alias("n")).where(F.col("n") > 1).where(F.col("field").isin("country", *LISTS))


# --- treaties


def title_like(text: Column) -> Column:
    return (F.length(text) <= 160) & ~text.rlike("[。；;！？!?]") & ~text.rlike(r"(?i)^(?:鉴于|whereas\b)")


def titles(p: DataFrame) -> DataFrame:
    """One row per document with a title: doc_id, language, lines and at (their para_idx). The title's lines: of the first
    three non-blank short lines those up to the first with a treaty word, else the first."""
    text = F.coalesce("text", F.lit(""))
    rows = p.withColumn("line", T.squeeze(text))
    some = F.col("line") != ""
    whole = _doc("para_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = lambda c, n: F.nth_value(F.when(some, c), n, ignoreNulls=True).over(whole)
    # all windows are of one order, so that they share one pass
    columns = {f"_l{n}": nth(F.col("line"), n) for n in (1, 2, 3)} | {f"_a{n}": nth(F.struct("para_idx"), n) for n in (1, 2, 3)} | {"_row": F.row_number().over(_doc("para_idx"))}
    if "language" not in p.columns:
        without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
        cjk = F.when(F.octet_length(text) == F.length(text), 0).otherwise(without(T.CJK))
        columns |= {"_cjk": F.sum(cjk).over(whole), "_latin": F.sum(without("[A-Za-z]+")).over(whole)}
    rows = rows.withColumns(columns).where("_row = 1")
    if "language" not in p.columns:
        rows = rows.withColumn("language", F.when((F.col("_cjk") >= 2) & (F.col("_cjk") >= F.floor(F.col("_latin") / 4)), "zh").otherwise("en"))
    like = lambda n: title_like(F.col(f"_l{n}"))
    word = lambda n: F.when(F.col("language") == "zh", F.col(f"_l{n}").rlike(f"(?:{TITLE_WORDS['zh']})$")).otherwise(F.col(f"_l{n}").rlike(f"(?i){TITLE_WORDS['en']}"))
    last = F.when(word(1), 1).when(like(2) & word(2), 2).when(like(2) & like(3) & word(3), 3).otherwise(1)
    rows = rows.where(like(1)).withColumn("_last", last)
    upto = lambda c: F.slice(F.array(*[f"{c}{n}" for n in (1, 2, 3)]), F.lit(1), F.col("_last"))
    return rows.select("doc_id", "language", upto("_l").alias("lines"), F.transform(upto("_a"), lambda a: a.para_idx).alias("at"))


def title_lines(p: DataFrame) -> DataFrame:
    """The title's lines, a row each."""
    rows = titles(p).select("doc_id", "language", F.explode_outer(F.arrays_zip("at", "lines")).alias("x"))
    return rows.select("doc_id", F.col("x.at").alias("para_idx"), F.col("x.lines").alias("line"), "language")


def treaty_heads(titles: DataFrame) -> DataFrame:
    """doc_id, language and the part of the title that lists the parties. titles: rows of lines, or of whole titles."""
    df = titles
    if "lines" not in df.columns:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "line"))), lambda x: x.line)
        df = df.groupBy("doc_id").agg(F.first("language").alias("language"), lines.alias("lines"))
    is_zh = F.col("language") == "zh"
    start, joined = SUBJECT_START["zh"], F.array_join("lines", "")
    zh = (
        F.when((F.size("lines") > 1) & F.get("lines", F.lit(1)).rlike(f"^(?:{start})"), F.get("lines", F.lit(0)))
        .when(joined.rlike(start), F.regexp_extract(joined, f"(?s)^(.*?)(?:{start})", 1))
        .when(joined.rlike(f"(?:{TITLE_WORDS['zh']})$"), F.regexp_replace(joined, f"(?:{TITLE_WORDS['zh']})$", "")).otherwise("")
    )
    # a column of its own for each step, so that none is worked out twice; what is listed is never empty
    df = df.withColumn("_flat", F.when(is_zh, "").otherwise(T.squeeze(F.regexp_replace(F.array_join("lines", " "), r"(?U)\s{2,}|[^\S ]", " "))))
    df = df.withColumn("_listed", F.regexp_extract("_flat", f"(?i){EN_LEAD}(.+?)(?:{SUBJECT_START['en']}|$)", 1))
    en = F.when(F.col("_listed") != "", F.col("_listed")).otherwise(F.regexp_extract("_flat", f"(?i)^(.+?){TITLE_WORDS['en']}", 1))
    return df.select("doc_id", "language", F.when(is_zh, zh).otherwise(en).alias("head"))


def split_parties(heads: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id and parties (array) of each head. A separator inside a known name does not split: neighbours of which the
    first is unknown are one party where together they are known. index: keys of known names (name_index, review lists).
    A small index is looked up in the row of the head, a larger one by joins of the pieces."""
    zh = F.col("language") == "zh"
    cut = lambda f: F.when(zh, f(SEPARATORS["zh"])).otherwise(f(f"(?i){SEPARATORS['en']}"))
    pieces = F.coalesce(cut(lambda s: F.split("head", s, -1)), F.array(F.lit(None).cast("string")))
    df = heads.withColumns({"_p": pieces, "_s": cut(lambda s: F.regexp_extract_all("head", F.lit(s), F.lit(0)))})
    pairs = F.transform("_p", lambda x, i: F.when(i + 1 < F.size("_p"), F.concat(x, F.get("_s", i), F.get("_p", i + 1))))
    trailing = lambda x: T.squeeze(F.regexp_replace(x, ZH_TRAILING, ""))
    commas = lambda x: F.when(x.endswith(",") | x.endswith("，"), T.squeeze(F.regexp_replace(x, "[,，]+$", ""))).otherwise(x)
    clean = lambda x: F.when(zh, F.transform(F.transform(x, T.squeeze), trailing)).otherwise(F.transform(F.transform(x, T.squeeze), commas))
    df = df.select("doc_id", clean(F.col("_p")).alias("one"), clean(pairs).alias("two"))
    df = M.with_name_keys(df.withColumn("_names", F.concat("one", "two")), "_names", "_k")
    df = df.withColumns({"_k1": F.slice("_k", F.lit(1), F.size("one")), "_k2": F.slice("_k", F.size("one") + 1, F.size("one"))})
    keys = index.select("key").where("key is not null").distinct()
    few = keys.limit(M.INDEX_LITERALS + 1).collect()
    if len(few) <= M.INDEX_LITERALS:
        known = lambda k: F.coalesce(k.isin(*[r.key for r in few]), F.lit(False))
        df = df.withColumn("may", F.transform("_k2", lambda k, i: known(k) & ~known(F.get("_k1", i))))
    else:
        keys = bounded(keys)
        rows = df.select("doc_id", F.posexplode_outer(F.arrays_zip("one", "two", "_k1", "_k2")).alias("i", "x")).select("doc_id", "i", "x.*")
        rows = rows.join(keys.select(F.col("key").alias("_k1"), F.lit(True).alias("_known1")), "_k1", "left").join(keys.select(F.col("key").alias("_k2"), F.lit(True).alias("_known2")), "_k2", "left")
        may = F.col("_known1").isNull() & F.col("_known2").isNotNull()
        x = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "one", "two", may.alias("may")))).alias("x"))
        df = x.select("doc_id", "x.one", "x.two", "x.may")
    start = F.struct(F.lit(False).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        joins = ~s.used & x.may
        party = F.when(joins, x.two).otherwise(x.one)
        return F.struct(joins.alias("used"), F.when(s.used | (party == ""), s.out).otherwise(F.concat(s.out, F.array(party))).alias("out"))

    joined = F.aggregate(F.arrays_zip("one", "two", "may"), start, step, lambda s: s.out)
    return df.select("doc_id", F.when(F.exists("may", lambda m: m), joined).otherwise(F.filter("one", lambda x: ~x.eqNullSafe(""))).alias("parties"))


def treaty_body(p: DataFrame) -> DataFrame:
    """doc_id, para_idx, line of the paragraphs between title and closing block."""
    rows = with_language(p).withColumn("line", T.squeeze(F.coalesce("text", F.lit("")))).where("line <> ''")
    last = Window.partitionBy("doc_id").orderBy(F.col("para_idx").desc())
    like = (F.length("line") <= 160) & ~F.col("line").rlike("[。；;！？!?]|[，,]$")
    labels = F.when(F.col("language") == "zh", Y.label_tokens(F.col("line"), "zh")).otherwise(Y.label_tokens(F.col("line"), "en"))
    rows = rows.withColumn("_n", F.row_number().over(last))
    rows = rows.withColumn("_off", F.max(((F.col("_n") > 8) | ~like).cast("int")).over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_closing", F.min(F.when((F.col("_off") == 0) & labels.isNotNull(), F.col("para_idx"))).over(_doc()))
    titles = title_lines(p).select("doc_id", "para_idx")
    body = rows.where("_closing is null or para_idx < _closing").select("doc_id", "para_idx", "line")
    return body.join(titles.hint("merge"), ["doc_id", "para_idx"], "left_anti")
