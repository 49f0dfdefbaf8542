"""Word-processor packages as tables. Spark reads and deals the files; a small parser turns each into rows.

Read parts only from packages that passed package_audit: parsing refuses document type definitions anyway.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.operators.scratch import small_batches

#: Limits of a package.
LIMITS = {"upload": 20 * 2**20, "expanded": 100 * 2**20, "xml": 16 * 2**20, "parts": 5000, "ratio": 250, "depth": 256}
METHODS = (0, 8)
REQUIRED = ("[Content_Types].xml", "word/document.xml")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

ENTRIES = (
    "doc_id string, entry_idx int, name string, flags int, method int, crc long, compressed long, expanded long, offset long, local_flags int, local_method int, local_crc long, local_compressed long, "
    "local_expanded long, data_end long, crc_ok boolean, has_dtd boolean, xml_depth int, xml_ok boolean, sha256 string, problem string"
)
PARAGRAPHS = "doc_id string, para_idx int, region string, text string, style string, jc string, num_id string, ilvl int"
RUNS = "doc_id string, para_idx int, run_idx int, start int, len int, text string, b boolean, i boolean, u boolean, sz double, font_ascii string, font_east_asia string, font_hansi string, hidden boolean, struck boolean"
RELATIONSHIPS = "doc_id string, part string, id string, type string, target string, mode string"
STYLES = "doc_id string, style string, kind string, based_on string, is_default boolean, b boolean, i boolean, u boolean, sz double, font_ascii string, font_east_asia string, jc string, num_id string, ilvl int, hidden boolean, struck boolean"
LEVELS = "doc_id string, num_id string, abstract_id string, ilvl int, fmt string, lvl_text string, start int, override boolean"


def read_package_dir(spark: SparkSession, path: str, doc_type: str, limit: int = LIMITS["upload"]) -> tuple[DataFrame, DataFrame]:
    """(packages, too large): every *.docx below path but owner files; the second has their sizes only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    files = files.withColumn("source_name", F.element_at(F.split("path", "/"), -1)).where("source_name not like '~$%'")
    docs = files.where(F.col("length") <= limit).select(F.col("path").alias("doc_id"), "source_name", F.lit(doc_type).alias("doc_type"), "content")
    return docs, files.where(F.col("length") > limit).select(F.col("path").alias("doc_id"), "source_name", "length")


#: What a parser may raise on a broken package, and the problem it is reported as.
PROBLEMS = (
    (ElementTree.ParseError, "malformed-xml"),
    (zipfile.BadZipFile, "unreadable"), (zlib.error, "unreadable"), (EOFError, "unreadable"), (struct.error, "unreadable"), (NotImplementedError, "unreadable"), (RuntimeError, "unreadable"), (OSError, "unreadable"),
    (ValueError, "invalid-value"), (KeyError, "invalid-value"), (TypeError, "invalid-value"), (AttributeError, "invalid-value"), (RecursionError, "too-deep"),
)


class _Broken(Exception):
    """A package that is not parsed any further; its text is the problem."""


def _rows(docs: DataFrame, schema: str, parse: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of each package, one package at a time, as one may have 20 MiB, with the column `problem`.

    A package fails alone: one that can't be parsed gives a single row, with its doc_id and the problem.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    schema = f"{schema}, problem string" if "problem" not in schema else schema
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def rows_of(doc_id: str, content: bytes) -> list[tuple]:
        try:
            return [(*x, None) if len(x) < len(kinds) else x for x in parse(doc_id, content)]
        except _Broken as broken:
            problem = str(broken)
        except tuple(kind for kind, _ in PROBLEMS) as error:
            problem = next(name for kind, name in PROBLEMS if isinstance(error, kind))
        return [(doc_id, *[None] * (len(kinds) - 2), problem)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = rows_of(doc_id.as_py(), content.as_py() or b"")
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select("doc_id", "content").mapInArrow(run, schema)


def package_problems(docs: DataFrame) -> DataFrame:
    """doc_id and problem (null where there is none) of every package: its paragraphs are read and not kept."""

    def parse(doc_id: str, content: bytes) -> Iterator[tuple]:
        for _ in _paragraphs(doc_id, content):
            pass
        yield (doc_id,)

    return _rows(docs, "doc_id string", parse)


def failures(parsed: DataFrame) -> DataFrame:
    """doc_id and problem of the packages that a parser gave up."""
    return parsed.where("problem is not null").select("doc_id", "problem").distinct()


def sound(parsed: DataFrame) -> DataFrame:
    """The rows of the packages that were parsed."""
    return parsed.where("problem is null").drop("problem")


class _Refused(Exception):
    """A document type definition."""


def _xml_facts(data: bytes) -> tuple[bool, int, bool]:
    """Whether an XML part declares a document type (in any encoding), its depth up to a fault, and whether there is none."""
    depth = most = 0

    def opened(*_) -> None:
        nonlocal depth, most
        depth += 1
        most = max(most, depth)

    def closed(*_) -> None:
        nonlocal depth
        depth -= 1

    def refuse(*_) -> None:
        raise _Refused

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = opened, closed, refuse
    try:
        parser.Parse(data, True)
    except _Refused:
        return True, most, True
    except (expat.ExpatError, ValueError):
        return False, most, False
    return False, most, True


def _is_xml(name: str) -> bool:
    return name.lower().endswith((".xml", ".rels"))


def _read(z: zipfile.ZipFile, e: zipfile.ZipInfo, keep: bool) -> tuple[bytes, bool, str | None]:
    """(content if keep, whether it could be read and its CRC holds, sha256), in blocks and never past the declared size."""
    digest, parts, left = hashlib.sha256(), [], e.file_size
    try:
        with z.open(e) as part:
            while block := part.read(2**16):
                left -= len(block)
                if left < 0:
                    return b"", False, None
                digest.update(block)
                if keep:
                    parts.append(block)
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError):
        return b"", False, None
    return b"".join(parts), left == 0, digest.hexdigest()


def _local(content: bytes, e: zipfile.ZipInfo) -> tuple:
    """The local header's flags, method, CRC and sizes, and where the data end; nulls if there is none."""
    at = e.header_offset
    if at < 0 or at + 30 > len(content) or content[at : at + 4] != b"PK\x03\x04":
        return (None,) * 6
    flags, method = struct.unpack_from("<HH", content, at + 6)
    crc, compressed, expanded, name, extra = struct.unpack_from("<IIIHH", content, at + 14)
    return flags, method, crc, compressed, expanded, at + 30 + name + extra + e.compress_size


def _entries(doc_id: str, content: bytes) -> Iterator[tuple]:
    """Parts are expanded only where their declared sizes and ratio are within the limits; crc_ok is null for others."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            total = 0
            for i, e in enumerate(z.infolist()):
                total += e.file_size
                xml = _is_xml(e.filename)
                fair = e.file_size <= LIMITS["ratio"] * e.compress_size and total <= LIMITS["expanded"] and i < LIMITS["parts"] and not (xml and e.file_size > LIMITS["xml"])
                data, ok, digest = _read(z, e, xml) if fair else (b"", None, None)
                dtd, depth, sound_ = _xml_facts(data) if xml and data else (False, 0, None if xml and not ok else not xml or not fair)
                yield (doc_id, i, e.filename, e.flag_bits, e.compress_type, e.CRC, e.compress_size, e.file_size, e.header_offset, *_local(content, e), ok, dtd, depth, sound_, digest, None)
    except (zipfile.BadZipFile, ValueError, OSError) as problem:
        yield (doc_id, *[None] * 19, type(problem).__name__)


def package_entries(docs: DataFrame) -> DataFrame:
    """One row per ZIP entry; an unreadable package has one row with the problem."""
    return _rows(docs, ENTRIES, _entries)


def package_audit(entries: DataFrame) -> DataFrame:
    """doc_id, rule, name of every violation. Relational rules over package_entries."""
    # one pass: entries are parsed once, and rules on several entries are windows over one sort of a package's rows
    same_name, whole = Window.partitionBy("doc_id", "name", "_read"), Window.partitionBy("doc_id")
    placed = whole.orderBy("_read", "offset", "entry_idx").rowsBetween(Window.unboundedPreceding, -1)
    narrow = [c for c in entries.columns if c != "sha256"]
    e = entries.select(*narrow).withColumn("_read", F.col("problem").isNull())
    own = lambda c: F.when(F.col("_read"), F.col(c))
    xml = F.col("name").rlike(r"(?i)\.(xml|rels)$")
    streamed = F.col("flags").bitwiseAND(8) != 0
    same = lambda *columns: F.array(*[F.col(c).cast("long") for c in columns])
    one = {
        "no-local-header": F.col("local_flags").isNull(),
        "header-mismatch": ~same("flags", "method").eqNullSafe(same("local_flags", "local_method")) | (~streamed & ~same("crc", "compressed", "expanded").eqNullSafe(same("local_crc", "local_compressed", "local_expanded"))),
        "encrypted": (F.col("flags").bitwiseAND(1)) == 1,
        "unsafe-path": F.col("name").rlike(r"(^|/)\.\.(/|$)|^/|\\|[\x00-\x1f]|^__proto__$"),
        "method": ~F.col("method").isin(*METHODS),
        "xml-size": xml & (F.col("expanded") > LIMITS["xml"]),
        "zero-compressed": (F.col("compressed") == 0) & (F.col("expanded") > 0),
        "ratio": (F.col("compressed") > 0) & (F.col("expanded") > F.col("compressed") * LIMITS["ratio"]),
        "crc": ~F.col("crc_ok"),
        "dtd": F.col("has_dtd"),
        "malformed-xml": ~F.col("xml_ok"),
        "depth": F.col("xml_depth") > LIMITS["depth"],
    }
    e = e.select(
        "doc_id", "name", "entry_idx", "offset", "data_end", "expanded", "_read", F.when(F.col("_read"), F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in one.items()]))).alias("_rules")
    )
    # entries at one offset follow each other as the directory has them
    e = e.withColumns({
        "_end": F.max(own("data_end")).over(placed), "_first": F.row_number().over(whole.orderBy("_read", "offset", "entry_idx")) == 1,
        "_n": F.count_if("_read").over(whole), "_bytes": F.sum(own("expanded")).over(whole), "_have": F.size(F.collect_set(F.when(F.col("_read") & F.col("name").isin(*REQUIRED), F.col("name"))).over(whole)),
    })
    e = e.withColumns({"_times": F.count("*").over(same_name), "_turn": F.row_number().over(same_name.orderBy("entry_idx"))})
    found = lambda rule, name: F.struct(rule.alias("rule"), name.alias("name"))
    of_entry = F.concat(F.coalesce("_rules", F.array().cast("array<string>")), F.array_compact(F.array(
        F.when(F.col("_read") & (F.col("_times") > 1) & (F.col("_turn") == 1), "duplicate"), F.when(F.col("_read") & (F.col("offset") < F.col("_end")), "overlap"),
    )))
    of_package = F.array_compact(F.array(
        F.when(~F.col("_read"), "unreadable"), F.when(F.col("_first") & (F.col("_n") > LIMITS["parts"]), "too-many-parts"), F.when(F.col("_first") & (F.col("_bytes") > LIMITS["expanded"]), "total-size"),
        F.when(F.col("_first") & (F.col("_n") > 0) & (F.col("_have") < len(REQUIRED)), "missing-part"),
    ))
    nothing = F.lit(None).cast("string")
    both = F.concat(F.transform(of_entry, lambda r: found(r, F.col("name"))), F.transform(of_package, lambda r: found(r, nothing)))
    return e.select("doc_id", F.explode_outer(both).alias("x")).where("x is not null").select("doc_id", "x.rule", "x.name")


def _part(content: bytes, name: str) -> ElementTree.Element | None:
    """The root of an XML part, None if the package lacks it; never more than the limit is expanded."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if name not in z.namelist():
            return None
        entry = z.getinfo(name)
        if entry.file_size > LIMITS["xml"]:
            raise _Broken("too-large")
        data, whole, _ = _read(z, entry, True)
    if not whole:
        raise _Broken("unreadable")
    if _xml_facts(data)[0]:
        raise _Broken("dtd")
    return ElementTree.fromstring(data)


def _get(node: ElementTree.Element | None, path: str) -> str | None:
    found = None if node is None else node.find(path)
    return None if found is None else found.get(f"{W}val")


def _on(props: ElementTree.Element | None, tag: str) -> bool | None:
    """Tri-state switch of run properties: absent is null."""
    found = None if props is None else props.find(f"{W}{tag}")
    return None if found is None else (found.get(f"{W}val") or "").lower() not in ("0", "false", "off", "none")


def _fonts(props: ElementTree.Element | None) -> tuple[str | None, str | None, str | None]:
    found = None if props is None else props.find(f"{W}rFonts")
    return tuple(None if found is None else found.get(f"{W}{slot}") for slot in ("ascii", "eastAsia", "hAnsi"))


def _size(props: ElementTree.Element | None) -> float | None:
    size = _get(props, f"{W}sz")
    return float(size) / 2 if size else None


def _text(run: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in run)


def _walk(node: ElementTree.Element, region: str) -> Iterator[tuple[ElementTree.Element, str]]:
    """Paragraphs in document order; content controls are transparent, tables and text boxes are regions."""
    for x in node:
        inner = "table" if x.tag == f"{W}tbl" else "textbox" if x.tag == f"{W}txbxContent" else region
        if x.tag == f"{W}p":
            yield x, region
        yield from _walk(x, inner)


def _runs_of(p: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for x in p:
        if x.tag == f"{W}r":
            yield x
        elif x.tag not in (f"{W}del", f"{W}moveFrom", f"{W}pPr"):
            yield from _runs_of(x)


def _body(content: bytes) -> Iterator[tuple[int, ElementTree.Element, str]]:
    root = _part(content, "word/document.xml")
    if root is None:
        raise _Broken("missing-part")
    for i, (p, region) in enumerate(_walk(root, "flow")):
        yield i, p, region


def _paragraphs(doc_id: str, content: bytes) -> Iterator[tuple]:
    for i, p, region in _body(content):
        props = p.find(f"{W}pPr")
        number, level = _get(props, f"{W}numPr/{W}numId"), _get(props, f"{W}numPr/{W}ilvl")
        text = "".join(map(_text, _runs_of(p)))
        yield doc_id, i, region, text, _get(props, f"{W}pStyle"), _get(props, f"{W}jc"), None if number == "0" else number, int(level) if number not in (None, "0") and level else None


def _runs(doc_id: str, content: bytes) -> Iterator[tuple]:
    for i, p, _ in _body(content):
        start = 0
        for k, r in enumerate(_runs_of(p)):
            props, text = r.find(f"{W}rPr"), _text(r)
            struck = _on(props, "strike") or _on(props, "dstrike")
            yield doc_id, i, k, start, len(text), text, _on(props, "b"), _on(props, "i"), _on(props, "u"), _size(props), *_fonts(props), bool(_on(props, "vanish")), bool(struck)
            start += len(text)


def _relationships(doc_id: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".rels")]
    for name in names:
        root = _part(content, name)
        for r in root if root is not None else ():
            yield doc_id, name, r.get("Id"), r.get("Type"), r.get("Target"), r.get("TargetMode") or "Internal"


def _levels(doc_id: str, content: bytes) -> Iterator[tuple]:
    root = _part(content, "word/numbering.xml")
    if root is None:
        return
    abstract = {a.get(f"{W}abstractNumId"): a for a in root.findall(f"{W}abstractNum")}
    for n in root.findall(f"{W}num"):
        of, number = _get(n, f"{W}abstractNumId"), n.get(f"{W}numId")
        # the instance's own level wins over the abstract one, its start override over both
        levels = {x.get(f"{W}ilvl"): (x, False) for x in (abstract[of].findall(f"{W}lvl") if of in abstract else ())}
        starts = {}
        for o in n.findall(f"{W}lvlOverride"):
            if (own := o.find(f"{W}lvl")) is not None:
                levels[o.get(f"{W}ilvl")] = (own, True)
            starts[o.get(f"{W}ilvl")] = _get(o, f"{W}startOverride")
        for at, (x, own) in levels.items():
            start = starts.get(at) or _get(x, f"{W}start") or "1"
            yield doc_id, number, of, int(at), _get(x, f"{W}numFmt"), _get(x, f"{W}lvlText"), int(start), own or bool(starts.get(at))


def _styles(doc_id: str, content: bytes) -> Iterator[tuple]:
    """Styles, and the document's defaults as a style without a name's parent: what every chain ends in."""
    root = _part(content, "word/styles.xml")
    if root is None:
        return
    defaults = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
    if defaults is not None:
        yield doc_id, "", "default", None, False, _on(defaults, "b"), _on(defaults, "i"), _on(defaults, "u"), _size(defaults), *_fonts(defaults)[:2], None, None, None, _on(defaults, "vanish"), _on(defaults, "strike")
    for x in root.findall(f"{W}style"):
        run, para = x.find(f"{W}rPr"), x.find(f"{W}pPr")
        level = _get(para, f"{W}numPr/{W}ilvl")
        yield (
            doc_id, x.get(f"{W}styleId"), x.get(f"{W}type"), _get(x, f"{W}basedOn") or ("" if defaults is not None else None), (x.get(f"{W}default") or "").lower() in ("1", "true", "on"),
            _on(run, "b"), _on(run, "i"), _on(run, "u"), _size(run), *_fonts(run)[:2], _get(para, f"{W}jc"), _get(para, f"{W}numPr/{W}numId"), int(level) if level else None, _on(run, "vanish"), _on(run, "strike"),
        )


def parse_paragraphs(docs: DataFrame) -> DataFrame:
    """read_paragraphs with the column `problem`: write it once to have both the rows (sound) and the ledger (failures)."""
    return _rows(docs, PARAGRAPHS, _paragraphs)


def read_styles(docs: DataFrame) -> DataFrame:
    """One row per style, with what it is based on; document defaults are the style "" at the end of every chain."""
    return sound(_rows(docs, STYLES, _styles))


def read_paragraphs(docs: DataFrame) -> DataFrame:
    return sound(parse_paragraphs(docs))


def read_runs(docs: DataFrame) -> DataFrame:
    return sound(_rows(docs, RUNS, _runs))


def read_relationships(docs: DataFrame) -> DataFrame:
    return sound(_rows(docs, RELATIONSHIPS, _relationships))


def read_list_levels(docs: DataFrame) -> DataFrame:
    return sound(_rows(docs, LEVELS, _levels))


def read_resources(entries: DataFrame) -> DataFrame:
    """Media and embedded objects with their hashes."""
    return entries.where(F.col("name").rlike(r"^word/(media|embeddings)/")).select("doc_id", "name", "sha256")


def safe_to_render(entries: DataFrame, relationships: DataFrame) -> DataFrame:
    """doc_id and safe: no macros or embedded objects, and only hyperlinks lead outside."""
    bad = entries.where(F.col("name").rlike(r"(?i)vbaProject|activeX|oleObject|/embeddings/")).select("doc_id")
    outside = (F.lower("mode") == "external") | F.col("target").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|\\\\)")
    bad = bad.union(relationships.where(outside & ~F.col("type").rlike("/hyperlink$")).select("doc_id")).distinct().withColumn("_bad", F.lit(True))
    return entries.select("doc_id").distinct().join(bad.hint("merge"), "doc_id", "left").select("doc_id", F.col("_bad").isNull().alias("safe"))


def relationship_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Relationships that are gone or whose type, target or mode changed."""
    keys = ["doc_id", "part", "id"]
    b = after.select(*keys, F.struct("type", "target", "mode").alias("_b")).hint("merge")
    return before.withColumn("_a", F.struct("type", "target", "mode")).join(b, keys, "left").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, F.when(F.col("_b").isNull(), "removed").otherwise("changed").alias("kind"))


def repeated_relationships(relationships: DataFrame) -> DataFrame:
    """Ids that occur more than once in a part: an error of the package."""
    return relationships.groupBy("doc_id", "part", "id").agg(F.count("*").alias("n")).where("n > 1")


def relationship_audit(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings of relationship_diff that no rule (doc_id, part, id) allows, and repeated ids afterwards."""
    keys = ["doc_id", "part", "id"]
    open_ = relationship_diff(before, after).join(allowed.select(*keys).distinct().hint("merge"), keys, "left_anti")
    return open_.union(repeated_relationships(after).select(*keys, F.lit("repeated").alias("kind")))


def level_audit(before: DataFrame, after: DataFrame, rules: DataFrame) -> DataFrame:
    """List levels (read_list_levels) that changed in more than the format and text their rule (doc_id, num_id, ilvl,
    fmt, lvl_text) gives; starts and lists stay as they were."""
    keys = ["doc_id", "num_id", "ilvl"]
    a = before.select(*keys, F.col("fmt").alias("fmt_a"), F.col("lvl_text").alias("text_a"), F.col("start").alias("start_a"), F.lit(1).alias("_a"))
    b = after.select(*keys, F.col("fmt").alias("fmt_b"), F.col("lvl_text").alias("text_b"), F.col("start").alias("start_b"), F.lit(1).alias("_b"))
    j = a.join(b.hint("merge"), keys, "full_outer").join(rules.select(*keys, "fmt", "lvl_text").hint("merge"), keys, "left")
    code = (
        F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "created").when(~F.col("start_a").eqNullSafe(F.col("start_b")), "start")
        .when(~F.col("fmt_b").eqNullSafe(F.coalesce("fmt", "fmt_a")), "format").when(~F.col("text_b").eqNullSafe(F.coalesce("lvl_text", "text_a")), "text")
    )
    return j.withColumn("code", code).where("code is not null").select(*keys, "code")
