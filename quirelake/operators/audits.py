"""Audits: secrets, paths, link targets, marks, fingerprints. Findings name the place and the rule, never the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.sequences import paragraphs

#: Rules of the secrets scan.
SECRETS = {
    "github-token": r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,}",
    "api-key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{24,}",
    "aws-access-key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}",
    "credential-url": r"(?i)(?:https?|postgres(?:ql)?|mysql|redis)://[^\s/:]+:[^\s/@]+@",
    "personal-path": r"/(?:Users|home)/[A-Za-z0-9._-]+/|[A-Za-z]:[\\/]Users[\\/][A-Za-z0-9._-]+[\\/]",
}
#: Credential assignments and placeholders, addresses and the domains that may be named, generated directories.
LITERAL = r"""(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret)\b\s*[=:]\s*["']([^"'\n]{8,})["']"""
PLACEHOLDER = r"(?i)example|placeholder|change.?me|your[_ -]|dummy|test|process\.env|os\.environ|\$\{|/path/to"
EMAIL = r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
ALLOWED_DOMAINS = ["example.com", "example.org", "example.net", "example.invalid", "users.noreply.github.com"]
GENERATED = ["node_modules", ".venv", "venv", ".local-runtime", "__pycache__", "dist", ".next", ".vinext", ".wrangler", "_CodeSignature"]
#: Directories and suffixes that are not imported, and files that are although their kind is not.
EXCLUDED_STARTS = ["scripts/fixtures/", "fixtures/", "outputs/", "output/", "qa/", "work/", "examples/acceptance-outputs/"]
EXCLUDED_SUFFIXES = ["log", "pid", "pem", "key", "p12", "pfx", "zip", "tar", "pyc"]
ALLOWED_ENV, ALLOWED_HOSTING = ".env.example", "hosting.example.json"
#: What a text must hold for each rule to be tried: cheap tests that spare almost all texts the patterns.
HINTS = {
    "github-token": ["gh", "github_pat_"], "api-key": ["sk-"], "aws-access-key": ["AKIA", "ASIA"], "private-key": ["PRIVATE KEY"], "jwt": ["eyJ"], "credential-url": ["://"],
    "personal-path": ["/Users/", "/home/", "\\Users", ":/Users"],
}


def secret_scan(docs: DataFrame, keys: list[str], text: str = "text", line: str = "para_idx") -> DataFrame:
    """keys, line and rule of each finding; one per line and rule, one per literal or address.

    Whole texts are tested for the few characters that a rule needs; only texts with one are cut into lines.
    """
    whole = F.col(text)
    marks = sorted({h for hints in HINTS.values() for h in hints} | {"@"})
    quick = F.lit(False)
    for mark in marks:
        quick = quick | whole.contains(mark)
    quick = quick | whole.rlike(r"(?i)key|token|passw|secret")
    lines = paragraphs(docs.where(whole.isNotNull() & quick).select(*keys, text), keys, text)
    text_ = F.col("text")
    any_of = lambda hints: [text_.contains(h) for h in hints]
    rules = []
    for name, pattern in SECRETS.items():
        first, *rest = any_of(HINTS[name])
        for other in rest:
            first = first | other
        rules.append(F.when(first & text_.rlike(pattern), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    each = lambda hint, pattern, bad, rule: F.when(hint, F.transform(F.filter(F.regexp_extract_all(text_, F.lit(pattern), F.lit(1)), bad), lambda _: F.lit(rule))).otherwise(none)
    literal = each(text_.rlike(r"""[=:]\s*["']"""), LITERAL, lambda v: ~v.rlike(PLACEHOLDER), "literal-credential-review")
    email = each(text_.contains("@"), EMAIL, lambda d: ~F.lower(d).isin(ALLOWED_DOMAINS), "personal-email-review")
    found = F.concat(*rules, literal, email)
    return lines.select(*keys, F.col("para_idx").alias(line), F.explode_outer(found).alias("rule")).where("rule is not null")


def path_audit(files: DataFrame, path: str = "path") -> DataFrame:
    """path and finding of files that are not to be imported: generated, env, hosting, fixture or suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    starts = F.lit(False)
    for s in EXCLUDED_STARTS:
        starts = starts | F.col(path).startswith(s)
    finding = (
        F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, GENERATED))), "generated")
        .when(name.startswith(".env") & (name != ALLOWED_ENV), "env")
        .when(F.col(path).startswith(".openai/") & (name != ALLOWED_HOSTING), "hosting")
        .when(starts, "fixture")
        .when(name.rlike(rf"^.+\.(?:{'|'.join(EXCLUDED_SUFFIXES)})$"), "suffix")
    )
    return files.withColumn("finding", finding).where("finding is not null").select(path, "finding")


def binaries_to_review(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Paths that a person must look at, as no text scan can: files that are not UTF-8, and parts of packages other than
    XML (as package!part). files: path, content (binary). entries: package_entries, with the package's path as doc_id."""
    plain = files.where(~F.col("path").endswith(".docx") & ~F.is_valid_utf8("content")).select("path")
    if entries is None:
        return plain
    parts = entries.where(F.col("problem").isNull() & ~F.col("name").rlike(r"\.(xml|rels)$") & ~F.col("name").endswith("/"))
    return plain.union(parts.select(F.concat_ws("!", "doc_id", "name")))


def link_targets(pages: DataFrame) -> DataFrame:
    """page_id and target of each href, without query and fragment."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.where("html is not null").select("page_id", F.explode_outer(found).alias("target")).where("target is not null").withColumn("target", F.regexp_replace("target", "[?#].*$", ""))


def dangling_targets(links: DataFrame, known: DataFrame) -> DataFrame:
    """Internal targets that no known path has, with how many links lead there. Links are counted before the join."""
    inner = links.where("target like '/%'").groupBy("target").agg(F.count("*").alias("links"))
    return inner.join(known.select(F.col("path").alias("target")).distinct().hint("merge"), "target", "left_anti")


def document_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, sha256 of the canonical fragments of its lines in order, without labelled lines, and n_lines of these.

    Row by row: lines are an array of the row, so no text is shuffled.
    """
    lines = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: T.label_value(x).isNull())
    rows = docs.where("text is not null").select("doc_id", lines.alias("_l")).where(F.size("_l") > 0)
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("_l", T.canonical_fragment), "").cast("binary"), 256).alias("fingerprint"), F.size("_l").cast("long").alias("n_lines"))


def duplicate_groups(fingerprints: DataFrame) -> DataFrame:
    """fingerprint, first doc_id, size and lines of each group of several."""
    return fingerprints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.sum("n_lines").alias("n_lines")).where("n > 1")


def uniform_damage(runs: DataFrame, doc: str, mark: Column, text: str = "text") -> DataFrame:
    """Per document with text: whether a mark covers every run that has some, how many runs it marks, and how many there are.

    Blank runs say nothing: a blank without the mark between marked runs does not hide the damage.
    """
    said = runs.where(F.col(text).rlike(r"(?U)\S"))
    return said.groupBy(doc).agg(F.bool_and(F.coalesce(mark, F.lit(False))).alias("uniform"), F.count_if(mark).alias("marked"), F.count("*").alias("runs"))


def mark_notes(runs: DataFrame, keys: list[str], doc: str, hidden: Column, struck: Column, text: str = "text") -> DataFrame:
    """keys and note (hidden, struck, hidden-and-struck) of each paragraph that keeps marked text. A mark that covers all
    of a document's text is damage and is no note."""
    said = runs.where(F.col(text).rlike(r"(?U)\S")).withColumns({"_h": F.coalesce(hidden, F.lit(False)), "_s": F.coalesce(struck, F.lit(False))})
    whole = said.groupBy(doc).agg(F.bool_and("_h").alias("_all_h"), F.bool_and("_s").alias("_all_s"))
    lines = said.groupBy(*dict.fromkeys([doc, *keys])).agg(F.bool_or("_h").alias("_h"), F.bool_or("_s").alias("_s")).where("_h or _s")
    j = lines.join(whole.hint("merge"), doc).withColumns({"_h": F.col("_h") & ~F.col("_all_h"), "_s": F.col("_s") & ~F.col("_all_s")})
    note = F.when(F.col("_h") & F.col("_s"), "hidden-and-struck").when(F.col("_h"), "hidden").when(F.col("_s"), "struck")
    return j.withColumn("note", note).where("note is not null").select(*keys, "note")


def noise_count(rows: DataFrame, keys: list[str], noisy: list[Column]) -> DataFrame:
    total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in noisy), F.lit(0))
    return rows.groupBy(*keys).agg(F.sum(total).cast("long").alias("noise"))


def prefix_join(rows: DataFrame, vocabulary: DataFrame, text: str, phrase: str, keys: list[str], words: bool = True) -> DataFrame:
    """The longest phrase that each text starts with: keys and phrase.

    Each text gives its prefixes of the lengths that phrases have, and these are joined as wholes, so a text meets one
    phrase of each length at most, however many share a first word. words: a phrase must end where a word does.
    """
    known = vocabulary.select(F.col(phrase).alias("_p")).where(F.length("_p") > 0).distinct()
    lengths = [r[0] for r in known.select(F.length("_p")).distinct().collect()]  # at most as many as the longest phrase has characters
    if not lengths:
        return rows.select(*keys, F.lit(None).cast("string").alias("phrase")).limit(0)
    ends = lambda n: F.length(text) >= n if not words else (F.length(text) == n) | ((F.length(text) > n) & F.substr(text, n + 1, F.lit(1)).rlike(r"[^\p{L}\p{N}_]"))
    own = F.filter(F.array(*map(F.lit, sorted(lengths))), ends)
    prefixes = F.transform(own, lambda n: F.substr(text, F.lit(1), n))
    cut = rows.select(*keys, F.explode_outer(prefixes).alias("_p")).where("_p is not null")
    return cut.join(known.hint("merge"), "_p").groupBy(*keys).agg(F.max_by("_p", F.length("_p")).alias("phrase"))


def union_findings(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first
