"""Clause functions. Vocabularies are parameters: lists of phrases, as policy_tables gives them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import LIST_MARKER, UNICODE, squeeze

#: Lines that name an organ before the clauses.
SUBJECT_LINES = (r"^The [A-Z][A-Za-z'’.\-]*(?: (?:[A-Z][A-Za-z'’.\-]*|of|on|for|and|the|in|to|de|\([A-Z]+\))){0,9},$", r"^[一-鿿·（）()]{0,28}(?:大会|理事会|委员会|议会|组织|会议|法院)[，,]$")
PREFIX = r"(?i)^(?:the\s+|联合国)"
#: What a clause is by default in each type, and how sure that is.
DEFAULTS = {"working-paper": ("body", 0.72), "draft-directive": ("operative", 0.72), "friendly-amendment": ("operative", 0.72), "unfriendly-amendment": ("operative", 0.72)}


def starts_with_any(text: Column, phrases: list[str]) -> Column:
    """Whether the text starts with one of the phrases, whatever its case."""
    if not phrases:
        return F.lit(False)
    if all(c.isascii() or c.lower() == c.upper() for p in phrases for c in p):
        return text.rlike(f"^ *(?:{'|'.join(map(_any_case, phrases))})")
    low = F.lower(F.ltrim(text))
    return reduce(or_, [F.startswith(low, F.lit(p.lower())) for p in phrases])


def _any_case(phrase: str) -> str:
    """A pattern of the texts that begin with the phrase once they are lower-cased: letters, and the Kelvin sign and the
    dotted capital I (which becomes i and a mark) where they do."""
    last = len(phrase) - 1
    extra = lambda i, c: "\u212a" if c == "k" else "\u0130" if c == "i" and i == last else ""
    return "".join(f"[{c}{c.upper()}{extra(i, c)}]" if "a" <= c <= "z" else re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", c) for i, c in enumerate(phrase.lower()))


def longest_phrase(text: Column, phrases: list[str], whole_words: bool = True) -> Column:
    """struct<phrase, start, length> of the longest phrase that stands at the start, behind the list marker; or null."""
    marker = F.regexp_extract(text, UNICODE + LIST_MARKER, 0)
    body = F.substr(text, F.length(marker) + 1)
    fits = lambda p: F.startswith(F.lower(body), F.lower(p)) & (~F.substr(body, F.length(p) + 1, F.lit(1)).rlike(r"[A-Za-z0-9_]") if whole_words else F.lit(True))
    found = F.get(F.filter(F.array(*[F.lit(p) for p in sorted(phrases, key=len, reverse=True)]), fits), 0)
    return F.when(found.isNotNull(), F.struct(F.substr(body, F.lit(1), F.length(found)).alias("phrase"), F.length(marker).alias("start"), F.length(found).alias("length")))


def classify_clause(text: Column, document_type: str, preambulatory: list[str], operative: list[str], subject_seen: Column | None = None) -> Column:
    """struct<kind, confidence>: by the opening verb, else by the document type."""
    kind, sure = DEFAULTS.get(document_type, ("body", 0.8))
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    out = F.when(starts_with_any(text, preambulatory), pair("preambulatory", 0.94)).when(starts_with_any(text, operative), pair("operative", 0.94))
    if document_type == "draft-resolution" and subject_seen is not None:
        out = out.when(F.coalesce(subject_seen, F.lit(False)), pair("unknown", 0.35))
    return out.otherwise(pair(kind, sure))


def is_subject_line(text: Column, verbs: list[str]) -> Column:
    return (text.rlike(SUBJECT_LINES[0]) | text.rlike(SUBJECT_LINES[1])) & ~starts_with_any(text, verbs)


def without_commas(text: Column) -> Column:
    """The text without final commas, also those before a last line break."""
    return F.when(F.contains(text, F.lit(",")) | F.contains(text, F.lit("，")), F.regexp_replace(text, "[，,]+$", "")).otherwise(text)


def ends_in_comma(line: Column) -> Column:
    return F.when(line.endswith(","), True).otherwise(line.endswith("，"))


def bare(line: Column) -> Column:
    """A trimmed line without final commas, trimmed again."""
    return F.when(ends_in_comma(line), squeeze(without_commas(line))).otherwise(line)


def without_prefix(name: Column) -> Column:
    """The name of an organ without its article or prefix; few begin like one and need the pattern."""
    begin = F.substr(name, F.lit(1), F.lit(1))
    return F.when(begin.isin("t", "T", "联"), F.regexp_replace(name, PREFIX, "")).otherwise(name)


def bare_organ(text: Column) -> Column:
    return F.regexp_replace(squeeze(without_commas(squeeze(text))), PREFIX, "")


def organ_name(text: Column) -> Column:
    return F.lower(bare_organ(text))


def is_committee_subject(text: Column, committee: Column) -> Column:
    """Whether an organ line names the committee, apart from an article or a prefix."""
    return text.rlike("[，,]\\s*$") & (organ_name(text) == organ_name(committee)) & (organ_name(text) != "")


def country_field_value(text: Column) -> Column:
    """Value behind a country label, the bare text of an unlabelled line, null for other labels."""
    from quirelake.functions.text import label_value

    found = label_value(text)
    return F.when(found.isNull(), squeeze(text)).when(found["key"] == "country", found["value"])
