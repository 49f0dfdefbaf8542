"""Functions on titles and closing blocks of treaties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import squeeze

#: How closing lines are cut into tokens, which tokens are labels, and what a label is made of.
GAPS = {"zh": r"[\s　]+", "en": r"\t+|\s{2,}|　+"}
LABEL = {"zh": "代表[:：]?$", "en": r"(?i)^(?:Representative of|On behalf of|For)\b|\bRepresentative[:：]?$"}
NEW_LABEL = {"zh": "%s代表", "en": "Representative of %s"}


def signature_tokens(text: Column, language: str) -> Column:
    return F.filter(F.split(squeeze(text), GAPS[language]), lambda t: t != "")


def label_tokens(text: Column, language: str) -> Column:
    """The tokens of a line all of whose tokens are labels, or null."""
    tokens = signature_tokens(text, language)
    return F.when((F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(LABEL[language])), tokens)


def label_party(label: Column, language: str) -> Column:
    """A label without its wording: the party."""
    if language == "zh":
        return F.regexp_replace(label, "代表[:：]?$", "")
    return F.regexp_replace(F.regexp_replace(label, r"(?i)^(?:Representative of|On behalf of|For)\s+", ""), r"(?i)\s*Representative[:：]?$", "")


def party_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(squeeze(value), r"(?i)^the\s+", ""), r"\s+", " "))


def party_label(party: Column, language: str) -> Column:
    return F.format_string(NEW_LABEL[language], party)


def join_names(names: Column, language: str) -> Column:
    """Names as a list in a sentence."""
    if language == "zh":
        return F.when(F.size(names) > 1, F.concat(F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), "、"), F.lit("和"), F.element_at(names, -1))).otherwise(F.array_join(names, ""))
    return F.when(F.size(names) > 2, F.concat(F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "), F.lit(" and "), F.element_at(names, -1))).otherwise(F.array_join(names, " and "))


def treaty_title(word: str, parties: Column, subject: Column, language: str) -> Column:
    """A title line from its word, parties and subject."""
    if language == "zh":
        return F.concat(join_names(parties, "zh"), F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit("关于"), subject, F.lit("的"))).otherwise(""), F.lit(word))
    return F.concat(F.lit(f"{word} between "), join_names(parties, "en"), F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit(" on "), subject)).otherwise(""))
