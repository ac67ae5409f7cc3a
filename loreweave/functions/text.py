"""Scalar functions of texts, paths and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII letters, digits or underscores and anything else, also beside letters of unspaced scripts.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
WORD = r"([\p{L}\p{N}_]{3,})"


def words(text: Column) -> Column:
    """Search words: runs of three or more letters, digits or underscores, lower case, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a plain word in an already lower-cased text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("bigint")


def lower_score(low: Column, keywords: list[str]) -> Column:
    return sum((occurrences(low, k) for k in keywords), F.lit(0).cast("bigint"))


def keyword_score(text: Column, keywords: list[str]) -> Column:
    return lower_score(F.lower(text), keywords)


def first_line_with(text: Column, keywords: list[str], most: int = 160) -> Column:
    """The first line that holds one of the words, trimmed and cut."""
    hit = F.filter(F.split(text, r"\r?\n"), lambda s: F.lower(s).rlike("|".join(keywords)))
    return F.substring(F.trim(F.try_element_at(hit, F.lit(1))), 1, most)


def plain_path(path: Column) -> Column:
    """A path with forward slashes only, without empty and leading dot segments."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./|/)+", "/"), r"^(\./)+", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(plain_path(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def page_slug(path: Column) -> Column:
    """Path-qualified slug: folders joined by colons, without the file ending."""
    return F.replace(F.regexp_replace(F.regexp_replace(plain_path(path), r"^wiki/", ""), r"\.md$", ""), F.lit("/"), F.lit(":"))


def slugify(text: Column, most: int = 60, fallback: str = "note") -> Column:
    """Kebab-case slug: other signs become a hyphen, cut, stripped again, with a fallback."""
    kebab = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.regexp_replace(kebab, "^-+|-+$", ""), 1, most), "-+$", ""), F.lit("")), F.lit(fallback))


def duration_seconds(text: Column) -> Column:
    """Seconds of "1h 12m", "4m 30s", "13s"; anything else is 0."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+)\s*{unit}", 1), F.lit("")).cast("int"), F.lit(0))
    whole = F.coalesce(text.rlike(r"^\s*(\d+\s*h)?\s*(\d+\s*m)?\s*(\d+\s*s)?\s*$"), F.lit(False))
    return F.when(whole, part("h") * 3600 + part("m") * 60 + part("s")).otherwise(F.lit(0))


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return (
        F.when(seconds.isNull() | (seconds < 0), "0s").when(seconds < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))).otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    )


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(3.5)).cast("bigint")


def front_matter(text: Column) -> Column:
    """The header between the leading dashes, empty where there is none."""
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)


def header_field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}:\s*(.*?)\s*$", 1), F.lit(""))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n*", "")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")
