"""Text columns: cleaning, extraction and short forms, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Patterns and what they become, in order.
TERM_RULES: tuple[tuple[str, str], ...] = ((r"(?i)\bRIO[-\s]?Live\b", "RIO +LAN"), (r"(?i)\bRIO\s*\+\s*WAN\s+Live\b", "RIO +LAN"))
#: Patterns of personal data.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?:\+\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
SERIAL = r"(?i)\b(CY-)([A-Z][A-Z0-9]{1,3})(-\d{1,3}-\d{1,3})\b"
DOCS_HOST = "https://docs.example.com/"


def term_transforms(text: Column, rules=TERM_RULES) -> Column:
    for pattern, becomes in rules:
        text = F.regexp_replace(text, pattern, becomes)
    return text


def strip_html_fast(html: Column, most: int = 8000) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def snippet(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def answer_preview(text: Column, most: int = 240, least: int = 120) -> Column:
    """The text without leading headings and bullets in one line, cut at the last sentence past ``least`` or word; empty gives null."""
    out = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^(?:[^\S\n]*#[^\n]*(?:\n|$))+", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[>\-*•\s]+", ""), r"\s+", " "))
    head = F.substring(out, 1, most)
    sentence = F.regexp_extract(head, r"^(.*[.!?]) ", 1)
    word = F.regexp_extract(head, r"^(.*) ", 1)
    cut = F.when(F.length(sentence) > least, F.concat(sentence, F.lit(" …"))).when(word != "", F.concat(word, F.lit("…"))).otherwise(F.concat(head, F.lit("…")))
    return F.when(out == "", F.lit(None)).when(F.length(out) <= most, out).otherwise(cut)


def normalize_doc_url(url: Column, host: str = DOCS_HOST) -> Column:
    """The url with ``docs/`` after the docs host; null gives an empty text, other hosts stay."""
    rest = F.substring(url, F.lit(len(host) + 1), F.length(url))
    return F.when(url.isNull(), "").when(F.startswith(url, F.lit(host)) & ~F.startswith(rest, F.lit("docs/")), F.concat(F.lit(host + "docs/"), rest)).otherwise(url)


def relative_time(value: Column, as_of: Column) -> Column:
    s = F.timestamp_diff("SECOND", value, as_of)
    days = F.floor(s / 86400)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(value.isNull(), "")
        .when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(days < 7, plural(days, "day"))
        .when(days < 35, plural(F.floor(days / 7), "week"))
        .when(days < 360, plural(F.floor(days / 30), "month"))
        .otherwise(F.date_format(value, "yyyy-MM-dd"))
    )


def found_pii(text: Column) -> tuple[Column, Column, Column]:
    """Arrays of distinct serials (upper case), e-mail addresses (lower case) and phone numbers (seven digits or more)."""
    phones = F.filter(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 7)
    serials = F.transform(F.regexp_extract_all(text, F.lit(SERIAL), F.lit(0)), F.upper)
    emails = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)
    return F.array_distinct(serials), F.array_distinct(emails), F.array_distinct(phones)


def markdown_title(text: Column) -> Column:
    """The first heading of the first level, else of the second, else null."""
    first = lambda mark: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{mark}\s+(.+)$", 1)), F.lit(""))
    return F.coalesce(first("#"), first("##"))


def parse_mail_date(value: Column) -> Column:
    rfc = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(value))


def parse_model_json(answer: Column, schema: str) -> Column:
    """The object in a model's answer: the whole, a fenced block, or from the first brace to the last; else null."""
    tries = [answer, F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(answer, r"(?s)(\{.*\})", 1)]

    def first(text: Column) -> Column:
        one = F.from_json(text, schema, {"mode": "PERMISSIVE"})
        many = F.get(F.from_json(text, f"array<{schema}>"), F.lit(0))
        kept = F.when(F.startswith(F.trim(text), F.lit("{")), one).when(F.startswith(F.trim(text), F.lit("[")), many)
        return F.when(F.to_json(kept) != "{}", kept)

    return F.coalesce(*map(first, tries))


def query_variants(raw: Column, rewritten: Column) -> tuple[Column, Column]:
    """The normalised form, only where it differs, and the text that is searched for."""
    base = F.coalesce(rewritten, raw)
    changed = term_transforms(base)
    return F.when(changed != base, changed), changed


def uuid5_dns(name: Column) -> Column:
    """The version 5 UUID of a name in the DNS name space."""
    space = "6ba7b8109dad11d180b400c04fd430c8"
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
