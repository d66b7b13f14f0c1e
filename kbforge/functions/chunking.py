"""Chunks of texts as columns: paragraphs are packed by a fold, so no text leaves the JVM. Twins of the chunkers in ``helpers``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What Python's ``strip`` takes away.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def estimated(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def _parts(text: Column, separator: str) -> Column:
    """The stripped parts of a text that are not empty."""
    return F.filter(F.transform(F.split(text, re.escape(separator) if separator.strip() else separator, -1), strip), lambda p: p != "")


def tail_of(text: Column, n: int) -> Column:
    def cut(end: Column) -> Column:
        from_end = F.instr(F.reverse(end), F.lit(" ."))
        good = (from_end > 0) & (F.length(end) - from_end - 1 > F.floor(F.length(end) / 2))
        return F.when(good, F.substring(end, F.length(end) - from_end + 2, F.length(end))).otherwise(end)

    return F.when(F.length(text) <= n, text).otherwise(bound(F.right(text, F.lit(n)), cut))


def sentences_tail(text: Column, n: int) -> Column:
    def step(held: Column, sentence: Column) -> Column:
        size = held["size"] + estimated(sentence)
        full = held["done"] | ((held["kept"] != "") & (size > 1.5 * n))
        kept = F.when(full, held["kept"]).when(held["kept"] == "", sentence).otherwise(F.concat(sentence, F.lit(" "), held["kept"]))
        return F.struct(kept.alias("kept"), F.when(full, held["size"]).otherwise(size).alias("size"), (full | (size >= n)).alias("done"))

    def whole(parts: Column) -> Column:
        sentences = F.transform(F.filter(F.transform(parts, strip), lambda p: p != ""), lambda p: F.when(F.endswith(p, F.lit(".")), p).otherwise(F.concat(p, F.lit("."))))
        start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("done"))
        return F.when(F.size(parts) == 1, F.right(text, F.lit(5 * n))).otherwise(F.aggregate(F.reverse(sentences), start, step, lambda held: held["kept"]))

    parts = F.split(F.replace(text, F.lit(".\n"), F.lit(". ")), r"\. ", -1)
    return F.when(estimated(text) <= n, text).otherwise(bound(parts, whole))


def _packed(paras: Column, separator: str, full: Callable[[Column, Column], Column], rest: Callable[[Column], Column]) -> Column:
    """Paragraphs joined while ``full(held, paragraph)`` is false; a new chunk begins with the ``rest`` of the last."""

    def step(state: Column, para: Column) -> Column:
        held = state["held"]
        over = (held != "") & full(held, para)
        joined = lambda before: F.when(before != "", F.concat(before, F.lit(separator), para)).otherwise(para)
        out = F.when(over, F.concat(state["out"], F.array(strip(held)))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.when(over, bound(rest(held), joined)).otherwise(joined(held)).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return F.aggregate(paras, start, step, lambda s: F.when(s["held"] != "", F.concat(s["out"], F.array(strip(s["held"])))).otherwise(s["out"]))


def plain(text: Column, size: int = 1000, overlap: int = 100, separator: str = "\n\n") -> Column:
    over = lambda held, para: F.length(held) + F.length(para) + len(separator) > size
    return _packed(_parts(F.coalesce(text, F.lit("")), separator), separator, over, lambda held: tail_of(held, overlap))


def paragraphs(text: Column, tokens: int = 400, overlap: int = 50, whole: int = 200) -> Column:
    over = lambda held, para: F.floor((F.length(held) + 2 + F.length(para)) / 4) > tokens
    none = F.array().cast("array<string>")

    def packed(body: Column) -> Column:
        return F.when(body == "", none).when(estimated(body) <= whole, F.array(body)).otherwise(_packed(_parts(body, "\n\n"), "\n\n", over, lambda held: sentences_tail(held, overlap)))

    return bound(strip(F.coalesce(text, F.lit(""))), packed)


def chunk(text: Column, section: Column, kind: str) -> Column:
    return F.struct(text.alias("text"), section.cast("string").alias("section"), F.lit(kind).alias("kind"))


def texts(found: Column) -> Column:
    return F.transform(found, lambda t: chunk(t, F.lit(None), "text"))


#: Stand before a heading's name and before what follows it; texts are freed of them first.
_OPEN, _CLOSE = "\x01", "\x02"


def support_case(text: Column, tokens: int = 350, overlap: int = 50, whole: int = 200) -> Column:
    def cut(body: Column) -> Column:
        marked = F.regexp_replace(body, rf"(?md)^##{SPACE}+(.+)$", f"{_OPEN}$1{_CLOSE}")
        named = F.transform(F.filter(F.split(marked, _OPEN, -1), lambda s, i: i > 0), lambda s: F.split(s, _CLOSE, 2))
        filled = F.filter(F.transform(named, lambda s: F.struct(strip(s[0]).alias("name"), strip(s[1]).alias("content"))), lambda s: s["content"] != "")

        def shown(sections: Column) -> Column:
            def one(name: Column) -> Column:
                last = F.element_at(F.filter(sections, lambda s: s["name"] == name), -1)["content"]
                return bound(F.concat(F.lit("## "), name, F.lit("\n"), last), lambda t: F.when(estimated(t) <= 1.5 * tokens, F.array(chunk(t, name, "section"))).otherwise(F.transform(paragraphs(t, tokens, overlap, whole), lambda p: chunk(p, name, "text"))))

            several = F.flatten(F.transform(F.array_distinct(F.transform(sections, lambda s: s["name"])), one))
            return F.when(F.size(sections) == 0, texts(paragraphs(body, tokens, overlap, whole))).otherwise(several)

        return F.when((body != "") & (estimated(body) <= whole), F.array(chunk(body, F.lit(None), "complete"))).otherwise(bound(filled, shown))

    return bound(strip(F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "")), cut)
