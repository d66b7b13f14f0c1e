"""What built-in functions cannot say: chunking, HTML, quoted mail, placeholders. Plain functions on texts, and their columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from kbforge.functions import chunking
from kbforge.functions.text import EMAIL, PHONE, SERIAL

CHUNK = "array<struct<text:string,section:string,kind:string>>"


def tail_of(text: str, n: int) -> str:
    """The last ``n`` characters, from behind their last sentence's end if that lies past their middle; a shorter text whole."""
    end = text[max(len(text) - n, 0) :]
    at = end.rfind(". ") if len(end) < len(text) else -1
    return end[at + 2 :] if at > len(end) // 2 else end


def estimated_tokens(text: str) -> int:
    return len(text) // 4


def sentences_tail(text: str, n: int, count: Callable[[str], int] = estimated_tokens) -> str:
    """Whole sentences from the end until they have ``n`` tokens; they stop before half as much again, but one comes always."""
    if count(text) <= n:
        return text
    parts = text.replace(".\n", ". ").split(". ")
    if len(parts) == 1:
        return text[max(len(text) - 5 * n, 0) :]
    kept: list[str] = []
    size = 0
    for part in filter(None, map(str.strip, reversed(parts))):
        sentence = part if part.endswith(".") else part + "."
        more = count(sentence)
        if kept and size + more > 1.5 * n:
            break
        kept.append(sentence)
        size += more
        if size >= n:
            break
    return " ".join(reversed(kept))


def chunk_paragraphs(text: str | None, tokens: int = 400, overlap: int = 50, whole: int = 200, count: Callable[[str], int] = estimated_tokens) -> list[str]:
    """Paragraphs packed up to ``tokens``; the next chunk begins with the last sentences of the one before.

    Texts up to ``whole`` tokens stay whole, and so do long paragraphs.
    """
    body = (text or "").strip()
    if not body:
        return []
    if count(body) <= whole:
        return [body]
    out: list[str] = []
    held = ""
    for para in filter(None, map(str.strip, body.split("\n\n"))):
        longer = f"{held}\n\n{para}" if held else para
        if held and count(longer) > tokens:
            out.append(held.strip())
            rest = sentences_tail(held, overlap, count)
            longer = f"{rest}\n\n{para}" if rest else para
        held = longer
    return [*out, held.strip()]


def chunk_plain(text: str | None, size: int = 1000, overlap: int = 100, separator: str = "\n\n") -> list[str]:
    """Paragraphs packed while they fit; the next chunk begins with the end of the last. Long paragraphs stay whole."""
    if not text or not text.strip():
        return []
    out: list[str] = []
    held = ""
    for para in (p.strip() for p in text.split(separator)):
        if not para:
            continue
        if held and len(held) + len(para) + len(separator) > size:
            out.append(held.strip())
            rest = tail_of(held, overlap)
            held = f"{rest}{separator}{para}" if rest else para
        else:
            held = f"{held}{separator}{para}" if held else para
    return out + ([held.strip()] if held else [])


_HEAD = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_BLOCK = re.compile(r"```(\w*)\n.*?```|(?:^\|.*\|[ \t]*\n)(?:^\|[ \t]*:?-{3,}.*\n)(?:^\|.*\|[ \t]*(?:\n|$))*", re.M | re.S)


def chunk_semantic(text: str | None, tokens: int = 400, overlap: int = 50, whole: int = 200, count: Callable[[str], int] = estimated_tokens) -> list[tuple[str, str | None, str]]:
    """``text, section, kind`` of each chunk of markdown. Short texts stay whole; sections are kept together where they fit
    one and a half chunks; code fences and tables are never cut."""
    body = (text or "").strip()
    if not body:
        return []
    if count(body) <= whole:
        return [(body, None, "complete")]
    heads = list(_HEAD.finditer(body))
    out: list[tuple[str, str | None, str]] = []
    if heads:
        if intro := body[: heads[0].start()].strip():
            out += _around_blocks(intro, "Introduction", tokens, overlap, whole, count)
        for head, after in zip(heads, [*heads[1:], None]):
            content = body[head.end() : after.start() if after else len(body)].strip()
            shown = f"{head[1]} {head[2].strip()}" + (f"\n\n{content}" if content else "")
            if count(shown) <= 1.5 * tokens:
                out.append((shown, head[2].strip(), "section"))
            else:
                out += _around_blocks(shown, head[2].strip(), tokens, overlap, whole, count)
        return out
    return _around_blocks(body, None, tokens, overlap, whole, count)


def _around_blocks(text: str, section: str | None, tokens: int, overlap: int, whole: int, count: Callable[[str], int]) -> list[tuple[str, str | None, str]]:
    out, at = [], 0
    for block in _BLOCK.finditer(text):
        out += [(t, section, "text") for t in chunk_paragraphs(text[at : block.start()], tokens, overlap, whole, count)]
        out.append((block[0].strip(), section, "code" if block[0].startswith("```") else "table"))
        at = block.end()
    return out + [(t, section, "text") for t in chunk_paragraphs(text[at:], tokens, overlap, whole, count)]


def chunk_support_case(text: str | None, tokens: int = 350, overlap: int = 50, whole: int = 200, count: Callable[[str], int] = estimated_tokens) -> list[tuple[str, str | None, str]]:
    """Sections at ``##``, those without content go, as does text before the first; short texts stay whole.

    Of a name given twice the first place and the last content that is not empty count.
    """
    body = (text or "").strip()
    if body and count(body) <= whole:
        return [(body, None, "complete")]
    heads = list(re.finditer(r"^##\s+(.+)$", body, re.M))
    spans = zip(heads, [*(h.start() for h in heads[1:]), len(body)])
    sections = {head[1].strip(): content for head, stop in spans if (content := body[head.end() : stop].strip())}
    if not sections:
        return [(t, None, "text") for t in chunk_paragraphs(body, tokens, overlap, whole, count)]
    out: list[tuple[str, str | None, str]] = []
    for name, content in sections.items():
        shown = f"## {name}\n{content}"
        out += [(shown, name, "section")] if count(shown) <= 1.5 * tokens else [(t, name, "text") for t in chunk_paragraphs(shown, tokens, overlap, whole, count)]
    return out


_SKIP, _VOID = {"script", "style", "nav", "aside", "header", "footer"}, {"br", "img", "meta", "link", "hr", "input"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.open: list[tuple[str, bool]] = []
        self.h1: list[str] = []
        self.title: list[str] = []
        self.og = ""
        self.rows: list[list[list[str]]] | None = None
        self.first: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta" and given.get("property") == "og:title":
            self.og = self.og or (given.get("content") or "")
        if tag in _VOID:
            return
        hidden = tag in _SKIP or any(w in (given.get("class") or "") for w in ("sidebar", "menu", "toc"))
        if tag in self.parts and tag not in self.first:
            self.first[tag] = len(self.open)
        self.open.append((tag, hidden))
        if tag == "table" and self.rows is None:
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append([])

    def handle_endtag(self, tag):
        names = [t for t, _ in self.open]
        if tag not in names:
            return
        at = len(names) - 1 - names[::-1].index(tag)
        del self.open[at:]
        for part, depth in self.first.items():
            if depth == at and tag == part:
                self.first[part] = -1
        if tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join([" ".join(c).replace("|", "\\|") for c in r] + [""] * (width - len(r))) + " |" for r in rows]
                self.take("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))

    def handle_data(self, data):
        piece = data.strip()
        if not piece:
            return
        tags = [t for t, _ in self.open]
        if "title" in tags:
            self.title.append(piece)
        if "h1" in tags:
            self.h1.append(piece)
        if self.rows and self.rows[-1] and not any(h for _, h in self.open):
            self.rows[-1][-1].append(piece)
        else:
            self.take(piece)

    def take(self, piece: str) -> None:
        if any(h for _, h in self.open) or any(t in ("head", "title") for t, _ in self.open):
            return
        for part, depth in self.first.items():
            if 0 <= depth < len(self.open):
                self.parts[part].append(piece)


def html_page(html: str | None) -> tuple[str, str]:
    """Main text (of the first article, else main, else body) and title of a page; malformed pages give what was read."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    text = next((" ".join(page.parts[p]) for p in ("article", "main", "body") if page.parts[p]), "")
    short = re.split(r"[|–—-]", " ".join(page.title))[0].strip()
    return text, " ".join(page.h1) or page.og or short or "Untitled"


#: Lines that begin a new message, a reply's head or a forwarded part, and a signature; case aside.
NEW_MESSAGE = (r"^-{3,}\s*Message\s*\d*\s*-{3,}$", r"^-{3,}\s*$")
REPLY_HEADS = (r"^On .+wrote:\s*$", r"^Le .+a écrit\s*:\s*$", r"^Am .+schrieb.+:\s*$", r"^From:\s*.+$")
SEPARATORS = (r"^-{3,}\s*(Original Message|Forwarded|Begin forwarded)", r"^_{3,}\s*$", r"^={3,}\s*$", r"^\*{3,}\s*$")
SIGNATURES = (
    r"^--\s*$", r"^(Best|Kind|Warm)?\s*regards?,?\s*$", r"^(Many\s+)?thanks?,?\s*$", r"^Cheers,?\s*$", r"^Sincerely,?\s*$", r"^Cordialement,?\s*$",
    r"^Mit freundlichen Grüßen,?\s*$", r"^Sent from my (iPhone|iPad|Android|Galaxy|Pixel)", r"^Envoyé de mon (iPhone|iPad)", r"^Get Outlook for",
)
_NEW, _HEADS, _CUTS, _SIGN = (re.compile("|".join(p), re.I) for p in (NEW_MESSAGE, REPLY_HEADS, SEPARATORS, SIGNATURES))


def clean_thread_quotes(text: str | None, signatures: bool = True) -> str:
    """A mail without quoted lines, reply heads and separators with what follows up to a blank line, and signatures.

    A signature ends at a reply's head or a new message; blank lines of a quote or a signature go with it.
    """
    out, quoted, signed, headed = [], False, False, False
    for line in (text or "").split("\n"):
        bare = line.strip()
        if _NEW.match(bare):
            quoted = signed = headed = False
            out.append(line)
            continue
        if not bare:
            if not quoted and not signed and not headed:
                out.append(line)
            headed = headed and (quoted or signed)
            continue
        quoted = bare.startswith(">")
        if quoted:
            continue
        if signatures and not signed and _SIGN.match(bare):
            signed = True
        elif _HEADS.match(bare):
            headed, signed = True, False
        elif not signed and _CUTS.match(bare):
            headed = True
        elif not signed and not headed:
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def anonymize(texts: list[str | None], own_domain: str = "") -> list[str]:
    """A thread's texts with serials, addresses and phone numbers as placeholders numbered by first appearance."""
    seen: dict[str, dict[str, str]] = {"SERIAL": {}, "EMAIL": {}, "PHONE": {}}

    def serial(m: re.Match) -> str:
        return seen["SERIAL"].setdefault(m[0].upper(), f"[SERIAL:{m[2].upper()}-{len(seen['SERIAL']) + 1}]")

    def email(m: re.Match) -> str:
        if own_domain and m[0].lower().endswith("@" + own_domain):
            return m[0]
        return seen["EMAIL"].setdefault(m[0].lower(), f"[EMAIL-{len(seen['EMAIL']) + 1}]")

    def phone(m: re.Match) -> str:
        if sum(c.isdigit() for c in m[0]) < 7:
            return m[0]
        return seen["PHONE"].setdefault(m[0], f"[PHONE-{len(seen['PHONE']) + 1}]")

    out = []
    for text in texts:
        text = re.sub(SERIAL, serial, text or "")
        text = re.sub(EMAIL, email, text)
        out.append(re.sub(PHONE, phone, text))
    return out


def pii_parts(text: str | None, own_domain: str = "") -> tuple[list[tuple[str, str, str]], str]:
    """A text as ``literal, label, key`` up to each placeholder, and the literal behind the last; as ``anonymize`` finds them."""

    def cut(literals: list[tuple[str, str, str]], pattern: str, named) -> list[tuple[str, str, str]]:
        out = []
        for literal, label, key in literals:
            at = 0
            for m in re.finditer(pattern, literal):
                if found := named(m):
                    out.append((literal[at : m.start()], *found))
                    at = m.end()
            out.append((literal[at:], label, key))
        return out

    parts = cut([(text or "", "", "")], SERIAL, lambda m: (f"SERIAL:{m[2].upper()}", m[0].upper()))
    parts = cut(parts, EMAIL, lambda m: None if own_domain and m[0].lower().endswith("@" + own_domain) else ("EMAIL", m[0].lower()))
    parts = cut(parts, PHONE, lambda m: ("PHONE", m[0]) if sum(c.isdigit() for c in m[0]) >= 7 else None)
    return parts[:-1], parts[-1][0]


#: Characters of the texts that a task holds as Python's, about.
SLICE_CHARS = 1_000_000


def text_slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """The texts in lists of about so many characters; a longer text comes alone."""
    part: list[str | None] = []
    size = 0
    for one in texts:
        text = one.as_py()
        if part and size + len(text or "") > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def text_column(text: Column, kind: str, one: Callable[[str | None], object]) -> Column:
    """``one`` of each text, as ``kind``. A batch stays in Arrow and is read and given back in slices, so a task's memory hangs
    neither on the batch's texts nor on what is made of them."""
    made = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.array([one(t) for t in part], made)

    return F.arrow_udf(run, kind)(text)


def apply_fixes(text: str | None, fixes: list[tuple[str, str]]) -> tuple[str, int]:
    """Each fix in order at its first occurrence, case aside; the text and how many were applied."""
    text, n = text or "", 0
    for old, new in fixes:
        at = text.lower().find(old.lower()) if old else -1
        if at >= 0:
            text, n = text[:at] + new + text[at + len(old) :], n + 1
    return text, n


def fixed_column(text: Column, fixes: Column) -> Column:
    """``text, applied`` by a list of fixes ``a, b``, as ``apply_fixes`` gives them, by built-in functions."""

    def step(held: Column, fix: Column) -> Column:
        def put(at: Column) -> Column:
            new = F.concat(F.substring(held["text"], F.lit(1), at - 1), fix["b"], F.substring(held["text"], at + F.length(fix["a"]), F.length(held["text"])))
            return F.when((fix["a"] != "") & (at > 0), F.struct(new.alias("text"), (held["applied"] + 1).alias("applied"))).otherwise(held)

        return chunking.bound(F.instr(F.lower(held["text"]), F.lower(fix["a"])), put)

    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("applied"))
    return F.aggregate(F.coalesce(fixes, F.array().cast("array<struct<a:string,b:string>>")), start, step)


def chunk_column(text: Column, mode: str, **options) -> Column:
    """Chunks as an array: ``mode`` is plain, paragraphs, semantic or support_case.

    All but markdown's are built-in folds (``chunking``), unless a ``count`` of tokens of one's own is given.
    """
    if "count" not in options and mode in ("plain", "paragraphs", "support_case"):
        return chunking.support_case(text, **options) if mode == "support_case" else chunking.texts(getattr(chunking, mode)(text, **options))
    how = {"plain": lambda t: [(c, None, "text") for c in chunk_plain(t, **options)], "paragraphs": lambda t: [(c, None, "text") for c in chunk_paragraphs(t, **options)], "semantic": lambda t: chunk_semantic(t, **options), "support_case": lambda t: chunk_support_case(t, **options)}[mode]

    return text_column(text, CHUNK, lambda t: [{"text": a, "section": b, "kind": c} for a, b, c in how(t)])


def sender_of(sender: str, original: str, reply_to: str, own_domain: str) -> tuple[str, str, bool]:
    """``name, address, staff`` of a mail: the original sender counts first, then a reply address from outside, then the sender.

    A group's `` via `` and what follows is no part of a name.
    """

    def named(value: str) -> str:
        name = value.split("<")[0].strip().strip('"') if "<" in value else ""
        at = name.lower().find(" via ")
        return name[:at].strip() if at > 0 else name

    inner = lambda value: value.split("<")[1].split(">")[0] if "<" in value and ">" in value else value
    if original:
        name, address = named(sender), original
    elif reply_to and "@" + own_domain not in reply_to.lower():
        own = reply_to.split("<")[0].strip().strip('"') if "<" in reply_to and ">" in reply_to else ""
        name, address = own or named(sender), inner(reply_to)
    else:
        name, address = (named(sender), inner(sender)) if "<" in sender and ">" in sender else ("", sender)
    return name, address, any(own_domain.split(".")[0] in part.lower() for part in (address, original, sender))


def sender_column(sender: Column, original: Column, reply_to: Column, own_domain: str) -> Column:
    """A missing sender counts as ``Unknown``, other missing heads as empty."""

    @F.pandas_udf("name string, address string, staff boolean")
    def run(senders: pd.Series, originals: pd.Series, replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sender_of(*row, own_domain) for row in zip(senders, originals, replies)], columns=["name", "address", "staff"])

    return run(F.coalesce(sender, F.lit("Unknown")), F.coalesce(original, F.lit("")), F.coalesce(reply_to, F.lit("")))


def html_column(html: Column) -> Column:
    return text_column(html, "struct<text:string,title:string>", lambda t: dict(zip(("text", "title"), html_page(t))))
