"""Secret scans with linked parts of credentials, in DataFrame operations only.

Strong finds are reported by themselves: ``assign`` (a named secret with a value), ``access`` (an access identifier) and
``hex`` (a long hexadecimal run). Weak candidates are reported only with the parts that complete them: a ``key``
(40 characters of base64, as secret keys have) within ``SCOPE`` code points of an access identifier, and an
``endpoint`` (a url's scheme and host) within ``SCOPE`` of an access identifier and of a secret (``assign`` or a
reported ``key``). Scopes are linked by an interval join: parts meet in equi-joined cells as wide as the scope.

Spans are in code points, end exclusive; a span of a kind never overlaps another of its kind, kinds may overlap. Spark has
no match positions, so they are summed from the pieces between the matches, and only for texts that have one.

Null texts count as empty. Rows are linked by id and a hash of the text: repeated rows get equal results each, rows that
share an id are scanned apart, null ids are kept. An empty table gives no rows; other columns are ignored by ``scan``
and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kbforge.functions.storage import materialize

#: Kind, pattern, group whose length counts, least length. The order of the kinds breaks ties of position.
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The weak candidates, of the same form.
WEAK: tuple[tuple[str, str, int, int], ...] = (
    ("key", r"[A-Za-z0-9+/]+", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+", 0, 10),
)
KEY_CHARS = 40
#: Code points between the nearest ends of two parts of one credential, at most.
SCOPE = 200

MARK = "[SECRET]"
_BLOCK = 256
_SPAN = "array<struct<start:int,end:int>>"
NAMES = [k for k, *_ in KINDS + WEAK]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Running sums of an array, each before its element; in blocks, so that long arrays cost no square of their length."""

    def within(block: Column, base: Column) -> Column:
        first = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def sums(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, n: x + n))
        return F.flatten(F.zip_with(blocks, within(totals, F.lit(0)), within))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
    return _let(lengths, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(_let(cut(a), sums)))


def _spans(text: Column, kind: tuple[str, str, int, int]) -> Column:
    """``start, end`` of the finds of a kind, leftmost and non-overlapping."""
    name, pattern, group, least = kind
    screen = pattern
    if pattern.startswith("["):
        # Runs below the least length are no finds, and a longer run is found whole.
        screen = f"{pattern[:-1]}{{{least}}}"
        pattern = f"{pattern[:-1]}{{{least},}}+"

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.transform(found, F.length)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), sizes, lambda g, n: g + n)
        counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
        rows = F.arrays_zip(_running(steps).alias("a"), steps.alias("s"), sizes.alias("n"), counted.alias("c"))
        enough = (lambda z: z["c"] == KEY_CHARS) if name == "key" else (lambda z: z["c"] >= least)
        return F.transform(F.filter(rows, enough), lambda z: F.struct((z["a"] + z["s"] - z["n"]).alias("start"), (z["a"] + z["s"]).alias("end")))

    none = F.array().cast(_SPAN)
    return F.when(text.rlike(screen), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def _has_weak(text: Column) -> Column:
    """Whether a text has an access identifier and a weak candidate."""
    return text.contains("AKIA") & text.rlike(KINDS[1][1]) & (text.rlike("[A-Za-z0-9+/]{40}") | text.rlike(WEAK[1][1]))


def _cells(parts: DataFrame, reach: int) -> DataFrame:
    """A row for each cell, as wide as the scope, that a part and ``reach`` on both sides touch."""
    lo, hi = F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") + reach) / SCOPE)
    return parts.withColumn("cell", F.explode(F.sequence(lo, hi)))


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The ``parts`` within ``SCOPE`` of one of ``others`` in the same text."""
    a, b = _cells(parts, 0).alias("a"), _cells(others, SCOPE).alias("b")
    same = (F.col("a._id") == F.col("b._id")) & (F.col("a._h") == F.col("b._h")) & (F.col("a.cell") == F.col("b.cell"))
    gap = F.greatest(F.col("a.start") - F.col("b.end"), F.col("b.start") - F.col("a.end"))
    return a.join(b, same & (gap <= SCOPE), "left_semi").drop("cell").distinct()


def linked(docs: DataFrame) -> DataFrame:
    """``_id, _h`` and the reported weak spans (``key``, ``endpoint``) of the texts that have some."""
    text = F.col("text")
    rows = docs.filter(_has_weak(text)).select(*_identity(), "text").distinct()

    def tagged(kind: tuple) -> Column:
        return F.transform(_spans(text, kind), lambda s: F.struct(F.lit(kind[0]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = rows.select("_id", "_h", F.explode(F.concat(*map(tagged, KINDS + WEAK))).alias("p"))
    parts = materialize(found.select("_id", "_h", "p.*"), "credential-parts")
    access = parts.filter("kind = 'access'")
    keys = _near(parts.filter("kind = 'key'"), access)
    ends = _near(_near(parts.filter("kind = 'endpoint'"), access), parts.filter("kind = 'assign'").unionByName(keys))
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))).alias(k)
    return keys.unionByName(ends).groupBy("_id", "_h").agg(pick("key"), pick("endpoint"))


def _identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id"), F.xxhash64("text").alias("_h")]


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, others) with a column of spans for each kind. Texts without weak candidates stay in place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = {k[0]: _spans(text, k) for k in KINDS}
    weak = F.coalesce(_has_weak(F.col("text")), F.lit(False))
    none = F.array().cast(_SPAN)
    plain = docs.filter(~weak).withColumns(strong | {k[0]: none for k in WEAK})
    rest = docs.filter(weak).withColumns(strong).withColumns(dict(zip(("_id", "_h"), _identity())))
    more = linked(docs)
    joined = rest.join(more, ["_id", "_h"], "left").withColumns({k[0]: F.coalesce(k[0], none) for k in WEAK}).drop("_id", "_h")
    return plain.unionByName(joined)


def _listed(kinds: list[str]) -> Column:
    def tagged(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(NAMES.index(kind)).alias("order"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    return F.array_join(F.transform(F.array_sort(F.concat(*map(tagged, kinds))), lambda s: s["name"]), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` of each document."""
    rows = with_spans(docs.select("doc_id", "text"))
    base = [k[0] for k in KINDS]
    listed = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), _listed(base).alias("base"), _listed(NAMES).alias("spans"), (F.size("key") + F.size("endpoint")).cast("long").alias("n_linked"))
    return listed.select("doc_id", *(f"n_{k}" for k in base), F.sha2("base", 256).alias("base_sha256"), "spans", "n_linked")


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """All rows and columns of ``docs``; reported spans of the text are replaced by ``mark``, touching ones by one.

    ``n_chars``, where there is such a column, follows the text.
    """
    # All columns but the two that are read stand under other names while the helpers are about.
    plain = docs.toDF(*(c if c.lower() in ("doc_id", "text") else f"_kept{i}" for i, c in enumerate(docs.columns)))
    rows = with_spans(plain)

    def rebuilt(spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = F.concat(F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
            out = F.when((s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0)), acc["out"]).otherwise(F.concat(acc["out"], F.array(fresh)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
        return F.aggregate(F.array_sort(spans), first, step, tail)

    every = F.concat(*(F.col(k) for k in NAMES))
    new = F.when(F.size(every) > 0, rebuilt(every)).otherwise(F.col("text"))
    rows = rows.select(*plain.columns, F.size(every).alias("found"), new.alias("new"))

    def shown(name: str, inner: str) -> Column:
        if name.lower() == "text":
            return F.col("new").alias(name)
        if name.lower() == "n_chars":
            return F.when(F.col("found") > 0, F.length("new").cast(docs.schema[name].dataType)).otherwise(F.col(inner)).alias(name)
        return F.col(inner).alias(name)

    return rows.select(*map(shown, docs.columns, plain.columns))
