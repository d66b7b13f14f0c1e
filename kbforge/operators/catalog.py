"""Product catalogs: normalised lists, keys for matching, merges, duplicate groups, related items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbforge.functions.storage import materialize
from kbforge.operators.components import connected_components, join_spread

#: Phrases of generic mentions, and patterns of names that are none.
GENERIC = ("any camera", "most cameras", "all cameras", "example camera", "generic camera", "various cameras", "multiple cameras", "camera model", "your camera", "the camera", "a camera")
SUSPICIOUS = (r"^\d+$", r"^[a-z]$", r"test", r"sample", r"example", r"unknown", r"n/a")
#: Beginnings of names that belong to a maker.
PREFIXES: dict[str, tuple[str, ...]] = {
    "Sony": ("ilce-", "ilme-", "pxw-", "hdc-", "hxc-", "brc-", "src-", "fr"),
    "Panasonic": ("aw-", "ag-", "dc-"),
    "Canon": ("cr-", "eos", "xl-"),
    "Blackmagic": ("ursa", "pyxis", "micro"),
    "ARRI": ("alexa", "amira"),
    "JVC": ("gy-", "kh-"),
}
#: Makers that stand before a model's name, in the order in which they are looked for.
MAKERS = (
    "Sony", "Canon", "Panasonic", "Blackmagic", "ARRI", "RED", "Grass Valley", "Ikegami", "Hitachi", "JVC", "Fujifilm", "Nikon", "Z CAM", "Kinefinity",
    "Ross", "AJA", "BMD", "GoPro", "DJI", "Atomos", "Marshall", "PTZOptics",
)
LISTS = ("ports", "protocols", "controls")
#: Lists and single values that are merged where a table has them; the type, source and confidence of a known item are not.
MERGED_LISTS = (*LISTS, "notes")
MERGED_VALUES = ("manufacturer", "code_model", "doc_url", "manufacturer_url")


def _has(rows: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in rows.columns]


def _joined(name: str) -> Column:
    """The sorted union of a group's lists."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)


def normalize_list(values: Column, aliases: dict[str, str]) -> Column:
    """Trimmed values under their alias, without repeats but for case; the first of each stays, in order."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    named = F.transform(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), lambda v: F.coalesce(F.element_at(table, F.lower(F.trim(v))), F.trim(v)))

    def add(acc: Column, v: Column) -> Column:
        return F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v)))

    return F.aggregate(named, F.array().cast("array<string>"), add)


def entity_key(name: Column, maker: Column) -> Column:
    """The name in lower case without its own maker, model prefix, trailing ``head``, hyphens, dots and spaces; mark numbers as digits."""
    out = F.lower(F.trim(name))
    own = F.concat(F.lower(F.coalesce(maker, F.lit(""))), F.lit(" "))
    out = F.when((F.length(own) > 1) & F.startswith(out, own), F.substring(out, F.length(own) + 1, F.length(out))).otherwise(out)
    out = F.regexp_replace(out, r"^(?:aw-|ag-|ilme-|ilce-)", "")
    for mark, digit in ((r"(?:iii|3)", "3"), (r"(?:ii|2)", "2"), (r"(?:i|1)\b", "1")):
        out = F.regexp_replace(out, rf"(?:mk|mark)\s*{mark}", f"mk{digit}")
    return F.regexp_replace(F.regexp_replace(out, r"\s+head$", ""), r"[-_.\s]", "")


def infer_device_type(name: Column, maker: Column, rules: list[tuple[str, str]]) -> Column:
    """The type of the first pattern, in order, that the maker and name match, case aside."""
    text = F.concat_ws(" ", F.coalesce(maker, F.lit("")), name)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def clean_model_name(name: Column, maker: Column) -> Column:
    """The name without the first known maker before it, then without its own; null and empty stay."""
    out = F.trim(F.regexp_replace(F.trim(name), "(?i)^(?:" + "|".join(MAKERS) + ") ", ""))
    own = F.concat(F.lower(F.coalesce(maker, F.lit(""))), F.lit(" "))
    return F.when((F.length(own) > 1) & F.startswith(F.lower(out), own), F.trim(F.substring(out, F.length(own), F.length(out)))).otherwise(out)


def normalize_manufacturer(maker: Column) -> Column:
    """A maker's usual name, others with capitals at their words; empty gives null."""
    text = F.trim(maker)
    low = F.lower(text)
    usual = F.when(low.contains("blackmagic") | (low == "bmd"), "Blackmagic").when((low.contains("grass") & low.contains("valley")) | (low == "gv"), "Grass Valley")
    for m in MAKERS:
        usual = usual.when(low == m.lower(), m)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    capital = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    return F.when(maker != "", usual.otherwise(capital))


def import_sheet(rows: DataFrame, maker: str, renamed: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of a vendor's sheet (all texts) as catalog rows: headings renamed, models cleaned, cells split to lists.

    Rows without a model go; of a model given several times one row stays, with the union of its ports.
    """
    named = rows.select(*(F.col(f"`{old}`").alias(new) for old, new in renamed.items()))
    name = clean_model_name(F.col("name"), F.lit(maker))
    ports = normalize_list(F.split(F.coalesce("ports", F.lit("")), r"[,;/\n]"), aliases or {})
    one = named.select(name.alias("name"), F.nullif(F.trim("code_model"), F.lit("")).alias("code_model"), ports.alias("ports")).filter("name <> ''")
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports"))))
    each = one.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name"), F.min("code_model").alias("code_model"), union.alias("ports"))
    return each.select("name", F.lit(maker).alias("manufacturer"), "code_model", "ports")


def validate_records(items: DataFrame, makers: list[str]) -> DataFrame:
    """``items`` with ``score``, ``issues``, ``valid`` and ``review``; each fault lowers a score that starts at 1.

    Of ``LISTS`` those that are columns count.
    """
    name, maker = F.coalesce("name", F.lit("")), F.coalesce("manufacturer", F.lit(""))
    bare = lambda m: m.lower().replace(" ", "")
    known = F.replace(F.lower(maker), F.lit(" "), F.lit("")).isin(*map(bare, makers))
    generic = F.lit(False)
    for word in GENERIC:
        generic = generic | F.lower(name).contains(word)
    empty = F.lit(True)
    for c in set(LISTS) & set(items.columns):
        empty = empty & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    faults = [
        ("name_too_short", F.length(name) < 2, 0.4),
        ("name_too_long", F.length(name) > 50, 0.2),
        ("generic_name", generic, 0.5),
        ("no_manufacturer", maker == "", 0.1),
        ("unknown_manufacturer", (maker != "") & ~known, 0.15),
        ("no_details", empty, 0.3),
        ("suspicious_name", F.lower(name).rlike("|".join(SUSPICIOUS)), 0.3),
        ("name_has_manufacturer", (maker != "") & F.startswith(F.lower(name), F.lower(maker)), 0.1),
    ]
    score = F.lit(1.0)
    for _, cond, cost in faults:
        score = score - F.when(cond, cost).otherwise(0.0)
    issues = F.array_compact(F.array(*(F.when(cond, label) for label, cond, _ in faults)))
    score = F.round(F.greatest(F.lit(0.0), score), 2)
    return items.withColumn("score", score).withColumn("issues", F.array_join(issues, ",")).withColumn("valid", (score >= 0.5) & ~generic).withColumn("review", (score < 0.7) | (F.size(issues) > 0))


def detect_issues(items: DataFrame, prefixes: dict[str, tuple[str, ...]] = PREFIXES) -> DataFrame:
    """``id, issues``: missing maker or code, a name that begins like each other maker's, a name of two characters or fewer."""
    begins = lambda own: F.lower("name").rlike("^(?:" + "|".join(own) + ")")
    other = [F.when(begins(own) & (F.col("manufacturer") != m) & (F.col("manufacturer") != ""), F.lit(f"manufacturer_mismatch:{m}")) for m, own in prefixes.items()]
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    found = F.array_compact(F.array(F.when(blank("manufacturer"), "missing_manufacturer"), F.when(blank("code_model"), "missing_code_model"), *other, F.when(F.length("name") <= 2, "name_too_short")))
    return items.select("id", F.array_join(found, ",").alias("issues")).filter("issues <> ''")


def merge_extractions(rows: DataFrame) -> DataFrame:
    """Rows of one key (maker, name without separators) as one: the longest name, the last values, the union of lists.

    ``rows`` has ``at``, their order.
    """
    key = F.concat(F.lower(F.coalesce("manufacturer", F.lit("unknown"))), F.lit(":"), F.regexp_replace(F.lower("name"), r"[-_\s]", ""))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    values = [last(c) for c in ("manufacturer", *_has(rows, ("device_type",)), *_has(rows, MERGED_VALUES[1:]))]
    return rows.groupBy(key.alias("key")).agg(F.max_by("name", F.struct(F.length("name"), -F.col("at"))).alias("name"), *values, *map(_joined, _has(rows, MERGED_LISTS)), F.count("*").alias("merged"))


def upsert_catalog(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """``catalog`` with incoming rows merged by exact name, else by key; the rest is inserted without an id.

    Incoming rows of one key count once, the first by name, then by ``at`` where they have it, their order of coming, and by their
    other values. Lists are joined; incoming values stand over old ones where given, of
    several the greatest. Both tables have the same of the merged columns; all other columns are dropped.
    """
    key = lambda df: df.withColumn("k", entity_key(F.col("name"), F.col("manufacturer"))).withColumn("n", F.lower("name"))
    lists, values = _has(incoming, MERGED_LISTS), _has(incoming, MERGED_VALUES)
    new = key(incoming).filter("k <> ''").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("name", *_has(incoming, ("at",)), *values, *lists))).filter("r = 1")
    old = key(catalog)
    by_name = new.join(old.groupBy("n").agg(F.min("id").alias("id")), "n")
    rest = new.join(by_name.select("k"), "k", "left_anti")
    by_key = rest.join(old.filter("k <> ''").groupBy("k").agg(F.min("id").alias("id")), "k")
    hits = by_name.select("id", *values, *lists).unionByName(by_key.select("id", *values, *lists))
    hit = hits.groupBy("id").agg(*(F.max(c).alias(f"_{c}") for c in values), *(_joined(c).alias(f"_{c}") for c in lists))
    none = F.array().cast("array<string>")
    merged = catalog.join(hit, "id", "left").select("id", "name", *(F.coalesce(f"_{c}", c).alias(c) for c in values), *(F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"_{c}", none))).alias(c) for c in lists))
    fresh = rest.join(by_key.select("k"), "k", "left_anti").select(F.lit(None).cast("long").alias("id"), "name", *values, *(F.array_sort(c).alias(c) for c in lists))
    return merged.unionByName(fresh)


def merge_by_code(items: DataFrame) -> DataFrame:
    """Of items that share a code one stays: not named like the code, then of the shorter name, then the last by name."""
    bare = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit(""))
    best = Window.partitionBy("code_model").orderBy((bare("name") == bare("code_model")).cast("int"), F.length("name"), F.desc("name"), "id")
    coded = items.filter("coalesce(code_model, '') <> ''").withColumn("r", F.row_number().over(best))
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports"))))
    groups = coded.groupBy("code_model").agg(F.min_by("id", "r").alias("id"), F.min_by("name", "r").alias("name"), union.alias("ports"), F.count("*").alias("merged"))
    rest = items.filter("coalesce(code_model, '') = ''").select("code_model", "id", "name", F.array_sort("ports").alias("ports"), F.lit(1).cast("long").alias("merged"))
    return groups.unionByName(rest)


def duplicate_groups(items: DataFrame) -> DataFrame:
    """``id, group_id``: items joined by an equal key and maker, or by one's code that is another's name; groups of two or more.

    Items of one key are joined to the least of them, not to each other.
    """
    keyed = items.select("id", entity_key(F.col("name"), F.col("manufacturer")).alias("k"), F.lower(F.coalesce("manufacturer", F.lit(""))).alias("m"), F.lower("name").alias("n"), F.lower("code_model").alias("c")).filter("k <> ''")
    heads = keyed.groupBy("k", "m").agg(F.min("id").alias("b"), F.count("*").alias("size")).filter("size > 1")
    same = keyed.join(heads, ["k", "m"]).select(F.col("id").alias("a"), "b")
    names = keyed.groupBy(F.col("n").alias("named")).agg(F.min("id").alias("b"))
    code = keyed.filter("c <> ''").join(names, F.col("c") == F.col("named")).select(F.col("id").alias("a"), "b")
    return connected_components(same.unionByName(code)).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def merge_into_primary(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Targets (``id, primary_id``) go into their primaries: joined lists, the primary's values first, then the first target's
    that has one, the highest confidence, and no review is due any more."""
    own = items.join(mapping, "id", "left").withColumn("into", F.coalesce("primary_id", "id"))
    order = F.struct(F.col("primary_id").isNotNull(), F.col("id"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in _has(items, (*MERGED_VALUES, "device_type"))]
    review = [(F.min_by("needs_review", order) & (F.count("*") == 1)).alias("needs_review")] if "needs_review" in items.columns else []
    return own.groupBy(F.col("into").alias("id")).agg(F.min_by("name", order).alias("name"), *first, *map(_joined, _has(items, MERGED_LISTS)), F.max("confidence").alias("confidence"), *review, F.count("*").alias("merged"))


def strip_name_prefix(items: DataFrame) -> DataFrame:
    """Names without their maker in front; items that thereby get another's name go into the one of the least id."""
    prefix = F.lower(F.concat("manufacturer", F.lit(" ")))
    clean = F.when(F.startswith(F.lower("name"), prefix), F.trim(F.substring(F.col("name"), F.length(prefix) + 1, F.length("name")))).otherwise(F.col("name"))
    return items.withColumn("clean", clean).groupBy(F.lower("clean").alias("k")).agg(F.min("id").alias("id"), F.min_by("clean", "id").alias("name"), F.count("*").alias("merged")).drop("k")


def filter_catalog(items: DataFrame, maker: str | None = None, device: str | None = None, port: str | None = None, offset: int = 0, limit: int = 50, protocol: str | None = None) -> DataFrame:
    """A page of the items that fit all given conditions, by maker and name, with the total."""
    rows = items
    if maker:
        rows = rows.filter(F.lower("manufacturer") == maker.lower())
    if device:
        rows = rows.filter(F.col("device_type") == device)
    if port:
        rows = rows.filter(F.exists("ports", lambda p: F.lower(p) == port.lower()))
    if protocol:
        rows = rows.filter(F.exists("protocols", lambda p: F.lower(p) == protocol.lower()))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("manufacturer", "name", "id").offset(offset).limit(limit).select("id", "name").crossJoin(F.broadcast(total))


def review_queue(items: DataFrame, limit: int = 50) -> DataFrame:
    return items.filter("needs_review").orderBy("confidence", F.desc("created_at"), "id").limit(limit).select("id", "confidence")


def catalog_facets(items: DataFrame) -> DataFrame:
    """``facet, value``: the distinct makers, device types, ports and protocols."""
    facet = lambda name, col: items.select(F.lit(name).alias("facet"), col.alias("value")).filter("value IS NOT NULL").distinct()
    single = facet("manufacturer", F.col("manufacturer")).unionByName(facet("device_type", F.col("device_type")))
    return single.unionByName(facet("port", F.explode("ports"))).unionByName(facet("protocol", F.explode("protocols")))


def catalog_stats(items: DataFrame) -> DataFrame:
    """``name, n``: all items, distinct makers, and items of each source."""
    whole = items.agg(F.count("*").alias("total"), F.count_distinct("manufacturer").alias("manufacturers")).unpivot([], ["total", "manufacturers"], "name", "n")
    return whole.unionByName(items.groupBy(F.concat(F.lit("source:"), "source").alias("name")).agg(F.count("*").alias("n")))


def related_items(items: DataFrame, asked: DataFrame, limit: int = 5, same: int = 3) -> DataFrame:
    """``id, other, score, rank`` of the ``limit`` items nearest to each asked one: 3 for the same maker, 3 for the same type,
    1 for each shared port and protocol; of equal scores the least ids, none with a score of 0.

    Items of one set of attributes are one class with its least ids. A class stands in lists by what it has: maker, type or
    both, alone or with one port or protocol. How long a list is tells what score an asked class's ``limit``-th neighbour has
    at least; its shortest list that is long enough is scored to raise that threshold. A class that reaches it must then
    share one of the lists that the threshold leaves (with a maker and type worth 6 and 9 further attributes, a threshold of 12
    leaves the lists of both with one of the 4 rarest attributes, and those of maker or type alone with just one). Only these meet.
    Lists and pairs hold classes by number. What was scored for the threshold is not scored again, and a pair below it goes at once.
    Everything here grows with the items, so no side of a join is broadcast, however small its files are: ten packed MB of lists
    and classes make hundreds of MB of rows in the driver.
    """
    every = ["maker", "kind", "marks"]
    shuffled = lambda left, right, on, how="inner": left.join(right.hint("merge"), on, how)
    classed = materialize(_classed(items).unionByName(_classed(asked).withColumn("asking", F.lit(True)), allowMissingColumns=True), "classed")
    told = classed.groupBy("digest").agg(*(F.first(c).alias(c) for c in every), F.count(F.when(F.col("asking").isNull(), 1)).alias("n"), F.count("asking").alias("n_asked"))
    told = materialize(told.withColumn("cls", F.monotonically_increasing_id()), "classes")
    there, asking = told.filter("n > 0"), told.filter("n_asked > 0").select("cls", *every, F.lit(1).alias("least"))
    lists = materialize(there.select("cls", "n", F.explode(_lists(F.col("marks"))).alias("key")), "lists")
    sizes = lists.groupBy("key").agg(F.sum("n").alias("n"))
    own = materialize(shuffled(asking.select("cls", F.explode(_lists(F.col("marks"))).alias("key")), sizes, "key"), "own-lists")

    def scored(pairs: DataFrame, left: DataFrame) -> DataFrame:
        """``cls, other, n, score`` of pairs of classes that reach the class's ``least``."""
        left = left.select("cls", "least", *(F.col(c).alias(f"own_{c}") for c in every))
        both = shuffled(shuffled(pairs, left, "cls"), there.select(F.col("cls").alias("other"), "n", *every), "other")
        alike = lambda c: F.when((F.col(c) != "") & (F.col(c) == F.col(f"own_{c}")), same).otherwise(0)
        score = (alike("maker") + alike("kind") + F.size(F.array_intersect("marks", "own_marks"))).cast("long")
        return both.withColumn("score", score).filter("score >= least").select("cls", "other", "n", "score")

    # The item itself may stand in the list, so one more is wanted.
    enough = materialize(own.filter(F.col("n") > limit).groupBy("cls").agg(F.min(F.struct("n", "key"))["key"].alias("key")), "tried")
    tried = scored(shuffled(enough, lists.select(F.col("cls").alias("other"), "key"), "key").select("cls", "other"), asking)
    # The score that more than ``limit`` of the tried items reach.
    above = Window.partitionBy("cls").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.max(F.when(F.col("reach") > limit, F.col("score"))).over(Window.partitionBy("cls"))
    reached = materialize(tried.withColumn("reach", F.sum("n").over(above)).withColumn("least", least).filter("score >= coalesce(least, 1)").select("cls", "other", "score", "least"), "reached")
    met = shuffled(asking.drop("least"), reached.groupBy("cls").agg(F.max("least").alias("least")), "cls", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    rare = own.filter(F.col("key.mark") != "").filter("key.maker = '' AND key.kind = ''").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", F.col("key.mark").alias("mark")))).alias("rare"))
    # Marks that no class has are the rarest; a prefix need not hold them, but they count in its length. The list that was tried is known.
    wanted = shuffled(shuffled(met, rare, "cls", "left"), enough, "cls", "left").select("cls", F.explode(F.array_except(_wanted(same), F.array("key"))).alias("key"))
    pairs = shuffled(wanted, lists.select(F.col("cls").alias("other"), "key"), "key").select("cls", "other").distinct()
    members = classed.filter("asking IS NULL").select("digest", "id").withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).filter(F.col("r") <= limit + 1)
    members = shuffled(members, there.select("digest", F.col("cls").alias("other")), "digest").select("other", "id")
    near = scored(pairs, met).select("cls", "other", "score").unionByName(reached.drop("least")).dropDuplicates(["cls", "other"])
    best = shuffled(near, members, "other").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= limit + 1)
    tops = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").alias("other")))).alias("top"))
    each = join_spread(classed.filter("asking").select("id", "digest"), shuffled(tops, told.select("cls", "digest"), "cls").drop("cls"), "digest", hint="merge")
    others = F.slice(F.filter("top", lambda x: ~x["other"].eqNullSafe(F.col("id"))), 1, limit)
    return each.select("id", F.posexplode(others).alias("rank", "x")).select("id", "x.other", (-F.col("x.less")).alias("score"), (F.col("rank") + 1).alias("rank"))


def _classed(items: DataFrame) -> DataFrame:
    """``id, digest`` (of the class) and what the class has: maker and type (empty: none), ports and protocols as marks."""
    marks = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.concat(F.lit(f"{c}:"), x))
    rows = items.select("id", F.coalesce("manufacturer", F.lit("")).alias("maker"), F.coalesce("device_type", F.lit("")).alias("kind"), F.array_sort(F.array_distinct(F.concat(marks("ports"), marks("protocols")))).alias("marks"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.to_json(F.struct("maker", "kind", "marks")), 256)))


def _lists(marks: Column) -> Column:
    """The lists that a class stands in: each of its maker and type, with one mark or none; the empty list is left out."""
    bases = F.array_distinct(F.array(*(F.struct(F.when(F.lit(m), F.col("maker")).otherwise("").alias("maker"), F.when(F.lit(k), F.col("kind")).otherwise("").alias("kind")) for m in (True, False) for k in (True, False))))
    keys = F.flatten(F.transform(bases, lambda b: F.transform(F.concat(F.array(F.lit("")), marks), lambda x: F.struct(b["maker"].alias("maker"), b["kind"].alias("kind"), x.alias("mark")))))
    return F.filter(keys, lambda k: (k["maker"] != "") | (k["kind"] != "") | (k["mark"] != ""))


def _list_of(maker: Column, kind: Column) -> Callable[[Column], Column]:
    return lambda mark: F.struct(maker, kind, mark.alias("mark"))


def _wanted(same: int) -> Column:
    """Of an asked class the lists that hold every class of the score ``least`` or more.

    What shares no more of maker and type than a list's must make up for the rest by ports and protocols: of p of them r are
    shared only if one of any p - r + 1 is.
    """
    out = []
    rare, p = F.transform(F.coalesce("rare", F.array().cast("array<struct<n:bigint,mark:string>>")), lambda x: x["mark"]), F.size("marks")
    for m in (True, False):
        for k in (True, False):
            there = (F.col("maker") != "" if m else F.lit(True)) & (F.col("kind") != "" if k else F.lit(True))
            need = F.col("least") - same * (m + k)
            # Marks that no class has come first in the order of rareness.
            length = F.greatest(p - need + 1 - (p - F.size(rare)), F.lit(0)).cast("int")
            chosen = F.when(need <= 0, F.array(F.lit("")) if m or k else rare).otherwise(F.slice(rare, F.lit(1), F.least(length, F.size(rare))))
            maker, kind = (F.col("maker") if m else F.lit("")).alias("maker"), (F.col("kind") if k else F.lit("")).alias("kind")
            own = F.transform(chosen, _list_of(maker, kind))
            out.append(F.when(there, own).otherwise(F.array().cast("array<struct<maker:string,kind:string,mark:string>>")))
    return F.array_distinct(F.concat(*out))


def compare_items(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each set (``set_id, id``) the ports and the protocols that all its items have, and its makers."""
    own = sets.join(items, "id")
    n = own.groupBy("set_id").agg(F.count_distinct("id").alias("n"), F.array_join(F.array_sort(F.collect_set("manufacturer")), ",").alias("manufacturers"))

    def values(kind: str) -> Column:
        return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    has = F.concat(values("ports"), values("protocols"))
    held = own.select("set_id", "id", F.explode(has).alias("x")).distinct().groupBy("set_id", "x").agg(F.count("*").alias("have"))
    common = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("x.kind") == kind, F.col("x.value")))), ",").alias(kind)
    shared = held.join(n, "set_id").filter("have = n").groupBy("set_id").agg(common("ports"), common("protocols"))
    return n.join(shared, "set_id", "left").select("set_id", "n", "manufacturers", *(F.coalesce(c, F.lit("")).alias(c) for c in ("ports", "protocols")))


def lookup_codes(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Codes that are missing, from ``manufacturer, name, known_code``."""
    return items.join(reference, ["manufacturer", "name"], "left").withColumn("code_model", F.coalesce("code_model", "known_code")).drop("known_code")


def apply_corrections(items: DataFrame, corrections: DataFrame, least: float = 0.7) -> DataFrame:
    """Corrections (``id, new_name, confidence_of``) of enough confidence that change something."""
    good = corrections.filter(F.col("confidence_of") >= least)
    changed = F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name"))
    return items.join(good, "id", "left").withColumn("corrected", F.coalesce(changed, F.lit(False))).withColumn("name", F.when(F.coalesce(changed, F.lit(False)), F.col("new_name")).otherwise(F.col("name"))).drop("new_name", "confidence_of")


def like_search_catalog(items: DataFrame, text: str, limit: int = 100) -> DataFrame:
    low = text.lower()
    hit = F.lower("name").contains(low) | F.lower("manufacturer").contains(low) | F.lower(F.coalesce("code_model", F.lit(""))).contains(low)
    return items.filter(hit).orderBy("name", "id").limit(limit)
