"""Catalog operators over ``part``, whose lists come from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbforge.functions.storage import read_table
from kbforge.operators import catalog as ops

MAKERS = [f"Brand#{i}" for i in range(1, 21)]
TYPES = [("ring", "ring|bolt"), ("wid", "widget"), ("small", "small"), ("econ", "brand#1")]
ALIASES = {"a-0": "Alpha", "n-1": "November", "r-2": "Romeo", "r-3": "romeo"}
SQL_ITEMS = """ports AS (SELECT l_partkey AS id, list_sort(list(DISTINCT l_returnflag || '-' || (l_suppkey % 4))) AS ports FROM lineitem GROUP BY l_partkey),
  items AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Mark II' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' ' || p_size END AS name,
    CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS manufacturer, p_type AS device_type, CASE WHEN p_partkey % 4 <> 0 THEN 'C' || (p_partkey % 500) END AS code_model, coalesce(ports, []) AS ports,
    p_partkey % 13 = 0 AS needs_review, (p_partkey % 10) / 10.0::DOUBLE AS confidence, 's' || (p_partkey % 3) AS source, p_partkey AS created_at FROM part LEFT JOIN ports ON id = p_partkey)"""
SQL_KEY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN manufacturer IS NOT NULL AND starts_with(lower(trim(name)), lower(manufacturer) || ' ') THEN substring(lower(trim(name)), length(manufacturer) + 2) ELSE lower(trim(name)) END, '^(?:aw-|ag-|ilme-|ilce-)', ''),
  'mk\s*iii|mark\s*iii|mark\s*3|mk\s*3', 'mk3', 'g'), 'mk\s*ii|mark\s*ii|mark\s*2|mk\s*2', 'mk2', 'g'), 'mk\s*i\b|mark\s*i\b|mk\s*1\b|mark\s*1\b', 'mk1', 'g'), '\s+head$', ''), '[-_.\s]', '', 'g')"""


def items(spark: SparkSession, d: str) -> DataFrame:
    ports = read_table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat_ws("-", "l_returnflag", (F.col("l_suppkey") % 4).cast("string")))).alias("ports"))
    part = read_table(spark, d, "part").selectExpr(
        "p_partkey AS id", "concat(CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, ' ') ELSE '' END, p_name, CASE WHEN p_partkey % 3 = 0 THEN ' Mark II' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(' ', p_size) END) AS name",
        "CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS manufacturer", "p_type AS device_type", "CASE WHEN p_partkey % 4 <> 0 THEN concat('C', p_partkey % 500) END AS code_model",
        "p_partkey % 13 = 0 AS needs_review", "p_partkey % 10 / 10.0D AS confidence", "concat('s', p_partkey % 3) AS source", "p_partkey AS created_at",
    )
    return part.join(ports, "id", "left").withColumn("ports", F.coalesce("ports", F.array().cast("array<string>")))


SQL_FULL = """full_ AS (SELECT *, ['x' || (id % 6), 'y' || (id % 10)] AS protocols, CASE WHEN id % 8 = 0 THEN ['iris'] ELSE [] END AS controls, ['note ' || (id % 3)] AS notes,
  CASE WHEN id % 3 = 0 THEN 'd/' || id END AS doc_url, CASE WHEN id % 4 = 1 THEN 'm/' || id END AS manufacturer_url FROM items)"""
LISTED = ("ports", "protocols", "controls", "notes")


def full(spark: SparkSession, d: str) -> DataFrame:
    """The items with all lists and values that are merged."""
    return items(spark, d).selectExpr(
        "*", "array(concat('x', id % 6), concat('y', id % 10)) AS protocols", "CASE WHEN id % 8 = 0 THEN array('iris') ELSE cast(array() AS array<string>) END AS controls", "array(concat('note ', id % 3)) AS notes",
        "CASE WHEN id % 3 = 0 THEN concat('d/', id) END AS doc_url", "CASE WHEN id % 4 = 1 THEN concat('m/', id) END AS manufacturer_url",
    )


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    old = full(spark, d).filter("id % 2 = 0")
    new = full(spark, d).filter("id % 2 = 1").select(F.lower("name").alias("name"), "manufacturer", F.lit("NEW").alias("code_model"), F.array(F.lit("X")).alias("ports"), "protocols", F.array(F.lit("zoom")).alias("controls"), "notes", "doc_url", "manufacturer_url", F.col("id").alias("at"))
    return _joined(ops.upsert_catalog(old, new), *LISTED)


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    cells = read_table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 6 = 0 THEN concat('Sony ', p_name) WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS `Model Name`", "concat(p_partkey % 7 + 10, '') AS Code", "concat('r-', p_partkey % 4, ', ', p_brand, ';A-0') AS `Ports (all)`")
    rows = ops.import_sheet(cells, "Sony", {"Model Name": "name", "Code": "code_model", "Ports (all)": "ports"}, ALIASES)
    return _joined(rows, "ports")


def _related(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).withColumn("protocols", F.array(F.concat(F.lit("x"), F.col("id") % 6), F.concat(F.lit("y"), F.col("id") % 10)))
    return ops.related_items(rows, rows.filter("id % 20 = 0"))


def _makers(spark: SparkSession, d: str) -> DataFrame:
    maker = F.element_at(F.array(*map(F.lit, (" sony", "Blackmagic Design", "grass  VALLEY", "GV", "z cam", "other MAKER  x", ""))), (F.col("id") % 7 + 1).cast("int"))
    return items(spark, d).select("id", ops.normalize_manufacturer(F.when(F.col("id") % 8 != 0, maker)).alias("maker"))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    before = F.element_at(F.array(*map(F.lit, ("SONY ", "Grass Valley ", " BMD Brand#1 ", "", "Sonya "))), (F.col("id") % 5 + 1).cast("int"))
    return items(spark, d).select("id", ops.clean_model_name(F.concat(before, "name"), F.col("manufacturer")).alias("name"))


def _primary(spark: SparkSession, d: str) -> DataFrame:
    mapping = read_table(spark, d, "part").filter("p_partkey % 6 IN (1, 2)").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 6).alias("primary_id"))
    return _joined(ops.merge_into_primary(full(spark, d), mapping), *LISTED)


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.col("ports"), F.array(F.lit(" R-2"), F.lit(""), F.lit("other "), F.lit("OTHER")))
    return items(spark, d).select("id", F.array_join(ops.normalize_list(listed, ALIASES), ",").alias("ports"))


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    fixes = read_table(spark, d, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN concat('fixed ', p_partkey) END AS new_name", "p_partkey % 10 / 10.0D AS confidence_of")
    return ops.apply_corrections(items(spark, d), fixes).select("id", "name", "corrected")


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    known = items(spark, d).filter("manufacturer IS NOT NULL").groupBy("manufacturer", "name").agg(F.concat(F.lit("K"), F.min("id")).alias("known_code"))
    return ops.lookup_codes(items(spark, d), known).select("id", "code_model")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    sets = read_table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("set_id"), F.col("p_partkey").alias("id"))
    return ops.compare_items(full(spark, d), sets)


#: Names that are tried as they stand, by the item's number.
ODD_NAMES = ("plain", "Example Camera 3", "12345", "x", "Unknown thing", "Brand#13 mine", "y" * 51, "test bench", "Any Camera")


def _odd_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("id") % 3 == 0, F.element_at(F.array(*map(F.lit, ODD_NAMES)), (F.floor(F.col("id") / 3) % len(ODD_NAMES) + 1).cast("int"))).otherwise(F.col("name"))
    none = F.array().cast("array<string>")
    return items(spark, d).withColumns({"name": name, "ports": F.when(F.col("id") % 4 == 0, none).otherwise(F.col("ports")), "protocols": none, "controls": F.when(F.col("id") % 8 == 0, F.array(F.lit("iris"))).otherwise(none)})


STARTS = ("ILME-FX6", "eos r5", "FR7", "Alexa Mini", "GY-HC", "ursa", "x1", "HDC", "cr-n300")
OWNERS = ("Sony", "Canon", "Panasonic", "ARRI")


def _prefixed(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("id") / n) % len(values) + 1).cast("int"))
    return items(spark, d).withColumns({"name": F.when(F.col("id") % 2 == 0, pick(STARTS, 2)).otherwise(F.col("name")), "manufacturer": F.when(F.col("id") % 6 != 0, pick(OWNERS, 3))})


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh item is named by a code, with a hyphen."""
    return items(spark, d).withColumn("name", F.when(F.col("id") % 11 == 0, F.concat(F.lit("c-"), F.col("id") % 500)).when(F.col("id") % 13 == 0, F.concat(F.lit("C"), F.col("id") % 499)).otherwise(F.col("name")))


QUERIES = {
    "normalize_lists": _normalized,
    "entity_key": lambda s, d: items(s, d).select("id", ops.entity_key(F.col("name"), F.col("manufacturer")).alias("k")),
    "infer_device_type": lambda s, d: items(s, d).select("id", ops.infer_device_type(F.col("name"), F.col("manufacturer"), TYPES).alias("kind")),
    "validate_records": lambda s, d: ops.validate_records(_odd_names(s, d), ["Brand #1", "Brand#2", "brand#13"]).select("id", "score", "issues", "valid", "review"),
    "detect_issues": lambda s, d: ops.detect_issues(_prefixed(s, d)),
    "clean_model_names": _cleaned,
    "normalize_manufacturer": _makers,
    "vendor_sheet_import": _sheet,
    "merge_extractions": lambda s, d: _joined(ops.merge_extractions(full(s, d).withColumn("at", F.col("id"))), *LISTED),
    "upsert_catalog": _upserted,
    "merge_by_code": lambda s, d: _joined(ops.merge_by_code(_coded(s, d)), "ports"),
    "duplicate_groups": lambda s, d: ops.duplicate_groups(_coded(s, d)),
    "merge_into_primary": _primary,
    "strip_name_prefix": lambda s, d: ops.strip_name_prefix(items(s, d)),
    "filter_catalog": lambda s, d: ops.filter_catalog(full(s, d), "brand#3", None, "r-1", 1, 30, "X1"),
    "review_queue": lambda s, d: ops.review_queue(items(s, d), 40),
    "catalog_facets": lambda s, d: ops.catalog_facets(full(s, d)),
    "catalog_stats": lambda s, d: ops.catalog_stats(items(s, d)),
    "related_items": _related,
    "compare_items": _compared,
    "lookup_codes": _looked_up,
    "apply_corrections": _corrected,
    "like_search_catalog": lambda s, d: ops.like_search_catalog(items(s, d), "RING").select("id", "name"),
}

_CASES = " ".join(f"WHEN regexp_matches(coalesce(manufacturer, '') || ' ' || name, '(?i){p}') THEN '{k}'" for k, p in TYPES)
_CASES_NULL = " ".join(f"WHEN regexp_matches(concat_ws(' ', coalesce(manufacturer, ''), name), '(?i){p}') THEN '{k}'" for k, p in TYPES)
_UNIONS = ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({c})))), ',') AS {c}" for c in LISTED)
_LAST = ", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN id END) AS {c}" for c in ("manufacturer", "device_type", "code_model", "doc_url", "manufacturer_url"))
_FIRST = ", ".join(f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN struct_pack(moved, id) END) AS {c}" for c in ("manufacturer", "device_type", "code_model", "doc_url", "manufacturer_url"))
_KEYED = f"keyed AS (SELECT *, {SQL_KEY} AS k FROM items)"
_CODED = "coded AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 'c-' || (id % 500) WHEN id % 13 = 0 THEN 'C' || (id % 499) ELSE name END AS name) FROM items)"
ORACLES = {
    "normalize_lists": f"WITH {SQL_ITEMS}, l AS (SELECT id, unnest(list_concat(ports, [' R-2', '', 'other ', 'OTHER'])) AS v, generate_subscripts(list_concat(ports, [' R-2', '', 'other ', 'OTHER']), 1) AS i FROM items), m AS (SELECT id, i, CASE lower(trim(v)) WHEN 'a-0' THEN 'Alpha' WHEN 'n-1' THEN 'November' WHEN 'r-2' THEN 'Romeo' WHEN 'r-3' THEN 'romeo' ELSE trim(v) END AS v FROM l WHERE trim(v) <> ''), f AS (SELECT id, min(i) AS i, arg_min(v, i) AS v FROM m GROUP BY id, lower(v)) SELECT id, string_agg(v, ',' ORDER BY i) AS ports FROM f GROUP BY id",
    "entity_key": f"WITH {SQL_ITEMS}, {_KEYED} SELECT id, k FROM keyed",
    "infer_device_type": f"WITH {SQL_ITEMS} SELECT id, CASE {_CASES_NULL} END AS kind FROM items",
    "validate_records": f"""WITH {SQL_ITEMS}, v AS (SELECT id, CASE WHEN id % 3 = 0 THEN ['plain', 'Example Camera 3', '12345', 'x', 'Unknown thing', 'Brand#13 mine', repeat('y', 51), 'test bench', 'Any Camera'][1 + (id // 3) % 9] ELSE name END AS n, coalesce(manufacturer, '') AS m, (len(ports) = 0 OR id % 4 = 0) AND id % 8 <> 0 AS empty FROM items),
        g AS (SELECT *, regexp_matches(lower(n), 'any camera|most cameras|all cameras|example camera|generic camera|various cameras|multiple cameras|camera model|your camera|the camera|a camera') AS generic,
          regexp_matches(lower(n), '^[0-9]+$|^[a-z]$|test|sample|example|unknown|n/a') AS odd, replace(lower(m), ' ', '') IN ('brand#1', 'brand#2', 'brand#13') AS known FROM v),
        s AS (SELECT *, round(greatest(0, 1 - 0.4 * (length(n) < 2)::INT - 0.2 * (length(n) > 50)::INT - 0.5 * generic::INT - 0.1 * (m = '')::INT - 0.15 * (m <> '' AND NOT known)::INT - 0.3 * empty::INT - 0.3 * odd::INT - 0.1 * (m <> '' AND starts_with(lower(n), lower(m)))::INT), 2)::DOUBLE AS score,
          concat_ws(',', CASE WHEN length(n) < 2 THEN 'name_too_short' END, CASE WHEN length(n) > 50 THEN 'name_too_long' END, CASE WHEN generic THEN 'generic_name' END, CASE WHEN m = '' THEN 'no_manufacturer' END, CASE WHEN m <> '' AND NOT known THEN 'unknown_manufacturer' END, CASE WHEN empty THEN 'no_details' END, CASE WHEN odd THEN 'suspicious_name' END, CASE WHEN m <> '' AND starts_with(lower(n), lower(m)) THEN 'name_has_manufacturer' END) AS issues FROM g)
        SELECT id, score, issues, score >= 0.5 AND NOT generic AS valid, score < 0.7 OR issues <> '' AS review FROM s""",
    "detect_issues": f"""WITH {SQL_ITEMS}, p AS (SELECT id, code_model, lower(CASE WHEN id % 2 = 0 THEN ['ILME-FX6', 'eos r5', 'FR7', 'Alexa Mini', 'GY-HC', 'ursa', 'x1', 'HDC', 'cr-n300'][1 + (id // 2) % 9] ELSE name END) AS n, CASE WHEN id % 6 <> 0 THEN ['Sony', 'Canon', 'Panasonic', 'ARRI'][1 + (id // 3) % 4] END AS m FROM items),
        x AS (SELECT id, concat_ws(',', CASE WHEN m IS NULL THEN 'missing_manufacturer' END, CASE WHEN coalesce(code_model, '') = '' THEN 'missing_code_model' END, CASE WHEN m <> 'Sony' AND regexp_matches(n, '^(ilce-|ilme-|pxw-|hdc-|hxc-|brc-|src-|fr)') THEN 'manufacturer_mismatch:Sony' END,
          CASE WHEN m <> 'Panasonic' AND regexp_matches(n, '^(aw-|ag-|dc-)') THEN 'manufacturer_mismatch:Panasonic' END, CASE WHEN m <> 'Canon' AND regexp_matches(n, '^(cr-|eos|xl-)') THEN 'manufacturer_mismatch:Canon' END, CASE WHEN m <> 'Blackmagic' AND regexp_matches(n, '^(ursa|pyxis|micro)') THEN 'manufacturer_mismatch:Blackmagic' END,
          CASE WHEN m <> 'ARRI' AND regexp_matches(n, '^(alexa|amira)') THEN 'manufacturer_mismatch:ARRI' END, CASE WHEN m <> 'JVC' AND regexp_matches(n, '^(gy-|kh-)') THEN 'manufacturer_mismatch:JVC' END, CASE WHEN length(n) <= 2 THEN 'name_too_short' END) AS issues FROM p) SELECT * FROM x WHERE issues <> ''""",
    "clean_model_names": rf"""WITH {SQL_ITEMS}, c AS (SELECT id, manufacturer AS m, CASE id % 5 WHEN 2 THEN 'Brand#1 ' || name WHEN 4 THEN 'Sonya ' || name WHEN 3 THEN regexp_replace(name, '^red ', '') ELSE name END AS n FROM items) SELECT id, CASE WHEN m IS NOT NULL AND starts_with(lower(n), lower(m) || ' ') THEN trim(substring(n, length(m) + 1)) ELSE trim(n) END AS name FROM c""",
    "normalize_manufacturer": "SELECT p_partkey AS id, CASE WHEN p_partkey % 8 <> 0 THEN ['Sony', 'Blackmagic', 'Grass Valley', 'Grass Valley', 'Z CAM', 'Other Maker X', NULL][1 + p_partkey % 7] END AS maker FROM part",
    "vendor_sheet_import": r"""WITH c AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE regexp_replace(p_name, '^red ', '') END AS n, (p_partkey % 7 + 10)::VARCHAR AS code, 'r-' || (p_partkey % 4) AS a, p_brand AS b FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 17 <> 0),
        p AS (SELECT n, code, unnest(list_distinct([CASE a WHEN 'r-2' THEN 'Romeo' WHEN 'r-3' THEN 'romeo' ELSE a END, b, 'Alpha'])) AS port FROM c)
        SELECT min(n) AS name, 'Sony' AS manufacturer, min(code) AS code_model, string_agg(DISTINCT port, ',' ORDER BY port) AS ports FROM p GROUP BY lower(n)""",
    "upsert_catalog": f"""WITH {SQL_ITEMS}, {SQL_FULL}, keyed AS (SELECT *, {SQL_KEY} AS k FROM full_), o AS (SELECT *, lower(name) AS n FROM keyed WHERE id % 2 = 0),
        i AS (SELECT *, lower(name) AS n FROM keyed WHERE id % 2 = 1 AND k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY lower(name)) = 1),
        hits AS (SELECT i.*, coalesce((SELECT min(o.id) FROM o WHERE o.n = i.n), (SELECT min(o.id) FROM o WHERE o.k = i.k)) AS into_ FROM i),
        t AS (SELECT into_, max(manufacturer) AS manufacturer, max(doc_url) AS doc_url, max(manufacturer_url) AS manufacturer_url, flatten(list(protocols)) AS protocols, flatten(list(notes)) AS notes FROM hits WHERE into_ IS NOT NULL GROUP BY into_)
        SELECT o.id, o.name, coalesce(t.manufacturer, o.manufacturer) AS manufacturer, CASE WHEN into_ IS NULL THEN o.code_model ELSE 'NEW' END AS code_model, coalesce(t.doc_url, o.doc_url) AS doc_url, coalesce(t.manufacturer_url, o.manufacturer_url) AS manufacturer_url,
               array_to_string(list_sort(CASE WHEN into_ IS NULL THEN o.ports ELSE list_append(o.ports, 'X') END), ',') AS ports, array_to_string(list_sort(list_distinct(list_concat(o.protocols, coalesce(t.protocols, [])))), ',') AS protocols,
               array_to_string(list_sort(list_distinct(CASE WHEN into_ IS NULL THEN o.controls ELSE list_append(o.controls, 'zoom') END)), ',') AS controls, array_to_string(list_sort(list_distinct(list_concat(o.notes, coalesce(t.notes, [])))), ',') AS notes FROM o LEFT JOIN t ON into_ = o.id
        UNION ALL SELECT NULL, n, manufacturer, 'NEW', doc_url, manufacturer_url, 'X', array_to_string(list_sort(protocols), ','), 'zoom', array_to_string(notes, ',') FROM hits WHERE into_ IS NULL""",
    "merge_extractions": rf"WITH {SQL_ITEMS}, {SQL_FULL} SELECT lower(coalesce(manufacturer, 'unknown')) || ':' || regexp_replace(lower(name), '[-_\s]', '', 'g') AS key, arg_max(name, struct_pack(a := length(name), b := -id)) AS name, {_LAST}, {_UNIONS}, count(*) AS merged FROM full_ GROUP BY 1",
    "merge_by_code": f"WITH {SQL_ITEMS}, {_CODED}, c AS (SELECT *, row_number() OVER (PARTITION BY code_model ORDER BY (replace(lower(name), '-', '') = replace(lower(code_model), '-', ''))::INT, length(name), name DESC, id) AS r FROM coded WHERE code_model IS NOT NULL) SELECT code_model, arg_min(id, r) AS id, arg_min(name, r) AS name, array_to_string(list_sort(list_distinct(flatten(list(ports)))), ',') AS ports, count(*) AS merged FROM c GROUP BY code_model UNION ALL SELECT code_model, id, name, array_to_string(ports, ','), 1 FROM coded WHERE code_model IS NULL",
    "duplicate_groups": f"""WITH RECURSIVE {SQL_ITEMS}, {_CODED}, keyed AS (SELECT *, {SQL_KEY} AS k FROM coded), e AS (SELECT a.id AS a, b.id AS b FROM keyed a JOIN keyed b ON a.k = b.k AND lower(coalesce(a.manufacturer, '')) = lower(coalesce(b.manufacturer, '')) AND a.id <> b.id WHERE a.k <> ''
          UNION SELECT a.id, b.id FROM keyed a JOIN (SELECT min(id) AS id, lower(name) AS n FROM keyed WHERE k <> '' GROUP BY 2) b ON lower(a.code_model) = b.n AND a.id <> b.id WHERE a.k <> ''), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(id, group_id) AS (SELECT a, least(a, b) FROM w UNION SELECT w.b, r.group_id FROM r JOIN w ON w.a = r.id) SELECT id, min(group_id) AS group_id FROM r GROUP BY id""",
    "merge_into_primary": f"WITH {SQL_ITEMS}, {SQL_FULL}, o AS (SELECT *, id % 6 IN (1, 2) AS moved, CASE WHEN id % 6 IN (1, 2) THEN id - id % 6 ELSE id END AS into_ FROM full_) SELECT into_ AS id, arg_min(name, struct_pack(moved, id)) AS name, {_FIRST}, {_UNIONS}, max(confidence) AS confidence, count(*) = 1 AND bool_or(needs_review) AS needs_review, count(*) AS merged FROM o GROUP BY into_",
    "strip_name_prefix": f"WITH {SQL_ITEMS}, c AS (SELECT id, CASE WHEN starts_with(lower(name), lower(manufacturer || ' ')) THEN trim(substring(name, length(manufacturer) + 2)) ELSE name END AS clean FROM items) SELECT min(id) AS id, arg_min(clean, id) AS name, count(*) AS merged FROM c GROUP BY lower(clean)",
    "filter_catalog": f"WITH {SQL_ITEMS}, {SQL_FULL}, f AS (SELECT * FROM full_ WHERE lower(manufacturer) = 'brand#3' AND list_contains(ports, 'R-1') AND list_contains(protocols, 'x1')) SELECT id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY manufacturer, name, id LIMIT 30 OFFSET 1",
    "review_queue": f"WITH {SQL_ITEMS} SELECT id, confidence FROM items WHERE needs_review ORDER BY confidence, created_at DESC, id LIMIT 40",
    "catalog_facets": f"WITH {SQL_ITEMS}, {SQL_FULL} SELECT DISTINCT 'manufacturer' AS facet, manufacturer AS value FROM items WHERE manufacturer IS NOT NULL UNION ALL SELECT DISTINCT 'device_type', device_type FROM items UNION ALL SELECT DISTINCT 'port', unnest(ports) FROM items UNION ALL SELECT DISTINCT 'protocol', unnest(protocols) FROM full_",
    "catalog_stats": f"WITH {SQL_ITEMS} SELECT 'total' AS name, count(*) AS n FROM items UNION ALL SELECT 'manufacturers', count(DISTINCT manufacturer) FROM items UNION ALL SELECT 'source:' || source, count(*) FROM items GROUP BY source",
    "related_items": f"""WITH {SQL_ITEMS}, s AS (SELECT a.id, b.id AS other, 3 * coalesce((a.manufacturer = b.manufacturer)::INT, 0) + 3 * (a.device_type = b.device_type)::INT + len(list_intersect(a.ports, b.ports)) + (a.id % 6 = b.id % 6)::INT + (a.id % 10 = b.id % 10)::INT AS score FROM items a JOIN items b ON a.id <> b.id WHERE a.id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "compare_items": f"""WITH {SQL_ITEMS}, {SQL_FULL}, o AS (SELECT id // 4 AS set_id, * FROM full_), n AS (SELECT set_id, count(*) AS n, coalesce(string_agg(DISTINCT manufacturer, ',' ORDER BY manufacturer), '') AS manufacturers FROM o GROUP BY set_id),
        h AS (SELECT set_id, kind, value, count(*) AS have FROM (SELECT set_id, 'port' AS kind, unnest(ports) AS value FROM o UNION ALL SELECT set_id, 'protocol', unnest(protocols) FROM o) GROUP BY ALL)
        SELECT set_id, n, manufacturers, coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM h WHERE kind = 'port' AND h.set_id = n.set_id AND have = n.n), '') AS ports,
               coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM h WHERE kind = 'protocol' AND h.set_id = n.set_id AND have = n.n), '') AS protocols FROM n""",
    "lookup_codes": f"WITH {SQL_ITEMS}, k AS (SELECT manufacturer, name, 'K' || min(id) AS known FROM items WHERE manufacturer IS NOT NULL GROUP BY ALL) SELECT id, coalesce(code_model, known) AS code_model FROM items LEFT JOIN k USING (manufacturer, name)",
    "apply_corrections": f"WITH {SQL_ITEMS} SELECT id, CASE WHEN id % 6 = 0 AND id % 10 >= 7 THEN 'fixed ' || id ELSE name END AS name, id % 6 = 0 AND id % 10 >= 7 AS corrected FROM items",
    "like_search_catalog": f"WITH {SQL_ITEMS} SELECT id, name FROM items WHERE contains(lower(name), 'ring') OR contains(lower(manufacturer), 'ring') OR contains(lower(coalesce(code_model, '')), 'ring') ORDER BY name, id LIMIT 100",
}
