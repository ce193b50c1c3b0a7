"""Every query over the derived code lists, and the same in DuckDB SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import collation
from .functions.labels import fill_missing_label as label_filled
from .operators import catalog, hierarchy, present, sheet
from .operators import search as s
from .plans import schema
from .plans.service import CodeLists
from .sources import adapters, artifact, fixtures, systems
from .sources.store import StoreSource
from .streaming.debounce import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LEVELS = fixtures.PROD_LEVELS

#: Derived tables as DuckDB sees them; the order key of a level list has the level above bit 40.
_PARTS = """parts AS (
    SELECT lpad(substr(p_brand, 7), 2, '0') AS b, lpad(CAST(p_size AS VARCHAR), 2, '0') AS z, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS k, p_name, p_type, p_size, p_partkey
    FROM part)"""


def _prod(name: str, version: str) -> str:
    gap = "" if version == "2020" else "WHERE p_size % 7 <> 0"
    status = "current" if version == "2020" else "archived"
    return f"""{name} AS (
    SELECT 'prod' AS system, '{version}' AS version, level, code, label, description, CAST(NULL AS VARCHAR) AS parent_code, '{status}' AS status,
        'test tables' AS source, CAST(NULL AS VARCHAR) AS source_url, (depth << 40) + ord AS ord, depth
    FROM (
        SELECT DISTINCT 'brand' AS level, b AS code, 'Brand ' || b AS label, NULL AS description, CAST(b AS BIGINT) AS ord, 0::BIGINT AS depth FROM parts
        UNION ALL SELECT DISTINCT 'size', b || '.' || z, 'Size ' || z, NULL, CAST(b || z AS BIGINT), 1 FROM parts {gap}
        UNION ALL SELECT 'item', b || '.' || z || '.' || k, p_name, p_type || ' ' || p_name, CAST(b || z || k AS BIGINT), 2 FROM parts))"""


_P20, _P09 = _prod("prod", "2020"), _prod("prod09", "2009")
_GEO = """geo AS (
    SELECT code, label, level, CAST(code AS BIGINT) AS ord FROM (
        SELECT lpad(CAST(r_regionkey + 1 AS VARCHAR), 2, '0') || '00000000' AS code, r_name AS label, 'Reg' AS level FROM region
        UNION ALL SELECT lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '000000', n_name, 'Prov' FROM nation
        UNION ALL SELECT lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey + 1 AS VARCHAR), 6, '0'), c_name, 'Bgy'
            FROM customer JOIN nation ON c_nationkey = n_nationkey))"""
_DOCS = """docs AS (
    SELECT 'docs' AS system, '1' AS version, lang AS level, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(7, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS code, source AS label, text AS description,
        CAST(NULL AS VARCHAR) AS parent_code, 'current' AS status, 'test tables' AS source, CAST(NULL AS VARCHAR) AS source_url, doc_id AS ord
    FROM documents)"""


def _sheet(gappy: bool) -> str:
    size = "CASE WHEN p_size % 7 <> 0 THEN b || '.' || z END" if gappy else "b || '.' || z"
    return f"""sheet AS (
    SELECT CAST(b || z || k AS BIGINT) AS row_no, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY z, k) = 1 THEN b END AS brand,
        CASE WHEN row_number() OVER (PARTITION BY b, z ORDER BY z, k) = 1 THEN {size} END AS size, b || '.' || z || '.' || k AS item, p_name AS description
    FROM parts)"""


_PARSED = """f AS (
        SELECT *, last_value(brand IGNORE NULLS) OVER w AS fb, last_value(size IGNORE NULLS) OVER w AS fs FROM sheet WINDOW w AS (ORDER BY row_no ROWS UNBOUNDED PRECEDING)),
    parsed AS (
        SELECT row_no * 10 AS ord, 'brand' AS level, brand AS code, description AS label, CAST(NULL AS VARCHAR) AS parent_code FROM f WHERE brand IS NOT NULL
        UNION ALL SELECT row_no * 10 + 1, 'size', size, description, fb FROM f WHERE size IS NOT NULL
        UNION ALL SELECT row_no * 10 + 2, 'item', item, description, coalesce(fs, fb) FROM f WHERE item IS NOT NULL)"""
_COLS = ", ".join(schema.COLUMNS)
_NORM = r"regexp_replace(trim(lower({0}), ' ' || chr(9) || chr(13) || chr(10)), '[\t\n\f\r\p{{Z}}]+', ' ', 'g')"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _search_sql(ctes: str, table: str, normed: str, level: str | None = None, limit: int = 100, blank: bool = False) -> str:
    q, where = _quoted(normed), f"WHERE level = {_quoted(level)}" if level is not None else ""
    if blank:
        tier, keep = "CAST(NULL AS INTEGER)", ""
    else:
        label, description = _NORM.format("label"), _NORM.format("description")
        tier = f"""CASE WHEN lower(code) = {q} THEN 1 WHEN starts_with(lower(code), {q}) THEN 2 WHEN {label} = {q} THEN 3
            WHEN starts_with({label}, {q}) THEN 4 WHEN contains({label}, {q}) THEN 5 WHEN contains({description}, {q}) THEN 6 END"""
        keep = "WHERE tier IS NOT NULL"
    return f"""WITH {ctes}, t AS (SELECT *, {tier} AS tier FROM {table} {where}),
        r AS (SELECT *, row_number() OVER (ORDER BY tier, ord) AS pos FROM t {keep})
        SELECT {_COLS}, tier, pos FROM r WHERE pos <= {limit}"""


def _searches() -> None:
    def plain(spark, d):
        return fixtures.prod_rows(spark, d)

    def padded(spark, d):
        label = F.when(F.col("level") == "item", F.concat(F.lit("  "), F.replace("label", F.lit(" "), F.lit(" \t  ")), F.lit("\n"))).otherwise(F.col("label"))
        return plain(spark, d).withColumn("label", label)

    def typed(spark, d):
        kind = F.regexp_extract("description", r"^(\S+)", 1)
        return plain(spark, d).withColumn("label", F.when(F.col("level") == "item", F.concat("label", F.lit(" ("), kind, F.lit(")"))).otherwise(F.col("label")))

    def signed(spark, d):
        return plain(spark, d).withColumn("label", F.when(F.col("level") == "item", F.concat("label", F.lit(" 0.5%_[x]"))).otherwise(F.col("label")))

    prod = f"{_PARTS}, {_P20}"
    sig = prod + ", list AS (SELECT * REPLACE (CASE WHEN level = 'item' THEN label || ' 0.5%_[x]' ELSE label END AS label) FROM prod)"
    pad = prod + ", list AS (SELECT * REPLACE (CASE WHEN level = 'item' THEN '  ' || replace(label, ' ', ' ' || chr(9) || '  ') || chr(10) ELSE label END AS label) FROM prod)"
    typ = prod + r", list AS (SELECT * REPLACE (CASE WHEN level = 'item' THEN label || ' (' || regexp_extract(description, '^(\S+)', 1) || ')' ELSE label END AS label) FROM prod)"
    cases = [
        ("search_ranked", plain, prod, "prod", "13", "13", None, 100), ("search_code_exact", plain, prod, "prod", "13.07", "13.07", None, 100),
        ("search_code_prefix", plain, prod, "prod", "13.0", "13.0", None, 100), ("search_label_exact", plain, prod, "prod", "red widget", "red widget", None, 100),
        ("search_label_prefix", plain, prod, "prod", "red", "red", None, 500), ("search_label_contains", plain, prod, "prod", "widget", "widget", None, 500),
        ("search_description", plain, prod, "prod", "economy", "economy", None, 500), ("search_level_filter", plain, prod, "prod", "13", "13", "item", 100),
        ("search_limit", plain, prod, "prod", "13", "13", None, 5), ("search_limit_zero", plain, prod, "prod", "13", "13", None, 0),
        ("search_no_match", plain, prod, "prod", "no such thing", "no such thing", None, 100), ("search_unknown_level", plain, prod, "prod", "13", "13", "planet", 100),
        ("search_literal_dot", plain, prod, "prod", "13x07", "13x07", None, 100), ("search_literal_dot_hit", signed, sig, "list", "0.5%_", "0.5%_", None, 500), ("search_literal_paren", typed, typ, "list", "(economy)", "(economy)", None, 500),
        ("search_literal_percent", plain, prod, "prod", "%13_", "%13_", None, 100), ("search_literal_percent_hit", signed, sig, "list", "%_[", "%_[", None, 500), ("search_case_insensitive", plain, prod, "prod", "ReD WiDgEt", "red widget", None, 100),
        ("search_whitespace", padded, pad, "list", " red \t  widget\n", "red widget", None, 500),
        ("search_documents", fixtures.docs, _DOCS, "docs", "src1", "src1", None, 1000), ("search_documents_text", fixtures.docs, _DOCS, "docs", "license", "license", None, 1000),
        ("search_documents_whitespace", fixtures.docs, _DOCS, "docs", ".\n the", ". the", None, 1000),
    ]
    for name, make, ctes, table, text, normed, level, limit in cases:
        run = lambda spark, d, make=make, text=text, level=level, limit=limit: s.search(make(spark, d), text, level, limit, ranked=True)
        query(name, _search_sql(ctes, table, normed, level, limit))(run)
    for name, text, level in (("browse_all", "", None), ("browse_level", " \t\n", "size"), ("browse_null", None, "brand")):
        run = lambda spark, d, text=text, level=level: s.search(plain(spark, d), text, level, 100, ranked=True)
        query(name, _search_sql(prod, "prod", "", level, 100, blank=True))(run)
    for name, code in (("entry_lookup", "13.07"), ("entry_lookup_miss", " 13.07")):
        query(name, f"WITH {prod} SELECT {_COLS} FROM prod WHERE code = {_quoted(code)}")(lambda spark, d, code=code: s.entry(plain(spark, d), code))

    indexed = [
        ("index_code", "prod", prod, "prod", "13", "13", None, 100), ("index_label_prefix", "prod", prod, "prod", "red", "red", None, 500), ("index_label_contains", "prod", prod, "prod", "widget", "widget", "item", 500),
        ("index_description", "prod", prod, "prod", "economy", "economy", None, 500), ("index_text", "docs", _DOCS, "docs", "license", "license", None, 1000),
        ("index_text_rare", "docs", _DOCS, "docs", "Under  CC by-nc 4.0.", "under cc by-nc 4.0.", None, 1000), ("index_text_short", "docs", _DOCS, "docs", "zu", "zu", "de", 20),
    ]
    for name, which, ctes, table, text, normed, level, limit in indexed:
        run = lambda spark, d, which=which, text=text, level=level, limit=limit: fixtures.indexed(spark, d, which).search(text, level, limit, ranked=True)
        query(name, _search_sql(ctes, table, normed, level, limit))(run)
    query("index_browse", _search_sql(prod, "prod", "", None, 100, blank=True))(lambda spark, d: fixtures.indexed(spark, d, "prod").search("", None, 100, ranked=True))
    query("index_entry", f"WITH {prod} SELECT {_COLS} FROM prod WHERE code = '13.07'")(lambda spark, d: fixtures.indexed(spark, d, "prod").entry("13.07"))


_searches()

_J1 = """parented AS (
    SELECT c.* EXCLUDE (parent_code), p.parent_code FROM lists c LEFT JOIN (
        SELECT c.version, c.level, c.code, arg_max(p.code, length(p.code)) AS parent_code
        FROM (SELECT DISTINCT version, level, code, depth FROM lists) c JOIN (SELECT DISTINCT version, code, depth FROM lists) p
            ON p.version = c.version AND p.depth = c.depth - 1 AND starts_with(c.code, p.code) AND length(p.code) < length(c.code)
        GROUP BY ALL) p ON p.version = c.version AND p.level = c.level AND p.code = c.code)"""
_BOTH = f"{_PARTS}, {_P20}, {_P09}, lists AS (SELECT * FROM prod UNION ALL SELECT * FROM prod09)"
_J2 = """zeroed AS (
    SELECT g.*, z.parent_code FROM geo g LEFT JOIN (
        SELECT c.code, arg_min(p.code, k) AS parent_code
        FROM (SELECT DISTINCT code FROM geo) c, range(1, 10) r(k), (SELECT DISTINCT code FROM geo) p
        WHERE p.code = left(c.code, CAST(10 - k AS BIGINT)) || repeat('0', CAST(k AS BIGINT)) AND p.code <> c.code
        GROUP BY c.code) z ON z.code = g.code)"""
_GEO_ROW = "'geo' AS system, 'Q2_2026' AS version, level, code, label, CAST(NULL AS VARCHAR) AS description, parent_code, 'current' AS status, 'test tables' AS source, CAST(NULL AS VARCHAR) AS source_url"
_P20_ONLY = f"{_PARTS}, {_P20}, lists AS (SELECT * FROM prod)"
_LEVEL_NAME = "CASE level WHEN 'brand' THEN 'section' WHEN 'size' THEN 'division' ELSE 'group' END"
_PSIC_ROW = f"'psic' AS system, '2026' AS version, {_LEVEL_NAME} AS level, code, label, description, parent_code, status, source, source_url"


@query("parent_by_prefix", f"WITH {_BOTH}, {_J1} SELECT version, level, code, parent_code FROM parented")
def parent_by_prefix(spark, d):
    both = fixtures.prod_rows(spark, d).unionByName(fixtures.prod_rows(spark, d, "2009"))
    return hierarchy.parent_by_prefix(both, LEVELS).select("version", "level", "code", "parent_code")


@query("parent_by_zero_suffix", f"WITH {_GEO}, {_J2} SELECT level, code, parent_code FROM zeroed")
def parent_by_zero_suffix(spark, d):
    return fixtures.geo(spark, d).select("level", "code", "parent_code")


@query("get_classification", f"WITH {_BOTH}, {_GEO}, {_J1}, {_J2} SELECT {_COLS} FROM parented UNION ALL SELECT {_GEO_ROW} FROM zeroed")
def get_classification(spark, d):
    """Every published edition in one scan; parents were found when they were published."""
    return fixtures.published(spark, d).read().where("system <> 'psic'").select(*schema.COLUMNS)


@query("current_classifications", f"WITH {_P20_ONLY}, {_GEO}, {_J1}, {_J2} SELECT {_COLS} FROM parented UNION ALL SELECT {_GEO_ROW} FROM zeroed UNION ALL SELECT {_PSIC_ROW} FROM parented")
def current_classifications(spark, d):
    """The current edition of every system, by a join with the catalog that prunes partitions."""
    return fixtures.published(spark, d).current().select(*schema.COLUMNS)


@query("built_edition", f"WITH {_PARTS}, {_sheet(True)}, {_PARSED}, n AS (SELECT count(*) AS rows FROM parsed) SELECT level, code, label, parent_code, rows, (SELECT count(*) FROM parsed WHERE level = 'size') AS sizes FROM parsed, n")
def built_edition(spark, d):
    """A sheet without row numbers, parsed, counted and published, read back through the service with what was observed."""
    store = fixtures.built(spark, d)
    lists = CodeLists(spark, {"sheet": [StoreSource(store, "sheet")]})
    stated = lists.metadata("sheet", "1")
    return lists.get("sheet", "1").select("level", "code", "label", "parent_code", F.lit(stated["rows"]).alias("rows"), F.lit(stated["parsed_counts"]["size"]).cast("long").alias("sizes"))


@query("get_level", f"WITH {_BOTH}, {_J1} SELECT {_COLS} FROM parented WHERE version = '2009' AND level = 'item'")
def get_level(spark, d):
    return fixtures.prod(spark, d, "2009").where("level = 'item'").select(*schema.COLUMNS)


#: Row numbers of the derived sheets are codes; a block of them is one brand.
_BLOCK = 10**9


def _sheet_file(spark, d, gappy=False):
    """Written as CSV, its columns in another order, and read, checked and typed as a sheet is."""
    path = artifact.scratch(spark, "sheet")
    fixtures.prod_sheet(spark, d, gappy).select("description", *reversed(LEVELS), "row_no").write.option("header", True).csv(path)
    columns = ["row_no", *LEVELS, "description"]
    found = artifact.read_sheet(spark, path, columns).withColumn("row_no", F.col("row_no").cast("long"))
    sheet.check_sheet(found, columns)
    return found


def _parse(spark, d, gappy=False):
    return sheet.parse_wide_sheet(_sheet_file(spark, d, gappy), LEVELS, block=_BLOCK)


for _name, _gappy in (("", False), ("_gappy", True)):
    query(f"sheet_scan{_name}", f"WITH {_PARTS}, {_sheet(_gappy)} SELECT * FROM sheet")(lambda spark, d, g=_gappy: _sheet_file(spark, d, g))
    query(f"parse_wide_sheet{_name}", f"WITH {_PARTS}, {_sheet(_gappy)}, {_PARSED} SELECT * FROM parsed")(lambda spark, d, g=_gappy: _parse(spark, d, g))


@query("level_counts", f"WITH {_PARTS}, {_sheet(True)}, {_PARSED} SELECT level, count(*) AS n FROM parsed GROUP BY level")
def level_counts(spark, d):
    return sheet.level_counts(_parse(spark, d, True), LEVELS)


@query(
    "count_reconciliation",
    f"""WITH {_PARTS}, {_sheet(True)}, {_PARSED}, n AS (SELECT level, count(*) AS parsed FROM parsed GROUP BY level),
        e AS (SELECT 'brand' AS level, count(DISTINCT b) AS stated FROM parts UNION ALL SELECT 'size', count(DISTINCT b || z) FROM parts UNION ALL SELECT 'item', count(*) FROM parts)
        SELECT level, parsed, stated, CASE WHEN parsed = stated THEN 'PASS' ELSE 'WARN (documented discrepancy)' END AS result FROM n JOIN e USING (level)""",
)
def count_reconciliation(spark, d):
    plain = sheet.level_counts(_parse(spark, d), LEVELS)
    return sheet.reconcile(sheet.level_counts(_parse(spark, d, True), LEVELS), plain)


_MISSING = "CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS label, CASE WHEN p_partkey % 10 = 0 THEN p_type || ' This item' END AS description"


@query(
    "fill_missing_label",
    f"""WITH {_PARTS}, m AS (SELECT b || '.' || z || '.' || k AS code, {_MISSING} FROM parts)
        SELECT code, coalesce(label, CASE WHEN regexp_matches(description, '^([A-Z0-9 ,\\-]+?)\\s[A-Z][a-z]') THEN trim(regexp_extract(description, '^([A-Z0-9 ,\\-]+?)\\s[A-Z][a-z]', 1)) END, code) AS label FROM m""",
)
def fill_missing_label(spark, d):
    items = fixtures.pull_prod(spark, d, "2020", "item").join(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_type"), F.substring("value", 7, 20).cast("long") == F.col("p_partkey"))
    label = F.when(F.col("p_partkey") % 5 != 0, F.col("label"))
    description = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_type", F.lit(" This item")))
    return items.select(F.col("value").alias("code"), label_filled(label, description, F.col("value")).alias("label"))


@query("conform_canonical", f"WITH {_PARTS}, {_P20} SELECT {_COLS}, ord FROM prod WHERE level = 'size'")
def conform_canonical(spark, d):
    raw = fixtures.pull_prod(spark, d, "2020", "size").withColumnRenamed("value", "code").withColumn("unused", F.lit(1))
    order = F.lit(1 << 40) + F.col("ord")
    return schema.conform(raw, order, system="prod", version="2020", level="size", status="current", source=fixtures.SOURCE, source_url=None)


@query("union_levels", f"WITH {_PARTS}, {_P20} SELECT level, code, label, description, ord FROM prod")
def union_levels(spark, d):
    return adapters.union_levels({lv: fixtures.pull_prod(spark, d, "2020", lv) for lv in LEVELS}, list(LEVELS))


@query("src_level_scan", f"WITH {_PARTS}, {_P20} SELECT code AS value, label, description FROM prod WHERE level = 'item'")
def src_level_scan(spark, d):
    return fixtures.pull_prod(spark, d, "2020", "item").select("value", "label", "description")


@query("datasource_level", f"WITH {_PARTS}, {_P09} SELECT system, version, level, code, label, description, (depth << 40) + row_number() OVER (PARTITION BY level ORDER BY ord) - 1 AS ord FROM prod09 WHERE level <> 'size'")
def datasource_level(spark, d):
    """Two levels of one edition through a data source; the others are not pulled."""
    return fixtures.pulled(spark, d).where("version = '2009' and level in ('brand', 'item')")


@query("src_release_scan", f"WITH {_GEO} SELECT code, label, level FROM geo")
def src_release_scan(spark, d):
    return fixtures.pull_geo(spark, d).select("code", "label", "level")


@query("src_artifact_scan", f"WITH {_PARTS}, {_P09} SELECT {_COLS}, ord FROM prod09")
def src_artifact_scan(spark, d):
    """Written as the stored code lists are, and read back."""
    path = artifact.scratch(spark, "code-lists")
    artifact.write_editions(fixtures.prod_rows(spark, d, "2009"), path)
    found = artifact.read_editions(spark, path)
    return found.where((found.system == "prod") & (found.version == "2009"))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else _quoted(v) for v in r) + ")" for r in rows) + ")"


#: What the adapters of the seven systems list, once more as a counterpart: editions in order with their status, levels from the top.
_FIXED_EDITIONS = [
    ("psgc", "Q1_2023", 1, "archived"), ("psgc", "Q2_2026", 2, "current"), ("psic", "2019", 1, "archived"), ("psic", "2026", 2, "current"), ("psoc", "2012", 1, "current"), ("psced", "2017", 1, "current"),
    ("pcoicop", "2020", 1, "current"), ("pcoicop", "2009", 2, "archived"), ("pcpc", "2002", 1, "current"), ("psccs", "2018", 1, "current"),
]
_FIXED_LEVELS = "psic:section,division,group,class,sub-class;psoc:major,sub-major,minor,unit;psced:levels,broadfield,narrowfield,detailedfield;pcoicop:divisions,groups,class,sub-class,item,subitem;pcpc:sections,divisions,groups,classes,sub-classes,item;psccs:section,divisions,groups,classes,sub-classes"
_EDITIONS = f"SELECT * FROM {_values(_FIXED_EDITIONS)} t(system, version, ord, status)"


def _years(table: str = "orders", system: str = "o_orderpriority", day: str = "o_orderdate") -> str:
    return f"""(SELECT system, version, CAST(row_number() OVER w AS INTEGER) AS ord, CASE WHEN n > lag(n, 1, 0) OVER w THEN 'current' ELSE 'archived' END AS status FROM (
        SELECT {system} AS system, CAST(year({day}) AS VARCHAR) AS version, count(*) AS n FROM {table} GROUP BY ALL) WINDOW w AS (PARTITION BY system ORDER BY version))"""


_SHIPPED = ("lineitem", "l_returnflag", "l_shipdate")


@query("src_versions", "SELECT * FROM (VALUES ('prod', '2009'), ('prod', '2020')) t(system, version)")
def src_versions(spark, d):
    path = artifact.scratch(spark, "code-lists")
    for version in ("2009", "2020"):
        artifact.write_editions(fixtures.prod_rows(spark, d, version), path)
    return artifact.list_editions(spark, path)


def _systems(spark, d):
    return systems.adapters(spark, lambda v: fixtures.pull_geo(spark, d), store=fixtures.published(spark, d))


_PSIC = [("section", "sections"), ("division", "divisions"), ("group", "groups"), ("class", "classes"), ("sub-class", "sub-classes")]


@query(
    "level_arg_map",
    f"""WITH {_PARTS}, {_P20}, n AS (SELECT {_LEVEL_NAME} AS level, count(*) AS n FROM prod GROUP BY 1)
        SELECT 'psic' AS system, level, level_arg, coalesce(n, 0) AS n FROM {_values(_PSIC)} t(level, level_arg) LEFT JOIN n USING (level)""",
)
def level_arg_map(spark, d):
    """What the source calls the levels of a system, and the rows that the stored edition has there."""
    known = catalog.level_args(spark, {k: v for k, v in _systems(spark, d).items() if k == "psic"})
    stored = fixtures.published(spark, d).edition("psic", "2026").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return known.join(stored, "level", "left").select("system", "level", "level_arg", F.coalesce("n", F.lit(0)).alias("n"))


@query("version_status", f"SELECT system, version, CASE WHEN version = (SELECT max(version) FROM {_years()}) THEN 'current' ELSE 'archived' END AS status FROM {_years()}")
def version_status(spark, d):
    versions = fixtures.yearly_editions(spark, d)
    return catalog.version_status(versions, "latest", versions.agg(F.max("version")).first()[0])


@query("current_version", f"SELECT system, coalesce(arg_min(version, ord) FILTER (WHERE status = 'current'), arg_min(version, ord)) AS current_version FROM {_years(*_SHIPPED)} GROUP BY system")
def current_version(spark, d):
    return catalog.current_version(fixtures.yearly_editions(spark, d, *_SHIPPED))


_BUSIEST = "(SELECT o_orderpriority AS system, arg_max(y, n * 10000 + y) AS y FROM (SELECT o_orderpriority, year(o_orderdate) + CASE WHEN o_orderpriority LIKE '1%' THEN 100 ELSE 0 END AS y, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1)"


@query(
    "current_version_latest",
    f"""SELECT v.system, coalesce(max(CASE WHEN version = latest THEN version END), arg_max(version, ord)) AS current_version
        FROM {_years()} v LEFT JOIN (SELECT system, CAST(y AS VARCHAR) AS latest FROM {_BUSIEST}) l ON l.system = v.system GROUP BY v.system""",
)
def current_version_latest(spark, d):
    """The busiest year counts as the latest edition; that of one system is not listed."""
    year = F.year("o_orderdate") + F.when(F.col("o_orderpriority").startswith("1"), 100).otherwise(0)
    counted = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("system"), year.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    latest = counted.groupBy("system").agg(F.max_by("y", F.col("n") * 10000 + F.col("y")).cast("string").alias("latest"))
    return catalog.current_version_latest(fixtures.yearly_editions(spark, d), latest)


@query(
    "versions_union",
    f"""WITH u AS (
            SELECT system, version, min(o) AS o FROM (
                SELECT system, version, -ord AS o FROM {_years()} WHERE version < '1996' UNION ALL SELECT system, version, 100 + ord FROM {_years()} WHERE version > '1993')
            GROUP BY system, version)
        SELECT system, row_number() OVER (PARTITION BY system ORDER BY o) AS pos, version FROM u""",
)
def versions_union(spark, d):
    years = fixtures.yearly_editions(spark, d)
    return catalog.versions_union(years.where("version < '1996'").withColumn("ord", -F.col("ord")), years.where("version > '1993'"))


@query(
    "available_levels",
    f"WITH {_BOTH} SELECT system, row_number() OVER (PARTITION BY system ORDER BY o) AS pos, level FROM (SELECT system, level, min(ord) AS o FROM lists GROUP BY system, level)",
)
def available_levels(spark, d):
    return catalog.available_levels(fixtures.prod_rows(spark, d).unionByName(fixtures.prod_rows(spark, d, "2009")))


@query(
    "distinct_levels_sorted",
    f"""WITH {_GEO}, b AS (SELECT CASE WHEN ord % 3 = 0 THEN '' ELSE level END AS level FROM geo)
        SELECT 'geo' AS system, 'Q2_2026' AS version, row_number() OVER (ORDER BY level) AS pos, level FROM (SELECT DISTINCT level FROM b WHERE level <> '')""",
)
def distinct_levels_sorted(spark, d):
    some_blank = F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("level"))
    rows = fixtures.pull_geo(spark, d).withColumn("level", some_blank).withColumn("system", F.lit("geo")).withColumn("version", F.lit("Q2_2026"))
    return catalog.distinct_levels_sorted(rows)


_SYSTEM_ROWS = [(x.id, x.display_name, x.short_name, x.category, x.adapter, x.supports_history, x.source, x.source_url) for x in systems.SYSTEMS]
_LEVEL_ROWS = [(part.split(":")[0], i, lv) for part in _FIXED_LEVELS.split(";") for i, lv in enumerate(part.split(":")[1].split(","))]
_REGISTRY = f"""WITH {_GEO}, r AS (SELECT * FROM {_values(_SYSTEM_ROWS)} t(id, display_name, short_name, category, adapter, supports_history, source, source_url)), e AS ({_EDITIONS}),
    l AS (SELECT * FROM {_values(_LEVEL_ROWS)} t(system, ord, level) UNION ALL SELECT 'psgc', row_number() OVER (ORDER BY level), level FROM (SELECT DISTINCT level FROM geo)),
    registry AS (
        SELECT id, display_name, short_name, category, adapter, (SELECT string_agg(version, '|' ORDER BY ord) FROM e WHERE system = id) AS available_versions,
            (SELECT coalesce(arg_min(version, ord) FILTER (WHERE status = 'current'), arg_min(version, ord)) FROM e WHERE system = id) AS current_version,
            coalesce((SELECT string_agg(level, '|' ORDER BY ord) FROM l WHERE system = id), '') AS available_levels, supports_history, source, source_url
        FROM r)"""


def _registry(spark, d):
    return catalog.registry(spark, systems.SYSTEMS, _systems(spark, d))


def _joined(reg: DataFrame) -> DataFrame:
    return reg.withColumns({c: F.array_join(c, "|") for c in ("available_versions", "available_levels")})


@query("registry", f"{_REGISTRY} SELECT * FROM registry")
def registry(spark, d):
    return _joined(_registry(spark, d))


@query("registry_row", f"{_REGISTRY} SELECT * FROM registry WHERE id = 'pcoicop'")
def registry_row(spark, d):
    return _joined(_registry(spark, d)).where("id = 'pcoicop'")


@query("registry_choices", f"{_REGISTRY} SELECT id, short_name || ' — ' || display_name AS label FROM registry")
def registry_choices(spark, d):
    return catalog.choices(_registry(spark, d))


@query("registry_sources", f"{_REGISTRY} SELECT short_name, display_name, source, source_url FROM registry")
def registry_sources(spark, d):
    return catalog.sources(_registry(spark, d))


_BROKEN = "CASE WHEN ord % 7 = 0 THEN NULL ELSE label END AS label, CASE WHEN ord % 11 = 0 THEN 'draft' WHEN ord % 13 = 0 THEN 'lost' WHEN ord % 17 = 0 THEN NULL ELSE status END AS status"


def _broken(spark, d):
    o = F.col("ord")
    status = F.when(o % 11 == 0, "draft").when(o % 13 == 0, "lost").when(o % 17 == 0, None).otherwise(F.col("status"))
    return fixtures.prod_rows(spark, d).withColumns({"label": F.when(o % 7 != 0, F.col("label")), "status": status})


@query("validate_nulls", f"WITH {_PARTS}, {_P20}, x AS (SELECT * REPLACE ({_BROKEN}) FROM prod) SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in schema.REQUIRED) + " FROM x")
def validate_nulls(spark, d):
    return schema.null_counts(_broken(spark, d))


@query("validate_status_domain", f"WITH {_PARTS}, {_P20}, x AS (SELECT * REPLACE ({_BROKEN}) FROM prod) SELECT string_agg(DISTINCT status, ', ' ORDER BY status) AS bad_statuses FROM x WHERE status NOT IN ('current', 'archived')")
def validate_status_domain(spark, d):
    return schema.bad_statuses(_broken(spark, d))


_SHOWN = 'code AS "Code", label AS "Label", level AS "Level", status AS "Status"'


@query("display_page", f"WITH {_PARTS}, {_P20} SELECT {_SHOWN} FROM (SELECT * FROM prod ORDER BY ord LIMIT 15 OFFSET 30)")
def display_page(spark, d):
    return present.display_page(fixtures.prod_rows(spark, d), 2)


@query("index_page", f"WITH {_DOCS} SELECT {_COLS}, ord FROM docs ORDER BY ord LIMIT 15 OFFSET 615")
def index_page(spark, d):
    """A deep page by the stored page index: the blocks before it are not read."""
    return fixtures.paged(spark, d).page(41).select(*schema.COLUMNS, "ord")


@query("index_next_page", f"WITH {_DOCS} SELECT {_COLS}, ord FROM docs WHERE ord > 700 ORDER BY ord LIMIT 15")
def index_next_page(spark, d):
    return fixtures.paged(spark, d).next_page(700).select(*schema.COLUMNS, "ord")


@query("display_page_sorted", f"WITH {_PARTS}, {_P20} SELECT {_SHOWN} FROM (SELECT * FROM prod WHERE contains(lower(label), 'red') ORDER BY label DESC, ord LIMIT 15)")
def display_page_sorted(spark, d):
    return present.display_page(fixtures.prod_rows(spark, d), sort="Label", descending=True, contains="red")


@query("select_by_position", f"WITH {_PARTS}, {_P20} SELECT {_COLS}, ord FROM (SELECT *, row_number() OVER (ORDER BY ord) AS p FROM prod) WHERE p = 17")
def select_by_position(spark, d):
    return present.select_by_position(fixtures.prod_rows(spark, d), 17)


@query(
    "entry_detail",
    f"""WITH {_PARTS}, {_P20}, f AS (
            SELECT code, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i, unnest(['Code', 'Label', 'Description', 'System', 'Edition / release', 'Level', 'Status', 'Source']) AS field,
                unnest([code, label, coalesce(description, 'Not available'), upper(system), version, level, CASE WHEN status = 'current' THEN 'Current' ELSE 'Archived reference' END, source]) AS value
            FROM prod)
        SELECT code, CAST(i AS BIGINT) AS pos, field, value FROM f""",
)
def entry_detail(spark, d):
    return present.entry_detail(fixtures.prod_rows(spark, d))


@query(
    "status_badge",
    f"""WITH {_BOTH} SELECT code, status, CASE WHEN status = 'current' THEN 'Current' ELSE 'Archived reference' END AS badge,
        CASE WHEN status = 'current' THEN 'success' ELSE 'secondary' END AS style FROM lists""",
)
def status_badge(spark, d):
    return present.status_badge(fixtures.prod_rows(spark, d).unionByName(fixtures.prod_rows(spark, d, "2009")))


@query("sha256_text", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"))


#: First words of texts as labels with accents, by language.
_WORDS = "words AS (SELECT lang, regexp_extract(text, '^[^\\s.,;:!?]+') AS label FROM documents)"


def _first_words(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("lang", F.regexp_extract("text", r"^[^\s.,;:!?]+", 0).alias("label"))


def _sorted_sql() -> str:
    parts = [f"SELECT lang, row_number() OVER (ORDER BY label COLLATE {x}, label) AS pos, label FROM (SELECT DISTINCT lang, label FROM words WHERE lang = '{x}')" for x in ("de", "es", "fr")]
    other = "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY label) AS pos, label FROM (SELECT DISTINCT lang, label FROM words WHERE lang NOT IN ('de', 'es', 'fr'))"
    return f"WITH {_WORDS} SELECT * FROM ({' UNION ALL '.join([*parts, other])}) WHERE pos <= 100"


@query("labels_by_language", _sorted_sql())
def labels_by_language(spark, d):
    return collation.sorted_labels(_first_words(spark, d), "label", "lang", {x: x for x in ("de", "es", "fr")})


@query("labels_spelled_alike", f"WITH {_WORDS} SELECT min(label) AS label, count(DISTINCT label) AS spellings, count(*) AS n FROM words WHERE lang IN ('es', 'fr') GROUP BY strip_accents(lower(label))")
def labels_spelled_alike(spark, d):
    return collation.spelled_alike(_first_words(spark, d).where("lang in ('es', 'fr')"), "label")


@query(
    "labels_matched_loosely",
    f"""WITH {_WORDS}, k AS (SELECT label, strip_accents(lower(label)) AS k FROM words WHERE lang IN ('es', 'fr')),
        m AS (SELECT label, CASE WHEN k = 'ene' THEN 1 WHEN starts_with(k, 'ene') THEN 2 WHEN contains(k, 'ene') THEN 3 END AS tier FROM k)
        SELECT label, tier, count(*) AS n FROM m WHERE tier IS NOT NULL GROUP BY ALL""",
)
def labels_matched_loosely(spark, d):
    rows = _first_words(spark, d).where("lang in ('es', 'fr')").withColumn("tier", collation.matching(F.col("label"), "ÈNE"))
    return rows.where("tier is not null").groupBy("label", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("display_page_by_language", f"WITH {_DOCS}, w AS (SELECT code AS \"Code\", regexp_extract(description, '^[^\\s.,;:!?]+') AS \"Label\", level AS \"Level\", status AS \"Status\", ord FROM docs) SELECT \"Code\", \"Label\", \"Level\", \"Status\" FROM w ORDER BY \"Label\" COLLATE fr, \"Label\", ord LIMIT 15 OFFSET 60")
def display_page_by_language(spark, d):
    rows = fixtures.docs(spark, d).withColumn("label", F.regexp_extract("description", r"^[^\s.,;:!?]+", 0))
    return present.display_page(rows, 4, sort="Label", collation="fr")


@query(
    "debounce_events",
    "SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n > ts + INTERVAL 6 HOURS",
)
def debounce_events(spark, d):
    return debounce(spark.read.parquet(f"{d}/events.parquet")).select("event_id", "user_id", "event_type")


def _service(spark, d) -> CodeLists:
    """Over what is published: an edition is one partition, parents are columns."""
    store = fixtures.published(spark, d)
    return CodeLists(spark, {x: [StoreSource(store, x, fixtures.SOURCE)] for x in ("prod", "geo")}, datetime.date(2024, 2, 29), systems.LICENSE)


_ROWS = f"WITH {_BOTH}, {_GEO}, n AS (SELECT system, version, count(*) AS rows FROM lists GROUP BY ALL UNION ALL SELECT 'geo', 'Q2_2026', count(*) FROM geo)"


@query("service_versions", f"{_ROWS} SELECT system, row_number() OVER (PARTITION BY system ORDER BY version) AS pos, version, version <> '2009' AS is_current, rows FROM n")
def service_versions(spark, d):
    """As the manifest has them, in the order they were published."""
    found = fixtures.published(spark, d).catalog().where("system in ('prod', 'geo')")
    return found.select("system", F.col("position").cast("long").alias("pos"), "version", (F.col("rank") == 1).alias("is_current"), "rows")


@query(
    "service_levels",
    f"""WITH {_GEO} SELECT 'geo' AS system, row_number() OVER (ORDER BY level) AS pos, level FROM (SELECT DISTINCT level FROM geo)
        UNION ALL SELECT * FROM (VALUES ('prod', 1, 'brand'), ('prod', 2, 'size'), ('prod', 3, 'item')) t(system, pos, level)""",
)
def service_levels(spark, d):
    lists = _service(spark, d)
    rows = [(x, i, lv) for x, v in (("geo", "Q2_2026"), ("prod", "2020")) for i, lv in enumerate(lists.levels(x, v), 1)]
    return spark.createDataFrame(rows, "system string, pos long, level string")


@query("service_get", f"WITH {_BOTH}, {_GEO}, {_J1}, {_J2} SELECT {_COLS} FROM parented WHERE version = '2009' UNION ALL SELECT {_GEO_ROW} FROM zeroed WHERE level = 'Prov'")
def service_get(spark, d):
    lists = _service(spark, d)
    return lists.get("prod", "2009", "").unionByName(lists.get("geo", "Q2_2026", "Prov")).select(*schema.COLUMNS)


@query("service_search", f"WITH {_BOTH}, {_J1} SELECT {_COLS} FROM (SELECT * FROM parented WHERE version = '2020' AND level = 'size' AND starts_with(lower(code), '13') ORDER BY ord LIMIT 7)")
def service_search(spark, d):
    return _service(spark, d).search("prod", "2020", " 13 ", "size", 7)


@query("service_search_all_levels", f"WITH {_BOTH}, {_J1} SELECT {_COLS} FROM (SELECT * FROM parented WHERE version = '2020' ORDER BY ord LIMIT 100)")
def service_search_all_levels(spark, d):
    return _service(spark, d).search("prod", "2020", None, "")


@query("service_search_indexed", f"WITH {_P20_ONLY}, {_J1}, p AS (SELECT {_PSIC_ROW}, ord FROM parented) SELECT {_COLS} FROM (SELECT * FROM p WHERE contains(lower(label), 'widget') AND level = 'group' ORDER BY starts_with(lower(label), 'widget') DESC, ord LIMIT 50)")
def service_search_indexed(spark, d):
    """Through the service over an edition with a stored index."""
    fixtures.published_indexed(spark, d)
    lists = CodeLists(spark, {"psic": _systems(spark, d)["psic"]})
    return lists.search("psic", "2026", "Widget", "group", 50)


@query("service_entry", f"WITH {_BOTH}, {_J1} SELECT {_COLS} FROM parented WHERE version = '2020' AND code = '13.07'")
def service_entry(spark, d):
    return _service(spark, d).entry("prod", "2020", "13.07")


@query(
    "service_metadata",
    f"""{_ROWS}, c AS (SELECT version, string_agg(level || '=' || n, ' ' ORDER BY depth) AS counts FROM (SELECT version, level, depth, count(*) AS n FROM lists GROUP BY ALL) GROUP BY version)
        SELECT 'prod' AS system, version, version AS display_version, CASE WHEN version = '2020' THEN 'current' ELSE 'archived' END AS status, 'test tables' AS source, CAST(NULL AS VARCHAR) AS source_url,
            '2024-02-29' AS retrieved_at, 'CC BY 4.0 unless otherwise stated by PSA' AS license, rows, counts
        FROM n JOIN c USING (version) WHERE system = 'prod'""",
)
def service_metadata(spark, d):
    lists = _service(spark, d)
    rows = []
    for v in lists.versions("prod"):
        m = lists.metadata("prod", v)
        counts = " ".join(f"{lv}={n}" for lv, n in m["parsed_counts"].items())
        rows.append((*[m[k] for k in ("system", "version", "display_version", "status", "source", "source_url", "retrieved_at", "license", "rows")], counts))
    return spark.createDataFrame(rows, "system string, version string, display_version string, status string, source string, source_url string, retrieved_at string, license string, rows long, counts string")
