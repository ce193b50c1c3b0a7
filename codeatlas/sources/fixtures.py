"""Code lists derived from the test tables.

``prod`` has dotted codes of brand, size and item; its edition 2020 is complete, 2009 lacks every size that
seven divides.  ``geo`` has ten-digit codes of region, nation and customer.  ``docs`` has a document per code.
Order keys come from the codes, so no global numbering is needed.

``published`` and ``indexed`` store them once an application: what reads them reads what was published, as a service does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.search_index import SearchIndex
from ..operators.search_index import build as build_index
from ..plans.build import SheetPlan, build_edition
from ..plans.schema import ORD, conform
from .adapters import LevelSource, ReleaseSource
from .datasource import read_level, register
from .files import scratch
from .store import Store

PROD_LEVELS = ("brand", "size", "item")
SOURCE = "test tables"
#: Bytes of texts in a file and in a block of the stored indexes: a file is a task of each table of the build, and what the driver keeps of tasks grows with them.
FILE_BYTES, BLOCK_BYTES = 32 << 20, 1 << 18


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.lpad(F.substring("p_brand", 7, 10), 2, "0")
    z = F.lpad(F.col("p_size").cast("string"), 2, "0")
    k = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    return _read(spark, sf_dir, "part").select(b.alias("b"), z.alias("z"), k.alias("k"), "p_name", "p_type", "p_size", "p_partkey")


def pull_prod(spark: SparkSession, sf_dir: str, version: str, level: str) -> DataFrame:
    """One level of one edition: ``value, label, ord`` and for items ``description``."""
    p = _parts(spark, sf_dir)
    if level == "brand":
        return p.select("b").distinct().select(F.col("b").alias("value"), F.concat(F.lit("Brand "), "b").alias("label"), F.col("b").cast("long").alias("ord"))
    if level == "size":
        kept = p if version == "2020" else p.where("p_size % 7 <> 0")
        return kept.select("b", "z").distinct().select(
            F.concat_ws(".", "b", "z").alias("value"), F.concat(F.lit("Size "), "z").alias("label"), F.concat("b", "z").cast("long").alias("ord")
        )
    return p.select(
        F.concat_ws(".", "b", "z", "k").alias("value"), F.col("p_name").alias("label"), F.concat("b", "z", "k").cast("long").alias("ord"), F.concat_ws(" ", "p_type", "p_name").alias("description")
    )


def prod_source(spark: SparkSession, sf_dir: str) -> LevelSource:
    return LevelSource(
        "prod", ("2009", "2020"), PROD_LEVELS, lambda v, lv: pull_prod(spark, sf_dir, v, lv), lambda v: "current" if v == "2020" else "archived", SOURCE
    )


def pull_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad((F.col(c) + 1).cast("string"), 2, "0")
    region, nation, customer = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    reg = region.select(F.concat(two("r_regionkey"), F.lit("00000000")).alias("code"), F.col("r_name").alias("label"), F.lit("Reg").alias("level"))
    prov = nation.select(F.concat(two("n_regionkey"), two("n_nationkey"), F.lit("000000")).alias("code"), F.col("n_name").alias("label"), F.lit("Prov").alias("level"))
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    bgy = homes.select(
        F.concat(two("n_regionkey"), two("n_nationkey"), F.lpad((F.col("c_custkey") + 1).cast("string"), 6, "0")).alias("code"), F.col("c_name").alias("label"), F.lit("Bgy").alias("level")
    )
    return reg.unionByName(prov).unionByName(bgy).withColumn(ORD, F.col("code").cast("long"))


def geo_source(spark: SparkSession, sf_dir: str) -> ReleaseSource:
    return ReleaseSource("geo", ("Q2_2026",), lambda v: pull_geo(spark, sf_dir), "Q2_2026", SOURCE)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    code = F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(7), F.length(F.col("doc_id").cast("string"))), F.lit("0"))
    rows = d.select(code.alias("code"), F.col("lang").alias("level"), F.col("source").alias("label"), F.col("text").alias("description"), "doc_id")
    return conform(rows, F.col("doc_id"), system="docs", version="1", status="current", source=SOURCE, source_url=None)


def prod(spark: SparkSession, sf_dir: str, version: str = "2020") -> DataFrame:
    return prod_source(spark, sf_dir).edition(version)


def prod_rows(spark: SparkSession, sf_dir: str, version: str = "2020") -> DataFrame:
    """An edition without parents, for queries that don't need them."""
    from .adapters import union_levels

    rows = union_levels({lv: pull_prod(spark, sf_dir, version, lv) for lv in PROD_LEVELS}, list(PROD_LEVELS))
    return conform(rows, F.col(ORD), system="prod", version=version, status="current" if version == "2020" else "archived", source=SOURCE, source_url=None)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_source(spark, sf_dir).edition("Q2_2026")


def prod_sheet(spark: SparkSession, sf_dir: str, gappy: bool = False) -> DataFrame:
    """``row_no, brand, size, item, description``: brand and size only where they change; ``gappy`` blanks some sizes."""
    p = _parts(spark, sf_dir)
    first = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("z", "k")) == 1
    size = F.when(first("b", "z"), F.concat_ws(".", "b", "z"))
    if gappy:
        size = F.when(F.col("p_size") % 7 != 0, size)
    return p.select(
        F.concat("b", "z", "k").cast("long").alias("row_no"), F.when(first("b"), F.col("b")).alias("brand"), size.alias("size"),
        F.concat_ws(".", "b", "z", "k").alias("item"), F.col("p_name").alias("description"),
    )


_kept: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """What ``make`` gives, made once an application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def published(spark: SparkSession, sf_dir: str) -> Store:
    """A store with both editions of ``prod``, the release of ``geo``, and the current edition of ``prod`` as the stored edition of ``psic``."""

    def make() -> Store:
        store = Store(spark, scratch(spark, "store"))
        source = prod_source(spark, sf_dir)
        for version in source.versions:
            store.publish(source.edition(version), source.levels)
        source = geo_source(spark, sf_dir)
        store.publish(source.edition("Q2_2026"), source.list_levels("Q2_2026"))
        names = dict(zip(PROD_LEVELS, ("section", "division", "group"), strict=True))
        level = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("level")]
        psic = store.edition("prod", "2020").withColumns({"level": level, "system": F.lit("psic"), "version": F.lit("2026")})
        store.publish(psic, list(names.values()), {"display_version": "Revision 5 (2026)"})
        return store

    return _once(spark, sf_dir, "store", make)


def published_indexed(spark: SparkSession, sf_dir: str) -> Store:
    """The same store once the stored edition of ``psic`` has its search index, which only searches need."""
    store = published(spark, sf_dir)
    _once(spark, sf_dir, "store-index", lambda: store.build_index("psic", "2026", FILE_BYTES, BLOCK_BYTES))
    return store


def built(spark: SparkSession, sf_dir: str) -> Store:
    """A store with one edition built from a sheet in several files, without a column of row numbers."""

    def make() -> Store:
        path = scratch(spark, "sheet")
        prod_sheet(spark, sf_dir, gappy=True).orderBy("row_no").select("description", *reversed(PROD_LEVELS)).write.option("header", True).csv(path)
        store = Store(spark, scratch(spark, "store"))
        items = _read(spark, sf_dir, "part").count()
        build_edition(spark, path, store, SheetPlan("sheet", "1", PROD_LEVELS, SOURCE, stated={"item": items, "size": -1}, soft=("size",)))
        return store

    return _once(spark, sf_dir, "built", make)


def indexed(spark: SparkSession, sf_dir: str, name: str) -> SearchIndex:
    """The stored index of ``prod`` or of ``docs``."""
    rows = {"prod": prod_rows, "docs": docs}[name]
    return _once(spark, sf_dir, f"index-{name}", lambda: build_index(rows(spark, sf_dir), scratch(spark, "index"), FILE_BYTES, BLOCK_BYTES))


def paged(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored pages of ``docs``: an index without what only searches need."""
    return _once(spark, sf_dir, "pages-docs", lambda: build_index(docs(spark, sf_dir), scratch(spark, "index"), FILE_BYTES, BLOCK_BYTES, pages_only=True))


def yearly_editions(spark: SparkSession, sf_dir: str, table: str = "orders", system: str = "o_orderpriority", day: str = "o_orderdate") -> DataFrame:
    """``system, version, ord, status``: the years that a table has for each value of a column as its editions; the last with fewer rows than the one before is no longer current."""
    counted = _read(spark, sf_dir, table).groupBy(F.col(system).alias("system"), F.year(day).cast("string").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    years = W.partitionBy("system").orderBy("version")
    status = F.when(F.col("n") > F.lag("n", 1, 0).over(years), "current").otherwise("archived")
    return counted.select("system", "version", F.row_number().over(years).alias("ord"), status.alias("status"))


def pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prod`` as a data source: its raw levels are stored in the order of the source, and pulled by the tasks that need them."""

    def make() -> str:
        path = scratch(spark, "raw")
        for version in ("2009", "2020"):
            for level in PROD_LEVELS:
                pull_prod(spark, sf_dir, version, level).orderBy("ord").write.parquet(f"{path}/{version}/{level}")
        name = f"prod_{len(_kept)}"
        register(spark, name, [("prod", v, PROD_LEVELS) for v in ("2009", "2020")], lambda system, version, level: read_level(f"{path}/{version}/{level}"))
        return name

    return spark.read.format(_once(spark, sf_dir, "pulled", make)).load()
