"""Registered queries over the test tables, and the same rows in SQL.

Layers come from synth.py: rectangles in integer units of 1e-4 degrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import codes, grid, measure, sheets, st, text
from landgrid.functions.affine import Affine
from landgrid.operators import features as feats
from landgrid.operators import framed, jobs, keyword, overlay, raster, spatial, stats
from landgrid.plans import synth
from landgrid.sources import json as feature_json
from landgrid.sources import sinks
from landgrid.sources.store import stored_once
from landgrid.streaming import stats as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

L1, L2 = f"l1 AS ({synth.LAYER_1})", f"l2 AS ({synth.LAYER_2})"
AREA_INT = (1_163_000, 393_000, 1_171_500, 401_200)
AREA = tuple(v / synth.UNIT for v in AREA_INT)
POINT = (116.53335571289062, 39.942169189453125)
GRID = 500  # units of a fixed grid's cell


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _layer(spark: SparkSession, d: str, n: int = 1) -> DataFrame:
    return synth.layer(spark, d, n)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def z_sql(level: str, inner: str) -> str:
    """SELECT with a column z for rows (…, lvl, row, col) given by inner."""
    steps = f"SELECT *, row AS a, col AS b FROM ({inner})"
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        steps = f"SELECT * EXCLUDE (a, b), ((a | (a << {s})) & {m}) AS a, ((b | (b << {s})) & {m}) AS b FROM ({steps})"
    return f"SELECT * EXCLUDE (a, b), (a | (b << 1)) + {level} * {1 << grid.LEVEL_BIT} AS z FROM ({steps})"


def level_sql(c: str) -> str:
    return f"CASE WHEN length({c}) <> 4 THEN -1 WHEN {c} = '0000' THEN 0 WHEN {c} LIKE '%00' THEN 1 WHEN {c} LIKE '%0' THEN 2 ELSE 3 END"


def parent_sql(c: str) -> str:
    return f"CASE {level_sql(c)} WHEN 3 THEN substr({c}, 1, 3) || '0' WHEN 2 THEN substr({c}, 1, 2) || '00' ELSE '0000' END"


SUMS = "count(*) AS cnt, cast(sum(area) AS bigint) AS area, cast(sum(length) AS bigint) AS length"
RESUMS = "cast(sum(cnt) AS bigint) AS cnt, cast(sum(area) AS bigint) AS area, cast(sum(length) AS bigint) AS length"
BASE = f"base AS (SELECT category, {SUMS} FROM l1 WHERE rowkey LIKE '1%' GROUP BY category)"
ROLLED = f"""rolled AS (SELECT code AS category, {RESUMS} FROM (
    SELECT DISTINCT category AS own, cnt, area, length, unnest([category, substr(category, 1, 3) || '0', substr(category, 1, 2) || '00']) AS code FROM base) GROUP BY code)"""
X0, Y0, X1, Y1 = AREA_INT


# access: scans, filters, projections, paging


@query(f"WITH {L1} SELECT rowkey, caption, category, area FROM l1 WHERE rowkey = (SELECT min(rowkey) FROM l1 WHERE k % 70 = 0)")
def feature_get(spark, d):
    layer = _layer(spark, d)
    key = layer.filter("k % 70 = 0").agg(F.min("rowkey")).first()[0]
    return feats.get(layer, key).select("rowkey", "caption", "category", "area")


@query(f"WITH {L1} SELECT l1.rowkey, caption, area FROM l1 WHERE k % 13 = 0")
def feature_multi_get(spark, d):
    layer = _layer(spark, d)
    return feats.multi_get(layer, layer.filter("k % 13 = 0").select("rowkey")).select("rowkey", "caption", "area")


@query(f"WITH {L1} SELECT rowkey, category FROM l1 WHERE rowkey >= '120000000000' AND rowkey < '1302'")
def feature_key_range(spark, d):
    return feats.key_range(_layer(spark, d), "120000000000", "1302").select("rowkey", "category")


@query(f"WITH {L1} SELECT k, caption, region12, category, fid, rowkey, area, length FROM l1 WHERE category LIKE '01%'")
def detail_projection(spark, d):
    return feats.detail(feats.scan(_layer(spark, d), categories=["0100"]), ("x0", "y0", "x1", "y1"))


@query(f"WITH {L1} SELECT rowkey, caption, 1::bigint AS cnt, area, length, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM l1 WHERE category LIKE '011%'")
def position_projection(spark, d):
    return feats.positions(feats.scan(_layer(spark, d), categories=["0110"]))


@query(f"WITH {L1} SELECT rowkey, area FROM l1 WHERE rowkey LIKE '1201%'")
def region_prefix_scan(spark, d):
    return feats.scan(_layer(spark, d), region="120100").select("rowkey", "area")


@query(f"WITH {L1} SELECT rowkey, category FROM l1 WHERE category LIKE '10%' OR category LIKE '011%'")
def category_prefix_scan(spark, d):
    return feats.scan(_layer(spark, d), categories=["1000", "0110"]).select("rowkey", "category")


@query(f"WITH {L1} SELECT rowkey, caption, area FROM l1 WHERE rowkey LIKE '13%' AND (category LIKE '04%' OR category LIKE '07%')")
def region_category_scan(spark, d):
    return feats.scan(_layer(spark, d), "130000", ["0400", "0700"]).select("rowkey", "caption", "area")


@query(f"WITH {L1} SELECT rowkey, region12 FROM l1 WHERE rpad(substr(region12, 1, 4), 6, '0') IN ('110100', '150300')")
def district_filter(spark, d):
    layer = _layer(spark, d)
    return layer.filter(feats.in_districts(["110100", "150300"], 2)).select("rowkey", "region12")


@query(f"WITH {L1} SELECT rowkey, caption FROM l1 ORDER BY rowkey LIMIT 20 OFFSET 20")
def page_query(spark, d):
    return feats.page(_layer(spark, d), 21, 20).select("rowkey", "caption")


@query(f"WITH {L1} SELECT rowkey, cast((row_number() OVER (ORDER BY rowkey) - 1) // 50 AS bigint) AS batch FROM l1")
def key_batches(spark, d):
    return feats.batches(_layer(spark, d), 50)


@query(f"WITH {L1} SELECT DISTINCT y0 // {GRID} AS cell_row, x0 // {GRID} AS cell_col FROM l1")
def existing_cells(spark, d):
    return _layer(spark, d).select(F.floor(F.col("y0") / GRID).alias("cell_row"), F.floor(F.col("x0") / GRID).alias("cell_col")).distinct()


# codes


@query(f"WITH {L1} SELECT k, rowkey AS key, region12 AS region, category, fid FROM l1")
def rowkey_build(spark, d):
    layer = _layer(spark, d).withColumn("key", codes.row_key(F.substring("region12", 1, 6), "category", F.col("k").cast("string")))
    return layer.select("k", "key", codes.key_region("key").alias("region"), codes.key_category("key").alias("category"), codes.key_fid("key").alias("fid"))


@query(f"WITH {L1} SELECT DISTINCT category, {level_sql('category')} AS level, {parent_sql('category')} AS parent, CASE {level_sql('category')} WHEN 0 THEN '' WHEN 1 THEN substr(category, 1, 2) WHEN 2 THEN substr(category, 1, 3) ELSE category END AS short FROM l1")
def category_parent(spark, d):
    c = F.col("category")
    return _layer(spark, d).select(c, codes.category_level(c).alias("level"), codes.category_parent(c).alias("parent"), codes.category_short(c).alias("short")).distinct()


@query(f"WITH {L1} SELECT DISTINCT category FROM l1 WHERE category LIKE '03%'")
def category_subtree(spark, d):
    dimension = _layer(spark, d).select(F.col("category").alias("code")).distinct()
    return feats.category_subtree(dimension, "0300").select(F.col("code").alias("category"))


@query(f"""WITH {L1}, c AS (SELECT DISTINCT substr(region12, 1, 6) AS region FROM l1),
    n AS (SELECT region, length(rtrim(region, '0')) AS n FROM c)
    SELECT region, CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END AS level, substr(region, 1, CASE WHEN n <= 2 THEN 2 WHEN n <= 4 THEN 4 ELSE 6 END) AS short FROM n""")
def region_level(spark, d):
    regions = _layer(spark, d).select(F.substring("region12", 1, 6).alias("region")).distinct()
    return regions.select("region", codes.region_level("region").alias("level"), codes.region_short("region").alias("short"))


@query("SELECT event_id, event_type AS type, props AS raw FROM events")
def property_map(spark, d):
    events = _table(spark, d, "events")
    packed = F.concat(F.lit("type:"), F.col("event_type"), F.lit("\tskipped\tid:"), F.col("event_id").cast("string"), F.lit(":lost"))
    parsed = events.withColumn("m", text.property_map(packed))
    return parsed.select(F.col("m")["id"].cast("bigint").alias("event_id"), F.col("m")["type"].alias("type"), F.col("props").alias("raw"))


# statistics


@query(f"WITH {L1}, {BASE} SELECT * FROM base")
def category_stats(spark, d):
    return stats.category_stats(feats.scan(_layer(spark, d)))


@query(f"WITH {L1}, {BASE}, {ROLLED} SELECT * FROM rolled")
def category_rollup(spark, d):
    return stats.rollup(stats.category_stats(_layer(spark, d)))


@query(f"""WITH {L1}, {BASE}, {ROLLED}, t AS (SELECT sum(cnt)::double AS c, sum(area)::double AS a, sum(length)::double AS l FROM base)
    SELECT rolled.*, cnt / c AS cnt_percent, area / a AS area_percent, length / l AS length_percent FROM rolled, t""")
def category_rollup_percent(spark, d):
    return stats.rollup_percent(stats.category_stats(_layer(spark, d)))


@query(f"WITH {L1}, {BASE} SELECT {RESUMS} FROM base")
def stats_summary(spark, d):
    return stats.summary(stats.category_stats(_layer(spark, d)))


@query(f"WITH {L1}, {L2} SELECT category, {SUMS} FROM (SELECT category, area, length FROM l1 UNION ALL SELECT category, area, length FROM l2) GROUP BY category")
def merged_stats(spark, d):
    return stats.merge_stats(*(stats.category_stats(_layer(spark, d, n)) for n in (1, 2)))


@query("""SELECT count(*) FILTER (q > 60000) AS count_a, sum(q) FILTER (q > 60000) AS sum_a, count(*) FILTER (p > 60000) AS count_b, sum(p) FILTER (p > 60000) AS sum_b,
    cast(floor(sum(q) FILTER (q > 60000) / 1000 / nullif(count(*) FILTER (q > 60000), 0)) AS bigint) AS average_a, cast(floor(sum(p) FILTER (p > 60000) / 1000 / nullif(count(*) FILTER (p > 60000), 0)) AS bigint) AS average_b
    FROM (SELECT cast(l_quantity AS bigint) * 2000 AS q, cast(round(l_extendedprice) AS bigint) AS p FROM lineitem) WHERE q IS NOT NULL AND p IS NOT NULL""".replace("sum(q) FILTER (q > 60000) AS sum_a", "cast(sum(q) FILTER (q > 60000) AS bigint) AS sum_a").replace("sum(p) FILTER (p > 60000) AS sum_b", "cast(sum(p) FILTER (p > 60000) AS bigint) AS sum_b"))
def two_column_sum(spark, d):
    lines = _table(spark, d, "lineitem")
    return stats.two_column_sum(lines, F.col("l_quantity").cast("bigint") * 2000, F.round("l_extendedprice").cast("bigint"))


@query(f"WITH {L1} SELECT substr(region12, 1, 6) AS region6, category, cast(sum(area) AS bigint) AS area FROM l1 GROUP BY ALL")
def area_by_region_category(spark, d):
    return stats.area_by(_layer(spark, d).withColumn("region6", F.substring("region12", 1, 6)), "region6", "category")


@query(f"WITH {L1} SELECT category, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l1 GROUP BY category")
def envelope_agg(spark, d):
    return stats.extent(_layer(spark, d), "category")


# grids and sheets

_CELLS = f"SELECT k, 14 AS lvl, cast(trunc((180.0 - y0 / 10000.0) / (360.0 / pow(2.0, 14))) AS bigint) AS row, cast(trunc((x0 / 10000.0) / (360.0 / pow(2.0, 14))) AS bigint) AS col FROM l1"


@query(f"WITH {L1} SELECT k, row, col, z FROM ({z_sql('14', _CELLS)})")
def zvalue_encode(spark, d):
    layer, size = synth.degrees(_layer(spark, d)), grid.cell_size(F.lit(14))
    placed = layer.select("k", grid.row_of("ymin", size).alias("row"), grid.column_of("xmin", size).alias("col"))
    return placed.withColumn("z", grid.z_encode(14, "row", "col"))


@query(f"WITH {L1} SELECT k, 14 AS level, row, col FROM ({_CELLS})")
def zvalue_decode(spark, d):
    layer = synth.degrees(_layer(spark, d))
    keyed = layer.select("k", grid.point_cell("xmin", "ymin", F.lit(14)).alias("z"))
    return keyed.select("k", grid.z_level("z").alias("level"), grid.z_row("z").alias("row"), grid.z_col("z").alias("col"))


@query(f"WITH {L1} SELECT k, 0.2 * col AS xmin, 180.0::double - 0.2::double * (row + 1) AS ymin, 0.2::double * (col + 1) AS xmax, 180.0::double - 0.2::double * row AS ymax FROM (SELECT k, cast(trunc((180.0 - y0 / 10000.0) / 0.2::double) AS bigint) AS row, cast(trunc((x0 / 10000.0) / 0.2::double) AS bigint) AS col FROM l1)".replace("0.2 * col", "0.2::double * col"))
def cell_envelope(spark, d):
    layer = synth.degrees(_layer(spark, d))
    box = grid.cell_envelope(grid.row_of("ymin", F.lit(0.2)), grid.column_of("xmin", F.lit(0.2)), F.lit(0.2))
    return layer.select("k", box.alias("b")).select("k", "b.*")


_DOWN = "SELECT k, 13 AS lvl, {f} * row + {g} AS row, {f} * col + {g} AS col FROM (SELECT k, row // 8 AS row, col // 8 AS col FROM (" + _CELLS + "))"


@query(f"WITH {L1}, lo AS ({z_sql('13', _DOWN.format(f=4, g=0))}), hi AS ({z_sql('13', _DOWN.format(f=4, g=3))}) SELECT k, lo.z AS zmin, hi.z AS zmax FROM lo JOIN hi USING (k)")
def zrange_descendants(spark, d):
    layer, size = synth.degrees(_layer(spark, d)), grid.cell_size(F.lit(14))
    placed = layer.select("k", F.floor(grid.row_of("ymin", size) / 8).alias("row"), F.floor(grid.column_of("xmin", size) / 8).alias("col"))
    return placed.select("k", grid.descendant_range(F.lit(11), "row", "col", 2).alias("r")).select("k", "r.*")


_SINGLE = """SELECT k, l, cast(trunc((180.0 - y1 / 10000.0) / s) AS bigint) AS row, cast(trunc((x0 / 10000.0) / s) AS bigint) AS col,
    trunc((x0 / 10000.0) / s) = trunc((x1 / 10000.0) / s) AND trunc((180.0 - y0 / 10000.0) / s) = trunc((180.0 - y1 / 10000.0) / s) AS single
    FROM l1, (SELECT l, 360.0 / pow(2.0, l) AS s FROM range(1, 15) AS t(l))"""
_BEST = "SELECT s.k, s.l AS lvl, s.row, s.col FROM s JOIN (SELECT k, coalesce(min(l) FILTER (NOT single), 15) - 1 AS l FROM s GROUP BY k) AS b ON s.k = b.k AND s.l = greatest(b.l, 1)"


@query(f"WITH {L1}, s AS ({_SINGLE}) SELECT k, z AS zvalue FROM ({z_sql('lvl', _BEST)})")
def optimal_cell(spark, d):
    return spatial.with_index(synth.degrees(_layer(spark, d))).select("k", "zvalue")


@query(f"WITH {L1} SELECT k, lvl AS level, z FROM ({z_sql('lvl', 'SELECT k, l AS lvl, cast(trunc((180.0 - y0 / 10000.0) / (360.0 / pow(2.0, l))) AS bigint) AS row, cast(trunc((x0 / 10000.0) / (360.0 / pow(2.0, l))) AS bigint) AS col FROM l1, range(1, 15) AS t(l)')})")
def point_cells(spark, d):
    layer = synth.degrees(_layer(spark, d))
    return layer.select("k", F.posexplode(grid.point_cells("xmin", "ymin")).alias("i", "z")).select("k", (F.col("i") + 1).cast("bigint").alias("level"), "z")


@query(f"""WITH {L1} SELECT rowkey, r AS cell_row, c AS cell_col FROM (SELECT rowkey, unnest(range(cast(trunc((180.0 - y1 / 10000.0) / 0.05::double) AS bigint), cast(trunc((180.0 - y0 / 10000.0) / 0.05::double) AS bigint) + 1)) AS r, x0, x1 FROM l1),
    LATERAL (SELECT unnest(range(cast(trunc((x0 / 10000.0) / 0.05::double) AS bigint), cast(trunc((x1 / 10000.0) / 0.05::double) AS bigint) + 1)) AS c)""")
def fixed_grid_cells(spark, d):
    return spatial.explode_cells(synth.degrees(_layer(spark, d)), 0.05, "rowkey")


def _sheet_sql(row: str, col: str, n: int, letter: str) -> str:
    return f"chr(cast({row} // {n} + 65 AS int)) || lpad(cast({col} // {n} + 31 AS string), 2, '0') || '{letter}' || lpad(cast({n} - {row} % {n} AS string), 3, '0') || lpad(cast({col} % {n} + 1 AS string), 3, '0')"


_ROWS = "SELECT k, x0, y0, x1, y1, cast(floor((y0 / 10000.0) * {n} / 4) AS bigint) AS r{n}, cast(floor((x0 / 10000.0) * {n} / 6) AS bigint) AS c{n} FROM l1"


@query(f"WITH {L1}, a AS ({_ROWS.format(n=24)}), b AS ({_ROWS.format(n=12)}) SELECT a.k, {_sheet_sql('r24', 'c24', 24, 'E')} AS sheet, {_sheet_sql('r12', 'c12', 12, 'D')} AS parent FROM a JOIN b USING (k)")
def sheet_code(spark, d):
    layer, scale = synth.degrees(_layer(spark, d)), sheets.scale_of("E")
    coded = layer.select("k", sheets.sheet_code("ymin", "xmin", scale).alias("sheet"))
    return coded.select("k", "sheet", sheets.super_sheet("sheet", sheets.scale_of("D")).alias("parent"))


@query(f"WITH {L1}, a AS ({_ROWS.format(n=24)}) SELECT k, round(c24 * 0.25::double, 6) AS xmin, round(r24 / 6.0, 6) AS ymin, round((c24 + 1) * 0.25::double, 6) AS xmax, round((r24 + 1) / 6.0, 6) AS ymax FROM a")
def sheet_envelope(spark, d):
    layer = synth.degrees(_layer(spark, d))
    box = layer.select("k", sheets.sheet_envelope(sheets.sheet_code("ymin", "xmin", sheets.scale_of("E"))).alias("b"))
    return box.select("k", *(F.round(f"b.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query(f"""WITH {L1} SELECT k, {_sheet_sql('r', 'c', 96, 'G')} AS sheet FROM (
    SELECT k, x0, x1, unnest(range(cast(floor((y0 / 10000.0) * 96 / 4) AS bigint), cast(floor((y1 / 10000.0) * 96 / 4) AS bigint) + 1)) AS r FROM l1),
    LATERAL (SELECT unnest(range(cast(floor((x0 / 10000.0) * 96 / 6) AS bigint), cast(floor((x1 / 10000.0) * 96 / 6) AS bigint) + 1)) AS c)""")
def sheets_in_range(spark, d):
    layer = synth.degrees(_layer(spark, d))
    return layer.select("k", F.explode(sheets.sheets_in_range("xmin", "ymin", "xmax", "ymax", sheets.scale_of("G"))).alias("sheet"))


@query(f"WITH {L1} SELECT k, cast(trunc((x0 / 10000.0 + 6) / 6) * 6 - 3 AS int) AS meridian, cast(floor((x0 / 10000.0) / 6) * 6 + 3 AS int) AS zone FROM l1")
def projection_zone(spark, d):
    layer = synth.degrees(_layer(spark, d))
    return layer.select("k", sheets.central_meridian("xmin").alias("meridian"), sheets.sheet_zone(sheets.sheet_code("ymin", "xmin", sheets.scale_of("E"))).alias("zone"))


# spatial index and queries


def _by_cell(spark, d) -> DataFrame:
    """The layer with its zvalue, as a table in that order: the index that key ranges prune."""
    return stored_once(spark, d, "layer-by-cell", lambda path: sinks.write_by_cell(spatial.with_index(synth.degrees(_layer(spark, d))), path))


_IN = f"x0 <= {X1} AND x1 >= {X0} AND y0 <= {Y1} AND y1 >= {Y0}"


@query(f"WITH {L1} SELECT rowkey, category, area FROM l1 WHERE {_IN}")
def spatial_query_rect(spark, d):
    return spatial.box_query(_by_cell(spark, d), AREA).select("rowkey", "category", "area")


@query(f"WITH {L1} SELECT rowkey, level, cat2 FROM (SELECT rowkey, lvl AS level, substr(category, 1, 2) AS cat2 FROM l1 JOIN (WITH s AS ({_SINGLE}) {_BEST}) USING (k))")
def spatial_index(spark, d):
    return spatial.build_index(synth.degrees(_layer(spark, d))).select("rowkey", F.col("level").cast("bigint").alias("level"), "cat2")


_CUT = f"""SELECT category, rowkey, greatest(x0, {X0}) AS a, greatest(y0, {Y0}) AS b, least(x1, {X1}) AS c, least(y1, {Y1}) AS e, region12 FROM l1 WHERE x0 < {X1} AND x1 > {X0} AND y0 < {Y1} AND y1 > {Y0}"""


@query(f"WITH {L1} SELECT category, count(*) AS cnt, cast(sum((c - a) * (e - b)) AS bigint) AS area, cast(sum(2 * (c - a + e - b)) AS bigint) AS length FROM ({_CUT}) GROUP BY category")
def spatial_stats_rect(spark, d):
    return jobs.box_statistics(_layer(spark, d), AREA_INT)


@query(f"""WITH {L1}, s AS ({_SINGLE}), i AS (SELECT l1.*, b.lvl, b.row, b.col FROM l1 JOIN ({_BEST}) AS b USING (k)) SELECT rowkey, caption FROM i
    WHERE x0 <= 1165333.5571289062 AND x1 >= 1165333.5571289062 AND y0 <= 399421.69189453125 AND y1 >= 399421.69189453125 ORDER BY lvl DESC, rowkey LIMIT 1""")
def point_query(spark, d):
    return spatial.point_query(_by_cell(spark, d), *POINT).select("rowkey", "caption")


_PAIRS = """SELECT l1.category AS category1, l2.category AS category2, l1.rowkey AS key1, l2.rowkey AS key2, l2.region12 AS region,
    (least(l1.x1, l2.x1) - greatest(l1.x0, l2.x0)) * (least(l1.y1, l2.y1) - greatest(l1.y0, l2.y0)) AS overlap
    FROM l1 JOIN l2 ON l1.x0 < l2.x1 AND l2.x0 < l1.x1 AND l1.y0 < l2.y1 AND l2.y0 < l1.y1"""


@query(f"WITH {L1}, {L2} SELECT key1 AS rowkey, key2 AS other, overlap FROM ({_PAIRS})")
def spatial_join_rect(spark, d):
    pairs = spatial.overlap_join(_layer(spark, d).select("rowkey", "x0", "y0", "x1", "y1"), jobs.other(_layer(spark, d, 2), rowkey="other"))
    return pairs.select("rowkey", "other", "overlap")


# overlay jobs on rectangles


@query(f"WITH {L1}, {L2} SELECT region, category1 AS category, cast(sum(overlap) AS bigint) AS area FROM ({_PAIRS}) GROUP BY ALL")
def area_statistics_rect(spark, d):
    return jobs.area_statistics(_layer(spark, d), _layer(spark, d, 2))


@query(f"WITH {L1} SELECT substr(region12, 1, 6) AS region6, category, rowkey, a AS x0, b AS y0, c AS x1, e AS y1, (c - a) * (e - b) AS area FROM ({_CUT})")
def clip_rect(spark, d):
    return jobs.clip(_layer(spark, d), AREA_INT)


@query(f"WITH {L1}, {L2} SELECT substr(region, 1, 6) AS region6, category1, category2, cast(sum(overlap) AS bigint) AS area, count(*) AS pairs FROM ({_PAIRS}) WHERE category1 <> category2 GROUP BY ALL")
def change_detection_rect(spark, d):
    return jobs.change_detection(_layer(spark, d), _layer(spark, d, 2))


@query(f"WITH {L1} SELECT cast(sum((c - a) * (e - b)) AS bigint) AS area, count(*) AS n FROM ({_CUT})")
def polygon_cut_area(spark, d):
    return jobs.cut_area(_layer(spark, d), AREA_INT)


@query(f"WITH {L1} SELECT rowkey FROM ({_CUT})")
def polygon_cut_ids(spark, d):
    return jobs.cut_ids(_layer(spark, d), AREA_INT)


@query(f"""WITH {L1}, p AS (SELECT rowkey, category, r AS cell_row, c AS cell_col, greatest(x0, c * {GRID}) AS px0, greatest(y0, r * {GRID}) AS py0, least(x1, (c + 1) * {GRID}) AS px1, least(y1, (r + 1) * {GRID}) AS py1
    FROM (SELECT *, unnest(range(y0 // {GRID}, (y1 - 1) // {GRID} + 1)) AS r FROM l1), LATERAL (SELECT unnest(range(x0 // {GRID}, (x1 - 1) // {GRID} + 1)) AS c))
    SELECT *, (px1 - px0) * (py1 - py0) AS area, 2 * (px1 - px0 + py1 - py0) AS length FROM p""")
def grid_pieces(spark, d):
    return spatial.grid_pieces(_layer(spark, d), GRID)


# measures on columns


def _ringed(spark, d) -> DataFrame:
    layer = synth.degrees(_layer(spark, d))
    return layer.select("k", measure.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("ring"), "xmin", "ymin", "xmax", "ymax")


@query(f"WITH {L1} SELECT k, round(area / 1e8, 9) AS area FROM l1")
def shoelace_area(spark, d):
    return _ringed(spark, d).select("k", F.round(measure.ring_area(F.col("ring")), 9).alias("area"))


@query(f"WITH {L1} SELECT k, round(length / 1e4, 6) AS length FROM l1")
def ring_length(spark, d):
    return _ringed(spark, d).select("k", F.round(measure.path_length(F.col("ring")), 6).alias("length"))


def _strip(l1: str, b1: str, l2: str, b2: str) -> str:
    terms = " ".join(f"{'+' if i % 2 == 0 else '-'} {c!r}::double * sin({(2 * i + 1) / 2} * ({b2} - {b1})) * cos({2 * i + 1} * ({b1} + {b2}) / 2)" for i, c in enumerate(measure.SERIES))
    return f"(2 * pow({measure.MINOR!r}::double, 2) * ({l1} + {l2}) / 2 * ({terms}))"


@query(f"""WITH {L1}, r AS (SELECT k, radians(x0 / 10000.0) AS a, radians(y0 / 10000.0) AS b, radians(x1 / 10000.0) AS c, radians(y1 / 10000.0) AS e FROM l1)
    SELECT k, round({_strip('c', 'b', 'c', 'e')} + {_strip('a', 'e', 'a', 'b')}, 1) AS area FROM r""")
def ellipsoid_area(spark, d):
    return _ringed(spark, d).select("k", F.round(measure.ellipsoid_ring_area(F.col("ring")), 1).alias("area"))


@query(f"WITH {L1} SELECT k, x0 < 1166000 AND x1 >= 1166000 AND y0 < 400000 AND y1 >= 400000 AS holds FROM l1")
def point_in_polygon(spark, d):
    return _ringed(spark, d).select("k", measure.point_in_ring(F.col("ring"), F.lit(116.6) - 1e-9, F.lit(40.0) - 1e-9).alias("holds"))


@query(f"WITH {L1} SELECT k, round((2 * x0 - y0) / 10000.0 + 1, 6) AS x, round((x0 + 3 * y0) / 10000.0 - 2, 6) AS y FROM l1")
def affine_transform(spark, d):
    moved = _ringed(spark, d).select("k", measure.affine(F.col("ring"), 2.0, -1.0, 1.0, 1.0, 3.0, -2.0)[0].alias("p"))
    return moved.select("k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"WITH {L1} SELECT k, round(radians(x0 / 10000.0) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(y0 / 10000.0) / 2)) * 6378137.0, 4) AS y FROM l1")
def web_mercator(spark, d):
    layer = synth.degrees(_layer(spark, d))
    x, y = measure.web_mercator(F.col("xmin"), F.col("ymin"))
    return layer.select("k", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


# rasters

_AROUND = [f"coalesce(max(n.height) FILTER (n.row = c.row + {dr} AND n.col = c.col + {dc}), c.height)" for dr, dc in measure.NEIGHBOURS]
_SURFACE = f"""SELECT c.row, c.col, c.height, {' + '.join(f'sqrt(250000 + pow({_AROUND[i - i % 2]} - c.height, 2)) * sqrt(250000 + pow({_AROUND[i]} - {_AROUND[i - 1]}, 2)) / 8' for i in range(8))} AS surface
    FROM dem AS c JOIN dem AS n ON abs(n.row - c.row) <= 1 AND abs(n.col - c.col) <= 1 GROUP BY c.row, c.col, c.height"""


@query(f"WITH dem AS ({synth.RASTER}) SELECT row, col, round(surface, 6) AS surface FROM ({_SURFACE})")
def dem_cell_surface(spark, d):
    return raster.cell_surfaces(synth.raster(spark, d), GRID).select("row", "col", F.round("surface", 6).alias("surface"))


@query(f"""WITH {L1}, dem AS ({synth.RASTER}), s AS ({_SURFACE}), p AS (SELECT surface, {synth.ORIGIN_X} + col * {GRID} + {GRID // 2} AS x, {synth.ORIGIN_Y + synth.SPAN} - row * {GRID} - {GRID // 2} AS y FROM s)
    SELECT category, round(sum(surface), 4) AS surface, count(*) AS cells FROM l1 JOIN p ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY category""")
def surface_area_by_category(spark, d):
    cells = raster.cell_surfaces(synth.raster(spark, d), GRID)
    centres = cells.select("surface", (F.col("col") * GRID + synth.ORIGIN_X + GRID // 2).alias("x"), (F.lit(synth.ORIGIN_Y + synth.SPAN - GRID // 2) - F.col("row") * GRID).alias("y"))
    found = jobs.surface_by_category(_layer(spark, d), centres)
    return found.select("category", F.round("surface", 4).alias("surface"), "cells")


# keywords

_WORDS = r"""words AS (SELECT doc_id AS rowkey, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
    idx AS (SELECT term, rowkey, n_words, count(*) AS tf FROM (SELECT rowkey, len(w) AS n_words, unnest(w) AS term FROM words) GROUP BY ALL)"""
_TERMS = ["the", "benchmark", "onon", "license"]
_HITS = f"""SELECT rowkey, count(*) AS n_terms, sum(tf * i * i / sqrt(n_words::double)) AS score FROM idx JOIN (
    SELECT term, ln((SELECT count(*) FROM documents)::double / count(*)) + 1 AS i FROM idx WHERE term IN {tuple(_TERMS)} GROUP BY term) USING (term) GROUP BY rowkey"""


def _hits(spark, d, terms, every) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("rowkey"), "text")
    index = stored_once(spark, d, "words-by-term", lambda path: sinks.write_words(keyword.build_keyword_index(docs, "text"), path))
    return keyword.search(index, docs.count(), terms, every)


@query(f"WITH {_WORDS} SELECT rowkey, round(score, 6) AS score FROM ({_HITS.replace(str(tuple(_TERMS)), str(tuple(_TERMS[::3])))}) WHERE n_terms = 2")
def keyword_and(spark, d):
    return _hits(spark, d, _TERMS[::3], True).select("rowkey", F.round("score", 6).alias("score"))


@query(f"WITH {_WORDS} SELECT rowkey, n_terms, round(score, 6) AS score FROM ({_HITS})")
def keyword_or(spark, d):
    return _hits(spark, d, _TERMS, False).select("rowkey", "n_terms", F.round("score", 6).alias("score"))


@query(f"WITH {_WORDS} SELECT rowkey, round(score, 6) AS score FROM ({_HITS}) ORDER BY 2 DESC, 1 LIMIT 25")
def keyword_topk(spark, d):
    return keyword.top_hits(_hits(spark, d, _TERMS, False), 25).select("rowkey", F.round("score", 6).alias("score"))



# geometry functions on polygons made from the rectangles, in integer units


def _shaped(spark, d, n: int = 1) -> DataFrame:
    """A layer with geom, and its envelope in degrees."""
    layer = spatial.dealt(synth.degrees(_layer(spark, d, n)), "rowkey")
    return layer.withColumn("geom", st.st_make_envelope("xmin", "ymin", "xmax", "ymax"))


def _whole(spark, d, n: int = 1) -> DataFrame:
    """A layer with geom in integer units."""
    return spatial.dealt(_layer(spark, d, n), "rowkey").withColumn("geom", st.st_make_envelope(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))))


_WKT = "'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))'"
_TEXT = f"WITH {L1} SELECT k, {_WKT} AS wkt FROM l1"


@query(_TEXT)
def wkt_roundtrip(spark, d):
    layer = _layer(spark, d).withColumn("wkt", F.expr(_WKT))
    return layer.select("k", st.st_as_wkt(st.st_from_wkt("wkt")).alias("wkt"))


@query(_TEXT)
def wkb_roundtrip(spark, d):
    return _whole(spark, d).select("k", st.st_as_wkt(st.st_from_wkb(st.st_as_wkb("geom", little=False))).alias("wkt"))


@query(_TEXT)
def geojson_roundtrip(spark, d):
    return _whole(spark, d).select("k", st.st_as_wkt(st.st_from_geojson(st.st_as_geojson("geom"))).alias("wkt"))


@query(f"WITH {L1} SELECT k, area, length FROM l1")
def feature_json_roundtrip(spark, d):
    back = _whole(spark, d).withColumn("g", st.st_from_feature_json(st.st_as_feature_json("geom", 4490)))
    return back.select("k", st.st_area("g").cast("bigint").alias("area"), st.st_length("g").cast("bigint").alias("length"))


@query(f"WITH {L1} SELECT k, area, length FROM l1")
def shape_roundtrip(spark, d):
    back = _whole(spark, d).withColumn("g", st.st_from_shape(st.st_as_shape("geom")))
    return back.select("k", st.st_area("g").cast("bigint").alias("area"), st.st_length("g").cast("bigint").alias("length"))


@query(f"WITH {L1} SELECT k, area, length, x0, y0, x1, y1, 5 AS n_points, 2 AS dimension, 'Polygon' AS type, (x0 + x1) / 2 AS label_x, (y0 + y1) / 2 AS label_y FROM l1")
def st_accessors(spark, d):
    g = _whole(spark, d).select("k", "geom", st.st_envelope("geom").alias("b"), st.st_label_point("geom").alias("p"))
    corner = (F.col(f"b.{a}").cast("bigint").alias(c) for a, c in zip(("xmin", "ymin", "xmax", "ymax"), ("x0", "y0", "x1", "y1")))
    return g.select(
        "k", st.st_area("geom").cast("bigint").alias("area"), st.st_length("geom").cast("bigint").alias("length"), *corner, st.st_num_points("geom").alias("n_points"),
        st.st_dimension("geom").alias("dimension"), st.st_geometry_type("geom").alias("type"), F.col("p.x").alias("label_x"), F.col("p.y").alias("label_y"),
    )


_PAIR = ("rowkey", "other")


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    """The layers with geom in integer units, as the sides of an overlap join."""
    return _whole(spark, d).select("rowkey", "geom", "x0", "y0", "x1", "y1"), jobs.other(_whole(spark, d, 2), rowkey="other", geom="geom2")


_BOTH = _PAIRS.replace("l1.category AS category1", "l1.area AS area1, l2.area AS area2, l1.category AS category1")


@query(f"WITH {L1}, {L2} SELECT key1 AS rowkey, key2 AS other, overlap AS common, area1 + area2 - overlap AS joined, area1 - overlap AS rest, area1 + area2 - 2 * overlap AS either FROM ({_BOTH})")
def st_set_operations(spark, d):
    return framed.areas(*_both(spark, d), _PAIR, common="intersection", joined="union", rest="difference", either="sym_difference")


_HOLD = "l2.x0 >= l1.x0 AND l2.x1 <= l1.x1 AND l2.y0 >= l1.y0 AND l2.y1 <= l1.y1"
_HELD = "l1.x0 >= l2.x0 AND l1.x1 <= l2.x1 AND l1.y0 >= l2.y0 AND l1.y1 <= l2.y1"


@query(f"""WITH {L1}, {L2} SELECT l1.rowkey, l2.rowkey AS other, true AS meets, {_HOLD} AS holds, {_HELD} AS held, NOT ({_HOLD}) AND NOT ({_HELD}) AS overlaps, false AS touches, false AS apart,
    ({_HOLD}) AND ({_HELD}) AS same FROM l1 JOIN l2 ON l1.x0 < l2.x1 AND l2.x0 < l1.x1 AND l1.y0 < l2.y1 AND l2.y0 < l1.y1""")
def st_relations(spark, d):
    return framed.relations(*_both(spark, d), _PAIR, meets="intersects", holds="contains", held="within", overlaps="overlaps", touches="touches", apart="disjoint", same="equals")


_WITHIN, _AROUND_IT = "l1.x0 >= l2.x0 AND l1.x1 <= l2.x1 AND l1.y0 >= l2.y0 AND l1.y1 <= l2.y1", "l2.x0 >= l1.x0 AND l2.x1 <= l1.x1 AND l2.y0 >= l1.y0 AND l2.y1 <= l1.y1"
_STRICT = "(l1.x0 > l2.x0 AND l1.x1 < l2.x1 AND l1.y0 > l2.y0 AND l1.y1 < l2.y1) OR (l2.x0 > l1.x0 AND l2.x1 < l1.x1 AND l2.y0 > l1.y0 AND l2.y1 < l1.y1)"


@query(f"""WITH {L1}, {L2}, m AS (SELECT l1.rowkey, l2.rowkey AS other, ({_WITHIN}) AS held, ({_AROUND_IT}) AS holds,
        CASE WHEN l1.x0 = l2.x0 OR l1.x1 = l2.x1 OR l1.y0 = l2.y0 OR l1.y1 = l2.y1 THEN '1' WHEN {_STRICT} THEN 'F' ELSE '0' END AS rims
        FROM l1 JOIN l2 ON l1.x0 < l2.x1 AND l2.x0 < l1.x1 AND l1.y0 < l2.y1 AND l2.y0 < l1.y1)
    SELECT rowkey, other, '2' || CASE WHEN held THEN 'FF' ELSE '12' END || CASE WHEN holds THEN 'F' ELSE '1' END || rims || CASE WHEN held THEN 'F' ELSE '1' END
        || CASE WHEN holds THEN 'FF' ELSE '21' END || '2' AS matrix, holds, false AS crosses FROM m""")
def st_relate(spark, d):
    return framed.relations(*_both(spark, d), _PAIR, matrix="relate_matrix", holds=("relate", "T*****FF*"), crosses="crosses")


_CX, _CY = 1_168_000, 398_000


@query(f"""WITH {L1} SELECT rowkey, round(sqrt(pow(greatest(x0 - {_CX}, 0, {_CX} - x1), 2) + pow(greatest(y0 - {_CY}, 0, {_CY} - y1), 2)), 6) AS distance,
    least(greatest({_CX}, x0), x1) AS x, least(greatest({_CY}, y0), y1) AS y FROM l1""")
def st_distance(spark, d):
    at = (F.lit(float(_CX)), F.lit(float(_CY)))
    near = _whole(spark, d).select("rowkey", F.round(st.st_distance("geom", st.st_point(*at)), 6).alias("distance"), st.st_nearest_coordinate("geom", *at).alias("n"))
    return near.select("rowkey", "distance", F.col("n.x").cast("bigint").alias("x"), F.col("n.y").cast("bigint").alias("y"))


@query(f"WITH {L1} SELECT rowkey, round(area + length * 25 + 48 * 625 * sin(2 * pi() / 96), 3) AS area, cast(greatest(x1 - x0 - 30, 0) * greatest(y1 - y0 - 30, 0) AS double) AS shrunk FROM l1")
def st_buffer(spark, d):
    layer = _whole(spark, d)
    return layer.select("rowkey", F.round(st.st_area(st.st_buffer("geom", F.lit(25.0))), 3).alias("area"), F.round(st.st_area(st.st_buffer("geom", F.lit(-15.0))), 3).alias("shrunk"))


@query(f"WITH {L1} SELECT rowkey, cast(2 * ceil((x1 - x0) / 40.0) + 2 * ceil((y1 - y0) / 40.0) + 1 AS int) AS n_dense, 5 AS n_plain, length AS rim FROM l1")
def st_densify(spark, d):
    dense = _whole(spark, d).withColumn("g", st.st_densify("geom", F.lit(40.0)))
    return dense.select("rowkey", st.st_num_points("g").alias("n_dense"), st.st_num_points(st.st_simplify("g", F.lit(0.001))).alias("n_plain"), F.round(st.st_length(st.st_boundary("g"))).cast("bigint").alias("rim"))


@query(f"WITH {L1} SELECT rowkey, (c - a) * (e - b) AS area FROM ({_CUT})")
def st_clip_by_box(spark, d):
    clipped = _whole(spark, d).select("rowkey", st.st_area(st.st_clip_by_box("geom", *(float(v) for v in AREA_INT))).cast("bigint").alias("area"))
    return clipped.filter("area > 0")


@query(f"WITH {L1} SELECT rowkey, 'left' AS side, ({_CX} - x0) * (y1 - y0) AS area FROM l1 WHERE x0 < {_CX} AND x1 > {_CX} UNION ALL SELECT rowkey, 'right', (x1 - {_CX}) * (y1 - y0) FROM l1 WHERE x0 < {_CX} AND x1 > {_CX}")
def st_cut(spark, d):
    cutter = st.st_from_wkt(F.lit(f"LINESTRING ({_CX} 0, {_CX} 2000000)"))
    parts = _whole(spark, d).select("rowkey", F.explode(st.st_cut("geom", cutter)).alias("p")).filter("p.side <> 'uncut'")
    return parts.select("rowkey", "p.side", F.round(st.st_area("p.geom")).cast("bigint").alias("area"))


@query(f"WITH {L1} SELECT rowkey, area, ceil((x1 - x0) / 100.0)::bigint * ceil((y1 - y0) / 100.0)::bigint AS tiles FROM l1")
def st_tiles(spark, d):
    tiles = _whole(spark, d).select("rowkey", F.explode(st.st_tiles("geom", 100.0)).alias("t"))
    return tiles.groupBy("rowkey").agg(F.sum(st.st_area("t")).cast("bigint").alias("area"), F.count("*").alias("tiles"))


_REACHED = """near AS (SELECT a.category, a.rowkey AS a, b.rowkey AS b FROM l1 AS a JOIN l1 AS b ON a.category = b.category AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
        AND (least(a.x1, b.x1) > greatest(a.x0, b.x0) OR least(a.y1, b.y1) > greatest(a.y0, b.y0))),
    reach(category, a, b) AS (SELECT category, a, b FROM near UNION SELECT n.category, r.a, n.b FROM reach AS r JOIN near AS n ON n.category = r.category AND n.a = r.b)"""
_STRIPS = """xs AS (SELECT category, x, lead(x) OVER (PARTITION BY category ORDER BY x) AS nx FROM (SELECT DISTINCT category, unnest([x0, x1]) AS x FROM l1)),
    held AS (SELECT xs.category, xs.x, xs.nx, l1.y0, l1.y1 FROM xs JOIN l1 ON l1.category = xs.category AND l1.x0 <= xs.x AND l1.x1 >= xs.nx),
    runs AS (SELECT *, max(y1) OVER (PARTITION BY category, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM held),
    areas AS (SELECT category, cast(sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(upto, y0)))) AS bigint) AS area FROM runs GROUP BY category)"""


@query(f"""WITH RECURSIVE {L1}, {_REACHED}, {_STRIPS}
    SELECT category, area, cast(parts AS int) AS parts FROM areas JOIN (SELECT category, count(DISTINCT least_of) AS parts FROM (SELECT category, a, min(b) AS least_of FROM reach GROUP BY category, a) GROUP BY category) USING (category)""")
def st_union_agg(spark, d):
    found = st.dissolve(_whole(spark, d), ["category"])
    return found.select("category", F.round(st.st_area("geom")).cast("bigint").alias("area"), st.st_num_geometries("geom").alias("parts"))


@query(f"""WITH {L1}, p AS (SELECT DISTINCT category, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM l1),
    wide AS (SELECT category, min(x) AS xa, max(x) AS xb FROM p GROUP BY category),
    low AS (SELECT p.category, p.x, min(y) AS lo, max(y) AS hi FROM p GROUP BY p.category, p.x),
    sides AS (SELECT a.category, a.x AS ax, a.lo AS al, a.hi AS ah, b.x AS bx, b.lo AS bl, b.hi AS bh FROM low AS a JOIN low AS b ON a.category = b.category AND a.x < b.x),
    under AS (SELECT ax, al, bx, bl, s.category FROM sides AS s WHERE NOT EXISTS (SELECT 1 FROM low AS r WHERE r.category = s.category AND ((bx - ax) * (r.lo - al) - (bl - al) * (r.x - ax) < 0
        OR ((bx - ax) * (r.lo - al) = (bl - al) * (r.x - ax) AND (r.x < ax OR r.x > bx))))),
    over AS (SELECT ax, ah, bx, bh, s.category FROM sides AS s WHERE NOT EXISTS (SELECT 1 FROM low AS r WHERE r.category = s.category AND ((bx - ax) * (r.hi - ah) - (bh - ah) * (r.x - ax) > 0
        OR ((bx - ax) * (r.hi - ah) = (bh - ah) * (r.x - ax) AND (r.x < ax OR r.x > bx)))))
    SELECT category, cast(round((t - u) / 2.0) AS bigint) AS area, true AS convex FROM (SELECT category, sum((bx - ax) * (ah + bh)) AS t FROM over GROUP BY category) JOIN (SELECT category, sum((bx - ax) * (al + bl)) AS u FROM under GROUP BY category) USING (category)""")
def st_convex_hull(spark, d):
    found = st.hulls(_whole(spark, d), ["category"])
    return found.select("category", F.round(st.st_area("geom")).cast("bigint").alias("area"), st.st_is_convex("geom").alias("convex"))


@query(f"WITH {L1} SELECT rowkey, round(length + 3840 * sin(pi() / 96), 3) AS round, round(length + 80 * sqrt(2.0), 3) AS bevel, round(length + 160.0::double, 3) AS miter, round(length + 320 * tan(pi() / 8), 3) AS square FROM l1")
def st_offset_curve(spark, d):
    rim = _whole(spark, d).withColumn("rim", st.st_boundary("geom"))
    return rim.select("rowkey", *(F.round(st.st_length(st.st_offset_curve("rim", F.lit(20.0), join)), 3).alias(join) for join in ("round", "bevel", "miter", "square")))


def _geodesic_sql(rows: str, rounds: int = 8) -> str:
    """Metres on WGS84 between (a, b) and (c, e) in degrees, by so many inverse iterations."""
    f = "(1 / 298.257223563::double)"
    steps = f"SELECT *, radians(c - a) AS total, radians(c - a) AS lam, atan((1 - {f}) * tan(radians(b))) AS u, atan((1 - {f}) * tan(radians(e))) AS v FROM ({rows})"
    for _ in range(rounds):
        steps = f"SELECT *, sqrt(pow(cos(v) * sin(lam), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(lam), 2)) AS sn, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) AS cs FROM ({steps})"
        steps = f"SELECT *, atan2(sn, cs) AS s, cos(u) * cos(v) * sin(lam) / sn AS sa FROM ({steps})"
        steps = f"SELECT *, 1 - sa * sa AS c2, cs - 2 * sin(u) * sin(v) / (1 - sa * sa) AS mid FROM ({steps})"
        steps = f"SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS cc FROM ({steps})"
        keep = "k, a, b, c, e, total, u, v, sn, cs, s, c2, mid"
        steps = f"SELECT {keep}, total + (1 - cc) * {f} * sa * (s + cc * sn * (mid + cc * cs * (2 * mid * mid - 1))) AS lam FROM ({steps})"
        last, steps = steps, f"SELECT k, a, b, c, e, total, u, v, lam FROM ({steps})"
    minor = f"(6378137.0::double * (1 - {f}))"
    last = f"SELECT *, c2 * (pow(6378137.0::double, 2) - pow({minor}, 2)) / pow({minor}, 2) AS q FROM ({last})"
    last = f"SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS p, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS w FROM ({last})"
    return f"SELECT k, {minor} * p * (s - w * sn * (mid + w / 4 * (cs * (2 * mid * mid - 1) - w / 6 * mid * (4 * sn * sn - 3) * (4 * mid * mid - 3)))) AS metres FROM ({last})"


@query(f"WITH {L1} SELECT k, round(metres, 3) AS metres FROM ({_geodesic_sql('SELECT k, x0 / 10000.0::double AS a, y0 / 10000.0::double AS b, x1 / 10000.0::double AS c, y1 / 10000.0::double AS e FROM l1')})")
def geodesic_distance(spark, d):
    layer = synth.degrees(_layer(spark, d))
    return layer.select("k", F.round(st.st_geodesic_distance("xmin", "ymin", "xmax", "ymax"), 3).alias("metres"))


def _near_sql(l1: str, b1: str, l2: str, b2: str) -> str:
    """The mid-latitude formula between points in radians."""
    mid, dl, db = f"(({b1} + {b2}) / 2)", f"({l2} - {l1})", f"({b2} - {b1})"
    major, minor = f"{measure.MAJOR!r}::double", f"{measure.MINOR!r}::double"
    eta, t = f"(({major} * {major} - {minor} * {minor}) / ({minor} * {minor}) * pow(cos({mid}), 2))", f"pow(tan({mid}), 2)"
    n = f"({major} * {major} / {minor} / sqrt(1 + {eta}))"
    east = f"({n} * cos({mid}) * {dl} + {n} * cos({mid}) * (1 + {eta} - 9 * {eta} * {t}) / (24 * pow(1 + {eta}, 2)) * {dl} * pow({db}, 2) - {n} * pow(cos({mid}), 3) * {t} / 24 * pow({dl}, 3))"
    north = f"({n} / (1 + {eta}) * {db} - {n} * pow(cos({mid}), 2) * (2 + 3 * {t} + 3 * {t} * {eta}) / (24 * (1 + {eta})) * {db} * pow({dl}, 2) + {n} * ({eta} - {eta} * {t}) / (8 * pow(1 + {eta}, 3)) * pow({db}, 3))"
    return f"sqrt(pow({east}, 2) + pow({north}, 2))"


@query(f"""WITH {L1}, r AS (SELECT k, radians(x0 / 10000.0::double) AS a, radians(y0 / 10000.0::double) AS b, radians(x1 / 10000.0::double) AS c, radians(y1 / 10000.0::double) AS e FROM l1)
    SELECT k, round({_near_sql('a', 'b', 'c', 'b')} + {_near_sql('c', 'b', 'c', 'e')} + {_near_sql('c', 'e', 'a', 'e')} + {_near_sql('a', 'e', 'a', 'b')}, 3) AS metres FROM r""")
def ellipsoid_length(spark, d):
    return _ringed(spark, d).select("k", F.round(measure.ellipsoid_path_length(F.col("ring")), 3).alias("metres"))


_A, _B = f"{measure.MAJOR!r}::double", f"{measure.MINOR!r}::double"
_GK = f"""SELECT k, x, y, sin(b) AS sb, cos(b) AS cb, tan(b) AS tb, e, n, l * cos(b) AS m, pow(tan(b), 2) AS t, p * pow(cos(b), 2) AS h,
        {_A} * ((1 - e / 4 - 3 * pow(e, 2) / 64 - 5 * pow(e, 3) / 256 - 175 * pow(e, 4) / 16384) * b - (3 * e / 8 + 3 * pow(e, 2) / 32 + 45 * pow(e, 3) / 1024 + 105 * pow(e, 4) / 4096) * sin(2 * b)
        + (15 * pow(e, 2) / 256 + 45 * pow(e, 3) / 1024 + 525 * pow(e, 4) / 16384) * sin(4 * b) - (35 * pow(e, 3) / 3072 + 175 * pow(e, 4) / 12288) * sin(6 * b)) AS arc
    FROM (SELECT *, radians(y) AS b, radians(x - meridian) AS l, {_A} / sqrt(1 - e * pow(sin(radians(y)), 2)) AS n
        FROM (SELECT k, x0 / 10000.0::double AS x, y0 / 10000.0::double AS y, trunc((x0 / 10000.0::double + 6) / 6) * 6 - 3 AS meridian, 1 - pow({_B} / {_A}, 2) AS e, ({_A} * {_A} - {_B} * {_B}) / ({_B} * {_B}) AS p FROM l1))"""


@query(f"""WITH {L1} SELECT k, round(500000 + n * m * (1 + pow(m, 2) * ((1 - t + h) / 6 + pow(m, 2) * (5 - 18 * t + t * t + 14 * h - 58 * t * h) / 120)), 3) AS east,
    round(arc + n * tb * pow(m, 2) * (0.5::double + pow(m, 2) * ((5 - t + 9 * h + 4 * h * h) / 24 + pow(m, 2) * (61 - 58 * t + t * t) / 720)), 3) AS north FROM ({_GK})""")
def gauss_kruger(spark, d):
    layer = synth.degrees(_layer(spark, d))
    east, north = measure.gauss_kruger(F.col("xmin"), F.col("ymin"), sheets.central_meridian("xmin"))
    return layer.select("k", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


# overlay jobs on polygons


def _window(spark) -> DataFrame:
    """One polygon: a rectangle as rows of the range."""
    a, b, c, e = AREA
    rows = spark.range(1).select(F.lit("w").alias("id"), *(F.lit(v).alias(n) for v, n in zip((a, b, c, e), overlay.ENVELOPE)))
    return rows.withColumn("geom", st.st_make_envelope(*overlay.ENVELOPE))


def _units(area):
    return F.round(area * 1e8).cast("bigint")


@query(ORACLE_SQL["area_statistics_rect"])
def area_statistics(spark, d):
    found = overlay.area_statistics(_shaped(spark, d), _shaped(spark, d, 2).withColumnRenamed("region12", "region"), size=0.05)
    return found.select("region", "category", _units(F.col("area")).alias("area"))


@query(f"WITH {L1} SELECT substr(region12, 1, 6) AS region6, category, count(*) AS parts, cast(sum((c - a) * (e - b)) AS bigint) AS area FROM ({_CUT}) GROUP BY ALL")
def clip_job(spark, d):
    parts = overlay.clip(_shaped(spark, d), overlay.Range(_window(spark)))
    return parts.groupBy("region6", "category").agg(F.count("*").alias("parts"), F.sum(_units(st.st_area("geom"))).alias("area"))


@query(f"WITH {L1} SELECT substr(region12, 1, 6) AS region6, category, count(*) AS parts, cast(sum(round(area + length * 20 + 48 * 400 * sin(2 * pi() / 96))) AS bigint) AS area FROM l1 WHERE substr(region12, 1, 4) = '1103' GROUP BY ALL")
def buffer_job(spark, d):
    parts = overlay.buffer(_shaped(spark, d), overlay.Range(districts=("110300",), level=2), 0.002)
    return parts.groupBy("region6", "category").agg(F.count("*").alias("parts"), F.sum(_units(st.st_area("geom"))).alias("area"))


@query(f"WITH {L1}, {L2} SELECT substr(region, 1, 6) AS region6, category1, category2, cast(sum(overlap) AS bigint) AS area FROM ({_PAIRS} AND l1.category LIKE '01%') WHERE category1 <> category2 GROUP BY ALL")
def change_detection(spark, d):
    everywhere = overlay.Range(districts=tuple(f"1{i}0000" for i in range(10)), level=1)
    found = overlay.change_detection(_shaped(spark, d), _shaped(spark, d, 2), everywhere, ["0100"], size=0.05)
    return found.groupBy("region6", "category1", "category2").agg(F.sum(_units(st.st_area("geom"))).alias("area"))


@query(f"WITH {L1} SELECT cast(sum((c - a) * (e - b)) AS bigint) AS area, count(*) AS features FROM ({_CUT})")
def polygon_cut(spark, d):
    found = overlay.cut_area(overlay.grid_pieces(_shaped(spark, d), 0.05), _window(spark), 0.05)
    return found.select(_units(F.col("area")).alias("area"), "features")


def _cells(spark, d) -> DataFrame:
    """Centres and surfaces of the raster's cells, in degrees."""
    cells = raster.cell_surfaces(synth.raster(spark, d), GRID)
    x, y = F.col("col") * GRID + synth.ORIGIN_X + GRID // 2, F.lit(synth.ORIGIN_Y + synth.SPAN - GRID // 2) - F.col("row") * GRID
    return cells.select("surface", (x / synth.UNIT).alias("x"), (y / synth.UNIT).alias("y"))


_CENTRES = f"p AS (SELECT surface, {synth.ORIGIN_X} + col * {GRID} + {GRID // 2} AS x, {synth.ORIGIN_Y + synth.SPAN} - row * {GRID} - {GRID // 2} AS y FROM s)"


@query(f"""WITH {L1}, dem AS ({synth.RASTER}), s AS ({_SURFACE}), {_CENTRES}
    SELECT substr(region12, 1, 6) AS region6, category, round(sum(surface), 4) AS surface, count(*) AS cells FROM l1 JOIN p ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY ALL""")
def surface_area(spark, d):
    found = overlay.surface_area(_shaped(spark, d), _cells(spark, d), 0.05)
    return found.select("region6", "category", F.round("surface", 4).alias("surface"), "cells")


@query(f"""WITH {L1}, dem AS ({synth.RASTER}), s AS ({_SURFACE}), {_CENTRES}
    SELECT substr(region12, 1, 6) AS region6, category, round(sum(surface * (least(x1, x + {GRID // 2}) - greatest(x0, x - {GRID // 2})) * (least(y1, y + {GRID // 2}) - greatest(y0, y - {GRID // 2})) / {float(GRID * GRID)}), 1) AS surface
    FROM l1 JOIN p ON x + {GRID // 2} > x0 AND x - {GRID // 2} < x1 AND y + {GRID // 2} > y0 AND y - {GRID // 2} < y1 GROUP BY ALL""")
def surface_area_prorated(spark, d):
    found = overlay.surface_area(_shaped(spark, d), _cells(spark, d), 0.05, prorate=GRID / synth.UNIT)
    return found.select("region6", "category", F.round("surface", 1).alias("surface"))


@query(f"WITH {L1} SELECT rowkey, 2 * x0 + 7 AS x, y0 - 3 AS y, area * 2 AS area FROM l1")
def st_affine(spark, d):
    moved = _whole(spark, d).withColumn("g", Affine.scale(2.0, 1.0).then(Affine.shift(7.0, -3.0)).geometry("geom"))
    box = moved.select("rowkey", st.st_envelope("g").alias("b"), st.st_area("g").cast("bigint").alias("area"))
    return box.select("rowkey", F.col("b.xmin").cast("bigint").alias("x"), F.col("b.ymin").cast("bigint").alias("y"), "area")


@query(f"""WITH {L1}, v AS (SELECT rowkey, unnest([0, 1, 2, 3]) AS i, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM l1)
    SELECT rowkey, i, x, y FROM v QUALIFY row_number() OVER (PARTITION BY rowkey ORDER BY pow(x - {_CX}, 2) + pow(y - {_CY}, 2), i) = 1""")
def st_nearest_vertex(spark, d):
    near = _whole(spark, d).select("rowkey", F.explode(st.st_nearest_vertices("geom", F.lit(float(_CX)), F.lit(float(_CY)))).alias("v"))
    return near.select("rowkey", "v.i", F.col("v.x").cast("bigint").alias("x"), F.col("v.y").cast("bigint").alias("y"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    found = streams.windowed(_table(spark, d, "events"))
    return found.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {L1} SELECT category, min(xmin) AS xmin, max(ymax) AS ymax, count(*) AS parts FROM (SELECT category, x0 / 10000.0 AS xmin, y1 / 10000.0 AS ymax FROM l1) GROUP BY category")
def feature_json_lines(spark, d):
    """Features written as feature JSON and read back through the object reader."""
    lines = feature_json.to_feature_json(_shaped(spark, d), ["category"])
    back = feature_json.parse_lines(lines).withColumn("b", st.st_envelope("geom"))
    return back.groupBy(F.col("attributes")["category"].alias("category")).agg(F.min("b.xmin").alias("xmin"), F.max("b.ymax").alias("ymax"), F.count("*").alias("parts"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The rollup of category statistics with percentages."""
    return category_rollup_percent(spark, d)


from landgrid.plans import service_queries, shape_queries  # noqa: E402, F401  they register theirs
