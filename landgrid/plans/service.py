"""The feature query service over a feature table, a spatial index on it and a keyword index."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import st
from landgrid.functions.codes import category_parent
from landgrid.functions.text import tokens
from landgrid.kernel import codecs, ops
from landgrid.kernel.model import box
from landgrid.operators import features as feats
from landgrid.operators import keyword, stats
from landgrid.operators.spatial import point_query
from landgrid.plans.conditions import FeatureQuery, unit_parameters
from landgrid.plans.cover import cover, kind_of, may_hold


class FeatureService:
    """features: rowkey, region12, category, caption, area, length, geom, envelope and zvalue (operators.spatial.with_index).

    words: the keyword index (operators.keyword.build_keyword_index). units: features whose geometry or region a request
    may name by row key. Results of list requests are kept, persisted, for the ``kept`` last requests.
    """

    def __init__(self, features: DataFrame, words: DataFrame | None = None, units: DataFrame | None = None, kept: int = 16, top: int = 1000, limit_before_filter: bool = False):
        self.features, self.words, self.units = features, words, units
        self.kept, self.top, self.limit_before_filter = kept, top, limit_before_filter
        self._results: OrderedDict[FeatureQuery, DataFrame] = OrderedDict()

    # requests

    def condition(self, params: Mapping[str, str]) -> FeatureQuery | None:
        given = {k.upper(): v for k, v in params.items()}
        key = given.get("GNCROWKEY")
        if key and self.units is not None:
            unit = feats.get(self.units, key).select("category", "properties", st.st_as_wkt("geom").alias("wkt")).first()
            if unit is None:
                return None
            given = unit_parameters(given, unit["category"], unit["properties"] or {}, unit["wkt"])
        return FeatureQuery.from_params(given)

    def select(self, query: FeatureQuery) -> DataFrame:
        """The features of a request, whole."""
        chosen = self.features.filter(feats.in_categories(query.categories))
        if query.kind == "spatial":
            return self._meeting(chosen, query)
        chosen = chosen.filter(feats.in_region(query.region))
        if query.kind == "property":
            return chosen
        if self.words is None:
            raise ValueError("no keyword index")
        hits = keyword.search(self.words, self.features.count(), self._terms(query), every=True)
        if self.limit_before_filter:
            hits = keyword.top_hits(hits, self.top)
        found = chosen.join(hits.select("rowkey", "score"), "rowkey")
        return found if self.limit_before_filter else keyword.top_hits(found, self.top)

    def _terms(self, query: FeatureQuery) -> list[str]:
        one = self.features.sparkSession.range(1).select(tokens(F.lit(query.keyword or "")).alias("t")).first()
        return one["t"]

    def _meeting(self, chosen: DataFrame, query: FeatureQuery) -> DataFrame:
        """Features that meet any of the request's polygons, each once, and the polygons they meet."""
        parts = None
        for text in query.wkt:
            area = codecs.from_wkt(text)
            x0, y0, x1, y1 = area.envelope()
            ranges = cover((x0, y0, x1, y1), lambda b, g=area: ops.contains(g, box(*b)), lambda b, g=area: not ops.intersects(g, box(*b)))
            near = chosen.filter(may_hold(F.col("zvalue"), ranges)).withColumn("_kind", kind_of(F.col("zvalue"), ranges)).filter("_kind > 0")
            sure = near.filter("_kind = 2").drop("_kind")
            edge = near.filter("_kind = 1").drop("_kind")
            edge = edge.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
            edge = edge.filter(st.st_intersects("geom", st.st_from_wkt(F.lit(text))))
            found = sure.withColumn("inside", F.lit(True)).unionByName(edge.withColumn("inside", F.lit(False)))
            parts = found if parts is None else parts.unionByName(found.join(parts.select("rowkey"), "rowkey", "left_anti"))
        return parts

    # the interface

    def feature(self, key: str) -> DataFrame:
        return feats.detail(feats.get(self.features, key))

    def feature_list(self, params: Mapping[str, str]) -> DataFrame:
        """Row keys, captions and stored measures; statistics where the request asks for those only."""
        query = self.condition(params)
        if query is None:
            return self.features.limit(0)
        return self.statistics(params) if query.statistics_only else self._list(query)

    def _list(self, query: FeatureQuery) -> DataFrame:
        key = query.identity
        if key in self._results:
            self._results.move_to_end(key)
            return self._results[key]
        result = self.select(query).select("rowkey", "caption", "category", "area", "length").persist()
        self._results[key] = result
        while len(self._results) > self.kept:
            self._results.popitem(last=False)[1].unpersist()
        return result

    def page(self, params: Mapping[str, str]) -> DataFrame:
        """A page of the list with all columns but the geometry."""
        query = self.condition(params)
        if query is None:
            return feats.detail(self.features.limit(0))
        keys = feats.page(self._list(query).select("rowkey"), query.start, query.length)
        return feats.detail(feats.multi_get(self.features, keys)).orderBy("rowkey")

    def statistics(self, params: Mapping[str, str]) -> DataFrame:
        """Count, area and length by category, rolled up from the level of the requested categories, with percentages.

        In a spatial request, features on the boundary count with the part inside, in the coordinates' units; those
        that the index places inside count with the planar measures of their geometry, so that a sum has one unit.
        """
        query = self.condition(params)
        if query is None:
            return stats.rollup_percent(stats.category_stats(self.features.limit(0)))
        chosen = self.select(query)
        if query.kind == "spatial":
            area = codecs.to_wkt(ops.union(*(codecs.from_wkt(t) for t in query.wkt)))
            part = F.when(F.col("inside"), F.col("geom")).otherwise(st.st_intersection("geom", st.st_from_wkt(F.lit(area))))
            chosen = chosen.select("category", part.alias("part")).filter(~st.st_is_empty("part"))
            chosen = chosen.select("category", st.st_area("part").alias("area"), st.st_length("part").alias("length"))
        return stats.rollup_percent(stats.category_stats(chosen), stats.top_level(list(query.categories)))

    def point(self, x: float, y: float) -> DataFrame:
        """The feature at a point, from the finest cells: the envelope's hit of least key among those that hold it."""
        hits = self.features.filter((F.col("xmin") <= x) & (F.col("xmax") >= x) & (F.col("ymin") <= y) & (F.col("ymax") >= y))
        return point_query(hits.filter(st.st_contains_point("geom", F.lit(x), F.lit(y))), x, y)

    def keywords(self, text: str, region: str | None = None, categories: tuple[str, ...] = ()) -> DataFrame:
        """Row key, first word of the caption, category and its parent, of features with any of the words."""
        hits = keyword.search(self.words, self.features.count(), self._terms(FeatureQuery("keyword", keyword=text)), every=False)
        chosen = self.features.filter(feats.in_region(region) & feats.in_categories(categories))
        found = keyword.top_hits(chosen.join(hits.select("rowkey", "score"), "rowkey"), self.top)
        return found.select("rowkey", F.split("caption", " ")[0].alias("caption"), "category", category_parent("category").alias("parent"), "score")

    def keyword_statistics(self, params: Mapping[str, str]) -> DataFrame:
        return stats.category_stats(self.select(self.condition(params)))
