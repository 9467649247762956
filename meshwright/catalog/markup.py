"""Queries that write map documents from the tables and read them back: features, styles, overlays, archives, issues, folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..plans.staging import shared_path
from ..sources import kml
from . import maps, views
from .tables import read
from .views import sql_with

_OPEN, _CLOSE = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"


def _documents(rows: DataFrame, path: str, body: str) -> DataFrame:
    """Files (path, content): one document a row; ``body`` is SQL of what it holds."""
    return rows.selectExpr(f"{path} as path", f"encode(concat('{_OPEN}', {body}, '{_CLOSE}'), 'UTF-8') as content")


def _element(name: str, column: str) -> str:
    safe = f"replace(replace(replace(coalesce({column}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"'<{name}>', {safe}, '</{name}>'"


_PLACES = "array_join(transform(line, p -> concat_ws(',', cast(cast(p.lon as decimal(12,9)) as string), cast(cast(p.lat as decimal(12,9)) as string))), ' ')"


def _features(spark: SparkSession, d: str) -> DataFrame:
    own = views.assets(spark, d, "dv", "feature_id", "asset_id", "site_id", "network_family", "source_name")
    return views.of_features(views.lines(spark, d), own).select("geometry_id", "line", "asset_id", "site_id", "network_family", "source_name")


def kml_features(spark: SparkSession, d: str) -> DataFrame:
    """Lines as placemarks in nested folders, with attributes and a line and its first place as geometries: written as one document each and parsed."""
    body = f"concat('<Folder>', {_element('name', 'site_id')}, '<Folder>', {_element('name', 'network_family')}, '<Placemark>', {_element('name', 'source_name')}, '<ExtendedData><Data name=\"Asset ID\">', {_element('value', 'asset_id')}, '</Data></ExtendedData><MultiGeometry><LineString><coordinates>', {_PLACES}, '</coordinates></LineString><Point><coordinates>', substring_index({_PLACES}, ' ', 1), '</coordinates></Point></MultiGeometry></Placemark></Folder></Folder>')"
    found = kml.parse_files(_documents(_features(spark, d), "geometry_id", body)).where("record = 'placemark'")
    parts = found.selectExpr("path as geometry_id", "folder_path", "name", "attributes['Asset ID'] as asset_id", "inline(geometries)")
    first = "case when kind = 'Point' then from_json(coordinates, 'array<double>') else from_json(coordinates, 'array<array<double>>')[0] end"
    return parts.selectExpr("geometry_id", "folder_path", "name", "asset_id", "part", "kind", "valid", f"{first}[0] as lon", f"{first}[1] as lat", "case when kind = 'Point' then 1 else size(from_json(coordinates, 'array<array<double>>')) end as n_places")


def kml_files(spark: SparkSession, d: str) -> DataFrame:
    """Points written as KML files into the shared folder, read back from there."""
    path = shared_path(spark, "kml")
    points = views.points(spark, d).selectExpr("geometry_id", "array(named_struct('lon', cast(lon as decimal(12,9)), 'lat', cast(lat as decimal(12,9)))) as line")
    kml.write_kml(points.select(kml.placemark(F.col("geometry_id"), F.lit("Point"), F.col("line")).alias("xml")), path)
    found = kml.read_kml(spark, path).where("record = 'placemark'").selectExpr("name as geometry_id", "from_json(geometries[0].coordinates, 'array<double>') as p", "geometries[0].valid as valid")
    return found.selectExpr("geometry_id", "p[0] as lon", "p[1] as lat", "valid")


def kml_styles(spark: SparkSession, d: str) -> DataFrame:
    """Styles of placemarks: chains of maps as long as the asset's name, rings of maps and missing styles, resolved."""
    rows = views.assets(spark, d, "source_name", "object_role")
    n = "length(source_name)"
    styles = f"concat('<Style id=\"s0\"/>', array_join(transform(sequence(1, greatest({n}, 1)), i -> concat('<StyleMap id=\"s', i, '\"><Pair><key>normal</key><styleUrl>#s', i - 1, '</styleUrl></Pair></StyleMap>')), ''), '<StyleMap id=\"c1\"><Pair><key>normal</key><styleUrl>#c2</styleUrl></Pair></StyleMap><StyleMap id=\"c2\"><Pair><key>normal</key><styleUrl>#c1</styleUrl></Pair></StyleMap>')"
    wanted = f"case object_role when 'device_node' then concat('#s', {n}) when 'cable_path' then '#c1' when 'coverage_area' then '#none' else 'other.kml#s' end"
    body = f"concat({styles}, '<Placemark><styleUrl>', {wanted}, '</styleUrl></Placemark>')"
    return kml.resolve_styles(kml.parse_files(_documents(rows, "object_id", body))).selectExpr("path as object_id", "ref", "status")


def kml_overlays(spark: SparkSession, d: str) -> DataFrame:
    """Ground overlays over the box of each site's points, their boxes checked and turned by 30 degrees."""
    own = views.assets(spark, d, "dv", "feature_id", "site_id")
    boxes = own.select("site_id").distinct().join(views.of_features(views.points(spark, d), own).groupBy("site_id").agg(*map(F.expr, ("max(lat) as north", "min(lat) as south", "max(lon) as east", "min(lon) as west"))), "site_id", "left")
    sides = ", ".join(f"'<{s}>', coalesce(cast(cast({s} as decimal(12,9)) as string), 'none'), '</{s}>'" for s in ("north", "south", "east", "west"))
    found = kml.parse_files(_documents(boxes, "site_id", f"concat('<GroundOverlay><Icon><href>map.png</href></Icon><LatLonBox>', {sides}, '</LatLonBox></GroundOverlay>')")).where("record = 'overlay'")
    told = found.select(F.col("path").alias("site_id"), F.col("style_url").alias("href"), kml.valid_box().alias("valid"), *[F.expr(f"try_cast(attributes['{s}'] as double) as {s}") for s in ("north", "south", "east", "west")])
    corner = geo.rotated_corners(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.lit(30.0))[0]
    return told.select("site_id", "href", "valid", F.round(corner["lon"], 6).alias("corner_lon"), F.round(corner["lat"], 6).alias("corner_lat"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "dataset_versions").selectExpr(f"{views.id_sql('dataset_version_id')} as dv").where("dv is not null").distinct().selectExpr("dv", "ascii(right(dv, 1)) % 4 as kind")


def kml_issues(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of documents that are unsafe, broken, without a root, or hold what isn't read; one a version."""
    body = "case kind when 0 then '<!DOCTYPE kml [<!ENTITY a \"b\">]><kml/>' when 1 then '<kml><Document>' when 2 then '<gpx/>' else '<kml><Document><NetworkLink/><Placemark><Point><coordinates>181,-95</coordinates></Point></Placemark></Document></kml>' end"
    found = kml.parse_files(_versions(spark, d).selectExpr("dv as path", f"encode({body}, 'UTF-8') as content"))
    return found.selectExpr("path as dv", "record", "name", "geometries[0].valid as valid")


def _zipped(rows: DataFrame) -> DataFrame:
    """An archive for each version; every fourth has a path that leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dv, kind in zip(batch.column("dv").to_pylist(), batch.column("kind").to_pylist()):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    for name in ("files/b.kml", "a.kml", "doc.kml", "images/icon.png", *(["../out.kml"] if kind == 0 else [])):
                        archive.writestr(name, f"{_OPEN}<Placemark><name>{dv} {name}</name></Placemark><Placemark><name>shared</name></Placemark>{_CLOSE}" if name.endswith("kml") else dv)
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("dv"), pa.array(out, pa.binary()), pa.array(["./IMAGES/icon.png"] * len(out), pa.string())], ["path", "content", "wanted"])

    return rows.mapInArrow(run, "path string, content binary, wanted string")


def kmz_documents(spark: SparkSession, d: str) -> DataFrame:
    """Placemarks of archives: documents in their order, the first of equal names stays, archives with unsafe paths refused."""
    found = kml.parse_files(_zipped(_versions(spark, d)))
    order = F.expr("case when lower(document) = 'doc.kml' then 0 when endswith(lower(document), '/doc.kml') then 1 else 2 end")
    kept = found.groupBy("path", "record", "name").agg(F.min(F.struct(order.alias("o"), F.lower("document").alias("l"), "document")).alias("m"))
    return kept.selectExpr("path as dv", "record", "name", "m.document as document")


def kmz_resources(spark: SparkSession, d: str) -> DataFrame:
    """A picture of each archive, by its path inside."""
    return kml.resources(_zipped(_versions(spark, d))).selectExpr("path as dv", "name", "size", "sha256", "issue")


def folder_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of assets' names as folders, by the labels and aliases of the vocabulary."""
    terms = read(spark, d, "vocabulary_terms").where("field_name = 'asset_type'").selectExpr("canonical_value as category", "explode(array_union(array(replace(canonical_value, '_', ' '), label), coalesce(aliases, cast(array() as array<string>)))) as alias")
    aliases = terms.select(text.token_text(F.col("alias")).alias("alias"), "category")
    folders = views.assets(spark, d, "source_name", "asset_type").select(F.col("object_id").alias("id"), F.split(text.token_text(F.concat_ws(" ", "source_name", "asset_type")), " ").alias("words"))
    return kml.folder_categories(folders, aliases).selectExpr("id as object_id", "category")


QUERIES = {f.__name__: f for f in (kml_features, kml_files, kml_styles, kml_overlays, kml_issues, kmz_documents, kmz_resources, folder_categories)}

_V = f"v as (select distinct {views._i('dataset_version_id')} as dv from dataset_versions), w as (select dv, ascii(right(dv, 1)) % 4 as kind from v where dv is not null)"
_WIDE, _PLAIN = "".join(chr(0xFF41 + i) for i in range(26)), "".join(chr(97 + i) for i in range(26))
_TOKENS = lambda c: maps._NORM.format(f"translate(lower({c}), '{_WIDE}', '{_PLAIN}')")

SQL = {
    "kml_features": sql_with("assets", "lines") + """, f as (select l.geometry_id, l.line, a.asset_id, a.site_id, a.network_family, a.source_name from lines l join assets a on a.dv = l.dv and a.feature_id = l.feature_id where a.feature_id <> ''),
      g as (select *, concat_ws('/', nullif(site_id, ''), nullif(network_family, '')) as folder_path, coalesce(nullif(source_name, ''), 'Placemark 1') as name, line[1][1]::decimal(12, 9)::double as lon, line[1][2]::decimal(12, 9)::double as lat from f)
      select geometry_id, folder_path, name, nullif(asset_id, '') as asset_id, 'geometry[0].LineString[0]' as part, 'LineString' as kind, true as valid, lon, lat, len(line)::int as n_places from g union all select geometry_id, folder_path, name, nullif(asset_id, ''), 'geometry[0].Point[1]', 'Point', true, lon, lat, 1 from g""",
    "kml_files": sql_with("points") + " select geometry_id, lon::decimal(12, 9)::double as lon, lat::decimal(12, 9)::double as lat, true as valid from points",
    "kml_styles": sql_with("assets") + " select object_id, case object_role when 'device_node' then '#s0' when 'cable_path' then '#c1' when 'coverage_area' then '#none' else 'other.kml#s' end as ref, case object_role when 'device_node' then 'resolved' when 'cable_path' then 'cycle' when 'coverage_area' then 'missing' else 'external' end as status from assets",
    "kml_overlays": sql_with("assets", "points") + """, s as (select distinct site_id from assets), b as (select site_id, max(lat)::decimal(12, 9)::double as n, min(lat)::decimal(12, 9)::double as s, max(lon)::decimal(12, 9)::double as e, min(lon)::decimal(12, 9)::double as w from points p join assets a on a.dv = p.dv and a.feature_id = p.feature_id and a.feature_id <> '' group by all)
      select s.site_id, 'map.png' as href, b.n is not null as valid, round((w + e) / 2 + (w - (w + e) / 2) * cos(radians(30)) - (n - (s.s0 + n) / 2) * sin(radians(30)), 6) as corner_lon, round((s.s0 + n) / 2 + (w - (w + e) / 2) * sin(radians(30)) + (n - (s.s0 + n) / 2) * cos(radians(30)), 6) as corner_lat from (select s.site_id, b.s as s0 from s left join b using (site_id)) s left join b using (site_id)""",
    "kml_issues": f"with {_V} select dv, case when kind = 3 then 'placemark' else 'issue' end as record, case kind when 0 then 'unsafe_xml_declaration' when 1 then 'invalid_xml' when 2 then 'missing_kml_root' else 'Placemark 1' end as name, case when kind = 3 then false end as valid from w union all select dv, 'issue', 'unsupported_element', null from w where kind = 3",
    "kmz_documents": f"with {_V} select dv, 'placemark' as record, dv || ' ' || x as name, x as document from w, unnest(['files/b.kml', 'a.kml', 'doc.kml']) as u(x) where kind <> 0 union all select dv, 'placemark', 'shared', 'doc.kml' from w where kind <> 0 union all select dv, 'issue', 'unsafe_archive_path', '' from w where kind = 0",
    "kmz_resources": f"with {_V} select dv, 'images/icon.png' as name, length(dv) as size, sha256(dv) as sha256, null::varchar as issue from w",
    "folder_categories": sql_with("assets") + f""", n as (select object_id, {_TOKENS("concat_ws(' ', source_name, asset_type)")} as t from assets), a as (select {_TOKENS('x')} as alias, min(canonical_value) as category from (select canonical_value, unnest([replace(canonical_value, '_', ' '), label] || coalesce(aliases, [])) as x from vocabulary_terms where field_name = 'asset_type') where x is not null group by 1),
      m as (select object_id, arg_min(category, (-length(alias), alias)) as category from n join a on alias <> '' and (t = alias or (length(alias) > 3 and contains(' ' || t || ' ', ' ' || alias || ' '))) group by 1) select object_id, coalesce(category, 'unmapped') as category from n left join m using (object_id)""",
}
