"""KML and KMZ files as tables, and tables as KML files.

A document is parsed whole by one task (files above ``max_bytes`` are reported,
not parsed); documents are spread over tasks. One row comes out per placemark,
overlay, style or issue, told apart by ``record``. Folder paths
and the fixed order of a placemark's direct geometries are kept.

Defined results: text with a DTD or entities, without a ``kml`` root, or that
is not XML gives one issue row and nothing else; an empty folder gives no rows;
a placemark without a name is called ``Placemark n``; null coordinates make the
part invalid. Repeated files are parsed once each.
"""

from __future__ import annotations

import hashlib
import html
import io
import json
import math
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 64 * 1024 * 1024
MAX_ENTRIES, MAX_RATIO = 2_000, 200
#: Geometries in the order in which several of one placemark are put together.
GEOMETRIES = ("Point", "LineString", "Polygon", "MultiGeometry", "Track", "MultiTrack")
#: Elements that are reported, not read.
UNSUPPORTED = ("NetworkLink", "PhotoOverlay", "ScreenOverlay", "Model", "Tour", "BalloonStyle", "ListStyle")

SCHEMA = "path string, document string, record string, seq int, folder_path string, name string, description string, style_url string, visible boolean, attributes map<string,string>, geometries array<struct<part:string,kind:string,coordinates:string,valid:boolean>>, detail string"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _tag(c) == name), None)


def _text(e: ET.Element | None, name: str) -> str | None:
    found = _child(e, name) if e is not None else None
    return found.text.strip() if found is not None and found.text and found.text.strip() else None


def positions(text: str | None, separator: str = ",") -> list[list[float]]:
    """Tuples of numbers; what is no number is NaN."""
    out = []
    for part in (text or "").split() if separator == "," else [text or ""]:
        values = []
        for v in part.split(separator) if separator == "," else part.split():
            try:
                values.append(float(v))
            except ValueError:
                values.append(math.nan)
        if values:
            out.append(values[:3])
    return out


def _place_ok(p: list[float]) -> bool:
    return len(p) >= 2 and all(map(math.isfinite, p)) and abs(p[0]) <= 180 and abs(p[1]) <= 90


def ring_ok(ring: list[list[float]]) -> bool:
    """At least three different corners, all valid, around some area."""
    if not ring or not all(map(_place_ok, ring)) or len({(p[0], p[1]) for p in ring}) < 3:
        return False
    closed = ring if ring[0][:2] == ring[-1][:2] else [*ring, ring[0]]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(closed, closed[1:]))) > 0


def closed(ring: list[list[float]]) -> list[list[float]]:
    return ring if not ring or ring[0][:2] == ring[-1][:2] else [*ring, ring[0]]


def _parts(e: ET.Element, path: str) -> Iterator[tuple[str, str, list, bool]]:
    kind = _tag(e)
    if kind == "Point":
        p = positions(_text(e, "coordinates"))
        yield path, "Point", p[0] if p else [], len(p) == 1 and _place_ok(p[0])
    elif kind == "LineString":
        p = positions(_text(e, "coordinates"))
        yield path, "LineString", p, len(p) >= 2 and all(map(_place_ok, p))
    elif kind == "Polygon":
        rings = []
        for side in ("outerBoundaryIs", "innerBoundaryIs"):
            for boundary in (c for c in e if _tag(c) == side):
                ring = _child(boundary, "LinearRing")
                rings.append(closed(positions(_text(ring, "coordinates"))))
        yield path, "Polygon", rings, bool(rings) and all(map(ring_ok, rings))
    elif kind == "Track":
        p = [q for c in e if _tag(c) == "coord" for q in positions(c.text, " ")]
        yield path, "LineString", p, len(p) >= 2 and all(map(_place_ok, p))
    else:
        for i, c in enumerate(c for c in e if _tag(c) in GEOMETRIES):
            yield from _parts(c, f"{path}.{'LineString' if _tag(c) == 'Track' else _tag(c)}[{i}]")


def _attributes(e: ET.Element) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    data = _child(e, "ExtendedData")
    for item in data if data is not None else ():
        if _tag(item) == "Data" and item.get("name"):
            out.setdefault(item.get("name"), _text(item, "value"))
        elif _tag(item) == "SchemaData":
            for s in item:
                if _tag(s) == "SimpleData" and s.get("name"):
                    out.setdefault(s.get("name"), (s.text or "").strip() or None)
    return out


def plain_description(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip() or None


def parse(text: str) -> Iterator[dict]:
    """Rows of one KML text."""
    text = text.lstrip("﻿")
    row = lambda record, **k: {"record": record, "seq": 0, "folder_path": "", "name": None, "description": None, "style_url": None, "visible": None, "attributes": None, "geometries": None, "detail": None} | k
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.IGNORECASE):
        yield row("issue", name="unsafe_xml_declaration")
        return
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        yield row("issue", name="invalid_xml", detail=str(e))
        return
    if _tag(root) != "kml":
        yield row("issue", name="missing_kml_root")
        return
    counts = {"placemark": 0, "overlay": 0}
    held = [(root, "")]
    while held:  # depth first without recursion; what a container holds itself comes before its folders
        e, folder = held.pop()
        ahead = []
        for c in e:
            tag = _tag(c)
            if tag in ("Document", "Folder", "kml"):
                name = _text(c, "name") if tag == "Folder" else None
                ahead.append((c, "/".join(x for x in (folder, name) if x) if tag == "Folder" else folder))
            elif tag == "Placemark":
                counts["placemark"] += 1
                direct = [g for kind in GEOMETRIES for g in c if _tag(g) == kind]
                parts = [p for k, g in enumerate(direct) for p in _parts(g, "geometry[0]" if len(direct) == 1 else f"geometry[0].{_tag(g)}[{k}]")]
                yield row(
                    "placemark", seq=counts["placemark"], folder_path=folder, name=_text(c, "name") or f"Placemark {counts['placemark']}", description=plain_description(_text(c, "description")), style_url=_text(c, "styleUrl"),
                    visible=_text(c, "visibility") != "0", attributes=_attributes(c), geometries=[{"part": p, "kind": k, "coordinates": json.dumps(v).replace("NaN", "null").replace(" ", ""), "valid": ok} for p, k, v, ok in parts],
                )
            elif tag == "GroundOverlay":
                counts["overlay"] += 1
                box = _child(c, "LatLonBox")
                sides = {k: _text(box, k) for k in ("north", "south", "east", "west", "rotation")} if box is not None else {}
                yield row("overlay", seq=counts["overlay"], folder_path=folder, name=_text(c, "name") or f"Overlay {counts['overlay']}", visible=_text(c, "visibility") != "0", style_url=_text(_child(c, "Icon"), "href"), attributes=sides)
            elif tag in ("Style", "StyleMap"):
                pairs = {_text(p, "key"): _text(p, "styleUrl") for p in c if _tag(p) == "Pair" and _text(p, "key")}
                yield row("style", folder_path=folder, name=c.get("id"), style_url=pairs.get("normal") or next(iter(pairs.values()), None), detail=tag)
            elif tag in UNSUPPORTED:
                yield row("issue", folder_path=folder, name="unsupported_element", detail=tag)
        held += ahead[::-1]


def safe_entry(name: str) -> bool:
    """Whether an archive's entry stays inside: no absolute, parent or drive path."""
    path = name.replace("\\", "/")
    return bool(path) and not path.startswith("/") and not re.match(r"^[A-Za-z]:", path) and ".." not in path.split("/") and "\0" not in path


def kml_order(name: str) -> tuple:
    low = name.lower()
    return (0 if low == "doc.kml" else 1 if low.endswith("/doc.kml") else 2, low)


def documents(content: bytes, max_bytes: int) -> Iterator[tuple[str, str | None, str | None]]:
    """(name, text, issue) of each KML text in a KML or KMZ file."""
    if content[:2] != b"PK":
        yield "", content.decode("utf-8", "replace"), None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield "", None, "invalid_archive"
        return
    entries = [i for i in archive.infolist() if not i.is_dir()]
    if len(entries) > MAX_ENTRIES or sum(i.file_size for i in entries) > max_bytes or any(i.file_size > MAX_RATIO * max(1, i.compress_size) for i in entries):
        yield "", None, "archive_too_large"
    elif any(not safe_entry(i.filename) for i in entries):
        yield "", None, "unsafe_archive_path"
    elif any(i.flag_bits & 1 for i in entries):
        yield "", None, "encrypted_archive"
    else:
        for i in sorted((i for i in entries if i.filename.lower().endswith(".kml")), key=lambda i: kml_order(i.filename)):
            yield i.filename, archive.read(i).decode("utf-8", "replace"), None


def read_kml(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of all KML and KMZ files under ``path``, see ``SCHEMA``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").rlike(r"\.(kml|kmz)$"))
    return parse_files(files, max_bytes)


def parse_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The same of files (path, content binary) that are at hand."""
    rows = files.select("path", F.when(F.length("content") <= max_bytes, F.col("content")).alias("content"))

    part = pa.struct([("part", pa.string()), ("kind", pa.string()), ("coordinates", pa.string()), ("valid", pa.bool_())])
    kinds = {"seq": pa.int32(), "visible": pa.bool_(), "attributes": pa.map_(pa.string(), pa.string()), "geometries": pa.list_(part)}
    names = ("path", "document", "record", "seq", "folder_path", "name", "description", "style_url", "visible", "attributes", "geometries", "detail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                out = []
                for name, text, issue in documents(content, max_bytes) if content is not None else [("", None, "kml_too_large")]:
                    found = parse(text) if issue is None else iter([{"record": "issue", "seq": 0, "folder_path": "", "name": issue}])
                    out += [r | {"path": source, "document": name} for r in found]
                for at in range(0, len(out), 10_000):
                    piece = out[at : at + 10_000]
                    value = lambda r, n: list(r[n].items()) if n == "attributes" and r.get(n) is not None else r.get(n)
                    yield pa.RecordBatch.from_arrays([pa.array([value(r, n) for r in piece], kinds.get(n, pa.string())) for n in names], list(names))

    return rows.mapInArrow(run, SCHEMA)


def _ended(ahead: dict[str, str | None]) -> dict[str, tuple[str, str]]:
    """Reference -> (where it ends, status) of the styles of one document (reference -> the next one, None for a style itself); each is passed once."""
    ends: dict[str, tuple[str, str]] = {}
    for start in ahead:
        at, passed = start, []
        while at not in ends:
            passed.append(at)
            ends[at] = "", "cycle"  # stands if the walk comes back here
            to = ahead[at]
            if to is None:
                ends[at] = at, "resolved"
            elif to not in ahead:
                ends[at] = to, "missing"
            else:
                at = to
        for ref in passed:
            ends[ref] = ends[at] if ends[at][1] != "cycle" else (ref, "cycle")
    return ends


def resolve_styles(rows: DataFrame) -> DataFrame:
    """Placemarks with the style they end at: own reference, through any number of maps, cycles (which keep it) and missing ones told.

    A document's styles come to one task, as the document did, and before its
    placemarks, which stream by, so nothing is joined and no table can be taken
    for small enough to broadcast. Of several styles with one name the least next
    reference counts (a map before a style); without a path or a document no
    style is held.
    """
    key = ["path", "document"]
    names = [*key, "seq", "name", "ref", "status"]
    wanted = rows.filter("record = 'placemark' or record = 'style' and name is not null and path is not null and document is not null")
    sorted_rows = wanted.select(*key, "record", "seq", "name", "style_url").repartition(*key).sortWithinPartitions(*key, F.col("record").desc(), "name", F.col("style_url").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ahead, ends = None, {}, None
        for batch in batches:
            out = []
            for path, document, record, seq, name, url in zip(*(batch.column(c).to_pylist() for c in (*key, "record", "seq", "name", "style_url"))):
                if (path, document) != current:
                    current, ahead, ends = (path, document), {}, None
                if record == "style":
                    ahead.setdefault(f"#{name}", url)
                    continue
                if ends is None:
                    ends = _ended(ahead)
                if url is None or not url.startswith("#"):
                    end = url, "none" if url is None else "external"
                else:
                    end = ends.get(url, (url, "missing"))
                out.append((path, document, seq, name, *end))
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "seq" else pa.string()) for n, c in zip(names, columns)], names)

    return sorted_rows.mapInArrow(run, "path string, document string, seq int, name string, ref string, status string")


def valid_box(attributes: str = "attributes") -> Column:
    """Whether an overlay's sides are numbers within the earth's bounds, north not below south; west may lie east of east (the date line)."""
    side = lambda n: f"try_cast({attributes}['{n}'] as double)"
    return F.expr(f"coalesce({side('north')} >= {side('south')} and {side('north')} <= 90 and {side('south')} >= -90 and {side('east')} between -180 and 180 and {side('west')} between -180 and 180, false)")


def folder_categories(folders: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, category) of folders (id, words array<string>) by aliases (alias, category): the longest alias that is the folder's name or, from four letters on, a run of whole words in it; ``unmapped`` for none.

    Runs of words meet aliases in an equi-join; the longest alias in words bounds
    the runs. Aliases are token texts; of two categories for one alias the least counts.
    """
    known = aliases.filter("alias != ''").groupBy("alias").agg(F.min("category").alias("category"))
    longest = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 0
    runs = folders.selectExpr("id", "words", f"explode(flatten(transform(sequence(0, greatest(size(words) - 1, 0)), i -> transform(sequence(1, greatest(least({max(1, longest)}, size(words) - i), 1)), n -> array_join(slice(words, i + 1, n), ' '))))) as alias")
    met = runs.join(known, "alias").where("length(alias) > 3 or alias = array_join(words, ' ')")
    best = met.groupBy("id").agg(F.expr("min(struct(-length(alias) as l, alias, category)) as m"))
    return folders.select("id").distinct().join(best, "id", "left").selectExpr("id", "coalesce(m.category, 'unmapped') as category")


def resources(files: DataFrame, wanted: str = "wanted", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, name, size, sha256, issue): the resource that each archive (path, content, wanted) is asked for, by its path inside; letter case and ``./`` don't matter."""
    rows = files.select("path", "content", F.col(wanted).alias("wanted"))

    def one(content: bytes, name: str) -> tuple[str | None, int | None, str | None, str | None]:
        if not name or not safe_entry(name):
            return None, None, None, "unsafe_resource_path"
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            return None, None, None, "invalid_archive"
        plain = lambda n: n.replace("\\", "/").removeprefix("./").lower()
        found = next((i for i in archive.infolist() if not i.is_dir() and plain(i.filename) == plain(name)), None)
        if found is None:
            return None, None, None, "resource_missing"
        if found.flag_bits & 1 or found.file_size > max_bytes or found.file_size > MAX_RATIO * max(1, found.compress_size):
            return found.filename, found.file_size, None, "resource_too_large"
        return found.filename, found.file_size, hashlib.sha256(archive.read(found)).hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(c, w) for c, w in zip(batch.column("content").to_pylist(), batch.column("wanted").to_pylist())]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "name", "size", "sha256", "issue"])

    return rows.mapInArrow(run, "path string, name string, size long, sha256 string, issue string")


def coverage(rows: DataFrame) -> DataFrame:
    """Counts of records, geometry kinds and their validity."""
    parts = rows.filter("record = 'placemark'").select(F.inline("geometries"))
    return rows.groupBy(F.col("record").alias("what"), F.lit("").alias("kind"), F.lit(None).cast("boolean").alias("valid")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        parts.groupBy(F.lit("geometry").alias("what"), "kind", "valid").agg(F.count(F.lit(1)).alias("n"))
    )


# --- writing ------------------------------------------------------------------


def escaped(column: Column) -> Column:
    out = F.coalesce(column, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def placemark(name: Column, kind: Column, coordinates: Column) -> Column:
    """A Placemark element of a point or line; ``coordinates`` is array<struct(lon, lat)>."""
    text = F.array_join(F.transform(coordinates, lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"))), " ")
    return F.concat(F.lit("<Placemark><name>"), escaped(name), F.lit("</name><"), kind, F.lit("><coordinates>"), text, F.lit("</coordinates></"), kind, F.lit("></Placemark>"))


def write_kml(placemarks: DataFrame, path: str) -> None:
    """``placemarks`` (column ``xml``) as KML files; every file is a whole document."""

    def framed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>']})
        for frame in frames:
            yield pd.DataFrame({"value": frame["xml"]})
        yield pd.DataFrame({"value": ["</Document></kml>"]})

    raw = {"extension": "kml", "quote": "\0", "sep": "\x01", "escapeQuotes": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # lines as they are; only this writer lets files be named
    placemarks.select("xml").mapInPandas(framed, "value string").write.mode("overwrite").options(**raw).csv(path)
