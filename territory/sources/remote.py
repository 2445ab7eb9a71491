"""WFS, ArcGIS REST, GeoJSON and Overpass as data sources.

Paging loses nothing: where the server tells how many features match, the pages after the first are dealt to tasks, each as
long as the server made the first one; else pages are asked for until one is empty, whatever their length, by one task, or
with the option ``tiles`` by many: the box is cut into ``4 ** TILE_LEVEL`` tiles, a task each, and a tile whose answer is as long
as that of the whole box (which the server may have cut off) is quartered, again and again. At ``TILE_DEPTH`` the last
tile's pages are asked for one by one, so that more features in one place than an answer holds are not lost. Features on the
edges of tiles come more than once: with tiles each row has its ``feature_id``, and ``read_tiled`` keeps one row an id.
``payloads`` gives the pages as they came, a row each, to be written down once and decoded from there
(``sources.payloads``).
"""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from territory.sources.base import FEATURE_ID, as_row, features, features_of, fetch, fetch_parts, infer_schema

TILE_LEVEL, TILE_DEPTH = 2, 24
#: Elements of a page of a map payload, and characters within which its elements begin.
PAGE, HEAD = 5000, 1 << 20
_ELEMENTS = re.compile(r'\s*\{(?:\s*"(?:[^"\\]|\\.)*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|\{[^{}]*\}|[^\s"{}\[\],]+)\s*,)*\s*("elements")\s*:\s*\[')
_BETWEEN = re.compile(r"[\s,]*")
OVERPASS_SCHEMA = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>, pos bigint"


class Request(InputPartition):
    """The pages from ``start`` on, until ``stop`` if there is one; ``body`` is the first of them where it is there already."""

    def __init__(self, where: tuple[str, ...], start: int = 0, stop: int | None = None, body: bytes | None = None) -> None:
        super().__init__((where, start))
        self.where, self.start, self.stop, self.body = where, start, stop, body


class Tile(InputPartition):
    """A tile of the box, how often the box was quartered for it, and how long an answer may be cut off."""

    def __init__(self, box: tuple[float, float, float, float], depth: int, cap: int, where: tuple[str, ...] = ()) -> None:
        super().__init__((box, depth))
        self.box, self.depth, self.cap, self.where = box, depth, cap, where

    def quarters(self) -> list[Tile]:
        a, b, c, d = self.box
        x, y = (a + c) / 2, (b + d) / 2
        return [Tile(box, self.depth + 1, self.cap, self.where) for box in ((a, b, x, y), (x, b, c, y), (a, y, x, d), (x, y, c, d))]


def matched(payload: dict) -> int | None:
    """How many features the server has in all, where it tells."""
    for k in ("numberMatched", "totalFeatures"):
        if str(payload.get(k, "")).isdigit():
            return int(payload[k])
    return None


def _goes_on(payload: dict, n: int, at: int, size: int) -> bool:
    """May there be more after ``at`` features, the last page having ``n``?"""
    total = matched(payload)
    if not n or total is not None:
        return n > 0 and at < total
    return bool(size) or _cut_off(payload)


def _cut_off(payload: dict) -> bool:
    """Does the server say that it left features out?"""
    return bool(payload.get("exceededTransferLimit") or (payload.get("properties") or {}).get("exceededTransferLimit"))


class _Paged(DataSource):
    def _page(self, start: int, where: tuple[str, ...], box: tuple[float, ...] | None = None) -> str:
        raise NotImplementedError

    @property
    def tiled(self) -> bool:
        return self.options.get("tiles", "false").lower() == "true"

    def tile_bodies(self, t: Tile) -> Iterator[tuple[int, str, bytes]]:
        """(start, url, body) of all answers of a tile that are whole; those of tiles whose answers may not be are dropped for
        those of their quarters."""
        open_ = [t]
        while open_:
            t = open_.pop()
            if t.depth >= TILE_DEPTH:
                yield from self.bodies(Request(t.where), t.box)
                continue
            url = self._page(0, t.where, t.box)
            body = fetch(url)
            payload = json.loads(body)
            n = len(features_of(payload))
            if n and (n >= t.cap or _cut_off(payload)):
                open_ += t.quarters()
            elif n:
                yield 0, url, body

    @property
    def page_size(self) -> int:
        return int(self.options.get("pageSize", "0"))

    def bodies(self, r: Request | Tile, box: tuple[float, ...] | None = None) -> Iterator[tuple[int, str, bytes]]:
        """(start, url, body) of the request's pages."""
        if isinstance(r, Tile):
            yield from self.tile_bodies(r)
            return
        at, before = r.start, None
        while r.stop is None or at < r.stop:
            url = self._page(at, r.where, box)
            body = r.body if at == r.start and r.body is not None else fetch(url)
            if body == before:  # a server that does not page gives the same page again
                return
            payload = json.loads(body)
            n = len(features_of(payload))
            if n or at == r.start:
                yield at, url, body
            at, before = at + n, body
            if not _goes_on(payload, n, at, self.page_size):
                return

    def requests(self, where: tuple[str, ...]) -> list[Request] | list[Tile]:
        tiled = self.tiled
        body = fetch(self._page(0, where))
        payload = json.loads(body)
        n, total = len(features_of(payload)), matched(payload)
        if tiled and n and total is None:
            tiles = [Tile(tuple(float(v) for v in self.options["bbox"].split(",")[:4]), 0, n, where)]
            for _ in range(TILE_LEVEL):
                tiles = [q for t in tiles for q in t.quarters()]
            return tiles
        if not n or total is None or total <= n:
            return [Request(where, 0, None, body)]
        starts = range(n, total, n)
        return [Request(where, 0, n, body), *(Request(where, x, y) for x, y in zip(starts, [*starts[1:], None], strict=True))]


class _Features(_Paged):
    """``schema`` may be given; else all pages' features tell it."""

    @property
    def pushes(self) -> bool:
        """Can the server take a filter beside what it is asked already?"""
        return True

    def schema(self) -> StructType:
        told = infer_schema(f for r in self.requests(()) for _, _, body in self.bodies(r) for f in features(body))
        return StructType([*told.fields, StructField(FEATURE_ID, StringType())]) if self.tiled else told

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self, schema)


class FeatureReader(DataSourceReader):
    """Equality on the filter column goes to the server; Spark checks it again."""

    def __init__(self, source: _Features, schema: StructType) -> None:
        self.source, self.kinds, self.where = source, schema, ()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        pushed = []
        for f in filters:
            if self.source.pushes and isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, int | str) and not isinstance(f.value, bool):
                value = str(f.value) if isinstance(f.value, int) else "'" + f.value.replace("'", "''") + "'"
                pushed.append(f"{f.attribute[0]} = {value}")
            yield f
        self.where = tuple(pushed)

    def partitions(self) -> list[InputPartition]:
        return self.source.requests(self.where)

    def read(self, partition: Request) -> Iterator[tuple]:
        for _, _, body in self.source.bodies(partition):
            for f in features(body):
                yield as_row(f, self.kinds)


def read_tiled(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """The features of a ``wfs`` or ``arcgis`` layer in a box, read tile by tile, one row an id."""
    return spark.read.format(kind).options(**options, tiles="true").load().dropDuplicates([FEATURE_ID])


class GeoJson(_Features):
    """A feature collection at ``path``."""

    @classmethod
    def name(cls) -> str:
        return "geojson"

    def _page(self, start: int, where: tuple[str, ...], box: tuple[float, ...] | None = None) -> str:
        return self.options["path"]


class Wfs(_Features):
    """Options endpoint, typeName, srs, cql or bbox, pageSize, tiles."""

    @property
    def tiled(self) -> bool:
        if super().tiled and (self.options.get("cql") or not self.options.get("bbox")):
            raise ValueError("tiles are of a box, which a request has beside no other filter")
        return super().tiled

    @property
    def pushes(self) -> bool:
        return not self.tiled

    @classmethod
    def name(cls) -> str:
        return "wfs"

    def _page(self, start: int, where: tuple[str, ...], box: tuple[float, ...] | None = None) -> str:
        o = self.options
        q = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeNames": o["typeName"], "srsName": o.get("srs", "EPSG:4674"), "outputFormat": "application/json"}
        cql = [c for c in (o.get("cql"), *where) if c]
        bbox = ",".join(map(repr, box)) if box else o.get("bbox")
        if cql:
            q["CQL_FILTER"] = " AND ".join(cql)
        elif bbox:
            q["bbox"] = f"{bbox},{q['srsName']}"
        q |= {"count": str(self.page_size)} if self.page_size else {}
        q |= {"startIndex": str(start)} if self.page_size or start else {}
        e = o["endpoint"]
        return e + ("&" if "?" in e else "?") + urllib.parse.urlencode(q)


class ArcGis(_Features):
    """Options endpoint, layerId, srs, where and bbox, pageSize, tiles."""

    @classmethod
    def name(cls) -> str:
        return "arcgis"

    def _page(self, start: int, where: tuple[str, ...], box: tuple[float, ...] | None = None) -> str:
        o = self.options
        wkid = o.get("srs", "EPSG:4674").rpartition(":")[2]
        q = {"outFields": "*", "f": "geojson", "outSR": wkid, "where": " AND ".join(c for c in (o.get("where"), *where) if c) or "1=1"}
        bbox = ",".join(map(repr, box)) if box else o.get("bbox")
        if bbox:
            q |= {"geometry": bbox, "geometryType": "esriGeometryEnvelope", "inSR": wkid, "spatialRel": "esriSpatialRelIntersects"}
        q |= {"resultOffset": str(start)} if self.page_size or start else {}
        q |= {"resultRecordCount": str(self.page_size)} if self.page_size else {}
        return f"{o['endpoint'].rstrip('/')}/{o['layerId']}/query?" + urllib.parse.urlencode(q)


class Overpass(DataSource):
    """Elements of a payload at ``path``, or of a query posted to ``endpoint``; an answer that is no payload, or tells of an error, fails."""

    @classmethod
    def name(cls) -> str:
        return "overpass"

    def schema(self) -> str:
        return OVERPASS_SCHEMA

    def reader(self, schema: StructType) -> OverpassReader:
        return OverpassReader(dict(self.options))


def overpass_parts(o: dict) -> tuple[str, Iterator[str]]:
    """(location, the answer's text in parts)"""
    if "path" in o:
        return o["path"], fetch_parts(o["path"])
    return o["endpoint"], fetch_parts(o["endpoint"], urllib.parse.urlencode({"data": o["query"]}).encode())


def element_texts(parts: Iterable[str]) -> Iterator[tuple[dict, str]]:
    """(element, its text) of a map payload that comes in parts; no more of it is held than a part and an element.

    A text without elements (an error page), one that ends too early, and one whose remark tells of an error raise: the
    last ones after the elements they have.
    """
    parts = iter(parts)
    text = next(parts, "")
    while not (begin := _ELEMENTS.match(text)) and len(text) < HEAD and (more := next(parts, None)) is not None:
        text += more
    if not begin:
        raise ValueError(f"no map payload: {text[:200]!r}")
    head, at, decode = text[: begin.start(1)], begin.end(), json.JSONDecoder().raw_decode
    while True:
        at = _BETWEEN.match(text, at).end()
        if at < len(text):
            if text[at] == "]":
                break
            try:
                element, end = decode(text, at)
            except ValueError:
                end = None
            if end is not None and end < len(text):
                yield element, text[at:end]
                at = end
                continue
        more = next(parts, None)
        if more is None:
            raise ValueError(f"no map payload: it ends within its elements, after {text[max(0, at - 100) : at]!r}")
        text, at = text[at:] + more, 0
    rest = text[at + 1 :] + "".join(parts)
    try:
        around = json.loads(f'{head}"elements": []{rest}')
    except ValueError:
        raise ValueError(f"no map payload: {rest[:200]!r}") from None
    if "error" in str(around.get("remark", "")).lower():
        raise ValueError(f"the server gave up: {around['remark']}")


class OverpassReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        num = lambda v: None if v is None else float(v)
        for pos, (e, _) in enumerate(element_texts(overpass_parts(self.options)[1])):
            yield e.get("type"), e.get("id"), num(e.get("lat")), num(e.get("lon")), e.get("nodes"), {k: str(v) for k, v in e["tags"].items()} if e.get("tags") is not None else None, pos


def element_pages(o: dict) -> Iterator[tuple[int, str, str]]:
    """(place of the first element, location, text) of an answer as payloads of ``PAGE`` elements each; one without elements
    has one page."""
    url, parts = overpass_parts(o)
    page: list[str] = []
    n = 0
    for _, text in element_texts(parts):
        page.append(text)
        n += 1
        if len(page) == PAGE:
            yield n - PAGE, url, f'{{"elements":[{",".join(page)}]}}'
            page = []
    if page or not n:
        yield n - len(page), url, f'{{"elements":[{",".join(page)}]}}'


class Payloads(DataSource):
    """(page, url, body): what the source of option ``kind`` answers, a row a page."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "page bigint, url string, body string"

    def reader(self, schema: StructType) -> PayloadReader:
        return PayloadReader(self.options)


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def _source(self) -> _Paged | None:
        kinds = {c.name(): c for c in (GeoJson, Wfs, ArcGis)}
        return kinds[self.options["kind"]](self.options) if self.options["kind"] != "overpass" else None

    def partitions(self) -> list[InputPartition]:
        source = self._source()
        return source.requests(()) if source else [Request(())]

    def read(self, partition: Request) -> Iterator[tuple]:
        source = self._source()
        if source is None:
            yield from element_pages(self.options)
            return
        for at, url, body in source.bodies(partition):
            yield at, url, body.decode()
