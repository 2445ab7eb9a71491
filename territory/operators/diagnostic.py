"""The municipal diagnostic: every source of a list to a layer of its own, once, with a report."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.functions import crs, urls
from territory.functions.codes import normalize_uf_value
from territory.functions.folders import written
from territory.functions.wkb import wkb_bbox
from territory.operators import geometry as G
from territory.operators import layout, overlay
from territory.operators import network as N
from territory.operators.municipalities import in_box
from territory.operators.reader import read_geo
from territory.plans.sources import PROTOCOLS, Source, by_id
from territory.sources.base import fetch_changed
from territory.sources.payloads import decode_features

REPORT = "source_id string, status string, message string"


def report(states: DataFrame) -> DataFrame:
    """status and message of each row, from what became of a source: (supported, exists, fetch_failed, n_fetched, clipped, n_kept)."""
    reason = (
        F.when(~F.col("supported"), "unsupported").when(F.col("exists"), "exists").when(F.col("fetch_failed"), "fetch_error").when(F.col("n_fetched") == 0, "empty").when(F.col("clipped") & (F.col("n_kept") == 0), "empty_after_clip")
    )
    return states.withColumn("message", reason).withColumn("status", F.when(F.col("message").isNull(), "ok").when(F.col("message") == "fetch_error", "failed").otherwise("skipped"))


class LayerStore:
    """Layers below a folder, read and written through Spark's file systems, in versions that come into being at once.

    A version is a folder of Parquet files of its own (``data-...``); it counts once an empty marker with its number stands below
    ``_versions``, which is created after the last file. Readers take the version of the highest marker, so they see a
    whole layer or the one before, whatever becomes of a run that writes; nothing is renamed or written over. Of two runs
    that write at once both stand, and the higher marker counts. Each write leaves ``KEEP`` versions, for readers that are on
    their way; folders without a marker are left for ``vacuum``.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        #: Payloads whose server failed in this run, so that older answers stood in: why.
        self.stale: dict[str, str] = {}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        top = self._path()
        return top.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self, name: str) -> list[tuple[int, str]]:
        """(number, folder) of every whole version, the newest last."""
        return [(int(n[:12]), f"{self.root}/{name}/data-{n[13:]}") for n in self._names(*name.split("/"), "_versions") if n[:12].isdigit()]

    def layers(self) -> set[str]:
        """Names of the layers that have a whole version."""
        return {n for n in self._names() if n != "_raw" and self.versions(n)}

    def _write(self, name: str, rows: DataFrame) -> None:
        mark = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}/data-{mark}")
        number = max((n for n, _ in self.versions(name)), default=0) + 1
        self._fs().create(self._path(name, "_versions", f"{number:012d}-{mark}"), False).close()
        for _, folder in self.versions(name)[: -self.KEEP]:
            self._drop(name, folder)

    def _drop(self, name: str, folder: str) -> None:
        """Take a version away, its marker first."""
        fs, mark = self._fs(), folder.rpartition("data-")[2]
        for n in self._names(*name.split("/"), "_versions"):
            if n.endswith(mark):
                fs.delete(self._path(name, "_versions", n), False)
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def vacuum(self, name: str) -> int:
        """Delete all but the newest version and what broken runs left; how many folders. For times when no run writes."""
        whole = [folder for _, folder in self.versions(name)]
        left = [f"{self.root}/{name}/{n}" for n in self._names(*name.split("/")) if n.startswith("data-")]
        gone = [f for f in left if f not in whole[-1:]]
        for folder in gone:
            self._drop(name, folder)
        return len(gone)

    def write(self, name: str, layer: DataFrame, by_place: bool = False) -> None:
        """A new version of a layer; ``by_place`` lays it out along a curve, with boxes, for ``read(name, box)``."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"no layer name: {name!r}")
        self._write(name, layout.by_place(layer) if by_place else layer)

    def read(self, name: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """A layer's newest whole version; with a box, of a layer written by place the rows whose box meets it."""
        whole = self.versions(name)
        if not whole:
            raise ValueError(f"no layer: {name!r}")
        rows = self.spark.read.parquet(whole[-1][1])
        return layout.in_box(rows, *box) if box else rows

    def payloads(self, key: str, ask: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        """A source's raw answers: those written down below ``_raw`` if there are any, else (or with ``refresh``) what ``ask``
        gives, written first. If asking fails, older ones do, and ``stale`` says why."""
        if not re.fullmatch(r"[\w.-]+", key):
            raise ValueError(f"no payload name: {key!r}")
        name = f"_raw/{key}"
        have = bool(self.versions(name))
        if not have or refresh:
            try:
                self._write(name, ask())
                self.stale.pop(key, None)
            except Exception as e:  # noqa: BLE001
                if not have:
                    raise
                self.stale[key] = str(e).splitlines()[0] if str(e) else type(e).__name__
        return self.read(name)

    def text(self, key: str, url: str, refresh: bool = False) -> DataFrame:
        """One row (url, value, etag, modified): the text at a url, such as a catalog's list of releases, kept below ``_raw`` with the
        validators its server gave. With ``refresh`` the server is asked whether these still hold, and sends the text only if not; a
        text that is the same makes no new version. If asking fails, the kept one does, and ``stale`` says why."""
        if not re.fullmatch(r"[\w.-]+", key):
            raise ValueError(f"no payload name: {key!r}")
        name = f"_raw/{key}"
        have = self.read(name).where(F.col("url") == url).first() if self.versions(name) else None
        if have is None or refresh:
            try:
                got = fetch_changed(url, have and have.etag, have and have.modified)
                self.stale.pop(key, None)
                if got and (have is None or got[0].decode() != have.value or got[1:] != (have.etag, have.modified)):
                    self._write(name, self.spark.createDataFrame([(url, got[0].decode(), *got[1:])], "url string, value string, etag string, modified string"))
            except Exception as e:  # noqa: BLE001
                if have is None:
                    raise
                self.stale[key] = str(e).splitlines()[0] if str(e) else type(e).__name__
        return self.read(name)

    def register_views(self) -> list[str]:
        """Every layer as a temporary view of its name."""
        names = sorted(self.layers())
        for n in names:
            self.read(n).createOrReplaceTempView(n)
        return names


def stamped(layer: DataFrame, source: Source) -> DataFrame:
    """Lineage as columns: the day of extraction and the protocol."""
    return layer.withColumn("data_extracao", F.current_date()).withColumn("fonte", F.lit(source.protocol))


def clip_layer(layer: DataFrame, outline, outline_crs: str | int = crs.DEFAULT) -> DataFrame:
    """Cut a layer to an outline (a ring of coordinate pairs, or parts of rings) by what its geometry is: WKB
    (``geometry``), a line (``points``), a ring (``ring``), or x and y. Small rings go into the plan as expressions; outlines
    with many vertices, parts or holes go with a function that looks their edges up. The outline is brought to the layer's
    coordinate system, which the metadata of its geometry column names, vertex by vertex; a layer of an unknown system raises."""
    outline = crs.project_outline(outline, outline_crs, crs.layer_crs(layer))
    parts = overlay.as_parts(outline)
    if {"xmin", "ymin", "xmax", "ymax"} <= set(layer.columns):
        (x0, y0), (x1, y1) = overlay.outline_of(parts).box
        layer = in_box(layer, float(x0), float(y0), float(x1), float(y1))
    if "geometry" in layer.columns:
        return overlay.clip_layer(layer, parts)
    small = G.is_small_ring(outline)
    if "ring" in layer.columns:
        return G.clip_polygons(layer, "ring", outline) if small else overlay.clip_polygons(layer, "ring", parts)
    if "points" in layer.columns:
        return G.clip_lines(layer, "points", outline) if small else overlay.clip_lines(layer, "points", parts)
    return G.clip_points(layer, "x", "y", outline) if small else overlay.clip_points(layer, "x", "y", parts)


def near_outline(layer: DataFrame, outline, outline_crs: str | int = crs.DEFAULT) -> DataFrame:
    """The rows of a layer of WKB whose box meets the outline's: names of municipalities are not unique across units, so what a
    server gives for a name is held against the place."""
    if "geometry" not in layer.columns:
        return layer
    outline = crs.project_outline(outline, outline_crs, crs.layer_crs(layer))
    (x0, y0), (x1, y1) = overlay.outline_of(overlay.as_parts(outline)).box
    box = wkb_bbox(F.col("geometry"))
    return layer.withColumn("__b", box).where(F.col("__b.xmin").isNull() | G.bbox_intersects(F.col("__b"), float(x0), float(y0), float(x1), float(y1))).drop("__b")


def fetcher(
    spark: SparkSession,
    bbox: tuple[float, float, float, float],
    catalogs: dict[str, DataFrame],
    resolve: Callable[[str], str] = lambda p: p,
    page_size: int = 1000,
    overpass: str = "https://overpass-api.de/api/interpreter",
    raw: LayerStore | None = None,
    refresh: bool = False,
    tiles: bool = False,
) -> Callable[[Source, dict], DataFrame]:
    """How each protocol's rows are had: by server filter or box, a catalog's files, or a road query.

    A server is asked once a page a run: its answers are written down, in ``raw`` if there is one, where later runs find
    them (``refresh`` asks again), and decoded from there. With ``tiles`` a box is asked for tile by tile, by many tasks, of
    servers that do not tell how much there is.
    """
    box = ",".join(map(str, bbox))

    def answers(s: Source, place: dict, options: dict) -> DataFrame:
        ask = lambda: spark.read.format("payloads").options(**options).load()
        return raw.payloads(f"{s.id}_{place['code']}", ask, refresh) if raw else written(ask())

    def remote(kind: str, layer_option: str, cond: str, s: Source, place: dict) -> DataFrame:
        o = {"kind": kind, "endpoint": s.endpoint, layer_option: s.layer.replace("{uf}", (place["uf"] or "").lower()), "srs": s.srs, "pageSize": str(page_size)}
        if s.cut == "code":
            o[cond] = f"{s.field} = {place['code']}"
        elif s.cut == "name":
            o[cond] = "{} = '{}'".format(s.field, place["name"].replace("'", "''"))
        else:
            o |= {"bbox": box} | ({"tiles": "true"} if tiles else {})
        return crs.with_crs(decode_features(answers(s, place, o), one_an_id="tiles" in o), s.srs)

    def fetch(s: Source, place: dict) -> DataFrame:
        if s.protocol == "wfs":
            return remote("wfs", "typeName", "cql", s, place)
        if s.protocol == "arcgis":
            return remote("arcgis", "layerId", "where", s, place)
        if s.protocol == "osm":
            west, south, east, north = bbox
            told = answers(s, place, {"kind": "overpass", "endpoint": overpass, "query": urls.overpass_text(west, south, east, north)})
            return written(N.parse_elements(told, "body"))  # nodes and roads are looked up in it several times, the text is parsed once
        return read_geo(spark, s.layer, catalogs[s.endpoint], resolve, s.endpoint, code=place["code"] if s.cut == "code" else "all")

    return fetch


def run_diagnostic(
    spark: SparkSession, ids: Iterable[str], code_muni: int, store: LayerStore, fetch: Callable[[Source, dict], DataFrame], ring: Callable[[], G.Ring | overlay.Parts | None], name_muni: str = "", force: bool = False, ring_crs: str | int = crs.DEFAULT
) -> DataFrame:
    """Load every source that is not there yet; (source_id, status, message) of each.

    ``fetch`` gives a source's rows for {code, name, uf}; ``ring`` the municipality's outline (a ring, or parts
    with holes as ``municipalities.outline`` gives them) in the system ``ring_crs``, asked for once. A source that fails stops no other.
    """
    have, rows, outline, missing = store.layers(), [], [], []
    place = {"code": int(code_muni), "name": name_muni, "uf": normalize_uf_value(code_muni)[1]}

    def polygon():
        """The outline, or None; why there is none is told in ``missing``."""
        if not outline:
            try:
                outline.append(ring())
                missing.append("no_polygon")
            except Exception as e:  # noqa: BLE001  asked for once; told in the report
                outline.append(None)
                missing.append(f"no_polygon: {e}")
        return outline[0]

    def one(s: Source) -> tuple[str, str | None]:
        if s.protocol == "basemap":
            return "skipped", "basemap"
        if s.protocol not in PROTOCOLS:
            return "skipped", "unsupported"
        names = [f"osm_links_{code_muni}", f"osm_nodes_{code_muni}"] if s.protocol == "osm" else [f"{s.id}_{code_muni}"]
        if not force and set(names) <= have:
            return "skipped", "exists"
        try:
            layer = fetch(s, place)
        except Exception as e:  # noqa: BLE001  told in the report
            return "failed", f"fetch_error: {e}"
        told = store.stale.get(f"{s.id}_{code_muni}")
        if s.clipped and polygon() is None:
            return "failed", missing[0]
        try:
            if s.protocol == "osm":
                links, nodes = N.build_network(layer, crs.project_outline(polygon(), ring_crs, crs.DEFAULT))
                if links.isEmpty():
                    return "skipped", "empty"
                outs = [links, nodes]
            else:
                if layer.isEmpty():
                    return "skipped", "empty"
                if s.cut == "name" and polygon() is not None:
                    layer = near_outline(layer, polygon(), ring_crs)
                outs = [clip_layer(layer, polygon(), ring_crs) if s.clipped else layer]
        except Exception as e:  # noqa: BLE001
            return "failed", f"clip_error: {e}"
        try:
            for name, out in zip(names, outs, strict=True):
                store.write(name, stamped(out, s))
        except Exception as e:  # noqa: BLE001
            return "failed", f"write_error: {e}"
        if store.read(names[0]).isEmpty():
            return "skipped", "empty_after_clip"
        return "ok", f"older_answers: {told}" if told else None

    for s in by_id(ids):
        rows.append((s.id, *one(s)))
    return spark.createDataFrame(rows, REPORT)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is wanted and not there yet, by a key."""
    return wanted.join(done.select(key), key, "left_anti")


def run_summary(report: DataFrame) -> DataFrame:
    """(status, n, ids): how many sources came to each status, and which."""
    return report.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("ids"))
