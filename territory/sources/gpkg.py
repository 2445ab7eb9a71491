"""GeoPackage layers: SQLite files, geometry as WKB.

The data source ``gpkg`` reads a file of a folder that the executors share, dealt by ranges of row ids. With the option
``boxes`` each row has its box beside it, and filters on the box go to the file's R-tree where it has one, so that rows are
dealt, and read, inside the box alone. ``read_gpkg_files`` reads files of any store that Spark reads, a file a task, through
their bytes.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from territory.functions.wkb import gpkg_to_wkb, read_rings, wkb_to_gpkg

ROWS_A_PARTITION = 100_000
#: The columns of a row's box, and of those of the R-tree what a filter on each may ask: its boxes are no smaller than the rows'.
BOX = ("xmin", "ymin", "xmax", "ymax")
_TREE = {"xmin": ("minx", "<"), "ymin": ("miny", "<"), "xmax": ("maxx", ">"), "ymax": ("maxy", ">")}
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _opened(blob: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(blob)
    return db


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str) -> DataType:
    d = declared.upper()
    if d.startswith("BOOL"):
        return BooleanType()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


def _layer(db: sqlite3.Connection, want: str | None) -> tuple[str, str | None]:
    """(table, geometry column) of a layer, by default the first."""
    found = db.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c LEFT JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type IN ('features', 'attributes') ORDER BY c.rowid").fetchall()
    for name, geom in found:
        if want in (None, name):
            return name, geom
    raise ValueError(f"no layer {want!r}; there are {[n for n, _ in found]}")


def _schema(db: sqlite3.Connection, table: str, geom: str | None) -> StructType:
    cols = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    return StructType([StructField("geometry" if c[1] == geom else c[1], BinaryType() if c[1] == geom else _type(c[2])) for c in cols])


def _rows(db: sqlite3.Connection, table: str, geom: str | None, kinds: StructType, where: str = "", values: tuple = ()) -> Iterator[tuple]:
    cols = [f.name for f in kinds.fields]
    boxed = cols[-4:] == list(BOX) and geom is not None and not {*BOX} & {c[1] for c in db.execute(f"PRAGMA table_info({_quoted(table)})")}
    cols = cols[:-4] if boxed else cols
    at = cols.index("geometry") if "geometry" in cols else -1
    names = ", ".join(_quoted(geom if c == "geometry" and geom else c) for c in cols)
    flags = [isinstance(f.dataType, BooleanType) for f in kinds.fields]
    floats = [isinstance(f.dataType, DoubleType) for f in kinds.fields]
    for row in db.execute(f"SELECT {names} FROM {_quoted(table)}{where}", values):
        out = tuple(gpkg_to_wkb(v) if i == at else None if v is None else bool(v) if flags[i] else float(v) if floats[i] else v for i, v in enumerate(row))
        yield (*out, *_box(out[at])) if boxed else out


def _box(b: bytes | None) -> tuple[float | None, ...]:
    """xmin, ymin, xmax, ymax; nulls for null or empty geometries."""
    g = read_rings(b)
    rings = [r for p in g[1] for r in p if len(r)] if g else []
    if not rings:
        return None, None, None, None
    return (*map(float, np.min([r.min(axis=0) for r in rings], axis=0)), *map(float, np.max([r.max(axis=0) for r in rings], axis=0)))


def decode_files(files: DataFrame, content: str = "content", layer: str | None = None, schema: StructType | None = None) -> DataFrame:
    """The layer's rows of every file, a row of ``files`` holding one file's bytes; all files have one schema, by default that
    of a first one."""
    blobs = files.select(F.col(f"`{content}`")).where(F.col(f"`{content}`").isNotNull())
    if schema is None:
        one = blobs.limit(1).first()
        if one is None:
            raise ValueError("no file to take the schema from")
        db = _opened(bytes(one[0]))
        schema = _schema(db, *_layer(db, layer))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                db = _opened(blob.as_py())
                rows = _rows(db, *_layer(db, layer), schema)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return blobs.mapInArrow(run, schema)


def read_gpkg_files(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer of the file or files at a path of any store."""
    return decode_files(spark.read.format("binaryFile").load(path), layer=layer)


def encode_layers(layers: dict[str, tuple[Iterable[tuple], StructType]], srs: int = 4674) -> bytes:
    """The bytes of a GeoPackage of layers given as rows and schema; the column ``geometry``, if there is one, holds WKB."""
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT);")
    kinds = {LongType: "INTEGER", IntegerType: "INTEGER", DoubleType: "REAL", BooleanType: "BOOLEAN", BinaryType: "BLOB"}
    for layer, (rows, schema) in layers.items():
        names = schema.fieldNames()
        at = names.index("geometry") if "geometry" in names else -1
        cols = ", ".join(f"{_quoted('geom' if i == at else f.name)} {kinds.get(type(f.dataType), 'TEXT')}" for i, f in enumerate(schema.fields))
        db.execute(f"CREATE TABLE {_quoted(layer)} ({cols})")
        db.execute("INSERT INTO gpkg_contents VALUES (?, ?)", (layer, "features" if at >= 0 else "attributes"))
        if at >= 0:
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (layer,))
        plain = [type(f.dataType) in kinds for f in schema.fields]
        value = lambda i, v: None if v is None else wkb_to_gpkg(bytes(v), srs) if i == at else v if plain[i] else str(v)  # noqa: E731, B023
        db.executemany(f"INSERT INTO {_quoted(layer)} VALUES ({', '.join('?' * len(names))})", (tuple(value(i, v) for i, v in enumerate(r)) for r in rows))
    db.commit()
    return db.serialize()


def encode_file(rows: list[tuple], schema: StructType, layer: str, srs: int = 4674) -> bytes:
    """The bytes of a GeoPackage with one layer."""
    return encode_layers({layer: (rows, schema)}, srs)


def with_suffix(path: str) -> str:
    """The path with ``.gpkg`` at its end, in any case."""
    return path if path.lower().endswith(".gpkg") else f"{path}.gpkg"


def write_gpkg(layers: dict[str, DataFrame], path: str, most_rows: int = 1_000_000) -> str:
    """Write layers into one GeoPackage file of any store, for other programs; the path that was written.

    One file is made by one writer, the driver, so this is for the layers of a municipality: more than ``most_rows`` rows
    raise before anything is sent.
    """
    path = with_suffix(path)
    for name, layer in layers.items():
        if (n := layer.limit(most_rows + 1).count()) > most_rows:
            raise ValueError(f"layer {name!r} has more than {most_rows} rows ({n} seen); keep it in the layer store")
    data = encode_layers({name: (map(tuple, layer.toLocalIterator()), layer.schema) for name, layer in layers.items()})
    spark = next(iter(layers.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    for lo in range(0, len(data), 1 << 22):
        out.write(bytearray(data[lo : lo + (1 << 22)]))
    out.close()
    return path


class Rows(InputPartition):
    def __init__(self, low: int, high: int, where: str, values: tuple) -> None:
        super().__init__((low, high))
        self.low, self.high, self.where, self.values = low, high, where, values


class GeoPackage(DataSource):
    """Options path, layer (default: the first feature table) and boxes (true: with the columns of ``BOX``)."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def layer(self) -> tuple[str, str | None]:
        with _connect(self.options["path"]) as db:
            return _layer(db, self.options.get("layer"))

    def schema(self) -> StructType:
        with _connect(self.options["path"]) as db:
            table, geom = _layer(db, self.options.get("layer"))
            kinds = _schema(db, table, geom)
        if self.options.get("boxes", "false").lower() != "true" or geom is None:
            return kinds
        if taken := {*BOX} & {*kinds.names}:
            raise ValueError(f"the layer has columns of its own called {sorted(taken)}")
        return StructType([*kinds.fields, *(StructField(c, DoubleType()) for c in BOX)])

    def reader(self, schema: StructType) -> GeoPackageReader:
        return GeoPackageReader(self.options["path"], *self.layer(), schema)


class GeoPackageReader(DataSourceReader):
    """Comparisons of columns go to SQLite, where an index may serve them, and those of the box to the layer's R-tree; Spark
    checks them all again."""

    def __init__(self, path: str, table: str, geom: str | None, schema: StructType) -> None:
        self.path, self.table, self.geom, self.kinds, self.where, self.values = path, table, geom, schema, [], []
        with _connect(path) as db:
            self.own = {c[1] for c in db.execute(f"PRAGMA table_info({_quoted(table)})")}
            tree = f"rtree_{table}_{geom}"
            self.tree = tree if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (tree,)).fetchone() else None
        self.inside: list[str] = []
        self.limits: list[float] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            sign = _COMPARE.get(type(f))
            if sign and len(f.attribute) == 1:
                name, number = f.attribute[0], isinstance(f.value, int | float) and not isinstance(f.value, bool)
                if name in self.own and name != self.geom and (number or sign == "=" and isinstance(f.value, int | str)):
                    self.where.append(f"{_quoted(name)} {sign} ?")
                    self.values.append(f.value)
                elif name in _TREE and name not in self.own and number and self.tree and sign[0] == _TREE[name][1]:
                    self.inside.append(f"{_TREE[name][0]} {sign} ?")
                    self.limits.append(float(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids with ROWS_A_PARTITION rows each of those that the R-tree leaves, however far apart the ids lie."""
        tree = f" WHERE rowid IN (SELECT id FROM {_quoted(self.tree)} WHERE {' AND '.join(self.inside)})" if self.inside else ""
        with _connect(self.path) as db:
            ids = f"SELECT rowid AS r, row_number() OVER (ORDER BY rowid) AS n FROM {_quoted(self.table)}{tree}"
            starts = [r for (r,) in db.execute(f"SELECT r FROM ({ids}) WHERE (n - 1) % ? = 0 ORDER BY r", (*self.limits, ROWS_A_PARTITION))]
            (high,) = db.execute(f"SELECT max(rowid) FROM {_quoted(self.table)}{tree}", self.limits).fetchone()
        if not starts:
            return [Rows(0, -1, "", ())]
        where = "".join(f" AND {w}" for w in [*self.where, *([tree.removeprefix(" WHERE ")] if tree else [])])
        return [Rows(a, b - 1, where, (*self.values, *self.limits)) for a, b in zip(starts, [*starts[1:], high + 1], strict=True)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with _connect(self.path) as db:
            yield from _rows(db, self.table, self.geom, self.kinds, f" WHERE rowid BETWEEN ? AND ?{partition.where}", (partition.low, partition.high, *partition.values))
