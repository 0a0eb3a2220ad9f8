"""DXF drawings: tagged text files as rows, entity by entity.

A drawing is read whole by one task (entities span lines), so a corpus of drawings is what runs in parallel. What can't be read is a row with ``corrupt``, and the
records after it are read like any others.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Encodings that are tried in this order.
ENCODINGS = ("utf-8", "gbk", "cp936", "gb18030", "latin1")
#: The same for drawings that are to be rasterised.
RASTER_ENCODINGS = ("gbk", "utf-8", "gb18030", "latin1")
#: What becomes of records that can't be read: rows with ``corrupt``, nothing, an error.
MODES = ("permissive", "dropmalformed", "failfast")

ENTITY = "file_id string, section string, block string, entity_id long, type string, layer string, handle string, text string, name string, points array<struct<x:double,y:double>>, radius double, start_angle double, end_angle double, x_scale double, y_scale double, rotation double, closed boolean, attributes map<string,string>, corrupt string"
_COLUMNS = [c.split()[0] for c in ENTITY.replace("struct<x:double,y:double>", "p").replace("map<string,string>", "m").split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "m": pa.map_(pa.string(), pa.string()), "array<p>": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ENTITY.replace("struct<x:double,y:double>", "p").replace("map<string,string>", "m").split(", ")])
#: Bytes that are decoded at once.
PIECE = 1 << 20
#: Codes that hold a number in every kind of record.
_NUMBERS = {10, 11, 20, 21, 40, 41, 42, 50, 51}


def decode(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    for e in encodings:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode("latin1")


_CODE = re.compile(r"\s*-?\d{1,4}\s*")
_KIND = re.compile(r"[A-Z][A-Z0-9_]*")


def encoding_of(data: bytes | memoryview, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first of ``encodings`` that ``decode`` would use; the text is looked at piece by piece."""
    for e in encodings:
        try:
            for _ in _pieces(data, e):
                pass
            return e
        except UnicodeDecodeError:
            continue
    return "latin1"


def _pieces(data: bytes | memoryview, encoding: str) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(encoding)()
    for at in range(0, len(data), PIECE):
        yield decoder.decode(bytes(data[at : at + PIECE]))
    yield decoder.decode(b"", True)


def lines_of(data: bytes | memoryview, encodings: tuple[str, ...] = ENCODINGS) -> Iterator[str]:
    """Lines of a drawing, which end in a line feed, with or without a carriage return, and in nothing else. No more than a piece of the text is held."""
    held: list[str] = []
    for piece in _pieces(data, encoding_of(data, encodings)):
        first, *more = piece.split("\n")
        held.append(first)
        for line in more:
            yield "".join(held).removesuffix("\r")
            held = [line]
    yield "".join(held)


def tags(lines: Iterator[str]) -> Iterator[tuple[int | None, str]]:
    """(group code, value) pairs.

    Where a code should stand and doesn't, the pair (None, line) tells so once, and reading goes on at the next line 0 that a kind of record follows.
    """
    here, then = next(lines, None), next(lines, None)
    while then is not None:
        if _CODE.fullmatch(here):
            yield int(here), then.strip()
            here, then = next(lines, None), next(lines, None)
            continue
        yield None, here.strip()[:200]
        here, then = then, next(lines, None)
        while then is not None and not (here.strip() == "0" and _KIND.fullmatch(then.strip())):
            here, then = then, next(lines, None)


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def records(lines: Iterator[str]) -> Iterator[tuple[str, str | None, str | None, list[tuple[int, str]]]]:
    """(section, block, type, tags) of every record of the file; of the header's variables each is a record VARIABLE. Type None: a line that can't be read."""
    section, block, kind, own, waits = "", None, None, [], False
    for code, value in chain(tags(lines), [(0, "EOF")]):
        if code is None:
            if value:
                yield section, block, None, [(0, value)]
        elif code == 0 or (code == 9 and section == "HEADER"):
            if kind == "BLOCK":
                block = next((v for c, v in own if c == 2), None)
            if kind and kind not in ("SECTION", "ENDSEC", "EOF"):
                yield section, block, kind, own
            if kind == "ENDBLK":
                block = None
            kind, own, waits = (value, [], value == "SECTION") if code == 0 else ("VARIABLE", [(2, value)], False)
            if code == 0 and value == "ENDSEC":
                section = ""
        elif waits and code == 2:
            section, waits = value, False
        else:
            own.append((code, value))


def _row(file_id: str, i: int, section: str, block: str | None, kind: str | None, own: list[tuple[int, str]]) -> dict:
    wrong = None if kind in ("VARIABLE",) or section != "ENTITIES" else next((f"{c}: {v}" for c, v in own if c in _NUMBERS and _number(v) is None), None)
    if kind is None or wrong:
        return {**dict.fromkeys(_COLUMNS), "file_id": file_id, "section": section, "block": block, "entity_id": i, "type": kind, "points": [], "attributes": {}, "corrupt": wrong or own[0][1]}
    first = {}
    for c, v in own:
        first.setdefault(c, v)
    xs = [_number(v) for c, v in own if c in (10, 11)]
    ys = [_number(v) for c, v in own if c in (20, 21)]
    number = lambda c: _number(first[c]) if c in first else None
    text = "".join(v for c, v in own if c == 3) + first.get(1, "") if kind in ("TEXT", "MTEXT", "ATTRIB", "ATTDEF", "DIMENSION") else None
    return {
        "file_id": file_id, "section": section, "block": block, "entity_id": i, "type": kind, "layer": first.get(8), "handle": first.get(5), "text": text, "name": first.get(2),
        "points": [{"x": x, "y": y} for x, y in zip(xs, ys, strict=False) if x is not None and y is not None], "radius": number(40) if kind in ("CIRCLE", "ARC", "TEXT", "MTEXT") else None,
        "start_angle": number(50) if kind == "ARC" else None, "end_angle": number(51) if kind == "ARC" else None, "x_scale": number(41) if kind == "INSERT" else None, "y_scale": number(42) if kind == "INSERT" else None,
        "rotation": number(50) if kind in ("INSERT", "TEXT", "MTEXT") else None, "closed": bool(int(number(70) or 0) & 1) if kind in ("LWPOLYLINE", "POLYLINE") else None,
        "attributes": {str(c): v for c, v in first.items() if section in ("HEADER", "TABLES") or c not in (5, 8, 1, 2, 3, 10, 20, 11, 21)}, "corrupt": None,
    }


def rows_of(file_id: str, data: bytes | memoryview, encodings: tuple[str, ...], mode: str) -> Iterator[dict]:
    for i, r in enumerate(records(lines_of(data, encodings))):
        row = _row(file_id, i, *r)
        if row["corrupt"] is not None:
            if mode == "failfast":
                raise ValueError(f"record {i} of drawing {file_id} can't be read: {row['corrupt']}")
            if mode == "dropmalformed":
                continue
        yield row


def _mode(mode: str) -> str:
    if mode.lower() not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    return mode.lower()


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DxfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mode = _mode(options.get("mode", "permissive"))
        self.encodings = tuple(e.strip() for e in options["encodings"].split(",")) if "encodings" in options else ENCODINGS
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[Files]:
        """Files in the order of their names, as many to a partition as its bytes hold, one at least."""
        if os.path.isfile(self.path):
            return [Files([self.path])]
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".dxf"))
        out: list[Files] = []
        size = self.bytes
        for p in found:
            own = os.path.getsize(p)
            if size + own > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(p)
            size += own
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            with open(p, "rb") as f:
                data = f.read()
            for r in rows_of(hashlib.sha256(data).hexdigest(), data, self.encodings, self.mode):
                yield tuple([(q["x"], q["y"]) for q in r[c]] if c == "points" else r[c] for c in _COLUMNS)


class DxfSource(DataSource):
    """``spark.read.format("dxf")``: the drawings of a folder that every executor can open, a partition for some files.

    Options: path; mode (permissive, dropmalformed, failfast); encodings (a list with commas, tried in this order); partitionBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return ENTITY

    def reader(self, schema: object) -> DxfReader:
        return DxfReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``dxf`` known to the session."""
    spark.dataSource.register(DxfSource)


def read_dxf(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS, mode: str = "permissive") -> DataFrame:
    """Every record of the drawings under ``path``, which only Spark has to be able to open."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][xX][fF]").option("recursiveFileLookup", "true").load(path)
    return parse_drawings(files, encodings, mode)


def parse_drawings(files: DataFrame, encodings: tuple[str, ...] = ENCODINGS, mode: str = "permissive") -> DataFrame:
    """Every record of drawings in a binary column ``content``; file_id is the SHA-256 of the bytes. A null content has no records."""
    mode = _mode(mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, data in zip(b.column(0), b.column(1), strict=True):
                # the bytes stay where Arrow has them, and rows go as soon as there are enough for a batch
                rows = []
                for r in rows_of(file_id.as_py(), memoryview(data.as_buffer()), encodings, mode):
                    rows.append({**r, "attributes": list(r["attributes"].items())})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.where("content is not null").select(F.sha2("content", 256).alias("file_id"), "content").mapInArrow(run, ENTITY)


def entities(records_: DataFrame) -> DataFrame:
    """Of the model space, those that could be read."""
    return records_.where("section = 'ENTITIES' and corrupt is null")


def corrupt(records_: DataFrame) -> DataFrame:
    """(file_id, section, entity_id, type, corrupt) of what couldn't be read."""
    return records_.where("corrupt is not null").select("file_id", "section", "entity_id", "type", "corrupt")


def header(records_: DataFrame) -> DataFrame:
    """(file_id, variable, value): the header's variables; the values of a point are joined by commas."""
    v = records_.where("section = 'HEADER' and type = 'VARIABLE'")
    values = F.transform(F.array_sort(F.filter(F.map_entries("attributes"), lambda e: e["key"] != "2")), lambda e: e["value"])
    return v.select("file_id", F.col("name").alias("variable"), F.array_join(values, ",").alias("value"))


def linetypes(records_: DataFrame) -> DataFrame:
    t = records_.where("section = 'TABLES' and type = 'LTYPE' and name is not null")
    return t.select("file_id", "name", F.col("attributes")["3"].alias("description"))


def styles(records_: DataFrame) -> DataFrame:
    t = records_.where("section = 'TABLES' and type = 'STYLE' and name is not null")
    return t.select("file_id", "name", F.expr("try_cast(attributes['40'] as double)").alias("height"))


def dimstyles(records_: DataFrame) -> DataFrame:
    return records_.where("section = 'TABLES' and type = 'DIMSTYLE' and name is not null").select("file_id", "name")


def block_names(records_: DataFrame) -> DataFrame:
    return records_.where("section = 'BLOCKS' and type = 'BLOCK' and name is not null").select("file_id", "name")


#: kind -> section, type, and the code of what describes it.
NAMED = {"block": ("BLOCKS", "BLOCK", None), "dimstyle": ("TABLES", "DIMSTYLE", None), "linetype": ("TABLES", "LTYPE", "3"), "style": ("TABLES", "STYLE", "40")}


def all_named(records_: DataFrame) -> DataFrame:
    """(file_id, kind, name, detail): what ``block_names``, ``dimstyles``, ``linetypes`` and ``styles`` give, by reading the drawings once; detail is the description or the height."""
    kind, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (section, type_, code) in NAMED.items():
        own = (F.col("section") == section) & (F.col("type") == type_)
        kind = F.when(own, k).otherwise(kind)
        if code:
            found = F.col("attributes")[code]
            detail = F.when(own, found.try_cast("double").cast("string") if k == "style" else found).otherwise(detail)
    return records_.where("name is not null").select("file_id", kind.alias("kind"), "name", detail.alias("detail")).where("kind is not null")


def layers(records_: DataFrame) -> DataFrame:
    """name, color, linetype, is_frozen, is_locked, is_off; a negative colour is off."""
    t = records_.where("section = 'TABLES' and type = 'LAYER'")
    flags, color = F.expr("try_cast(attributes['70'] as int)"), F.expr("try_cast(attributes['62'] as int)")
    flags = F.coalesce(flags, F.lit(0))
    return t.select("file_id", "name", F.abs(color).alias("color"), F.col("attributes")["6"].alias("linetype"), flags.bitwiseAND(1).cast("boolean").alias("is_frozen"), flags.bitwiseAND(4).cast("boolean").alias("is_locked"), (F.coalesce(color, F.lit(0)) < 0).alias("is_off"))


def named_tables(records_: DataFrame, kind: str) -> DataFrame:
    """Names of block, linetype (LTYPE), text style (STYLE) or dimension style (DIMSTYLE) records."""
    return records_.where(F.col("type") == kind).select("file_id", "name", "attributes").where("name is not null")


def lines(records_: DataFrame, least: float = 0.1) -> DataFrame:
    """(file_id, entity_id, layer, x1, y1, x2, y2) of LINE, LWPOLYLINE, CIRCLE and ARC entities longer than ``least``."""
    from planwright.functions import geometry as G

    e = entities(records_).where(F.col("type").isin("LINE", "LWPOLYLINE", "CIRCLE", "ARC")).where(F.size("points") > 0)
    centre = F.col("points")[0]
    arc = G.arc_points(centre["x"], centre["y"], F.col("radius"), F.coalesce("start_angle", F.lit(0.0)), F.coalesce("end_angle", F.lit(360.0)))
    path = F.when(F.col("type").isin("CIRCLE", "ARC"), arc).when(F.col("closed"), F.array_append("points", centre)).otherwise(F.col("points"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("p"), F.element_at("path", i + 1).alias("q")))
    s = e.withColumn("path", path).where(F.size("path") > 1).select("file_id", "entity_id", "layer", F.explode(pairs).alias("s"))
    out = s.select("file_id", "entity_id", "layer", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))
    return out.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > least)
