"""SRC-15, SRC-21, SNK-05: workbooks as a data source of Spark's, read and written.

``spark.read.format("workbook").load(path)`` gives one row for each row of a sheet that has a cell: ``path``,
``sheet``, ``sheet_index``, ``row`` (from 0), ``cells`` (``col``, ``kind``, ``value``; only those that hold something)
and ``error``.  Kinds are ``s`` (text), ``n`` (number), ``b`` (truth), ``d`` (date or time, as ISO text) and ``e`` (an
error value).  Large files are read in one partition a sheet, small ones several in one partition; a partition streams
through its sheets' XML and holds no more than a workbook's shared strings and styles and some rows.  A file or sheet
that can't be read is a row with ``error``.

``write`` makes one workbook for each value of ``workbook``.  Tasks write below a staging folder of the job's own;
only the job's end moves whole files to their place, so a task that dies or runs twice leaves nothing.
"""

from __future__ import annotations

import datetime
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridgauge.functions import dates

SCHEMA = "path string, sheet string, sheet_index int, row int, cells array<struct<col:int,kind:string,value:string>>, error string"
#: Bytes of a file from which on each sheet is a partition of its own; bytes of smaller files in one partition, about; rows of a batch.
LARGE, TOGETHER, ROWS = 4 << 20, 4 << 20, 2048

# Number formats of dates and times that need no format code.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
ENDINGS = (".xlsx", ".xlsm")


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pa.fs.LocalFileSystem(), path)


def is_date_format(code: str) -> bool:
    """Whether a format code shows a date or a time: a day, month, year, hour or second outside quotes, colours and conditions."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0], flags=re.I)
    return bool(re.search(r"[dmyhs]", re.sub(r"general", "", bare, flags=re.I), re.I))


def from_serial(value: float, since_1904: bool = False) -> str:
    """A serial number as ISO text.

    The system of 1900 counts a 29th of February 1900 that never was: numbers below 60 are a day later than the others suggest,
    and 60 itself is the 28th.  Numbers between 0 and 1 are times without a day.
    """
    micros = round(value * 86_400_000) * 1000
    if 0 <= value < 1:
        at = datetime.datetime(1900, 1, 1) + datetime.timedelta(microseconds=micros)
        return at.time().isoformat("milliseconds" if at.microsecond else "seconds") if at.day == 1 else "00:00:00"
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 31 if value < 60 else 30)
    at = start + datetime.timedelta(microseconds=micros)
    if at.time() == datetime.time():
        return at.date().isoformat()
    return at.isoformat(" ", "milliseconds" if at.microsecond else "seconds")


def to_serial(text: str) -> int:
    """The serial number (1900) of an ISO date."""
    n = (datetime.date.fromisoformat(text) - datetime.date(1899, 12, 30)).days
    return n if n > 60 else n - 1


def column_of(name: str) -> int:
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_name(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(z: zipfile.ZipFile, name: str, wanted: frozenset[str]) -> Iterator[ElementTree.Element]:
    """The elements of a part by name, each forgotten once the next is asked for."""
    with z.open(name) as f:
        root = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = e
            if event == "end" and bare(e.tag) in wanted:
                yield e
                e.clear()
                if bare(e.tag) in ("row", "si"):
                    root.clear()
                    for child in list(root):
                        child.clear()


def text_in(e: ElementTree.Element) -> str:
    """All text of a string, without its reading aids."""
    if bare(e.tag) == "rPh":
        return ""
    return (e.text or "" if bare(e.tag) == "t" else "") + "".join(map(text_in, e))


class Workbook:
    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.sheets: list[tuple[str, str]] = []
        self.since_1904, self._strings, self._dates = False, None, None
        targets = {}
        for e in elements(self.zip, "xl/_rels/workbook.xml.rels", frozenset(["Relationship"])):
            targets[e.get("Id")] = posixpath.normpath(posixpath.join("xl", e.get("Target"))) if not e.get("Target").startswith("/") else e.get("Target")[1:]
        for e in elements(self.zip, "xl/workbook.xml", frozenset(["sheet", "workbookPr"])):
            if bare(e.tag) == "workbookPr":
                self.since_1904 = (e.get("date1904") or "0").lower() in ("1", "true")
            else:
                key = next((v for k, v in e.attrib.items() if bare(k) == "id"), None)
                self.sheets.append((e.get("name"), targets.get(key, "")))

    def strings(self) -> list[str]:
        if self._strings is None:
            name = "xl/sharedStrings.xml"
            self._strings = [text_in(e) for e in elements(self.zip, name, frozenset(["si"]))] if name in self.zip.namelist() else []
        return self._strings

    def date_styles(self) -> list[bool]:
        """For each cell format whether it shows a date or a time."""
        if self._dates is None:
            own, self._dates, name = {}, [], "xl/styles.xml"
            if name in self.zip.namelist():
                for e in elements(self.zip, name, frozenset(["numFmt", "cellXfs"])):
                    if bare(e.tag) == "numFmt":
                        own[int(e.get("numFmtId"))] = is_date_format(e.get("formatCode") or "")
                    else:
                        ids = [int(x.get("numFmtId") or 0) for x in e]
                        self._dates = [own.get(i, i in DATE_FORMATS) for i in ids]
        return self._dates

    def rows(self, k: int) -> Iterator[tuple[int, list[tuple[int, str, str]]]]:
        """(row, cells) of sheet ``k``; places that the file leaves out follow from those before."""
        at = -1
        for e in elements(self.zip, self.sheets[k][1], frozenset(["row"])):
            at = int(e.get("r")) - 1 if e.get("r") else at + 1
            cells, col = [], -1
            for c in e:
                name = c.get("r")
                col = column_of(re.match("[A-Z]+", name)[0]) if name else col + 1
                if (got := self.value(c)) is not None:
                    cells.append((col, *got))
            if cells:
                yield at, cells

    def value(self, c: ElementTree.Element) -> tuple[str, str] | None:
        kind, v, inline = c.get("t") or "n", None, None
        for x in c:
            if bare(x.tag) == "v":
                v = x.text
            elif bare(x.tag) == "is":
                inline = text_in(x)
        if kind == "inlineStr":
            return ("s", inline) if inline else None
        if not v:
            return None
        if kind == "s":
            return ("s", said) if (said := self.strings()[int(v)]) else None
        if kind == "n":
            style = int(c.get("s") or 0)
            if style < len(self.date_styles()) and self.date_styles()[style]:
                return ("d", from_serial(float(v), self.since_1904))
            return ("n", v)
        if kind == "d":
            return ("d", v.replace("T", " ").removesuffix("Z"))
        return {"b": ("b", "true" if v in ("1", "true") else "false"), "e": ("e", v)}.get(kind, ("s", v))


@dataclass
class Part(InputPartition):
    """Files of a partition, each with one of its sheets or (None) all."""

    files: list[tuple[str, int | None]]

    def __post_init__(self):
        super().__init__(self.files)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.sheets = options["path"], int(options.get("sheets", 1 << 30))

    def partitions(self) -> list[Part]:
        """Only large files are looked into here."""
        fs, base = place(self.path)
        info = fs.get_file_info(base)
        found = [info] if info.type == pa.fs.FileType.File else sorted(fs.get_file_info(pa.fs.FileSelector(base, recursive=True)), key=lambda x: x.path)
        found = [x for x in found if x.type == pa.fs.FileType.File and x.path.lower().endswith(ENDINGS) and not re.search(r"/[._][^/]*(/|\Z)", x.path[len(base) :])]
        out, held, size = [], [], 0
        for x in found:
            if x.size >= LARGE:
                try:
                    with fs.open_input_file(x.path) as f:
                        out += [Part([(x.path, k)]) for k in range(min(len(Workbook(f).sheets), self.sheets))]
                    continue
                except Exception:  # noqa: BLE001, the partition says what is wrong
                    pass
            held.append((x.path, None))
            size += x.size
            if size >= TOGETHER:
                out.append(Part(held))
                held, size = [], 0
        return out + ([Part(held)] if held or not out else [])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = place(self.path)
        cell = pa.struct([("col", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(cell), pa.string()]
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = zip(*held)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "sheet", "sheet_index", "row", "cells", "error"])
            held.clear()
            return batch

        for path, only in partition.files:
            try:
                with fs.open_input_file(path) as f:
                    book = Workbook(f)
                    for k, (name, _) in enumerate(book.sheets[: self.sheets]):
                        if only not in (None, k):
                            continue
                        try:
                            for row, cells in book.rows(k):
                                held.append((path, name, k, row, [dict(zip(("col", "kind", "value"), c)) for c in cells], None))
                                if len(held) >= ROWS:
                                    yield flush()
                        except Exception as e:  # noqa: BLE001
                            held.append((path, name, k, None, None, f"{type(e).__name__}: {e}"))
            except Exception as e:  # noqa: BLE001
                held.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
        if held:
            yield flush()


@dataclass
class Done(WriterCommitMessage):
    files: list[tuple[str, str]]


PARTS = {
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML can't hold.
UNFIT = re.compile("[^\\t\\n\\r\\u0020-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


class Book:
    """A workbook in the making; sheets and rows come in order, nothing is held."""

    def __init__(self, stream):
        self.stream, self.zip = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.sheets: list[str] = []
        self.sheet = None

    def start(self, name: str) -> None:
        self.end()
        self.sheets.append(name)
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
        self.sheet.write((HEAD + '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>').encode())

    def row(self, at: int, cells) -> None:
        out = [f'<row r="{at + 1}">']
        for k, c in enumerate(cells or ()):
            if c is None or c["value"] is None:
                continue
            ref, kind, value = f"{column_name(k)}{at + 1}", c["kind"], c["value"]
            if kind == "d":
                out.append(f'<c r="{ref}" s="1"><v>{to_serial(value)}</v></c>')
            elif kind in ("n", "b"):
                out.append(f'<c r="{ref}" t="{kind}"><v>{escape({"true": "1", "false": "0"}.get(value, value))}</v></c>')
            else:
                out.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(UNFIT.sub("", value)).replace(chr(13), "&#13;")}</t></is></c>')
        self.sheet.write("".join([*out, "</row>"]).encode())

    def end(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        if not self.sheets:
            self.start("Table_1")
        self.end()
        n = range(1, len(self.sheets) + 1)
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        sheets = "".join(f'<sheet name={quoteattr(UNFIT.sub("", s))} sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, self.sheets))
        parts = PARTS | {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + f'<Relationship Id="rId{n[-1] + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n) + "</Types>",
        }
        for name, text in parts.items():
            self.zip.writestr(name, HEAD + text)
        self.zip.close()
        self.stream.close()


class Writer(DataSourceWriter):
    """Rows of a task come sorted by workbook, sheet and row."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        _, base = place(self.path)
        self.base, self.staging = base.rstrip("/"), f"{base.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Done:
        fs, _ = place(self.path)
        folder, files, book, at = f"{self.staging}/{uuid.uuid4().hex}", [], None, (None, None)
        for r in iterator:
            if at[0] != r["workbook"] or book is None:
                if book:
                    book.close()
                name = re.sub(r"[^\w.-]", "_", r["workbook"] or "null") + ".xlsx"
                fs.create_dir(folder, recursive=True)
                files.append((f"{folder}/{len(files)}", f"{self.base}/{name}"))
                book, at = Book(fs.open_output_stream(files[-1][0])), (r["workbook"], None)
            if at[1] != r["sheet"] or not book.sheets:
                if r["sheet"] in book.sheets:
                    raise ValueError(f"rows of sheet {r['sheet']} aren't together")
                book.start(r["sheet"] or "")
                at = (at[0], r["sheet"])
            book.row(r["row"], r["cells"])
        if book:
            book.close()
        return Done(files)

    def commit(self, messages) -> None:
        fs, _ = place(self.path)
        moves = [move for m in messages if m for move in m.files]
        ends = [end for _, end in moves]
        if len(set(ends)) < len(ends):
            self.abort(messages)
            raise ValueError("two tasks or names made one workbook")
        fs.create_dir(self.base, recursive=True)
        for start, end in moves:
            fs.move(start, end)
        if self.overwrite:
            for x in fs.get_file_info(pa.fs.FileSelector(self.base)):
                if x.path.lower().endswith(ENDINGS) and x.path not in ends:
                    fs.delete_file(x.path)
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, _ = place(self.path)
        if fs.get_file_info(self.staging).type == pa.fs.FileType.Directory:
            fs.delete_dir(self.staging)


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, sheets: int | None = None) -> DataFrame:
    """SRC-15: rows of all workbooks below ``path``, of the first ``sheets`` sheets of each if given."""
    spark.dataSource.register(Source)
    got = spark.read.format("workbook")
    return (got if sheets is None else got.option("sheets", str(sheets))).load(path)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-05: columns ``workbook``, ``sheet``, ``sheet_index``, ``row`` and ``cells`` (structs of ``kind`` and ``value``; null: empty) as workbooks.

    Sheets stand in the order of ``sheet_index``.  A workbook is made by one task, which holds one row of it at a time.
    """
    df.sparkSession.dataSource.register(Source)
    rows = df.repartition("workbook").sortWithinPartitions("workbook", "sheet_index", "sheet", "row").select("workbook", "sheet", "row", "cells")
    rows.write.format("workbook").mode(mode).save(path)


def dated(rows: DataFrame) -> DataFrame:
    """SRC-21: each date in the cells of ``read``: path, sheet, row, col, ``text`` as it stands and ``date``; date cells as a whole, texts by the patterns."""
    cells = rows.where("error is null").select("path", "sheet", "sheet_index", "row", F.explode("cells").alias("c")).select("path", "sheet", "sheet_index", "row", "c.*")
    whole = cells.where("kind = 'd'").select("path", "sheet", "sheet_index", "row", "col", F.col("value").alias("text"), F.try_to_date(F.substring("value", 1, 10), "yyyy-MM-dd").alias("date"))
    inside = cells.where("kind = 's'").select("path", "sheet", "sheet_index", "row", "col", F.explode(dates.find(F.col("value"))).alias("text"))
    return whole.unionByName(inside.withColumn("date", dates.parse(F.col("text")))).where("date is not null")
