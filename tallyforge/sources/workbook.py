"""Workbooks (OOXML spreadsheets) as a Spark data source, from the standard library alone.

Reading: each sheet of each file is a partition, parsed row by row; what a task holds is the file's shared strings and one row. Writing: each task writes one file; rows that follow each other with the same
sheet name make a sheet, so rows must be sorted by sheet within a task (`write_workbook` does), and one row is held at a time. Files get their names when the job commits, so a task that runs again leaves no
second copy. Paths are any that Arrow's file systems know; driver and executors must both reach them.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names that the format fixes.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Rows that a sheet holds at most; more go on in a sheet of the same name with a number.
MOST_ROWS = 1_048_576
RAW = "file string, sheet string, row_nr int, cells map<string,string>"


def letters(i: int) -> str:
    """Column name of place i, from 0: A to Z, AA, AB, ..."""
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-zA-Z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def _quoted(text: str) -> str:
    """Text for XML 1.0: characters that it can't hold, and what looks like their escape, are escaped as the format says."""
    text = re.sub(r"_x[0-9A-Fa-f]{4}_", lambda m: "_x005F" + m[0], text)
    return escape(re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _unquoted(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
        target = links[s.get(f"{{{LINKS}}}id")]
        found.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _text(node: ET.Element) -> str:
    """The text of a string item: its own or that of its runs, without phonetic hints."""
    parts = [t.text or "" for c in node if c.tag in (f"{{{MAIN}}}t", f"{{{MAIN}}}r") for t in ([c] if c.tag.endswith("}t") else c.iter(f"{{{MAIN}}}t"))]
    return _unquoted("".join(parts))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return [_text(e) for _, e in ET.iterparse(f) if e.tag == f"{{{MAIN}}}si"]


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, dict[str, str]]]:
    """Row number and cells by column letter of each row that is there. Numbers as written, truth values as TRUE and FALSE, errors as their names; empty cells are left out."""
    shared, last = _shared(book), 0
    with book.open(part) as f:
        parents: list[ET.Element] = []
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag != f"{{{MAIN}}}row":
                continue
            last, cells, at = int(e.get("r") or last + 1), {}, -1
            for c in e.iter(f"{{{MAIN}}}c"):
                name = re.match(r"[A-Z]+", c.get("r") or letters(at + 1))[0]
                at = -1
                for ch in name:
                    at = (at + 1) * 26 + ord(ch) - 65
                kind, value = c.get("t", "n"), c.find(f"{{{MAIN}}}v")
                if kind == "inlineStr":
                    inline = c.find(f"{{{MAIN}}}is")
                    v = _text(inline) if inline is not None else None
                elif value is None or value.text is None:
                    v = None
                else:
                    v = shared[int(value.text)] if kind == "s" else ("TRUE" if value.text == "1" else "FALSE") if kind == "b" else _unquoted(value.text) if kind == "str" else value.text
                if v is not None:
                    cells[name] = v
            yield last, cells
            e.clear()
            if parents:
                parents[-1].clear()  # rows that are done


@dataclass
class SheetPart(InputPartition):
    file: str
    sheet: str
    part: str


class Workbook(DataSource):
    """format("workbook"). Reading gives file, sheet, row_nr and cells (text by column letter). Options: path (a file or a folder of .xlsx files), sheet (one name; all without it)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options, schema.names, overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~"), key=lambda f: f.path)
        out = []
        for f in files:
            with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as book:
                out += [SheetPart(f.path, name, part) for name, part in _sheets(book) if self.sheet in (None, name)]
        if self.sheet is not None and files and not out:
            raise ValueError(f"no sheet is called {self.sheet}")
        return out or [SheetPart("", "", "")]

    def read(self, partition: SheetPart) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as raw, zipfile.ZipFile(raw) as book:
            for number, cells in sheet_rows(book, partition.part):
                yield partition.file.rsplit("/", 1)[-1], partition.sheet, number, cells


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class WorkbookWriter(DataSourceWriter):
    """The first column is the sheet's name, the others are cells A, B, ... in order."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = options["path"], names, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = _store(self.path)
        rows = iter(iterator)
        first = next(rows, None)
        if first is None:
            return Written(None)
        pending = f"{path}/_pending-{self.run}"
        store.create_dir(pending, recursive=True)
        name = f"part-{context.partitionId():05d}-{self.run[:8]}.xlsx"
        attempt = f"{pending}/{context.taskAttemptId()}-{name}"
        with store.open_output_stream(attempt) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
            write_book(book, self._all(first, rows))
        return Written(f"{attempt}|{path}/{name}")

    @staticmethod
    def _all(first: Row, rows: Iterator[Row]) -> Iterator[Row]:
        yield first
        yield from rows

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.base_name.endswith(".xlsx"):
                    store.delete_file(f.path)
        for m in messages:
            if m and m.file:
                store.move(*m.file.split("|"))
        self._clear(store, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        pending = f"{path}/_pending-{self.run}"
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


def _cell(column: str, number: int, v) -> str:
    if v is None:
        return ""
    at = f'r="{column}{number}"'
    if isinstance(v, bool):
        return f'<c {at} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c {at}><v>{v!r}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_quoted(str(v))}</t></is></c>'


def sheet_name(name: str, taken: set[str]) -> str:
    """A name that the format allows: 31 characters at most, none of []:*?/\\, told apart from those taken by a number."""
    base = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", name).strip("'")[:31] or "sheet"
    out, n = base, 2
    while out.lower() in taken:
        mark = f" ({n})"
        out, n = base[: 31 - len(mark)] + mark, n + 1
    taken.add(out.lower())
    return out


def write_book(book: zipfile.ZipFile, rows: Iterator[Row]) -> None:
    """Sheets of rows whose first value names the sheet; each run of the same name is a sheet."""
    taken: set[str] = set()
    names: list[str] = []
    current, out, number = object(), None, 0

    def close() -> None:
        if out:
            out.write(b"</sheetData></worksheet>")
            out.close()

    for row in rows:
        if row[0] != current or number >= MOST_ROWS:
            close()
            current, number = row[0], 0
            names.append(sheet_name(str(current), taken))
            out = book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True)
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        number += 1
        out.write(f'<row r="{number}">{"".join(_cell(letters(i), number, v) for i, v in enumerate(row[1:]))}</row>'.encode())
    close()
    n = range(1, len(names) + 1)
    sheets = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, names, strict=True))
    links = "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>')
    book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
    book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')


def write_workbook(df: DataFrame, path: str, sheet: str, *order: str, mode: str = "append") -> None:
    """One .xlsx file a task under path: rows by the column `sheet`, then `order`; all other columns but those of `order` that begin with _ are cells from A on, in the frame's order."""
    df.sparkSession.dataSource.register(Workbook)
    cells = [c for c in df.columns if c != sheet and not c.startswith("_")]
    df.sortWithinPartitions(sheet, *order).select(F.col(sheet).cast("string").alias(sheet), *cells).write.format("workbook").mode(mode).save(path)


def read_cells(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None) -> DataFrame:
    """file, sheet, row_nr and a column for each letter of `columns`, cast to the type given with it (a value that is none is null). A partition a sheet."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    df = (reader.option("sheet", sheet) if sheet is not None else reader).load(path)
    return df.select("file", "sheet", "row_nr", *[F.col("cells")[c].try_cast(t).alias(c) for c, t in columns.items()])


def read_headed(spark: SparkSession, path: str, schema: StructType | str, sheet: str | None = None) -> DataFrame:
    """Sheets whose first row holds column names: file, sheet, row_nr and the schema's columns; one that a sheet lacks is null there. The first rows are joined to the others by file and sheet."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    df = (reader.option("sheet", sheet) if sheet is not None else reader).load(path)
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    head = df.where("row_nr = 1").select("file", "sheet", F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(e["value"], e["key"]))).alias("head"))
    return df.where("row_nr > 1").join(head, ["file", "sheet"]).select("file", "sheet", "row_nr", *[F.col("cells")[F.col("head")[f.name]].try_cast(f.dataType).alias(f.name) for f in fields])
