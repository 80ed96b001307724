"""Workbooks (.xlsx) as a data source: a reader with a partition for each sheet that finds the header row, and a writer with a commit protocol.

Register it once a session: ``spark.dataSource.register(Workbook)``. Only the standard library's zip and XML are used; files are opened by
pyarrow's file systems, so paths may be local or remote. Styles, formulas and charts aren't read or written.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Numbers of built-in formats that show dates, rows searched for a header, and data rows of a written sheet.
_DATES = {14, 15, 16, 17, 22}
SCAN, ROWS = 10, 1_000_000
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Book:
    """An open workbook: its sheets by name, its shared texts, and which styles show dates."""

    def __init__(self, path: str):
        system, own = _files(path)
        self.zip = zipfile.ZipFile(system.open_input_file(own))
        names = set(self.zip.namelist())
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.join("xl", t)
        self.sheets = {s.get("name"): place(targets[s.get(f"{_REL}id")]) for s in self._tree("xl/workbook.xml").iter(f"{_MAIN}sheet")}
        shared = self._tree("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else ()
        self.texts = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in shared]
        styles = self._tree("xl/styles.xml").find(f"{_MAIN}cellXfs") if "xl/styles.xml" in names else None
        self.dates = {i for i, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in _DATES}

    def _tree(self, name: str):
        with self.zip.open(name) as f:
            return ElementTree.parse(f).getroot()

    def rows(self, sheet: str) -> Iterator[tuple[int, list]]:
        """Row numbers from 1 and the cells' texts, null where a cell is empty; one row is held at a time."""
        with self.zip.open(self.sheets[sheet]) as f:
            at = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                at = int(row.get("r", at + 1))
                cells: list = []
                for c in row.iter(f"{_MAIN}c"):
                    column = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (column - len(cells)) + [self._text(c)]
                yield at, cells
                row.clear()

    def _text(self, c) -> str | None:
        kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.texts[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind == "n":
            number = float(v.text)
            if int(c.get("s", 0)) in self.dates:
                return str(datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number))
            return str(int(number)) if number.is_integer() else str(number)
        return v.text


def _column(place: str) -> int:
    out = 0
    for c in place.rstrip("0123456789"):
        out = 26 * out + ord(c) - 64
    return out - 1


def _letters(column: int) -> str:
    out, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    number: int


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.wanted = options["path"], json.loads(options["columns"]) if "columns" in options else None
        self.scan = int(options.get("scan", SCAN))

    def partitions(self):
        from pyarrow import fs

        system, own = _files(self.path)
        prefix = self.path[: len(self.path) - len(own)] if self.path.endswith(own) else ""
        info = system.get_file_info(own)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True))
        paths = sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".xlsx") and not any(p.startswith(("_", ".", "~")) for p in i.path[len(own) :].split("/")))
        return [Sheet(prefix + p, name, i) for p in paths for i, name in enumerate(_Book(prefix + p).sheets)]

    def read(self, partition: Sheet):
        rows = _Book(partition.path).rows(partition.name)
        seq = lambda r: partition.number * (1 << 32) + r
        if self.wanted is None:
            for r, cells in rows:
                yield partition.path, partition.name, r, cells
            return
        first, at = next(iter(self.wanted)), None
        for r, cells in rows:
            if at is None:
                shown = [(c or "").strip() for c in cells]
                own = {n: next((shown.index(h) for h in names if h in shown), None) for n, names in self.wanted.items()}
                if own[first] is not None:
                    at = own
                elif r >= self.scan:
                    return  # a sheet without the header has no data
                continue
            yield partition.path, partition.name, seq(r), *(cells[i] if i is not None and i < len(cells) else None for i in at.values())


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    """One workbook a task, first under a temporary name; all get their names when all tasks are done, and ``_SUCCESS`` comes last."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], [f.name for f in schema.fields], overwrite
        self.most, self.job = int(options.get("rows", ROWS)), uuid.uuid4().hex
        self.title = options.get("sheet", "Sheet")

    def write(self, rows):
        from pyspark import TaskContext

        system, own = _files(self.path)
        system.create_dir(f"{own}/_temporary-{self.job}", recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05}-{self.job}-{task.taskAttemptId()}.xlsx"
        with system.open_output_stream(f"{own}/_temporary-{self.job}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            count, sheets, rows = 0, 0, iter(rows)
            row = next(rows, None)
            while row is not None or not sheets:
                sheets += 1
                with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                    put = lambda s: f.write(s.encode())  # noqa: E731, B023
                    put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>')
                    put(_row(1, self.names))
                    n = 0
                    while row is not None and n < self.most:
                        n += 1
                        put(_row(n + 1, row))
                        row = next(rows, None)
                    put("</sheetData></worksheet>")
                    count += n
            for file, text in _frame([self.title if i == 0 else f"{self.title} {i + 1}" for i in range(sheets)]).items():
                book.writestr(file, text)
        return Part(name, count)

    def commit(self, messages):
        system, own = _files(self.path)
        if self.overwrite:
            from pyarrow import fs

            for i in system.get_file_info(fs.FileSelector(own)):
                if i.type == fs.FileType.File and (i.path.endswith(".xlsx") or i.path.endswith("_SUCCESS")):
                    system.delete_file(i.path)
        for m in messages:
            if m is not None:
                system.move(f"{own}/_temporary-{self.job}/{m.name}", f"{own}/{m.name}")
        system.delete_dir(f"{own}/_temporary-{self.job}")
        system.open_output_stream(f"{own}/_SUCCESS").close()

    def abort(self, messages):
        from pyarrow import fs

        system, own = _files(self.path)
        if system.get_file_info(f"{own}/_temporary-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{own}/_temporary-{self.job}")


def _row(number: int, values) -> str:
    cells = []
    for i, v in enumerate(values):
        place = f"{_letters(i)}{number}"
        if v is None:
            continue
        if isinstance(v, bool):
            cells.append(f'<c r="{place}" t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
            cells.append(f'<c r="{place}"><v>{v!r}</v></c>')
        else:
            cells.append(f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(v)))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def _frame(titles: list[str]) -> dict[str, str]:
    """The files that make sheets a workbook."""
    head, kind = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/package/2006"
    office, sheet = _REL[1:-1], "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{sheet}.worksheet+xml"/>' for i in range(len(titles)))
    listed = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, t in enumerate(titles))
    links = "".join(f'<Relationship Id="rId{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(titles)))
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{kind}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/>{parts}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{kind}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{kind}/relationships">{links}</Relationships>',
    }


class Workbook(DataSource):
    """Read options: ``path`` (a file or folder), ``columns`` (JSON of a name and its accepted headings, the first name's being needed), ``scan`` (rows searched
    for the header). With ``columns`` a row has path, sheet, seq (in the order of sheets and rows) and the named columns; without, path, sheet, row and cells.
    Write options: ``path``, ``sheet`` (the title), ``rows`` (data rows of a sheet)."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        if "columns" in self.options:
            return "path string, sheet string, seq bigint, " + ", ".join(f"`{n}` string" for n in json.loads(self.options["columns"]))
        return StructType([StructField("path", StringType()), StructField("sheet", StringType()), StructField("row", IntegerType()), StructField("cells", ArrayType(StringType()))])

    def reader(self, schema):
        return WorkbookReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WorkbookWriter(dict(self.options), schema, overwrite)
