"""One workbook as a stream of cells, and rows as a workbook: zip and XML, row by row."""

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Built-in number formats that show dates or times; names of the format.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
EPOCH = dt.date(1899, 12, 30)
#: The most rows of a sheet, one of them the header.
MOST_ROWS = 1_048_576

Cell = tuple[int, int, str, str | None, float | None, dt.date | None, bool, bool]


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(c: int) -> str:
    out = ""
    while c:
        c, k = divmod(c - 1, 26)
        out = chr(65 + k) + out
    return out


def place(ref: str) -> tuple[int, int]:
    return int(re.search("[0-9]+", ref)[0]), column_number(ref)


class Book:
    """An open workbook: sheets has (index, name, file within the zip) in the workbook's order."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = []
        for index, sheet in enumerate(ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            target = links[sheet.get(LINK)].lstrip("/")
            self.sheets.append((index, sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
        self.shared = list(self._strings()) if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _strings(self) -> Iterator[str]:
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}si":
                    yield "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
                    e.clear()

    def _date_styles(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
        shows = lambda k: k in DATE_FORMATS or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")), re.I)) and k in own
        styles = root.find(f"{MAIN}cellXfs")
        return {k for k, x in enumerate(styles if styles is not None else []) if shows(int(x.get("numFmtId", 0)))}

    def merged(self, target: str) -> list[tuple[int, int, int, int]]:
        """(first row, first column, last row, last column) of the merged ranges. They stand behind the
        rows, so the sheet is unpacked once for its end alone."""
        with self.zip.open(target) as f:
            tail = b""
            while block := f.read(1 << 20):
                at = (tail := tail[-16:] + block).find(b"<mergeCells")
                if at >= 0:
                    tail = tail[at:] + f.read()
                    break
            else:
                return []
        return [(*place(a.decode()), *place(b.decode())) for a, b in re.findall(rb'<mergeCell\s[^>]*ref="([A-Z]+[0-9]+):([A-Z]+[0-9]+)"', tail)]

    def cells(self, target: str, rows: int | None = None) -> Iterator[Cell]:
        """(row, col, kind, s, n, d, is_formula, cached) of the filled cells by row and column, merged
        ranges filled from their first cell; of the first rows only, if said. One row is held at a time."""
        ranges = sorted(self.merged(target))
        live: list[tuple[int, int, int, tuple]] = []  # ranges under way: last row, columns, value
        done = 0
        for r, held in self._rows(target):
            if rows is not None and r > rows:
                break
            yield from self._between(done, r, live)
            while ranges and ranges[0][0] <= r:
                r0, c0, r1, c1 = ranges.pop(0)
                if r0 == r and c0 in held:
                    live.append((r1, c0, c1, held[c0]))
            for _, c0, c1, value in live:
                held |= dict.fromkeys(range(c0, c1 + 1), value)
            yield from ((r, c, *v) for c, v in sorted(held.items()))
            done, live = r, [x for x in live if x[0] > r]
        yield from self._between(done, 1 + max((x[0] for x in live), default=0) if rows is None else rows + 1, live)

    @staticmethod
    def _between(done: int, upto: int, live: list[tuple[int, int, int, tuple]]) -> Iterator[Cell]:
        """Rows that only merged ranges fill."""
        for r in range(done + 1, min(upto, 1 + max((x[0] for x in live), default=0))):
            own = {c: v for r1, c0, c1, v in live if r1 >= r for c in range(c0, c1 + 1)}
            yield from ((r, c, *v) for c, v in sorted(own.items()))
        live[:] = [x for x in live if x[0] >= upto]

    def _rows(self, target: str) -> Iterator[tuple[int, dict[int, tuple]]]:
        with self.zip.open(target) as f:
            at, data = 0, None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = e if e.tag == f"{MAIN}sheetData" else data
                elif e.tag == f"{MAIN}row":
                    at = int(e.get("r", at + 1))
                    held, c = {}, 0
                    for cell in e.iter(f"{MAIN}c"):
                        c = column_number(cell.get("r")) if cell.get("r") else c + 1
                        if value := self._value(cell):
                            held[c] = value
                    yield at, held
                    data.clear()  # rows that were read

    def _value(self, c: ElementTree.Element) -> tuple | None:
        value, text, formula = c.find(f"{MAIN}v"), c.get("t", "n"), c.find(f"{MAIN}f") is not None
        raw = value.text if value is not None else None
        if text == "inlineStr":
            return "s", "".join(t.text or "" for t in c.iter(f"{MAIN}t")), None, None, formula, True
        if raw is None:
            return ("f", None, None, None, True, False) if formula else None
        if text == "s":
            return "s", self.shared[int(raw)], None, None, formula, True
        if text in ("str", "e"):
            return "s", raw, None, None, formula, True
        if text == "b":
            return "b", None, float(raw), None, formula, True
        if int(c.get("s", 0)) in self.dates:
            return "d", None, None, EPOCH + dt.timedelta(days=int(float(raw))), formula, True
        return "n", None, float(raw), None, formula, True

    def choose(self, wanted: list[str], rows: int = 200) -> tuple[int, str, str] | None:
        """The first wanted sheet in the workbook's order (any case), else that with the most cells in its first rows."""
        for sheet in self.sheets:
            if sheet[1].lower() in wanted:
                return sheet
        filled = lambda s: sum(1 for _ in self.cells(s[2], rows))
        return max(self.sheets, key=lambda s: (filled(s), -s[0]), default=None)


def _cell(r: int, c: int, v) -> str:
    if v is None:
        return ""
    ref = f"{column_letters(c)}{r}"
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.date):
        return f'<c r="{ref}" s="1"><v>{(dt.date(v.year, v.month, v.day) - EPOCH).days}</v></c>'
    if isinstance(v, int | float) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_plain(str(v)))}</t></is></c>'


def _formula(r: int, c: int, v) -> str:
    return f'<c r="{column_letters(c)}{r}"><f>{escape(v[1:])}</f></c>' if isinstance(v, str) and v.startswith("=") else _cell(r, c, v)


def _plain(text: str) -> str:
    """text without the characters that XML can't hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", "", text)


def save(sheets: dict[str, Iterable[Iterable]], out: IO[bytes] | str, formulas: bool = False) -> None:
    """Writes rows of text, numbers, booleans and dates as sheets; rows are taken one by one. With
    formulas, text that begins with = is one without a value."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names, cell = list(sheets), _formula if formulas else _cell
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {space}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="s{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        for k, n in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                f.write(f"<worksheet {space}><sheetData>".encode())
                for r, row in enumerate(sheets[n], 1):
                    f.write((f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
