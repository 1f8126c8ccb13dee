"""Workbooks: sheets of typed cells in one zipped file, as spreadsheet programs write them (.xlsx).

Rows become the sheets' text in Spark; the parts that tasks have written are copied into the file as streams.  A sheet
holds 1,048,576 rows by the format's own limit.  Files are read in tasks, a sheet in each, row by row.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.session import ship

#: Rows of a sheet at most, the header among them; the format's limit.
MOST_ROWS = 1_048_576

# Names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0D\\x0E-\\x1F]"


# Writing ---------------------------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    """Text as it stands in a cell: marked characters of XML, and those that XML has no place for as _xHHHH_."""
    out = F.regexp_replace(c, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    marked = out
    for k in [*range(9), 11, 12, 13, *range(14, 32)]:
        marked = F.replace(marked, F.lit(chr(k)), F.lit(f"_x{k:04X}_"))
    out = F.when(out.rlike(_CONTROL), marked).otherwise(out)
    return F.replace(F.replace(F.replace(out, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _cell(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        made = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, T.NumericType):
        real = isinstance(kind, T.DoubleType | T.FloatType)
        number = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
        made = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit('<c t="e"><v>#NUM!</v></c>')).otherwise(number) if real else number
    else:
        # A line feed would part the row's text; it is written as a reference.
        made = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), F.replace(_escaped(c.cast("string")), F.lit("\n"), F.lit("&#10;")), F.lit("</t></is></c>"))
    return F.coalesce(made, F.lit("<c/>"))


def write(tables: Mapping[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each table, its column names in the first row; rows in the tables' order.

    Numbers and booleans are typed, all else is text; null is an empty cell, NaN and infinities are errors.  The file
    appears at once, when it is whole.  A table with more rows than a sheet holds is refused.
    """
    if not tables:
        raise ValueError("a workbook needs a sheet")
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs, held = at(path).getFileSystem(conf), f"{path}-{uuid.uuid4().hex}"
    try:
        for i, (name, df) in enumerate(tables.items(), 1):
            if df.limit(MOST_ROWS).count() == MOST_ROWS:
                raise ValueError(f"{name} has {MOST_ROWS} rows or more; a sheet holds {MOST_ROWS - 1} and their names")
            row = F.concat(F.lit("<row>"), *[_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit("</row>"))
            df.select(row.alias("value")).write.text(f"{held}/sheet{i}")
        file = fs.create(at(f"{held}/book.xlsx"))
        zipped = jvm.java.util.zip.ZipOutputStream(file)

        def entry(name: str, *parts: str | list) -> None:
            zipped.putNextEntry(jvm.java.util.zip.ZipEntry(name))
            for p in parts:
                if isinstance(p, str):
                    zipped.write(bytearray(p.encode()))
                    continue
                for source in p:
                    opened = fs.open(source)
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, zipped, conf, False)
                    opened.close()
            zipped.closeEntry()

        names = list(tables)
        quoted = [n.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;") for n in names]
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        entry("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        entry("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        entry("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(quoted, 1)) + "</sheets></workbook>")
        entry("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, (_, df) in enumerate(tables.items(), 1):
            head = spark.range(1).select(F.concat(F.lit("<row>"), *[_cell(F.lit(c), T.StringType()) for c in df.columns], F.lit("</row>")).alias("v")).first()["v"]
            parts = sorted((s.getPath() for s in fs.listStatus(at(f"{held}/sheet{i}")) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
            entry(f"xl/worksheets/sheet{i}.xml", f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>{head}', parts, "</sheetData></worksheet>")
        zipped.close()
        fs.delete(at(path), False)
        if not fs.rename(at(f"{held}/book.xlsx"), at(path)):
            raise FileExistsError(path)
    finally:
        fs.delete(at(held), True)


# Reading ---------------------------------------------------------------------------------------------------------


def _column(reference: str) -> int:
    """The number, from 0, of the column that a cell's reference names."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _plain(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its own, or that of its runs, without phonetic hints."""
    own = f"{{{_MAIN}}}"
    return _plain("".join(t.text or "" for part in ([node] if node.find(f"{own}t") is not None else node.findall(f"{own}r")) for t in part.findall(f"{own}t")))


def sheet_paths(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets' names and the parts that hold them, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
        target = links[s.get(f"{{{_REL}}}id")]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """A sheet's rows as they are read: number from 1, and cells as text (null for empty ones and errors)."""
    own, shared = f"{{{_MAIN}}}", []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{own}si":
                    shared.append(_text(node))
                    node.clear()
    number = 0
    with book.open(part) as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{own}row":
                continue
            number = int(node.get("r") or number + 1)
            cells: list[str | None] = []
            for c in node.findall(f"{own}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t", "n"), c.find(f"{own}v")
                if kind == "inlineStr":
                    inner = c.find(f"{own}is")
                    cells[at] = None if inner is None else _text(inner)
                elif v is not None and v.text is not None and kind != "e":
                    cells[at] = shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else _plain(v.text) if kind == "str" else v.text
            yield number, cells
            node.clear()


_READ = T.StructType([T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])


def cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, sheet, row (from 1) and cells of the workbooks at a path or pattern; of all sheets, or of one name."""
    ship(spark)
    arrow = to_arrow_schema(_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, book = b.column(0)[i].as_py(), zipfile.ZipFile(io.BytesIO(b.column(1)[i].as_py()))
                for name, part in sheet_paths(book).items():
                    held: list[tuple] = []
                    for number, made in rows(book, part) if sheet in (None, name) else ():
                        held.append((file, name, number, made))
                        if len(held) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ)


def read(spark: SparkSession, path: str, sheet: str, schema: str) -> DataFrame:
    """The columns of a sheet that a schema names, by the names in its first row, which may stand in any order.

    A name that the sheet has not, and a cell that is no value of its type, give null.  Numbers of whole kinds may be
    written with a fraction of zero.
    """
    fields = T.StructType.fromDDL(schema).fields
    every = cells(spark, path, sheet)
    names = every.where("row = 1").select("file", F.col("cells").alias("names"))
    # One row of names for each file.
    told = every.where("row > 1").join(names, "file")

    def value(f: T.StructField) -> Column:
        text = F.get("cells", F.array_position("names", F.lit(f.name)).cast("int") - 1)
        return (text.try_cast("decimal(38,10)") if isinstance(f.dataType, T.IntegralType) else text).try_cast(f.dataType).alias(f.name)

    return told.select(*[value(f) for f in fields])
