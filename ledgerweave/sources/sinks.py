"""Exports: CSV and JSON documents in chunks, and workbooks; none holds a statement as a whole."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import money
from ..operators.transactions import edited_rows
from ..session import with_package
from .derived import HEAD_SQL, TX_SQL, sql

# Fixed value: the columns of an export.
HEADERS = ("Date", "Description", "Debit", "Credit", "Amount", "Balance")


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(category: bool = False) -> Column:
    """A row as one CSV line: text always quoted, numbers with two decimals, blank where there is none."""
    number = lambda c: F.coalesce(money.money_string(c), F.lit(""))
    cells = [csv_cell(F.col("date")), csv_cell(F.col("description")), number(F.col("debit_c")), number(F.col("credit_c")), number(money.derive_amount(F.col("debit_c"), F.col("credit_c"))), number(F.col("balance_c"))]
    return F.concat_ws(",", *cells, *([csv_cell(F.col("category"))] if category else []))


def in_chunks(rows: DataFrame, item: Column, chunk_rows: int, lead: Column | str = "") -> DataFrame:
    """statement_id, chunk_no, content: the items of each run of chunk_rows numbers of seq, lead before every one of them.

    Chunks are groups of bounded size, however many rows a statement has, and no task holds more than some of them.
    """
    lead = F.lit(lead) if isinstance(lead, str) else lead
    body = rows.select("statement_id", F.floor((F.col("seq") - 1) / chunk_rows).cast("long").alias("chunk_no"), "seq", F.concat(lead, item).alias("item"))
    body = body.groupBy("statement_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("l"))
    return body.select("statement_id", "chunk_no", F.array_join(F.col("l.item"), "").alias("content"))


#: Rows of a chunk, and the chunks before and after those with rows.
CHUNK_ROWS, HEAD, TAIL = 50_000, -1, 1 << 62


def csv_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """statement_id, chunk_no, content: a statement's contents in order are its CSV text, lines ended by CRLF but for the last."""
    head = rows.select("statement_id").distinct().select("statement_id", F.lit(HEAD).cast("long").alias("chunk_no"), F.lit(",".join(HEADERS)).alias("content"))
    return head.unionByName(in_chunks(rows, csv_line(), chunk_rows, "\r\n"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One text file per partition of CSV lines in order, CRLF between them; write.csv can't quote some cells only."""
    rows.repartition("statement_id").sortWithinPartitions("statement_id", "seq").select(csv_line().alias("value")).write.option("lineSep", "\r\n").text(path)


def json_chunks(rows: DataFrame, heads: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """statement_id, chunk_no, content: a statement's contents in order are a JSON document of its balances, as strings, and rows."""
    item = F.to_json(F.struct("seq", "date", "description", money.money_string(F.col("debit_c")).alias("debit"), money.money_string(F.col("credit_c")).alias("credit")))
    first = rows.groupBy("statement_id").agg(F.min("seq").alias("first"))
    body = in_chunks(rows.join(first, "statement_id"), item, chunk_rows, F.when(F.col("seq") > F.col("first"), ",").otherwise(""))
    ends = heads.join(first, "statement_id", "left_semi")
    opened = F.to_json(F.struct(money.money_string(F.col("opening_c")).alias("opening"), money.money_string(F.col("closing_c")).alias("closing")))
    opened = F.when(opened == "{}", '{"rows":[').otherwise(F.concat(F.substr(opened, F.lit(1), F.length(opened) - 1), F.lit(',"rows":[')))
    edge = lambda no, text: ends.select("statement_id", F.lit(no).cast("long").alias("chunk_no"), text.alias("content"))
    return edge(HEAD, opened).unionByName(body).unionByName(edge(TAIL, F.lit("]}")))


class DocumentWriter(DataSourceWriter):
    """Chunks as files of a folder for each statement, in a staging folder that becomes the path when all tasks are done.

    A task's file gets its name once it is whole, and a repeated task writes the same bytes, so a lost executor does no harm.
    """

    def __init__(self, options: dict, overwrite: bool):
        path = options["path"].rstrip("/")
        self.path, self.overwrite, self.suffix = path, overwrite, options.get("suffix", "csv")
        self.staging = f"{path}._staging-{uuid.uuid4().hex}"

    @staticmethod
    def place(uri: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(uri) if "://" in uri else FileSystem.from_uri(f"file://{uri}")

    def write(self, rows) -> WriterCommitMessage:
        files, root = self.place(self.staging)
        for row in rows:
            folder = f"{root}/statement={row['statement_id']}"
            files.create_dir(folder, recursive=True)
            name, content = f"{folder}/{row['chunk_no'] + 1:020d}.{self.suffix}", row["content"]
            part = f"{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            files.move(part, name)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileType

        files, staged = self.place(self.staging)
        _, path = self.place(self.path)
        if files.get_file_info(path).type != FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            files.delete_dir(path)
        files.create_dir(staged, recursive=True)
        files.move(staged, path)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        files, staged = self.place(self.staging)
        if files.get_file_info(staged).type != FileType.NotFound:
            files.delete_dir(staged)


class DocumentSink(DataSource):
    """Format statement_documents: writes (statement_id, chunk_no, content) to files by statement; see DocumentWriter."""

    @classmethod
    def name(cls) -> str:
        return "statement_documents"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def write_documents(chunks: DataFrame, path: str, suffix: str = "csv", mode: str = "error") -> None:
    """Chunks as path/statement=<id>/<number>.<suffix>; a statement's files in order of their names are its document. All or nothing."""
    spark = chunks.sparkSession
    with_package(spark)
    spark.dataSource.register(DocumentSink)
    chunks.select("statement_id", "chunk_no", "content").write.format("statement_documents").option("suffix", suffix).mode("overwrite" if mode == "overwrite" else "append").save(path)


XML = '<?xml version="1.0" encoding="UTF-8"?>'
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Transactions" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def sheet_row(cells: list) -> str:
    """Typed cells; nothing for empty text and missing numbers."""
    out = []
    for cell in cells:
        if cell in (None, ""):
            out.append("<c/>")
        elif isinstance(cell, str):
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(cell)}</t></is></c>')
        else:
            out.append(f"<c><v>{cell // 100 if cell >= 0 else -(-cell // 100)}.{abs(cell) % 100:02d}</v></c>" if cell >= 0 or abs(cell) >= 100 else f"<c><v>-0.{abs(cell):02d}</v></c>")
    return "<row>" + "".join(out) + "</row>"


#: Rows of a workbook. Fixed value: a sheet has 1,048,576 rows at most, one of them for the headings.
BOOK_ROWS = 1_048_575
SHEET = "xl/worksheets/sheet1.xml"
BEFORE, AFTER = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>"


class Book:
    """A workbook written row by row: what is held is its compressed bytes. The same rows always make the same bytes."""

    def __init__(self):
        self.n_rows, self.buffer = 0, io.BytesIO()
        self.archive = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_DEFLATED)
        for name, content in PARTS.items():
            self.archive.writestr(self.entry(name), XML + content)
        self.sheet = self.archive.open(self.entry(SHEET), "w")
        self.sheet.write((XML + BEFORE + sheet_row(list(HEADERS))).encode())

    @staticmethod
    def entry(name: str) -> zipfile.ZipInfo:
        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_DEFLATED
        return info

    def add(self, cells: list) -> None:
        self.sheet.write(sheet_row(cells).encode())
        self.n_rows += 1

    def finish(self) -> bytes:
        self.sheet.write(AFTER.encode())
        self.sheet.close()
        self.archive.close()
        return self.buffer.getvalue()


def workbooks(rows: DataFrame, book_rows: int = BOOK_ROWS) -> DataFrame:
    """statement_id, book_no, n_rows, content: a workbook of each statement, its rows in order, and further ones past a sheet's rows.

    A book is written by one task as its sorted rows pass by, so what a task holds is one compressed sheet.
    """
    with_package(rows.sparkSession)
    amount = money.derive_amount(F.col("debit_c"), F.col("credit_c"))
    lines = rows.select(
        "statement_id", F.floor((F.col("seq") - 1) / book_rows).cast("long").alias("book_no"), "seq", "date", "description", money.normalize_money(F.col("debit_c")).alias("debit"),
        money.normalize_money(F.col("credit_c")).alias("credit"), amount.alias("amount"), F.col("balance_c").alias("balance"),
    )

    def run(batches):
        key, book = None, None
        batch_of = lambda: pa.RecordBatch.from_pylist([{"statement_id": key[0], "book_no": key[1], "n_rows": book.n_rows, "content": book.finish()}], schema=kind)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != key:
                    if book:
                        yield batch_of()
                    key, book = row[:2], Book()
                book.add(list(row[3:]))
        if book:
            yield batch_of()

    kind = pa.schema([("statement_id", pa.int64()), ("book_no", pa.int64()), ("n_rows", pa.int64()), ("content", pa.binary())])
    by_book = lines.repartition("statement_id", "book_no").sortWithinPartitions("statement_id", "book_no", "seq")
    return by_book.mapInArrow(run, "statement_id long, book_no long, n_rows long, content binary")


def read_workbooks(books: DataFrame) -> DataFrame:
    """statement_id, book_no, row_no (0: headings), cells (texts, numbers as printed, null where empty) of workbooks."""
    with_package(books.sparkSession)

    def run(batches):
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        for batch in batches:
            for statement, book, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found, row_no = [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(SHEET) as sheet:
                    for _, element in iterparse(sheet):
                        if tag(element) != "row":
                            continue
                        cells = ["".join(c.itertext()) or None for c in element]
                        found.append({"statement_id": statement, "book_no": book, "row_no": row_no, "cells": cells})
                        row_no += 1
                        element.clear()
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_pylist(found, schema=kind)
                            found = []
                yield pa.RecordBatch.from_pylist(found, schema=kind)

    kind = pa.schema([("statement_id", pa.int64()), ("book_no", pa.int64()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string()))])
    return books.select("statement_id", "book_no", "content").mapInArrow(run, "statement_id long, book_no long, row_no long, cells array<string>")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_rows(spark, sf_dir).withColumn("description", F.concat("description", F.lit(' "x"'))).withColumn("balance_c", F.when(F.col("seq") % 3 == 0, F.col("row_no") - 500))


#: Rows of a chunk in the queries, so that every account has several.
QUERY_CHUNK = 25


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .derived import headers, transactions

    chunks = json_chunks(_rows(spark, sf_dir), headers(transactions(spark, sf_dir)), QUERY_CHUNK)
    return chunks.select("statement_id", "chunk_no", F.sha2("content", 256).alias("digest"))


def _xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells read back from workbooks of 40 rows at most."""
    cells = read_workbooks(workbooks(_rows(spark, sf_dir), 40))
    cell = lambda k: F.coalesce(F.col("cells")[k], F.lit(""))
    return cells.where("row_no > 0").select("statement_id", (F.col("book_no") * 40 + F.col("row_no")).cast("int").alias("seq"), *[cell(k).alias(h.lower()) for k, h in enumerate(HEADERS)])


ED_SQL = """ed AS (
  SELECT statement_id, row_no, seq, CASE WHEN row_no % 13 = 0 THEN '' ELSE date END AS date,
         CASE WHEN row_no % 17 = 0 THEN '' WHEN row_no % 29 = 0 THEN 'Sub-total of purchases' ELSE event_type END || ' "x"' AS description,
         CASE WHEN row_no % 19 = 0 THEN amount_c WHEN row_no % 23 = 0 THEN NULL WHEN row_no % 31 = 0 THEN -amount_c ELSE debit_c END AS d,
         CASE WHEN row_no % 19 = 0 THEN amount_c WHEN row_no % 23 = 0 THEN NULL WHEN row_no % 37 = 0 THEN 0 ELSE credit_c END AS c, CASE WHEN seq % 3 = 0 THEN row_no - 500 END AS b FROM tx
), cells AS (SELECT *, (seq - 1) // 25 AS chunk_no, CASE WHEN coalesce(d, 0) <> 0 AND coalesce(c, 0) = 0 THEN -d WHEN coalesce(c, 0) <> 0 AND coalesce(d, 0) = 0 THEN c END AS a FROM ed)"""
_MONEY = lambda x: f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(abs({x}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0')"
_BLANK = lambda x: f"coalesce({_MONEY(x)}, '')"


QUERIES = {
    "csv_export": (
        lambda s, d: csv_chunks(_rows(s, d), QUERY_CHUNK).select("statement_id", "chunk_no", F.sha2("content", 256).alias("digest")),
        sql(TX_SQL, ED_SQL, select="""
SELECT statement_id, CAST(chunk_no AS BIGINT) AS chunk_no, sha256(string_agg(chr(13) || chr(10) || '"' || date || '","' || replace(description, '"', '""') || '",' || """
            + " || ',' || ".join(map(_BLANK, "dcab"))
            + """, '' ORDER BY seq)) AS digest FROM cells GROUP BY statement_id, chunk_no
UNION ALL SELECT DISTINCT statement_id, -1, sha256('Date,Description,Debit,Credit,Amount,Balance') FROM cells"""),
    ),
    "json_export": (
        _json,
        sql(TX_SQL, HEAD_SQL, ED_SQL, select=f"""
SELECT statement_id, CAST(chunk_no AS BIGINT) AS chunk_no, sha256(string_agg(CASE WHEN seq > 1 THEN ',' ELSE '' END || '{{"seq":' || seq || ',"date":"' || date || '","description":"' || replace(description, '"', '\\"') || '"'
    || coalesce(',"debit":"' || {_MONEY('d')} || '"', '') || coalesce(',"credit":"' || {_MONEY('c')} || '"', '') || '}}', '' ORDER BY seq)) AS digest
FROM cells GROUP BY statement_id, chunk_no
UNION ALL SELECT statement_id, -1, sha256('{{' || coalesce('"opening":"' || {_MONEY('opening_c')} || '",', '') || coalesce('"closing":"' || {_MONEY('closing_c')} || '",', '') || '"rows":[') FROM head
UNION ALL SELECT statement_id, {TAIL}, sha256(']}}') FROM head"""),
    ),
    "xlsx_export": (
        _xlsx,
        sql(TX_SQL, ED_SQL, select=f"""
SELECT statement_id, seq, date, description, {_BLANK('nullif(d, 0)')} AS debit, {_BLANK('nullif(c, 0)')} AS credit, {_BLANK('a')} AS amount, {_BLANK('b')} AS balance FROM cells"""),
    ),
}
