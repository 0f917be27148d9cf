"""Files that come in: a folder of documents listed without reading them, and the checks of an upload."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, table
from .derived import TX_SQL, sql
from .sinks import _BLANK, ED_SQL, QUERY_CHUNK, _rows, csv_chunks, write_documents

# What an upload may be.
PDF_TYPE, PDF_SUFFIX, MOST_BYTES = "application/pdf", ".pdf", 10 * 1024 * 1024
NOT_PDF = "That file is not a PDF. Please upload a digital PDF bank statement."
TOO_LARGE = "That file is larger than 10 MB. Try a shorter statement or a single account."


def file_check(name: Column, kind: Column, size: Column) -> Column:
    """Why a file can't be taken, null if it can: its type or its name's end must say PDF, then its size counts."""
    is_pdf = F.coalesce(kind == PDF_TYPE, F.lit(False)) | F.coalesce(F.endswith(F.lower(name), F.lit(PDF_SUFFIX)), F.lit(False))
    return F.when(~is_pdf, NOT_PDF).when(size > MOST_BYTES, TOO_LARGE)


def scan_corpus(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """folder, label, path, n_bytes of all files below a root whose names fit: a label is the folder under the root and the
    file's number in it, by path, so that no name gets out. Spark lists the files; their contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    inner = F.regexp_replace(F.regexp_extract(F.regexp_replace("path", r"^[a-zA-Z]+:(?://[^/]*)?", ""), r"^(.*)/[^/]*$", 1), rf"^\Q{base}\E/?", "")
    found = files.select(F.coalesce(F.nullif(inner, F.lit("")), F.lit(".")).alias("folder"), "path", F.col("length").alias("n_bytes"))
    number = F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1
    return found.withColumn("label", F.concat("folder", F.lit("#"), number)).select("folder", "label", "path", "n_bytes")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all accounts as files in a folder for each, listed again."""
    root = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    write_documents(csv_chunks(_rows(spark, sf_dir), QUERY_CHUNK), root, "PDF")
    return scan_corpus(spark, root).select("folder", "label", "n_bytes")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, PDF_TYPE).when(n % 3 == 1, "text/plain")
    name = F.concat(F.lit("Statement "), n, F.when(n % 4 == 0, ".pdf").when(n % 4 == 1, ".PDF").when(n % 4 == 2, ".pdf.txt").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", file_check(name, kind, F.col("n_chars") * (n % 300 + 1)).alias("reason"))


QUERIES = {
    "corpus_scan": (
        _scan,
        sql(TX_SQL, ED_SQL, select="""
, c AS (SELECT statement_id, chunk_no, sum(2 + strlen('"' || date || '","' || replace(description, '"', '""') || '",' || """ + " || ',' || ".join(map(_BLANK, "dcab")) + """)) AS n FROM cells GROUP BY ALL
  UNION ALL SELECT DISTINCT statement_id, -1, 44 FROM cells)
SELECT 'statement=' || statement_id AS folder, 'statement=' || statement_id || '#' || (row_number() OVER (PARTITION BY statement_id ORDER BY chunk_no) - 1) AS label, CAST(n AS BIGINT) AS n_bytes FROM c"""),
    ),
    "file_checks": (
        _checks,
        f"""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 NOT IN (0, 1) THEN '{NOT_PDF}' WHEN n_chars * (doc_id % 300 + 1) > {MOST_BYTES} THEN '{TOO_LARGE}' END AS reason FROM documents""",
    ),
}
