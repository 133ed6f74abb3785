"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .step import read_step  # noqa: F401  (A4)

REQUIREMENT = "struct<type:string,description:string,min_value:double,max_value:double,unit:string,building_element:string,applies_to:string,condition:string,exception:string,values:string>"
ARTICLE = f"struct<number:string,title:string,content:string,requirements:array<{REQUIREMENT}>>"
CHAPTERS = f"array<struct<number:string,kind:string,title:string,sections:array<struct<number:string,title:string,articles:array<{ARTICLE}>>>>>"
STANDARD = (
    "standard_code string, standard_name string, year int, issuing_body string, status string, eff_status string, expired boolean, effective_date string, "
    f"doc_num string, doc_title string, vbpl_url string, source_id string, full_text boolean, scope string, supersedes string, related_standards array<string>, chapters {CHAPTERS}"
)
#: Shares of a source, and the most standards of a file: what a task writes and reads, as compressed files are read whole.
SHARES, FILE_RECORDS = 32, 20_000
FILE = "struct<fileName:string,kind:string,size:bigint,sha256:string,pages:int,text_chars:int,scanned:boolean,path:string,skipped:string>"
CATALOG = (
    "documents array<struct<id:string,docNum:string,title:string,qcvnCodes:array<string>,docType:string,issueDate:string,effFrom:string,effTo:string,effStatus:string,expired:boolean,"
    f"contentStatus:string,vbplUrl:string,html:struct<fileName:string,chars:int,path:string>,attachments:array<{FILE}>,supplements:array<{FILE}>>>"
)
MODEL = (
    "filename string, schema string, project_name string, site_name string, building_name string, storeys array<struct<name:string,elevation:double>>, "
    "elements array<struct<global_id:string,ifc_type:string,name:string,storey:string,material:string,properties:map<string,string>>>, "
    "spaces array<struct<global_id:string,name:string,long_name:string,storey:string,area:double>>, materials array<string>"
)


def read_standards(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A1: a folder of standards as JSON, one value (or an array) a file, or with ``lines`` one a line, as A6 writes several of one source; files whose
    name begins with "_" are reports and not read.  Fails before anything is written if a file is no JSON or has no code, or if there is none."""
    df = spark.read.schema(STANDARD).option("multiLine", not lines).option("mode", "FAILFAST").option("pathGlobFilter", "{[!_]*.json,[!_]*.json.gz}").json(path)
    bad = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce("standard_code", F.lit("")) == "").alias("bad")).first()
    if not bad["n"]:
        raise ValueError(f"no standards in {path}")
    if bad["bad"]:
        raise ValueError(f"{bad['bad']} standards without a code in {path}")
    return df


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A2: one row for each document of catalog envelopes."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")


def file_kind(content: Column) -> Column:
    """A3: pdf, doc or docx by the content's first bytes (and, for archives, the name of its main part); null otherwise."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(start(5) == "255044462D", "pdf").when(start(8) == "D0CF11E0A1B11AE1", "doc").when((start(2) == "504B") & F.contains(content, F.encode(F.lit("word/document.xml"), "UTF-8")), "docx")


def with_kind(df: DataFrame, content: str = "content") -> DataFrame:
    c = F.col(content)
    return df.withColumns({"kind": file_kind(c), "size": F.octet_length(c).cast("long"), "sha256": F.sha2(c, 256)})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A3: path, content, kind, size, sha256 of files."""
    return with_kind(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))


def read_parsed_models(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A5: parsed building models as JSON, one value (or an array) a file, or with ``lines`` one a line."""
    return spark.read.schema(MODEL).option("multiLine", not lines).json(path)


def write_standards(df: DataFrame, path: str, report: DataFrame | None = None, report_path: str | None = None) -> None:
    """The whole corpus anew, one folder for each source, with a report of its own.  A line holds a standard: read them with ``lines``.  Large sources are dealt
    over several tasks and files; files are compressed."""
    safe = F.regexp_replace("source_id", r"[^\p{L}\p{N}._-]+", "_")
    rows = df.withColumn("source_file", safe).repartition("source_file", F.pmod(F.xxhash64("standard_code"), F.lit(SHARES)))
    rows.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).partitionBy("source_file").json(path)
    if report is not None and report_path:
        report.write.mode("overwrite").json(report_path)


def replace_partitions(df: DataFrame, path: str, key: str = "source_id") -> None:
    """Of a table that is split by source, only the sources in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_foundation_json(df: DataFrame, path: str) -> None:
    """A JSON record for each bridge with its nested supports."""
    df.write.mode("overwrite").json(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Rows of ``logs.audit_rows`` are added to the audit table."""
    from ..operators.logs import audit_rows

    audit_rows(df).write.mode("append").parquet(path)


SCHEMAS = {"standard": STANDARD, "catalog": CATALOG, "model": MODEL}
