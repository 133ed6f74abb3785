"""Selecting, cleaning and choosing the sources of regulations (B)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .chunks import lookup
from .clauses import ordered_text

# How regulations, their codes and their validity are written.
REGULATION = r"(?iu)(?<![\p{L}\p{N}_])(?:QCVN|QCXDVN)(?![\p{L}\p{N}_])|(?iu)quy\s+chuẩn\s+kỹ\s+thuật\s+quốc\s+gia|(?iu)quy\s+chuẩn\s+xây\s+dựng"
TITLE_CODE = r"(?<![\p{L}\p{N}_])(QC(?:XD)?VN\s*[\d\-]+\s*:\s*\d{4}(?:\s*/\s*[A-ZĐ]+)?)"
CODE = r"(QC(?:XD)?VN)\s*([\d\-]+)\s*:\s*(\d{4})\s*/\s*([A-ZĐ]{2,8})"
SUPERSEDES = r"(?iu)(?:thay\s+thế|bãi\s+bỏ)[^.;]{0,250}?(QCVN\s*[\d\-]+\s*:\s*\d{4}\s*/\s*[A-ZĐ]{2,8})"
STATUS = {
    "còn hiệu lực": "active",
    "hết hiệu lực toàn bộ": "expired",
    "hết hiệu lực một phần": "partially_expired",
    "chưa có hiệu lực": "not_yet_effective",
    "ngưng hiệu lực": "suspended",
}
FULL_TEXT_CHARS = 10_000
SCAN_CHARS_PER_PAGE = 100
EDGE_LINES = 4
PAGE_NUMBER = r"(?i)^(?:(?:-\s*)?\d{1,4}(?:\s*-)?$|Trang\s+\d+)"
TOC_LEADER = r"(?:\.{4,}|…{2,}|[.…]{3,})\s*\d{1,4}\s*$"
LIST_ITEM = r"^(?:[a-zđ]\)|[-–+•●▪*]\s|\d{1,2}\)\s|[ivx]{1,4}\)\s)"
GROUP_RANK = {"supplement": 0, "docx": 1, "pdf": 2, "html": 3}


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def select_regulations(df: DataFrame, title: str = "title", doc_type: str = "doc_type") -> DataFrame:
    """B1: rows whose title names a regulation, with what matched; translations go.  Both columns are compared composed (NFC)."""
    found = F.regexp_extract(nfc(title), f"({REGULATION})", 1)
    return df.withColumn("matched_by", found).where((F.col("matched_by") != "") & ~F.lower(nfc(F.coalesce(doc_type, F.lit("")))).contains("bản dịch"))


def _tidy(code: Column) -> Column:
    """Spaces of a code as they are meant: QCVN 06:2022/BXD."""
    bare = F.regexp_replace(code, r"\s+", "")
    return F.regexp_replace(bare, r"^(QC(?:XD)?VN)", "$1 ")


def extract_codes(text: Column) -> Column:
    """B2: the codes of a title, each once, as first seen; the agency may be missing."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TITLE_CODE), 1), _tidy))


def validity(eff_status: Column) -> tuple[Column, Column]:
    """(status, expired)."""
    low = F.lower(F.trim(F.coalesce(eff_status, F.lit(""))))
    return F.coalesce(lookup(STATUS, low), F.lit("unknown")), F.lower(F.coalesce(eff_status, F.lit(""))).rlike("^(hết hiệu lực toàn bộ|ngưng hiệu lực)")


def filter_catalog(df: DataFrame, status: str | None = None, keyword: str | None = None, max_docs: int = 0, order: str = "id") -> DataFrame:
    """Part of the status, keyword in title or number, then the first rows."""
    if status:
        df = df.where(F.lower("eff_status").contains(status.lower()))
    if keyword:
        df = df.where(F.lower("title").contains(keyword.lower()) | F.lower("doc_num").contains(keyword.lower()))
    return df.orderBy(order).limit(max_docs) if max_docs else df


def content_status(html_chars: Column, files: Column) -> Column:
    """full_text, doc_only, scan_only, circular_only or none; files: array of structs with kind, text_chars, scanned."""
    long_ = F.exists(files, lambda f: F.coalesce(f["text_chars"], F.lit(0)) >= FULL_TEXT_CHARS)
    return (
        F.when((html_chars >= FULL_TEXT_CHARS) | long_, "full_text")
        .when(F.exists(files, lambda f: F.coalesce(f["kind"] == "doc", F.lit(False))), "doc_only")
        .when(F.exists(files, lambda f: F.coalesce(f["scanned"], F.lit(False))), "scan_only")
        .when(html_chars > 0, "circular_only")
        .otherwise("none")
    )


def clean_html(html: Column) -> Column:
    """The text of a page: no scripts, styles or tags, one piece a line, trimmed, without empty lines; the usual entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", "\n")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFC; line ends, tabs and no-break spaces; zero-width spaces go; runs of spaces are one; lines are trimmed."""
    text = nfc(text) if compose else text
    flat = F.replace(F.replace(F.translate(F.regexp_replace(text, "\r\n|\r", "\n"), "\u00a0\t", "  "), F.lit("\u200b"), F.lit("")), F.lit("\ufeff"), F.lit(""))
    return F.array_join(F.transform(F.split(F.regexp_replace(flat, " {2,}", " "), "\n"), lambda x: F.trim(x)), "\n")


def best_variant(df: DataFrame, key: str, text: str, name: str = "file_name", order: str = "ordinal") -> DataFrame:
    """Of a document's variants the one with the longest text, the first of equals; backups ("_bk_") don't count."""
    by = Window.partitionBy(key).orderBy(F.desc(F.length(text)), order)
    return df.where(~F.col(name).contains("_bk_")).withColumn("r_", F.row_number().over(by)).where("r_ = 1").drop("r_")


def detect_scans(pages: DataFrame) -> DataFrame:
    """By file: pages, text_chars and whether it is a scan: fewer than 100 trimmed characters a page."""
    out = pages.groupBy("file").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).alias("text_chars"))
    return out.withColumn("scanned", F.col("text_chars") < SCAN_CHARS_PER_PAGE * F.greatest("pages", F.lit(1)))


def strip_page_furniture(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """Lines (doc_id, page, line_no, line) without running heads and page numbers.  Among the first and last four lines of a page,
    a page number goes, and so does a line that is at the edge of many pages: as it is, or with its digits blanked if it has at
    most six words.  Documents of fewer than three pages stay as they are."""
    lines = lines.where("line <> ''")
    page = Window.partitionBy("doc_id", "page")
    n_pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    at = lines.withColumn("i_", F.row_number().over(page.orderBy("line_no"))).withColumn("n_", F.count("*").over(page))
    edge = (F.col("i_") <= EDGE_LINES) | (F.col("i_") > F.col("n_") - EDGE_LINES)
    short = F.size(F.split(F.trim("line"), r"\s+")) <= 6
    keys = F.when(short, F.array_distinct(F.array("line", F.regexp_replace("line", r"\d+", "#")))).otherwise(F.array("line"))
    marked = at.withColumn("edge_", edge).withColumn("keys_", keys).join(n_pages, "doc_id")
    seen = marked.where("edge_ AND n_pages >= 3").select("doc_id", "page", "n_pages", F.explode("keys_").alias("key")).distinct()
    often = seen.groupBy("doc_id", "key").agg(F.count("*").alias("k"), F.first("n_pages").alias("np")).where(F.col("k") >= F.greatest(F.lit(3), F.floor(share * F.col("np")))).select("doc_id", "key")
    gone = marked.where("edge_ AND n_pages >= 3").select("doc_id", "line_no", F.explode("keys_").alias("key")).join(often, ["doc_id", "key"]).select("doc_id", "line_no").distinct()
    numbers = marked.where(F.col("edge_") & (F.col("n_pages") >= 3) & F.col("line").rlike(PAGE_NUMBER)).select("doc_id", "line_no")
    return lines.join(gone.union(numbers).distinct(), ["doc_id", "line_no"], "left_anti").select("doc_id", "page", "line_no", "line")


def join_split_numbers(lines: DataFrame) -> DataFrame:
    """Without lines of a table of contents; a clause number alone on its line takes the next one (unless that is a measurement),
    a chapter number a title in capitals (unless that is a clause).
    A line that was taken can't take: in a run of such lines every other one takes."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.where((F.col("line") != "") & ~F.col("line").rlike(TOC_LEADER)).withColumns({"next_": F.lead("line").over(by), "n_": F.row_number().over(by)})
    alone = F.col("line").rlike(r"^(?:\d{1,2}|[A-ZĐ])(?:\.\d{1,3}){1,5}\.?$")
    measure = F.col("next_").rlike(r"^(?:\d|(?:mm|cm|m|ha|km|lux|dB|giờ|phút|lần)(?![\p{L}\p{N}_])|m2|m²|m3|m³|%|kg|kN|MPa|°)")
    head = F.col("line").rlike(r"^\d{1,2}\.?$") & F.col("next_").rlike(r"\p{Lu}.*\p{Lu}.*\p{Lu}") & ~F.col("next_").rlike(r"\p{Ll}|^(?:\d{1,2}|[A-ZĐ])(?:\.\d{1,3})+")
    rows = rows.withColumn("wants_", F.col("next_").isNotNull() & ((alone & ~measure) | head))
    rows = rows.withColumn("k_", F.col("n_") - F.coalesce(F.max(F.when(~F.col("wants_"), F.col("n_"))).over(by), F.lit(0)))  # place in its run
    rows = rows.withColumn("takes_", F.col("wants_") & (F.col("k_") % 2 == 1)).withColumn("taken_", F.coalesce(F.lag("takes_").over(by), F.lit(False)))
    joined = F.when(F.col("takes_"), F.concat(F.regexp_replace("line", r"\.$", ""), F.lit(" "), F.col("next_"))).otherwise(F.col("line"))
    return rows.where("NOT taken_").select("doc_id", "line_no", joined.alias("line"))


def begins(before: Column) -> Column:
    """Whether the line starts anew behind the line ``before``: it is the first or a list item or clause, or that one has ended."""
    return before.isNull() | before.rlike(r"[.:;!?]$") | opens(F.col("line"))


def opens(line: Column) -> Column:
    """Whether the line is a list item or a clause."""
    return line.rlike(LIST_ITEM) | line.rlike(r"^((?:\d{1,2}|[A-ZĐ])(?:\.\d{1,3}){1,5})\.?(?:\s|$)")


def reflow(lines: DataFrame, group: str | list[str] = "doc_id") -> DataFrame:
    """A text a group (one or more columns): lines are joined but before list items, clauses and after ``. : ; ! ?``."""
    group = [group] if isinstance(group, str) else group
    by = Window.partitionBy(*group).orderBy("line_no")
    rows = lines.withColumn("s_", begins(F.lag("line").over(by)).cast("int")).withColumn("p_", F.sum("s_").over(by))
    parts = rows.groupBy(*group, "p_").agg(ordered_text("line_no", "line", " ").alias("t_"))
    return parts.groupBy(*group).agg(ordered_text("p_", "t_").alias("text"))


def code_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, code, n, first: how often each code stands in a text and where it comes first."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(rf"((?<![\p{{L}}\p{{N}}_]){CODE})"), 1), _tidy)
    return df.select(key, F.posexplode(codes).alias("pos", "code")).groupBy(key, "code").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def detect_codes(df: DataFrame, key: str, col: str, limit: int = 12000) -> DataFrame:
    """Key and the codes in the head of a text, the most frequent first, ties by first place."""
    rows = code_counts(df, key, F.substring(col, 1, limit))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "code"))), lambda x: x["code"]).alias("codes"))


def resolve_code(df: DataFrame) -> DataFrame:
    """The code of a source file.  df: file_name, title_codes, detected (arrays), issue_date (text), title, doc_type, doc_num, single.
    Cascade: part number in the file's name, the title's only code, a detected code of the issue year or the year before, the first
    detected one, the title's only code, the document's number; then suffixes for amendments and consolidated texts."""
    titles, detected = F.coalesce("title_codes", F.array().cast("array<string>")), F.coalesce("detected", F.array().cast("array<string>"))
    part = lambda i: F.regexp_extract("file_name", r"(?i)QCVN[\s_]*(\d{1,2})[-_.](\d{1,2})(?!\d)", i)
    base = F.split(F.regexp_extract(F.get(titles, F.lit(0)), CODE, 2), "-")[0]
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    head = lambda i: F.regexp_extract(F.get(titles, F.lit(0)), CODE, i)
    from_part = F.when((part(1) != "") & (base != "") & (bare(base) == bare(part(1))), F.concat(head(1), F.lit(" "), base, F.lit("-"), part(2).cast("int").cast("string"), F.lit(":"), head(3), F.lit("/"), head(4)))
    only = F.when(F.size(titles) == 1, F.get(titles, F.lit(0)))
    year = F.substring(F.coalesce("issue_date", F.lit("")), 1, 4).cast("int")
    near = F.get(F.filter(detected, lambda c: F.regexp_extract(c, CODE, 3).cast("int").isin(year, year - 1)), F.lit(0))
    number = F.regexp_replace("doc_num", " ", "")
    code = F.coalesce(from_part, F.when(F.col("single"), only), near, F.get(detected, F.lit(0)), only, F.concat(F.lit("QCVN (văn bản "), number, F.lit(")")))
    change = lambda i: F.regexp_extract(F.coalesce("title", F.lit("")), r"(?iu)Sửa\s+đổi\s+(\d+)\s*:\s*(\d{4})", i)
    code = F.when((change(1) != "") & ~code.contains("Sửa đổi"), F.concat(code, F.lit(" – Sửa đổi "), change(1), F.lit(":"), change(2))).otherwise(code)
    whole = F.lower(F.coalesce("doc_type", F.lit(""))).contains("hợp nhất")
    return df.withColumn("code", F.when(whole, F.concat(code, F.lit(" (hợp nhất "), number, F.lit(")"))).otherwise(code))


def standard_name(text: Column, title: Column) -> Column:
    """The heading of 31 characters or more in the first 6,000, with up to two upper-case lines after it that carry no code; else
    the title."""
    lines = F.filter(F.split(normalize_text(F.substring(text, 1, 6000), compose=False), "\n"), lambda x: x != "")
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?iu)^QUY\s+CHUẨN\s+KỸ\s+THUẬT\s+QUỐC\s+GIA") & (F.length(x) > 30), i)), lambda i: i.isNotNull()), F.lit(0))
    more = F.filter(F.slice(lines, at + 2, 2), lambda x: (x == F.upper(x)) & x.rlike(r"\p{L}") & ~x.rlike(CODE))
    name = F.trim(F.regexp_replace(F.array_join(F.concat(F.array(F.get(lines, at)), more), " "), r"\s+", " "))
    return F.when(at.isNotNull(), F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, F.length(name))))).otherwise(F.coalesce(title, F.lit("")))


def supersedes(preamble: Column, own: Column) -> Column:
    """Codes that a preamble replaces, each once, without the own one."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(preamble, F.lit("")), F.lit(SUPERSEDES), 1))
    return F.filter(found, lambda c: ~own.contains(c))


def related_codes(df: DataFrame, key: str, col: str, own: str, k: int = 15) -> DataFrame:
    """The codes that a text cites most, without its own base code: key, code, n, rank."""
    base = F.split(F.split(F.col(own), " –")[0], r" \(")[0]
    rows = code_counts(df, key, F.col(col)).join(df.select(key, base.alias("base_")), key).where("code <> base_")
    by = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(key, "code", "n", "rank")


def candidate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group, group_rank and file of all sources with text.  docs: doc_id, supplements, attachments (arrays of structs file_name, kind,
    path, text_chars, scanned, sha256, skipped, ordinal), html (struct file_name, path).  Of equal PDFs the first stays."""
    def files(col: str, group: str, keep: str) -> DataFrame:
        rows = docs.select("doc_id", F.lit(group).alias("group"), F.lit(GROUP_RANK[group]).alias("group_rank"), F.posexplode(col).alias("ordinal", "f"))
        return rows.select("doc_id", "group", "group_rank", "ordinal", "f.file_name", "f.kind", "f.path", "f.text_chars", "f.scanned", "f.sha256", "f.skipped").where("skipped IS NULL AND coalesce(path, '') <> ''").where(keep)

    sup = files("supplements", "supplement", "kind IN ('pdf', 'docx') AND NOT coalesce(scanned, false)")
    docx = files("attachments", "docx", "kind = 'docx' AND coalesce(text_chars, 0) > 0")
    pdf = files("attachments", "pdf", "kind = 'pdf' AND NOT coalesce(scanned, false) AND coalesce(text_chars, 0) > 0")
    pdf = pdf.withColumn("r_", F.row_number().over(Window.partitionBy("doc_id", "sha256").orderBy("ordinal"))).where("r_ = 1").drop("r_")
    html = docs.where("html.path IS NOT NULL").select("doc_id", F.lit("html").alias("group"), F.lit(GROUP_RANK["html"]).alias("group_rank"), F.lit(0).alias("ordinal"), "html.file_name", F.lit("html").alias("kind"), "html.path")
    columns = ["doc_id", "group", "group_rank", "ordinal", "file_name", "kind", "path"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in (sup, docx, pdf, html)])


def bucket_by_code(files: DataFrame, least: int = 300) -> DataFrame:
    """A text for each document, group and code; of several codes those under 300 characters go, unless all would."""
    sums = files.groupBy("doc_id", "group", "code").agg(F.sum(F.length("text")).alias("chars"), ordered_text("ordinal", "text").alias("text"))
    whole = Window.partitionBy("doc_id", "group")
    n, most = F.count("*").over(whole), F.max("chars").over(whole)
    return sums.withColumns({"n_": n, "m_": most}).where((F.col("n_") == 1) | (F.col("chars") >= least) | (F.col("m_") < least)).drop("n_", "m_")


def choose_source(scored: DataFrame) -> DataFrame:
    """By document the group with most clauses, then characters; of equals the earlier.  scored: doc_id, group, group_rank, clauses, chars."""
    sums = scored.groupBy("doc_id", "group", "group_rank").agg(F.sum("clauses").alias("clauses"), F.sum("chars").alias("chars"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("clauses"), F.desc("chars"), "group_rank")
    return sums.withColumn("r_", F.row_number().over(by)).where("r_ = 1").drop("r_")


def build_standard_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for each document and code; documents without text give one of metadata only.  docs: doc_id, doc_num, title, issue_date,
    eff_status, content_status, code; chosen: doc_id, code, source_kind, clauses."""
    j = docs.withColumnRenamed("code", "own_code").join(chosen, "doc_id", "left").withColumn("standard_code", F.coalesce("code", "own_code"))
    year = F.coalesce(F.nullif(F.regexp_extract("standard_code", CODE, 3), F.lit("")), F.substring("issue_date", 1, 4))
    status, expired = validity(F.col("eff_status"))
    full = (F.col("content_status") == "full_text") & F.col("source_kind").isNotNull() & (F.coalesce("clauses", F.lit(0)) >= 3)
    return j.select(
        F.concat(F.lit("vbpl:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("standard_code")).alias("source_id"), "doc_id", "standard_code", F.coalesce(year.cast("int"), F.lit(0)).alias("year"),
        status.alias("status"), expired.alias("expired"), F.coalesce("source_kind", F.lit("none")).alias("source_kind"), F.coalesce(full, F.lit(False)).alias("full_text"), "doc_num", "title",
    )


def corpus_report(standards: DataFrame, articles: DataFrame, errors: DataFrame) -> DataFrame:
    """Name, n: documents, standards, full_text, articles, errors."""
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rows = [one("documents", standards, F.count_distinct("doc_id")), one("standards", standards, F.count("*")), one("full_text", standards, F.count_if("full_text")), one("articles", articles, F.count("*")), one("errors", errors, F.count("*"))]
    return reduce(DataFrame.unionByName, rows)


def merge_catalog(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows, and the old ones whose id is not among them, the last issued first."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns)).orderBy(F.desc("issue_date"), F.desc("doc_num"))


def catalog_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("content_status", F.lit("?")).alias("content_status")).agg(F.count("*").alias("n"))


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files with ok, changed or missing.  files: name, content; expected: name, sha256."""
    got = files.select("name", F.sha2("content", 256).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("changed")
    return expected.join(got, "name", "left").select("name", state.alias("state"))


def plan_fetch(listing: DataFrame, stored: DataFrame, suffixes: tuple[str, ...] = (".pdf", ".docx", ".doc")) -> DataFrame:
    """Files (doc_id, name, size, ordinal) still to fetch: allowed ending, no template, names without entities once each, and not stored with
    that size."""
    name = F.replace(F.replace(F.replace(F.replace("name", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    rows = listing.withColumn("name", name)
    good = reduce(Column.__or__, [F.lower("name").endswith(s) for s in suffixes]) & ~F.lower("name").endswith("template.pdf")
    by = Window.partitionBy("doc_id", "name").orderBy("ordinal")
    once = rows.where(good).withColumn("r_", F.row_number().over(by)).where("r_ = 1").drop("r_")
    return once.join(stored.select("doc_id", "name", "size"), ["doc_id", "name", "size"], "left_anti")


def fill_missing_metadata(df: DataFrame, extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Empty code and name from a second table; year, issuer, scope and supersedes too, but only where code or name was empty."""
    critical, optional = ["standard_code", "standard_name"], ["year", "issuing_body", "scope", "supersedes"]
    j = df.alias("a").join(extracted.select(key, *[F.col(c).alias(f"x_{c}") for c in critical + optional]), key, "left")
    missing = reduce(Column.__or__, [empty(F.col(c).cast("string")) for c in critical])
    fill = lambda c, when: F.when(when & empty(F.col(c).cast("string")), F.coalesce(f"x_{c}", c)).otherwise(F.col(c))
    return j.select(*[(fill(c, F.lit(True) if c in critical else missing) if c in critical + optional else F.col(c)).alias(c) for c in df.columns])


def strip_crawl_header(text: Column) -> Column:
    """What follows the first line of twenty or more "="; the whole text without one."""
    parts = F.split(text, r"(?m)^={20,}\s*$", 2)
    return F.when(F.size(parts) == 2, parts[1]).otherwise(text)
