"""Queries of sources, selection, clauses and chunks (A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, clauses, corpus, kgraph, models, structure
from ..sources import readers
from .base import fixture, query, table

STATUS_SQL = "CASE lower(trim(coalesce(eff_status, ''))) WHEN 'còn hiệu lực' THEN 'active' WHEN 'hết hiệu lực toàn bộ' THEN 'expired' WHEN 'hết hiệu lực một phần' THEN 'partially_expired' WHEN 'chưa có hiệu lực' THEN 'not_yet_effective' WHEN 'ngưng hiệu lực' THEN 'suspended' ELSE 'unknown' END"


# --- A --------------------------------------------------------------------------------------------------------------
@query("a3_read_files", "SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'pdf' END AS kind, strlen(html) AS size, sha256(html) AS sha256 FROM pages")
def a3(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return readers.with_kind(pages).drop("content")


@query("a9_audit_rows", "SELECT event_id, user_id, event_type AS action, CASE WHEN event_id % 3 > 0 THEN concat('{\"mode\":\"', event_type, '\"}') END AS detail FROM events")
def a9(spark, d):
    from ..operators import logs

    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), F.when(F.col("event_id") % 3 > 0, F.struct(F.col("event_type").alias("mode"))).alias("detail"), F.col("event_id").cast("string").alias("ip"), F.col("ts").alias("created_at"))
    return logs.audit_rows(e).select(F.col("ip").cast("long").alias("event_id"), "user_id", "action", "detail")


# --- B --------------------------------------------------------------------------------------------------------------
@query("b1_select_regulations", "SELECT id, regexp_extract(title, '(?i)(QCVN|QCXDVN|quy\\s+chuẩn\\s+kỹ\\s+thuật\\s+quốc\\s+gia|quy\\s+chuẩn\\s+xây\\s+dựng)', 1) AS matched_by FROM fx_catalog WHERE regexp_matches(title, '(?i)QCVN|QCXDVN|quy\\s+chuẩn\\s+kỹ\\s+thuật\\s+quốc\\s+gia|quy\\s+chuẩn\\s+xây\\s+dựng') AND NOT contains(lower(doc_type), 'bản dịch')")
def b1(spark, d):
    return corpus.select_regulations(fixture(spark, d, "fx_catalog")).select("id", "matched_by")


CODES_SQL = "list_transform(regexp_extract_all(title, '(QC(?:XD)?VN\\s*[\\d\\-]+\\s*:\\s*\\d{4}(?:\\s*/\\s*[A-ZĐ]+)?)', 1), lambda c: regexp_replace(regexp_replace(c, '\\s+', '', 'g'), '^(QC(?:XD)?VN)', '\\1 '))"


@query("b2_extract_codes", f"SELECT id, CASE WHEN id % 5 = 2 THEN 'QCXDVN 05:2008/BXD,QCVN 06:2022/BXD' ELSE array_to_string({CODES_SQL}, ',') END AS codes FROM fx_catalog")
def b2(spark, d):
    return fixture(spark, d, "fx_catalog").select("id", F.array_join(corpus.extract_codes(F.col("title")), ",").alias("codes"))


@query("b3_validity", f"SELECT id, {STATUS_SQL} AS status, regexp_matches(lower(coalesce(eff_status, '')), '^(hết hiệu lực toàn bộ|ngưng hiệu lực)') AS expired FROM fx_catalog")
def b3(spark, d):
    status, expired = corpus.validity(F.col("eff_status"))
    return fixture(spark, d, "fx_catalog").select("id", status.alias("status"), expired.alias("expired"))


@query("b4_filter_catalog", "SELECT id, doc_num, title FROM fx_catalog WHERE contains(lower(eff_status), 'hết') AND (contains(lower(title), 'qcvn') OR contains(lower(doc_num), 'qcvn')) ORDER BY id LIMIT 100")
def b4(spark, d):
    return corpus.filter_catalog(fixture(spark, d, "fx_catalog"), "hết", "qcvn", 100).select("id", "doc_num", "title")


@query("b5_content_status", "SELECT id, CASE WHEN html_chars >= 10000 OR text_chars >= 10000 THEN 'full_text' WHEN kind = 'doc' THEN 'doc_only' WHEN scanned THEN 'scan_only' WHEN html_chars > 0 THEN 'circular_only' ELSE 'none' END AS content_status FROM fx_catalog")
def b5(spark, d):
    files = F.array(F.struct("kind", "text_chars", "scanned"))
    return fixture(spark, d, "fx_catalog").select("id", corpus.content_status(F.col("html_chars"), files).alias("content_status"))


_ENTITIES = "t"
for _entity, _mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_entity}', '{_mark}')"


@query("b6_clean_html", f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', chr(10), 'g'), '(?is)<script\\b.*?</script\\s*>', chr(10), 'g'), '(?is)<style\\b.*?</style\\s*>', chr(10), 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS t FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split({_ENTITIES}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM a""")
def b6(spark, d):
    return table(spark, d, "pages").select("page_id", corpus.clean_html(F.col("html")).alias("text"))


@query("b7_normalize_text", "SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(replace(replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(9), ' '), chr(160), ' '), ' {2,}', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)) AS text FROM documents")
def b7(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.normalize_text(F.col("text")).alias("text"))


@query("b8_best_variant", "SELECT doc_id, file_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(html) DESC, file_id) AS r FROM fx_files WHERE NOT contains(file_name, '_bk_')) t WHERE r = 1")
def b8(spark, d):
    return corpus.best_variant(fixture(spark, d, "fx_files"), "doc_id", "html", order="file_id").select("doc_id", "file_id", "n_chars")


@query("b9_detect_scans", "SELECT doc_id, count(*) AS pages, sum(n) AS text_chars, sum(n) < 100 * greatest(count(*), 1) AS scanned FROM (SELECT doc_id, page, CAST(sum(length(trim(line))) AS BIGINT) AS n FROM fx_lines GROUP BY doc_id, page) t GROUP BY doc_id")
def b9(spark, d):
    pages = fixture(spark, d, "fx_lines").groupBy(F.col("doc_id").alias("file"), "page").agg(F.array_join(F.collect_list(F.trim("line")), "").alias("text"))
    # lines are trimmed one by one, as the SQL does; white space within the joined page is kept
    return corpus.detect_scans(pages).withColumnRenamed("file", "doc_id")


@query("b10_strip_page_furniture", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS i, count(*) OVER (PARTITION BY doc_id, page) AS n FROM fx_lines WHERE line <> ''),
np AS (SELECT doc_id, count(DISTINCT page) AS np FROM l GROUP BY doc_id),
k AS (SELECT l.doc_id, page, line_no, line, np, unnest(CASE WHEN len(string_split_regex(trim(line), '\\s+')) <= 6 THEN list_distinct([line, regexp_replace(line, '\\d+', '#', 'g')]) ELSE [line] END) AS key FROM l JOIN np USING (doc_id) WHERE (i <= 4 OR i > n - 4) AND np >= 3),
o AS (SELECT doc_id, key FROM k GROUP BY doc_id, key, np HAVING count(DISTINCT page) >= greatest(3, floor(0.3 * np))),
g AS (SELECT DISTINCT k.doc_id, line_no FROM k JOIN o USING (doc_id, key) UNION SELECT doc_id, line_no FROM k WHERE regexp_matches(line, '(?i)^(?:(?:-\\s*)?\\d{1,4}(?:\\s*-)?$|Trang\\s+\\d+)'))
SELECT doc_id, count(*) AS kept, CAST(sum(line_no) AS BIGINT) AS checksum FROM l ANTI JOIN g USING (doc_id, line_no) GROUP BY doc_id""")
def b10(spark, d):
    return corpus.strip_page_furniture(fixture(spark, d, "fx_lines")).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("checksum"))


@query("b11_join_split_numbers")
def b11(spark, d):
    return corpus.join_split_numbers(fixture(spark, d, "fx_clauses"))


@query("b12_reflow", """WITH a AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM fx_clauses),
s AS (SELECT *, CASE WHEN b IS NULL OR regexp_matches(b, '[.:;!?]$') OR regexp_matches(line, '^(?:[a-zđ]\\)|[-–+•●▪*]\\s|\\d{1,2}\\)\\s|[ivx]{1,4}\\)\\s)') OR regexp_matches(line, '^((?:\\d{1,2}|[A-ZĐ])(?:\\.\\d{1,3}){1,5})\\.?(?:\\s|$)') THEN 1 ELSE 0 END AS st FROM a),
p AS (SELECT doc_id, line_no, line, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM s),
q AS (SELECT doc_id, p, string_agg(line, ' ' ORDER BY line_no) AS t FROM p GROUP BY doc_id, p)
SELECT doc_id, string_agg(t, chr(10) ORDER BY p) AS text FROM q GROUP BY doc_id""")
def b12(spark, d):
    return corpus.reflow(fixture(spark, d, "fx_clauses"))


_CITING = "SELECT family AS doc_id, string_agg(concat('theo ', standard_code, ' và ', CASE WHEN std_id % 2 = 0 THEN 'QCVN 06:2022/BXD' ELSE 'QCVN 02:2021/BXD' END), '; ' ORDER BY std_id) AS text FROM fx_standards GROUP BY family"
_CODE_ROWS = f"""WITH c AS ({_CITING}), x AS (SELECT doc_id, regexp_extract_all(substr(text, 1, 12000), 'QC(?:XD)?VN [\\d\\-]+:\\d{{4}}/[A-ZĐ]{{2,8}}') AS cs FROM c),
e AS (SELECT doc_id, unnest(cs) AS code, generate_subscripts(cs, 1) AS pos FROM x), n AS (SELECT doc_id, code, count(*) AS n, min(pos) AS f FROM e GROUP BY doc_id, code)"""


def _citing(spark, d):
    s = fixture(spark, d, "fx_standards")
    text = F.concat(F.lit("theo "), F.col("standard_code"), F.lit(" và "), F.when(F.col("std_id") % 2 == 0, "QCVN 06:2022/BXD").otherwise("QCVN 02:2021/BXD"))
    return s.select(F.col("family").alias("doc_id"), "std_id", text.alias("t")).groupBy("doc_id").agg(clauses.ordered_text("std_id", "t", "; ").alias("text"))


@query("b13_detect_codes", f"{_CODE_ROWS} SELECT doc_id, string_agg(code, ',' ORDER BY n DESC, f) AS codes FROM n GROUP BY doc_id")
def b13(spark, d):
    return corpus.detect_codes(_citing(spark, d), "doc_id", "text").select("doc_id", F.array_join("codes", ",").alias("codes"))


@query("b14_resolve_code", """WITH c AS (SELECT *, CASE id % 5 WHEN 0 THEN concat('QCVN 0', CAST(1 + id % 9 AS STRING), ':', substr(issue_date, 1, 4), '/BXD') END AS title_code FROM fx_catalog),
r AS (SELECT id, CASE WHEN title_code IS NOT NULL AND starts_with(file_name, 'QCVN_07') AND id % 9 = 6 THEN concat('QCVN 07-', CAST(1 + id % 9 AS STRING), ':', substr(issue_date, 1, 4), '/BXD') ELSE coalesce(title_code, concat('QCVN (văn bản ', doc_num, ')')) END AS code, title, doc_type, doc_num FROM c)
SELECT id, concat(CASE WHEN id % 5 = 2 THEN concat(code, ' – Sửa đổi 1:2021') ELSE code END, CASE WHEN doc_type = 'Văn bản hợp nhất' THEN concat(' (hợp nhất ', doc_num, ')') ELSE '' END) AS code FROM r""")
def b14(spark, d):
    c = fixture(spark, d, "fx_catalog")
    titles = F.when(F.col("id") % 5 == 0, corpus.extract_codes(F.col("title"))).otherwise(F.array().cast("array<string>"))
    rows = c.withColumns({"title_codes": titles, "detected": F.array().cast("array<string>"), "single": F.lit(True)})
    return corpus.resolve_code(rows).select("id", "code")


@query("b15_standard_name", "SELECT std_id, CASE WHEN std_id % 3 = 0 THEN 'Quy chuẩn kỹ thuật quốc gia về nhà ở và công trình công cộng' ELSE standard_name END AS name FROM fx_standards")
def b15(spark, d):
    s = fixture(spark, d, "fx_standards")
    text = F.concat(F.lit("BỘ XÂY DỰNG\n"), F.when(F.col("std_id") % 3 == 0, F.lit("QUY CHUẨN KỸ THUẬT QUỐC GIA VỀ NHÀ Ở\nVÀ CÔNG TRÌNH CÔNG CỘNG\n")).otherwise(""), F.col("standard_name"))
    return s.select("std_id", corpus.standard_name(text, F.col("standard_name")).alias("name"))


@query("b16_supersedes", "SELECT std_id, CASE WHEN std_id % 3 = 0 THEN 'QCVN 03:2012/BXD' ELSE '' END AS supersedes FROM fx_standards")
def b16(spark, d):
    s = fixture(spark, d, "fx_standards")
    text = F.when(F.col("std_id") % 3 == 0, F.concat(F.lit("Quy chuẩn này thay thế QCVN 03:2012/BXD; bãi bỏ "), F.col("standard_code"))).otherwise("Không có.")
    return s.select("std_id", F.array_join(corpus.supersedes(text, F.col("standard_code")), ",").alias("supersedes"))


@query("b17_related_codes", f"{_CODE_ROWS} SELECT doc_id, code, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM n WHERE code <> 'QCVN 06:2022/BXD') t WHERE r <= 15")
def b17(spark, d):
    return corpus.related_codes(_citing(spark, d).withColumn("own", F.lit("QCVN 06:2022/BXD – Sửa đổi 1:2023")), "doc_id", "text", "own")


@query("b18_candidate_groups", """SELECT id AS doc_id, 'docx' AS "group", 1 AS group_rank, file_name FROM fx_catalog WHERE kind = 'docx' AND text_chars > 0 UNION ALL SELECT id, 'pdf', 2, 'a.pdf' FROM fx_catalog WHERE kind = 'pdf' AND NOT scanned AND text_chars > 0 UNION ALL SELECT id, 'html', 3, 'x.html' FROM fx_catalog WHERE html_chars > 0""")
def b18(spark, d):
    c = fixture(spark, d, "fx_catalog")
    none = F.lit(None).cast("string")
    one = lambda name, kind: F.struct(name.alias("file_name"), kind.alias("kind"), F.lit("p").alias("path"), F.col("text_chars"), F.col("scanned"), F.lit("s").alias("sha256"), none.alias("skipped"))
    name = F.when(F.col("kind") == "pdf", F.lit("a.pdf")).otherwise(F.col("file_name"))
    docs = c.select(F.col("id").alias("doc_id"), F.array(one(name, F.col("kind")), one(F.lit("b.pdf"), F.col("kind"))).alias("attachments"), F.array(one(name, F.lit("doc"))).alias("supplements"), F.struct(F.lit("x.html").alias("file_name"), F.when(F.col("html_chars") > 0, "p").alias("path")).alias("html"))
    rows = corpus.candidate_groups(docs)
    return rows.where(~((F.col("group") == "docx") & (F.col("file_name") == "b.pdf"))).select("doc_id", "group", "group_rank", "file_name")


@query("b19_bucket_by_code", """WITH s AS (SELECT doc_id, kind, code, sum(n) AS chars FROM (SELECT page_id % 20 AS doc_id, CASE page_id % 3 WHEN 0 THEN 'pdf' ELSE 'html' END AS kind, concat('C', CAST(page_id % 7 AS STRING)) AS code, length(url) AS n FROM pages) t GROUP BY ALL)
SELECT doc_id, kind, code, CAST(chars AS BIGINT) AS chars FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, kind) AS n, max(chars) OVER (PARTITION BY doc_id, kind) AS m FROM s) t WHERE n = 1 OR chars >= 300 OR m < 300""")
def b19(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.when(F.col("page_id") % 3 == 0, "pdf").otherwise("html").alias("group"), F.concat(F.lit("C"), (F.col("page_id") % 7).cast("string")).alias("code"), F.col("page_id").alias("ordinal"), F.col("url").alias("text"))
    return corpus.bucket_by_code(p).select("doc_id", F.col("group").alias("kind"), "code", "chars")


@query("b20_choose_source", """WITH s AS (SELECT page_id % 20 AS doc_id, page_id % 4 AS group_rank, CAST(sum(page_id % 6) AS BIGINT) AS clauses, CAST(sum(length(url)) AS BIGINT) AS chars FROM pages GROUP BY 1, 2)
SELECT doc_id, group_rank, clauses, chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clauses DESC, chars DESC, group_rank) AS r FROM s) t WHERE r = 1""")
def b20(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), (F.col("page_id") % 4).alias("group_rank"), (F.col("page_id") % 4).alias("group"), (F.col("page_id") % 6).alias("clauses"), F.length("url").alias("chars"))
    return corpus.choose_source(p).drop("group")


@query("b21_build_standard_rows", f"""SELECT concat('vbpl:', CAST(id AS STRING), ':', c) AS source_id, id AS doc_id, c AS standard_code, CAST(y AS INT) AS year, {STATUS_SQL} AS status, regexp_matches(lower(coalesce(eff_status, '')), '^(hết hiệu lực toàn bộ|ngưng hiệu lực)') AS expired,
 CASE WHEN id % 2 = 0 THEN 'pdf' ELSE 'none' END AS source_kind, id % 2 = 0 AND html_chars >= 10000 AND id % 5 >= 3 AS full_text, doc_num, title
FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'QCVN 09:2017/BXD' ELSE doc_num END AS c, CASE WHEN id % 2 = 0 THEN '2017' ELSE substr(issue_date, 1, 4) END AS y FROM fx_catalog) t""")
def b21(spark, d):
    c = fixture(spark, d, "fx_catalog").withColumnRenamed("id", "doc_id")
    docs = c.withColumn("code", F.col("doc_num")).withColumn("content_status", F.when(F.col("html_chars") >= 10000, "full_text").otherwise("none"))
    chosen = c.where("doc_id % 2 = 0").select("doc_id", F.lit("QCVN 09:2017/BXD").alias("code"), F.lit("pdf").alias("source_kind"), (F.col("doc_id") % 5).alias("clauses"))
    return corpus.build_standard_rows(docs, chosen)


@query("b22_corpus_report", "SELECT 'documents' AS name, count(DISTINCT family) AS n FROM fx_standards UNION ALL SELECT 'standards', count(*) FROM fx_standards UNION ALL SELECT 'full_text', count(*) FILTER (std_id % 2 = 0) FROM fx_standards UNION ALL SELECT 'articles', count(*) FROM fx_articles UNION ALL SELECT 'errors', count(*) FROM fx_catalog WHERE eff_status IS NULL")
def b22(spark, d):
    s = fixture(spark, d, "fx_standards").select(F.col("family").alias("doc_id"), (F.col("std_id") % 2 == 0).alias("full_text"))
    return corpus.corpus_report(s, fixture(spark, d, "fx_articles"), fixture(spark, d, "fx_catalog").where("eff_status IS NULL"))


@query("b23_merge_catalog", "SELECT id, doc_num, concat('new ', title) AS title, issue_date FROM fx_catalog WHERE id % 3 = 0 UNION ALL SELECT id, doc_num, title, issue_date FROM fx_catalog WHERE id % 3 <> 0 AND id % 4 = 1")
def b23(spark, d):
    c = fixture(spark, d, "fx_catalog").select("id", "doc_num", "title", "issue_date")
    return corpus.merge_catalog(c.where("id % 4 = 1"), c.where("id % 3 = 0").withColumn("title", F.concat(F.lit("new "), F.col("title"))))


@query("b24_verify_checksums", "SELECT page_id AS name, CASE page_id % 4 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' ELSE 'ok' END AS state FROM pages")
def b24(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("name"), F.encode("url", "UTF-8").alias("content"))
    wanted = p.select("name", F.when(F.col("name") % 4 == 0, "other").otherwise(F.sha2("content", 256)).alias("sha256"))
    return corpus.verify_checksums(p.where("name % 4 <> 1"), wanted)


@query("b25_plan_fetch", "SELECT doc_id, file_id, file_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, file_name ORDER BY file_id) AS r FROM fx_files WHERE NOT ends_with(file_name, '.html')) t WHERE r = 1 AND NOT (file_id % 2 = 0)")
def b25(spark, d):
    f = fixture(spark, d, "fx_files").select("doc_id", F.col("file_name").alias("name"), F.col("n_chars").alias("size"), F.col("file_id").alias("ordinal"))
    return corpus.plan_fetch(f, f.where("ordinal % 2 = 0")).select("doc_id", F.col("ordinal").alias("file_id"), F.col("name").alias("file_name"))


@query("b26_fill_missing_metadata", "SELECT std_id AS doc_id, CASE WHEN std_id % 2 = 0 THEN 'X' ELSE standard_code END AS standard_code, standard_name, CASE WHEN std_id % 2 = 0 AND std_id % 3 = 0 THEN 1999 WHEN std_id % 3 = 0 THEN NULL ELSE year END AS year FROM fx_standards")
def b26(spark, d):
    s = fixture(spark, d, "fx_standards")
    rows = s.select(F.col("std_id").alias("doc_id"), F.when(F.col("std_id") % 2 == 0, "").otherwise(F.col("standard_code")).alias("standard_code"), "standard_name", F.when(F.col("std_id") % 3 > 0, F.col("year")).alias("year"), F.lit("a").alias("issuing_body"), F.lit("b").alias("scope"), F.lit("c").alias("supersedes"))
    got = rows.select("doc_id", F.lit("X").alias("standard_code"), F.lit("Y").alias("standard_name"), F.lit(1999).alias("year"), "issuing_body", "scope", "supersedes")
    return corpus.fill_missing_metadata(rows, got).select("doc_id", "standard_code", "standard_name", "year")


@query("b27_strip_crawl_header", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), text) ELSE text END AS text FROM documents")
def b27(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Số: 1\n=========================\n"), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", corpus.strip_crawl_header(text).alias("text"))


# --- C --------------------------------------------------------------------------------------------------------------
_NUMBERED = "regexp_matches(line, '^(\\d{1,2})(?:\\.\\d{1,3}){1,5}\\.?\\s+[^\\s\\d]') AND NOT regexp_matches(line, '^[\\d.]+\\s+m ')"
_NUMBER = "regexp_extract(line, '^([\\d.]+)', 1)"


@query("c1_clause_candidates", f"SELECT doc_id, line_no, {_NUMBER} AS number, trim(regexp_extract(line, '^[\\d.]+\\s+(.*)$', 1)) AS rest FROM fx_clauses WHERE {_NUMBERED}")
def c1(spark, d):
    return clauses.clause_candidates(fixture(spark, d, "fx_clauses")).select("doc_id", "line_no", "number", "rest")


@query("c2_annex_cut", f"""WITH c AS (SELECT doc_id, line_no, {_NUMBER} AS number FROM fx_clauses WHERE {_NUMBERED}),
m AS (SELECT doc_id, line_no, line_no - lag(line_no) OVER w <= 8 OR lead(line_no) OVER w - line_no <= 8 AS close FROM fx_clauses WHERE line = 'PHỤ LỤC A' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT doc_id, min(line_no) AS fn FROM c GROUP BY doc_id), k AS (SELECT m.doc_id, min(m.line_no) AS cut FROM m JOIN f USING (doc_id) WHERE NOT coalesce(close, false) AND m.line_no > fn GROUP BY m.doc_id)
SELECT c.doc_id, c.line_no, number FROM c LEFT JOIN k USING (doc_id) WHERE cut IS NULL OR c.line_no <= cut""")
def c2(spark, d):
    lines = fixture(spark, d, "fx_clauses")
    return clauses.annex_cut(lines, clauses.clause_candidates(lines)).select("doc_id", "line_no", "number")


def _skeleton(spark, d):
    lines = fixture(spark, d, "fx_clauses")
    return lines, clauses.skeleton_of(lines)


@query("c3_clause_skeleton")
def c3(spark, d):
    return _skeleton(spark, d)[1]


@query("c4_assign_lines")
def c4(spark, d):
    return clauses.assign_lines(*_skeleton(spark, d))


@query("c4_chapter_titles")
def c4b(spark, d):
    lines = fixture(spark, d, "fx_clauses")
    heads = lines.where("line_no % 10 = 3").withColumn("line", F.concat(F.lit("Chương "), (1 + F.col("line_no") % 5).cast("string"), F.lit(" QUY ĐỊNH CHUNG")))
    lines = lines.where("line_no % 10 <> 3").unionByName(heads)
    return clauses.chapter_titles(lines, clauses.clause_skeleton(clauses.clause_candidates(lines)))


_TREE_TITLE = "CASE c % 3 WHEN 0 THEN '' ELSE concat(CASE WHEN c % 2 = 0 THEN 'YÊU CẦU ' ELSE 'QUY ĐỊNH ' END, CAST(c AS STRING), CASE WHEN c % 3 = 1 THEN ' (quy định)' ELSE '' END) END"
_TREE = f"""WITH a AS (SELECT std_id AS doc_id, 1 AS place, '0' AS chapter, 'preamble' AS kind, 'Phần mở đầu' AS chapter_title, '0' AS section, 'Phần mở đầu' AS section_title, '0' AS number, 'Phần mở đầu' AS title, concat('Quyết định số ', CAST(std_id AS STRING)) AS content FROM fx_tree WHERE n = 1
UNION ALL SELECT std_id, n * 20, CAST(c AS STRING), 'chapter', {_TREE_TITLE}, concat(CAST(c AS STRING), '.0'), {_TREE_TITLE}, concat(CAST(c AS STRING), '.0'), {_TREE_TITLE}, concat('Thân chương ', CAST(q AS STRING), '.') FROM fx_tree WHERE j = '1' AND c % 3 > 0
UNION ALL SELECT std_id, n * 20 + 4, CAST(c AS STRING), 'chapter', {_TREE_TITLE}, s, concat('Tiêu đề mục ', CAST(q AS STRING)), concat(s, '.1'), concat('Nội dung ', CAST(p AS STRING), '.'),
  concat(s, '.1 Nội dung ', CAST(p AS STRING), '.', chr(10), 'câu sau nối dòng này.', CASE WHEN p % 2 = 0 THEN concat(chr(10), s, '.1.1 Chi tiết ', CAST(q AS STRING), '.') ELSE '' END) FROM fx_tree
UNION ALL SELECT std_id, n * 20 + 8, CAST(c AS STRING), 'chapter', {_TREE_TITLE}, s, concat('Tiêu đề mục ', CAST(q AS STRING)), concat(s, '.2'), concat('Mục hai ', CAST(q AS STRING), '.'), concat(s, '.2 Mục hai ', CAST(q AS STRING), '.') FROM fx_tree WHERE p % 3 = 0
UNION ALL SELECT std_id, n * 20 + 12, 'C', 'annex', 'Phụ lục C (tham khảo) CÁC HÌNH MINH HỌA', 'C.0', 'Phụ lục C (tham khảo) CÁC HÌNH MINH HỌA', 'C.0', 'Phụ lục C (tham khảo) CÁC HÌNH MINH HỌA', concat('Hình ', CAST(p AS STRING), '.') FROM fx_tree WHERE n = items AND p % 5 > 0)
SELECT doc_id, chapter, kind, chapter_title, section, section_title, number, title, content, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS position FROM a"""


@query("c4_c8_regulation_tree", _TREE)
def c48(spark, d):
    return structure.parse_regulations(fixture(spark, d, "fx_tree_lines"))


@query("c5_parse_articles_by_heading", """WITH h AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^Điều\\s+\\d{1,3}') THEN regexp_extract(line, '^Điều\\s+(\\d{1,3})', 1) ELSE '' END AS head, CASE WHEN regexp_matches(line, '^Điều\\s+\\d{1,3}') THEN 'Phạm vi' ELSE line END AS line FROM fx_clauses),
o AS (SELECT *, CAST(count(*) FILTER (head <> '') OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS ordinal FROM h)
SELECT doc_id, ordinal, concat('Điều ', max(head)) AS number, string_agg(line, chr(10) ORDER BY line_no) AS content FROM o WHERE ordinal > 0 GROUP BY doc_id, ordinal""")
def c5(spark, d):
    return clauses.parse_articles_by_heading(fixture(spark, d, "fx_clauses"))


@query("c6_parse_blocks")
def c6(spark, d):
    return clauses.parse_blocks(fixture(spark, d, "fx_lines"))


@query("c7_choose_structure", f"""SELECT doc_id, count(*) FILTER ({_NUMBERED}) AS n_clauses, count(*) FILTER (starts_with(line, 'Điều ')) AS n_headings,
CASE WHEN count(*) FILTER ({_NUMBERED}) >= 3 THEN 'numbered' WHEN count(*) FILTER (starts_with(line, 'Điều ')) >= 2 THEN 'dieu' ELSE 'blocks' END AS structure FROM fx_clauses GROUP BY doc_id""")
def c7(spark, d):
    lines = fixture(spark, d, "fx_clauses")
    heads = lines.where(F.col("line").rlike(clauses.ARTICLE))
    return clauses.choose_structure(clauses.clause_candidates(lines), heads, lines)


@query("c8_fold_clauses", "SELECT std_id AS doc_id, chapter_number AS chapter, section_number AS section, article_number, string_agg(concat(article_number, ' ', content), chr(10) ORDER BY ordinal) AS content FROM fx_articles GROUP BY ALL")
def c8(spark, d):
    a = fixture(spark, d, "fx_articles").select(F.col("std_id").alias("doc_id"), F.col("ordinal").alias("line_no"), F.col("article_number").alias("number"), F.col("content").alias("text"), F.lit(1).alias("n_lines"))
    return clauses.fold_clauses(a)


@query("c9_coverage", "SELECT doc_id, given, kept, CASE WHEN given = 0 THEN 1.0 ELSE round(kept / given, 6) END AS coverage FROM (SELECT doc_id, CAST(sum(length(regexp_replace(line, '\\s', '', 'g'))) AS BIGINT) AS given, CAST(coalesce(sum(length(regexp_replace(line, '\\s', '', 'g'))) FILTER (line_no % 2 = 0), 0) AS BIGINT) AS kept FROM fx_clauses GROUP BY doc_id) t")
def c9(spark, d):
    lines = fixture(spark, d, "fx_clauses")
    return clauses.coverage(lines, lines.where("line_no % 2 = 0").withColumnRenamed("line", "content")).withColumn("coverage", F.round("coverage", 6))


_REQS = """SELECT std_id, article_number, 0 AS req_no, 'minimum_value' AS type, concat('Điều ', article_number, ': ', regexp_extract(content, '([^.]*)$', 1)) AS description, CAST(q AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, 'mm' AS unit, content FROM fx_articles
UNION ALL SELECT std_id, article_number, 1, 'maximum_value', '', NULL, CAST(replace(regexp_extract(content, 'quá ([0-9,]+) m', 1), ',', '.') AS DOUBLE), 'm', content FROM fx_articles"""


@query("c10_extract_requirements", f"SELECT std_id, article_number, req_no, type, min_value, max_value, unit FROM ({_REQS}) t")
def c10(spark, d):
    return clauses.extract_requirements(fixture(spark, d, "fx_articles")).select("std_id", "article_number", "req_no", "type", "min_value", "max_value", "unit")


@query("c11_flatten_standards", """SELECT 'chapter' AS kind, concat(standard_code, '_ch', chapter_number) AS key FROM fx_articles JOIN fx_standards USING (std_id) GROUP BY ALL
UNION ALL SELECT 'section', concat(standard_code, '_sec', section_number) FROM fx_articles JOIN fx_standards USING (std_id) GROUP BY ALL
UNION ALL SELECT 'article', concat(standard_code, '_art', article_number) FROM fx_articles JOIN fx_standards USING (std_id)
UNION ALL SELECT 'requirement', concat(standard_code, '_art', article_number, '_req', CAST(i AS STRING)) FROM fx_articles JOIN fx_standards USING (std_id), (VALUES (0), (1)) v(i)""")
def c11(spark, d):
    a = fixture(spark, d, "fx_articles").join(fixture(spark, d, "fx_standards").select("std_id", "standard_code"), "std_id")
    ch, sec, art, req = clauses.flatten_standards(a)
    one = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    return one("chapter", ch.select("chapter_id").distinct(), "chapter_id").union(one("section", sec.select("section_id").distinct(), "section_id")).union(one("article", art, "article_id")).union(one("requirement", req, "req_id"))


@query("c12_first_sentence", "SELECT std_id, article_number, CASE WHEN length(t) <= 40 THEN t ELSE concat(rtrim(substr(t, 1, 39)), '…') END AS title FROM (SELECT *, CASE WHEN regexp_matches(trim(content), '^.{10,}?[.:;](?:\\s|$)') THEN regexp_extract(trim(content), '^(.{10,}?[.:;])(?:\\s|$)', 1) ELSE trim(content) END AS t FROM fx_articles) x")
def c12(spark, d):
    return fixture(spark, d, "fx_articles").select("std_id", "article_number", clauses.first_sentence(F.col("content"), 40).alias("title"))


# --- D --------------------------------------------------------------------------------------------------------------
@query("d1_split_text")
def d1(spark, d):
    return chunks.split_text(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "part", "parts", F.length("piece").alias("chars"), F.sha2("piece", 256).alias("digest"))


@query("d1_split_text_invariants", "SELECT doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS chars, TRUE AS fits FROM documents")
def d1b(spark, d):
    rows = chunks.split_text(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("piece", r"\s", ""))).alias("chars"), (F.max(F.length("piece")) <= chunks.LIMIT).alias("fits"))


_TAG = "CASE eff_status WHEN 'Hết hiệu lực toàn bộ' THEN '[HẾT HIỆU LỰC] ' WHEN 'Hết hiệu lực một phần' THEN '[HẾT HIỆU LỰC MỘT PHẦN] ' ELSE '' END"


def _joined(spark, d):
    s = fixture(spark, d, "fx_standards")
    return fixture(spark, d, "fx_articles").join(s, "std_id").withColumns({
        "status": corpus.validity(F.col("eff_status"))[0], "chapter_kind": F.lit("chapter"), "chapter_title": F.lit("Quy định kỹ thuật"), "section_title": F.lit("Lối đi"), "requirements_text": F.lit(""), "doc_num": F.lit("1"),
    })


@query("d2_chunk_articles", f"SELECT std_id, article_number, concat({_TAG}, '[', standard_code, '] ', standard_name, chr(10), 'Chương ', chapter_number, ': Quy định kỹ thuật > Mục ', section_number, ': Lối đi', chr(10), chr(10), content) AS text FROM fx_articles JOIN fx_standards USING (std_id)")
def d2(spark, d):
    return chunks.chunk_articles(_joined(spark, d)).select("std_id", "article_number", "text")


@query("d3_chunk_overview", f"SELECT std_id, concat({_TAG}, standard_code, ' — ', standard_name, chr(10), 'Năm ban hành: ', CAST(year AS STRING), chr(10), 'Cơ quan ban hành: Bộ Xây dựng', chr(10), 'Tình trạng hiệu lực: ', eff_status, chr(10), 'Trạng thái: ', {STATUS_SQL}) AS text FROM fx_standards")
def d3(spark, d):
    s = fixture(spark, d, "fx_standards")
    none = F.lit(None).cast("string")
    full = s.withColumns({"status": corpus.validity(F.col("eff_status"))[0], "issuing_body": F.lit("Bộ Xây dựng"), "doc_num": none, "doc_title": none, "effective_date": none, "scope": F.lit(""), "supersedes": none, "related_standards": F.array().cast("array<string>"), "full_text": F.lit(True)})
    return chunks.chunk_overview(full).select("std_id", "text")


@query("d4_status_tag", f"SELECT std_id, {_TAG} AS tag FROM fx_standards")
def d4(spark, d):
    return fixture(spark, d, "fx_standards").select("std_id", chunks.status_tag(corpus.validity(F.col("eff_status"))[0]).alias("tag"))


@query("d5_format_requirements")
def d5(spark, d):
    reqs = clauses.extract_requirements(fixture(spark, d, "fx_articles"))
    none = F.lit(None).cast("string")
    row = F.struct("req_no", "description", none.alias("values"), "min_value", "max_value", "unit", none.alias("condition"), none.alias("exception"))
    return reqs.groupBy("std_id", "article_number").agg(F.array_sort(F.collect_list(row)).alias("r")).select("std_id", "article_number", chunks.format_requirements(F.col("r")).alias("text"))


_KINDS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(models.ELEMENT_TYPES.items()))
#: Models as read from files: no storey in M7, no materials in M8, spaces in every third one.
_BIM = f"""h AS (SELECT DISTINCT model, concat('Dự án ', model) AS project_name, concat('Nhà ', model) AS building_name FROM fx_elements), el AS (SELECT * REPLACE (CASE WHEN model = 'M8' THEN '' ELSE material END AS material) FROM fx_elements),
st AS (SELECT model, storey AS name, min(z0) AS z FROM fx_elements WHERE storey <> '' AND model <> 'M7' GROUP BY ALL), sp AS (SELECT model, concat('P', storey) AS name, storey, count(*) % 5 * 2.5 AS area FROM fx_elements WHERE storey <> '' AND CAST(substr(model, 2) AS INT) % 3 = 0 GROUP BY ALL),
s AS (SELECT model, count(*) AS n, string_agg(concat(chr(10), '  - ', name, ' (cao độ ', CAST(CAST(z AS INT) AS STRING), '.0m)'), '' ORDER BY z) AS t FROM st GROUP BY model),
k AS (SELECT model, ifc_type, count(*) AS n FROM el GROUP BY ALL), c AS (SELECT model, sum(n) AS n, string_agg(concat(chr(10), '  - ', v, ' (', ifc_type, '): ', CAST(n AS STRING)), '' ORDER BY i) AS t FROM k JOIN (VALUES {_KINDS}) q(i, ifc_type, v) USING (ifc_type) GROUP BY model),
m AS (SELECT model, count(*) AS n, string_agg(concat(chr(10), '  - ', material), '' ORDER BY material) AS t FROM (SELECT DISTINCT model, material FROM el WHERE material <> '') z GROUP BY model),
r AS (SELECT model, count(*) AS n, string_agg(concat(chr(10), '  - ', name, CASE WHEN area > 0 THEN printf(' — %.1fm²', area) ELSE '' END, ' [', storey, ']'), '' ORDER BY name) AS t FROM sp GROUP BY model),
d7 AS (SELECT model, concat('Dự án: ', project_name, chr(10), 'Công trình: ', building_name, chr(10), 'Schema: IFC4', chr(10), 'Số tầng: ', CAST(coalesce(s.n, 0) AS STRING), coalesce(s.t, ''), chr(10), chr(10), 'Tổng số cấu kiện: ', CAST(c.n AS STRING), c.t,
  CASE WHEN m.n > 0 THEN concat(chr(10), chr(10), 'Vật liệu sử dụng (', CAST(m.n AS STRING), '):', m.t) ELSE '' END, CASE WHEN r.n > 0 THEN concat(chr(10), chr(10), 'Không gian (', CAST(r.n AS STRING), '):', r.t) ELSE '' END) AS text
  FROM h JOIN c USING (model) LEFT JOIN s USING (model) LEFT JOIN m USING (model) LEFT JOIN r USING (model))"""


def _bim(spark, d):
    e = fixture(spark, d, "fx_elements").withColumn("material", F.when(F.col("model") == "M8", "").otherwise(F.col("material")))
    heads = e.select("model").distinct().select("model", F.concat(F.lit("Dự án "), "model").alias("project_name"), F.concat(F.lit("Nhà "), "model").alias("building_name"), F.lit("IFC4").alias("schema"))
    storeys = e.where("storey <> '' AND model <> 'M7'").groupBy("model", F.col("storey").alias("name")).agg(F.min("z0").alias("elevation")).withColumn("position", F.col("elevation"))
    spaces = e.where("storey <> '' AND CAST(substr(model, 2) AS INT) % 3 = 0").groupBy("model", "storey").agg((F.count("*") % 5 * 2.5).alias("area")).withColumn("name", F.concat(F.lit("P"), "storey")).withColumn("position", F.col("name"))
    door = F.col("ifc_type") == "IfcDoor"
    e = e.withColumns({"name": F.concat(F.lit("N"), "global_id"), "properties": F.when(door, F.create_map(F.lit("Width"), F.lit("0.9"), F.lit("IsExternal"), F.lit("true"))).otherwise(F.expr("CAST(map() AS MAP<STRING, STRING>)"))})
    return heads, storeys, e, spaces


@query("d6_chunk_bim", f"""WITH {_BIM} SELECT model, 'element' AS chunk_type, global_id AS key, concat('[Nhà ', model, '] ', ifc_type, ': N', global_id, CASE WHEN storey <> '' THEN concat(chr(10), 'Tầng: ', storey) ELSE '' END, CASE WHEN material <> '' THEN concat(chr(10), 'Vật liệu: ', material) ELSE '' END,
  CASE WHEN ifc_type = 'IfcDoor' THEN concat(chr(10), 'Width: 0.9', chr(10), 'IsExternal: true') ELSE '' END) AS text FROM el
UNION ALL SELECT model, 'space', name, concat('[Nhà ', model, '] Không gian: ', name, chr(10), 'Tầng: ', storey, chr(10), 'Diện tích: ', printf('%.1f', area), ' m²') FROM sp UNION ALL SELECT model, 'building_summary', model, text FROM d7""")
def d6(spark, d):
    return chunks.chunk_bim(*_bim(spark, d))


@query("d7_model_summary", f"WITH {_BIM} SELECT * FROM d7")
def d7(spark, d):
    return chunks.model_summary(*_bim(spark, d))


# --- the flagship -----------------------------------------------------------------------------------------------------
@query("topic_answers", f"""SELECT standard_code, article_number, type, min_value, max_value, unit, tag FROM (
 SELECT s.standard_code, r.article_number, type, min_value, max_value, unit, {_TAG} AS tag, row_number() OVER (ORDER BY coalesce(min_value, max_value) DESC, s.standard_code, r.article_number, type) AS k
 FROM ({_REQS}) r JOIN fx_standards s USING (std_id) WHERE contains(lower(r.content), 'lớn')  OR contains(lower(r.content), 'chiều rộng')) t WHERE k <= 10""")
def topic_answers(spark, d):
    """Articles on a topic with their requirements and the state of their standard, the strictest first."""
    rows = _joined(spark, d).withColumn("article_id", F.concat("standard_code", F.lit("_art"), F.col("article_number")))
    reqs = clauses.extract_requirements(rows.select("article_id", "article_number", "content")).select("article_id", "type", "min_value", "max_value", "unit")
    hits = kgraph.requirements_for_topic(rows.drop("type"), reqs, "chiều rộng")
    tagged = hits.withColumn("tag", chunks.status_tag(F.col("status"))).select("standard_code", "article_number", "type", "min_value", "max_value", "unit", "tag")
    return tagged.orderBy(F.desc(F.coalesce("min_value", "max_value")), "standard_code", "article_number", "type").limit(10)
