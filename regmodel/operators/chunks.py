"""Retrieval chunks from articles, standards and building models (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import ELEMENT_TYPES

LIMIT = 1200
#: The tags of regulations that are not in force.
STATUS_TAGS = {
    "expired": "HẾT HIỆU LỰC",
    "partially_expired": "HẾT HIỆU LỰC MỘT PHẦN",
    "not_yet_effective": "CHƯA CÓ HIỆU LỰC",
    "suspended": "NGƯNG HIỆU LỰC",
}


def lookup(values: dict, key: Column) -> Column:
    """A small constant table as an expression; null where the key is not in it."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def status_tag(status: Column) -> Column:
    """D4: "[HẾT HIỆU LỰC] " and the like, empty for the rest."""
    return F.coalesce(lookup({k: f"[{v}] " for k, v in STATUS_TAGS.items()}, status), F.lit(""))


def _pack(units: Column, limit: int, glue: str) -> Column:
    """Joins units with glue as long as they fit the limit, in order."""
    empty = F.expr("named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', '')")

    def step(a: Column, u: Column) -> Column:
        closes = (a["open"] != "") & (F.length(a["open"]) + F.length(u) + 1 > limit)
        grown = F.when(a["open"] == "", u).otherwise(F.concat(a["open"], F.lit(glue), u))
        return F.struct(F.when(closes, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(closes, u).otherwise(grown).alias("open"))

    return F.aggregate(units, empty, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def split_parts(text: Column, limit: int = LIMIT) -> Column:
    """Pieces of at most limit characters: paragraphs are packed, too long ones by sentences (after ``. ; :``), too
    long sentences are cut.  No text is lost but the white space at the cuts."""

    def cuts(sentence: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(sentence), F.lit(1)) - 1) / limit).cast("int")), lambda i: F.substring(sentence, i * limit + 1, F.lit(limit)))

    sentences = lambda p: F.flatten(F.transform(F.split(p, r"(?<=[.;:])\s+"), cuts))
    paragraph = lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(_pack(sentences(p), limit, " "))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(_pack(F.flatten(F.transform(F.split(text, "\n"), paragraph)), limit, "\n"))


def split_text(df: DataFrame, col: str, limit: int = LIMIT) -> DataFrame:
    """A row for each piece: part from 1, parts, piece."""
    pieces = df.withColumn("pieces_", split_parts(F.col(col), limit))
    return pieces.select("*", F.posexplode("pieces_").alias("pos_", "piece")).withColumns({"part": F.col("pos_") + 1, "parts": F.size("pieces_")}).drop("pieces_", "pos_")


def chapter_label(kind: Column, number: Column, title: Column) -> Column:
    title = F.coalesce(title, F.lit(""))
    own = lambda other: F.when(title != "", title).otherwise(other)
    label = F.rtrim(F.concat(F.lit("Chương "), number, F.lit(": "), title))
    return (
        F.when(kind == "annex", own(F.concat(F.lit("Phụ lục "), number)))
        .when(kind == "preamble", "Phần mở đầu (thông tư ban hành, lời nói đầu)")
        .when(kind == "text", own(F.lit("Toàn văn")))
        .otherwise(F.regexp_replace(label, "[: ]+$", ""))
    )


def chunk_articles(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks of articles under their standard, chapter and section.  df: standard_code, standard_name, status, chapter_kind,
    chapter_number, chapter_title, section_number, section_title, article_number, title, content, requirements_text, doc_num."""
    numbered = F.startswith("content", F.concat("article_number", F.lit(" ")))
    body = F.when(numbered, F.col("content")).otherwise(F.concat(F.lit("Điều "), F.col("article_number"), F.lit(": "), F.col("title"), F.lit("\n"), F.col("content")))
    rows = split_text(df.withColumn("body_", body), "body_", limit)
    part = F.when(F.col("parts") > 1, F.concat(F.lit(" (phần "), F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))).otherwise("")
    section = F.regexp_replace(F.concat(F.lit("Mục "), F.col("section_number"), F.lit(": "), F.coalesce("section_title", F.lit(""))), "[: ]+$", "")
    reqs = F.coalesce("requirements_text", F.lit(""))
    own = (reqs != "") & (F.col("part") == F.col("parts")) & (F.coalesce("doc_num", F.lit("")) == "")
    text = F.concat(
        status_tag(F.col("status")), F.lit("["), F.col("standard_code"), F.lit("] "), F.col("standard_name"), F.lit("\n"),
        chapter_label(F.col("chapter_kind"), F.col("chapter_number"), F.col("chapter_title")), F.lit(" > "), section, part, F.lit("\n\n"), F.col("piece"),
        F.when(own, F.concat(F.lit("\n\n"), reqs)).otherwise(""),
    )
    return rows.withColumn("text", text).drop("body_", "piece").withColumn("chunk_type", F.lit("article"))


def chunk_overview(df: DataFrame) -> DataFrame:
    """D3: one chunk for each standard; lines without a value are left out, but for year, issuer and status."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda label, c: F.when(value(c) != "", F.concat(F.lit(label), value(c)))
    issued = F.when(value("doc_num") != "", F.concat(F.lit("Văn bản ban hành: "), F.when(value("doc_title") != "", value("doc_title")).otherwise(value("doc_num"))))
    lines = F.array(
        F.concat(status_tag(F.col("status")), F.col("standard_code"), F.lit(" — "), F.col("standard_name")),
        F.concat(F.lit("Năm ban hành: "), value("year")), F.concat(F.lit("Cơ quan ban hành: "), value("issuing_body")), issued,
        line("Tình trạng hiệu lực: ", "eff_status"), line("Ngày có hiệu lực: ", "effective_date"), line("Phạm vi: ", "scope"),
        F.concat(F.lit("Trạng thái: "), F.coalesce("status", F.lit("active"))), line("Thay thế: ", "supersedes"),
        F.when(F.size("related_standards") > 0, F.concat(F.lit("Tiêu chuẩn liên quan: "), F.array_join("related_standards", ", "))),
        F.when(~F.col("full_text"), F.lit("Lưu ý: chưa có toàn văn quy chuẩn dạng chữ (chỉ có văn bản ban hành hoặc bản scan).")),
    )
    return df.withColumn("text", F.array_join(F.array_compact(lines), "\n")).withColumn("chunk_type", F.lit("overview"))


def format_requirements(reqs: Column) -> Column:
    """Requirements as text.  reqs: array of structs with description, values (a JSON object), min_value, max_value, unit,
    condition, exception; empty for none."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))

    def pairs(json: Column, glue: str) -> Column:
        return F.map_entries(F.from_json(F.coalesce(json, F.lit("{}")), "map<string,string>"))

    def values(r: Column) -> Column:
        inner = lambda v: F.when(v.startswith("{"), F.array_join(F.transform(pairs(v, ", "), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")).otherwise(v)
        return F.transform(pairs(r["values"], "\n"), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), inner(e["value"])))

    def lines(r: Column) -> Column:
        limit = lambda label, c: F.when(r[c].isNotNull(), F.concat(F.lit(f"  {label}: "), text(r[c]), F.lit(" "), text(r["unit"])))
        note = lambda label, c: F.when(r[c].isNotNull(), F.concat(F.lit(f"  {label}: "), r[c]))
        tail = F.array(limit("Giá trị tối thiểu", "min_value"), limit("Giá trị tối đa", "max_value"), note("Điều kiện", "condition"), note("Ngoại lệ", "exception"))
        return F.concat(F.array(F.concat(F.lit("• "), text(r["description"]))), values(r), F.array_compact(tail))

    return F.when(F.size(reqs) > 0, F.array_join(F.concat(F.array(F.lit("Yêu cầu kỹ thuật:")), F.flatten(F.transform(reqs, lines))), "\n")).otherwise("")


def _plain(number: Column) -> Column:
    """A number with at least one digit after the point, and no exponent below 1e18."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e18), F.concat(number.cast("long").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))


def model_summary(heads: DataFrame, storeys: DataFrame, elements: DataFrame, spaces: DataFrame) -> DataFrame:
    """A text for each row of heads (model, project_name, building_name, schema): its storeys with their elevations, the number of
    elements by class, materials and spaces; parts that a model lacks are left out.  storeys: model, position, name, elevation;
    elements: model, ifc_type, material; spaces: model, position, name, storey, area."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def listed(df: DataFrame, name: str, text: Column, *order: Column | str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("t_"))))
        return df.groupBy("model").agg(F.transform(rows, lambda x: x["t_"]).alias(name))

    counts = elements.where(F.col("ifc_type").isin(list(ELEMENT_TYPES))).groupBy("model", "ifc_type").agg(F.count("*").alias("n"))
    name = F.create_map(*[F.lit(x) for p in ELEMENT_TYPES.items() for x in p])[F.col("ifc_type")]
    place = F.array_position(F.array(*map(F.lit, ELEMENT_TYPES)), F.col("ifc_type")).alias("p_")
    area = F.when(F.coalesce("area", F.lit(0.0)) != 0, F.format_string(" — %.1fm²", F.col("area").cast("double"))).otherwise("")
    parts = [
        listed(storeys, "s", line("  - ", F.col("name"), " (cao độ ", _plain(F.col("elevation").cast("double")), "m)"), "position"),
        listed(counts, "c", line("  - ", name, " (", F.col("ifc_type"), "): ", F.col("n").cast("string")), place),
        listed(elements.where("material <> ''").select("model", "material").distinct(), "m", line("  - ", F.col("material")), "material"),
        listed(spaces, "r", line("  - ", F.col("name"), area, " [", F.coalesce("storey", F.lit("")), "]"), "position"),
        counts.groupBy("model").agg(F.sum("n").alias("total")),
    ]
    rows = heads
    for part in parts:
        rows = rows.join(part, "model", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(line("\n", title, " (", size(c), "):")), F.col(c)))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    top = F.array(line("Dự án: ", F.coalesce("project_name", F.lit(""))), line("Công trình: ", F.coalesce("building_name", F.lit(""))), line("Schema: ", F.coalesce("schema", F.lit(""))), line("Số tầng: ", size("s")))
    total = F.array(line("\nTổng số cấu kiện: ", F.coalesce("total", F.lit(0)).cast("string")))
    text = F.array_join(F.concat(top, F.coalesce("s", none), total, F.coalesce("c", none), F.coalesce(block("Vật liệu sử dụng", "m"), none), F.coalesce(block("Không gian", "r"), none)), "\n")
    return rows.select("model", text.alias("text"))


def chunk_bim(heads: DataFrame, storeys: DataFrame, elements: DataFrame, spaces: DataFrame) -> DataFrame:
    """A chunk for each model (its summary), element and space: model, chunk_type, key, text.  As for ``model_summary``; elements: also
    global_id, name, storey, properties (a map), which are lines of their own in the map's order."""
    named = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    building = heads.select("model", F.concat(F.lit("["), F.coalesce("building_name", F.lit("")), F.lit("] ")).alias("b_"))
    lines = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    text = F.concat_ws("\n", F.concat("b_", F.col("ifc_type"), F.lit(": "), F.col("name")), named("Tầng: ", "storey"), named("Vật liệu: ", "material"), F.when(F.size("properties") > 0, F.array_join(lines, "\n")))
    own = elements.join(building, "model").select("model", F.lit("element").alias("chunk_type"), F.col("global_id").alias("key"), text.alias("text"))
    area = F.format_string("%.1f", F.coalesce(F.col("area").cast("double"), F.lit(0.0)))
    room = spaces.join(building, "model").select("model", F.lit("space").alias("chunk_type"), F.col("name").alias("key"), F.concat("b_", F.lit("Không gian: "), F.col("name"), F.lit("\nTầng: "), F.coalesce("storey", F.lit("")), F.lit("\nDiện tích: "), area, F.lit(" m²")).alias("text"))
    whole = model_summary(heads, storeys, elements, spaces).select("model", F.lit("building_summary").alias("chunk_type"), F.col("model").alias("key"), "text")
    return own.unionByName(room).unionByName(whole)
