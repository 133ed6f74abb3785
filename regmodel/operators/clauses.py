"""Clause structure and numeric requirements of regulation texts (C)."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.arrow import values
from ..functions.storage import stored

# How clauses, annexes, articles, measurements and limits are written.
CLAUSE = r"^((?:\d{1,2}|[A-ZĐ])(?:\.\d{1,3}){1,5})\.?(?:\s+(.*))?$"
MEASUREMENT = r"^(?:\d|(?:mm|cm|m|ha|km|lux|dB|giờ|phút|lần)(?![\p{L}\p{N}_])|m2|m²|m3|m³|%|kg|kN|MPa|°)"
ANNEX = r"^(?:PHỤ\s+LỤC|Phụ\s+lục)\s+([A-ZĐ])(?![\p{L}\p{N}_])[.:]?\s*(.*)$"
ARTICLE = r"^Điều\s+(\d{1,3})\s*[.:]?\s*(.*)$"
UNITS = r"(mm²|mm2|mm|cm|m²|m2|m³|m3|m|km|ha|kN/m²|kN/m2|kN/m³|kN|MPa|kg/m³|kg|phút|giờ|%|lux|dB|°C)(?![\p{L}\p{N}_²³/])"
NUMBER = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)"
NOT_LESS = r"(?:không\s+(?:được\s+)?nhỏ\s+hơn|không\s+(?:được\s+)?thấp\s+hơn|tối\s+thiểu(?:\s+là)?|ít\s+nhất(?:\s+là)?|≥|>=)"
NOT_MORE = r"(?:không\s+(?:được\s+)?lớn\s+hơn|không\s+(?:được\s+)?vượt\s+quá|không\s+quá|tối\s+đa(?:\s+là)?|≤|<=)"
ANNEX_ORDER = "ABCDĐEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CLAUSES = 3
BLOCK_CHARS = 1500
#: Characters of a snippet, and of what it may show behind the match.
SNIPPET, AFTER = 220, 60


def vn_number(text: Column) -> Column:
    """'1.500' is 1500, '1,5' is 1.5, '2.5' is 2.5, '12.000,5' is 12000.5."""
    grouped = text.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    return F.replace(F.when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text), F.lit(","), F.lit(".")).cast("double")


def unit_name(unit: Column) -> Column:
    """m2, m3 and mm2 with their exponents raised."""
    return F.when(unit.isin("m2", "m3", "mm2"), F.translate(unit, "23", "²³")).otherwise(unit)


_SPACE = re.compile("[ \t\n\x0b\f\r]+")


@F.arrow_udf(ArrayType(StructType([StructField("least", BooleanType()), *[StructField(n, StringType()) for n in ("snippet", "number", "unit")]])))
def _cut_limits(marked: pa.Array) -> pa.Array:
    """The limits of texts whose matches are marked, minima before maxima, each with its sentence.  One pass from the left carries the sentence
    begun so far, one from the right what follows, both no longer than a snippet can show."""
    ends, rows = [0], []
    for text in marked.to_pylist():
        head, *pieces = (text or "").split("\x01")
        if pieces:
            pieces = [p.split("\x02") for p in pieces]
            after, behind = "", []
            for found, *_, rest in reversed(pieces):
                behind.append(after)
                after = (found + rest + after)[:AFTER]
            begun, least, most = head, [], []
            for found, word, number, unit, rest in pieces:
                begun = begun[max(begun.rfind("."), begun.rfind("\n")) + 1 :]
                if len(begun) > SNIPPET:
                    begun = _SPACE.sub(" ", begun)[: SNIPPET + 2]
                snippet = begun + found + (rest[:AFTER] + behind.pop())[:AFTER]
                (least if word else most).append((word != "", snippet, number, unit))
                begun += found + rest
            rows += least
            rows += most
        ends.append(len(rows))
    rows = list(zip(*rows, strict=True)) or [[]] * 4
    columns = [pa.array(rows[0], pa.bool_()), *[pa.array(r, pa.string()) for r in rows[1:]]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["least", "snippet", "number", "unit"]))


def _limits(content: Column) -> Column:
    """Array of the limits of a text.  A single pattern reads it once (no match of one kind can overlap one of the other) and marks each match with
    its word, if it is a minimum, its number and its unit; the text is cut there in an Arrow function, as higher-order functions are not compiled."""
    # the first letter is looked at before any of the words is tried
    pattern = rf"(?iu)(?=[ktí≥≤<>])((?:({NOT_LESS})|{NOT_MORE})\s*{NUMBER}\s*{UNITS})"
    return _cut_limits(F.regexp_replace(F.translate(content, "\x01\x02", "\ufffd\ufffd"), pattern, "\x01$1\x02$2\x02$3\x02$4\x02"))


def extract_requirements(df: DataFrame, col: str = "content", number: str = "article_number") -> DataFrame:
    """A row for each numeric limit: req_no from 0 (minima before maxima), type, description, min_value, max_value, unit."""
    out = df.select("*", F.posexplode(_limits(F.col(col))).alias("req_no", "req_"))
    least, value = F.col("req_.least"), vn_number(F.col("req_.number"))
    description = F.concat(F.lit("Điều "), F.col(number), F.lit(": "), F.substring(F.trim(F.regexp_replace("req_.snippet", r"\s+", " ")), 1, SNIPPET))
    return out.select("*", F.when(least, "minimum_value").otherwise("maximum_value").alias("type"), description.alias("description"), F.when(least, value).alias("min_value"), F.when(~least, value).alias("max_value"), unit_name(F.col("req_.unit")).alias("unit")).drop("req_")


def first_sentence(text: Column, limit: int = 160) -> Column:
    """Up to the first sentence end after ten characters; cut with an ellipsis beyond the limit."""
    text = F.trim(text)
    found = F.regexp_extract(text, r"^(.{10,}?[.:;])(?:\s|$)", 1)
    title = F.when(found != "", found).otherwise(text)
    return F.when(F.length(title) <= limit, title).otherwise(F.concat(F.rtrim(F.substring(title, 1, limit - 1)), F.lit("…")))


def flatten_standards(articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C11: chapters, sections, articles and requirements with composite keys.  articles: standard_code, chapter_number,
    section_number, article_number, title, content."""
    code = F.col("standard_code")
    articles = stored(articles.select("standard_code", "chapter_number", "section_number", "article_number", "title", "content"), "articles")  # read four times
    keyed = articles.select(
        "*",
        F.concat(code, F.lit("_ch"), F.col("chapter_number")).alias("chapter_id"),
        F.concat(code, F.lit("_sec"), F.col("section_number")).alias("section_id"),
        F.concat(code, F.lit("_art"), F.col("article_number")).alias("article_id"),
    )
    chapters = keyed.select("standard_code", "chapter_id", "chapter_number").distinct()
    sections = keyed.select("chapter_id", "section_id", "section_number").distinct()
    rows = keyed.select("section_id", "article_id", "article_number", "title", "content")
    reqs = extract_requirements(rows).select("article_id", F.concat("article_id", F.lit("_req"), F.col("req_no").cast("string")).alias("req_id"), "type", "description", "min_value", "max_value", "unit")
    return chapters, sections, rows, reqs


def _candidate() -> tuple[Column, Column, Column]:
    """Number and rest of a line, and whether they make it a candidate."""
    number, rest = F.regexp_extract("line", CLAUSE, 1), F.trim(F.regexp_extract("line", CLAUSE, 2))
    return number, rest, (number != "") & (rest != "") & ~rest.rlike(MEASUREMENT)


def clause_candidates(lines: DataFrame) -> DataFrame:
    """Lines that begin with a clause number and are no measurement or table row: doc_id, line_no, number, rest."""
    number, rest, good = _candidate()
    return lines.select("*", number.alias("number"), rest.alias("rest")).where(good)


def _heads_annex() -> Column:
    head, rest = F.regexp_extract("line", ANNEX, 1), F.trim(F.regexp_extract("line", ANNEX, 2))
    own = F.col("line").startswith("PHỤ LỤC") | (rest == "") | rest.startswith("(")
    return (head != "") & own & ~F.col("line").rlike(r"^(?:PHỤ\s+LỤC|Phụ\s+lục)\s+[A-ZĐ][.,;:]")


def _cut(rows: DataFrame, near: int) -> DataFrame:
    """Candidates among candidates and annex headings (``mark_``).  All windows are by document, so rows are shuffled once and come out by document."""
    doc, mark, at = Window.partitionBy("doc_id"), F.col("mark_"), F.col("line_no")
    seen = lambda order: F.last(F.when(mark, at), ignorenulls=True).over(doc.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    close = F.coalesce(at - seen(at) <= near, F.lit(False)) | F.coalesce(seen(at.desc()) - at <= near, F.lit(False))
    numeric = F.col("number").rlike(r"^\d")
    rows = rows.withColumn("annex_", mark & ~close).withColumn("first_", F.min(F.when(~mark & numeric, at)).over(doc))
    rows = rows.withColumn("cut_", F.min(F.when(F.col("annex_") & (at > F.col("first_")), at)).over(doc))
    return rows.where(~mark & (F.col("cut_").isNull() | ~numeric | (at <= F.col("cut_")))).drop("mark_", "annex_", "first_", "cut_")


def annex_cut(lines: DataFrame, candidates: DataFrame, near: int = 8) -> DataFrame:
    """Candidates without the numeric ones behind the first real annex heading.  Headings within ``near`` lines of another are a
    table of contents."""
    marks = lines.where(_heads_annex()).select("doc_id", "line_no", F.lit(True).alias("mark_"))
    return _cut(candidates.withColumn("mark_", F.lit(False)).unionByName(marks, allowMissingColumns=True), near)


def skeleton_of(lines: DataFrame, near: int = 8) -> DataFrame:
    """C1 to C3 of lines that are read once: ``clause_skeleton`` of ``annex_cut`` of ``clause_candidates``."""
    number, rest, good = _candidate()
    lines = lines.where(F.substring("line", 2, 2).contains(".") | (F.substring("line", 1, 1) == "P"))  # no other line can be one, so the patterns are tried on few
    rows = lines.select("doc_id", "line_no", F.when(good, number).alias("number"), F.when(good, rest).alias("rest"), _heads_annex().alias("mark_"))
    return clause_skeleton(_cut(rows.where("mark_ OR number IS NOT NULL"), near), together=True)


@functools.lru_cache(1 << 16)
def order_key(number: str) -> tuple:
    """Chapters 1..N, then annexes, with Đ after D."""
    head, *rest = number.split(".")
    place = (0, int(head)) if head.isdigit() else (1, ANNEX_ORDER.find(head) if head in ANNEX_ORDER else 99)
    return (*place, *map(int, rest))


def _longest_rise(numbers: list[str]) -> list[int]:
    """Places of a longest strictly rising subsequence; ``ends[k]`` is where the best run of k + 1 ends."""
    tops: list[tuple] = []
    ends: list[int] = []
    before: list[int | None] = []
    for i, key in enumerate(map(order_key, numbers)):
        k = bisect.bisect_left(tops, key)
        before.append(ends[k - 1] if k else None)
        tops[k : k + 1], ends[k : k + 1] = [key], [i]
    out: list[int] = []
    at = ends[-1] if ends else None
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def clause_skeleton(candidates: DataFrame, together: bool = False) -> DataFrame:
    """By document, the longest rising run of clause numbers in reading order.  Documents are streamed, sorted within
    partitions; what is held is one document's candidates, which its lines bound.  ``together``: a document's rows lie in one partition already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, schema = None, [], None

        def risen() -> list[tuple]:
            return [held[i] for i in _longest_rise([row[2] for row in held])]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema, out = batch.schema, []
            for row in zip(*map(values, batch.columns), strict=True):
                if row[0] != doc:
                    out += risen()
                    doc, held = row[0], []
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(risen())

    columns = candidates.select("doc_id", "line_no", "number", "rest")
    return (columns if together else columns.repartition("doc_id")).sortWithinPartitions("doc_id", "line_no", "number").mapInArrow(run, columns.schema)


def _numbered(lines: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) with number and rest of their row of the skeleton, null where there is none.  The row goes before its line
    in one order by document, so that rows are shuffled once and come out by document."""
    none, own = F.lit(None).cast("string"), F.col("own_")
    both = lines.select("doc_id", "line_no", "line", none.alias("number"), none.alias("rest"), F.lit(True).alias("own_"))
    both = both.unionByName(skeleton.select("doc_id", "line_no", none.alias("line"), "number", "rest", F.lit(False).alias("own_")))
    last = F.last(F.when(~own, F.struct("line_no", "number", "rest")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no", "own_"))
    found = F.when(F.col("s_.line_no") == F.col("line_no"), F.col("s_"))
    return both.withColumn("s_", last).where(own).withColumn("s_", found).select("doc_id", "line_no", "line", "s_.number", "s_.rest")


def assign_lines(lines: DataFrame, skeleton: DataFrame) -> DataFrame:
    """C4 (lines to clauses): each line belongs to the clause being read; those before the first make the preamble "0"."""
    at = _numbered(lines, skeleton)
    by = Window.partitionBy("doc_id").orderBy("line_no")
    return at.select("doc_id", "line_no", F.coalesce("rest", "line").alias("line"), F.coalesce(F.last("number", ignorenulls=True).over(by), F.lit("0")).alias("clause"), F.coalesce(F.split(F.last("number", ignorenulls=True).over(by), r"\.")[0], F.lit("0")).alias("chapter"))


def is_upper(text: Column) -> Column:
    """Three letters or more, none of them small."""
    return ~text.rlike(r"\p{Ll}") & (F.length(F.regexp_replace(text, r"\P{L}", "")) >= 3)  # most lines have a small letter early


def heading_title(line: Column, top: Column) -> Column:
    """The title of a line that heads the chapter or annex ``top``, else null."""
    word = r"^(?:CHƯƠNG|Chương|PHẦN|Phần)\s+(\d{1,2})(?![\p{L}\p{N}_])[.:]?\s*(.*)$"
    number = r"^(\d{1,2})\.?\s+(\S.*)$"
    title = F.trim(F.regexp_extract(line, number, 2))
    words = F.size(F.regexp_extract_all(title, F.lit(r"(\p{L}{2,})"), 1))
    plain = (words >= 2) & ~title.rlike(MEASUREMENT) & (F.length(title) <= 150) & ~title.rlike(r"[,;]$")
    rest = F.trim(F.regexp_extract(line, ANNEX, 2))
    annex = (F.regexp_extract(line, ANNEX, 1) == top) & ~line.rlike(r"^(?:PHỤ\s+LỤC|Phụ\s+lục)\s+[A-ZĐ][.,;:]")
    return (
        F.when(F.regexp_extract(line, word, 1) == top, F.trim(F.regexp_extract(line, word, 2)))
        .when((F.regexp_extract(line, number, 1) == top) & plain, title)
        .when(annex, F.rtrim(F.concat(F.lit("Phụ lục "), top, F.lit(" "), rest)))
    )


def chapter_titles(lines: DataFrame, skeleton: DataFrame, reach: int = 6) -> DataFrame:
    """C4 (headings): doc_id, chapter, kind, title, first_line, last_line of each chapter whose heading is among the last ``reach`` lines
    before its first clause.  Upper-case lines and lines in brackets right after the heading belong to the title."""
    doc, top, at = Window.partitionBy("doc_id"), F.split("number", r"\.")[0], F.col("line_no")
    before = F.last("top_", ignorenulls=True).over(doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    marked = _numbered(lines, skeleton).withColumn("top_", top)
    marked = marked.withColumn("start_", F.when(F.col("top_").isNotNull() & (before.isNull() | (before != F.col("top_"))), at))
    marked = marked.withColumn("first_", F.min("start_").over(Window.partitionBy("doc_id", "top_")))
    clause = F.when(F.col("top_").isNotNull(), F.struct(at.alias("at"), F.when(F.col("start_") == F.col("first_"), F.col("top_")).alias("chapter")))
    pending = marked.withColumn("next_", F.last(clause, ignorenulls=True).over(doc.orderBy(at.desc())))  # the frame grows; one that shrinks is computed anew for every row
    pending = pending.where("top_ IS NULL AND next_.chapter IS NOT NULL").select("doc_id", "line_no", "line", "next_.at", "next_.chapter")
    near = pending.withColumn("r_", F.row_number().over(Window.partitionBy("doc_id", "at").orderBy(F.desc("line_no")))).where(F.col("r_") <= reach)
    rows = near.groupBy("doc_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    found = F.get(F.filter(F.transform("ls", lambda x, i: F.struct(heading_title(x["line"], F.col("chapter")).alias("title"), i.alias("i"))), lambda x: x["title"].isNotNull()), F.lit(0))
    tail = F.slice("ls", F.col("h.i") + 2, reach)
    stop = F.get(F.filter(F.transform(tail, lambda x, i: F.when(~(is_upper(x["line"]) | x["line"].startswith("(")), i)), lambda i: i.isNotNull()), F.lit(0))
    more = F.slice("tail_", 1, F.coalesce(F.col("stop_"), F.size("tail_")))
    out = rows.withColumn("h", found).where("h IS NOT NULL").withColumn("tail_", tail).withColumn("stop_", stop).withColumn("more_", more)
    title = F.trim(F.array_join(F.concat(F.array("h.title"), F.transform("more_", lambda x: x["line"])), " "))
    kind = F.when(F.col("chapter").rlike(r"^\d"), "chapter").otherwise("annex")
    head = F.get("ls", F.col("h.i"))["line_no"]
    return out.select("doc_id", "chapter", kind.alias("kind"), title.alias("title"), head.alias("first_line"), (head + F.size("more_")).alias("last_line"))


def parse_articles_by_heading(lines: DataFrame) -> DataFrame:
    """Clauses by "Điều N" headings: doc_id, ordinal from 1, number, content.  Lines before the first are left out."""
    head = F.regexp_extract("line", ARTICLE, 1)
    rest = F.regexp_extract("line", ARTICLE, 2)
    by = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.select("doc_id", "line_no", head.alias("head"), F.when(head == "", F.col("line")).when(rest != "", rest).otherwise(F.concat(F.lit("Điều "), head)).alias("line"))
    own = marked.select("*", F.count_if(F.col("head") != "").over(by).alias("ordinal")).where("ordinal > 0")
    return own.groupBy("doc_id", "ordinal").agg(F.concat(F.lit("Điều "), F.max("head")).alias("number"), ordered_text("line_no", "line").alias("content"))


def ordered_text(order: str, text: str, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def parse_blocks(lines: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """Greedy blocks of lines; a block closes once it holds ``size`` characters."""
    ordered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    start = F.expr("named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', CAST(array() AS ARRAY<STRING>), 'n', 0)")

    def step(a: Column, x: Column) -> Column:
        n, open_ = a["n"] + F.length(x["line"]), F.concat(a["open"], F.array(x["line"]))
        full = F.struct(F.concat(a["done"], F.array(F.array_join(open_, "\n"))).alias("done"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("open"), F.lit(0).alias("n"))
        return F.when(n >= size, full).otherwise(F.struct(a["done"].alias("done"), open_.alias("open"), n.alias("n")))

    done = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"])
    blocks = ordered.select("doc_id", F.posexplode(F.aggregate("ls", start, step, done)).alias("pos", "content"))
    return blocks.select("doc_id", (F.col("pos") + 1).alias("ordinal"), F.concat(F.lit("Đoạn "), (F.col("pos") + 1).cast("string")).alias("number"), "content")


def choose_structure(clauses: DataFrame, headings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, structure: "numbered" from three clauses on, else "dieu" from two headings on, else "blocks"."""
    a = clauses.groupBy("doc_id").agg(F.count("*").alias("n_clauses"))
    b = headings.groupBy("doc_id").agg(F.count("*").alias("n_headings"))
    n, m = F.coalesce("n_clauses", F.lit(0)), F.coalesce("n_headings", F.lit(0))
    return docs.select("doc_id").distinct().join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", n.alias("n_clauses"), m.alias("n_headings"), F.when(n >= MIN_CLAUSES, "numbered").when(m >= 2, "dieu").otherwise("blocks").alias("structure"))


def fold_clauses(clauses: DataFrame) -> DataFrame:
    """Chapter, section, article_number, content.  Level two is a section, and an article unless it is a bare heading (one
    line of at most 80 characters without an end mark); level three is an article; deeper clauses join their article."""
    parts = F.split("number", r"\.")
    level = F.size(parts)
    text = F.col("text")
    bare = (level == 2) & (F.col("n_lines") == 1) & (F.length(text) <= 80) & ~F.rtrim(text).rlike(r"[.:;]$")
    rows = clauses.where(~bare).select("doc_id", "line_no", parts[0].alias("chapter"), F.array_join(F.slice(parts, 1, 2), ".").alias("section"), F.array_join(F.slice(parts, 1, 3), ".").alias("article_number"), F.concat_ws(" ", "number", "text").alias("piece"))
    return rows.groupBy("doc_id", "chapter", "section", "article_number").agg(ordered_text("line_no", "piece").alias("content"))


def coverage(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Kept over given characters that are no space, by document (1 for an empty one)."""
    size = lambda c: F.sum(F.length(F.regexp_replace(c, r"\s", "")))
    given, kept = lines.groupBy("doc_id").agg(size("line").alias("given")), articles.groupBy("doc_id").agg(size("content").alias("kept"))
    return given.join(kept, "doc_id", "left").select("doc_id", "given", F.coalesce("kept", F.lit(0)).alias("kept"), F.when(F.col("given") == 0, 1.0).otherwise(F.coalesce("kept", F.lit(0)) / F.col("given")).alias("coverage"))


def nest_articles(articles: DataFrame, key: str = "standard_code", order: str = "ordinal") -> DataFrame:
    """The inverse of C11: by standard, its chapters with their sections and articles, each in order of its first article.  What comes
    together is one standard.  articles: key, order, chapter_number, section_number, article_number, title, content."""
    text = F.lit(None).cast("string")
    own = F.struct(F.col(order).alias("at"), F.struct(F.col("article_number").alias("number"), "title", "content").alias("x"))
    inner = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda e: e["x"])
    sections = articles.groupBy(key, "chapter_number", "section_number").agg(F.min(order).alias("at"), inner(own).alias("articles"))
    one = F.struct("at", F.struct(F.col("section_number").alias("number"), text.alias("title"), "articles").alias("x"))
    chapters = sections.groupBy(key, "chapter_number").agg(inner(one).alias("sections"), F.min("at").alias("at"))
    one = F.struct("at", F.struct(F.col("chapter_number").alias("number"), text.alias("kind"), text.alias("title"), "sections").alias("x"))
    return chapters.groupBy(key).agg(inner(one).alias("chapters"))


def unnest_articles(standards: DataFrame) -> DataFrame:
    """The articles of nested standards: standard_code, chapter_number, section_number, article_number, title, content."""
    rows = standards.select("standard_code", F.explode("chapters").alias("c"))
    rows = rows.select("standard_code", F.col("c.number").alias("chapter_number"), F.explode("c.sections").alias("s"))
    rows = rows.select("standard_code", "chapter_number", F.col("s.number").alias("section_number"), F.explode("s.articles").alias("a"))
    return rows.select("standard_code", "chapter_number", "section_number", F.col("a.number").alias("article_number"), "a.title", "a.content")
