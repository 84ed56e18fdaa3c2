"""Structure checks of Markdown and HTML texts: blocks, ids, markers, colours, hierarchies, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = r"B[0-9]+(?:-[0-9]+)+"
# Opening signs of the four kinds of marked words, and colours that texts must not have.
MARKERS = ("「", "<", "{", "（")
FORBIDDEN = r"(?i)(#000(?:000)?|#fff(?:fff)?|#([0-9a-f]{2})\2\2|#([0-9a-f])\3\3|\b(?:black|white|gr[ae]y)\b)(?![0-9a-z])"


def blocks(docs: DataFrame) -> DataFrame:
    """Markdown units of texts: doc_id, pos, kind (heading, list, table, code, paragraph), level, text. Code fences hold as one."""
    fenced = F.split("text", r"(?m)^```[^\n]*$")
    outer = docs.select("doc_id", F.posexplode(fenced).alias("part", "chunk"))
    code = outer.where("part % 2 = 1").select("doc_id", "part", F.lit(0).alias("line"), F.lit("code").alias("kind"), F.lit(0).alias("level"), F.trim(F.regexp_replace("chunk", r"^\n|\n$", "")).alias("text"))
    lines = outer.where("part % 2 = 0").select("doc_id", "part", F.posexplode(F.split("chunk", "\n")).alias("line", "text")).where("trim(text) <> ''")
    mark = F.regexp_extract("text", r"^(#{1,6})\s", 1)
    kind = F.when(mark != "", "heading").when(F.col("text").rlike(r"^\s*([-*+]|[0-9]+[.)])\s"), "list").when(F.col("text").rlike(r"^\s*\|"), "table").otherwise("paragraph")
    return lines.select("doc_id", "part", "line", kind.alias("kind"), F.length(mark).alias("level"), F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")).alias("text")).unionByName(code).withColumn("pos", F.struct("part", "line")).drop("part", "line")


def html_tag(level):
    """Heading level 1 to 4 becomes h2 to h5."""
    return F.concat(F.lit("h"), F.least(level + 1, F.lit(6)))


def node_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NODE), F.lit(0))).alias("id")).distinct()


def missing_ids(source: DataFrame, output: DataFrame) -> DataFrame:
    """Ids of the source that the output of the same document lacks."""
    return node_ids(source).join(node_ids(output), ["doc_id", "id"], "left_anti")


def marker_counts(paragraphs: DataFrame, each: int = 3) -> DataFrame:
    """Add the count of each marker, their sum, and whether each and all stay within the limit."""
    named = {f"m{k}": F.length("text") - F.length(F.replace("text", F.lit(m))) for k, m in enumerate(MARKERS)}
    out = paragraphs.withColumns(named)
    cols = [F.col(c) for c in named]
    return out.withColumn("markers", sum(cols[1:], cols[0])).withColumn("each_ok", F.greatest(*cols) <= each).withColumn("all_ok", F.col("markers") <= each)


def sentence_checks(docs: DataFrame, chars: int = 40, most: int = 5) -> DataFrame:
    """Per document: sentences, those over the limit, whether the number of sentences is allowed."""
    s = F.filter(F.transform(F.split("text", r"[。！？.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.size(s).alias("sentences"), F.size(F.filter(s, lambda x: F.length(x) > chars)).alias("too_long"), (F.size(s) <= most).alias("count_ok"))


def forbidden_colours(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").rlike(FORBIDDEN).alias("forbidden"))


def outline(pages: DataFrame) -> DataFrame:
    """Per HTML page (page_id, html): headings, paragraphs and list items by their opening tags."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return pages.select("page_id", n("<h[1-6][ >]").alias("headings"), n("<p[ >]").alias("paragraphs"), n("<li[ >]").alias("items"))


def lossless(source: DataFrame, output: DataFrame) -> DataFrame:
    """Per document: characters, headings and ids of both, and whether the output keeps them all."""
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", "")
    heads = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    a = source.select("doc_id", F.length(F.regexp_replace(F.regexp_replace("text", r"(?m)^#+\s*", ""), r"\s+", "")).alias("source_chars"), heads("text", r"(?m)^#{1,4}\s").alias("source_headings"))
    b = output.select("doc_id", F.length(strip("text")).alias("output_chars"), heads("text", r"<h[2-5]\b").alias("output_headings"))
    lost = missing_ids(source, output).groupBy("doc_id").agg(F.count("*").alias("lost_ids"))
    both = a.join(b, "doc_id", "left").join(lost, "doc_id", "left").withColumn("lost_ids", F.coalesce("lost_ids", F.lit(0)))
    return both.withColumn("ok", F.coalesce((F.col("output_chars") >= F.col("source_chars")) & (F.col("output_headings") == F.col("source_headings")) & (F.col("lost_ids") == 0), F.lit(False)))


def hierarchy(nodes: DataFrame, children: int = 3, depth: int = 3, steps: int = 3) -> DataFrame:
    """Per parent of ids like B0-1-2: children, and whether their number, their depth and their steps stay within the limits."""
    parts = F.split("id", "-")
    n = nodes.withColumn("parent", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-")).withColumn("level", F.size(parts) - 1).where("level > 0")
    return n.groupBy("parent").agg(F.count("*").alias("children"), ((F.count("*") <= children) & (F.max("level") <= depth) & (F.max("steps") <= steps)).alias("ok"))


def parts_compared(source: DataFrame, output: DataFrame) -> DataFrame:
    """Exact text units omitted, invented or repeated: unit, change, n. Both have a column unit."""
    a, b = source.groupBy("unit").agg(F.count("*").alias("a")), output.groupBy("unit").agg(F.count("*").alias("b"))
    both = a.join(b, "unit", "full_outer").select("unit", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).where("a <> b")
    return both.select("unit", F.when(F.col("b") == 0, "omitted").when(F.col("a") == 0, "invented").when(F.col("b") > F.col("a"), "repeated").otherwise("reduced").alias("change"), F.abs(F.col("a") - F.col("b")).alias("n"))
