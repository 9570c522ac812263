"""Markdown sources: memory and skill files, their front matter, sections and chunks."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(source_path, sha, mtime, tool, text) of whole files. Spark lists no hidden folders below path, so give those as paths."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("sha"), F.unix_seconds("modificationTime").alias("mtime"), T.tool_of(F.col("path")).alias("tool"), F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n").alias("text"))


def front_matter(text: Column) -> Column:
    """The key: value lines between the first two --- lines, as a map."""
    lines = F.split(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1), "\n")
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")


def h2_lines(docs: DataFrame) -> DataFrame:
    """(id, n, line, fenced, section) of docs (id, text): a line in a code fence is fenced, and one with ## outside begins a section."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.startswith("line", F.lit("```"))
    fenced = lines.withColumn("fenced", (F.sum(mark.cast("int")).over(w) % 2 == 1) | mark)
    head = F.startswith("line", F.lit("## ")) & ~F.col("fenced")
    return fenced.withColumn("section", F.sum(head.cast("long")).over(w))


def sections(docs: DataFrame) -> DataFrame:
    """(id, position, title, text, has_code): the part before the first ## and each section; empty ones are left out."""
    g = h2_lines(docs).groupBy("id", F.col("section").alias("position")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"), F.max("fenced").alias("has_code"))
    text = T.strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    title = F.when(F.col("position") > 0, T.strip(F.expr("substring(ls[0].line, 4)")))
    return g.select("id", "position", title.alias("title"), text.alias("text"), "has_code").where("text <> ''")


def memory_chunks(files: DataFrame) -> DataFrame:
    """Chunks of memory files (id, text): one without ##, else one for the part before and one for each section."""
    rows = files.select("id", F.regexp_replace("text", "\r\n", "\n").alias("text")).withColumn("meta", front_matter(F.col("text")))
    cut = sections(rows.select("id", body(F.col("text")).alias("text")))
    chunk = cut.join(rows.select("id", "meta"), "id")
    kind = F.when(F.col("position") == 0, "intro").otherwise("h2")
    return chunk.select("id", "position", kind.alias("section_kind"), "title", "text", "has_code", F.col("meta")["name"].alias("name"), F.col("meta")["description"].alias("description"), F.col("meta")["type"].alias("memory_type"))


def skill_chunks(files: DataFrame) -> DataFrame:
    """Chunks of skill files: a summary (description and first paragraph) and each section."""
    rows = files.select("id", F.regexp_replace("text", "\r\n", "\n").alias("text")).withColumn("meta", front_matter(F.col("text")))
    cut = sections(rows.select("id", body(F.col("text")).alias("text"))).join(rows.select("id", "meta"), "id")
    intro = T.strip(F.regexp_replace(F.split("text", r"\n\s*\n")[0], "(?m)^# .*$", ""))
    first = F.concat_ws("\n\n", F.col("meta")["description"], F.when(intro != "", intro))
    return cut.select("id", "position", F.when(F.col("position") == 0, "skill_summary").otherwise("skill_section").alias("doc_type"), "title", F.when(F.col("position") == 0, first).otherwise(F.col("text")).alias("text"), "has_code")


def observation_text(kind: Column, title: Column, narrative: Column, facts: Column) -> Column:
    """[type] title, narrative and facts as bullets, parts that are empty left out."""
    head = F.trim(F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(title, F.lit(""))))
    told = F.when(T.strip(narrative) != "", T.strip(narrative))
    listed = F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda f: F.concat(F.lit("• "), f)), "\n"))
    return F.concat_ws("\n\n", head, told, listed)


def split_text(text: str, target: int) -> list[str]:
    """Pieces of at most target tokens (words), cut at the coarsest border that does: headings, paragraphs, sentences, lines, words, characters."""
    import re

    if len(text.split()) <= target and len(text) <= target * 16:
        return [text] if text.strip() else []
    for border in (r"\n(?=## )", r"\n(?=### )", r"\n\s*\n", r"(?<=[.!?])\s+", r"\n", r"\s+"):
        parts = [p for p in re.split(border, text) if p.strip()]
        if len(parts) > 1:
            glue = "\n\n" if border == r"\n\s*\n" else "\n" if "\\n" in border else " "
            out, now, size = [], "", 0
            for p in parts:
                n = len(p.split())
                if now and (size + n > target or len(now) + len(p) > target * 16):
                    out.append(now)
                    now, size = "", 0
                now, size = (now + glue + p if now else p), size + n
            out.append(now)
            return [x for piece in out for x in (split_text(piece, target) if piece != text else [piece])]
    return [text[i : i + target * 16] for i in range(0, len(text), target * 16)]


#: fixed values: tokens that embedding models take at most
MODEL_LIMITS = {
    "voyage-4-large": 32_000, "voyage-4-lite": 32_000, "voyage-3-large": 32_000, "voyage-3.5": 32_000, "voyage-3.5-lite": 32_000,
    "voyage-3-lite": 32_000, "voyage-code-3": 32_000, "voyage-code-2": 16_000, "voyage-finance-2": 32_000, "voyage-law-2": 16_000,
    "voyage-4-nano": 512, "text-embedding-3-large": 8_192, "text-embedding-3-small": 8_192, "text-embedding-ada-002": 8_192,
}


def model_limit(model: Column, default: int = 512) -> Column:
    """The limit of a model by its name, with or without its maker before a slash; unknown ones get the default."""
    limits = F.create_map(*(F.lit(x) for pair in MODEL_LIMITS.items() for x in pair))
    return F.coalesce(F.try_element_at(limits, F.substring_index(model, "/", -1)), F.lit(default))


def split_for_limit(chunks: DataFrame, limit_tokens: int = 512) -> DataFrame:
    """chunks (id, text) cut to three quarters of a model's limit: (id, split_index, split_total, text)."""
    target = max(1, limit_tokens * 3 // 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, len(ps), p) for i, ps in ((i, split_text(t or "", target)) for i, t in zip(pdf["id"], pdf["text"], strict=True)) for k, p in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["id", "split_index", "split_total", "text"])

    return chunks.select("id", "text").mapInPandas(run, "id long, split_index int, split_total int, text string")
