"""Chunks of texts and sections, as column expressions; nothing here leaves the JVM or shuffles except section grouping by document.

Null and empty texts give no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import rules as R
from docweft.functions import text as T


def starts(n: Column, width: int, overlap: int) -> Column:
    """Starts of windows over n things: one if they fit, else steps of width - overlap until a window reaches the end."""
    step = max(1, width - overlap)
    return F.when(n <= width, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((n - width) / step).cast("int")), lambda k: k * step))


def char_chunks(df: DataFrame, text: str, width: int, overlap: int) -> DataFrame:
    """df without text, with start_char, end_char and chunk; windows of white space alone are left out."""
    if overlap >= width:
        raise ValueError("the overlap must be smaller than the chunk")
    cut = df.withColumn("start_char", F.explode(starts(F.length(text), width, overlap)))
    chunk = F.substring(text, F.col("start_char") + 1, F.lit(width))
    return cut.withColumns({"end_char": F.least(F.col("start_char") + width, F.length(text)), "chunk": chunk}).filter(F.trim("chunk") != "").drop(text)


def sentence_chunks(df: DataFrame, sentences: str, width: int, overlap: int) -> DataFrame:
    """df without sentences, with chunk_no, first_id and last_id (from 1) and chunk (an array)."""
    cut = df.select("*", F.posexplode(starts(F.size(sentences), width, overlap)).alias("chunk_no", "__s"))
    return cut.withColumns({"first_id": F.col("__s") + 1, "last_id": F.least(F.col("__s") + width, F.size(sentences)), "chunk": F.slice(sentences, F.col("__s") + 1, F.lit(width))}).drop(sentences, "__s")


def paragraph_chunks(df: DataFrame, text: str, most: int) -> DataFrame:
    """df without text, with chunk_no and chunk: paragraphs joined while they stay within most characters; a longer one stands alone."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), T.strip), lambda p: p != "")
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 2 + F.length(p) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws("\n\n", F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p)))

    packed = df.filter(F.col(text).isNotNull()).withColumn("__c", F.aggregate(paragraphs, none, step))
    return packed.select("*", F.posexplode("__c").alias("chunk_no", "chunk")).drop(text, "__c")


def section_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line, section): content lines with the header they stand under.

    Lines before the first header belong to it; a text without headers has null sections.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("k", "raw")).select(key, (F.col("k") + 1).alias("line_no"), T.strip(F.col("raw")).alias("line"))
    lines = lines.withColumn("head", R.is_section_header(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("line_no")
    header = F.when(F.col("head"), F.col("line"))
    lines = lines.withColumn("section", F.last(header, ignorenulls=True).over(so_far))
    first = F.first(header, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lines.withColumn("section", F.coalesce("section", first)).filter(~F.col("head") & ~R.is_junk_line(F.col("line"))).drop("head")


def section_chunks(df: DataFrame, key: str, text: str, most: int, overlap: int) -> DataFrame:
    """(key, section_no, section, start_char, end_char, chunk): sections in order of their headers, PREAMBLE before the first."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("k", "line"))
    lines = lines.withColumn("head", R.is_section_header(F.col("line")))
    no = F.sum(F.col("head").cast("int")).over(Window.partitionBy(key).orderBy("k"))
    lines = lines.withColumn("section_no", no)
    body = lines.groupBy(key, "section_no").agg(F.max(F.when(F.col("head"), F.left(F.col("line"), F.lit(50)))).alias("section"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return char_chunks(body.withColumn("section", F.coalesce("section", F.lit("PREAMBLE"))).filter(F.length("body") > 0), "body", most, overlap)


def chunk(df: DataFrame, strategy: str, key: str, text: str, most: int = 12_000, overlap: int = 200, sentences: str | None = None, sentence_width: int = 50, sentence_overlap: int = 5) -> DataFrame:
    """The chunks of a strategy: char, paragraph, sentence (of the array column sentences) or section; another one is a ValueError."""
    if strategy == "char":
        return char_chunks(df, text, most, overlap)
    if strategy == "paragraph":
        return paragraph_chunks(df, text, most)
    if strategy == "sentence":
        if sentences is None:
            raise ValueError("the strategy sentence needs the column of sentences")
        return sentence_chunks(df, sentences, sentence_width, sentence_overlap)
    if strategy == "section":
        return section_chunks(df, key, text, most, overlap)
    raise ValueError(f"no such strategy: {strategy}; there are char, paragraph, sentence and section")


def merge_sections(sections: DataFrame, key: str, least: int = 10) -> DataFrame:
    """(key, form, name, sentences) from (key, section_no, name, sentence_no, sentence): sections of the same normal name as one, under the first name seen, with
    each sentence of at least so many characters once, in order; sections without any are left out. Null names pool under the empty form.
    """
    at = F.struct("section_no", "sentence_no", "sentence")
    rows = sections.withColumns({"form": F.coalesce(T.norm_text(F.col("name")), F.lit("")), "same": T.norm_text(F.col("sentence"))})
    names = rows.groupBy(key, "form").agg(F.min_by("name", F.struct("section_no", "name")).alias("name"))
    once = rows.filter(F.length("same") >= least).groupBy(key, "form", "same").agg(F.min(at).alias("at"))
    kept = once.groupBy(key, "form").agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["sentence"]).alias("sentences"))
    return kept.join(names, [key, "form"]).select(key, "form", "name", "sentences")


def facts_section(text: Column) -> Column:
    """From the facts header on; the whole text if there is none."""
    at = F.regexp_instr(text, F.lit("(?i)factual background|statement of facts"))
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)


#: White space of all scripts, and that within a line. A header is sought from the last line break before it, so that runs of blanks cost no time.
_BLANK, _IN_LINE = r"[\s\x1c-\x1f]", r"[\s\x1c-\x1f&&[^\n]]"
FACTS_TIERS = (rf"\n{_IN_LINE}*(?:(?:III|II|I)\.{_BLANK}*)?(?:factual )?(?:background|history|facts){_IN_LINE}*\n", rf"\n{_IN_LINE}*relevant facts{_IN_LINE}*\n")
OPINION_TIERS = tuple(rf"\n{_IN_LINE}*{w}" for w in ("memorandum", "opinion", "decision"))
DISCUSSION = rf"\n{_IN_LINE}*(?:discussion|analysis){_IN_LINE}*\n"


def facts_body(text: Column) -> Column:
    """What follows the first facts header; else what lies between MEMORANDUM, OPINION or DECISION and DISCUSSION or ANALYSIS; else the whole text."""
    flags = "(?iU)"
    strip = lambda c: F.regexp_replace(c, rf"(?U)\A{_BLANK}+|(?<!{_BLANK}){_BLANK}+\z", "")
    after = lambda p: F.when(text.rlike(flags + p), strip(F.regexp_extract(text, rf"{flags}{p}((?s:.*))", 1)))
    before = lambda c: strip(F.get(F.split(c, flags + DISCUSSION, 2), F.lit(0)))
    return F.coalesce(*[after(p) for p in FACTS_TIERS], *[before(after(p)) for p in OPINION_TIERS], text)
