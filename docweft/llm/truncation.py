"""Texts cut off by field limits or broken transfers.

Four kinds of evidence, each over all rows:

copy    the text is a strict prefix of a longer text elsewhere, by a self-join on hashed prefixes of fixed lengths.
limit   its length in characters or bytes is one at which far more texts end than at the lengths around it, most of
        them without an ending.
mark    it ends with a mark of cutting or in the middle of an escape sequence, entity or character.
open    it ends without a full stop and not like other texts end: shapes of last lines and last words
        that many texts share (signatures, exhibit numbers, "as is just") are endings of filings.

Defined results: null and blank texts are not cut; repeated rows give one result; ties of equal texts are one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut

#: Share of texts, and number, that must share the shape of an ending.
SHARED, LEAST = 0.003, 3
#: Characters at the end of a text that its ending is told from.
TAIL = 300
#: A field limit: so many texts at a length, this many times the mean of the lengths within WINDOW around it.
LIMIT_TEXTS, LIMIT_TIMES, WINDOW = 3, 8.0, 20
# Marks of cutting, remains of escapes, and abbreviations that end no text.
MARKS = (
    r"(?i)(?:\[[^\[\]]*(?:truncated|continued|omitted|cut off)[^\[\]]*\]?|\(continued\)|\[\.\.\.\]|\[…\]"
    r"|\((?:more|cont\.?|snip)\)|<(?:snip|more|cut)>|%[0-9a-f]?|%[0-9a-f]{2}%?|\\u[0-9a-f]{0,4}|\\|&#?[a-z0-9]{0,8}|<[^<>\s]{0,20}|\x{FFFD}|…|[^.\s]\.\.\.)$"
)
DANGLING = r"(?:\b(?:Mr|Mrs|Ms|Dr|Lt|Prof|Messrs|Hon|No|Nos|Sec|Art|art|para|Ex|Dep|Tr|Compl|Br|id|Id|ch|Apt|approx|v|p|St|Nr|Abs|Sr|Sra|Dra|Lic|pág|núm|párr|fl|fls|cf|г|гр|см|ст)|(?<![\p{L}.])\p{L}|\b[ap])\.$"
ENDED = r"[.!?。！？।॥۔؟።။;:…][”“»’\"'」』）)\]]*$"
_FUNCTION = "a|an|and|as|at|by|for|from|in|is|of|on|or|other|such|that|the|to|with"


def _shape(c: Column) -> Column:
    """Digits as 0, capitals as U, names as N."""
    c = F.regexp_replace(c, r"[0-9]+(?:[.,:/–-][0-9]+)*", "0")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{M}])\p{Lu}{2,}(?![\p{L}\p{M}])(?:\s+\p{Lu}{2,}(?![\p{L}\p{M}]))*", "")
    c = F.regexp_replace(c, r"\p{Lu}[\p{L}\p{M}’'-]*(?:\.?\s+\p{Lu}[\p{L}\p{M}’'-]*)*", "N")
    return F.regexp_replace(c, "", "U")


def endings(texts: DataFrame, text: str = "tail") -> DataFrame:
    """texts with line (shape of the last line, if short), unit (of what follows its last full stop) and words (shape of the last three words).

    text holds the last TAIL characters, more than any ending that is looked for.
    """
    last = F.substring_index(text, "\n", -1)
    short = F.when((F.length(last) <= 120) & (F.length(last) < F.length(text)), last)
    unit = F.regexp_extract(last, r"[.!?。！？][”»\"’)]*\s+(\p{Lu}(?:[^.!?]|(?<=\bTel)\.)*|\W+|\[.*)$", 1)
    tail = F.split(_shape(F.right(F.col(text), F.lit(90))), r"\s+")
    words = F.when(F.size(tail) >= 3, F.array_join(F.slice(tail, F.greatest(F.size(tail) - 2, F.lit(1)), 3), " ")).otherwise(F.array_join(tail, " "))
    caps = F.regexp_extract(words, r"(U 0)$", 1)
    return texts.withColumns({"line": _line(short), "unit": _line(F.nullif(unit, F.lit(""))), "words": F.when(caps != "", caps).otherwise(words)})


def _line(c: Column) -> Column:
    """The label that opens a line, else its shape with all but function words as w."""
    label = F.regexp_extract(c, r"^(\p{L}+:)\s", 1)
    shape = F.regexp_replace(_shape(c), rf"(?<![\p{{L}}\d])(?!(?:{_FUNCTION})(?!\p{{L}}))\p{{Ll}}[\p{{Ll}}-]*", "w")
    return F.when(label != "", label).otherwise(shape)


#: Texts are bucketed by their prefixes of 1, 4, 16, 64, .. characters; up to this level the prefixes are short enough to be shipped in place of the texts.
LOW = 4


def prefixes(texts: DataFrame) -> DataFrame:
    """(digest) of the texts of (text) that are strict prefixes of another.

    A text of 4^k to 4^(k+1) characters can only continue in texts of its bucket, those with the same hash of the first 4^k characters. Buckets with such a
    text and another one hand the lengths of these texts to all longer texts, which hash their beginnings of just these lengths; a
    beginning with the digest of a text is its continuation. A bucket has at most 3 * 4^k such lengths, however many texts; no pair of texts is ever formed, and
    copies count once, before the shuffle.
    """
    t = texts.filter("text <> ''").select("text", F.md5("text").alias("digest"), F.length("text").alias("n"))
    own = F.floor((F.length(F.bin("n")) - 1) / 2).cast("int")
    starts = F.transform(F.sequence(F.lit(0), own), lambda k: F.xxhash64(F.left(F.col("text"), F.pow(F.lit(4), k).cast("int"))))
    keys = cut(t.select("digest", "n", own.alias("own"), F.posexplode(starts).alias("level", "bucket")).distinct())
    wanted = keys.groupBy("level", "bucket").agg(F.max(F.col("level") == F.col("own")).alias("has"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("has and lo <> hi").select("level", "bucket")
    short = cut(keys.filter("level = own").join(wanted, ["level", "bucket"]).select("level", "bucket", "n", "digest"))
    lengths = short.groupBy("level", "bucket").agg(F.collect_set("n").alias("lengths"))
    ask = keys.join(lengths, ["level", "bucket"]).select("digest", "level", F.explode("lengths").alias("length"), "n").filter("length < n")
    ask = cut(ask.groupBy("digest", (F.col("level") <= LOW).alias("low")).agg(F.collect_set("length").alias("lengths")))
    found = None
    for low, value in ((True, F.left("text", F.lit(4 ** (LOW + 1)))), (False, F.col("text"))):
        asked = ask.filter(F.col("low") == low).select("digest", "lengths").join(t.select("digest", value.alias("text")), "digest")
        begun = asked.select(F.explode(F.transform("lengths", lambda k: F.md5(F.left(F.col("text"), k)))).alias("digest")).distinct()
        found = begun if found is None else found.unionByName(begun)
    return short.select("digest").join(found, "digest", "left_semi").distinct()


def _limits(texts: DataFrame, size: str) -> DataFrame:
    """(size): the lengths that are limits. The table has a row per length, so its window stays small."""
    counts = texts.groupBy(size).agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))
    around = counts.select(F.explode(F.array(*[F.lit(k) for k in range(-WINDOW, WINDOW + 1) if k])).alias("k"), F.col(size).alias("s"), "n")
    around = around.select((F.col("s") + F.col("k")).alias(size), "n").groupBy(size).agg((F.sum("n") / (2 * WINDOW)).alias("mean"))
    near = counts.join(around, size, "left")
    return near.filter((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.coalesce("mean", F.lit(0.0))) & (F.col("n_open") * 2 > F.col("n"))).select(size)


def truncated_texts(texts: DataFrame) -> DataFrame:
    """(digest, copy, limit, mark, open, tail): the distinct texts of (text) that are cut, by MD5, and by which evidence.

    Whole texts are read for the prefixes, digests and sizes; endings are by definition in the last TAIL characters.
    """
    body = F.regexp_replace(F.right("text", F.lit(2 * TAIL)), r"\s+$", "")
    own = texts.filter("text is not null").select(F.md5("text").alias("digest"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.right(body, F.lit(TAIL)).alias("tail")).filter("tail <> ''")
    t = own.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("chars", "bytes", "tail")])
    end = F.right("tail", F.lit(60))
    t = cut(endings(t).withColumns({
        "ended": end.rlike(ENDED) & ~end.rlike(DANGLING) & ~end.rlike(r"[;:]$"),
        "mark": end.rlike(MARKS) & ~end.rlike(r"[.!?][”\"]?\s*…$"),
    }))
    least = F.greatest(F.lit(LEAST), F.ceil(F.lit(SHARED) * F.lit(t.count())))
    for name in ("line", "words"):
        shared = t.filter(~F.col("ended") & F.col(name).isNotNull()).groupBy(name).count().filter(F.col("count") >= least).select(name, F.lit(True).alias(f"known_{name}"))
        t = t.join(shared, name, "left")
        if name == "line":  # the same closing may stand on the line of the last sentence
            t = t.join(shared.select(F.col(name).alias("unit"), F.lit(True).alias("known_unit")), "unit", "left")
    t = cut(t.select("digest", "chars", "bytes", "mark", "tail", (~F.col("ended") & F.coalesce("known_line", "known_unit", "known_words").isNull()).alias("open")))
    for name in ("chars", "bytes"):
        t = t.join(_limits(t, name).withColumn(f"at_{name}", F.lit(True)), name, "left")
    t = t.join(prefixes(texts).withColumn("copy", F.lit(True)), "digest", "left").select(
        "digest", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("at_chars", "at_bytes", F.lit(False)).alias("limit"), "mark", "open", "tail", "chars"
    )
    return t.filter("copy or limit or mark or open")


def truncated_rows(rows: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows cut off: key, source, evidence), (report: source, n_keys, n_cut, share); sources in lower case, trimmed."""
    r = rows.select(key, F.lower(F.trim(F.col(source))).alias("source"), F.md5(F.col(text)).alias("digest"))
    bad = truncated_texts(rows.select(F.col(text).alias("text")))
    evidence = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("copy", "limit", "mark", "open")]), lambda x: x.isNotNull())
    found = cut(r.join(bad.select("digest", evidence.alias("evidence")), "digest").groupBy(key, "source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence")))
    hit = found.select(key).distinct().withColumn("hit", F.lit(1))
    report = r.select(key, "source").distinct().join(hit, key, "left").groupBy("source").agg(F.count("*").alias("n_keys"), F.count("hit").alias("n_cut"))
    return found, report.withColumn("share", F.round(F.col("n_cut") / F.col("n_keys"), 6))
