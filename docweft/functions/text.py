"""Column functions on text: normal forms, tokens, keys, predicates and rule labels.

Null in gives null out, unless said otherwise; blank text is treated like missing text where a function says "missing".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = "a an and are as at be by for from has have he in is it its of on or she that the their they this to was were will with".split()
NOT_DISTRICT = ("ca", "uscfc", "usca", "arb", "neb", "nysb")


def strip(c: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def norm_text_any(c: Column) -> Column:
    """As norm_text, with the white space of all scripts (no-break, ideographic and the like)."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")))


def missing(c: Column) -> Column:
    """Null for null and blank."""
    return F.nullif(strip(c), F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[missing(c) for c in cols])


def which_nonempty(**cols: Column) -> Column:
    """The name of the first column that has a value."""
    return F.coalesce(*[F.when(missing(c).isNotNull(), F.lit(k)) for k, c in cols.items()])


def tokens(c: Column, pattern: str = r"[a-z0-9_]+") -> Column:
    """Words of the lower-case text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def token_set(c: Column, pattern: str = r"[a-z0-9_]+") -> Column:
    return F.array_distinct(tokens(c, pattern))


def content_tokens(c: Column) -> Column:
    """Words of three letters and more but stopwords."""
    return F.array_except(token_set(c, r"[a-z][a-z0-9_]{2,}"), F.array(*map(F.lit, STOPWORDS)))


def fts_terms(c: Column) -> Column:
    """Distinct prefix terms of a question: words of three letters and more, else all."""
    t = token_set(c)
    long = F.filter(t, lambda x: F.length(x) >= 3)
    return F.when(F.size(long) > 0, long).otherwise(t)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")


def docket_number_id(number: Column, url: Column) -> Column:
    """A docket id from a number, else from the path of a URL."""
    return F.coalesce(F.expr("null").cast("bigint") if number is None else number.try_cast("bigint"), F.regexp_extract(url, r"/dockets/(\d+)", 1).try_cast("bigint"))


def caption_parties(c: Column) -> Column:
    """Both sides of a caption parted at v. or v, the first of these marks that parts it; one element if it has no two sides."""

    def sides(sep: str) -> Column:
        at = F.instr(c, sep)
        left, right = strip(F.substring(c, F.lit(1), at - 1)), strip(F.substring(c, at + len(sep), F.length(c)))
        return F.when((at > 0) & (left != "") & (right != ""), F.array(left, right))

    return F.coalesce(sides(" v. "), sides(" v "), sides(" V. "), sides(" V "), F.array(strip(c)))


def is_district_court(court_id: Column) -> Column:
    """False for null and blank ids and for appeal and special courts."""
    c = F.lower(F.trim(court_id))
    return F.coalesce((c != "") & ~c.rlike("^(" + "|".join(NOT_DISTRICT) + ")"), F.lit(False))


def strip_html(c: Column) -> Column:
    """Tags to blanks, common entities to characters, white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentence_label(c: Column) -> Column:
    """1 for facts, 0 for non-facts, null for other labels."""
    w = norm_text(c)
    return F.when(w.isin("fact", "facts", "fac", "1"), 1).when(w.isin("non-fact", "nonfact", "non_fact", "non fact", "non-facts", "0"), 0)


def section_label(name: Column) -> Column:
    """1 for sections of facts, 0 for jurisdiction, venue and the like, null for others."""
    n = F.lower(name)
    return F.when(n.rlike("fact"), 1).when(n.rlike("jurisdiction|venue|parties|relief|prayer"), 0)


def clean_line(line: Column) -> Column:
    """Without a list number and then a list letter in front."""
    return strip(F.regexp_replace(F.regexp_replace(strip(line), r"^[0-9]+\.\s+", ""), r"^[A-Z]\.\s+", ""))


def split_sentences_simple(c: Column) -> Column:
    """At white space after . ! or ?"""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), strip), lambda x: x != "")


def clip(c: Column, n: int) -> Column:
    """Head and tail with dots between, of at most n characters and the dots."""
    half = n // 2
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit("..."), F.right(c, F.lit(n - half))))


def content_key(c: Column) -> Column:
    """16 hex digits of SHA-256 over the text."""
    return F.left(F.sha2(c, 256), F.lit(16))


def sentence_map(c: Column) -> Column:
    """Map of number to text from lines "[S12] text"; of a repeated number the last holds."""
    pattern = r"\[S(\d+)\]\s*([^\[]*)"
    ids, texts = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(ids.alias("k"), texts.alias("v"))
    keep = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(ids, i + 2, F.size(ids)), x.getField("k")))
    return F.map_from_entries(F.transform(keep, lambda x: F.struct(x.getField("k").cast("int"), strip(F.regexp_replace(x.getField("v"), r"\s+", " ")))))


def temporal_relation(c: Column) -> Column:
    """The relation's canonical name: BEFORE and AFTER are NEXT (AFTER with ends swapped), the simultaneous ones OVERLAP."""
    r = F.upper(strip(c))
    return F.when(r.isin("BEFORE", "AFTER"), "NEXT").when(r.isin("SIMULTANEOUS", "SAME_TIME", "CONCURRENT"), "OVERLAP").otherwise(r)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def json_strings(c: Column) -> Column:
    """A JSON array of strings; an empty array for null and for what can't be parsed."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sentence_numbers(c: Column) -> Column:
    """Sorted distinct numbers from a JSON array of ids such as 12, "12" and "S12"."""
    n = F.transform(json_strings(c), lambda x: F.regexp_extract(x, r"^[sS]?(\d+)$", 1).try_cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(n)))


def url_page(url: Column, page: Column) -> Column:
    """The URL without its fragment, with the parameter page set."""
    bare = F.regexp_replace(url, "#.*$", "")
    kept = F.regexp_replace(F.regexp_replace(bare, r"([?&])page=[^&]*(&|$)", "$1"), "[?&]$", "")
    return F.concat(kept, F.when(kept.contains("?"), "&page=").otherwise("?page="), page.cast("string"))


def url_path(url: Column) -> Column:
    """The path of an absolute or relative URL, without parameters and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")


def case_docket(c: Column) -> Column:
    """Number and year around the mark cv of a docket or document id: 2:19-cv-01234 gives 19-cv-01234; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), "([0-9]+[-_]cv[-_][0-9]+)", 1), "_", "-"), F.lit(""))


def signed_confidence(belongs: Column, confidence: Column) -> Column:
    """The confidence of a yes, and one less it of a no; null if either is."""
    return F.when(belongs, confidence).when(~belongs, 1 - confidence)


def time_key(c: Column) -> Column:
    """The first value in a scalar or nested JSON text, in lower case and trimmed; null if there is none."""
    inside = F.regexp_extract(c, r'(?:^\s*|[\[{:,]\s*)(?:"([^"]*[^"\s][^"]*)"(?!\s*:)|(-?\d[^\s,\]}]*))', 0)
    value = F.regexp_replace(inside, r'^[\s\[{:,"]+|["\s]+$', "")
    return missing(F.lower(F.when(c.rlike(r"^\s*[\[{]"), value).otherwise(c)))


def multi_hot(labels: Column, vocabulary: Column) -> Column:
    """1 for each word of the vocabulary among the labels, else 0; unknown labels are ignored, null labels are none."""
    return F.transform(vocabulary, lambda v: F.coalesce(F.array_contains(labels, v), F.lit(False)).cast("int"))
