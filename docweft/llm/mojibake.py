"""Text read in a wrong character encoding: find it and restore it.

The unit is the token, a run without white space that holds a non-ASCII character. A wrong encoding
leaves ASCII alone, so a garbled token and its clean near-twins agree once non-ASCII characters are
taken out ("rsum" of a garbled and of a right "résumé"). The steps:

1. Count each distinct token over all documents, digits folded. Count how often each non-ASCII character
   stands between which classes of neighbours: that tells usual text from unusual.
2. Join unusual tokens with usual ones that are equal around a run of non-ASCII characters, up to three ASCII characters on both sides, so that a run
   is aligned with the one clean character in its place; words without ASCII characters are joined by which of their characters repeat, and aligned one by
   one. Each pair of aligned characters tells which encodings (written in, read in) turn one into the other; the fewest encodings that explain the pairs are
   learned. Aligned pairs that no encoding explains are learned as they are, a table of characters, if enough different tokens agree.
3. Apply learned encodings and the table to all unusual tokens, again to the results (text garbled twice); a result counts
   if its characters stand where they usually stand. Encodings that were learned, but not with each other, are tried on long runs.
4. A document is garbled by the pair that explains most of it. Strong evidence is a word that becomes a known word, a
   valid multi-byte sequence or a long run; a lone sign could be another by chance, so two of them must agree.

Defined results: null and pure ASCII texts are never garbled; U+FFFD and C1 control characters are garbled
whatever stands around them, restored where a clean twin tells how, else kept. Repeated rows
give the same result; extra columns are kept by repair().
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut, spread

# Encodings that text is written in, and that it is read in by mistake.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866", "cp1253", "iso8859-7", "iso8859-15", "cp1250", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr", "mac_cyrillic")
READ = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1253", "cp1250", "iso8859-15", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr", "iso8859-5", "mac_cyrillic")
PAIRS = [(w, r) for w in WRITTEN for r in READ if w != r]
#: Garbled characters, each of another aligned pair or of one that became several, that must agree on a pair of encodings.
SUPPORT = 2
#: Gain in mean log frequency per character that a restored token must show; 2 is a factor of 7.
GAIN = 2.0
#: Multi-byte encodings; a wrong byte would break a long run of them, so a long run may prove encodings that twins taught apart from each other.
MULTIBYTE = ("utf-8", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
LONG = 8
#: Different places that must agree on a pair of characters that no encoding explains.
AGREE = 4
#: A token whose rarest character stands in a context at least this frequent (log, less two deviations) is usual.
USUAL = -9.0
#: ASCII letters and digits that a run needs next to it for a twin; words without any have twins told by which characters repeat, if so many
#: do, counted with the length of the word: 7 characters with two repeats, or 10 with one, tell words well apart.
ANCHORS, PATTERN, REPEATS = 2, 7, 10
#: Characters that one garbled character may have become.
WIDEST = 4
SKELETON = r"(?:[^\x21-\x7e]|\?)+"
#: The context table holds characters x neighbour classes; it can't outgrow Unicode, but is checked.
MAX_CONTEXTS = 5_000_000
TOKEN = r"(?<![^\s])[\x21-\x7e]*+(?:[^\x00-\x7f]|(?<=[a-z])\?(?=[a-z]))[^\x00-\x20]*"


def tokens(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token) distinct: tokens with a non-ASCII character or a question mark inside a word, digits as 0."""
    folded = F.regexp_replace(text, r"[0-9]+", "0")
    return documents.filter(F.col(text).rlike(r"[^\x00-\x7f]|[a-z]\?[a-z]")).select(key, F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)))).alias("token"))


@lru_cache(100_000)
def _kind(c: str) -> str:
    """Class of a neighbour: boundary, ASCII letters by case, digit, mark, and others by script."""
    if c == "":
        return "B"
    if c < "\x80":
        return "l" if c.islower() else "u" if c.isupper() else "0" if c.isdigit() else "."
    if c.isalpha():
        script = unicodedata.name(c, "?").split()[0]
        return {"LATIN": "é" if c.islower() else "É", "CYRILLIC": "я" if c.islower() else "Я", "GREEK": "γ", "CJK": "漢", "HIRAGANA": "か", "KATAKANA": "か"}.get(script, script)
    return "S" if ord(c) < 0xA0 or unicodedata.category(c)[0] in "SC" else "P"


def contexts(token: str) -> list[str]:
    return [_kind(token[i - 1] if i else "") + c + _kind(token[i + 1 : i + 2]) for i, c in enumerate(token) if c > "\x7f"]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, int] = {}
    for pdf in batches:
        for token, n in zip(pdf["token"], pdf["n"]):
            for c in contexts(token):
                total[c] = total.get(c, 0) + n
    if total:
        yield pd.DataFrame({"context": list(total), "n": list(total.values())})


class Usage:
    """How usual tokens are, by the counts of their characters' contexts."""

    def __init__(self, counts: dict[str, int]):
        self.all = math.log(sum(counts.values()) + 1)
        self.log = {c: math.log(n) for c, n in counts.items()}
        self.never = math.log(0.3)
        # What the counts show for sure: two deviations less, so that a few sightings prove nothing in a table of any size.
        self.sure = {c: math.log(n - 2 * math.sqrt(n)) for c, n in counts.items() if n > 4}

    def mean(self, token: str) -> float:
        c = contexts(token)
        return sum(self.log.get(x, self.never) for x in c) / len(c) - self.all if c else 0.0

    def worst(self, token: str) -> float:
        return min((self.sure.get(x, self.never) for x in contexts(token)), default=self.all) - self.all

    def usual(self, token: str) -> bool:
        return self.worst(token) >= USUAL


@lru_cache(None)
def _table(codec: str) -> tuple[dict[str, int], list[str]] | None:
    """Of a single-byte encoding: character to byte, and byte to character; undefined bytes stand for themselves."""
    if codec in MULTIBYTE:
        return None
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in enumerate(chars)}, chars


def encode(text: str, codec: str) -> bytes | None:
    if (t := _table(codec)) is None:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return bytes([t[0][c] for c in text])
    except KeyError:
        return None


def decode(data: bytes, codec: str) -> str | None:
    if t := _table(codec):
        return "".join([t[1][b] for b in data])
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


@lru_cache(None)
def _sequences() -> re.Pattern:
    """A lead and a continuation byte of UTF-8 as some single-byte encoding shows them."""
    found = []
    for r in READ:
        if t := _table(r):
            lead, rest = "".join(t[1][0xC2:0xF5]), "".join(t[1][0x80:0xC0])
            found.append(f"[{re.escape(lead)}][{re.escape(rest)}]")
    return re.compile("|".join(found))


#: Stands for the encoding of a table of aligned characters, which is then named in the place of the other one: garbled, clean, garbled, ..
ALIGNED = "aligned"


@lru_cache(4)
def _aligned_table(text: str) -> tuple[re.Pattern, dict[str, str]]:
    parts = text.split("\n")
    table = dict(zip(parts[::2], parts[1::2]))
    return re.compile("|".join(re.escape(g) for g in sorted(table, key=lambda g: (-len(g), g)))), table


def undo(token: str, written: str, read: str) -> str | None:
    """The token as it was before text written in one encoding was read in another; null where that can't be."""
    if written == ALIGNED:
        out = _aligned_table(read)[0].sub(lambda m: _aligned_table(read)[1][m.group(0)], token)
    else:
        data = encode(token, read)
        out = None if data is None else decode(data, written)
    return None if out is None or out == token or not out.strip("?") else out


def garble(token: str, written: str, read: str) -> str | None:
    data = encode(token, written)
    return None if data is None else decode(data, read)


_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def windows(token: str, longest: int) -> list[tuple[str, str]]:
    """(skeleton, run) of each run of at most so many non-ASCII characters with ANCHORS letters or digits next to it: the ASCII characters
    around the run, up to three on a side, with the ends of the token. Of longer runs, as scripts without blanks have them, the beginnings
    and ends of such lengths, if there are as many anchors on that side."""
    out = []
    anchored = lambda *sides: sum(c.isalnum() for s in sides for c in s) >= ANCHORS
    for m in _RUN.finditer(token):
        run = m.group()
        before = re.search("[\x21-\x7e]*$", token[max(0, m.start() - 3) : m.start()]).group()
        after = re.match("[\x21-\x7e]*", token[m.end() : m.end() + 3]).group()
        if len(run) <= longest:
            if anchored(before, after):
                out.append((("^" if m.start() <= len(before) else "") + f"{before}\x01{after}" + ("$" if m.end() + len(after) == len(token) else ""), run))
            continue
        for k in range(1, longest + 1):
            if anchored(before):
                out.append((f"{before}\x01>", run[:k]))
            if anchored(after):
                out.append((f"<\x01{after}", run[-k:]))
    return out


def pattern(token: str) -> str | None:
    """The token with each non-ASCII character as the number of its first like, which a wrong single-byte encoding leaves as it is;
    null where too few characters repeat to tell words apart."""
    first: dict[str, int] = {}
    out = [c if "!" <= c <= "~" and c != "?" else chr(0xE000 + first.setdefault(c, len(first))) for c in token]
    n = sum(c >= "\ue000" for c in out)
    return "".join(out) if n >= PATTERN and n * (n - len(first)) >= REPEATS else None


@lru_cache(500_000)
def explains(garbled: str, clean: str) -> frozenset[int]:
    """The pairs of encodings, by number, that turn clean into garbled."""
    return frozenset(k for k, (w, r) in enumerate(PAIRS) if garble(clean, w, r) == garbled)


def _units(usage: Usage):
    """For rows (token, n): whether the token is odd, and units (skeleton, run, odd, clean) that twins are told by; run is the whole token where characters repeat.

    A unit may be both odd and clean: usual, but with a sequence that UTF-8 would also leave."""

    def is_odd(text: str) -> bool:
        return not usage.usual(text) or "\ufffd" in text or "?" in text or bool(_sequences().search(text))

    def is_clean(text: str) -> bool:
        return usage.usual(text) and "\ufffd" not in text and "?" not in text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for token in pdf["token"]:
                odd, units = is_odd(token), []
                for s, r in windows(token, WIDEST):
                    place = s.strip("^$<>").replace("\x01", r)
                    # Clean is one character; it may also begin or end a run.
                    units.append((s, r, odd and is_odd(place), len(r) == 1 and is_clean(place)))
                if not any("!" <= c <= "~" and c.isalnum() for c in token) and (p := pattern(token)):
                    units.append((p, token, odd, is_clean(token)))
                out.append((odd, [{"skeleton": s, "run": r, "odd": o, "clean": c} for s, r, o, c in units if o or c]))
            yield pdf.assign(odd=[x[0] for x in out], units=[x[1] for x in out])

    return run


def _aligner(usage: Usage):
    """For rows (skeleton, run, twin): aligned pairs (garbled, clean, fit), fit being the numbers of the encodings that explain the pair.

    The twin must be so much more usual that it is the clean one, but what UTF-8 makes of a twin tells that by itself, however common it is."""
    utf = frozenset(k for k, (w, _) in enumerate(PAIRS) if w == "utf-8")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for skeleton, g, c in zip(pdf["skeleton"], pdf["run"], pdf["twin"]):
                if "\x01" not in skeleton:  # whole words, character by character
                    fit = None
                    for x, y in zip(g, c):
                        if x != y:
                            fit = explains(x, y) if fit is None else fit & explains(x, y)
                            if not fit:
                                break
                    if not fit or usage.mean(c) < usage.mean(g) + GAIN / 2:
                        continue
                elif "\ufffd" in g:
                    continue
                else:
                    fit = explains(g, c)
                    place = skeleton.strip("^$<>")
                    if usage.mean(place.replace("\x01", c)) < usage.mean(place.replace("\x01", g)) + GAIN / 2:
                        fit = fit & utf
                        if not fit:
                            continue
                out.append((g, c, ",".join(map(str, sorted(fit)))))
            yield pd.DataFrame(out, columns=["garbled", "clean", "fit"])

    return run


def _cover(fits: dict[str, int]) -> list[tuple[str, str]]:
    """The fewest pairs that explain the aligned characters, the best supported first."""
    left = {tuple(map(int, k.split(","))): n for k, n in fits.items() if k}
    out = []
    while left:
        votes: dict[int, int] = {}
        for k, n in left.items():
            for p in k:
                votes[p] = votes.get(p, 0) + n
        best = min(votes, key=lambda p: (-votes[p], p))
        if votes[best] < SUPPORT:
            break
        out.append(PAIRS[best])
        left = {k: n for k, n in left.items() if best not in k}
    return out


@lru_cache(None)
def _readable(read: str) -> re.Pattern:
    return re.compile(f"[{re.escape(''.join(t[1][0x80:]))}]+") if (t := _table(read)) else _RUN


def _runs(token: str, written: str, read: str) -> str | None:
    """Each run of characters of the read encoding on its own; runs that can't be undone stay."""
    out = _readable(read).sub(lambda m: undo(m.group(0), written, read) or m.group(0), token)
    return None if out == token else out


def restore(token: str, usage: Usage, pairs: list[tuple[str, str]], learned: int) -> list[tuple[int, str, float]]:
    """(pair, clean, gain): for each pair the most usual result after up to three rounds, if more usual than the token.

    The first pairs, learned in number, were taught by twins; the others need a long run."""
    base, results = usage.mean(token), []
    long = sum(c > "\x7f" for c in token) >= LONG
    for k, (w, r) in enumerate(pairs):
        if k >= learned and not long:
            break
        # Valid UTF-8 is kept whatever its usage, in case other tokens prove the pair.
        best, score, t = None, -math.inf if w == "utf-8" else base + 0.3, token
        for _ in range(3):
            out = undo(t, w, r)
            if out is None and w == "utf-8":  # the token also has what was right, or a sequence cut short
                out = _runs(t, w, r)
            if out is None:
                break
            if not _LOST.search(out) and (s := usage.mean(out) if _RUN.search(out) else base + GAIN) > score:
                best, score = out, s
            t = out
        if best is not None and (k < learned or score > base + 2 * GAIN):
            results.append((k, best, score - base))
    return results


def _lossy(token: str, twin: str) -> bool:
    """Do the two agree but for lost characters of the token? The alignment is by position of ASCII characters."""
    pattern = "".join("[^\\x00-\\x7f]{0,3}" if c in "\ufffd?" else re.escape(c) for c in token)
    return bool(re.fullmatch(pattern, twin))


def _judge(usage: Usage, pairs: list[tuple[str, str]], learned: int):
    """Candidates of each token: (token, pair, clean, gain, sure); pair -1 is damage that no pair explains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for token, twin in zip(pdf["token"], pdf["twin"]):
                found = restore(token, usage, pairs, learned)
                long = sum(c > "\x7f" for c in token) >= 6
                out += [(token, k, clean, gain, long or pairs[k][0] == "utf-8") for k, clean, gain in found]
                twin = twin if twin is not None and _lossy(token, twin) else None
                if _LOST.search(token) or (not found and twin is not None and re.search(r"[a-z]\?[a-z]", token)):
                    out.append((token, -1, twin, 0.0, True))
            yield pd.DataFrame(out, columns=["token", "pair", "clean", "gain", "sure"])

    return run


def candidates(counts: DataFrame) -> tuple[DataFrame, Usage, list[tuple[str, str]]]:
    """Candidates, what is usual, and the pairs of encodings by number. Candidates are (token, pair, clean, gain, strength) of tokens that may be garbled among (token, n), a row for each pair that explains one.

    Strength 0 is no evidence, but serves where other tokens of a document prove the pair.
    """
    table = counts.mapInPandas(_count, "context string, n long").groupBy("context").agg(F.sum("n").alias("n")).limit(MAX_CONTEXTS + 1).toPandas()
    if len(table) > MAX_CONTEXTS:
        raise ValueError(f"more than {MAX_CONTEXTS} contexts of characters")
    usage = Usage(dict(zip(table["context"], table["n"])))

    # Few rows, but each costs time: a fixed number of tasks.
    marked = cut(spread(counts.select("token", "n")).mapInPandas(_units(usage), "token string, n long, odd boolean, units array<struct<skeleton string, run string, odd boolean, clean boolean>>"))
    odd = marked.filter("odd").select("token", "n")
    # Windows are of few characters, so there are not many more of them than kinds of signs, however long the table.
    units = marked.select(F.explode("units").alias("u")).select("u.*").distinct()
    twins = units.filter("odd").join(units.filter("clean").select("skeleton", F.col("run").alias("twin")), "skeleton").filter("run <> twin")
    alike = twins.select("skeleton", "run", "twin").repartition(max(4 * counts.sparkSession.sparkContext.defaultParallelism, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    alike = cut(alike.mapInPandas(_aligner(usage), "garbled string, clean string, fit string").groupBy("garbled", "clean", "fit").agg(F.count("*").alias("n")))
    # Of what may stand in the place of a sign, only what does so about as often as the most common.
    most = alike.groupBy("garbled").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    alike = cut(alike.join(most, "garbled").filter("n * 2 >= most"))
    # A character that became several is as good as several that became one each.
    fits = alike.groupBy("fit").agg(F.sum(F.length("garbled")).alias("weight")).collect()  # sets of pairs of encodings
    pairs = _cover({r["fit"]: r["weight"] for r in fits})
    # What no encoding explains: signs that mostly meet one and the same character, and that no learned encoding reads.
    raw = alike.filter((F.col("fit") == "") & (F.col("n") >= AGREE) & (F.col("n") * 3 >= F.col("all") * 2) & F.col("garbled").rlike(r"^[^\p{L}\p{M}\p{N}\p{P}\x00-\x7f]$|^[^\x00-\x7f]{2,4}$"))
    raw = raw.groupBy("garbled").agg(F.min("clean").alias("clean")).limit(MAX_CONTEXTS).collect()
    if raw := [r for r in raw if not any(undo(r[0], *p) for p in pairs)]:
        pairs.append((ALIGNED, "\n".join(x for r in sorted(raw) for x in r)))
    learned = len(pairs)
    taught = [p for p in pairs if p[0] != ALIGNED]
    pairs += [(w, r) for w in MULTIBYTE for r in READ if w != r and (w, r) not in taught and any(w == a for a, _ in taught) and any(r == b for _, b in taught)]
    # The clean form of what lost characters is the commonest token that is equal but for its non-ASCII characters.
    skeleton = F.regexp_replace("token", SKELETON, "\u0001")
    lost = odd.select("token", skeleton.alias("skeleton")).filter(F.col("token").rlike(r"\x{FFFD}|\?|[\x80-\x9f]"))
    usual = marked.filter((~F.col("odd")) & ~F.col("token").contains("?")).select("token", "n", skeleton.alias("skeleton"))
    usual = usual.groupBy("skeleton").agg(F.max_by("token", F.struct("n", "token")).alias("twin"))
    lossy = lost.join(usual, "skeleton").select("token", "twin")
    found = spread(odd.select("token").join(lossy, "token", "left")).mapInPandas(_judge(usage, pairs, learned), "token string, pair int, clean string, gain double, sure boolean")
    known = counts.select(F.col("token").alias("clean"), F.col("n").alias("n_clean"))
    found = cut(found.join(odd.select("token", "n"), "token").join(known, "clean", "left"))
    word = F.col("token").rlike(r"[A-Za-z].*[A-Za-z]|[^\x00-\x7f]{2}") & (F.col("n_clean") >= 3) & (F.col("n_clean") > F.col("n"))
    # Valid UTF-8 that gives a known word is proof, whatever share of the corpus is garbled alike.
    proven = F.col("pair").isin([k for k, (w, _) in enumerate(pairs) if w == "utf-8"]) & F.coalesce(F.col("n_clean") >= 3, F.lit(False))
    out = found.select("token", "pair", "clean", "gain", F.when((F.col("gain") < GAIN) & (F.col("pair") >= 0) & ~proven, 0.0).when(F.col("sure") | word, 1.0).otherwise(0.5).alias("strength"))
    return out, usage, pairs


def _apply(usage: Usage, pairs: list[tuple[str, str]]):
    """For rows (token, pair): the token restored by that pair alone, where it gets more usual."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, p, found[0][1]) for t, p in zip(pdf["token"], pdf["best"]) if (found := restore(t, usage, [pairs[p]], 1))]
            yield pd.DataFrame(out, columns=["token", "best", "clean"])

    return run


def garbled_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, clean): the garbled tokens of each garbled document, digits as 0; clean is null where it is lost."""
    found = cut(tokens(documents, key, text))
    counts = cut(found.groupBy("token").agg(F.count("*").alias("n")))
    tested, usage, encodings = candidates(counts)
    explained = cut(found.join(tested, "token"))
    # One sign can't count twice for a pair: weak evidence is taken once for each of a document's signs.
    sign = F.when(F.col("strength") < 1, F.regexp_replace("token", r"[\x00-\x7f]", "")).otherwise(F.col("token"))
    pairs = explained.groupBy(key, "pair", sign.alias("sign")).agg(F.max("strength").alias("strength"), F.sum("gain").alias("gain"))
    pairs = pairs.groupBy(key, "pair").agg(F.sum("strength").alias("strength"), F.sum("gain").alias("gain"))
    best = pairs.groupBy(key).agg(F.max("strength").alias("evidence"), F.max_by("pair", F.struct("strength", "gain", -F.col("pair"))).alias("best")).filter("evidence >= 1")
    best = cut(best)
    rows = explained.join(best, key)
    order = F.struct((F.col("pair") == F.col("best")).cast("int"), F.col("clean").isNotNull().cast("int"), "strength", "gain")
    out = rows.groupBy(key, "token").agg(F.max_by("clean", order).alias("clean"))
    # A proven pair also restores the document's tokens that look usual by themselves.
    rest = cut(found.join(best.filter("best >= 0").select(key, "best"), key).join(out.select(key, "token"), [key, "token"], "left_anti"))
    more = rest.select("token", "best").distinct().mapInPandas(_apply(usage, encodings), "token string, best int, clean string")
    return out.unionByName(rest.join(more, ["token", "best"]).select(key, "token", "clean"))


def garbled_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_lost): documents with garbled tokens, and how many of these can't be restored."""
    return garbled_tokens(documents, key, text).groupBy(key).agg(F.count("*").alias("n_tokens"), F.count_if(F.col("clean").isNull()).alias("n_lost"))


def _refold(clean: Column, raw: Column) -> Column:
    """The clean form with the digits of the raw token back in the places of its zeros."""
    digits = F.regexp_extract_all(raw, F.lit(r"[0-9]+"), F.lit(0))
    parts = F.split(clean, "0")
    joined = F.array_join(F.flatten(F.transform(parts, lambda x, i: F.array(x, F.coalesce(F.get(digits, i), F.lit(""))))), "")
    return F.when(F.size(parts) == F.size(digits) + 1, joined).otherwise(raw)


def repair(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The garbled documents, all columns kept, with restored (the text as far as it can be restored) and n_lost."""
    bad = garbled_tokens(documents, key, text)
    known = bad.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("clean", "token")))).alias("__known"), F.count_if(F.col("clean").isNull()).alias("n_lost"))
    rows = documents.join(known, key)
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\s\x00-\x20]+|[^\s\x00-\x20]+"), F.lit(0))
    fold = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    fixed = F.transform(pieces, lambda x: F.coalesce(_refold(F.try_element_at("__known", fold(x)), x), x))
    return rows.withColumn("restored", F.array_join(fixed, "")).drop("__known")
