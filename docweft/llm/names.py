"""Variant spellings of persons, firms and agencies, by merging and matching again.

Each distinct spelling is one record with the parts of its name, and equal parts are one profile. A profile enters the blocks of all
its family names (of bodies: the words of their own), each with the forms that it shares with names up to the distance at which two still match, and
all its initials. In a block each profile names the best one that it surely matches; a profile is merged into that one if it
stays itself, so merges are stars and the profiles that a merge unites never contradict each other. The united
profile, with all spellings, given names, initials and suffixes, enters the blocks again, until nothing merges. Where no sure match is left,
profiles with initials only, or without a suffix that others have, go to the one profile that can take them over all their blocks, if there is
exactly one, and aliases tell who initials are; then sure matches are sought again. Names without a given name at all come
last. What blocks say of a profile is only the best, smallest and largest candidate, so it is aggregated before the shuffle, and a block with many profiles is
compared in cells of a bounded size that meet all others. Work grows with distinct spellings, not with rows.

Defined results: null, blank and role names and placeholders name nobody and are in no pair; repeated rows
of an entity count once; aliases_json that can't be parsed has no aliases; an alias of another family name is ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import cut, spread, tidy

# Words that are roles or placeholders, titles, suffixes, legal forms, abbreviations and nicknames.
ROLES = (
    "plaintiff|plaintiffs|defendant|defendants|employer|employee|supervisor|manager|company|corporation|court|judge|hr|human resources|unknown|none|n/?a|"
    "co-?worker|coworker|witness|claimant|respondent|petitioner|appellant|appellee|insurer|agency|counsel|attorney|complainant|union|union steward|trustee|"
    "(?:john|jane|richard|mary) (?:doe|roe)(?: (?:no\\.? )?\\d+)?|does? \\d+(?:[- ](?:through|to)?[- ]?\\d+)?|party|third party|person|individual|other|anonymous|unnamed|tbd|null|nan|\\W*|\\d+"
)
TITLES = "mr mrs ms mx miss dr prof judge hon lt sgt capt officer rev sir madam mme".split()
CREDENTIALS = "esq md cpa phd jd dds rn pe msw".split()
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "2nd": "ii", "iii": "iii", "3rd": "iii", "iv": "iv"}
LEGAL = "inc incorporated corp corporation co company llc ltd limited liability lp llp plc pllc pc gmbh ag sa".split()
EXPAND = {
    "prop": "property", "props": "property", "mgmt": "management", "mgt": "management", "int'l": "international", "intl": "international", "mfg": "manufacturing", "pkg": "packaging",
    "svcs": "services", "svc": "services", "service": "services", "frt": "freight", "sys": "systems", "wkrs": "workers", "loc": "local", "assoc": "associates", "assocs": "associates", "assn": "association",
    "bros": "brothers", "tech": "technologies", "med": "medical", "ctr": "center", "ins": "insurance", "bd": "board", "educ": "education", "dept": "department", "pub": "public", "cnty": "county", "cty": "county",
    "comm'n": "commission", "comm": "commission", "auth": "authority", "hsg": "housing", "ofc": "office", "stds": "standards", "univ": "university", "hosp": "hospital", "grp": "group", "transp": "transportation",
    "eng'g": "engineering", "engg": "engineering", "eng": "engineering", "hhc": "home health care", "fcu": "federal credit union", "nat'l": "national", "natl": "national", "gov't": "government", "div": "division",
}
KINDS = set(
    "property management international manufacturing packaging services freight systems workers local associates association brothers sons technologies medical center insurance board education "
    "department public county works commission transit authority housing office labor standards university hospital group transportation storage engineering home health care federal credit union "
    "national government division foods dental holdings city state bureau school district bank partners".split()
)
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander", "sasha": "alexander", "xander": "alexander", "bart": "bartholomew", "charlie": "charles", "chuck": "charles", "chas": "charles", "corny": "cornelius", "neil": "cornelius",
    "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "ellie": "eleanor", "nell": "eleanor", "nora": "eleanor", "lena": "eleanor",
    "beth": "elizabeth", "liz": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "fran": "frances francisco", "fanny": "frances", "frank": "francisco", "paco": "francisco", "pancho": "francisco", "cisco": "francisco",
    "jerry": "gerald", "gerry": "gerald", "lupe": "guadalupe", "lupita": "guadalupe", "hank": "henry", "harry": "henry", "hal": "henry", "iggy": "ignacio", "nacho": "ignacio", "jim": "james", "jimmy": "james", "jamie": "james", "jo": "josephine", "josie": "josephine",
    "pepe": "jose", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "kath": "katherine", "larry": "lawrence", "laurie": "lawrence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret",
    "nate": "nathaniel", "nat": "nathaniel", "nathan": "nathaniel", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "phil": "philippa", "pippa": "philippa", "rick": "richard", "dick": "richard", "rich": "richard", "bob": "robert", "bobby": "robert",
    "rob": "robert", "robbie": "robert", "bert": "robert", "sukie": "susannah", "sue": "susannah", "susie": "susannah", "suzy": "susannah", "theo": "theodore", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "walt": "walter", "wally": "walter", "bill": "william", "billy": "william", "will": "william",
    "wendy": "wendell", "zach": "zachary", "zack": "zachary", "quint": "quentin", "joe": "joseph jose", "mike": "michael", "dave": "david", "dan": "daniel", "tom": "thomas", "tony": "anthony", "jen": "jennifer", "becky": "rebecca", "sam": "samuel", "ben": "benjamin", "matt": "matthew", "chris": "christopher",
}

_ROLE = re.compile(rf"(?i)(?:the |an? )?(?:{ROLES})")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DBA = re.compile(r"(?i)\b(?:d/?b/?a|a/?k/?a|f/?k/?a|doing business as)\b\.?:?\s*([^()]+)")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def scanned(word: str) -> str:
    """Digits that a scanner put for letters, in words that have letters."""
    return word.translate(str.maketrans("015", "ols")) if any(c.isalpha() for c in word) and any(c.isdigit() for c in word) and word not in GENERATIONS else word


def distance(a: str, b: str, most: int) -> int:
    """Edits (a swap of neighbours is one) between two words, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def tokens_of(name: str) -> list[str]:
    t = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group(1).replace(".", ""), plain(name).replace("’", "'"))
    t = re.sub(r"\bm\.d\b|\bph\.d\b", lambda m: m.group(0).replace(".", ""), t)
    return [scanned(w) for w in _TOKEN.findall(t.replace("&", " and "))]


def is_body(words: list[str]) -> bool:
    known = [w for w in words if w in LEGAL or w in KINDS or w in EXPAND]
    return bool(known) and (len(known) >= 2 or known[-1] == words[-1] or len(words) > 2 or known[0] in KINDS)


def parse(name: str, given_names: dict[str, int]) -> dict | None:
    """The parts of a name; null for who names nobody. given_names: how often each word is given less how often family name, where the form of
    a name tells; it decides on two words without a comma."""
    name = re.sub(r"\s+", " ", name).strip(" ,;")
    if not name or _ROLE.fullmatch(plain(name)):
        return None
    if m := _DBA.search(name):
        name = m.group(1).strip()
    words = tokens_of(name)
    if is_body(words):
        return _body(name)
    name = re.sub(r"(?i),?\s+(?:m\.\s?d|ph\.\s?d|r\.\s?n|j\.\s?d|d\.d\.s)\.?(?=\s|,|$)", "", name)
    comma = [tokens_of(re.sub(r"\b(\w)\.(?=\w)", r"\1 ", p)) for p in name.split(",")]
    clean, suffix = [], ""
    for part in comma:
        keep = []
        for w in part:
            if w in GENERATIONS and (clean or keep):
                suffix = GENERATIONS[w]
            elif w not in CREDENTIALS and (w not in TITLES or keep or clean):
                keep.append(w)
        if keep:
            clean.append(keep)
    titled = bool(words) and words[0] in TITLES
    lean = lambda x: given_names.get(x, 0) + (x in NICKNAMES)
    if not clean:
        return None
    if len(clean) > 1:
        core, given = " ".join(clean[0]), clean[1]
    else:
        w = clean[0]
        if len(w) == 1:
            if not titled:
                return {"kind": "P", "core": w[0], "first": "", "middle": "", "suffix": suffix, "sig": "", "extra": ""}
            core, given = w[0], []
        elif len(w) == 2 and len(w[1]) > 1 and len(w[0]) > 1 and lean(w[1]) > lean(w[0]):
            core, given = w[0], [w[1]]
        else:
            core, given = w[-1], w[:-1]
            if len(w) == 3 and len(w[2]) == 1:  # Last First M.
                core, given = w[0], w[1:]
    extra = ""
    if len(given) > 1 and len(given[0]) == 1 < len(given[1]):  # J. Robert: known by the second name
        extra, given = given[0], given[1:]
    return {"kind": "P", "core": core, "first": given[0] if given else "", "middle": given[1][0] if len(given) > 1 else "", "suffix": suffix, "sig": "", "extra": extra}


def _body(name: str) -> dict | None:
    """A firm or agency: its own words, and the sorted words of its kind with its numbers."""
    text = re.sub(r"(?i),\s+an?\s+[^,]*\b(?:firm|business|employer|company|corporation)\s*$", "", name)
    county = re.search(r"(?i)\bcounty of\b|\bcounty\b|\bcnty\b", text)
    if not county:
        text = re.sub(r"(?<=\w|\.)\s+of\s+[A-Z][\w’'-]+(?:\s+[A-Z][\w’'-]+)?\s*$", "", text)
    words = []
    for w in tokens_of(text):
        words += EXPAND.get(w, w).split()
    own, kind = [], set()
    for w in words:
        if w in KINDS or w.isdigit():
            kind.add(w)
        elif w not in LEGAL and w not in ("the", "of", "and", "on", "for", "a", "an"):
            own.append(w)
    if "workers" in kind:
        kind.discard("union")
    if not own:
        own, kind = sorted(kind), set()
    return {"kind": "O", "core": " ".join(own), "first": "", "middle": "", "suffix": "", "sig": " ".join(sorted(kind)), "extra": ""} if own else None


FEATURES = "name string, kind string, core string, first string, middle string, suffix string, sig string, extra string"


def _parser(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name, leaning in zip(pdf["name"], pdf["leaning"]):
            if p := parse(name, dict(leaning) if leaning is not None else {}):
                out.append((name, *p.values()))
        yield pd.DataFrame(out, columns=["name", "kind", "core", "first", "middle", "suffix", "sig", "extra"])


def formals(first: str) -> list[str]:
    return NICKNAMES.get(first, first).split()


@lru_cache(200_000)
def given_match(a: str, b: str) -> bool:
    """May two given names of more than an initial be one?"""
    for x in formals(a):
        for y in formals(b):
            if x == y or (min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x))):
                return True
            n = min(len(x), len(y))
            if n >= 4 and distance(x, y, 2) <= (2 if n >= 8 else 1):
                return True
    return False


#: Letters from which a family name may have one altered letter, and two.
ONE, TWO = 5, 8


@lru_cache(200_000)
def core_match(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or (n >= ONE and distance(a, b, 2) <= (2 if n >= TWO else 1))


class Profile:
    """One person or body as known so far; n is the number of its spellings."""

    __slots__ = ("pid", "n", "cores", "firsts", "middles", "suffixes", "rank")

    def __init__(self, r):
        self.pid, self.n, self.rank = r.pid, r.n, (-r.n, r.pid)
        self.cores, self.firsts, self.middles, self.suffixes = frozenset(r.cores), frozenset(r.firsts), frozenset(r.middles), frozenset(r.suffixes)

    def match(self, o: Profile) -> str:
        """'' if the two can't be one, 'strong' with given names alike, 'weak' if initials or a suffix leave it open. They share an initial by their block."""
        if self.suffixes and o.suffixes and not self.suffixes & o.suffixes or self.middles and o.middles and not self.middles & o.middles:
            return ""
        if not self.cores & o.cores and not any(core_match(a, b) for a in self.cores for b in o.cores):
            return ""
        if self.firsts and o.firsts:
            if not self.firsts & o.firsts and not any(given_match(a, b) for a in self.firsts for b in o.firsts):
                return ""
            return "strong" if bool(self.suffixes) == bool(o.suffixes) else "weak"
        return "weak"


#: Profiles that a cell of a block holds of each of its two sides.
CELL = 500
PROPOSALS = "pid string, sure_n long, sure string, low string, high string, open_n long, open string"


def _proposals(held: list) -> list[tuple]:
    """Of one cell, for each profile: the best sure match before it (fullest first); without one the smallest and largest
    profile with given names that could take it, and the best one without that comes before it."""
    if len(held) < 2:
        return []
    person = held[0].kind == "P"
    all_ = sorted((Profile(r) for r in held), key=lambda p: p.rank)
    out = []
    for i, p in enumerate(all_):
        sure, weak = None, []
        for q in all_[:i]:
            if person:
                m = p.match(q)
            else:
                m = "strong" if p.cores & q.cores or any(core_match(a, b) for a in p.cores for b in q.cores) else ""
            if m == "strong":
                sure = q
                break
            if m:
                weak.append((q, True))
        if sure is not None:
            out.append((p.pid, sure.n, sure.pid, None, None, None, None))
        elif person:
            weak += [(q, False) for q in all_[i + 1 :] if (q.firsts or not p.firsts) and p.match(q) == "weak"]
            full = [q.pid for q, _ in weak if q.firsts]
            first = next((q for q, before in weak if before and not p.firsts and not q.firsts), None)
            if full or first:
                out.append((p.pid, None, None, min(full, default=None), max(full, default=None), first.n if first else None, first.pid if first else None))
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell, and a cell may span batches; cells are small and many, so none gets a frame of its own."""
    columns = [c.split()[0] for c in PROPOSALS.split(", ")]
    key, held, out = None, [], []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if key != (k := (r.key, r.i, r.j)):
                out += _proposals(held)
                key, held = k, []
            held.append(r)
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(_proposals(held), columns=columns)


def spellings(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name) distinct, names and aliases; (name, alias) distinct."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    own = entities.select(squeeze(F.col("name")).alias("name"), "aliases_json").filter("name <> ''")
    aliases = own.select("name", F.explode(F.from_json("aliases_json", "array<string>")).alias("alias")).select("name", squeeze(F.col("alias")).alias("alias")).filter("alias <> '' and alias <> name").distinct()
    return own.select("name").unionByName(aliases.select(F.col("alias").alias("name"))).distinct(), aliases


def features(names: DataFrame) -> DataFrame:
    """The parts of each distinct name, by FEATURES."""
    folded = names.select("name", F.translate(F.lower("name"), "áàâäãåéèêëíìîïóòôöõúùûüñçýćčšžđ", "aaaaaaeeeeiiiiooooouuuuncyccszd").alias("f"))
    part = lambda pattern, k: F.regexp_extract("f", pattern, k)
    comma, middle = r"^(\w{2,}), (\w{2,})(?: \w\.?)?$", r"^(\w{2,}) \w\.? (\w{2,})(?:,|$)"
    roles = F.array(*[F.struct(part(p, k).alias("word"), F.lit(v).alias("v")) for p, k, v in ((comma, 2, 1), (comma, 1, -1), (middle, 1, 1), (middle, 2, -1))])
    lean = folded.select(F.explode(roles).alias("r")).filter("r.word <> ''").groupBy("r.word").agg(F.sum("r.v").alias("v"))
    two = folded.filter(F.col("f").rlike(r"^[\w.]+ [\w.]+$")).select("name", F.explode(F.regexp_extract_all("f", F.lit(r"\w{2,}"), F.lit(0))).alias("word"))
    of_name = two.join(lean, "word").groupBy("name", "word").agg(F.max("v").alias("v")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("leaning"))
    return cut(names.join(of_name, "name", "left").mapInPandas(_parser, FEATURES))


def _holes(c: Column) -> Column:
    """All forms with one letter left out."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def core_forms(parts: DataFrame) -> DataFrame:
    """(core, form, near): each core itself, and the forms with one or two letters left out that it shares with others, as far as core_match goes.

    near says that no more than one letter is left out. Forms that the same cores share count once, told by a digest of the set, so that blocks are not compared again.
    """
    cores = spread(parts.select("core"))
    n = F.length("core")
    none = F.array().cast("array<string>")
    one = F.array_append(F.when(n >= ONE, _holes(F.col("core"))).otherwise(none), F.col("core"))
    two = F.when(n >= TWO, F.flatten(F.transform(_holes(F.col("core")), _holes))).otherwise(none)
    # Forms go by their hash; a clash only gives a pair to compare more.
    hashed = lambda a, near: F.transform(a, lambda x: F.struct(F.xxhash64(x).alias("form"), F.lit(near).alias("near")))
    forms = cores.select("core", one.alias("one"), two.alias("two")).select("core", F.explode(F.concat(hashed(F.array_distinct("one"), True), hashed(F.array_except("two", "one"), False))).alias("f"))
    forms = cut(forms.select("core", F.xxhash64("core").alias("hash"), "f.form", "f.near"))
    sets = forms.groupBy("form").agg(F.count("*").alias("n"), F.bit_xor("hash").alias("x"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.min("near").alias("all_near")).filter("n > 1")
    # Of forms with the same cores the nearest one stays.
    kept = sets.groupBy("n", "x", "lo", "hi").agg(F.max_by("form", F.struct("all_near", "form")).alias("form")).select("form")
    shared = forms.join(kept, "form", "left_semi").select("core", F.concat(F.lit("~"), "form").alias("form"), "near")
    return cut(shared.unionByName(cores.select("core", F.col("core").alias("form"), F.lit(True).alias("near"))))


def _united(rows: DataFrame) -> DataFrame:
    """Profiles from (pid, kind, sig, cores, firsts, initials, middles, suffixes, n), the rows of a pid united."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return rows.groupBy("pid", "kind", "sig").agg(*[union(c) for c in ("cores", "firsts", "initials", "middles", "suffixes")], F.sum("n").alias("n"))


def proposals(profiles: DataFrame, forms: DataFrame) -> DataFrame:
    """One row (PROPOSALS) for each profile that could merge into another, from all its blocks."""
    by_core = profiles.select("*", F.explode("cores").alias("core")).join(forms.select("core", "form"), "core")
    initial = F.explode(F.when(F.col("kind") == "O", F.array(F.lit(""))).otherwise(F.col("initials")))
    keyed = by_core.withColumn("initial", initial).withColumn("key", F.concat_ws("\u0001", "kind", "sig", "form", "initial"))
    keyed = keyed.select("key", "pid", "kind", "cores", "firsts", "middles", "suffixes", "n").dropDuplicates(["key", "pid"])
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", F.ceil(F.col("size") / CELL).cast("int").alias("parts"))
    placed = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    placed = placed.select("key", "i", "j", "pid", "kind", "cores", "firsts", "middles", "suffixes", "n").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    told = placed.mapInPandas(_cells, PROPOSALS)
    best = lambda n, p: F.min(F.when(F.col(p).isNotNull(), F.struct((-F.col(n)).alias("n"), F.col(p).alias("pid"))))["pid"]
    return cut(told.groupBy("pid").agg(best("sure_n", "sure").alias("sure"), F.min("low").alias("low"), F.max("high").alias("high"), best("open_n", "open").alias("open")))


def _accepted(moves: DataFrame, profiles: DataFrame) -> DataFrame:
    """Of (pid, to) those that may be carried out at once: nobody moves into one that moves itself, and what moves into one agrees on middle names and suffixes."""
    traits = ("middles", "suffixes", "n")
    of = lambda c, p: profiles.select(F.col("pid").alias(c), *[F.col(t).alias(f"{p}_{t}") for t in traits])
    # Two that name each other: the less full one moves.
    back = moves.select(F.col("to").alias("pid"), F.col("pid").alias("to"), F.lit(True).alias("mutual"))
    m = moves.join(of("pid", "p"), "pid").join(of("to", "q"), "to").join(back, ["pid", "to"], "left")
    m = m.filter(F.col("mutual").isNull() | (F.struct(-F.col("p_n"), "pid") > F.struct(-F.col("q_n"), "to")))
    m = cut(m.drop("mutual"))
    m = m.join(m.select(F.col("pid").alias("to")), "to", "left_anti")
    for t in ("middles", "suffixes"):
        told = F.when((F.size(f"p_{t}") > 0) & (F.size(f"q_{t}") == 0), F.struct((-F.col("p_n")).alias("n"), "pid", F.col(f"p_{t}").alias("v")))
        m = m.join(m.groupBy("to").agg(F.min(told)["v"].alias("lead")), "to").filter(F.col("lead").isNull() | (F.size(f"p_{t}") == 0) | F.arrays_overlap("lead", f"p_{t}")).drop("lead")
    return cut(m.select("pid", "to"))


def name_groups(entities: DataFrame) -> DataFrame:
    """(name, group): the spellings that name the same person or body share a group."""
    names, aliases = spellings(entities)
    parts = features(names)
    forms = core_forms(parts)
    nick = F.create_map(*[F.lit(x) for k, v in NICKNAMES.items() for x in (k, v)])
    formal = F.coalesce(F.try_element_at(nick, F.col("first")), F.col("first"))
    filled = lambda c: F.filter(F.array(c), lambda x: x != "")
    initials = F.filter(F.array_distinct(F.concat(F.transform(F.split(formal, " "), lambda x: F.left(x, F.lit(1))), F.array("extra"))), lambda x: x != "")
    parts = parts.withColumn("formal", formal).withColumn("pid", F.sha2(F.to_json(F.struct("kind", "core", "sig", "formal", "middle", "suffix", "extra")), 256))
    parts = cut(parts.withColumns({"initials": initials, "long": F.length("first") > 1}))
    own = parts.select("pid", "kind", "sig", F.array("core").alias("cores"), F.when(F.col("long"), F.array("first")).otherwise(filled(F.lit(""))).alias("firsts"), "initials", filled(F.col("middle")).alias("middles"), filled(F.col("suffix")).alias("suffixes"), F.lit(1).alias("n"))
    profiles = cut(_united(own))
    # Who initials are, by aliases: of the same kind, suffix and initial, and of a family name that matches.
    side = lambda p: parts.select(*[F.col(c).alias(f"{p}_{c}") for c in ("name", "pid", "kind", "core", "first", "suffix", "sig")])
    told = aliases.join(side("n"), F.col("name") == F.col("n_name")).join(side("a"), F.col("alias") == F.col("a_name"))
    told = told.filter("n_pid <> a_pid and n_kind = a_kind and n_suffix = a_suffix and n_sig = a_sig and n_first <> '' and a_first <> ''")
    told = told.filter(((F.length("n_first") == 1) | (F.length("a_first") == 1)) & (F.left("n_first", F.lit(1)) == F.left("a_first", F.lit(1))))
    near = forms.select(F.col("core").alias("n_core"), "form").join(forms.select(F.col("core").alias("a_core"), "form"), "form").select("n_core", "a_core").distinct()
    told = cut(told.join(near, ["n_core", "a_core"], "left_semi").select("n_pid", "a_pid").distinct())
    group = cut(parts.select("pid").distinct().withColumn("to", F.col("pid")))  # first profile, and what it is in now, but for the steps
    steps: list[DataFrame] = []

    def settled() -> DataFrame:
        """group with all steps taken, in one job."""
        after = group
        for step in steps:
            after = after.join(step, F.col("to") == F.col("was"), "left").select("pid", F.coalesce("then", "to").alias("to"))
        steps.clear()
        return cut(after)

    while True:
        tidy(profiles.sparkSession)
        found = proposals(profiles, forms)
        sure = found.filter("sure is not null").select("pid", F.col("sure").alias("to"))
        moves = None if sure.isEmpty() else _accepted(sure, profiles)
        if moves is None or moves.isEmpty():
            group = settled()
            now = lambda c, p: group.select(F.col("pid").alias(c), F.col("to").alias(p))
            bridge = told.join(now("n_pid", "x"), "n_pid").join(now("a_pid", "y"), "a_pid").filter("x <> y").select("x", "y")
            bridge = bridge.unionByName(bridge.select(F.col("y").alias("x"), F.col("x").alias("y"))).join(profiles.filter("size(firsts) = 0").select(F.col("pid").alias("x")), "x", "left_semi")
            bridge = bridge.groupBy(F.col("x").alias("pid")).agg(F.min("y").alias("alias"), F.max("y").alias("alias_high")).filter("alias = alias_high").select("pid", "alias")
            to = F.coalesce("alias", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNull(), F.col("open")))
            moves = _accepted(found.join(bridge, "pid", "full").select("pid", to.alias("to")).filter("to is not null"), profiles)
            if moves.isEmpty():
                break
        step = moves.withColumnsRenamed({"pid": "was", "to": "then"})
        steps.append(step)
        profiles = cut(_united(profiles.join(step, F.col("pid") == F.col("was"), "left").withColumn("pid", F.coalesce("then", "pid")).drop("was", "then")))
    named = cut(parts.join(group, "pid").select("name", "kind", "core", "first", F.col("to").alias("group")))
    return named.filter("kind = 'O' or first <> ''").select("name", "group").unionByName(_lone(named, forms))


def _lone(named: DataFrame, forms: DataFrame) -> DataFrame:
    """(name, group) of names without a given name: the one person who bears the family name, else the one who bears one like it; else those alike stay together."""
    people = named.filter("kind = 'P' and first <> ''").groupBy("core").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    lone = named.filter("kind = 'P' and first = ''").select("name", "core")
    near = forms.filter("near")
    by_form = near.join(people, "core").groupBy("form").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    like = near.join(lone.select("core").distinct(), "core", "left_semi").join(by_form, "form").groupBy("core").agg(F.min("lo").alias("near_lo"), F.max("hi").alias("near_hi"))
    # Alone in their family: told apart by the smallest core that shares a form.
    heads = near.join(lone.select("core").distinct(), "core", "left_semi")
    heads = heads.join(heads.groupBy("form").agg(F.min("core").alias("head")), "form").groupBy("core").agg(F.min("head").alias("head"))
    taker = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull() & (F.col("near_lo") == F.col("near_hi")), F.col("near_lo"))
    return lone.join(people, "core", "left").join(like, "core", "left").join(heads, "core").select("name", F.coalesce(taker, F.concat(F.lit("="), "head")).alias("group"))


def entity_groups(entities: DataFrame) -> DataFrame:
    """(entity_id, group_id): one row for each entity that is somebody, with the smallest entity_id of its group."""
    squeeze = F.trim(F.regexp_replace("name", r"\s+", " "))
    ids = entities.filter("entity_id is not null").select("entity_id", squeeze.alias("name")).distinct()
    grouped = cut(ids.join(name_groups(entities), "name").select("entity_id", "group").distinct())
    heads = grouped.groupBy("group").agg(F.min("entity_id").alias("group_id"))
    return grouped.join(heads, "group").select("entity_id", "group_id").distinct()


#: Members of a group that one task pairs with all others.
SLICE = 1000


def entity_pairs(entities: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b), smaller first: all pairs of entities of one group, as the result is defined; entity_groups has the same in one row each.

    Large groups are paired in slices, so no task holds all pairs of a group.
    """
    grouped = cut(entity_groups(entities))
    slices = grouped.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    sized = grouped.join(slices, "group_id")
    a = sized.select(F.col("entity_id").alias("entity_id_a"), "group_id", F.pmod(F.xxhash64("entity_id"), F.col("slices")).cast("int").alias("slice"))
    b = sized.select(F.col("entity_id").alias("entity_id_b"), "group_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return a.join(b, ["group_id", "slice"]).filter("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()
