"""Rules on lines, sentences, roles, topics and intents of filings, as column expressions.

Null in gives null out, unless said otherwise. The tables below are values that other tools of the same data share, so they are stated as
they are; patterns that name single cases or parties are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import text as T

# Fixed values.
SECTION_NAMES = (
    "introduction", "intro", "jurisdiction", "venue", "jurisdiction and venue", "parties", "the parties", "facts", "factual background", "factual allegations", "factual history", "background",
    "cause of action", "first cause of action", "second cause of action", "third cause of action", "fourth cause of action", "fifth cause of action", "sixth cause of action",
    "seventh cause of action", "eighth cause of action", "v cause of action", "vi cause of action", "ve cause of action",
    "count i", "count ii", "count iii", "count iv", "count v", "count vi", "count 1", "count 2", "count 3", "count 4", "prayer for relief", "relief requested", "request for relief",
    "jury trial demanded", "demand for jury trial", "jury trial demand", "exhaustion of administrative remedies", "administrative exhaustion", "basis for instant action", "basis for action",
    "procedural prerequisites", "procedural prerequisite", "nature of the action", "nature of action", "civil complaint", "complaint", "designation form", "arbitration certification",
    "disability discrimination and retaliation under the ada", "retaliation under the fmla", "violation of title vii", "violation of phra", "discrimination under the americans with disabilities act",
    "failure to accommodate under the americans with disabilities act", "retaliation under the americans with disabilities act", "interference and retaliation under the family medical leave act",
    "discrimination under pennsylvania human relations act", "retaliation under the pennsylvania human relations act", "aiding and abetting under the pennsylvania human relations act",
    "discrimination under the philadelphia fair practices ordinance", "verification", "violation of title vii--sexual harassment and retaliation",
)
SECTION_TYPOS = (
    (r"counti([^\pL\pN_]|$)", "count i$1"), (r"count\s*it([^\pL\pN_]|$)", "count ii$1"), (r"(^|[^\pL\pN_])ve\s+cause", "$1v cause"),
    ("jurisidction", "jurisdiction"), ("diserimination", "discrimination"), (r"title\s*vu([^\pL\pN_]|$)", "title vii$1"), (r"title\s*vii([^\pL\pN_]|$)", "title vii$1"),
)
NOT_SECTIONS = (
    r"^defendants?\s*$", r"^plaintiffs?\s*$", r"^in the united states district court\s*$", r"^for the eastern district of pennsylvania\s*$", r"^civil cover sheet\s*$", r"^civil action\s*$", r"^civil action no\.?\s*$",
    r"^attorneys?\s*\(", r"^county of residence", r"^nature of suit", r"^basis of jurisdiction", r"^citizenship of principal parties", r"^the tract of land", r"^related case", r"^date signature of attorney",
    r"^amount applying ifp", r"^mag\.?\s*judge", r"^except in u\.s\. plaintiff", r"^designation form\s*$", r"^arbitration certification\s*$", r"^case management track designation", r"^contract torts forfeit",
    r"^receipt\s*#", r"^l\s*\(a\)\s*plaintiffs defendants", r"^complaint:.*rule 23", r"^\d+ u\.s\.c\.", r"^exhibit\s+[a-z]\s*$", r"^dismissal and notice of rights\s*$", r"^confidential\s*\(", r"^notice of suit rights\s*$",
    r"^\(?except in u\.s\. plaintiff", r"^note: inland", r"^for office use only", r"^united states district court\s*$", r"^v\.\s*;\s*\(.*jurors demanded", r"^eeoc form\s+\d+", r"^-\s*notice of suit rights\s*-",
    r"^l\s*_contract", r"^\[\s*contract torts", r"^\(?in u\.s\. plaintiff cases only", r"^[ivx]+\.\s*related case\s*\(s\)\s*$", r"^:\s*jury trial by twelve",
)
JUNK_LINES = (
    r"^source url:", r"^title:", r"^case\s+\d+[:-]\d+[\w-]*\s+document\s+\d+", r"^page\s+\d+\s+of\s+\d+\s*$", r"^filed\s+\d{2}/\d{2}/\d{2}", r"^in the united states district court\s*$",
    r"^for the eastern district of pennsylvania\s*$", r"^js 44", r"^civil cover sheet\s*$", r"^[\d\s]+$", r"^(?::|v\.|v)$", r"\s+:\s*$", r"^(?:defendant|plaintiff)\.?\s*:\s*", r"^v\.\s*:\s*civil action", r"^civil action no\.?\s*$",
)
ABBREVIATIONS = "dr mr mrs ms sr jr us usc et seq etc no inc ltd corp co v cf id al ps ph phd".split()
LIGHT_VERBS = "is are was were be been being has have had do does did".split()
ACTION_VERBS = (
    "hire hired report reported assign assigned plan planned cause caused damage damaged cancel cancelled secure secured disclose disclosed terminate terminated ask asked respond responded "
    "state stated proceed proceeded impress impressed congratulate congratulated shock shocked change changed"
).split()
TOPICS = {
    "employment_discrimination": ("title vii", "hostile work environment", "retaliation", "wrongful termination", "hr", "eeoc", "discrimination"),
    "civil_rights_police": (r"42 u\.?s\.?c\.?\s*1983", "excessive force", "unlawful arrest", "false arrest", "fourth amendment", "search and seizure"),
    "contract_commercial": ("breach of contract", "agreement", "purchase order", "invoice", "commercial", r"indemnif\w+"),
    "personal_injury": ("negligence", "slip and fall", "premises liability", "duty of care", "personal injury", "damages"),
    "disability_accommodation": ("ada", "reasonable accommodation", r"disabilit\w+", "interactive process"),
    "wage_hour": ("fair labor standards act", "flsa", "overtime", "unpaid wages", "minimum wage"),
    "housing_property": ("eviction", "landlord", "tenant", "lease", "property", "foreclosure"),
    "consumer_finance_debt": ("fdcpa", "debt collection", "credit report", "consumer", "loan", "mortgage"),
    "education_university": ("title ix", "university", "school district", "student", "professor"),
    "medical_healthcare": ("medical", "physician", "hospital", "malpractice", "treatment"),
}
EVENTS = {
    "hiring": ("hired", "employed", "position"),
    "termination": ("terminated", "discharged", "fired", "constructive discharge"),
    "complaint_filed": ("complaint", "lawsuit", "civil action", "causes of action"),
    "internal_complaint": ("reported", "complained", "hr", "supervisor"),
    "retaliation": ("retaliation", r"retaliat\w+"),
    "harassment": (r"harass\w+", "hostile work environment"),
    "injury_or_harm": ("injury", "hurt", "assault", "trauma"),
    "arrest_search": ("arrest", "detained", "search", "seizure"),
    "contract_breach": ("breach", "failed to perform", "nonpayment", "default"),
    "accommodation_request": ("accommodation", "request(?:ed)? accommodation", "interactive process"),
}
ROLES = (
    ("plaintiff", "Plaintiff"), ("defendant", "Defendant"), ("institution|organization|company|employer|corporation|corp|inc|llc", "Institution"),
    ("supervisor|manager|cto|coo|ceo|executive|boss", "Supervisor"), ("employee|director|contractor|worker|staff", "Employee"), ("recruit", "Recruiter"), ("human resources|^hr$", "HR"),
)
#: What a question asks for: its words, and what each type of event is worth to it.
INTENTS = (
    (r"terminate|termination|fired|discharged|let go", ((1.0, ("TERMINATION", "DISCHARGE")), (0.45, ("PREGNANCYDISCLOSURE", "PARENTALLEAVEDISCUSSION", "SUPERVISORCHANGE", "MEETINGRESCHEDULE")), (0.2, ("SUPPORTING_FACT",)))),
    (r"why|cause|because|led to|lead to", ((0.75, ("PREGNANCYDISCLOSURE", "PARENTALLEAVEDISCUSSION", "SUPERVISORCHANGE", "TASKREQUEST", "TASKASSIGNMENT", "TOPICABANDONMENT")), (0.2, ("SUPPORTING_FACT",)))),
    (r"pregnan|maternity|parental leave|leave", ((0.8, ("PREGNANCYDISCLOSURE", "PARENTALLEAVEDISCUSSION", "SHOCKREACTION", "TOPICABANDONMENT")),)),
)

#: A word character of any script; the bounds of a phrase are characters that are none.
EDGE = r"[^\pL\pN_]"
SPACES = r"[\s\x1c-\x1f\x85\pZ]+"


def phrase(words: tuple[str, ...]) -> str:
    """A pattern for whole phrases, alike in engines with and without look-around."""
    return rf"(?:^|{EDGE})(?:{'|'.join(words)})(?:{EDGE}|$)"


def is_junk_line(line: Column) -> Column:
    """Page furniture, captions and stamps; true for blank lines."""
    s = T.strip(line)
    low = F.lower(s)
    caption = s.rlike(r"^[A-Z\s-]+,?\s*:\s*$") | (low.endswith("jury trial demanded") & s.endswith("JURY TRIAL DEMANDED") & (F.length(s) < 50))
    return (s == "") | low.rlike("|".join(f"(?:{p})" for p in JUNK_LINES)) | caption


def section_key(line: Column) -> Column:
    """The line as it is compared with names of sections: lower case, single blanks, common misreadings mended."""
    s = F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))
    for pattern, to in SECTION_TYPOS:
        s = F.regexp_replace(s, pattern, to)
    return s


def is_section_header(line: Column) -> Column:
    """Known names and counts, or nine tenths capitals; captions, parties and form labels are none."""
    s, key = T.strip(line), section_key(line)
    caption = s.contains(" : ") | s.endswith(":") | (F.lower(s).rlike(rf"(?:^|{EDGE})(?:defendant|plaintiff)\.?\s*$") & (F.length(s) < 50))
    form = key.rlike("|".join(f"(?:{p})" for p in NOT_SECTIONS))
    count = key.rlike(r"^count\s+(?:i+|\d+)\s*$|^count\s+i+\s+")
    letters, capitals = F.length(F.regexp_replace(s, r"[^\pL]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    known = key.isin(*SECTION_NAMES)
    loud = (F.length(s) >= 6) & (letters > 0) & (capitals >= 0.9 * letters) & ~form
    return (F.length(s) >= 4) & ~caption & F.when(known, ~form).otherwise(count | loud)


def has_action_verb(c: Column) -> Column:
    """Is there a word of three letters and more that ends like a past or progressive form, or is on the list, and is no light verb?"""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z'-]*"), F.lit(0))
    return F.exists(words, lambda w: (F.length(w) >= 3) & ~w.isin(*LIGHT_VERBS) & (w.rlike("(?:ed|ing)$") | w.isin(*ACTION_VERBS)))


def _tags(c: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.rlike(phrase(p)), F.lit(k)) for k, p in sorted(rules.items())]))


def topics(c: Column) -> Column:
    """Topics whose phrases occur, sorted; other_general_civil if none."""
    found = _tags(c, TOPICS)
    return F.when(c.isNotNull(), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_general_civil"))))


def events(c: Column) -> Column:
    """Kinds of events whose phrases occur, sorted; none is an empty array."""
    return F.when(c.isNotNull(), _tags(c, EVENTS))


def role_label(c: Column) -> Column:
    """The short label of a role, by the first word of the ladder that occurs; empty for null, blank and other roles."""
    s = F.lower(T.strip(F.coalesce(c, F.lit(""))))
    out = F.when(s == "", "")
    for pattern, label in ROLES:
        out = out.when(s.rlike(pattern), label)
    return out.otherwise("")


def intent_score(question: Column, event_type: Column) -> Column:
    """From 0 to 1: what an event of this type is worth to what the question asks for; 0 for null."""
    q, kind = F.lower(F.coalesce(question, F.lit(""))), F.upper(F.coalesce(event_type, F.lit("")))
    total = F.lit(0.0)
    for words, worth in INTENTS:
        value = F.lit(0.0)
        for score, kinds in reversed(worth):
            value = F.when(kind.isin(*kinds), F.lit(score)).otherwise(value)
        total = total + F.when(q.rlike(words), value).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def split_sentences(c: Column) -> Column:
    """Sentences at . ! or ? and a blank before a capital, quotation mark, digit or dollar sign, but not after an abbreviation or a word of up to three
    characters and a full stop. White space becomes single blanks; a last sentence without a mark gets a full stop. A text that ends with an
    abbreviation keeps its last sentence."""
    t = F.translate(F.trim(F.regexp_replace(c, SPACES, " ")), "\u2024\u00b7", "..")
    short = "|".join(r"\.*".join(w) for w in ABBREVIATIONS)
    marked = F.regexp_replace(t, rf"(?<![^ ])(?!(?:[^ ]{{0,3}}|(?i:\.*(?:{short}))\.*)\. )([^ ]*[.?!]) (?=[A-Z\"'0-9$])", "$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))
