"""Sentence boundaries in many languages and scripts, as SQL expressions only.

Marks that end no sentence (in decimals, URLs, initials, abbreviations, quotations and brackets) are
masked by private-use characters of the same width, terminators of each script are then marked, the
text is split at the marks and the masks are undone. As every mask is one character for one
character, lengths of the pieces give exact offsets in the original text.

Defined results: null text gives null, empty or blank text gives no units; private-use characters
of the text itself that collide with the masks (U+E000 to U+E00B, U+E0FF) read as U+FFFD in the
units' text, offsets stay exact. Units cover everything but white space. Repeated rows each get
their own units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminators, their masks and the words before a full stop that ends nothing.
TERMINATORS = ".!?;。！？।॥۔؟။።፧։។．｡…\u037e"
MASKS = "".join(chr(0xE000 + i) for i in range(len(TERMINATORS)))
MARK = "\ue0ff"
_PRIVATE = "[\ue000-\ue0ff]"
TITLES = (
    "Mr Mrs Ms Dr Prof Lt Messrs Mmes Hon Rev Gen Capt Sgt Col Maj Gov Sen Rep Sr Sra Srta Dra Lic Ing Mgr Pte "
    "гр ул им см д-р проф डॉ सं श्री د άρθρ παρ αρ αριθ EE ዓ.ም RA"
)
REFERENCES = (
    "No no Nos Nr núm Núm pág págs párr fl fls cf Cf vgl Vgl Bl Abs Art art Arts Sec sec Ex Exh Dep Tr Compl Br id Id "
    "Apt ch Ch pp vol Vol ed Ed Rn Ziff Tel ext Op Cir App Supp ст п л ч кв стр p P para Para fig Fig approx bzgl ggf ca evtl sog Hs"
)
MONTHS = (
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr avr juil sept oct nov déc ene feb abr ago dic "
    "Mär Okt Dez fev mai set out dez янв февр апр авг сент окт нояб дек"
)
SUFFIXES = "Inc Co Corp Ltd LLC Ltda Cía Jr etc GmbH AG руб тыс млн usw ff Bros Assn Mfg Univ Dept No"
SPEECH = (
    "said|shouted|asked|wrote|replied|answered|added|testified|stated|cried|whispered|warned|explained|insisted"
)
MONTH_NAMES = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

_OPEN = "“„«‹「『（\\(\\[\"'‘¿¡"
_CLOSE = "”“»›」』）\\)\\]\"'’"
#: What may begin a unit: a capital, a digit, a letter of a script without case, or a brand such as iName.
_BEGIN = rf"[{_OPEN}—–-]*\s?(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}§¶]|[ei]-?\p{{Lu}})"
_SPANS = "|".join(
    (
        "„[^„“”]*[“”]", "“[^“”]*”", "«[^«»]*»", "「[^「」]*」", "『[^『』]*』", "（[^（）]*）", r"\([^()]*\)", r"\[[^\[\]]*\]", '"[^"]*"',
        "[^„“«「『（(\\[\"]+", "(?s:.)",
    )
)


def _words(*lists: str) -> str:
    return "|".join(sorted({w.replace(".", r"\.") for x in lists for w in x.split()}, key=lambda w: (-len(w), w)))


_DOT = MASKS[0]
_NOT_WORD = r"(?<![\p{L}\p{M}])"
#: What stands before and after a full stop that ends nothing. The stop itself comes first in the pattern, so that other characters fail at once.
_INNER = (
    (r"[\p{L}\d/_-]", r"[\p{Ll}\d_/-]"),  # decimals, versions, URLs, mail addresses, file names
    (r"(?<![\p{L}\p{N}\p{M}'’.])\p{L}", r"\s"),  # initials, z. B.
    (r"\p{Ll}{2}\.\p{Lu}", r"\s"),  # an initial after a missing blank
    (rf"{_NOT_WORD}(?:{_words(TITLES, REFERENCES)})", r"\s"),
    (rf"{_NOT_WORD}(?:{_words(MONTHS)})", r"\s+\d"),
    (rf"{_NOT_WORD}Co", r"\s+(?:KG|OHG)\b"),
    (rf"{_NOT_WORD}(?:{_words(SUFFIXES)})", r"\s+\p{Lo}"),
    (r"\p{Lu}\.\p{Lu}", r"\s+[§¶\p{Lo}]"),
    (r"\b\d{1,2}", rf"\s+(?:{MONTH_NAMES})\b"),
    (r"\b\d{1,2}", r"\s+\d{1,2}\.\s+\d{4}"),
    (r"\b\d{1,2}\.\s{1,3}\d{1,2}", r"\s+\d{4}"),
    (r"\b(?:[Dd](?:er|ie|as|en|em|es)|[AaIi]m|[Vv]om|[Zz]u[mr]|[Bb]eim)\s{1,3}\d{1,3}", r"\s+\p{Lu}\p{Ll}"),
    (r"\n\s{0,20}\d{1,3}", r"\s+\p{Lu}"),  # a list number opens the line
    (r"\s", r"\s\."),  # . . .
    (r"\.\s", r"\s"),
)
_MASKING = (
    (r"\.(?:" + "|".join(rf"(?<=(?:{before})\.)(?={after})" for before, after in _INNER) + ")", _DOT),
    (r"\A(\s*(?:\d{1,3}|[IVXLC]{1,6}))\.(?=\s)", "$1" + _DOT),  # or the paragraph
)

_Q = MASKS[1] + MASKS[2]
_M = f"{MASKS[0]}-{MASKS[-1]}"
_MARKING = (
    # Someone says what was quoted: no boundary after the quotation's own mark.
    (rf"([{_Q}][{_CLOSE}]+)(?=\s+(?:\p{{Lu}}[\p{{L}}\p{{M}}.{_DOT}'’-]*\s+){{1,4}}(?:{SPEECH})\b)", "$1\ue0fe"),
    # After a quotation a script without case may go on, so only a capital or a digit begins a unit there.
    (rf"([{_M}][{_CLOSE}]+)(?=\s+{_BEGIN.replace(chr(92) + 'p{Lo}', '')})", "$1" + MARK),
    (rf"([{_M}](?<=\p{{IsLatin}}.)[{_CLOSE}]+)(?=\s+\p{{Lo}})", "$1" + MARK),
    (rf"([.!?؟…．]+[{_CLOSE}]*)(?=\s+{_BEGIN})", "$1" + MARK),
    (r"([.!?](?<=[\p{Ll}\p{Lo}\d%)”]{2}.))(?=[“«]?\p{Lu}[\p{Ll}.\s’])", "$1" + MARK),  # the blank is missing
    # Marks that need no blank after them; the range comes first, so that Latin letters fail at once.
    (r"([\u0589-\uff61&&[。！？｡]]+[”」』）)»]*|[\u0589-\uff61&&[।॥۔။።፧։។]]+[”»’)\u0022]*)", "$1" + MARK),
    (r"([;\u037e](?<=\p{IsGreek}.)[”»]*)(?=\s+" + _BEGIN + ")", "$1" + MARK),
)
_THAI = (rf"((?<=[\u0e00-\u0e7f])\s+)(?=[\u0e00-\u0e7f]|[{_OPEN}]*[\p{{Lu}}\p{{Lo}}&&[^\u0e00-\u0e7f]])", "$1" + MARK)


def _swap(c: Column, masked: bool) -> Column:
    return F.translate(c, MASKS, TERMINATORS) if masked else F.translate(c, TERMINATORS, MASKS)


def _mask(p: Column) -> Column:
    for pattern, to in _MASKING:
        p = F.regexp_replace(p, pattern, to)
    return p


def _quotations(p: Column) -> Column:
    """The paragraph with all terminators inside quotations and brackets masked."""
    opens = F.lit("^(?s)[„“«「『（(\\[\"].+")
    spans = F.transform(F.regexp_extract_all(p, F.lit(_SPANS), F.lit(0)), lambda x: F.when(F.regexp_like(x, opens), _swap(x, False)).otherwise(x))
    return F.when(p.rlike("[”“»」』）)\\]\"]"), F.array_join(spans, "")).otherwise(p)


def _mark(p: Column) -> Column:
    for pattern, to in _MARKING:
        p = F.regexp_replace(p, pattern, to)
    return F.replace(p, F.lit("\ue0fe"), F.lit(""))


def pieces(text: Column) -> Column:
    """array<string> that joined gives the text; each piece is one unit with the white space around it.

    Each step is a transform of its own, so that no step's result is computed twice.
    """
    t = F.when(text.rlike(_PRIVATE), F.translate(text, MASKS + MARK + "\ue0fe", "\ufffd" * (len(MASKS) + 2))).otherwise(text)
    p = F.split(F.regexp_replace(t, r"(\n[^\S\n]*\n\s*|\x{2029}|\f)", "$1" + MARK), MARK)
    for step in (_mask, _quotations, _mark):
        p = F.transform(p, step)
    p = F.transform(p, lambda x: F.when(F.regexp_like(x, F.lit(r"[\u0e00-\u0e7f]\s")), F.regexp_replace(x, *_THAI)).otherwise(x))
    return F.transform(F.flatten(F.transform(p, lambda x: F.split(x, MARK))), lambda x: F.when(x.rlike(_PRIVATE), _swap(x, True)).otherwise(x))


#: Pieces whose offsets are summed one by one; blocks of them are summed first, so that no long array is copied for each piece.
RUN = 64


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sentence_units(text: Column) -> Column:
    """array<struct<text string, start_char int, end_char int>>: start from 0, end exclusive, without outer white space."""
    left = F.transform(pieces(text), lambda x: F.struct(F.length(x).alias("n"), F.regexp_replace(x, r"\A(?U:\s)+", "").alias("t")))
    both = F.transform(left, lambda x: F.struct(x["n"].alias("n"), (x["n"] - F.length(x["t"])).alias("lead"), F.regexp_replace(x["t"], r"(?U:\s)+\z", "").alias("text")))
    sized = F.transform(both, lambda x: F.struct(x["n"].alias("n"), x["lead"].alias("lead"), x["text"].alias("text"), F.length(x["text"]).alias("m")))
    # The start of each block of pieces, then that of each piece in its block.
    runs = _once(sized, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda i: F.slice(a, i * RUN + 1, F.lit(RUN))))
    added = F.transform(runs, lambda r: F.struct(r.alias("run"), F.aggregate(r, F.lit(0), lambda t, x: t + x["n"]).alias("n")))
    unit = F.struct(F.lit("").alias("text"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"))
    none = F.filter(F.array(unit), lambda x: F.lit(False))

    def place(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["lead"]
        unit = F.struct(x["text"].alias("text"), start.alias("start_char"), (start + x["m"]).alias("end_char"))
        return F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["m"] > 0, F.concat(acc["units"], F.array(unit))).otherwise(acc["units"]).alias("units"))

    def offsets(a: Column) -> Column:
        starts = F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), place, lambda acc: acc["starts"])
        return F.zip_with(a, starts, lambda x, at: F.aggregate(x["run"], F.struct(at.alias("at"), none.alias("units")), step, lambda acc: acc["units"]))

    return F.flatten(_once(added, offsets))
