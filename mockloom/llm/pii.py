"""Personal data in texts: patterns propose, checksums confirm, context words move the score. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Matches whose places are summed in one go.
BLOCK = 512
#: Score from which an added span is kept.
KEEP = 0.5

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A pattern that begins with a run of one class only needs to be tried where that
# run begins or the last match ended; without that, long runs cost the square of
# their length. Repetitions are possessive where nothing that follows could use
# what they give back, so that matching takes no stack.


def _begin(kind: str) -> str:
    return rf"(?:(?<![{kind}])|\G)"


def digits(span: Column) -> Column:
    return F.translate(span, " -().+", "")


def luhn(span: Column) -> Column:
    """Every second digit from the right doubled, digits summed, a multiple of ten."""
    code = F.reverse(digits(span))
    value = lambda i: F.substring(code, i, 1).cast("int")
    weigh = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), lambda acc, i: acc + weigh(i))
    return total % 10 == 0


def mod97(span: Column) -> Column:
    """First four characters to the end, letters as 10 to 35: the number leaves 1 modulo 97."""
    code = F.upper(F.translate(span, " ", ""))
    code = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    point = lambda i: F.ascii(F.substring(code, i, 1))
    add = lambda acc, i: F.when(point(i) > 57, acc * 100 + point(i) - 55).otherwise(acc * 10 + point(i) - 48) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), add) == 1


#: Characters of an IBAN by country, as registered.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """What begins like an IBAN, with as many characters as its country has in group 1; other countries may have 15 to 34.

    Only the first four characters are consumed, so that a code that fails its
    check hides no other that begins inside it.
    """
    known = "|".join(c for v in _IBAN_LENGTHS.values() for c in v.split())
    shapes = [rf"(?:{v.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, v in _IBAN_LENGTHS.items()]
    shapes.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join(shapes)})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


def _size(span: Column, low: int, high: int) -> Column:
    return F.length(digits(span)).between(low, high)


class Kind(NamedTuple):
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    #: A string without which the pattern can't match, or a pattern of it.
    needs: str
    score: float
    words: str = ""
    base: bool = True
    #: Characters a match consumes if its span is group 1, which may reach further; 0 if it is the whole match.
    head: int = 0


KINDS = [
    Kind("email", _begin(_LOCAL) + rf"[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", lambda s: F.lit(True), "@", 0.9, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", _begin("0-9") + r"[0-9]++(?:\.[0-9]++){3}", lambda s: s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"), ".", 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", _begin("0-9") + r"[0-9](?:[ -]?[0-9])++", lambda s: _size(s, 14, 19) & luhn(s), "", 0.7, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda s: _size(s, 10, 15), "+", 0.7, r"phone|\btel|call|mobile|\bfax"),
    Kind("iban", _iban(), lambda s: F.length(F.translate(s, " ", "")).between(15, 34) & mod97(s), "", 0.8, "iban|bank|konto|account|cuenta|compte", False, 4),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", lambda s: F.lit(True), "-", 0.3, r"\bssn\b|social.{1,3}security|tax", False),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, pattern: str, valid: Callable[[Column], Column], head: int = 0) -> Column:
    """Valid matches: array of (start, end, span).

    What lies between the matches and the matches themselves, in turn, give the
    places: a start is the length of all gaps so far and of all matches before.
    Sums run in blocks of BLOCK matches, so that texts with many take no square time.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if head else 0)).alias("span"))
    long = lambda x: F.coalesce(F.length(x["span"]), F.lit(0))
    taken = lambda x: F.when(x["span"].isNotNull(), head).otherwise(0) if head else long(x)
    size = lambda x: F.length(x["gap"]) + taken(x)
    none = F.array().cast("array<struct<start:int,end:int,span:string>>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + long(x)
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["span"].alias("span")))
        good = x["span"].isNotNull() & valid(x["span"])
        return F.struct((begin + taken(x)).alias("at"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def block(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("found")), add)["found"]

    def offsets(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + size(x)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(sizes, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    cut = lambda z: F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(BLOCK)), lambda i: F.slice(z, i + 1, BLOCK))
    joined = lambda bs: _let(offsets(bs), lambda off: F.flatten(F.transform(bs, lambda part, i: block(part, F.get(off, i)))))
    return _let(_let(pieces, cut), joined)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Valid spans of one kind: array of (start, rank, kind, end, span, score, base)."""
    found = _places(text, kind.pattern, kind.valid, kind.head)
    around = lambda x: F.lower(F.concat(
        F.substring(text, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), F.least(F.lit(CONTEXT), x["start"])), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(CONTEXT))))
    score = lambda x: F.lit(kind.score) + F.when(around(x).rlike(kind.words), 0.3).otherwise(0.0)
    out = F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), x["end"].alias("end"),
        x["span"].alias("span"), F.least(F.lit(1.0), score(x)).alias("score"), F.lit(kind.base).alias("base")))
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= KEEP)
    likely = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(likely & text.rlike(kind.pattern), out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans by start, then kind as listed in KINDS.

    Base kinds (email, ip, card, phone) are kept when their check holds, whatever
    the score; the others also need a score of KEEP, to which context words near
    the span add. Places are code points, end exclusive. One pass, no shuffle.

    A null text is empty and gives no spans, as does an empty one. Repeated rows
    and null ids are kept; an empty table gives no rows. Patterns run in time
    linear in the text and without recursion, so texts of any length are read whole.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kinds = [_spans(F.col("text"), k, r) for r, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,span:string,score:double,base:boolean>>")
    return source.select("doc_id", F.array_sort(F.concat(*[F.coalesce(k, none) for k in kinds])).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, all spans as text, and the scores."""
    spans = F.col("spans")
    text = lambda array: F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda name: F.size(F.filter(spans, lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter(spans, lambda x: x["base"])
    return found.select(
        "doc_id", *[count(k.name) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))
