"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All of it is column expressions. Matches and the gaps between them come from one pattern each
(regexp_extract_all and split walk the text alike), and running sums of their lengths give the positions,
so a text is never searched once per match; the surroundings of a match come from pieces of fixed length. Patterns carry possessive quantifiers and look-behinds where
these change no match: a long run of digits or letters is then read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of an IBAN by country: the registry of ISO 13616, and the countries that use the form without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC NI", 33: "RU",
}
# the length ends a match, so that a word or number behind it is no part of it
_IBAN = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern, a character every match has, score of a valid match, words nearby that raise the score."""

    name: str
    pattern: str
    needs: str
    score: float
    context: tuple[str, ...] = ()
    bonus: float = 0.0


#: The base kinds; every valid match is a span, whatever stands nearby.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.95, ("mail", "e-mail", "contact"), 0.04),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.8, ("ip", "address", "host", "server"), 0.15),
    # a whole run of digits with single separators, of 14 to 19 digits; other runs fail and are not retried
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", 0.9, ("card", "visa", "credit", "pay"), 0.09),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.85, ("tel", "phone", "call", "fax", "mobile"), 0.1),
)
#: Further kinds; a valid match is a span if its score with the words nearby reaches ACCEPT.
EXTRA = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", "", 0.9, ("iban", "bank", "account"), 0.09),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, ("ssn", "social", "security", "taxpayer"), 0.45),
    Kind("local_phone", r"(?<![0-9+().-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])", "(", 0.4, ("tel", "phone", "call", "fax", "mobile"), 0.4),
)
KINDS = BASE + EXTRA
ACCEPT = 0.6
#: Characters on either side of a match that are searched for context words.
WINDOW = 40
#: Characters of a piece of text that windows are cut from, so that each costs a piece and not the text up to it; at least WINDOW.
PIECE = 512
#: Running sums are taken in blocks of this many, so that a text full of matches does not cost the square of their number.
BLOCK = 256


def running(lengths: Column) -> Column:
    """Sum of what stands before each element of an array of integers."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    within = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, x: F.struct(
        (acc.getField("s") + x).alias("s"), F.concat(acc.getField("a"), F.array(acc.getField("s"))).alias("a"))))
    total = F.aggregate(within, zero, lambda acc, w: F.struct(
        (acc.getField("s") + w.getField("s")).alias("s"),
        F.concat(acc.getField("a"), F.transform(w.getField("a"), lambda v: v + acc.getField("s"))).alias("a")))
    return F.when(F.size(lengths) > 0, total.getField("a")).otherwise(F.array().cast("array<bigint>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits hold: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def valid(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def around(start: Column, end: Column) -> Column:
    """Up to WINDOW characters before ``start`` and behind ``end``, whatever matches they belong to; __c holds the pieces of the text."""
    def cut(at: Column, n: Column) -> Column:
        piece = F.floor(at / PIECE).cast("int")
        both = F.concat(*[F.coalesce(F.get("__c", piece + i), F.lit("")) for i in (0, 1)])
        return F.substring(both, (at - piece * PIECE + 1).cast("int"), n.cast("int"))

    first = F.greatest(start - WINDOW, F.lit(0))
    return F.concat(cut(first, start - first), F.lit(" "), cut(end, F.lit(WINDOW)))


def _found(k: Kind, rank: int) -> Column:
    """The spans of one kind, from its matches, the gaps around them and what stands before each pair."""
    m, g, at = F.col(f"__m_{k.name}"), F.col(f"__g_{k.name}"), F.col(f"__a_{k.name}")

    def span(match: Column, i: Column) -> Column:
        start = F.element_at(at, i + 1) + F.length(F.element_at(g, i + 1))
        near = F.lower(around(start, start + F.length(match)))
        score = F.lit(k.score) + F.when(near.rlike(r"\b(?:" + "|".join(k.context) + ")"), k.bonus).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(match)).alias("end"),
                        F.lit(k.name).alias("kind"), F.when(valid(k.name, match), score).otherwise(0.0).alias("score"))

    least = 1e-9 if k in BASE else ACCEPT
    spans_ = F.filter(F.transform(m, span), lambda s: s.getField("score") >= least)
    return F.when(F.size(m) > 0, spans_).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__spans``: the spans of its whole texts, by start, then kind as listed, then end.

    A null or empty text has none. Positions count code points, ends are exclusive. Spans of one kind never
    overlap; those of different kinds may.
    """
    out = docs.withColumn("__t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for k in KINDS:
        here = F.instr("__t", k.needs) > 0 if k.needs else F.lit(True)
        out = out.withColumn(f"__m_{k.name}", F.when(here, F.regexp_extract_all("__t", F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for k in KINDS:
        out = out.withColumn(f"__g_{k.name}", F.when(F.size(f"__m_{k.name}") > 0, F.split("__t", k.pattern, -1)).otherwise(F.array().cast("array<string>")))
    for k in KINDS:
        m, g = F.col(f"__m_{k.name}"), F.col(f"__g_{k.name}")
        steps = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        out = out.withColumn(f"__a_{k.name}", running(steps))
    some = F.greatest(*[F.size(f"__m_{k.name}") for k in KINDS]) > 0
    out = out.withColumn("__c", F.when(some, F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))))
    for rank, k in enumerate(KINDS):
        out = out.withColumn(f"__s_{k.name}", _found(k, rank))
    out = out.withColumn("__spans", F.array_sort(F.concat(*[F.col(f"__s_{k.name}").cast(f"array<{SPAN}>") for k in KINDS])))
    return out.drop("__t", "__c", *[f"__{x}_{k.name}" for k in KINDS for x in "mgas"])


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans, one row per row of ``docs``."""
    base = F.filter("__spans", lambda s: s.getField("rank") < len(BASE))
    counts = [F.expr(f"CAST(size(filter(__spans, s -> s.rank = {r})) AS BIGINT)").alias(f"n_{k.name}") for r, k in enumerate(BASE)]
    return spans(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; overlapping spans become one.

    Columns stay as they are, but for n_chars (where there is one), which follows the new text. A null text stays null.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        begin, end = s.getField("start"), s.getField("end")
        gap = F.substring("text", (acc.getField("at") + 1).cast("int"), (begin - acc.getField("at")).cast("int"))
        fresh = F.concat(acc.getField("out"), F.array(gap, F.concat(F.lit("<"), F.upper(s.getField("kind")), F.lit(">"))))
        # a span that starts inside the last one only prolongs it
        return F.struct(F.greatest(acc.getField("at"), end).alias("at"), F.when(begin >= acc.getField("at"), fresh).otherwise(acc.getField("out")).alias("out"))

    found = spans(docs)
    pieces = found.withColumn("__p", F.when(F.size("__spans") > 0, F.aggregate("__spans", start, cut)))
    clean = F.when(F.col("__p").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join("__p.out", ""), F.substring("text", (F.col("__p.at") + 1).cast("int"), F.length("text"))))
    out = pieces.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__p").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
