"""Operator 4: personal data, in DataFrame operations only.

Regular expressions propose spans, checksums and forms confirm or refute them, and words nearby, for and against, move
the score of what is confirmed. The base kinds are email, ip, card (Luhn) and phone, which are reported at any score once
confirmed; iban (mod 97) and ssn (a national number of the form 3-2-4 digits, which its form alone doesn't confirm enough)
are added where their score reaches the threshold.

Positions come from splitting the text at a pattern: the lengths of what lies between matches and of the matches
themselves sum up to starts. Sums run in blocks: n matches of a text take 32 n + n^2 / 8192 additions. Patterns begin
where a run begins and never give back what they took, so long runs of one kind of character are passed over once.

Nulls and empty texts have no spans. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import texts_of

LOCAL, PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BLOCK = 64
#: Scores from which an added span is reported; base spans always are.
THRESHOLD = 0.6
#: Characters before and behind a match in which context counts, and what it adds to or takes from the score.
NEARBY, CONTEXT = 48, 0.3


@dataclass(frozen=True)
class Kind:
    """A pattern for whole matches, what a text must contain to be searched, the score of what is confirmed, and the words that raise or lower it."""

    name: str
    pattern: str
    contains: str
    score: float
    context: str
    against: str = ""


#: A pattern may also begin where the match before it ended, as leftmost matching would.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{PART}++(?:\.{PART}++)++", "@", 0.9, r"e-?mail|contact|write\s+to|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server|login|client", r"version|release|section|chapter"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", 0.7, r"card|visa|credit|debit|payment|karte|tarjeta|carte", r"order|tracking|serial|isbn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|call|mobile|\bfax|\btel|contact|reach"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "", 0.9, r"iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, r"ssn|social\s+security|tax\s*id|sozialversicherung|seguridad\s+social|s[eé]curit[eé]\s+sociale"),
)
BASE = 4


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """An account number's remainder: the first four characters go last, letters count from 10."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda n, c: F.when(c == "", n).otherwise((n * F.when(c.between("0", "9"), 10).otherwise(100) + number(c)) % 97))


def _confirmed(kind: Kind, match: Column) -> Column:
    """What checksum or form say about a match."""
    digits = _digits(match)
    if kind.name == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind.name == "card":
        return F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & (_mod97(match) == 1)
    if kind.name == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def _score(kind: Kind, match: Column, before: Column, behind: Column) -> Column:
    """0 for what is refuted, else the kind's score, moved by the words nearby and 1 at most."""
    near = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEARBY)), F.left(behind, F.lit(NEARBY))))
    score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT).otherwise(0.0)
    if kind.against:
        score = score - F.when(near.rlike(kind.against), CONTEXT).otherwise(0.0)
    return F.when(_confirmed(kind, match), F.least(score, F.lit(1.0))).otherwise(0.0)


def _sums(lengths: Column) -> Column:
    """Sums of an array up to and with each entry: sums of blocks first, then within the block."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    of = F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    before = F.transform(blocks, lambda b: F.when(b == 0, 0).otherwise(total(F.slice(of, 1, b))))
    within = lambda i: total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
    return F.transform(lengths, lambda _, i: F.element_at(before, F.floor(i / BLOCK).cast("int") + 1) + within(i))


def _lengths(matches: Column, pieces: Column) -> Column:
    """Of what lies before each match together with the match: they sum up to the match's end."""
    return F.transform(matches, lambda x, i: F.length(F.get(pieces, i)) + F.length(x))


def _spans(order: int, kind: Kind) -> Column:
    m, p, e = F.col(f"m_{kind.name}"), F.col(f"p_{kind.name}"), F.col(f"e_{kind.name}")
    return F.transform(
        m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), F.get(e, i).alias("end"), _score(kind, x, F.get(p, i), F.get(p, i + 1)).alias("score"))
    )


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: array of (kind, start, end, score) in code points, ends exclusive, by start and then by kind as listed."""
    rows = texts_of(df, id_col, text_col)
    none = F.array().cast("array<string>")
    # One search for each kind; texts without its character, or without any match, are done at once.
    for k in KINDS:
        found = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))
        rows = rows.withColumn(f"m_{k.name}", F.coalesce(F.when(F.contains("text", F.lit(k.contains)), found) if k.contains else found, none))
    for k in KINDS:
        rows = rows.withColumn(f"p_{k.name}", F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(none))
    for k in KINDS:
        m, p = F.col(f"m_{k.name}"), F.col(f"p_{k.name}")
        rows = rows.withColumn(f"e_{k.name}", F.when(F.size(m) > 0, _sums(_lengths(m, p))).otherwise(F.array().cast("array<int>")))
    each = []
    for order, k in enumerate(KINDS):
        least = THRESHOLD if order >= BASE else 1e-9
        each.append(F.filter(_spans(order, k), lambda s: s["score"] >= least))  # noqa: B023
    return rows.select("id", F.array_sort(F.concat(*each)).alias("spans"))


def joined(base_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    spans = F.filter("spans", lambda s: s["order"] < BASE) if base_only else F.col("spans")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
