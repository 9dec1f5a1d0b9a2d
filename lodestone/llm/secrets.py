"""Operator 9: secrets in texts: fixed forms, and values in a credential's place that would be costly to guess.

The cost of a value is that of its cheapest segmentation, in bits: a dynamic program over its prefixes takes the least
of words, dates, repeats, sequences and keyboard walks, and characters guessed one by one. A repeat, sequence or walk is
a span of up to 64 characters from anywhere, or one of any length from where its run begins. A value behind a
credential's name, behind the name of a scheme, or between a user and a host, that the fixed forms don't cover as a whole is
reported as ``guess`` when its cost reaches a threshold. Left out are words that can be spoken, as prose behind a colon has
them, and sentences in quotes; any other value in quotes is taken whole.

Words are guessed in order: those that people put into passwords, then a vocabulary's, which is a parameter; a word of
rank r costs log2(r + 1) bits, another one in its place that differs in case or by usual signs for letters a bit more.

Nulls and empty texts have no spans. The work is linear in a text's length; a value's program looks back a fixed number
of characters. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_bpe import read_ranks
from lodestone.llm.common import map_rows, texts_of

KINDS = ("assign", "access", "hex", "guess")
#: Bits from which a value in a credential's place is a secret.
SECRET_BITS = 45.0
#: Characters that a word has at most, and a repeat, sequence or walk that begins within its run.
LONGEST_WORD, LONGEST_RUN = 20, 64

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential's name and what stands between it and its value, which may begin on the next line or behind a scheme's name.
_NAME = r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|api[-_]?key|(?:access|private|account|signing|encryption)[-_]?key|(?<![a-z])(?:pass|key|auth(?:orization)?))"""
_BETWEEN = r"""["']?\x20{0,8}(?::|=>?)[\x20\t]{0,8}(?:\r?\n[\x20\t]{0,8})?(?:(?:bearer|basic)\x20{1,8})?"""
#: A value in quotes reaches to the matching quote, another one to white space, a quote or a sign that ends values.
CONTEXT = re.compile(rf"""{_NAME}{_BETWEEN}(?:"((?:[^"\\\n]|\\.){{8,}})"|'((?:[^'\\\n]|\\.){{8,}})'|["']?([^\s"'<>,;|]{{8,}}))""", re.IGNORECASE | re.ASCII)
#: A value behind the name of a scheme alone, and one between a user and a host.
BEARER = re.compile(r"bearer\x20{1,8}([\w.~+/=-]{8,})", re.IGNORECASE | re.ASCII)
LOGIN = re.compile(r"://[^\s:/@]{1,64}:([^\s/@]{4,})@", re.ASCII)
#: Characters up to which a value of several words is one. Longer ones are sentences in quotes.
PHRASE = 64

#: Words that people put into passwords, the most usual ones first.
WORDS = """password admin welcome login letmein dragon monkey master football baseball shadow sunshine princess superman batman
hello freedom whatever secret summer winter spring autumn orange purple silver golden soccer hockey tigger pepper ginger
cookie chocolate computer internet server database root user guest test demo default changeme temp backup system service
access token private public key pass word love angel baby lucky star magic flower family friend happy house money power
jordan michael daniel thomas robert charlie andrew jessica ashley joshua matthew anthony""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oieastasi")
#: Dates by year, month and day, by day, month and year, and years; what each costs.
DATES = (
    (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", re.ASCII), log2(366 * 150)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII), log2(366 * 150)),
    (re.compile(r"(?:19|20)\d\d", re.ASCII), log2(150)),
)


def _near() -> set[tuple[str, str]]:
    """Pairs of keys side by side: in a row, or in the next row at the same place or one off."""
    at = {ch: (x, y) for y, row in enumerate(ROWS) for x, ch in enumerate(row)}
    return {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


NEAR = _near()


def vocabulary(paths: Iterable[str]) -> list[str]:
    """The whole words of rank files, by their best rank: tokens that begin with a blank and go on in letters alone."""
    best: dict[str, int] = {}
    for path in paths:
        for token, rank in read_ranks(path).items():
            word = token[1:].decode("utf-8", "ignore").lower() if token[:1] == b" " else ""
            if 3 <= len(word) <= LONGEST_WORD and word.isalpha() and rank < best.get(word, rank + 1):
                best[word] = rank
    return sorted(best, key=lambda w: (best[w], w))


def _charset_bits(ch: str) -> float:
    return log2(10) if ch.isdigit() else log2(26) if ch.islower() or ch.isupper() else log2(33)


class Guesser:
    """The words of passwords and then those of a vocabulary, in order, and what values cost by them."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank: dict[str, int] = {}
        for word in (*WORDS, *words):
            if len(word) <= LONGEST_WORD:
                self.rank.setdefault(word, len(self.rank) + 1)

    def bits(self, value: str) -> float:
        """The cost of the cheapest segmentation."""
        n, rank = len(value), self.rank
        low = value.lower() if len(value.lower()) == n else value
        plain = low.translate(LEET)
        dates: dict[int, list[tuple[int, float]]] = {}
        for start in range(n):
            if value[start] in "0123456789":
                for form, bits in DATES:
                    if hit := form.match(value, start):
                        dates.setdefault(hit.end(), []).append((start, bits))
        best = [0.0] * (n + 1)
        same = rising = falling = walk = 0  # where the runs that reach the present character began
        for i, ch in enumerate(value):
            end, own = i + 1, _charset_bits(ch)
            if i:
                step = ord(ch) - ord(value[i - 1])
                same = same if step == 0 else i
                rising = rising if step == 1 else i
                falling = falling if step == -1 else i
                walk = walk if (low[i - 1], low[i]) in NEAR else i
            cost = best[i] + own
            for start in range(max(0, end - LONGEST_WORD), end - 2):
                word = low[start:end]
                at = rank.get(word) or 2 * rank.get(plain[start:end], 0)
                if at:
                    cost = min(cost, best[start] + log2(at + 1) + (word != value[start:end]))
            for first, bits in ((same, own), (rising, own + 1), (falling, own + 1), (walk, log2(47) + 2.2)):
                if end - first >= 3:
                    for start in (first, *range(max(first + 1, end - LONGEST_RUN), end - 2)):
                        cost = min(cost, best[start] + bits + log2(end - start))
            for start, bits in dates.get(end, ()):
                cost = min(cost, best[start] + bits)
            best[end] = cost
        return best[n]


USUAL = Guesser()


def _prose(value: str) -> bool:
    """A word as texts have it behind a colon, if no list has it: letters alone in the case of a word that can be spoken.

    Signs beyond ASCII may stand between them. Of its Latin letters a quarter are vowels, at most six consonants stand
    together, and few are of the rare ones, which drawn letters have in plenty.
    """
    core = value.strip(".!?:)(*_]}")
    if not core or not all(ch.isalpha() or not ch.isascii() and not ch.isnumeric() for ch in core) or core not in (core.lower(), core.upper(), core.capitalize()):
        return False
    latin = [ch for ch in unicodedata.normalize("NFKD", core.lower()) if "a" <= ch <= "z"]
    consonants = max(map(len, re.split("[aeiouy]", "".join(latin))))
    return 4 * sum(ch in "aeiouy" for ch in latin) >= len(latin) and consonants <= 6 and sum(ch in "jkqvwxz" for ch in latin) <= max(1, len(latin) // 10)


def _number(kind: int, value: str) -> bool:
    """What ``hex`` also covers and is not masked: digits alone."""
    return KINDS[kind] == "hex" and value.isdigit()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans cover together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start of the value, end of the value) wherever a credential may stand, in order of the values."""
    found = []
    for hit in CONTEXT.finditer(text):
        a, b = hit.span(hit.lastindex)
        if b - a <= PHRASE or not any(map(str.isspace, text[a:b])):
            found.append((hit.start(), hit.end(), a, b))
    for form, sign in ((BEARER, "earer"), (LOGIN, "://")):
        if sign in text or sign == "earer" and "EARER" in text:
            found += [(hit.start(), hit.end(), *hit.span(1)) for hit in form.finditer(text)]
    return sorted(found, key=lambda x: (x[2], -x[3], x[0]))


def find(text: str | None, guesser: Guesser = USUAL) -> list[tuple[int, str, int, int, int, float]]:
    """(start, kind, end, start of the value, end of the value, bits), in order of start and then of kind."""
    text = text or ""
    out = []
    for hit in ASSIGN.finditer(text):
        if len(hit[2]) >= 12:
            out.append((hit.start(), 0, hit.end(), hit.start(2), hit.end(2)))
    if "AKIA" in text:
        out += [(hit.start(), 1, hit.end(), hit.start(), hit.end()) for hit in ACCESS.finditer(text) if hit.end() - hit.start() >= 18]
    out += [(hit.start(), 2, hit.end(), hit.start(), hit.end()) for hit in HEX.finditer(text)]
    scored = [(s, k, e, a, b, guesser.bits(text[a:b])) for s, k, e, a, b in out]
    taken = _merged([(a, b) for _, k, _, a, b in out if not _number(k, text[a:b])])
    at = -1
    for start, end, a, b in _places(text):
        before = bisect_left(taken, (a + 1,))
        covered = before > 0 and taken[before - 1][1] >= b
        if a >= at and not covered and not _prose(text[a:b]) and (bits := guesser.bits(text[a:b])) >= SECRET_BITS:
            scored.append((start, 3, end, a, b, bits))
            at = b
    return [(s, KINDS[k], e, a, b, bits) for s, k, e, a, b, bits in sorted(scored)]


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] = ()) -> DataFrame:
    """id, spans: array of (kind, start, end, value_start, value_end, bits), in code points, ends exclusive."""
    rows, sent = texts_of(df, id_col, text_col), df.sparkSession.sparkContext.broadcast(Guesser(words))  # as large as the vocabulary
    span = "struct<kind:string,start:int,end:int,value_start:int,value_end:int,bits:double>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("bits", pa.float64())]))

    def start():
        return lambda batch: pa.RecordBatch.from_arrays(
            [batch["id"], pa.array([[dict(kind=k, start=s, end=e, value_start=a, value_end=b, bits=bits) for s, k, e, a, b, bits in find(t.as_py(), sent.value)] for t in batch["text"]], kind)], ["id", "spans"]
        )

    return map_rows(rows, start, f"id {rows.schema['id'].dataType.simpleString()}, spans array<{span}>")


def joined(kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str | None, guesser: Guesser = USUAL, mark: str = "[SECRET]") -> str | None:
    """The text with its secrets' values replaced. Plain long numbers, which ``hex`` also covers, stay."""
    if not text:
        return text
    cuts = []
    for _, kind, _, a, b, _ in find(text, guesser):
        if not _number(KINDS.index(kind), text[a:b]):
            cuts.append((a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if b > at:
            out += [text[at : max(a, at)], mark if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])
