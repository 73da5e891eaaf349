"""Personal data: base patterns on the text as it is, and the same patterns on a normalised text whose characters know
the source characters that they come from."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.llm.common import free_memory

KINDS = ("email", "ip", "card", "phone")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where no digit precedes: the same matches, without trying each digit of a long run.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping local@domain, found from each @ outwards, so in linear time."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        local = text[floor:at]
        start = floor + len(local.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or not p.strip("0") or (len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255) for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like Latin ones, and marks that are not seen.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "—": "-", "―": "-", "−": "-", "。": ".",
}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
TOP_DOMAINS = set("com org net edu gov mil int info biz io co ai app dev eu us uk de fr es it nl be at ch pl pt se no fi dk ie cz gr ro hu ru ua tr in cn jp kr tw hk sg au nz ca mx br ar cl za me tv".split())
# End of fixed values.
ODD = re.compile(
    r"[\u00a0\u00ad\u2000-\u200a\u202f\u0370-\u03ff\u0400-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2010-\u2015\u2070-\u209f"
    r"\u200b-\u200d\u2060\u2212\u2460-\u24ff\u3002\ufe00-\ufe0f\ufeff\uff00-\uffef\U0001d400-\U0001d7ff]"
)

DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
DIGIT = r"(?:zero|one|two|three|four|five|six|seven|eight|nine)"
#: Three spelled digits at least in a row; figures, "oh" and dots may stand between them.
BETWEEN = r"(?:[\s,.-]{1,3}|\s+(?:dot|point)\s+)"
SPELLED = re.compile(rf"(?i)(?:\bplus[\s-]+)?\b{DIGIT}(?:{BETWEEN}(?:{DIGIT}|oh|double\s{DIGIT}|[0-9]+)\b){{2,}}|(?:\bplus\s+)(?=[0-9])")
SPELLED_PART = re.compile(rf"(?i)(plus)|(double)\s({DIGIT})|({DIGIT}|oh)\b|([0-9])|(?:^|(?<=[\s,.-]))(dot|point)\b|[^0-9a-z]+")
#: What follows is tried from its bracket, "at", @ or figure alone, and looked around from there, so no run of spaces or
#: of words is gone over again for each of its places.
BRACKETS = re.compile(r"(?i)[(\[{<]\s*(at|dot|@|\.)\s*[)\]}>]")
BLANK = re.compile(r"\s*")
DOT = re.compile(r"(?i)\s+dot\s+")
AT = re.compile(r"(?i)(?<=\s)at(?=\s)|@")
#: On the text before an AT, backwards: "tod" is "dot".
BEFORE = re.compile(r"(?i)(\s*)([A-Za-z0-9._%+-]+(?:\s+tod\s+[A-Za-z0-9._%+-]+)*)")
AFTER = re.compile(r"(?i)\s*([A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)+)")
#: A name that is no plain word: then "at" before a host is enough.
NAME = re.compile(r"(?i)[a-z0-9]+(?:[._%+-][a-z0-9]+)+|[a-z]+[0-9]+")
AT_HOST = re.compile(r"(?i)[a-z0-9]\s+at\s+[a-z0-9-]+\.[a-z0-9-]")
SPOKEN_IP = re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?:\s+dot\s+[0-9]{1,3}){3}(?![0-9])")


class Traced:
    """A text whose characters have the first and the end of their source characters."""

    def __init__(self, text: str, begin=None, end=None):
        self.text = text
        self.begin = np.arange(len(text)) if begin is None else begin
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """edits: ordered (start, end, instead); each new character comes from all that it replaces."""
        if not edits:
            return self
        text, begin, end, at = [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:s], new]
            begin += [self.begin[at:s], np.full(len(new), self.begin[s] if s < e else 0)]
            end += [self.end[at:s], np.full(len(new), self.end[e - 1] if s < e else 0)]
            at = e
        return Traced("".join(text), np.concatenate(begin), np.concatenate(end))


def homoglyphs(t: Traced) -> Traced:
    plain = lambda c: "" if c in UNSEEN else HOMOGLYPHS.get(c) or (str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else unicodedata.normalize("NFKC", c))
    return t.rewrite([(m.start(), m.end(), new) for m in ODD.finditer(t.text) if (new := plain(m[0])) != m[0]])


def spelled(t: Traced) -> Traced:
    edits = []
    for m in SPELLED.finditer(t.text):
        for p in SPELLED_PART.finditer(t.text, m.start(), m.end()):
            new = "+" if p[1] else DIGITS[p[3].lower()] * 2 if p[2] else DIGITS[p[4].lower()] if p[4] else "." if p[6] else p[5] or ""
            if new != p[0]:
                edits.append((p.start(), p.end(), new))
    return t.rewrite(edits)


def bracketed(text: str):
    """Edits that put @ or . for these words or marks in brackets, with the white space around."""
    floor = 0
    for m in BRACKETS.finditer(text):
        start = floor + len(text[floor : m.start()].rstrip())
        floor = BLANK.match(text, m.end()).end()
        yield start, floor, {"at": "@", "dot": "."}.get(m[1].lower(), m[1])


def spoken(text: str):
    """Edits of names "at" or @ hosts in which dots may be words; what is taken is not looked at again."""
    floor = 0
    for m in AT.finditer(text):
        if m.start() < floor:
            continue
        before, after = BEFORE.match(text[floor : m.start()][::-1]), AFTER.match(text, m.end())
        floor = after.end() if after else m.end()
        if not (before and after):
            continue
        start, end = m.start() - before.end(), m.start() - before.start(2)
        name, host = text[start:end], after[1]
        if m[0] == "@" or NAME.fullmatch(name) or (re.split(r"[\s.]", host)[-1].lower() in TOP_DOMAINS and (DOT.search(name) or DOT.search(host))):
            yield from ((d.start(), d.end(), ".") for d in DOT.finditer(text, start, end))
            yield end, after.start(1), "@"
            yield from ((d.start(), d.end(), ".") for d in DOT.finditer(text, after.start(1), after.end()))


def spoken_ips(text: str):
    for m in SPOKEN_IP.finditer(text):
        yield from ((d.start(), d.end(), ".") for d in DOT.finditer(text, m.start(), m.end()))


def at_and_dot(t: Traced) -> Traced:
    for edits in (bracketed, spoken, spoken_ips):
        t = t.rewrite([(s, e, new) for s, e, new in edits(t.text) if t.text[s:e] != new])
    return t


def all_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base). A span of the normalised text is added unless it lies in a base span."""
    base = base_spans(text)
    low = text.lower()
    odd, words, disguised = ODD.search(text), "plus" in low or SPELLED.search(low), "dot" in low or " @" in low or "@ " in low or BRACKETS.search(low) or (" at " in low and AT_HOST.search(low))
    out = [(s, k, e, True) for s, k, e in base]
    if not (odd or words or disguised):
        return out
    t = Traced(text)
    for step in ([homoglyphs] if odd else []) + [spelled, at_and_dot]:
        t = step(t)
    if t.text == text:
        return out
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for s, k, e in base_spans(t.text):
        s, e = int(t.begin[s:e].min()), int(t.end[s:e].max())
        before = bisect_right(starts, s)
        if not (before and reach[before - 1] >= e):
            out.append((s, k, e, False))
    return sorted(set(out))


@F.arrow_udf(SPAN)
def pii_spans(texts: pa.Array) -> pa.Array:
    rows = ([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in all_spans(t.as_py() or "")] for t in texts)
    return pa.array(rows, ARROW)


def redact(text: str) -> str:
    """Each span replaced by its kind in brackets; of spans that overlap, the first is named and all are covered."""
    parts, at = [], 0
    for start, kind, end, _base in sorted(all_spans(text), key=lambda x: (x[0], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array) -> pa.Array:
    free_memory()
    return pa.array([redact(t.as_py()) if t.is_valid else None for t in texts], pa.string())


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with a column spans: kind, start, end (code points, end exclusive) and base, ordered by start, then kind.

    Null and empty texts have no spans; whole texts of any length are searched in linear time; ties, repeated rows and
    extra columns stay as they are (a column named spans is replaced); an empty table stays empty.
    """
    return docs.withColumn("spans", pii_spans("text"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with the spans of find_pii replaced in text; a null text stays null."""
    return docs.withColumn("text", redacted("text"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
