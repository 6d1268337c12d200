"""Personal data in whole texts, disguised forms included, with spans in source characters.

Plain identifiers are found in the text itself. For disguised ones three transducers run in turn,
each keeping for every output character the source characters it stands for:

1. homoglyphs and invisible characters fold to ASCII;
2. "(at)", "[dot]", coded at-marks and then "na dot me at host dot tld" (also by the words of other languages, with
   line breaks, or marks between blanks, if the host ends as hosts do) and "name_at_host_dot_tld" become ``@`` and
   ``.``, in any mix that has an at-mark; "name at host.tld" with plain dots only is left, since prose has it ("look
   at example.com"); "192 dot 168 point 1 dot 5" becomes an address with dots;
3. runs of spelled digits ("plus one four double two ...", "eins neun zwei Punkt ...") become digits.

The same detectors then read the normalised text, and their spans map back to source characters.

Defined results: a null or empty text has no spans; repeated rows each get their own; all other
columns pass through untouched (a column named like the result is replaced). Memory for a text follows
its length and the number of rewritten places, not a record for each character.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.tokens import give_back

KINDS = ("email", "ip", "card", "phone")
#: Texts that are Python strings at once.
PART_ROWS = 256
SPAN_TYPE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

# Characters of an address, and the shapes of the other identifiers.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιıℓ․。․∙·٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹",
        "ABEKMHOPCTXYIJSaeopcyxijshdqwABEZHIKMNOPTYXoviil.....01234567890123456789",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
# Digit words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_POINT_WORDS, _PLUS_WORDS = ("dot", "point", "punkt", "punto"), ("plus", "más")
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "¹²³⁰-₉①-⑳﹒﹫！-～\U0001d400-\U0001d7ff]")
_AT = re.compile(r"\s?[\[({<] ?(?:at|@|ät|arroba) ?[\])}>]\s?|&#0*64;|&#x0*40;|&commat;|%40", re.I)
_DOT = re.compile(r"\s?[\[({<] ?(?:dot|punkt|point|punto|\.) ?[\])}>]\s?", re.I)
# Words for the marks, and ends of hosts; where a mark is said otherwise than by "at" and "dot", the host has one of these.
_AT_WORDS = ("at", "ät", "arroba", "chez")
TLDS = frozenset("com org net edu gov info io de fr es eu uk us ch at it nl be pt mx ar co ca au test example".split())
_SAID_DOT = rf"\s{{1,2}}(?:{'|'.join(_POINT_WORDS)})\s{{1,2}}"
_SAID_AT = rf"\s{{1,2}}(?:{'|'.join(_AT_WORDS)})\s{{1,2}}|\s?\(a\)\s?|\s?@\s?"
# A chain of words of a local part, and the host after it; chains without one are taken too, so each is read once.
_SPOKEN = re.compile(
    rf"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?:{_SAID_DOT}(?!at\s)[A-Za-z0-9._%+-]++)*+(?:(?P<at>{_SAID_AT})[A-Za-z0-9-]++(?:(?:{_SAID_DOT}|\s\.\s|\.)[A-Za-z0-9-]++)++)?", re.I
)
_SPOKEN_DOT = re.compile(rf"{_SAID_DOT}|\s\.\s", re.I)
_SPOKEN_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:{_SAID_DOT}|\.)[0-9]{{1,3}}){{3}}(?![\w.])", re.I)
# What no marked, said or pointed form can be without, from the same words.
_MARKED = re.compile(r"[\[({<] ?(?:at|@|ät|arroba|dot|punkt|point|punto|\.) ?[\])}>]|&#|&commat;|%40", re.I)
_AT_HINTS, _DOT_HINTS = [f" {w} " for w in _AT_WORDS], [f" {w} " for w in _POINT_WORDS]
_JOINED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+]+?(?P<at>([_-])at\2)[A-Za-z0-9]+(?:\2dot\2[A-Za-z0-9]+)+(?![A-Za-z0-9])", re.I)
_JOINED_DOT = re.compile(r"[_-]dot[_-]", re.I)
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_SAID = rf"(?:(?:{'|'.join(_TIMES)})[ -])?(?:{_WORD})"
_BETWEEN = r"[ ,()\n-]{1,3}"
_PLUS = rf"(?:{'|'.join(_PLUS_WORDS)}|\+)[ -]?(?:[0-9]{{1,3}}[ (-]{{1,2}})?"
_SPELLED = re.compile(rf"(?:(?<!\w){_PLUS})?(?<!\w){_SAID}(?:(?:{_BETWEEN}(?:{_SAID}|[0-9]|{'|'.join(_POINT_WORDS)}))(?!\w)){{5,}}", re.I)
_SPELLED_PART = re.compile(r"\w+|\+")
_HINT = re.compile(rf"\W{_SAID}{_BETWEEN}(?:{_SAID}|[0-9]|{'|'.join(_POINT_WORDS)})(?!\w)")  # what any spelled run begins with


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the plain identifiers, sorted."""
    found = []
    at, done, before = text.find("@"), 0, 0
    while at >= 0:  # an address is the whole run of its characters before an @, and a host after it
        if host := _HOST.match(text, at + 1):
            left = max(done, before)
            start = left + len(text[left:at].rstrip(_LOCAL))
            if start < at:
                found.append((start, 0, host.end()))
                done = host.end()
        before = at + 1
        at = text.find("@", before)
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text, *run.span()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


class _Tape:
    """A text under rewriting, in pieces: plain ones are source text from some place on, changed ones stand for a source part."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at, self.source, self.changed = [0], [(0, len(text))], [False]

    def _pieces(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(piece, first and last place of it) within [start, end)."""
        k = bisect.bisect_right(self.at, start) - 1
        while k < len(self.at) and self.at[k] < end:
            stop = self.at[k + 1] if k + 1 < len(self.at) else len(self.text)
            yield k, max(start, self.at[k]), min(end, stop)
            k += 1

    def part(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that [start, end) stands for."""
        k, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        first = self.source[k][0] + (0 if self.changed[k] else start - self.at[k])
        return first, self.source[j][1] if self.changed[j] else self.source[j][0] + end - self.at[j]

    def new_text(self, start: int, end: int) -> str:
        """What [start, end) has of rewritten text."""
        return "".join(self.text[a:z] for k, a, z in self._pieces(start, end) if self.changed[k])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces each [start, end) by its string, whose characters stand for all of the part."""
        if not edits:
            return
        text, at, source, changed, size, done = [], [], [], [], 0, 0

        def add(piece: str, part: tuple[int, int], new: bool) -> None:
            nonlocal size
            if piece:
                text.append(piece)
                at.append(size)
                source.append(part)
                changed.append(new)
                size += len(piece)

        def keep(start: int, end: int) -> None:
            for k, a, z in self._pieces(start, end):
                add(self.text[a:z], self.source[k] if self.changed[k] else self.part(a, z), self.changed[k])

        for start, end, new in edits:
            keep(done, start)
            add(new, self.part(start, end), True)
            done = end
        keep(done, len(self.text))
        self.text, self.at, self.source, self.changed = "".join(text), at or [0], source or [(0, 0)], changed or [True]


def _folded(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


def _spelled(part: str) -> str:
    out, times = [], 1
    for word in _SPELLED_PART.findall(part.lower()):
        if word in _TIMES:
            times = _TIMES[word]
            continue
        out.append(times * ("+" if word in _PLUS_WORDS else "." if word in _POINT_WORDS else DIGIT_WORDS.get(word, word)))
        times = 1
    return "".join(out)


def _hints(lower: str) -> tuple[bool, bool]:
    """Whether a text may have a said address, and a point that is a word."""
    flat = " ".join(lower.split())
    points = any(w in flat for w in _DOT_HINTS)
    at = "@" in flat and ("@ " in flat or " @" in flat or points)
    return at or "(a)" in flat or points and any(w in flat for w in _AT_HINTS), points


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans in source characters of what is found only after the transducers."""
    odd, lower = bool(_ODD.search(text)), text.lower()
    spoken, points = _hints(lower)
    joined_up = "_dot_" in lower or "-dot-" in lower
    if not (odd or spoken or points or joined_up or _MARKED.search(text) or _HINT.search(f" {lower}")):
        return []
    tape = _Tape(text)
    if odd:
        tape.rewrite([(m.start(), m.end(), _folded(m[0])) for m in _ODD.finditer(tape.text)])
        spoken, points = _hints(tape.text.lower())
    tape.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    edits = []
    for m in _SPOKEN.finditer(tape.text) if spoken or tape.text != text else ():
        if not m["at"]:
            continue
        dots = [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(tape.text, *m.span())]
        if m["at"] != "@":  # "look at example.com" is prose: some dot must be disguised
            if not m[0][0].isalnum() or not (dots or "." in tape.new_text(*m.span())):
                continue
            dots.append((*m.span("at"), "@"))
        usual = m["at"].strip().lower() in ("@", "at") and all(tape.text[s:e].strip().lower() == "dot" for s, e, new in dots if new == ".")
        if not usual and m[0].lower().replace(".", " ").split()[-1] not in TLDS:
            continue
        edits += sorted(dots)
    tape.rewrite(edits)
    if joined_up:
        tape.rewrite([e for m in _JOINED.finditer(tape.text) for e in sorted([(*m.span("at"), "@"), *((d.start(), d.end(), ".") for d in _JOINED_DOT.finditer(tape.text, m.end("at"), m.end()))])])
    if points:
        tape.rewrite([(d.start(), d.end(), ".") for m in _SPOKEN_IP.finditer(tape.text) for d in _SPOKEN_DOT.finditer(tape.text, *m.span())])
    tape.rewrite([(m.start(), m.end(), _spelled(m[0])) for m in _SPELLED.finditer(tape.text)])
    if tape.text == text:
        return []
    found = set()
    for start, kind, end in plain_spans(tape.text):
        first, last = tape.part(start, end)
        if tape.new_text(start, end) or last - first != end - start:
            found.add((first, kind, last))
    return sorted(found)


def find(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind's place in KINDS, end, base) of all identifiers in a text, sorted."""
    if not text:
        return []
    base = plain_spans(text)
    spans = [(*s, True) for s in base]
    for start, kind, end in disguised_spans(text):
        if not any(k == kind and s <= start and end <= e for s, k, e in base):
            spans.append((start, kind, end, False))
    return sorted(spans)


def redacted(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; overlapping ones become one."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _list_array(rows: list[list[tuple[int, int, int, bool]]]) -> pa.Array:
    flat = [s for r in rows for s in r]
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    spans = pa.StructArray.from_arrays(
        [
            pa.array([KINDS[k] for _, k, _, _ in flat], pa.string()),
            pa.array([s for s, _, _, _ in flat], pa.int64()),
            pa.array([e for _, _, e, _ in flat], pa.int64()),
            pa.array([b for _, _, _, b in flat], pa.bool_()),
        ],
        names=["kind", "start", "end", "base"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans).cast(_ARROW_SPANS)


def _in_parts(texts: pa.Array, made) -> pa.Array:
    """``made`` of a few texts at a time, so that a batch of long ones stands in memory as Arrow data only."""
    parts = [made(texts.slice(at, PART_ROWS).to_pylist()) for at in range(0, len(texts), PART_ROWS)]
    give_back()
    return pa.concat_arrays(parts) if parts else made([])


@F.arrow_udf(SPAN_TYPE)
def _find_udf(texts: pa.Array) -> pa.Array:
    return _in_parts(texts, lambda part: _list_array([find(t) for t in part]))


@F.arrow_udf(T.StringType())
def _redact_udf(texts: pa.Array) -> pa.Array:
    return _in_parts(texts, lambda part: pa.array([redacted(t) for t in part], pa.string()))


def with_pii(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """``docs`` with all spans (kind, start, end, base) of personal data in ``text``."""
    return docs.withColumn(into, _find_udf(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [EMAIL], [IP], [CARD] or [PHONE]."""
    return docs.withColumn(text, _redact_udf(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
