"""Text expressions: sentences, spoken-text clean-up, names, paths and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stand-alone fillers of spoken Korean, and the patterns removed from a spoken query.
FILLER_TOKENS = ("씁", "쓰읍", "음", "으음", "어", "아", "에", "엄", "흠", "하")
FILLER_PATTERNS = (r"^(어|음|자|그|저)\s+", r"그러니까\s*", r"뭐시기\s*", r"인가\s+그\s+", r"\s+그거\s+", r"\s+그게\s+")
# White space of other scripts, which Java's \s lacks; punctuation and white space that a comparison of transcripts leaves out.
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # the same, one by one
COMPARED_OUT = rf"[{_SPACE}.,!?;:\"'“”‘’()\[\]{{}}·…~\-—啊。！？、，]+"
# Particles after a final consonant, and without one.
PARTICLES = (("으로", "로"), ("이랑", "랑"), ("이라", "라"), ("이며", "며"), ("은", "는"), ("이", "가"), ("을", "를"), ("과", "와"))
_ENDS = ".!?。！？…"
_CLOSING = "[\"'”’)\\]】」』]*"
SENTENCE_END = f"[{_ENDS}]+{_CLOSING}"
# All other characters as ranges: Java tests a negated class of these about nine times slower.
_PLACES = [-1, *sorted(map(ord, _ENDS)), 0x110000]
_OTHERS = "".join(rf"\x{{{a + 1:x}}}-\x{{{b - 1:x}}}" for a, b in zip(_PLACES, _PLACES[1:]) if a + 1 < b)


def estimate_tokens(text: Column) -> Column:
    """Two characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("long")


def sentences(text: Column) -> Column:
    """Completed sentences: up to their terminal punctuation and closing quotes, trimmed, none empty."""
    return F.regexp_extract_all(text, F.lit(rf"\G[{_SPACE}]*+([{_OTHERS}]*{SENTENCE_END})"), F.lit(1))


def remainder(text: Column) -> Column:
    """What follows the last completed sentence."""
    return F.btrim(F.regexp_extract(text, rf"(?s)\A(?:.*[{_ENDS}]{_CLOSING}+)?+(.*)\z", 1), F.lit(_BLANKS))


def head_at(text: Column, n: int) -> Column:
    """The text up to the last blank at or before ``n`` characters, a hard cut if there is none."""
    t = F.trim(text)
    head = F.regexp_extract(t, f"(?s)^(.{{1,{n}}})(?= )", 1)
    return F.when(F.length(t) <= n, t).when(head != "", F.trim(head)).otherwise(F.substring(t, 1, n))


def tail_at(text: Column, n: int) -> Column:
    t = F.trim(text)
    head = F.regexp_extract(t, f"(?s)^(.{{1,{n}}})(?= )", 1)
    cut = F.when(head != "", F.length(head)).otherwise(n)
    return F.when(F.length(t) <= n, "").otherwise(F.trim(F.substring(t, cut + 1, F.length(t))))


@F.arrow_udf(T.StringType())
def nfc(texts):
    """Unicode composed form, for which Spark has no function."""
    import unicodedata

    import pyarrow as pa

    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def compared(text: Column) -> Column:
    """Lower case without punctuation and white space (apply to composed text)."""
    return F.regexp_replace(F.lower(text), COMPARED_OUT, "")


def compared_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), COMPARED_OUT), lambda w: w != "")


def without_fillers(text: Column) -> Column:
    """Words joined by one blank, without stand-alone fillers."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(*FILLER_TOKENS)), " ")


def spoken_query(text: Column, transliterations: list[tuple[str, str]] = ()) -> Column:
    """Transliterations (longest first, blanks allowed inside), fillers removed, white space collapsed."""
    out = F.trim(text)
    for spoken, written in sorted(transliterations, key=lambda p: -len(p[0])):
        out = F.regexp_replace(out, r"\s*".join(_quoted(c) for c in spoken if not c.isspace()), _replacement(written))
    out = reduce(lambda t, p: F.regexp_replace(t, p, " "), FILLER_PATTERNS, out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def _replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def with_particles(text: Column, term: str) -> Column:
    """Particles right after ``term`` agree with its last syllable; terms not in Hangul are left alone."""
    place = ord(term[-1]) - 0xAC00 if term else -1
    if not 0 <= place < 11172:
        return text
    final = place % 28
    for closed, open_ in PARTICLES:
        wants_closed = final != 0 and not (closed == "으로" and final == 8)
        right, wrong = (closed, open_) if wants_closed else (open_, closed)
        text = F.regexp_replace(text, f"{_quoted(term)}{wrong}(?=[\\s.,!?…\"')\\]]|$)", _replacement(term + right))
    return text


def display_correction(text: Column, transliterations: list[tuple[str, str]]) -> Column:
    """struct(text, fixed): transliterations with agreeing particles, and how many there were.

    A result over three times as long as the text is not believed.
    """
    out, count = text, F.lit(0)
    for spoken, written in sorted(transliterations, key=lambda p: -len(p[0])):
        pattern = r"\s*".join(_quoted(c) for c in spoken if not c.isspace())
        hits = F.regexp_count(out, F.lit(pattern))
        replaced = F.regexp_replace(out, pattern, _replacement(written))
        count = count + hits
        out = F.when(hits > 0, with_particles(replaced, written)).otherwise(out)
    grown = F.length(out) > 3 * F.greatest(F.lit(1), F.length(text))
    return F.struct(F.when(grown, text).otherwise(out).alias("text"), F.when(grown, 0).otherwise(count).cast("long").alias("fixed"))


def phrase(text: Column) -> Column:
    """White space collapsed; null unless 2 to 30 characters are left."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t).between(2, 30), t)


def iso639(tag: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.split_part(tag, F.lit("-"), F.lit(1))), F.lit("")), F.lit("ko"))


def section_concept(title: Column) -> Column:
    """Head concept of a section title; null for sentence-like, too short or too long ones."""
    head = F.trim(F.split_part(F.trim(F.regexp_replace(title, r"^\d+\.\d+\s*", "")), F.lit(":"), F.lit(1)))
    return F.when(F.length(head).between(2, 20) & ~head.rlike("(는가|한가|인가|까|기|법|것|다)$"), head)


def slash_terms(term: Column) -> Column:
    """Parts of a term joined by slashes; empty unless two at least can stand alone."""
    parts = F.filter(F.transform(F.split(term, "/"), lambda x: F.trim(x)), lambda p: (F.length(p) >= 2) & ~p.rlike(r"^\d+차$"))
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))


def paren_term(term: Column) -> Column:
    """struct(ko, english array) of "term(a, b)"."""
    inside = F.regexp_extract(term, r"^\s*([^(]+?)\s*\(([^)]*)\)", 2)
    ko = F.regexp_extract(term, r"^\s*([^(]+?)\s*(\(|$)", 1)
    return F.struct(ko.alias("ko"), F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "").alias("english"))


def repaired_filename(name: Column) -> Column:
    """UTF-8 bytes once read as Latin-1 are read again; other names stay."""
    broken = name.rlike("[\\u0080-\\u00ff]") & ~name.rlike("[^\\u0000-\\u00ff]")
    again = F.decode(F.encode(name, "ISO-8859-1"), "UTF-8")
    return F.when(broken & ~again.contains("�"), again).otherwise(name)


def without_extension(name: Column) -> Column:
    """Up to the last dot, if it is not the first character."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def blob_name(url: Column) -> Column:
    """Path after the container, percent-decoded."""
    return F.url_decode(F.regexp_extract(url, r"^[^:]+://[^/]+/[^/?#]+/([^?#]*)", 1))


def rewritten_url(url: Column, old: str, new: str) -> Column:
    return F.when(url.startswith(old), F.concat(F.lit(new), F.substring(url, len(old) + 1, 1 << 30))).otherwise(url)


def slug(text: Column, n: int = 24) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", ""), 1, n)


def segment_id(session: Column, run: Column, sequence: Column) -> Column:
    return F.format_string("%s-%s-seg-%06d", session, run, sequence)


def chunk_id(prefix: Column, page: Column, part: Column) -> Column:
    return F.format_string("%s_p%02d_%02d", prefix, page, part)


def dedupe_key(session: Column, segment: Column, locale: Column) -> Column:
    return F.concat_ws(":", session, segment, locale)


def ssml(locale: Column, text: Column, rate: int = 0) -> Column:
    safe = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(plain), F.lit(escaped))
    return F.format_string(f"<speak xml:lang='%s'><prosody rate='{rate:+d}%%'>%s</prosody></speak>", locale, safe)


def prompt(*blocks: Column) -> Column:
    """Blocks joined by a blank line; null ones are left out."""
    return F.concat_ws("\n\n", *blocks)


def failure_kind(message: Column, permanent: tuple[str, ...], transient: tuple[str, ...]) -> Column:
    """Permanent markers go before transient ones; what has neither may be tried again."""
    has = lambda marks: reduce(lambda a, m: a | F.lower(message).contains(m), marks, F.lit(False))
    return F.when(has(permanent), "permanent").when(has(transient), "transient").otherwise("retryable")


def draft(partial: Column, placeholder: str, least: int = 6) -> Column:
    """A partial result that is worth a draft: trimmed, long enough and not the placeholder; else null."""
    t = F.trim(partial)
    return F.when((F.length(t) >= least) & (t != placeholder), t)
