"""Column functions: normalising, segmenting and measuring text. All are native expressions but nfc()."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the measures mean it, with no-break and ideographic spaces and the byte-order mark.
WS = r"[\s\x0B   -     　﻿]"
#: The same as characters.
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Sentence ends, list lines, words from their first to their last letter or digit, list of closers after a full-width stop.
CLOSERS = "」』】〕）》〉｝\"'”’"
SENTENCE_END = rf"[.!?]+{WS}+|(?<=[。！？])(?![{CLOSERS}])|\n+"
PLAIN_END = rf"[.!?]+{WS}+|\n+"  # the same for texts without full-width stops
LIST_LINE = rf"^{WS}*(?:[-*+]{WS}+|\d+[.)]{WS}+)"
LETTERS = r"a-z\p{L}\p{N}"  # the commonest first, as a class is tried in order
WORD = rf"[{LETTERS}]++(?:{WS.replace('[', '[^' + LETTERS, 1)}++[{LETTERS}]++)*+"
STOPS = ".!?。！？…"
CJK_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]|[A-Za-z0-9]+"
CJK = ("zh", "ja")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for each row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trim(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def round_half_up(c: Column, digits: int = 6) -> Column:
    """floor(x 10^d + 0.5) / 10^d: halves go up, on the binary value."""
    return F.floor(c * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def non_empty(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def split_paragraphs(c: str | Column, unit: str = "paragraph") -> Column:
    """Paragraphs end at blank lines, or, with unit="line", at each line end; trimmed, empty ones dropped."""
    pattern = {"paragraph": rf"\n{WS}*\n", "line": "\n"}[unit]  # a carriage return before a line end is trimmed off
    return non_empty(F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern, -1), trim))


def split_lines(c: str | Column) -> Column:
    # split at a single character, a text needs no pattern
    return bind(F.coalesce(col(c), F.lit("")), lambda t: F.when(F.contains(t, F.lit("\r")), F.split(t, r"\r?\n", -1)).otherwise(F.split(t, "\n", -1)))


def strip_list_blocks(c: str | Column) -> Column:
    """A paragraph without its list lines, and without the plain lines that a line ending in a colon introduces if there are two or more."""

    def cut(plain: Column) -> Column:
        colon = F.array_position(F.transform(plain, lambda x: F.endswith(trim(x), F.lit(":"))), True)
        return bind(colon, lambda at: F.array_join(F.when((at > 0) & (F.size(plain) - at >= 2), F.slice(plain, F.lit(1), F.greatest(at, F.lit(1)).cast("int"))).otherwise(plain), "\n"))

    def prose(t: Column) -> Column:
        lines = bind(F.filter(split_lines(t), lambda x: ~x.rlike(LIST_LINE)), cut)
        return F.when(F.contains(t, F.lit("\n")), lines).when(t.rlike(LIST_LINE), "").otherwise(t)  # a single line introduces nothing

    return bind(F.coalesce(col(c), F.lit("")), prose)


def strip_lists(c: str | Column) -> Column:
    """A whole text without its lists: each of its paragraphs for itself, as a blank line ends what a colon introduces."""
    return F.array_join(non_empty(F.transform(split_paragraphs(c), strip_list_blocks)), "\n\n")


def full_stops(t: Column) -> Column:
    return F.contains(t, F.lit("。")) | F.contains(t, F.lit("！")) | F.contains(t, F.lit("？"))


def split_sentences(c: str | Column) -> Column:
    parts = bind(col(c), lambda t: F.when(full_stops(t), F.split(t, SENTENCE_END, -1)).otherwise(F.split(t, PLAIN_END, -1)))
    return non_empty(F.transform(parts, lambda s: F.rtrim(trim(s), F.lit(STOPS))))


def prose_sentences(c: str | Column) -> Column:
    return split_sentences(strip_list_blocks(c))


def tokenize(c: str | Column, lang: Column | None = None) -> Column:
    """Words with their edge punctuation off; single characters for Chinese and Japanese."""
    words = F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))
    if lang is None:
        return words
    return F.when(lang.isin(*CJK), F.regexp_extract_all(col(c), F.lit(CJK_TOKEN), F.lit(0))).otherwise(words)


def nfc(c: str | Column) -> Column:
    """Unicode NFC; Spark has no function for it, so Arrow batches go to unicodedata."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return run(col(c))


def detect_language(text: str | Column, path: str | Column | None = None) -> Column:
    """By the path's language mark, else by counts of scripts in the first 12,000 characters."""
    head = F.substring(F.coalesce(col(text), F.lit("")), 1, 12000)
    hangul, kana, han, latin = (F.regexp_count(head, F.lit(p)) for p in (r"[가-힯]", r"[぀-ヿ]", r"[一-鿿]", "[A-Za-z]"))
    where = F.lower(F.coalesce(col(path), F.lit(""))) if path is not None else F.lit("")
    return (
        F.when(where.rlike(r"(^|[._/-])kr([._/-]|$)|(^|[._/-])ko([._/-]|$)|korean"), "ko")
        .when(where.rlike(r"(^|[._/-])ja([._/-]|$)|japanese"), "ja")
        .when(where.rlike(r"(^|[._/-])zh([._/-]|$)|chinese"), "zh")
        .when((latin >= 80) & (latin > 2 * (hangul + kana + han)), "en")
        .when((hangul >= 8) & (hangul >= kana) & (hangul >= han), "ko")
        .when(kana >= 8, "ja")
        .when(han >= 8, "zh")
        .otherwise("en")
    )


#: Letters and the look-alikes that take their place.
HOMOGLYPHS = ("aceiopsxy", "асеіорѕху")
ZERO_WIDTH = "​"


def zero_width(c: str | Column, every: int = 4) -> Column:
    """A zero-width space after every n-th character that is no white space."""
    return F.regexp_replace(col(c), rf"((?:[^\s]\s*){{{every - 1}}}[^\s])", f"$1{ZERO_WIDTH}")


def homoglyph(c: str | Column) -> Column:
    return F.translate(col(c), *HOMOGLYPHS)


def strip_punct(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[.,!?;:()\[\]{}\"'…—–\-。！？、]", "")


def repeat_sentences(c: str | Column) -> Column:
    """Every sentence twice; pieces of ends and spaces alone stay single."""
    pieces = F.regexp_extract_all(col(c), F.lit(r"[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+\z"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"[^.!?。！？\s]"), F.concat(p, p)).otherwise(p)), "")


TRANSFORMS = {"zero_width": zero_width, "homoglyph": homoglyph, "upper": lambda c: F.upper(col(c)), "strip_punct": strip_punct, "repeat": repeat_sentences}


def text_hash(c: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(c), 256))


#: Shapes of secrets, most particular first, and names of keys that hold one.
SECRETS = (
    r"sk-[A-Za-z0-9_-]{16,}",
    r"ghp_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{12,}",
    r"(?i)(?:api[_-]?key|token|secret|password)\s*[=:]\s*\"?[A-Za-z0-9._~+/=-]{8,}\"?",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\b[0-9]{13,19}\b",
)
SECRET_KEY = r"(?i)(key|token|secret|password|authorization|cookie)"
REDACTED = "[redacted]"


def redact(c: str | Column) -> Column:
    out = col(c)
    for p in SECRETS:
        out = F.regexp_replace(out, p, REDACTED)
    return out


def redact_map(c: str | Column) -> Column:
    """Values under a telling key go as a whole, others lose what looks like a secret."""
    return F.map_zip_with(col(c), col(c), lambda k, v, _: F.when(k.rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(redact(v)))


def bucket(c: str | Column, bounds: list[float], names: list[str]) -> Column:
    """The first name whose upper bound (inclusive) holds the value; the last name has no bound."""
    out = F
    for b, n in zip(bounds, names, strict=False):
        out = out.when(col(c) <= b, n)
    return out.otherwise(F.when(col(c).isNotNull(), names[-1]))


def is_short(c: str | Column) -> Column:
    return (F.char_length(F.regexp_replace(col(c), rf"{WS}+", "")) <= 200) | (F.size(split_paragraphs(c)) <= 3)


def norm_match(c: str | Column) -> Column:
    return F.lower(trim(F.regexp_replace(col(c), rf"{WS}+", " ")))


def snippet(c: str | Column, chars: int) -> Column:
    """Up to the last sentence end at or before `chars`, else to the first after it, else cut there."""
    before = F.regexp_extract(F.substring(col(c), 1, chars + 1), r"(?s)\A(.*[.!?。！？])\s", 1)
    after = F.regexp_extract(col(c), r"(?s)\A(.*?[.!?。！？])(?:\s|\z)", 1)
    cut = F.when(before != "", before).when(after != "", after).otherwise(F.substring(col(c), 1, chars))
    return F.when(F.char_length(col(c)) <= chars, col(c)).otherwise(cut)


#: Order of the Markdown clean-up; front matter and fences first, markers last.
MARKDOWN = (
    (r"(?s)\A---\n.*?\n---\n", ""),
    (r"(?s)```.*?```", " "),
    (r"(?m)^\|.*\|[ \t]*$", ""),
    (r"(?s)<(script|style|svg)\b.*?</\1>", " "),
    (r"<!--(?s:.*?)-->", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"<[^>\n]+>", " "),
    (r"(?m)^[ \t]*#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", ""),
)


def strip_markdown(c: str | Column, drop_lists: bool = False, drop_links: bool = False, keep_code: bool = False) -> Column:
    out = col(c)
    if drop_lists:
        out = F.regexp_replace(out, r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+.*$", "")
    for p, r in MARKDOWN:
        if drop_links and r == "$1":
            r = " "
        out = F.regexp_replace(out, p, r)
    out = F.regexp_replace(out, "`([^`\n]*)`", "$1" if keep_code else " ")
    for _ in range(3):  # nested emphasis: three levels
        out = F.regexp_replace(out, r"(\*\*|__|\*|_|~~)(?=\S)([^\n]*?\S)\1", "$2")
    return trim(out)


def strip_esm(c: str | Column) -> Column:
    """Without import and export statements, which may run over lines until their brackets close."""
    lines = F.split(col(c), "\n", -1)
    opens = lambda s: F.regexp_count(s, F.lit(r"[({\[]")) - F.regexp_count(s, F.lit(r"[)}\]]"))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).alias("depth"))

    def step(acc, line):
        begins = (acc["depth"] == 0) & line.rlike(r"^(?:import|export)\b")
        inside = (acc["depth"] > 0) | begins
        depth = F.when(inside, F.greatest(acc["depth"] + opens(line), F.lit(0))).otherwise(F.lit(0))
        return F.struct(F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"), depth.alias("depth"))

    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["kept"], "\n"))
