"""Numeric claims of a text: what it says with figures, in a form in which equal statements are equal strings.

A reader knows a fixed set of notations. Each notation takes the characters it explains, the more particular
ones first; what is then left with a digit, an operator or a number word that no notation explains makes
the whole text unreadable, so a comparison refuses rather than guesses."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from fractions import Fraction

S = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"  # an ASCII word border
NUMBER = r"[-+−]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
WHOLE = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+"
FREE = r"(?<![A-Za-z0-9_.])"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
LONG = "|".join(MONTHS)
SHORT = f"(?:{LONG}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)"
CODES = "USD|EUR|GBP|JPY|KRW|CNY|CAD|AUD|CHF"
#: Units as (dimension, factor to its base).
UNITS = {
    "mm": ("length-mm", Fraction(1)), "cm": ("length-mm", Fraction(10)), "m": ("length-mm", Fraction(1000)), "km": ("length-mm", Fraction(1000000)),
    "g": ("mass-g", Fraction(1)), "kg": ("mass-g", Fraction(1000)), "lb": ("mass-g", Fraction(45359237, 100000)), "mL": ("volume-ml", Fraction(1)), "L": ("volume-ml", Fraction(1000)),
}
#: Korean magnitudes.
MAGNITUDES = {"백": 100, "천": 1000, "만": 10**4, "억": 10**8, "조": 10**12, "경": 10**16, "해": 10**20}
MAGNITUDE = rf"(?:[백천]{S}*[만억조경]|[백천만억조경해])"
HAN_DIGITS = dict(zip("零〇一二三四五六七八九十", (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10), strict=True))
#: Number words that are read.
WORDS = {
    "en": {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())},
    "ko": {w: i for i, w in enumerate("영 하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열".split())},
    "zh": HAN_DIGITS,
    "ja": HAN_DIGITS,
}
#: Number words that are not read, where they stand for a number.
UNREAD = {
    "en": re.compile(rf"(?i){B}(?:thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion|quadrillion|dozen){B}"),
    "ko": re.compile(rf"열(?:한|두)|스물|서른|마흔|쉰(?={S}?(?:명|살|개|번|세))|예순|일흔|여든|아흔|절반"),
    "ko-magnitude": re.compile(rf"[0-9]{S}*[백천만억조경해]|(?<![가-힣])[백천만억](?:{S}+(?:개|건|권|그릇|대|마리|명|번|병|살|세|송이|장|채|층|통|편|회|년|월|일)|(?:달러|원|엔|위안|퍼센트))"),
    "zh": re.compile("[两兩壹贰貳叁參肆伍陆陸柒捌玖拾廿卅卌半第分之百千萬万億亿兆京垓]"),
    "ja": re.compile("[壱弐参肆伍陸漆捌玖拾半第分の百千万億兆京垓]"),
}
#: Characters that count things, and those that are numerals, beside which an unread one tells.
COUNTERS = {"zh": "个個项項件名次位本张張条條台岁歲天年月日", "ja": "つ個ヶか人冊枚本回台歳才年月日"}
NUMERALS = {"zh": "零〇一二三四五六七八九十两兩壹贰貳叁參肆伍陆陸柒捌玖", "ja": "零〇一二三四五六七八九十壱弐参肆伍陸漆捌玖"}
#: What follows a Korean number word that counts something.
PARTICLES = re.compile("은|는|이|가|을|를|의|도|만|와|과|에|에서|에게|한테|으로|로|부터|까지|보다|처럼|마저|조차|이라도|라도|개|건|권|그릇|대|마리|명|번|병|살|세|송이|장|채|층|통|편|회|년|월|일|시간|분|초")
HANGUL = re.compile(r"[ᄀ-ᇿ㄰-㆏ꥠ-꥿가-퟿]")
HAN = re.compile(r"[⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]")
#: Notations with more than one reading, refused wherever they stand.
AMBIGUOUS = [
    re.compile(rf"{B}(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}){B}"),
    re.compile(rf"[-+]?[0-9][0-9,.]*{S}*/{S}*[-+]?[0-9][0-9,.]*"),
    re.compile(rf"[$€£¥₩]{S}*[0-9]|[0-9]{S}*[$€£¥₩]"),
    re.compile(rf"(?i)[0-9][0-9,.]*{S}*(?:km|cm|mm|m|kg|g|lb|L|mL){S}*/{S}*[A-Za-z]+"),
]
LEADING_DOT = re.compile(r"(?<!\d)[-−]?\.[0-9]")
#: The same where no date or time explains them.
LOOSE = [re.compile(rf"(?i){B}(?:{SHORT}\.?{S}+[0-9]{{1,2}},{S}*[0-9]{{4}}|[0-9]{{1,2}}{S}+{SHORT}\.?{S}+[0-9]{{4}}){B}"), re.compile(rf"(?i)[-+−]?[0-9][0-9,.]*{S}*°{S}*[CF]{B}")]
OPERATOR = re.compile(rf"\d{S}*(?:[-+−–—:/÷×*]{S}*)+\d")
COMPARATOR = re.compile(rf"[-+−]?\d[\d.,]*{S}*(?:<=|>=|<|>|≤|≥)|(?:<=|>=|<|>|≤|≥){S}*[-+−]?\d")


def value(raw: str) -> Fraction:
    return Fraction(raw.replace(",", "").replace("−", "-"))


def told(kind: str, x: Fraction) -> str:
    return f"{kind}:{x.numerator}/{x.denominator}"


def dated(year: str, month: int, day: str) -> str | None:
    try:
        return f"date:{datetime.date(int(year), month, int(day)).isoformat()}"
    except ValueError:
        return None


def magnitude(unit: str) -> int:
    out = 1
    for c in re.sub(S, "", unit):
        out *= MAGNITUDES[c]
    return out


def chained(m: re.Match) -> str | None:
    """1억 2천만: terms whose magnitudes fall add up."""
    terms = [(value(d), magnitude(u)) for d, u in re.findall(rf"({WHOLE}){S}*({MAGNITUDE})", m.group())]
    if any(b >= a for (_, a), (_, b) in zip(terms, terms[1:], strict=False)):
        return None
    return told("number", sum((d * u for d, u in terms), Fraction(0)))


def by_name(m: re.Match) -> str | None:
    month, day, year = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
    return dated(year, [x.lower() for x in MONTHS].index(month.lower()) + 1, day)


def unit(m: re.Match) -> str:
    kind, factor = UNITS[m[2]]
    return told(f"unit:{kind}", value(m[1]) * factor)


Notation = tuple[re.Pattern, Callable[[re.Match], str | None]]
#: Dates and times, then amounts, then Korean magnitudes: (pattern, claim or None if it is none).
CALENDAR: list[Notation] = [
    (re.compile(rf"{B}([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){B}"), lambda m: dated(m[1], int(m[2]), m[3])),
    (re.compile(rf"([0-9]{{4}})(?:년{S}*([0-9]{{1,2}})월{S}*([0-9]{{1,2}})일|年{S}*([0-9]{{1,2}})月{S}*([0-9]{{1,2}})日)"), lambda m: dated(m[1], int(m[2] or m[4]), m[3] or m[5])),
    (re.compile(rf"(?i){B}({LONG}){S}+([0-9]{{1,2}}),{S}*([0-9]{{4}}){B}|{B}([0-9]{{1,2}}){S}+({LONG}){S}+([0-9]{{4}}){B}"), by_name),
    (re.compile(r"(?<![0-9:])(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?![0-9])"), lambda m: "time:" + re.sub("^0(?=[0-9]:)", "", m.group())),
]
AMOUNTS: list[Notation] = [
    (re.compile(rf"{B}({CODES}){S}+({NUMBER})(?![A-Za-z0-9_]|,[0-9]|\.[0-9])|{FREE}({NUMBER}){S}+({CODES}){B}"), lambda m: told(f"currency:{m[1] or m[4]}", value(m[2] or m[3]))),
    (re.compile(rf"(?i){FREE}({NUMBER}){S}*(?:%|％|{B}percent{B}|퍼센트|パーセント)"), lambda m: told("percent", value(m[1]))),
    (re.compile(rf"百分之{S}*({NUMBER})"), lambda m: told("percent", value(m[1]))),
    (re.compile(rf"{FREE}({NUMBER}){S}*(km|cm|mm|m|kg|g|lb|mL|L){B}"), unit),
]
KOREAN: list[Notation] = [
    (re.compile(rf"{FREE}(?:{WHOLE}){S}*{MAGNITUDE}(?:{S}*(?:{WHOLE}){S}*{MAGNITUDE})+(?![0-9.백천만억조경해])"), chained),
    (re.compile(rf"{FREE}({NUMBER}){S}*({MAGNITUDE})(?![0-9백천만억조경해])"), lambda m: told("number", value(m[1]) * magnitude(m[2]))),
]


#: Parts of the English number words that are not read; each word has one.
UNREAD_PARTS = ("teen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "illion", "dozen")
FIGURE, OTHER_DIGIT = re.compile("[0-9]"), re.compile(r"(?![0-9])\d")


def folded(text: str) -> str:
    """A text in which whatever a pattern without regard to case takes for ASCII letters has these letters."""
    return text.lower() if text.isascii() else text.casefold().replace("i\u0307", "i").replace("\u0131", "i")


class Reader:
    """What has been read of one text."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.taken = bytearray(len(text))
        self.claims: list[tuple[int, str]] = []
        self.spans: list[tuple[int, int]] = []
        low = folded(text) if lang == "en" else text
        self.present = [w for w in WORDS.get(lang, WORDS["en"]) if w in low]
        self.unread = lang != "en" or any(w in low for w in UNREAD_PARTS)

    def take(self, start: int, end: int, claim: str | None) -> None:
        if claim is not None and not any(self.taken[start:end]):
            self.taken[start:end] = b"\x01" * (end - start)
            self.claims.append((start, claim))
            self.spans.append((start, end))

    def read(self, notations: list[Notation]) -> None:
        for pattern, claim in notations:
            for m in pattern.finditer(self.text):
                self.take(m.start(), m.end(), claim(m))

    def rest(self) -> str:
        """The text with blanks for what has been read."""
        out, at = [], 0
        for start, end in sorted(self.spans):
            out += [self.text[at:start], " " * (end - start)]
            at = end
        return "".join([*out, self.text[at:]])

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def figures(self) -> bool:
        """Plain numbers; False if one is grouped in an unknown way."""
        fine = True
        for m in re.finditer(r"[-+−]?[0-9][0-9,.]*", self.text):
            raw = m.group().rstrip(".,")
            beside = self.at(m.start() - 1) + self.at(m.start() + len(raw))
            if self.taken[m.start()] or self.lang == "en" and re.search("[A-Za-z_]", beside):
                continue
            if re.fullmatch(NUMBER, raw):
                self.take(m.start(), m.start() + len(raw), told("number", value(raw)))
            else:
                fine = False
        return fine

    def unread_words(self) -> bool:
        """Whether number words are left that no notation explains."""
        rest, lang = self.rest(), self.lang
        if lang in COUNTERS:
            telling = re.compile(rf"[\d{NUMERALS[lang]}{COUNTERS[lang]}]")
            return bool(re.search("[零〇一二三四五六七八九十]{2,}", rest)) or any(telling.search(rest[max(0, m.start() - 1) : m.start()] + rest[m.end() : m.end() + 1]) for m in UNREAD[lang].finditer(rest))
        if self.unread and lang in UNREAD and UNREAD[lang].search(rest):
            return True
        if lang == "ko" and (UNREAD["ko-magnitude"].search(rest) or any(self.touches_figure(m.start()) for m in re.finditer("[백천만억조경해]", rest))):
            return True
        words = self.present
        found = list(re.finditer(rf"(?i){B}(?:{'|'.join(words)}){B}" if lang == "en" else "|".join(words), rest)) if words else []
        gaps = [rest[a.end() : b.start()] for a, b in zip(found, found[1:], strict=False)]
        return any(re.fullmatch(rf"(?:{S}|-)+", g) if lang == "en" else g == "" for g in gaps)

    def touches_figure(self, i: int) -> bool:
        """Whether the next characters that are no white space on either side are read or digits."""
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(self.text) and re.match(S, self.text[j]):
                j += step
            if 0 <= j < len(self.text) and (self.taken[j] or self.text[j] in "0123456789"):
                return True
        return False

    def words(self) -> None:
        words = WORDS.get(self.lang, WORDS["en"])
        for word in self.present:
            n = words[word]
            for m in re.finditer(rf"(?i){B}{word}{B}" if self.lang == "en" else word, self.text):
                if not self.taken[m.start()] and self.counts(m):
                    self.take(m.start(), m.end(), f"number:{n}/1")

    def counts(self, m: re.Match) -> bool:
        """Whether a number word says how many: by what follows it in Korean, by its neighbours in Chinese and Japanese."""
        before, after = self.at(m.start() - 1), self.at(m.end())
        if self.lang == "ko":
            return not HANGUL.match(before) and bool(HANGUL.match(after)) and bool(PARTICLES.match(self.text, m.end()))
        if self.lang in COUNTERS:
            both = [c for c in (before, after) if c]
            return any(c in COUNTERS[self.lang] for c in both) or not any(HAN.match(c) for c in both)
        return True


def claims_of(text: str | None, lang: str = "en") -> tuple[list[str], str | None]:
    """(the numeric claims of a text in order, why it can't be read or None)."""
    text = text or ""
    r = Reader(text, lang)
    if not FIGURE.search(text):  # every notation but words has a figure
        if OTHER_DIGIT.search(text):
            return [], "unsupported_numeric_syntax"
        if r.unread_words():
            return [], "unsupported_word_number"
        r.words()
        return [c for _, c in sorted(r.claims)], None
    if any(p.search(text) for p in AMBIGUOUS):
        return [], "ambiguous_numeric_syntax"
    if LEADING_DOT.search(text):
        return [], "unsupported_numeric_syntax"
    r.read(CALENDAR)
    if any(not all(r.taken[m.start() : m.end()]) for p in LOOSE for m in p.finditer(text)):
        return [], "ambiguous_numeric_syntax"
    r.read(AMOUNTS)
    if lang == "ko":
        r.read(KOREAN)
    rest = r.rest()
    if OPERATOR.search(rest) or COMPARATOR.search(rest) or OTHER_DIGIT.search(rest):
        return [], "unsupported_numeric_syntax"
    grouped = r.figures()
    if r.unread_words():
        return [], "unsupported_word_number"
    r.words()
    if not grouped:
        return [], "ambiguous_number_grouping"
    if re.search("[0-9]", r.rest()):
        return [], "unsupported_numeric_syntax"
    return [c for _, c in sorted(r.claims)], None


def safety(original: str | None, rewrite: str | None, lang: str = "en") -> tuple[bool, str | None]:
    """(whether both make the same claims equally often, the reason if not); unreadable texts are not safe."""
    return compared(claims_of(original, lang), claims_of(rewrite, lang))


def compared(original: tuple[list[str], str | None], rewrite: tuple[list[str], str | None]) -> tuple[bool, str | None]:
    """safety() of texts that have been read."""
    (a, why), (b, other) = original, rewrite
    if why or other:
        return False, why or other
    return (True, None) if sorted(a) == sorted(b) else (False, "numeric_claim_changed")
