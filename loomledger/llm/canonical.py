"""Problem 4: one form for texts that look the same.

Quick-check properties tell which characters can be unstable; only the segments around those are
normalised, with the character before and the marks after as context, and spliced into the unchanged text.

Defined results: null stays null, empty stays empty, ASCII text is returned as it is. White space of
U+0020, tabs and line ends, typographic quotes and dashes, East Asian punctuation beside East Asian
text, Thai SARA AM, joiners in Indic clusters and emoji sequences, variation selectors and fillers where their script has them are left alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from loomledger.llm import lexicon

#: Letters of other alphabets and the Latin letters of the same look, beside those of the consortium's table (``looks``): small letters that only resemble each other.
LOOKALIKE_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "г": "r", "п": "n", "ѵ": "v", "ց": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
}
#: Latin letters and the Cyrillic letters of the same look; Greek ones go over Latin.
LOOKALIKE_CYRILLIC = {
    "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у", "r": "г", "n": "п", "k": "к", "h": "һ",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х", "Y": "У", "S": "Ѕ",
    "ο": "о", "ρ": "р", "α": "а", "χ": "х", "κ": "к", "Ο": "О", "Ρ": "Р", "Α": "А", "Χ": "Х", "Κ": "К", "Τ": "Т", "Β": "В", "Η": "Н", "Μ": "М", "Ε": "Е",
}
LOOKALIKE_GREEK = {"o": "ο", "v": "ν", "p": "ρ", "i": "ι", "k": "κ", "x": "χ", "u": "υ", "a": "α"} | {b: a for a, b in LOOKALIKE_LATIN.items() if "Α" <= a <= "Χ"}


class Looks(NamedTuple):
    """By alphabet: letters of others that look like one of its own."""

    latin: dict[str, str]
    cyrillic: dict[str, str]
    greek: dict[str, str]


#: First and last letters of the alphabets, with the code of each in CLASS.
ALPHABETS = (("latin", 8, ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF))), ("greek", 16, ((0x370, 0x3FF),)), ("cyrillic", 24, ((0x400, 0x52F),)), ("armenian", 32, ((0x531, 0x587),)), ("cherokee", 40, ((0x13A0, 0x13FD), (0xAB70, 0xABBF))), ("lisu", 48, ((0xA4D0, 0xA4F7),)), ("coptic", 56, ((0x2C80, 0x2CE3),)))
_LOOKS: Looks | None = None


def _derived() -> Looks:
    """From the consortium's table: two letters look alike where it gives both the same form; capitals stand for capitals."""
    form = lexicon.confusables()
    shape = lambda ch: (form.get(ch, ch), unicodedata.category(ch) != "Ll")
    letters = {name: [chr(cp) for a, b in ranges for cp in range(a, b + 1) if unicodedata.category(chr(cp))[0] == "L"] for name, _, ranges in ALPHABETS}
    found = []
    for own, fixed in (("latin", LOOKALIKE_LATIN), ("cyrillic", LOOKALIKE_CYRILLIC), ("greek", LOOKALIKE_GREEK)):
        # plain letters only: what is accented is told apart by its accent
        plain = [c for c in letters[own] if not unicodedata.decomposition(c) and (c.isascii() or own != "latin")]
        mine = {shape(c): c for c in reversed(plain)}
        others = [c for name in letters if name != own for c in letters[name] if not unicodedata.decomposition(c)]
        found.append({c: mine[shape(c)] for c in others if shape(c) in mine} | fixed)
    return Looks(*found)


def looks() -> Looks:
    """The tables of this process: as the driver sent them, else derived."""
    global _LOOKS
    if _LOOKS is None:
        _LOOKS = _derived()
    return _LOOKS


def use(tables: Looks) -> None:
    """Take the driver's tables, which a task gets by broadcast, so that no executor needs the library's file."""
    global _LOOKS
    _LOOKS = tables


#: Invisible characters of other categories or beyond the scan (default-ignorable code points); the variation selectors among them.
IGNORABLE = {0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}
_VARIED = re.compile("[©®‼⁉™ℹ←-⯿\u1000-\u109f\ua840-\ua877\U0001f000-\U0001faff]")


def _tables() -> tuple[dict[int, str], set[int], set[int]]:
    """From the character database: the map of single characters, the marks, and what may compose with the character before."""
    single: dict[int, str] = {}
    marks: set[int] = set()
    maybe: set[int] = set()
    for cp in range(0x20000):  # beyond lie ideographs, tags and private use
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            continue
        if cat in ("Mn", "Me", "Mc"):
            marks.add(cp)
        d = unicodedata.decomposition(ch)
        if cat == "Zs" and ch != " ":
            single[cp] = " "
        elif cat == "Cf" and cp < 0xE0000 and not 0x600 <= cp <= 0x6DD:
            single[cp] = ""
        elif d.startswith(("<wide>", "<narrow>", "<font>")) or (d.startswith("<compat>") and (0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F or cp in (0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x17F))):
            single[cp] = unicodedata.normalize("NFKC", ch)
        elif d and not d.startswith("<"):
            parts = [int(x, 16) for x in d.split()]
            if len(parts) == 1 and not 0xF900 <= cp <= 0xFAFF and not 0x2F800 <= cp <= 0x2FA1F:
                single[cp] = unicodedata.normalize("NFC", ch)
            elif len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                maybe.add(parts[1])
    maybe |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in (0x2028, 0x2029, 0x1680, 0xAD):
        single.setdefault(cp, "" if cp == 0xAD else " ")
    del single[0x2028], single[0x2029]
    single |= dict.fromkeys(IGNORABLE, "")
    return single, marks, maybe


def _ranges(cps: set[int]) -> str:
    out, cps = [], sorted(cps)  # type: ignore[assignment]
    i = 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\U{cps[i]:08x}-\\U{cps[j]:08x}")
        i = j + 1
    return "".join(out)


SINGLE, MARKS, MAYBE = _tables()
#: A segment: the character before as context, the unstable ones, and marks after.
SEGMENT = re.compile(f"(?s:.)?[{_ranges(set(SINGLE) | MAYBE)}]+[{_ranges(MARKS)}]*")
UNSTABLE = re.compile(f"[{_ranges(set(SINGLE) | MAYBE)}]")
_RANGE = {name: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) for name, _, ranges in ALPHABETS}
WORD = re.compile("[" + "".join(_RANGE.values()) + "]+")
MIXED = re.compile("|".join(f"[{own}](?=[{''.join(r for r in _RANGE.values() if r != own)}])" for own in _RANGE.values()))
EAST = re.compile("[⺀-ヿ㄀-鿿가-힯ｦ-ﾝ！-／：-＠［-｀｛-･\U00020000-\U0003ffff]")
_FULL_PUNCT = re.compile("[　！-／：-＠［-｀｛-･￠-￦]")
_INDIC_OR_EMOJI = re.compile("[ऀ-෿က-႟ក-៿←-⯿️\U0001f000-\U0001faff]")


def _classes() -> np.ndarray:
    """By code point: 1 may be unstable, 2 East Asian, 4 full-width punctuation, and the alphabet in the bits above."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    t[sorted(set(SINGLE) | MAYBE)] |= 1
    for bit, rx in ((2, EAST), (4, _FULL_PUNCT)):
        t[[cp for cp in (*range(0x2E80, 0x3130), *range(0x3000, 0x4000), *range(0xFF00, 0xFFF0)) if rx.match(chr(cp))]] |= bit
    for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x40000)):
        t[a:b] |= 2
    for _, kind, ranges in ALPHABETS:
        for a, b in ranges:
            t[a : b + 1] |= kind
    return t


CLASS = _classes()


def suspects(texts: list[str]) -> np.ndarray:
    """The quick check of many texts at once: False where the text is surely canonical."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = CLASS[codes]
    odd = (c & 1).astype(bool)
    east = (c & 2).astype(bool)
    beside = np.zeros_like(east)
    beside[1:] |= east[:-1]
    beside[:-1] |= east[1:]
    odd &= ~((c & 4).astype(bool) & beside)
    kind = c >> 3
    odd[:-1] |= (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0)
    ends = np.cumsum([len(t) + 1 for t in texts])
    flags = np.zeros(len(texts), bool)
    flags[np.searchsorted(ends, np.nonzero(odd)[0], side="right")] = True
    return flags


_SCRIPT = {code: name for name, code, _ in ALPHABETS}


def script_of(ch: str) -> str:
    return _SCRIPT.get(int(CLASS[ord(ch)]) & 0xF8, "latin")


def _one(text: str, at: int) -> str:
    """The canonical form of the character at ``at``, which is in SINGLE."""
    ch = text[at]
    if ch in "‌‍":  # joiners shape Indic clusters and emoji
        return ch if at and _INDIC_OR_EMOJI.match(text[at - 1]) and at + 1 < len(text) and _INDIC_OR_EMOJI.match(text[at + 1]) else ""
    if ord(ch) in IGNORABLE:
        return ch if _belongs(text, at) else ""
    if _FULL_PUNCT.match(ch):  # ordinary beside East Asian text
        before = next((c for c in reversed(text[max(0, at - 12) : at]) if c.isalnum() or EAST.match(c)), "")
        after = next((c for c in text[at + 1 : at + 13] if c.isalnum() or EAST.match(c)), "")
        return ch if EAST.match(before or "a") or EAST.match(after or "a") else SINGLE[ord(ch)]
    return SINGLE[ord(ch)]


def _belongs(text: str, at: int) -> bool:
    """Whether the script around an invisible character has it there."""
    ch, before, after = text[at], text[at - 1 : at] if at else "", text[at + 1 : at + 2]
    if "\ufe00" <= ch <= "\ufe0f":
        return bool(before and (_VARIED.match(before) or EAST.match(before))) or after == "\u20e3"
    if "\U000e0100" <= ch <= "\U000e01ef":
        return bool(before and EAST.match(before))
    if "\U000e0020" <= ch <= "\U000e007f":  # flags of regions: a black flag and its tags
        return text[max(0, at - 32) : at].rstrip("".join(map(chr, range(0xE0020, 0xE0080)))).endswith("\U0001f3f4")
    if ch in "\u115f\u1160":
        return any(x and re.match("[\u1100-\u115e\u1161-\u11ff\ua960-\ua97f\ud7b0-\ud7ff]", x) for x in (before, after))
    if ch in "\u17b4\u17b5":
        return "\u1780" <= before <= "\u17d3"
    return "\u180b" <= ch <= "\u180f" and "\u1800" <= before <= "\u18af"


def _word(m: re.Match[str]) -> str:
    w = m[0]
    if w.isascii() or not MIXED.search(w):
        return w
    n = Counter(map(script_of, w))
    # the word's own alphabet is the one whose letters no other offers, else the most frequent
    tables = looks()
    own = {s: sum(script_of(c) == s and not _swap(c, tables.cyrillic if s == "latin" else tables.latin) for c in w) for s in n}
    main = max(n, key=lambda s: (own[s], n[s], s == "latin"))
    to = tables._asdict().get(main, {})
    return "".join(c if script_of(c) == main else _swap(c, to) or c for c in w)


def _swap(ch: str, to: dict[str, str]) -> str:
    """The look-alike of ``ch``, its accents kept; empty where there is none."""
    base, *rest = unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFC", to[base] + "".join(rest)) if base in to else ""


def canonical(text: str | None) -> str | None:
    """The form in which equal-looking texts are equal. Applying it again changes nothing."""
    if text is None or text.isascii() or not suspects([text])[0]:
        return text
    if UNSTABLE.search(text):
        out, at = [], 0
        for m in SEGMENT.finditer(text):
            first = m.start()
            while first > at and unicodedata.combining(text[first]):  # back to what the marks stand on
                first -= 1
            seg = "".join(_one(text, i) if ord(text[i]) in SINGLE else text[i] for i in range(first, m.end()))
            if seg == text[first : m.end()] and unicodedata.is_normalized("NFC", seg):
                continue
            out += [text[at:first], unicodedata.normalize("NFC", seg)]
            at = m.end()
        if out:
            spliced = "".join([*out, text[at:]])
            # a removed character can bring two others together that compose or form another segment
            text = canonical(spliced) if spliced != text and UNSTABLE.search(spliced) else spliced
    if MIXED.search(text) and (spliced := WORD.sub(_word, text)) != text:
        text = canonical(spliced)  # a letter of the other alphabet can compose with the mark after it
    return text


def with_canonical(df: DataFrame, column: str = "text", into: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``column`` in ``into``, one Arrow pass without a shuffle.

    ``into`` replaces a column of that name; all other columns stay as they are.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    shipped = df.sparkSession.sparkContext.broadcast(looks())

    @F.pandas_udf(StringType())  # type: ignore[call-overload]
    def one(s):
        use(shipped.value)
        flags = suspects(s.fillna("").tolist())
        return pd.Series([canonical(t) if f else t for f, t in zip(flags, s, strict=True)], dtype=object)

    return df.withColumn(into, one(F.col(column)))


def changed(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The keys of the rows whose ``column`` is not in canonical form (null and empty texts are)."""
    at = df.schema[key].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(looks())

    def run(batches):
        use(shipped.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            flags = suspects([t or "" for t in texts])
            keep = [bool(f) and canonical(t) != t for f, t in zip(flags, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(keep, pa.bool_()))], names=[key])

    return df.select(key, column).mapInArrow(run, f"`{key}` {at}")
