"""Text as it is spoken: comparable words, spoken numbers, names and how they are heard."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: British spellings and the American ones that a recogniser writes.
BRITISH_AMERICAN = {
    "aluminium": "aluminum", "analyse": "analyze", "analysed": "analyzed", "armour": "armor", "behaviour": "behavior", "behaviours": "behaviors", "catalogue": "catalog",
    "centimetre": "centimeter", "centimetres": "centimeters", "centre": "center", "centred": "centered", "centres": "centers", "colour": "color", "coloured": "colored",
    "colours": "colors", "defence": "defense", "favour": "favor", "favourite": "favorite", "favours": "favors", "fibre": "fiber", "fibres": "fibers", "grey": "gray",
    "harbour": "harbor", "harbours": "harbors", "honour": "honor", "honoured": "honored", "honours": "honors", "humour": "humor", "jewellery": "jewelry",
    "kilometre": "kilometer", "kilometres": "kilometers", "labour": "labor", "litre": "liter", "litres": "liters", "manoeuvre": "maneuver", "manoeuvres": "maneuvers",
    "metre": "meter", "metres": "meters", "millimetre": "millimeter", "millimetres": "millimeters", "neighbour": "neighbor", "neighbouring": "neighboring",
    "neighbours": "neighbors", "organisation": "organization", "organise": "organize", "organised": "organized", "plough": "plow", "programme": "program",
    "programmes": "programs", "realise": "realize", "realised": "realized", "recognise": "recognize", "recognised": "recognized", "rumour": "rumor", "rumours": "rumors",
    "sceptical": "skeptical", "theatre": "theater", "theatres": "theaters", "travelled": "traveled", "traveller": "traveler", "travellers": "travelers",
    "travelling": "traveling", "vapour": "vapor", "vapours": "vapors",
}
#: Number words by their value from 0, and tens from 20.
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_UNITHS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_TENTHS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
SMALL = {w: i for ws in (_UNITS, _UNITHS) for i, w in enumerate(ws)} | {w: 20 + 10 * i for ws in (_TENS, _TENTHS) for i, w in enumerate(ws)}
SCALES = {"hundred": 100, "hundredth": 100, "thousand": 10**3, "thousandth": 10**3, "million": 10**6, "millionth": 10**6, "billion": 10**9, "billionth": 10**9}


def spoken_tokens(t: Column | str) -> Column:
    """Tokens for comparison, before spoken numbers become digits; all in the JVM."""
    x = F.lower(F.col(t) if isinstance(t, str) else t)
    x = F.regexp_replace(x, "[’‘']", "")
    x = F.regexp_replace(x, r"(?<=[0-9]),(?=[0-9])", "")
    x = F.regexp_replace(x, r"(?<=[0-9])\.(?=[0-9])", " point ")
    x = F.replace(F.replace(x, F.lit("%"), F.lit(" percent ")), F.lit("&"), F.lit(" and "))
    tokens = F.filter(F.split(x, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    tokens = F.transform(tokens, lambda w: F.regexp_replace(w, r"\A([0-9]+)(st|nd|rd|th)\z", "$1"))
    american = F.create_map(*[F.lit(s) for pair in BRITISH_AMERICAN.items() for s in pair])
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(american, w), w))


class _Number:
    """A spoken number while it is heard word by word; several in a row come out one after another."""

    def __init__(self):
        self.done: list[int] = []
        self.high, self.low, self.paired = 0, None, False

    def small(self, n: int) -> None:
        if self.low is None:
            self.low, self.paired = n, self.high == 0
        elif not self.paired:
            self.low += n
        elif 10 <= self.low <= 99 and not self.high:
            self.low, self.paired = self.low * 100 + n, False
        else:
            self.done.append(self.high + self.low)
            self.high, self.low, self.paired = 0, n, True

    def scale(self, s: int) -> None:
        n = 1 if self.low is None else self.low
        self.low = None
        if s == 100:
            self.low = n * 100
        else:
            self.high += n * s
        self.paired = False

    def end(self) -> list[int]:
        if self.low is not None or self.high:
            self.done.append(self.high + (self.low or 0))
        return self.done


def digits(tokens: Sequence[str]) -> list[str]:
    """Runs of number words as digits: 'nineteen oh eight' is 1908, 'one two three' stays three numbers, 'a hundred' is 100."""
    out: list[str] = []
    i, n = 0, len(tokens)
    while i < n:
        number, j, last, started = _Number(), i, None, False
        while j < n:
            w = tokens[j]
            after = tokens[j + 1] if j + 1 < n else ""
            unit = SMALL.get(after) if 1 <= SMALL.get(after, 0) <= 9 else None
            if w in SMALL:
                tens = SMALL[w] >= 20 and unit is not None
                last = SMALL[w] + (unit if tens else 0)
                number.small(last)
                j += 2 if tens else 1
            elif w in SCALES:
                number.scale(SCALES[w])
                last, j = "scale", j + 1
            elif w in ("oh", "o") and isinstance(last, int) and 10 <= last <= 99 and unit is not None:
                number.small(unit)
                last, j = unit, j + 2
            elif not started and after in SCALES and (w == "a" or w.isascii() and w.isdigit()):
                last = 1 if w == "a" else int(w)
                number.small(last)
                j += 1
            elif w == "and" and last == "scale" and after in SMALL:
                j += 1
            else:
                break
            started = True
        if started:
            out += map(str, number.end())
            i = j
        else:
            out.append(tokens[i])
            i += 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def _digits(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else digits(list(t)))


_NUMBER_WORD = r"\b(?:" + "|".join([*SMALL, *SCALES]) + r")\b"


def spoken_words(t: Column | str) -> Column:
    """Comparable words; only texts with a number word leave the JVM."""
    tokens = spoken_tokens(t)
    wanted = F.exists(tokens, lambda w: w.isin([*SMALL, *SCALES]))
    return F.when(wanted, _digits(F.when(wanted, tokens))).otherwise(tokens)


def lexicon_pattern(names: Sequence[str]) -> str:
    """One alternation, the longest first, matching whole names only; case matters."""
    ordered = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    return r"(?<![\p{IsAlphabetic}\p{N}])(?:" + "|".join(re.escape(n) for n in ordered) + r")(?![\p{IsAlphabetic}\p{N}])" if ordered else r"(?!)"


def names_in(t: Column | str, names: Sequence[str]) -> Column:
    """The names in a text, once each, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.col(t) if isinstance(t, str) else t, F.lit(lexicon_pattern(names)), F.lit(0)))


def respell(t: Column | str, say: Mapping[str, str]) -> Column:
    """Every name by how it is said, the longest first; null where no name is in the text."""
    ordered = sorted({n for n in say if n}, key=lambda n: (-len(n), n))
    own = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, ordered)) + r")(?![^\W_])") if ordered else None

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None or own is None or not own.search(x):
                return None
            return own.sub(lambda m: say[m[0]], x)

        return s.map(one).astype(object).where(lambda v: v.notna(), None)

    return run(F.col(t) if isinstance(t, str) else t)


def hear(tokens: Column | str, variants: Mapping[str, Sequence[str]]) -> Column:
    """Token sequences as they are misheard become the name's own tokens; the longest sequence first."""
    plain = lambda x: re.findall(r"[^\W_]+", x.lower())
    table = sorted(((tuple(plain(h)), plain(name)) for name, heard in variants.items() for h in heard if plain(h)), key=lambda p: (-len(p[0]), p[0]))

    def one(t):
        if t is None:
            return None
        out, i, t = [], 0, list(t)
        while i < len(t):
            for heard, name in table:
                if tuple(t[i : i + len(heard)]) == heard:
                    out += name
                    i += len(heard)
                    break
            else:
                out.append(t[i])
                i += 1
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def merge_lexicons(base: Column | str, overlay: Column | str) -> Column:
    """Two maps of names; the overlay wins."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (base, overlay))
    kept = F.map_filter(a, lambda k, _v: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)
