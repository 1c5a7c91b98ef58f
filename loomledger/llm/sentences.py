"""Problem 5: the sentences of documents in spaced and spaceless scripts, with their places.

A paragraph (blank lines end it) is cut at gaps, and every gap is scored. In spaced scripts a terminator opens a gap; what stands before it (abbreviations, acronyms,
initials, ordinals) and after it (case, digits, opening words, reporting clauses) speaks for or against an end. In spaceless scripts the text on both sides of a gap - a
terminator, and in Thai and Lao a space - is segmented by a lattice of dictionary words (``lexicon``); known words, final and opening words speak for an end, text that no
word covers against it, and after a quotation a reporting particle with a verb of saying, or a clause that ends in one, joins the quotation with its clause.

The gaps of a paragraph form a lattice: the path of the best total is taken, where a pair of quotation marks that is cut apart costs ``UNBALANCED`` once. Marks without
a partner cost nothing, so an unclosed one does not hold its paragraph together. Every step is linear in the text.

Places are code points of the text as it is, from 0, without white space at either end. Defined results: null, empty and blank texts have no sentences;
a text without any terminator is one sentence a paragraph; nothing is cut by length, however long the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomledger.llm import lexicon

_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n| )[^\S\r\n]*(?:\r\n|\r|\n| )\s*")
#: Abbreviations before a name, before a number, and those that go on in lower case, in the languages at hand.
BEFORE_NAME = set("dr prof st mt ft mr mrs ms mm capt col gov sen rep pres gen sgt lt rev hon sr sra srta dra dña mme mlle mgr mons me fr hr frl dipl ing им гр тов акад проф св стр डॉ श्री प्रो".split()) | {"m", "d"}
BEFORE_NUMBER = set("p pp pg pág págs no nos nr nro núm num vol vols fig figs ch chap sec art abs cf ca approx aprox env ver vers v c jan feb febr mar apr aug sept sep oct nov dec okt dez bd kap s ст стр рис гл т c. № vgl cca ungef ex".split())
NEVER = set("vs bzw usw etc e.g i.e z d.h u p.ex p.ej resp inkl evtl ggf viz et al jr cie тыс руб млн млрд напр".split()) - {"usw", "etc", "al", "jr"}
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Abbreviations that can end a sentence: only an opening word behind them tells; acronyms such as U.S. go with them.
EITHER = set("corp inc ltd co bros dept univ assn".split())
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
OPENERS = set("the a an he she it they we i you in on at by to from this that these those there here but and or yet so however when while after before since for as if his her its their our my your no not one two three many some all most who what why how where then now".split())
#: A run of terminators with the closing marks after it; French puts a space before them.
_SPACED = re.compile(r"(?P<t>[.!?…‽]+|[。！？।॥]+)(?P<c>(?:[\u00a0\u202f\u2009 ]?[»›]|[\"'”’“‘)\]」』])*)(?=\s|$|(?<=[。！？।॥])|(?<=[。！？।॥][」』”’）]))")
_WORD_BEFORE = re.compile(r"(?:[^\W_]|[.’'\u0300-\u036f\u0900-\u0903\u093a-\u094f])+$")
#: What it costs to cut a pair of quotation marks apart.
UNBALANCED = 3.0
#: Characters of each side of a gap that the lattice reads.
SIDE = 16
_EAST = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_SOUTH = {"thai": re.compile("[\u0e00-\u0e7f]"), "lao": re.compile("[\u0e80-\u0eff]"), "khmer": re.compile("[\u1780-\u17ff]"), "burmese": re.compile("[\u1000-\u109f]")}
_INDIC = re.compile("[\u0900-\u0dff]")
#: Opening marks and what closes them.
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』"}
_CLOSERS = set("”»“」』")


def quoted(par: str) -> list[tuple[int, int]]:
    """The outermost pairs of quotation marks; marks without a partner are none."""
    open_: list[int] = []
    found: list[tuple[int, int]] = []
    for m in re.finditer("[“”«»„「」『』]", par):
        ch = m[0]
        if ch in _CLOSERS:
            k = next((k for k in range(len(open_) - 1, max(-1, len(open_) - 4), -1) if ch in _PAIRS[par[open_[k]]]), None)
            if k is not None:
                begin = open_[k]
                del open_[k:]
                while found and found[-1][0] > begin:
                    found.pop()
                found.append((begin, m.start()))
                continue
        if ch in _PAIRS:
            open_.append(m.start())
    return found


def best_path(gaps: list[tuple[int, float]], pairs: list[tuple[int, int]]) -> list[int]:
    """The gaps (place, score) where sentences end: a passed gap costs its score, and the gaps inside a pair are taken only where they are worth more than ``UNBALANCED``."""
    ends: list[int] = []
    k = 0
    for begin, stop in [*pairs, (1 << 62, 1 << 62)]:
        while k < len(gaps) and gaps[k][0] <= begin:
            if gaps[k][1] > 0:
                ends.append(gaps[k][0])
            k += 1
        inside = []
        while k < len(gaps) and gaps[k][0] <= stop:
            inside.append(gaps[k])
            k += 1
        good = [g for g in inside if g[1] > 0]
        if 2 * sum(s for _, s in good) > UNBALANCED + 2 * WITHIN * len(good):
            ends += [at for at, s in good if s > WITHIN]
    return ends


#: What speaks against an end inside a quotation, at each gap.
WITHIN = 5.0


def _next_word(after: str) -> str:
    """The first character that tells, past opening marks and dashes."""
    return after.lstrip(" \t\r\n\u00a0\u202f\u2009—–-―\"'“«„‹(¿¡‘[")[:1]


def _spaced_gap(before: str, marks: str, closers: str, after: str) -> float:
    """How much speaks for the end of a sentence here (positive) or against it."""
    rest = after.lstrip()
    first = _next_word(after)
    if not rest:
        return 20.0
    if marks[0] in "。！？।॥":
        return 8.0
    dot = marks == "."
    if first.islower():
        # a reporting clause, or a sentence that goes on; a new one in lower case is rare
        return -8.0
    w = _WORD_BEFORE.search(before)
    word = (w[0] if w else "").lower().strip(".’'")
    if dot and not closers:
        if _INDIC.search(word):
            return -6.0  # the danda ends these sentences
        if word in MONTHS:
            return 4.0
        if word.isdigit() and len(word) <= 2 and rest.split(None, 1)[0].strip(".,;").lower() in MONTHS:
            return -8.0
        if first.isdigit() and (word in BEFORE_NUMBER or word in NEVER):
            return -8.0
        if word in BEFORE_NAME or word in NEVER:
            return -8.0
        if word in EITHER or _ACRONYM.fullmatch(word) and w and w[0].strip(".’'").isupper():  # U.S., not p.m.
            return 4.0 if re.match(r"[^\W\d_]*", rest)[0].lower() in OPENERS or not first.isalpha() else -5.0  # type: ignore[index]
        if len(word) == 1 and word.isalpha() and w and w[0][0].isupper():
            return -6.0  # an initial
        if len(word) == 1 and word.isalpha() and word not in "aiyàмhчмгйв" and first.isupper():
            return -5.0
        if word in BEFORE_NUMBER and word in ("cf", "ca", "approx", "aprox", "env", "ver", "vol", "fig", "nr", "pág", "sept"):
            return -6.0
    if marks in ("...", "…") and not first.isupper():
        return -4.0
    return 6.0


#: Verbs of saying that end a clause after a quotation in Hindi, where no small letter tells.
HI_SAY = {"पूछा", "कहा", "बोला", "बोली", "बोले", "लिखा", "बताया", "पुकारा", "चिल्लाया", "चिल्लाई", "चिल्लाए", "फुसफुसाया", "सोचा", "उत्तर दिया", "जवाब दिया"}
_INDIC_CLAUSE = re.compile(r"\s*([\u0900-\u0963\u0970-\u0dff][^।॥.!?…“”]*)")


def _said_in_indic(par: str, at: int) -> bool:
    """Whether the clause after a closed quotation ends in a verb of saying."""
    m = _INDIC_CLAUSE.match(par, at)
    words = m[1].split() if m else []
    return bool(words) and (words[-1] in HI_SAY or " ".join(words[-2:]) in HI_SAY)


def _spaced(par: str, _words: lexicon.Lattice | None) -> list[int]:
    """Where the sentences of a paragraph in a spaced script end."""
    gaps = []
    for m in _SPACED.finditer(par):
        score = _spaced_gap(par[max(0, m.start() - 24) : m.start()], m["t"], m["c"], par[m.end() : m.end() + 40])
        if m["c"] and score > 0 and _said_in_indic(par, m.end()):
            score = -8.0
        gaps.append((m.end(), score))
    pairs = quoted(par) if any(c in par for c in "“”«»„") else []
    return best_path(gaps, pairs)


def _sides(before: str, after: str, words: lexicon.Lattice) -> float:
    """What the words on both sides of a gap say: for an end where they are known, final or opening ones, against it where no word covers the text."""
    left, right = words.cut(before[-SIDE:]), words.cut(after[:SIDE])
    score = 0.0
    for side, at, told in ((left, -1, lexicon.FINAL), (right, 0, lexicon.OPENING)):
        own = [(w, k) for w, k in side if any(c.isalpha() for c in w)]
        if own:
            covered = sum(len(w) for w, k in own if k) / sum(len(w) for w, _ in own)
            score += (1.0 if covered >= 0.5 else -1.5) + (1.0 if own[at][0] in told[words.script] else 0.0)
        elif side:
            score += 1.0  # digits or marks alone
    return score


_EAST_END = re.compile(r"[。！？!?…]+[」』”’）)\]]*")


def _east(par: str, words: lexicon.Lattice) -> list[int]:
    """Ends in Chinese and Japanese."""
    pairs = quoted(par)
    gaps = []
    begin = k = 0
    for m in _EAST_END.finditer(par):
        after = par[m.end() : m.end() + 2 * SIDE]
        if not after.strip():
            continue
        while k < len(pairs) and pairs[k][1] < m.start():
            k += 1
        within = k < len(pairs) and pairs[k][0] < m.end() <= pairs[k][1]
        score = 4.0 if any(c in "。！？" for c in m[0]) else 2.0
        if not within:
            score += _sides(par[max(begin, m.start() - SIDE) : m.start()], after.lstrip(), words)
            if m[0][-1] in "」』”’" and (_reports(par, m.end(), words) or _says(par, begin, m.end(), words)):
                score -= 12.0
            elif m[0][0] in "!?…" and not _EAST.match(after.lstrip()[0]):
                score -= 6.0
        gaps.append((m.end(), score))
        if score > 0 and not within:
            begin = m.end()
    return best_path(gaps, pairs)


_CLAUSE = re.compile(r"[^。！？!?”“\n]*")


def _reports(par: str, at: int, words: lexicon.Lattice) -> bool:
    """Whether a Japanese clause after a closed quotation reports it: a particle, and where it needs one a verb of saying."""
    clause = words.cut(_CLAUSE.match(par, at, at + 4 * SIDE)[0])  # type: ignore[index]
    if not clause or not clause[0][1] or clause[0][0] not in lexicon.JA_REPORT:
        return False
    if not lexicon.JA_REPORT[clause[0][0]] or len(clause) > 1 and clause[1][0] in "、，":
        return True
    return any(known and w.startswith(tuple(lexicon.JA_SAY)) for w, known in clause[1:])


def _says(par: str, begin: int, at: int, words: lexicon.Lattice) -> bool:
    """Whether a Chinese clause after a quotation that begins its sentence ends in a verb of saying."""
    start = par[begin : begin + 3].lstrip()
    if start[:1] not in set("“「『‘"):
        return False
    clause = _CLAUSE.match(par, at)[0].rstrip("，：:,")[-SIDE:]  # type: ignore[index]
    last = words.cut(clause)[-1:] if clause else []
    return bool(last and last[0][1] and last[0][0] in lexicon.ZH_SAY)


_SOUTH_END = re.compile(r"[។៕៚။!?…]+[\"'”’)\]]*|\s+")


def _south(par: str, words: lexicon.Lattice) -> list[int]:
    """Ends in Thai and Lao, where a space is one unless a word of another script or a sign goes on across it, and in Khmer and Burmese, which have end marks."""
    gaps = []
    spaces = words.script in ("thai", "lao")
    for m in _SOUTH_END.finditer(par):
        before, after = par[max(0, m.start() - SIDE) : m.start()], par[m.end() : m.end() + SIDE]
        mark = not m[0].isspace()
        if not before or not after or not mark and not spaces or mark and spaces:
            continue
        score = (4.0 if mark else 1.0) + _sides(before, after.lstrip(), words)
        if not mark:
            foreign = before[-1].isascii() and before[-1].isalpha() and after[0].isascii() and after[0].isalpha()
            if foreign or before[-1] in "ฯ,:;(" or after[0] in "ๆฯ,;:)":
                score -= 4.0
        gaps.append((m.end() if mark else m.start(), score))
    return best_path(gaps, [])


def _kind(par: str) -> str:
    if par.isascii():
        return "spaced"
    for name, rx in _SOUTH.items():
        if len(rx.findall(par)) * 3 > len(par):
            return name
    return "east" if len(_EAST.findall(par)) * 4 > len(par) else "spaced"


class Lattices(dict):
    """The lattice of each script, made when a text first needs it."""

    def __init__(self, data):
        self.data = data

    def __missing__(self, script: str) -> lexicon.Lattice:
        self[script] = lexicon.Lattice(script, self.data(script))
        return self[script]


@lru_cache(maxsize=1)
def known() -> Lattices:
    return Lattices(lexicon.raw)


#: Of this worker, by the dictionary's path: tasks one after another share the lattices.
_OPEN: dict[str | None, Lattices] = {}


def spans(text: str | None, words: Lattices | None = None) -> list[tuple[int, int]]:
    """Start and stop of every sentence."""
    if not text:
        return []
    out = []
    begin = 0
    for stop, following in [*((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)), (len(text), len(text))]:
        par = text[begin:stop]
        if par.strip():
            kind = _kind(par)
            if kind != "spaced" and words is None:
                words = known()
            at = 0
            how = _spaced if kind == "spaced" else _east if kind == "east" else _south
            for end in [*how(par, words[kind] if kind != "spaced" else None), len(par)]:
                piece = par[at:end]
                own = piece.strip()
                if own and any(unicodedata.category(c)[0] in "LNS" for c in own):
                    first = begin + at + len(piece) - len(piece.lstrip())
                    out.append((first, first + len(own)))
                elif own and out and out[-1][1] <= begin + at:
                    out[-1] = (out[-1][0], begin + at + len(piece.rstrip()))  # marks alone belong to the sentence before
                at = end
        begin = following
    return out


def sentences(rows: DataFrame, key: str = "doc_id", text: str = "text", dictionary: str | None = None) -> DataFrame:
    """key, sent_ix, sent_start, sent_stop and sentence of every row; one Arrow pass without a shuffle.

    The dictionaries, of fixed size (some 500,000 words, 3 MB), are read on the driver from ``dictionary`` (Spark's own ICU library if it is not given) and broadcast.
    """
    kind = rows.schema[key].dataType.simpleString()
    shipped = rows.sparkSession.sparkContext.broadcast({s: lexicon.raw(s, dictionary) for s in lexicon.FILES})

    def run(batches):
        words = _OPEN.setdefault(dictionary, Lattices(lambda s: shipped.value[s]))
        for b in batches:
            at, ix, start, stop, own = [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for i, (x, y) in enumerate(spans(t, words)):
                    at.append(k)
                    ix.append(i)
                    start.append(x)
                    stop.append(y)
                    own.append(t[x:y])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ix, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(own, pa.string())], names=[key, "sent_ix", "sent_start", "sent_stop", "sentence"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, sent_ix int, sent_start bigint, sent_stop bigint, sentence string")
