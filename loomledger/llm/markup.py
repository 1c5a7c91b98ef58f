"""Problem 1: clean text with its structure from pages in HTML, Markdown, wiki or LaTeX notation.

A page becomes a sequence of leaf blocks: the text between block tags with its ancestors, and within it the lines that a light notation
sets apart. A linear-chain conditional random field labels the blocks - heading, list, code, formula, table, quote, drop, marked (running text with notation in it), text
(no notation) - from ancestors, line marks, the notation that inline rules see, and text features. It is trained on pages that ``labelled_pages`` renders in all four
notations with their labels, and decoded by Viterbi over the labels that a block can have at all.

The label decides: a block labelled text stays as it is, whatever marks stand in it, and a document counts as marked up when a block of its text or its title has another
label. Placeholders, ``<|...|>`` and lone symbols are text. In the clean text, headings are paragraphs of their own, items begin with a bullet, code is indented by four spaces,
formulas stand between ⟪ and ⟫. Defined results: null stays null, empty stays empty; broken or unclosed notation is taken away as far as it is recognised, and nothing raises,
whatever characters a text holds.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LABELS = ("text", "heading", "list", "code", "formula", "table", "quote", "drop", "marked")
PAGES = 300
TITLES = 200
EPOCHS = 50

_BLOCK = set("address article aside blockquote body caption center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li link main meta nav noscript ol p pre script section style summary syntaxhighlight table tbody tfoot thead title tr ul math gallery poem source".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|(?<!<)<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)(/?)>(?!>)", re.S | re.I)  # <<name>> is a placeholder
_ESCAPED_TAG = re.compile(r"&(?:amp;)*lt;(?:/?[A-Za-z][A-Za-z0-9]*(?:\s|/|&(?:amp;)*gt;)|!--|!DOCTYPE)", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
#: What any notation needs at least one of.
TRIGGER = re.compile(r"[<&\[{\\#*_`~|$>]|''|==|--|^\s*[-+=]|^\s*\d+[.)]\s", re.M)

_LINES = (
    ("fence", re.compile(r"\s{0,3}(?:```|~~~)")), ("atx", re.compile(r"#{1,6} +\S")), ("whead", re.compile(r"(={2,6})[^=\n].*\1\s*$")), ("thead", re.compile(r"\\(?:sub)*(?:section|chapter|paragraph|part|title)\*?\{")),
    ("preamble", re.compile(r"\\(?:documentclass|usepackage|begin\{document\}|end\{document\}|maketitle|author|date|newcommand|tableofcontents|bibliography)")), ("category", re.compile(r"\[\[(?:Category|File|Image):", re.I)),
    ("infobox", re.compile(r"\{\{[A-Z][^{}]*\|[^{}]*\}\}\s*$")), ("wtable", re.compile(r"\{\|")), ("env", re.compile(r"\\begin\{(?:verbatim|lstlisting|equation|align|displaymath|tabular|quote|quotation|itemize|enumerate|table|figure|center|abstract)\*?\}")),
    ("setext", re.compile(r"(?:={3,}|-{3,})\s*$")), ("hr", re.compile(r"\s{0,3}([-*_])(?: ?\1){2,}\s*$")), ("display", re.compile(r"\s*\$\$.*\$\$\s*$|\s*\\\[.*\\\]\s*$|\s*\$[^$\n]+\$\s*$")), ("item", re.compile(r"\s*\\item\b|\s*(?:[-+•]|\*{1,4})\s+\S")), ("number", re.compile(r"\s*\d{1,3}[.)]\s+\S")),
    ("bar", re.compile(r"\s*\|.*\|\s*$")), ("mark", re.compile(r"\s{0,3}>\s?\S")),
)
_ENVS = {"verbatim": "verbatim", "lstlisting": "verbatim", "equation": "equation", "align": "equation", "displaymath": "equation", "tabular": "tabular"}


class Block(NamedTuple):
    path: tuple[str, ...]
    kind: str
    raw: str
    marks: int  # notation taken away while cutting the block out


def _split_tags(text: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(ancestors, text, marks) of each leaf between block tags."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[str] = []
    buffer: list[str] = []
    marks, at = 0, 0

    def flush():
        nonlocal marks
        t = "".join(buffer)
        buffer.clear()
        if t.strip() or marks:
            out.append((tuple(stack), t, marks))
        marks = 0

    for m in _TAG.finditer(text):
        buffer.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            marks += 1
            continue
        close, name = bool(m[1]), m[2].lower()
        if name in ("td", "th") and close:
            buffer.append(" | ")
        if name == "br":
            buffer.append("\n")
        if name == "ref" or name == "sup" and not close:
            buffer.append(" " if name == "sup" else "")
        if name not in _BLOCK and name not in ("ref", "code") or name == "code" and "pre" not in stack:
            marks += 1
            continue
        flush()
        marks += 1
        if name in _VOID or m[4]:
            continue
        if not close:
            if name in ("p", "li", "tr", "h1", "h2", "h3") and name in stack:  # an end tag left out
                del stack[stack.index(name) :]
            stack.append(name)
        elif name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name) :]
    buffer.append(text[at:])
    flush()
    return out


def _split_lines(text: str, path: tuple[str, ...], marks: int) -> list[Block]:
    """The blocks that light notations set apart in one leaf."""
    out: list[Block] = []
    para: list[str] = []

    def flush(kind="para"):
        nonlocal marks
        t = "\n".join(para).strip("\n")
        para.clear()
        if t.strip() or marks:
            out.append(Block(path, kind, t, marks))
            marks = 0

    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if not line.strip():
            flush()
            continue
        kind = next((k for k, rx in _LINES if rx.match(line)), None)
        if kind is None:
            para.append(line)
            continue
        if kind == "setext":
            if len(para) == 1:
                flush("shead")
                out[-1] = out[-1]._replace(raw=out[-1].raw + "\n" + line)
                continue
            kind = "hr"
        if kind in ("number", "item") and para and kind == "number":  # a number that begins a wrapped line
            para.append(line)
            continue
        flush()
        body = [line]
        if kind == "fence":
            mark = line.strip()[:3]
            while i < len(lines):
                body.append(lines[i])
                i += 1
                if body[-1].strip().startswith(mark):
                    break
        elif kind == "wtable":
            while i < len(lines) and not body[-1].strip().startswith("|}"):
                body.append(lines[i])
                i += 1
        elif kind == "env":
            name = re.match(r"\\begin\{(\w+)", line)[1]  # type: ignore[index]
            kind = _ENVS.get(name, "envmark")
            if kind != "envmark":
                end = f"\\end{{{name}"
                while end not in body[-1] and i < len(lines):
                    body.append(lines[i])
                    i += 1
            elif line[line.index("}") + 1 :].strip():
                kind = "equote" if name.startswith("quot") else "para"
                while f"\\end{{{name}" not in body[-1] and i < len(lines) and lines[i].strip():
                    body.append(lines[i])
                    i += 1
        elif kind in ("item", "number", "mark", "atx", "para"):
            # a wrapped item goes on until the next mark or blank line
            while kind in ("item", "number", "mark") and i < len(lines) and lines[i].strip() and not any(rx.match(lines[i]) for _, rx in _LINES):
                body.append(lines[i])
                i += 1
        elif kind in ("bar",):
            while i < len(lines) and _LINES[14][1].match(lines[i]):
                body.append(lines[i])
                i += 1
        out.append(Block(path, kind, "\n".join(body), marks))
        marks = 0
    flush()
    return out


def parse(text: str) -> tuple[list[Block], bool]:
    """The blocks of a page, and whether its tags were escaped."""
    escaped = "&" in text and bool(_ESCAPED_TAG.search(text))
    if escaped:
        for _ in range(3):
            if not _ESCAPED_TAG.search(text):
                break
            text = html.unescape(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[Block] = []
    for path, leaf, marks in _split_tags(text) if "<" in text else [((), text, 0)]:
        if any(t in ("pre", "script", "style", "head", "title", "syntaxhighlight", "source", "math", "tr") for t in path):
            out.append(Block(path, "raw", leaf, marks))
        else:
            out += _split_lines(leaf, path, marks)
    return out, escaped


class Seen(NamedTuple):
    """A block with what the inline rules make of it: the text without notation, how much they took away, and which of them."""

    block: Block
    plain: str
    taken: int
    rules: frozenset[str]


#: Kinds of blocks whose inside is no running text.
_OPAQUE = {"fence", "verbatim", "equation", "tabular", "wtable", "bar", "preamble", "category", "infobox", "envmark", "hr"}
_CODE_TAGS = {"pre", "code", "math", "syntaxhighlight", "source", "script", "style"}


def seen(block: Block) -> Seen:
    if block.kind in _OPAQUE or _CODE_TAGS & set(block.path) or not block.raw:
        return Seen(block, block.raw, 0, frozenset())
    return Seen(block, *inline(block.raw))


def features(own: Seen, first: bool) -> list[str]:
    block = own.block
    raw = block.raw.strip()
    n = len(raw)
    f = ["bias", "k:" + block.kind, *{"a:" + t for t in block.path}, *{"i:" + r for r in own.rules}]
    f.append("taken:" + str(min(3, own.taken)) + ("+tags" if block.marks else ""))
    if block.path:
        f.append("leaf:" + block.path[-1])
    f.append("len:" + str(min(9, n.bit_length())))
    end = raw[-1:] or " "
    f.append("end:" + ("stop" if end in ".!?…。！？।" else "colon" if end in ":：" else "word" if end.isalnum() else "mark"))
    letters, signs = sum(map(str.isalpha, raw)), len("".join(raw.split())) - sum(map(str.isalnum, raw))
    f.append("odd:" + str(min(5, signs * 10 // max(1, n))))
    f.append("alpha:" + str(letters * 5 // max(1, n)))
    f.append("lines:" + str(min(4, raw.count("\n"))))
    for name, hit in (("tex", "\\" in raw), ("eq", "=" in raw), ("paren", "(" in raw and ")" in raw), ("bars", raw.count("|") > 1), ("idx", "[" in raw and "]" in raw), ("num", raw[:1].isdigit()), ("first", first), ("empty", not raw)):
        if hit:
            f.append("x:" + name)
    return f


_OF_TAG = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("li", "dd", "dt"), "list"), **dict.fromkeys(("pre", "code", "syntaxhighlight", "source"), "code"), "math": "formula", **dict.fromkeys(("table", "tr", "td", "th"), "table"), "blockquote": "quote", **dict.fromkeys(("head", "title", "script", "style"), "drop")}
_OF_KIND = {**dict.fromkeys(("atx", "shead", "whead", "thead"), "heading"), **dict.fromkeys(("item", "number"), "list"), **dict.fromkeys(("fence", "verbatim"), "code"), **dict.fromkeys(("equation", "display"), "formula"), **dict.fromkeys(("bar", "wtable", "tabular"), "table"), **dict.fromkeys(("mark", "equote"), "quote"), **dict.fromkeys(("preamble", "category", "infobox", "envmark", "hr"), "drop")}


@lru_cache(maxsize=1024)
def _bar(found: frozenset[str]) -> np.ndarray:
    return np.array([0.0 if x in found else -1e9 for x in LABELS])


def possible(own: Seen) -> frozenset[str]:
    """The labels that a block can have: what its tags and its line mark stand for, and always text and marked. Only what has no text can be dropped without a tag or mark for it."""
    block = own.block
    found = {"text", "marked", _OF_KIND.get(block.kind, "text"), *(_OF_TAG.get(t, "text") for t in block.path)}
    if not block.raw.strip():
        found.add("drop")
    elif block.kind == "para" and _MATH.fullmatch(block.raw.strip()):
        found.add("formula")
    return frozenset(found)


class Crf:
    """A linear-chain conditional random field; scores are log-potentials."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def emissions(self, pages: list[list[list[str]]]) -> list[np.ndarray]:
        get = self.index.get
        flat, starts, n = [], [], 0
        for page in pages:
            for f in page:
                starts.append(len(flat))
                flat += [k for x in f if (k := get(x)) is not None] or [0]
            n += len(page)
        e = np.add.reduceat(self.emit[np.array(flat, np.int64)], np.array(starts, np.int64)) if starts else np.zeros((0, len(LABELS)))
        return np.split(e, np.cumsum([len(p) for p in pages])[:-1])

    def decode(self, pages: list[list[list[str]]], bars: list[list[np.ndarray]] | None = None) -> list[np.ndarray]:
        """The most probable labels of each page; ``bars`` are added to the scores of each block. Pages of like length go together."""
        scores = self.emissions(pages)
        for e, rows in zip(scores, bars or (), strict=False):
            if rows:
                e += np.array(rows)
        out: list[np.ndarray] = [np.zeros(0, int)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        for a in range(0, len(order), 256):
            some = [i for i in order[a : a + 256] if len(pages[i])]
            if not some:
                continue
            steps = len(pages[some[0]])
            lengths = np.array([len(pages[i]) for i in some])
            e = np.zeros((len(some), steps, len(LABELS)))
            for k, i in enumerate(some):
                e[k, : len(scores[i])] = scores[i]
            back = np.zeros((len(some), steps, len(LABELS)), np.int8)
            best = e[:, 0].copy()
            for t in range(1, steps):
                live = int((lengths > t).sum())
                s = best[:live, :, None] + self.move
                back[:live, t] = s.argmax(1)
                best[:live] = s.max(1) + e[:live, t]
            last = best.argmax(1)
            for k, i in enumerate(some):
                path = np.zeros(lengths[k], int)
                path[-1] = last[k]
                for t in range(lengths[k] - 1, 0, -1):
                    path[t - 1] = back[k, t, path[t]]
                out[i] = path
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(pages: list[list[list[str]]], labels: list[list[int]], epochs: int = EPOCHS, l2: float = 1e-4) -> Crf:
    """Maximum conditional likelihood by Adagrad; forward and backward run over all pages at once, the longest first, so that each step has only the pages that reach it."""
    order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
    pages, labels = [pages[i] for i in order], [labels[i] for i in order]
    index: dict[str, int] = {"\0": 0}
    for p in pages:
        for f in p:
            for x in f:
                index.setdefault(x, len(index))
    k = len(LABELS)
    model = Crf(index, np.zeros((len(index), k)), np.zeros((k, k)))
    steps, n = max(map(len, pages)), len(pages)
    mask = np.zeros((n, steps), bool)
    gold = np.zeros((n, steps), int)
    for i, y in enumerate(labels):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
    feats = [np.array([index[x] for x in f]) for p in pages for f in p]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate(feats)
    want = np.zeros((n, steps, k))
    want[np.arange(n)[:, None], np.arange(steps), gold] = mask
    pairs = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen_e, seen_m = np.full_like(model.emit, 1e-6), np.full_like(model.move, 1e-6)
    starts = np.searchsorted(owner, np.arange(len(feats)))
    live = mask.sum(0)  # how many pages reach each step
    last = mask.sum(1) - 1
    by_feature = np.argsort(flat, kind="stable")
    present, first = np.unique(flat[by_feature], return_index=True)
    for _ in range(epochs):
        e = np.zeros((n, steps, k))
        e[mask] = np.add.reduceat(model.emit[flat], starts)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, steps):
            m = live[t]
            fwd[:m, t] = _lse(fwd[:m, t - 1, :, None] + model.move, 1) + e[:m, t]
        z = _lse(fwd[np.arange(n), last], 1)
        expected = np.zeros((k, k))
        for t in range(steps - 1, 0, -1):
            m = live[t]
            after = model.move + (e[:m, t] + bwd[:m, t])[:, None, :]
            bwd[:m, t - 1] = _lse(after, 2)
            expected += np.exp(fwd[:m, t - 1, :, None] + after - z[:m, None, None]).sum(0)
        post = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        g = np.zeros_like(model.emit)
        g[present] = np.add.reduceat((post - want)[mask][owner[by_feature]], first)
        g = g / n + l2 * model.emit
        gm = (expected - pairs) / n + l2 * model.move
        seen_e += g * g
        seen_m += gm * gm
        model.emit -= 0.5 * g / np.sqrt(seen_e)
        model.move -= 0.2 * gm / np.sqrt(seen_m)
    return model


_POOL = ("harbour", "river", "minute", "council", "lantern", "report", "bridge", "second", "north", "keeper", "gauge", "storm", "Bericht", "Brücke", "registre", "rivière", "invierno", "puente", "отчёт", "город", "журнал", "記録", "橋", "光", "报告", "山谷", "पुल", "घाटी", "สะพาน", "ประตู")
#: Formulas and code lines to render.
_FORMULAS = (r"E = m c^2", r"\frac{a}{b} + 1", r"\sum_{i=1}^{9} x_i \le 4", r"x_{3} \approx 7", r"p(t) = p_0 e^{-t/5}", r"\int_0^1 f(x) dx")
_CODE = ("x = read('a', 3)", "for i in range(9):", "    y[i] = f(x)  # row", "def f(x): return x[1]", "print(total / n);", "if (a < b) { return a; }", "SELECT n FROM t WHERE n > 3;")


def _sentence(r: random.Random, lo: int = 5, hi: int = 18) -> str:
    w = [str(r.randint(1, 3000)) if r.random() < 0.06 else r.choice(_POOL) for _ in range(r.randint(lo, hi))]
    if r.random() < 0.1:
        w[len(w) // 2] += r.choice((" (it was late)", " & Co.", " *", " #7", ", no. 3,"))
    return " ".join(w) + r.choice(("", ".", ".", ".", ".", "!", "?", "。"))


#: Notation inside running text by where it is used, and what looks like notation and is none; {} is a word.
_SPANS = {
    "html": ("<b>{}</b>", "<i>{}</i>", '<a href="/p/7">{}</a>', "{} &amp; {}", "{}&nbsp;{}", "&quot;{}&quot;", "<!-- {} -->", "{}<br />", "{}<sup>2</sup>", "<em>{} {}</em>", "&#8212; {}", "<span class=\"m\">{}</span>", "<code>{}</code>"),
    "md": ("**{}**", "*{}*", "_{}_", "[{}](/p/7)", "![{}](a.png)", "`{}`", "~~{}~~", "__{}__", "{}[^1]", "[{} {}](https://example.org/x)", "\\*{}"),
    "wiki": ("'''{}'''", "''{}''", "[[{}]]", "[[{}|{}]]", "{{{{cite book|title={}|year=1880}}}}", "<ref>{}</ref>", "[https://example.org {}]", "{{{{lang|fr|{}}}}}"),
    "tex": ("\\emph{{{}}}", "\\textbf{{{}}}", "{}~\\cite{{{}}}", "$x_{{3}} = 7$", "{}\\footnote{{{}}}", "5\\% {}", "\\ref{{{}}}", "{} \\& {}"),
}
_DECOYS = ("5 * 3 * 2", "#7", "[sic]", "{}_notes_31", "$5 and $7", "<|endoftext|>", "{{{{{}.{}}}}}", "${{{}}}", "<%= {} %>", "__TITLE__", "3 < 4", "9 > 7", "{} & {}", "{} -- {}", "* {}", "[Your {} here]", "C:\\{}", "{}/{}", "(see {})", "~40", "{}: {}", "`{}", "a|b", "^{}")


def _sprinkled(r: random.Random, text: str, spans: tuple[str, ...], share: float) -> str:
    """A text with some of ``spans`` beside its words, each with as many words as it takes."""
    words = text.split(" ")
    for _ in range(r.choice((1, 1, 2, 4)) if r.random() < share else 0):
        shape = r.choice(spans)
        words.insert(r.randint(0, len(words)), shape.format(*(r.choice(_POOL) for _ in range(4))))
    return " ".join(words)


def _gold(own: Seen, label: str) -> str:
    """The label of a block of a rendered piece: that of the piece where the block can have it; running text is marked where tags, a mark or a rule took something away."""
    can = possible(own)
    if own.block.raw.strip() and label in can and label not in ("text", "marked", "drop"):
        return label
    if "drop" in can and (not own.block.raw.strip() or label == "drop"):
        return "drop"
    return "marked" if own.taken or own.block.marks else "text"


def labelled_pages(n: int = PAGES, titles: int = TITLES, seed: int = 5) -> tuple[list[list[list[str]]], list[list[int]], list[list[np.ndarray]]]:
    """Features, labels and bars of pages and titles that are rendered from a known structure in a notation, at times in two or none."""
    r = random.Random(seed)
    rendered: list[list[tuple[Seen, str]]] = []
    for _ in range(n):
        plan = []
        for _ in range(r.randint(2, 14)):
            plan.append(r.choices(LABELS[:7], (7, 3, 3, 1, 1.2, 1, 1))[0])
        notations = [r.choice(("html", "md", "wiki", "tex", "plain", "plain", "plain"))]
        if r.random() < 0.25:
            notations.append(r.choice(("html", "md", "wiki", "tex")))
        page, traces = [], r.choice(("", *_SPANS))
        for notation in notations:
            for piece, label in _render(r, notation, plan[:: len(notations)]):
                # a page without a notation of its own can hold traces of one
                piece = _sprinkled(r, piece, _SPANS[traces], 0.35) if notation == "plain" and traces else piece
                page += [(own, _gold(own, label)) for own in map(seen, parse(piece)[0])]
        if page:
            rendered.append(page)
    for _ in range(titles):
        t = _sprinkled(r, _sentence(r, 2, 7).rstrip(".。!?"), _DECOYS, 0.3)
        notation = r.choice(("plain", "plain", *_SPANS))
        if notation != "plain":
            t = r.choice(({"html": "<b>{}</b>", "md": "# {}", "wiki": "== {} ==", "tex": "\\section{{{}}}"}[notation].format(t), _sprinkled(r, t, _SPANS[notation], 1.0)))
        own = _title(t)
        rendered.append([(own, _gold(own, "text"))])
    return [[features(own, i == 0) for i, (own, _) in enumerate(p)] for p in rendered], [[LABELS.index(y) for _, y in p] for p in rendered], [[_bar(possible(own)) for own, _ in p] for p in rendered]


def _render(r: random.Random, notation: str, plan: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    def text() -> str:
        t = _sprinkled(r, " ".join(_sentence(r) for _ in range(r.randint(1, 4))), _DECOYS, 0.25)
        return _sprinkled(r, t, _SPANS[notation], 0.4) if notation != "plain" else t

    head = lambda: _sentence(r, 2, 7).rstrip(".。!?")
    if notation == "html" and r.random() < 0.7:
        out += [(f"<html><head><title>{head()}</title></head></html>", "drop"), (f"<script>var q={r.randint(1, 99)};</script>", "drop"), ("<style>.m{margin:0}</style>", "drop")]
    if notation == "tex" and r.random() < 0.6:
        out += [("\\documentclass{article}", "drop"), ("\\usepackage{amsmath} % needed", "drop"), ("\\begin{document}", "drop")]
    if notation == "wiki" and r.random() < 0.6:
        out.append((f"{{{{Infobox thing|name={head()}|year={r.randint(1700, 1990)}}}}}", "drop"))
    for what in plan:
        code, formula = "\n".join(r.choices(_CODE, k=r.randint(1, 4))), r.choice(_FORMULAS)
        cells = [[r.choice(_POOL), str(r.randint(1, 999)), str(r.randint(1700, 1990))] for _ in range(r.randint(2, 4))]
        items = [_sentence(r, 3, 12) for _ in range(r.randint(2, 4))]
        if notation == "html":
            esc = html.escape(code)
            piece = {
                "text": r.choice((f"<p>{text()}</p>", f"<div>{text()}</div>", f"<body>{text()}</body>", f'<p class="m">{text()}</p>')), "heading": f"<h{(k := r.randint(1, 4))}>{head()}</h{k}>",
                "list": "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "code": r.choice((f"<pre><code>{esc}</code></pre>", f"<pre>{esc}</pre>")), "formula": f'<span class="math">\\({formula}\\)</span>' if r.random() < 0.3 else f"<math>{formula}</math>",
                "table": "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>", "quote": f"<blockquote>{text()}</blockquote>",
            }[what]
        elif notation == "md":
            mark = r.choice("-+*")
            piece = {
                "text": text(), "heading": r.choice((f"{'#' * r.randint(1, 4)} {head()}", f"{head()}\n------")), "list": "\n".join((f"{k}. {x}" if mark == "+" and len(items) > 2 else f"{mark} {x}") for k, x in enumerate(items, 1)),
                "code": f"```\n{code}\n```" if r.random() < 0.6 else f"~~~python\n{code}\n~~~", "formula": r.choice((f"$${formula}$$", f"${formula}$")), "table": "\n".join("| " + " | ".join(row) + " |" for row in cells), "quote": "> " + text(),
            }[what]
        elif notation == "wiki":
            bar = "=" * r.randint(2, 4)
            piece = {
                "text": text(), "heading": f"{bar} {head()} {bar}", "list": "\n".join("*" * r.randint(1, 2) + " " + x for x in items), "code": f"<syntaxhighlight lang=\"python\">\n{code}\n</syntaxhighlight>", "formula": f"<math>{formula}</math>",
                "table": '{| class="wikitable"\n' + "\n|-\n".join("| " + " || ".join(row) for row in cells) + "\n|}", "quote": f"<blockquote>{text()}</blockquote>",
            }[what]
        elif notation == "tex":
            piece = {
                "text": text(), "heading": f"\\{r.choice(('section', 'subsection*', 'subsubsection'))}{{{head()}}}", "list": "\\begin{itemize}\n" + "\n".join("\\item " + x for x in items) + "\n\\end{itemize}", "code": f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}",
                "formula": r.choice((f"\\begin{{equation}}\n{formula}\n\\end{{equation}}", f"${formula}$")), "table": "\\begin{tabular}{lrr}\n" + " \\\\\n".join(" & ".join(row) for row in cells) + "\n\\end{tabular}", "quote": f"\\begin{{quote}}{text()}\\end{{quote}}",
            }[what]
        else:
            piece, what = head() if what == "heading" else text(), "text"
        out.append((piece, what))
    if notation == "tex" and r.random() < 0.6:
        out.append(("\\end{document}", "drop"))
    if notation == "wiki" and r.random() < 0.6:
        out.append((f"[[Category:{head()}]]", "drop"))
    return out


@lru_cache(maxsize=1)
def model() -> Crf:
    pages, labels, _ = labelled_pages()
    return fit(pages, labels)


_MATH = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$|(?<![\\\w$])\$(?=[^$\n]*[\\^_{=])([^$\n]+?)(?<!\s)\$(?![\d{])", re.S)
_CODE_SPAN = re.compile(r"(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
_PLACEHOLDER = re.compile(r"\{\{\s?=?[\w.:-]+(?: [\w.:-]+){0,2}\s?\}\}|\$\{[^{}\n]*\}|#\{[^{}\n]*\}|<%.*?%>|<<[\w. ]+>>|__[A-Z][A-Z_ ]*__|\[%.*?%\]|%%[A-Z_.]+%%|@@[\w.]+@@|<\|[^|\n]*\|>|(?<![\\\w}{\]$#^_*])\{[\w. :-]{1,30}\}")
_WIKI_BARE = re.compile(r"\{\{\s?(?:reflist|references|stub|clear|toc|citation needed|cn|fact)\s?\}\}", re.I)
_INLINE: tuple[tuple[str, re.Pattern[str], str], ...] = (
    ("{{", re.compile(r"\{\{quote\|((?:[^{}]|\{[^{}]*\})*)\}\}", re.I), r"\1"), ("{{", re.compile(r"\{\{[^{}]*\|[^{}]*\}\}"), ""), ("{{", _WIKI_BARE, ""),
    ("[[", re.compile(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", re.I), ""), ("[[", re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    ("](", re.compile(r"!?\[([^\[\]]*)\]\([^()\n]*\)"), r"\1"), ("[http", re.compile(r"\[https?://\S+ ([^\[\]]*)\]"), r"\1"), ("[^", re.compile(r"\[\^[\w-]+\]:?"), ""),
    ("''", re.compile(r"''+"), ""), ("**", re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", re.S), r"\1"), ("__", re.compile(r"(?<![\w_])__(?=[^\s_])(.+?)(?<=[^\s_])__(?![\w_])"), r"\1"), ("~~", re.compile(r"~~(?=\S)([^~\n]+?)~~"), r"\1"),
    ("*", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*\\])\*(?![\w*])"), r"\1"), ("_", re.compile(r"(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_\\])_(?![\w_])"), r"\1"),
    ("{", re.compile(r"\\(?:footnote|cite[pt]?|ref|eqref|label|pageref|index|autoref|bibitem|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])*\{[^{}]*\}"), ""),
    ("{", re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?"), ""), ("{", re.compile(r"\\(?:href|url)\{[^{}]*\}\{([^{}]*)\}"), r"\1"), ("{", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}"), r"\1"),
    ("\\", re.compile(r"\\(?:item|par|noindent|maketitle|centering|hline|newline|textbackslash|LaTeX|TeX|quad|qquad|ldots|dots|tiny|small|large|bf|it|em)\b\s?"), ""), ("\\", re.compile(r"\\\\"), "\n"), ("\\", re.compile(r"\\([_#%&{}$~^*\[\]()|`!.+-])"), r"\1"),
)
#: Rules in the order they run, those in a row that need the same mark together; what nests is repeated, from the innermost out.
_RULES = [(need, [(rx, to) for _, rx, to in group]) for need, group in groupby(_INLINE, key=lambda r: r[0])]
_NESTS = ("{{", "{")


@lru_cache(maxsize=16)
def _held(pair: str) -> re.Pattern[str]:
    return re.compile(f"{pair[0]}(\\d+){pair[1]}")


def _unused(text: str) -> str:
    """Two characters for private use that the text has not."""
    free = (chr(c) for block in (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE)) for c in block)
    out = ""
    for ch in free:
        if ch not in text:
            out += ch
            if len(out) == 2:
                return out
    raise AssertionError("no text holds them all")


def inline(text: str) -> tuple[str, int, frozenset[str]]:
    """A block's text without notation inside, how much was taken away, and by which rules. Formulas, code spans and placeholders are held back meanwhile."""
    if not TRIGGER.search(text):
        return text, 0, frozenset()
    n = 0
    hits: set[str] = set()
    held: list[str] = []
    pair = _unused(text)
    restore = lambda t: _held(pair).sub(lambda m: held[int(m[1])], t) if held else t

    def hold(s: str) -> str:
        held.append(restore(s))  # what is held never holds another place
        return f"{pair[0]}{len(held) - 1}{pair[1]}"

    def count(rule: str, k: int) -> None:
        nonlocal n
        if k:
            n += k
            hits.add(rule)

    if "$" in text or "\\" in text:
        text, k = _MATH.subn(lambda m: hold("⟪" + next(g for g in m.groups() if g is not None).strip() + "⟫"), text)
        count("math", k)
    if "`" in text:
        text, k = _CODE_SPAN.subn(lambda m: hold(m[2]), text)
        count("code", k)
    if any(c in text for c in ("{", "__", "<", "[%", "%%", "@@")):
        text = _PLACEHOLDER.sub(lambda m: m[0] if _WIKI_BARE.match(m[0]) else hold(m[0]), text)
    for need, rules in _RULES:
        more = need in text
        while more:
            before = n
            for rx, to in rules:
                text, k = rx.subn(to, text)
                count(need, k)
            more = need in _NESTS and n > before
    if "~" in text and n:
        text = re.sub(r"(?<=\S)~(?=\S)", " ", text)
    if "&" in text:
        entities = len(_ENTITY.findall(text))
        if entities:
            text = html.unescape(text)
            count("entity", entities)
    return restore(text), n, frozenset(hits)


_STRIP = {
    "atx": re.compile(r"^#{1,6} +|\s+#+\s*$"), "whead": re.compile(r"^=+\s*|\s*=+\s*$"), "thead": re.compile(r"^\\\w+\*?\{|\}\s*$"), "shead": re.compile(r"\n[=-]{3,}\s*$"), "item": re.compile(r"^\s*(?:\\item\b|[-+*•]+)\s*"), "number": re.compile(r"^\s*\d{1,3}[.)]\s+"),
    "mark": re.compile(r"^\s{0,3}>\s?", re.M), "fence": re.compile(r"\A.*\n?|^\s*(?:```|~~~)\s*\Z", re.M), "verbatim": re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?\n?"), "equation": re.compile(r"\\(?:begin|end)\{[^{}]*\}\n?"), "tabular": re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?\n?"), "display": re.compile(r"^\s*(?:\$\$?|\\\[)|(?:\$\$?|\\\])\s*$"),
}


def render(own: Seen, label: str) -> str:
    """What a labelled block becomes."""
    block = own.block
    raw, kind = block.raw, block.kind
    if label == "text":
        return raw.strip()
    if label == "drop":
        return ""
    if label == "marked":
        return own.plain.strip()
    if kind in _STRIP and _OF_KIND.get(kind) == label:
        raw = _STRIP[kind].sub("", raw)
    if label == "code":
        return "\n".join("    " + x for x in (html.unescape(raw) if "&" in raw else raw).strip("\n").split("\n"))
    if label == "formula":
        return "⟪" + html.unescape(re.sub(r"^\s*(?:\\[(\[]|\$\$?)|(?:\\[)\]]|\$\$?)\s*$", "", raw.strip())).strip() + "⟫"
    if label == "table":
        rows = re.sub(r"(?m)^\s*(?:\{\|.*|\|\}|\|-+)\s*$\n?|^\s*[|!]\s?|\s*\|\s*$", "", raw)
        return inline(re.sub(r"\s*(?:\|\||!!|(?<!\\)&(?!\w+;|#)|\|)\s*", " | ", re.sub(r"\\\\\s*", "", rows)).strip())[0]
    text = (own.plain if raw is block.raw else inline(raw)[0]).strip()
    return "• " + text if label == "list" and text else text


class Converted(NamedTuple):
    text: str
    removed: int
    blocks: list[tuple[str, str]]


def convert(texts: list[str], crf: Crf, titles: bool = False) -> list[Converted]:
    """The clean text of many pages, or of their titles, at once; ``removed`` is the number of blocks that are no plain text."""
    if titles:
        pages = [[_title(t)] for t in texts]
    else:
        pages = [list(map(seen, parse(t)[0])) if TRIGGER.search(t) else [Seen(Block((), "para", p, 0), p, 0, frozenset()) for p in re.split(r"\n\s*\n", t) if p.strip()] for t in texts]
    labels = crf.decode([[features(x, i == 0) for i, x in enumerate(page)] for page in pages], [[_bar(possible(x)) for x in page] for page in pages])
    out = []
    for page, ys in zip(pages, labels, strict=True):
        done, removed = [], 0
        for x, y in zip(page, ys, strict=True):
            label = LABELS[y]
            removed += label != "text"
            text = render(x, label)
            if text.strip():
                done.append(("text" if label == "marked" else label, text))
        parts = []
        for i, (kind, text) in enumerate(done):
            if i:
                parts.append("\n" if kind == done[i - 1][0] and kind in ("list", "table") else "\n\n")
            parts.append(text)
        out.append(Converted("".join(parts), removed, done))
    return out


_TITLE_MARKS = re.compile(r"^#{1,6} +|^=+ | =+$|^\\\w+\*?\{(?=[^{}]*\}$)|(?<!<)</?[A-Za-z][^<>]*>(?!>)|<!--.*?-->")


def _title(title: str) -> Seen:
    """A title as a block of its own kind: what marks it as one, and the rules of running text."""
    bare = _TITLE_MARKS.sub("", html.unescape(title) if _ESCAPED_TAG.search(title) else title)
    plain, taken, rules = inline(bare)
    return Seen(Block((), "name", title, int(bare != title)), plain, taken, rules)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, clean_text, clean_title, removed (blocks of either that hold notation) and blocks (kind, text) of every document; one pass, no shuffle."""
    key = docs.schema["doc_id"].dataType.simpleString()
    crf = docs.sparkSession.sparkContext.broadcast(model())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def run(batches):
        m = crf.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                s = b.slice(a, 500)
                texts, titles = s.column("text").to_pylist(), s.column("title").to_pylist()
                t, h = convert([x or "" for x in texts], m), convert([x or "" for x in titles], m, titles=True)
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array([None if x is None else c.text if x else x for x, c in zip(texts, t, strict=True)], pa.string()), pa.array([None if x is None else c.text for x, c in zip(titles, h, strict=True)], pa.string()), pa.array([c.removed + d.removed for c, d in zip(t, h, strict=True)], pa.int32()), pa.array([[{"kind": k, "text": v} for k, v in c.blocks] for c in t], kind)],
                    names=["doc_id", "clean_text", "clean_title", "removed", "blocks"],
                )

    return docs.select("doc_id", "title", "text").mapInArrow(run, f"doc_id {key}, clean_text string, clean_title string, removed int, blocks array<struct<kind:string,text:string>>")


def marked_up(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """The ids of the documents in whose text or title the random field finds notation; only those with a character that notation needs are labelled."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(crf or model())

    def run(batches):
        m = shipped.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                s = b.slice(a, 500)
                hit: set[int] = set()
                for column, titles in (("text", False), ("title", True)):
                    texts = s.column(column).to_pylist()
                    at = [i for i, t in enumerate(texts) if t and i not in hit and TRIGGER.search(t)]
                    hit |= {i for i, c in zip(at, convert([texts[i] for i in at], m, titles), strict=True) if c.removed}
                yield pa.RecordBatch.from_arrays([s.column("doc_id").take(pa.array(sorted(hit), pa.int64()))], names=["doc_id"])

    return docs.select("doc_id", "title", "text").mapInArrow(run, f"doc_id {key}").distinct()
