"""Problem 10: unfilled templates, filler, error pages and notices that scripts are required.

A regularised linear classifier over hashed n-grams of tokens, lengths and the title. Its labels are weak: a segment (line or
sentence) is positive where a status line, an error or script phrase, a placeholder or filler phrase is in it, unlabelled where it stands in one
document with such a segment, else negative. It is trained on a bounded sample - the ``SAMPLE`` documents with the smallest hash of
their id - and scores every segment of every document; a document is found if any of its segments is.

Placeholders become one token by their shape, numbers and request ids too, so that names in them do not matter.
``validate`` trains on some hosts and reports precision and recall against the weak labels on the others.
Defined results: null, empty and blank texts are not found (there is no residue in them); a table without any positive label finds nothing.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

SAMPLE = 6000
NEGATIVES = 16_000
BUCKETS = 1 << 18
L2 = 2e-6
ROUNDS = 100

_NAME = r"[\w.:=-]+(?: [\w.:=-]+){0,3}"
#: The shapes of placeholders of common template languages.
SHAPES = {
    "{{}}": rf"\{{\{{\s?=?{_NAME}\s?\}}\}}(?!\}})", "${}": rf"\$\{{\s?{_NAME}\s?\}}", "#{}": rf"#\{{\s?{_NAME}\s?\}}", "<%>": rf"<%[=-]?\s?{_NAME}\s?-?%>",
    "{%}": rf"\{{%\s?{_NAME}\s?%\}}", "__X__": r"(?<![\w_])__[A-Z][A-Z_ ]*[A-Z]__(?![\w_])", "[%]": rf"\[%\s?{_NAME}\s?%\]", "%%": r"%%?[A-Z][A-Z_]+%%?", "%()s": r"%\([a-z_]+\)[sd]",
    "@@": r"@@\w+@@", "<<>>": rf"<<\s?{_NAME}\s?>>", "[your]": r"\[(?:[Yy]our|YOUR|[Ii]nsert|INSERT|[Ee]nter|[Aa]dd) [^\[\]\n]{1,40}\]", "[tbd]": r"\[[^\[\]\n]{1,40} (?:TBD|TBC|TODO)\]|\[(?:TBD|TBC|TODO)\]",
    "(insert)": r"\((?:insert|enter|add|your) [^()\n]{1,40} here\)", "{}": r"(?<![\\\w{}\]$#^_*])\{[\w. :-]{1,30}\}(?!\})", "todo": r"\b(?:TODO|TBD|FIXME):",
}
#: Wiki templates that stand without arguments.
_BARE = re.compile(r"\{\{\s?(?:reflist|references|stub|clear|toc|citation needed|cn|fact|unreferenced|[\w ]*-stub)\s?\}\}", re.I)
_SHAPE = "|".join(f"({p})" for p in SHAPES.values())
_TRIGGER = re.compile(r"[{}<%@_\[(]|TODO|TBD|FIXME")
_SHAPES = re.compile(_SHAPE)
_KINDS = list(SHAPES)
_EACH = "぀-ヿ一-鿿฀-๿"
_PLAIN = re.compile(rf"[{_EACH}]|[^\W_{_EACH}]+|[^\w\s]|_")
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？।])")
#: Phrases of error pages, access pages, script notices and filler; the weak labels.
_PHRASES = re.compile(
    r"\b(?:400 Bad Request|401 Unauthorized|40[34] (?:Forbidden|Not Found)|408 Request Time-?out|410 Gone|429 Too Many Requests|500 Internal Server Error|502 Bad Gateway|503 Service (?:Temporarily )?Unavailable|504 Gateway Time-?out)\b"
    r"|^(?:Not Found|Forbidden|Bad Gateway|Gateway Timeout|Service Unavailable|Internal Server Error|Too Many Requests|Gone|Access Denied)\W*$|\bError [45]\d\d\b|\bErreur [45]\d\d\b|Ошибка [45]\d\d|Fehler [45]\d\d|エラー[45]\d\d|错误代码[45]\d\d"
    r"|\bpage you (?:asked|were looking|requested)\b.*(?:n[o']t|moved)|\bpage (?:can(?:no|')t|could not) be (?:found|displayed)|Page introuvable|Seite wurde nicht gefunden|No se encontró la página|Страница не найдена|ページは見つかりません|页面不存在"
    r"|\b(?:enable|activate|allow|need|require|turn on)s? (?:JavaScript|scripting|scripts|cookies)\b|\bJavaScript (?:is|must be|to|pour|en tu|aktivieren)|включите JavaScript|aktivieren Sie JavaScript|Activa JavaScript|activer JavaScript|启用浏览器的脚本|<noscript"
    r"|\bscripts? (?:may be|are|turned|must be|to run)\b.{0,12}(?:blocked|disabled|off|switch)|\bscripts turned off|\bScripts and cookies must|\bneeds scripts to run"
    r"|\bsession has (?:expired|timed out)|\blog in again\b|\bdo not have permission\b|\bToo many requests\b|\bbrowser is secure\b|\bsomething went wrong\b|\bdown for (?:planned |scheduled )?maintenance|\bconnection failed: timeout|\bTraceback\b.{0,40}Error|\bdid not answer in time \(\d"
    r"|\b[45]\d\d\b.{0,12}\bThat['’]s an error\b|\brequested URL\b.*\bnot found\b|\bHTTP (?:ERROR|Error) [45]\d\d\b|\bsite can(?:no|['’])t be reached\b|\bverify (?:that )?you are (?:a )?human\b"
    r"|\b[Ll]orem ipsum\b|\bLorem [a-z]+ [a-z]+ [a-z]+|TODO: write",
    re.M,
)
#: What every phrase above holds at least one of; looked for first.
_HINT = re.compile(r"[Ss]cript|ookies|Not Found|Forbidden|Gateway|Unavailable|Internal|Requests|Gone|Denied|Unauthorized|Bad Request|Time-?out|Err[oe]|Ошибка|Fehler|エラー|错误|[Pp]age |Seite|página|Страница|ページ|页面|启用|session|log in|permission|requests|secure|wrong|maintenance|timeout|Traceback|answer|an error|requested URL|HTTP|reached|human|Lorem|lorem|TODO")
_TAG = re.compile(r"(?<!<)</?(?!noscript)[A-Za-z][^<>]*>(?!>)|''+")
_ESCAPED = re.compile(r"\\([_#%&{}$])")


def clean(text: str) -> str:
    """Entities, tags and escapes taken away, so that a placeholder has one shape in every notation."""
    for _ in range(2):
        if "&" not in text:
            break
        text = html.unescape(text)
    if "<" in text or "''" in text:
        text = _TAG.sub(" ", text)
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


#: A line that goes on: no mark at its end, and a small letter behind it.
_WRAPPED = re.compile(r"(?<=[^\s.!?:;。！？।>])[ \t]*\r?\n[ \t]*(?=[a-zß-öø-ÿа-я])")


def segments(text: str) -> list[str]:
    """Sentences and lines; a wrapped sentence is one."""
    return [s for x in _SPLIT.split(_WRAPPED.sub(" ", text)) if (s := x.strip())]


def placeholder(segment: str) -> bool:
    return any(not _BARE.match(m[0]) for m in _SHAPES.finditer(segment))


def weak(segment: str) -> bool:
    return bool(_HINT.search(segment) and _PHRASES.search(segment)) or (bool(_TRIGGER.search(segment)) and placeholder(segment))


class _Known(dict):
    """The hash of each token; runs with digits by their kind."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        kind = w
        if any(c.isdigit() for c in w):
            kind = "0num" if w.isdigit() else "0hex" if len(w) > 6 and all(c in "0123456789abcdef" for c in w) else re.sub(r"\d+", "0", w)
        h = 1469598103934665603
        for b in kind.encode("utf-8", "replace"):
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        self[w] = h
        return h


class Hasher:
    """Tokens and their n-grams as bucket numbers."""

    def __init__(self):
        self.known = _Known()

    def tokens(self, segment: str) -> list[int]:
        get = self.known.__getitem__
        if not _TRIGGER.search(segment):
            return list(map(get, _PLAIN.findall(segment.lower())))
        out, at = [], 0
        for m in _SHAPES.finditer(segment):
            out += map(get, _PLAIN.findall(segment[at : m.start()].lower()))
            out += [get("{bare}")] if _BARE.match(m[0]) else [get("{shape}"), get("{" + _KINDS[m.lastindex - 1])]
            at = m.end()
        return [*out, *map(get, _PLAIN.findall(segment[at:].lower()))]

    def features(self, rows: list[tuple[list[int], tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, owners): the tokens, pairs, triples and named features of all segments."""
        lengths = np.array([len(t) for t, _ in rows])
        flat = np.array([h for t, _ in rows for h in t], np.uint64)
        owner = np.repeat(np.arange(len(rows)), lengths)
        got, who = [flat], [owner]
        for n in (2, 3):
            if len(flat) >= n:
                x = flat[: len(flat) - n + 1].copy()
                for j in range(1, n):
                    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ flat[j : len(flat) - n + 1 + j]
                same = owner[: len(owner) - n + 1] == owner[n - 1 :]
                got.append(x[same] * np.uint64(n * 2 + 1))
                who.append(owner[: len(owner) - n + 1][same])
        got.append(np.array([self.known["\0" + name] for _, extra in rows for name in extra], np.uint64))
        who.append(np.repeat(np.arange(len(rows)), [len(e) for _, e in rows]))
        x = np.concatenate(got)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(who)


_SHAPED = _Known()["{shape}"]


def _extra(tokens: list[int], n_segments: int, title: str | None) -> tuple[str, ...]:
    n_tokens, shaped = len(tokens), ("shape", "shape of the segment") if _SHAPED in tokens else ()
    return (*shaped, "bias", f"len{min(12, n_tokens).bit_length()}", f"doc{min(64, n_segments).bit_length()}", "title" + ("0" if title is None else "1" if title.strip() else "b"))


def _scores(buckets: np.ndarray, owners: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(owners, weights[buckets], n)


def fit(buckets: np.ndarray, owners: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L2-regularised logistic regression by Adagrad on all segments at once; classes count alike."""
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    n = len(y)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(_scores(buckets, owners, n, weights), -30, 30)))
        g = np.bincount(buckets, (share * (p - y))[owners], BUCKETS) + L2 * weights
        seen += g * g
        weights -= 0.35 * g / np.sqrt(seen)
    return weights


def labelled(rows: list[tuple[str | None, str | None]], hasher: Hasher) -> list[tuple[bool, str, list[int], tuple[str, ...]]]:
    """(label, segment, token hashes, named features) of the segments of documents (title, text) that are labelled: those beside a positive one are not."""
    out = []
    for title, text in rows:
        segs = segments(clean(text or ""))
        flags = [weak(s) for s in segs]
        for s, f in zip(segs, flags, strict=True):
            if f or not any(flags):
                t = hasher.tokens(s)
                out.append((f, s, t, _extra(t, len(segs), title)))
    return out


def train_on(rows: list[tuple[bool, list[int], tuple[str, ...]]]) -> np.ndarray:
    """Weights from labelled segments; all zero where none is positive, or none negative."""
    y = np.array([f for f, _, _ in rows], bool)
    if not y.any() or y.all():
        return np.zeros(BUCKETS)
    return fit(*Hasher().features([(t, e) for _, t, e in rows]), y)


def train(rows: list[tuple[str | None, str | None]]) -> np.ndarray:
    """Weights from (title, text) of a few documents."""
    return train_on([(f, t, e) for f, _, t, e in labelled(rows, Hasher())])


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[bool, list[int], tuple[str, ...]]]:
    """Labelled segments of the ``size`` documents whose ids hash lowest: all as hashes, made on the executors; of either label at most ``NEGATIVES``, those whose words hash lowest.

    The same whatever the order of files; no text comes to the driver.
    """
    ids = docs.select("doc_id").where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches):
        hasher = Hasher()
        for b in batches:
            rows = labelled(list(zip(b.column("title").to_pylist(), b.column("text").to_pylist(), strict=True)), hasher)
            tokens = [np.array(t, np.uint64).view(np.int64) for _, _, t, _ in rows]
            place = [int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big") for _, s, _, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, *_ in rows], pa.bool_()), pa.array(place, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array([list(e) for *_, e in rows], pa.list_(pa.string()))], names=["label", "place", "tokens", "extra"])

    own = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("title", "text").mapInArrow(run, "label boolean, place bigint, tokens array<bigint>, extra array<string>")
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("place"))).where(F.col("_r") <= NEGATIVES)
    rows = first.orderBy("label", "place").select("label", "tokens", "extra").collect()
    return [(r["label"], np.array(r["tokens"], np.int64).view(np.uint64).tolist(), tuple(r["extra"])) for r in rows]


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (log-odds of the worst segment) and the characters of it, of every document with a text."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        hasher, w = Hasher(), shipped.value
        for b in batches:
            ids, titles, texts = (b.column(c) for c in ("doc_id", "title", "text"))
            for a in range(0, len(ids), 1000):
                rows, owner, segs_all = [], [], []
                for k, (title, text) in enumerate(zip(titles[a : a + 1000].to_pylist(), texts[a : a + 1000].to_pylist(), strict=True)):
                    segs = segments(clean(text)) if text else []
                    for s in segs:
                        t = hasher.tokens(s)
                        rows.append((t, _extra(t, len(segs), title)))
                        owner.append(k)
                        segs_all.append(s)
                if not rows:
                    continue
                s = _scores(*hasher.features(rows), len(rows), w)
                owner_ = np.array(owner)
                order = np.lexsort((-s, owner_))
                first = order[np.append(True, np.diff(owner_[order]) > 0)]
                yield pa.RecordBatch.from_arrays([ids[a : a + 1000].take(pa.array(owner_[first])), pa.array(s[first].astype(np.float64)), pa.array([segs_all[i] for i in first], pa.string())], names=["doc_id", "score", "segment"])

    return docs.select("doc_id", "title", "text").mapInArrow(run, f"doc_id {key}, score double, segment string")


def found(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The documents with residue."""
    return scored(docs, train_on(sample(docs, size))).where("score > 0").select("doc_id").distinct()


def validate(docs: DataFrame, size: int = SAMPLE, fold: int = 5) -> DataFrame:
    """Trained on the hosts (``source``) outside one fold: documents of the other hosts by weak label and prediction."""
    host = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(fold)) == 0
    weights = train_on(sample(docs.where(~host), size))

    @F.pandas_udf(BooleanType())  # type: ignore[call-overload]
    def label(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and any(weak(s) for s in segments(clean(t)))).astype(bool)

    unseen = docs.where(host)
    return scored(unseen, weights).join(unseen.select("doc_id", label("text").alias("label")), "doc_id").groupBy("label", (F.col("score") > 0).alias("predicted")).count()
