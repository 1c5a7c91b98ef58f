"""What stands behind a model: interfaces, their deterministic stand-ins, and the policy of calls over HTTP.

A part of a run that names a real provider is answered by it (``operators.models`` puts it into the plans); a part of kind ``fake`` by its stand-in, which is column expressions and no
provider at all. Real providers need a network or weights. They are made on the executors, one a task, from a factory that is shipped; a provider must survive pickling or be made there.
"""

from __future__ import annotations

import ipaddress
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol
from urllib.parse import urlsplit

TIMEOUT_S = 120
MOST_BYTES = 4 * 1024 * 1024
RETRIES = 2
TEXTS_A_REQUEST = 64


class Llm(Protocol):
    def complete(self, task: str, request: dict) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    """Entailment, neutrality and contradiction of (premise, hypothesis) pairs; three numbers a pair that sum to one."""

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]: ...


class Speaker(Protocol):
    """Speech of a chunk: samples, their rate, and a span of seconds for each turn."""

    def synthesize(self, request: dict) -> tuple[list[float], int, list[tuple[float, float]]]: ...


class Recogniser(Protocol):
    """Segments (text, start, stop) of what is heard in samples."""

    def transcribe(self, samples: list[float], rate: int) -> list[tuple[str, float, float]]: ...


def is_local(url: str) -> bool:
    """Whether a URL names this machine or a private network by its literal address; names other than localhost do not count."""
    host = urlsplit(url).hostname or ""
    if host == "localhost":
        return True
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return False
    return ip.is_loopback or ip.is_private


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a, **k):
        return None


def post_json(url: str, body: dict, key: str | None = None, hosted: bool = False, sleep: Callable[[float], None] = time.sleep, opener=None) -> dict:
    """A JSON reply of at most 4 MiB within 120 s; 429 and 5xx are tried twice more with doubling pauses, redirects are refused, the key never shows in an error.

    A URL that is not local is refused unless ``hosted`` says that the policy allows it.
    """
    if not hosted and not is_local(url):
        raise ValueError(f"{urlsplit(url).hostname} is hosted elsewhere; declare that to call it")
    opener = opener or urllib.request.build_opener(_NoRedirect)
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for attempt in range(RETRIES + 1):
        try:
            with opener.open(urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST"), timeout=TIMEOUT_S) as r:
                data = r.read(MOST_BYTES + 1)
            if len(data) > MOST_BYTES:
                raise ValueError("the reply is longer than 4 MiB")
            return json.loads(data)
        except urllib.error.HTTPError as e:
            if (e.code == 429 or e.code >= 500) and attempt < RETRIES:
                sleep(2.0**attempt)
                continue
            detail = e.read(500).decode("utf-8", "replace") if e.fp else ""
            raise RuntimeError(f"status {e.code}: {detail}".replace(key or "\0", "[key]")) from None
    raise AssertionError


@dataclass
class HttpLlm:
    """A chat endpoint in JSON mode; a reply that was cut off is an error."""

    url: str
    model: str
    key: str | None = None
    hosted: bool = False
    temperature: float | None = None
    max_tokens: int | None = None
    #: Where a local server is asked to free the model when a run no longer needs it.
    unload_root: str | None = None

    def complete(self, task: str, request: dict, stage_cap: int | None = None) -> str:
        cap = min((c for c in (self.max_tokens, stage_cap) if c is not None), default=None)
        body = {"model": self.model, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": task}, {"role": "user", "content": json.dumps(request)}]}
        if self.temperature is not None:
            body["temperature"] = self.temperature
        if cap is not None:
            body["max_tokens"] = cap
        choice = post_json(f"{self.url}/chat/completions", body, self.key, self.hosted)["choices"][0]
        if choice.get("finish_reason") == "length":
            raise RuntimeError("the reply was cut off")
        return choice["message"]["content"]

    def unload(self) -> None:
        if self.unload_root:
            post_json(f"{self.unload_root}/api/generate", {"model": self.model, "keep_alive": 0}, self.key, self.hosted)


@dataclass
class HttpEmbedder:
    """An embeddings endpoint, 64 texts a request; replies are put in order by their index."""

    url: str
    model: str
    key: str | None = None
    hosted: bool = False

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), TEXTS_A_REQUEST):
            reply = post_json(f"{self.url}/embeddings", {"model": self.model, "input": texts[a : a + TEXTS_A_REQUEST]}, self.key, self.hosted)
            out += [d["embedding"] for d in sorted(reply["data"], key=lambda d: d["index"])]
        check_vectors(texts, out)
        return out


def check_vectors(texts: list[str], vectors: list[list[float]]) -> None:
    """One vector a text, all of one length above zero, all finite."""
    import math

    if len(texts) != len(vectors):
        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    if vectors and (not vectors[0] or any(len(v) != len(vectors[0]) for v in vectors) or not all(math.isfinite(x) for v in vectors for x in v)):
        raise ValueError("vectors of no or different lengths, or not finite")


def validated(ask: Callable[[list[str]], str], parse: Callable[[str], object], attempts: int = 2) -> object:
    """The first reply that parses; every attempt sees the reasons against all before. A cut-off reply counts as rejected."""
    reasons: list[str] = []
    for _ in range(attempts):
        try:
            return parse(ask(list(reasons)))
        except (ValueError, RuntimeError, KeyError) as e:
            reasons.append(str(e)[:500])
    raise ValueError("; ".join(reasons))


PAIR_TOKENS, PAIR_BATCH = 512, 16


@dataclass
class OnnxPairScorer:
    """A cross-encoder from a folder of model.onnx, tokenizer.json and config.json; pairs in batches of 16, cut to 512 tokens, labels by the names in the config."""

    folder: str

    def __post_init__(self):
        self._open = None

    def _load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        names = json.loads((Path(self.folder) / "config.json").read_text())["id2label"]
        place = {str(v).lower(): int(k) for k, v in names.items()}
        if missing := {"entailment", "neutral", "contradiction"} - set(place):
            raise ValueError(f"the model has no label {', '.join(sorted(missing))}")
        words = Tokenizer.from_file(str(Path(self.folder) / "tokenizer.json"))
        words.enable_truncation(PAIR_TOKENS)
        words.enable_padding()
        return onnxruntime.InferenceSession(str(Path(self.folder) / "model.onnx")), words, [place[x] for x in ("entailment", "neutral", "contradiction")]

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        import numpy as np

        self._open = self._open or self._load()
        session, words, order = self._open
        wanted = {i.name for i in session.get_inputs()}
        out = []
        for a in range(0, len(pairs), PAIR_BATCH):
            e = words.encode_batch(pairs[a : a + PAIR_BATCH])
            given = {"input_ids": [x.ids for x in e], "attention_mask": [x.attention_mask for x in e], "token_type_ids": [x.type_ids for x in e]}
            logits = session.run(None, {k: np.array(v, np.int64) for k, v in given.items() if k in wanted})[0].astype(float)
            p = np.exp(logits - logits.max(1, keepdims=True))
            out += [tuple(r) for r in (p / p.sum(1, keepdims=True))[:, order].tolist()]
        check_scores(pairs, out)
        return out


def check_scores(pairs: list, scores: list) -> None:
    """Three finite numbers from 0 to 1 a pair."""
    import math

    if len(pairs) != len(scores) or any(len(s) != 3 or not all(math.isfinite(x) and -1e-6 <= x <= 1 + 1e-6 for x in s) for s in scores):
        raise ValueError("not three scores a pair")


def check_spans(turns: list, spans: list[tuple[float, float]], secs: float, slack: float = 0.02) -> None:
    """Of a speech reply: one span a turn, finite, in order, none over another, within the sound."""
    import math

    if len(turns) != len(spans):
        raise ValueError(f"{len(spans)} spans for {len(turns)} turns")
    at = 0.0
    for a, z in spans:
        if not (math.isfinite(a) and math.isfinite(z)) or a < at - 1e-9 or z < a or z > secs + slack:
            raise ValueError("spans that are not finite, out of order, over one another or beyond the sound")
        at = z


#: Providers by kind: what a run file may name, and what is made of it. A fake is None: the stand-in needs no provider.
FACTORIES: dict[str, dict[str, Callable[..., object]]] = {
    "llm": {"fake": lambda: None, "openai_compatible": HttpLlm}, "embedding": {"fake": lambda: None, "openai_compatible": HttpEmbedder}, "nli": {"fake": lambda: None, "cross_encoder": OnnxPairScorer},
}


def make(part: str, kind: str, **options):
    """The provider of a part; an unknown kind is an error that names the known ones, and so is an option that the kind has not."""
    known = FACTORIES.get(part, {})
    if kind not in known:
        raise ValueError(f"{part} has no kind {kind!r}; it has {', '.join(sorted(known)) or 'none'}")
    try:
        return known[kind](**options)
    except TypeError as e:
        raise ValueError(f"{part} of kind {kind}: {e}") from None
