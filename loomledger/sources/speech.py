"""Speech workers: a small protocol on the loopback with files handed over in a run's folder, its client, a server for any ``Speaker``, and the stand-ins.

GET /health gives {"ok", "model"}; POST /synthesize takes a request (``bench.check_request``), writes a WAV below the run's folder and gives {"out", "rate", "spans"}; POST /unload frees
the model. A worker serves one run's folder and refuses every path outside of it; a client refuses every host that is not this machine.
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np

from loomledger.operators.audio import bench, signal
from loomledger.sources.providers import MOST_BYTES, check_spans, post_json
from loomledger.sources.wav import decode, encode

WORD_SECS = 0.25


class ToneSpeaker:
    """The stand-in for a voice: tones, a quarter of a second a word, turns after each other."""

    model, rate = "tone", 24_000

    def synthesize(self, request: dict) -> tuple[np.ndarray, int, list[tuple[float, float]]]:
        parts = [signal.tone(t["speaker"], len(t["text"].split()), request["seed"], self.rate) for t in request["turns"]]
        ends = np.cumsum([len(p) for p in parts]) / self.rate
        return np.concatenate(parts), self.rate, list(zip(np.concatenate([[0.0], ends[:-1]]).tolist(), ends.tolist(), strict=True))

    def unload(self) -> None:
        pass


@dataclass
class ScriptedRecogniser:
    """The stand-in for a recogniser: what it was told is said, in segments that share the sound by their length."""

    said: list[str]

    def transcribe(self, samples: np.ndarray, rate: int) -> list[tuple[str, float, float]]:
        secs, total = len(samples) / rate, sum(map(len, self.said)) or 1
        out, at = [], 0.0
        for s in self.said:
            stop = at + secs * len(s) / total
            out.append((s, at, stop))
            at = stop
        check_segments(out, secs)
        return out


def check_segments(segments: list[tuple[str, float, float]], secs: float, slack: float = 0.02) -> None:
    """Of a transcript: finite, in order, none over another, within the sound."""
    check_spans(segments, [(a, z) for _, a, z in segments], secs, slack)


def inside(folder: Path, name: str) -> Path:
    """The file ``name`` below ``folder``; links and dots that lead out are refused."""
    p = (folder / name).resolve()
    if not p.is_relative_to(folder.resolve()) or p == folder.resolve():
        raise ValueError("out must stay below the run's folder")
    return p


@dataclass
class WorkerClient:
    """A speech worker on this machine, and the folder of the run that both see."""

    url: str
    folder: str

    def __post_init__(self):
        if (urlsplit(self.url).hostname or "") not in ("127.0.0.1", "localhost", "::1"):
            raise ValueError("a speech worker runs on this machine")

    def health(self) -> dict:
        import urllib.request

        with urllib.request.urlopen(f"{self.url}/health", timeout=10) as r:
            return json.loads(r.read(MOST_BYTES))

    def synthesize(self, request: dict) -> tuple[np.ndarray, int, list[tuple[float, float]]]:
        bench.check_request(request)
        reply = post_json(f"{self.url}/synthesize", request)
        if reply.get("out") != request["out"]:
            raise ValueError("the worker answers for another file")
        rate, samples = decode(inside(Path(self.folder), reply["out"]).read_bytes())
        spans = [tuple(s) for s in reply["spans"]]
        if rate != reply["rate"]:
            raise ValueError("the sound has another rate than the reply")
        check_spans(request["turns"], spans, len(samples) / rate)
        return samples, rate, spans

    def unload(self) -> None:
        post_json(f"{self.url}/unload", {})


def serve(speaker, folder: str, port: int = 0) -> ThreadingHTTPServer:
    """A worker on the loopback for one run's folder, in a thread of its own; close it by ``shutdown``. One request is synthesised at a time."""
    root, lock = Path(folder).resolve(strict=True), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a) -> None:
            pass

        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.reply(200, {"ok": True, "model": speaker.model}) if self.path == "/health" else self.reply(404, {"error": "no such path"})

        def do_POST(self) -> None:
            try:
                n = int(self.headers.get("Content-Length", 0))
                if not 0 <= n <= MOST_BYTES:
                    raise ValueError("a request of at most 4 MiB")
                body = json.loads(self.rfile.read(n) or b"{}")
                if self.path == "/unload":
                    speaker.unload()
                    return self.reply(200, {"ok": True})
                if self.path != "/synthesize":
                    return self.reply(404, {"error": "no such path"})
                target = inside(root, bench.check_request(body)["out"])
                with lock:
                    samples, rate, spans = speaker.synthesize(body)
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f".{target.name}.part")
                part.write_bytes(encode(rate, samples))
                part.replace(target)
                self.reply(200, {"out": body["out"], "rate": rate, "spans": spans})
            except (ValueError, KeyError, TypeError) as e:
                self.reply(400, {"error": str(e)[:500]})

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
