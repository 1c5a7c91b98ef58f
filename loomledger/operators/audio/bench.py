"""Measures and checks around voices: turns packed for a comparison, cut from a recording, and requests to a speech worker."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Sequence

import numpy as np

from loomledger.sources.wav import decode


def pack_turns(secs: Sequence[float], limit: float, gap: float) -> list[list[int]]:
    """Whole turns, in order, with ``gap`` seconds between them, up to ``limit`` seconds a pack; a longer turn is a pack of its own."""
    packs: list[list[int]] = []
    used = 0.0
    for i, s in enumerate(secs):
        if packs and used + gap + s <= limit:
            packs[-1].append(i)
            used += gap + s
        else:
            packs.append([i])
            used = s
    return packs


def word_error_rate(reference: Sequence[str], heard: Sequence[str]) -> float:
    """Unrounded; an empty reference is 0, or 1 where something is heard."""
    from loomledger.operators.audio.verify import edit_distance

    return edit_distance(reference, heard) / len(reference) if reference else float(bool(heard))


def contains(heard: Sequence[str], needle: Sequence[str]) -> bool:
    """Whether the words are heard in a row; none are not."""
    n = len(needle)
    return n > 0 and any(list(heard[i : i + n]) == list(needle) for i in range(len(heard) - n + 1))


def turn_times(turns: Sequence[Sequence[str]], heard: Sequence[tuple[str, float, float]]) -> list[tuple[float, float] | None]:
    """The time of each turn's first to last matched word, by matching blocks; null where none matches."""
    flat = [(w, t) for t, ws in enumerate(turns) for w in ws]
    out: list[tuple[float, float] | None] = [None] * len(turns)
    for block in difflib.SequenceMatcher(None, [w for w, _ in flat], [w for w, _, _ in heard], autojunk=False).get_matching_blocks():
        for k in range(block.size):
            t = flat[block.a + k][1]
            _, a, z = heard[block.b + k]
            out[t] = (a, z) if out[t] is None else (min(out[t][0], a), max(out[t][1], z))
    return out


def cut(samples: np.ndarray, rate: int, spans: Sequence[tuple[float, float]]) -> list[np.ndarray]:
    """The samples of each span of seconds; spans beyond the ends are cut short."""
    return [samples[max(0, int(a * rate)) : max(0, int(z * rate))] for a, z in spans]


#: Fixed value: a stretch of speech shorter than this says too little about a voice.
LEAST_SECS = 1.0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two voices' vectors; 0 where one is zero."""
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def check_voices(cast: dict[str, str], read, provenance: dict[str, str] | None = None) -> None:
    """Every speaker's clip is there and a WAV; a generated one has the digest it was made under. ``read`` gives the bytes of a path."""
    for speaker, path in cast.items():
        try:
            data = read(path)
            decode(data)
        except (OSError, ValueError) as e:
            raise ValueError(f"voice of {speaker}: {e}") from None
        if provenance and path in provenance and hashlib.sha256(data).hexdigest() != provenance[path]:
            raise ValueError(f"voice of {speaker}: the clip is not the one that was generated")


#: The fields of a synthesis request and their kinds.
_REQUEST = {"chunk_id": str, "seed": int, "turns": list, "voices": dict, "out": str}


def check_request(body: object) -> dict:
    """A request to a speech worker, field by field; missing, unknown or wrong ones are named."""
    if not isinstance(body, dict):
        raise ValueError("a request is an object")
    if extra := sorted(set(body) - set(_REQUEST)):
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    for name, kind in _REQUEST.items():
        if name not in body:
            raise ValueError(f"missing field: {name}")
        if not isinstance(body[name], kind) or isinstance(body[name], bool):
            raise ValueError(f"{name} must be a {kind.__name__}")
    if not body["turns"] or any(not isinstance(t, dict) or not t.get("text") or t.get("speaker") not in body["voices"] for t in body["turns"]):
        raise ValueError("every turn needs a text and a speaker with a voice")
    if ".." in body["out"].split("/") or body["out"].startswith("/"):
        raise ValueError("out must stay below the run's folder")
    return body
