"""WAV files: 32-bit float and 8 to 32-bit integer in, any number of channels averaged; float or clipped 16-bit out."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples); anything that is not a readable WAV is a ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, raw = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("truncated format")
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE and len(body) >= 26:
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif name == b"data":
            if len(body) < size:
                raise ValueError("truncated sample data")
            raw = body
        at += 8 + size + size % 2
    if form is None or raw is None:
        raise ValueError("no format or no samples")
    kind, channels, rate, _, _, bits = form
    if kind == 3 and bits == 32:
        x = np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").astype(np.float32)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(raw[: len(raw) // (bits // 8) * (bits // 8)], f"<i{bits // 8}").astype(np.float32) / float(1 << (bits - 1))
    elif kind == 1 and bits == 24:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)
        wide = np.zeros((len(b), 4), np.uint8)
        wide[:, 1:] = b
        x = (wide.view("<i4").ravel() >> 8).astype(np.float32) / float(1 << 23)
    else:
        raise ValueError(f"format {kind} with {bits} bits")
    channels = max(1, channels)
    return rate, x if channels == 1 else x[: len(x) // channels * channels].reshape(-1, channels).mean(1).astype(np.float32)


def encode(rate: int, x: np.ndarray, float32: bool = True) -> bytes:
    """A mono WAV file; 16-bit samples past full scale are clipped."""
    body = np.asarray(x, "<f4").tobytes() if float32 else (np.clip(np.nan_to_num(x), -1, 1) * 32767).astype("<i2").tobytes()
    size = 4 if float32 else 2
    form = struct.pack("<HHIIHH", 3 if float32 else 1, 1, rate, rate * size, size, size * 8)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(form) + 8 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples and error of each .wav file below a folder; a file that cannot be read has its error and null samples."""

    def run(batches):
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    rate, x = decode(c)
                    out.append((p, rate, x.tolist(), None))
                except ValueError as e:
                    out.append((p, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "rate", "samples", "error"]).astype({"rate": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>, error string")


def compress(source: str, target: str, program: str = "ffmpeg") -> None:
    """A compressed copy by an external program, arguments only, under another name first."""
    import os
    import subprocess

    part = f"{target}.part{os.path.splitext(target)[1]}"
    subprocess.run([program, "-nostdin", "-y", "-loglevel", "error", "-i", source, part], check=True)
    os.replace(part, target)
