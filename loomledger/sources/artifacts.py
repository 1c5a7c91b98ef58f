"""Sinks and caches: enveloped JSON artifacts, schemas, cached stages and content-addressed blobs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.config import SCHEMA_VERSION
from loomledger.sources.files import files_of

_KEY = re.compile(r"[0-9a-f]{64}")


def write_artifact(df: DataFrame, path: str, kind: str) -> None:
    """One JSON file with schema_version, kind and body. For artifacts a person reads: rows stream to the driver one by one, none are gathered."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    with part.open("w", encoding="utf-8") as f:
        f.write(f'{{\n  "schema_version": {SCHEMA_VERSION},\n  "kind": {json.dumps(kind)},\n  "body": [')
        for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
            f.write((",\n    " if i else "\n    ") + r["j"])
        f.write("\n  ]\n}\n")
    os.replace(part, target)


def read_artifact(path: str, kind: str) -> list:
    """The body of an artifact; another kind is an error."""
    whole = json.loads(Path(path).read_text(encoding="utf-8"))
    if whole.get("kind") != kind:
        raise ValueError(f"{path} holds {whole.get('kind')}, not {kind}")
    return whole["body"]


def write_schemas(frames: dict[str, DataFrame], folder: str) -> None:
    """<kind>.schema.json of each frame."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for kind, df in frames.items():
        (Path(folder) / f"{kind}.schema.json").write_text(json.dumps({"schema_version": SCHEMA_VERSION, "kind": kind, "row": json.loads(df.schema.json())}, indent=2) + "\n")


@dataclass
class StageCache:
    """Stage results as Parquet below a folder that all executors share, by a fingerprint of what went in.

    An entry without its success mark, of another schema version, or that cannot be read is a miss. A result is written under another name and renamed.
    """

    root: str
    records: list[tuple[str, str, bool, float]] = field(default_factory=list)

    def key(self, stage: str, version: int, inputs: list[str], config: object = None) -> str:
        text = json.dumps([SCHEMA_VERSION, stage, version, inputs, config], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def fingerprint(self, df: DataFrame) -> str:
        """Of a frame's schema and rows, whatever their order: an upstream run with equal output leaves what follows cached."""
        row = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns]) if df.columns else F.lit(0)
        other = F.crc32(F.concat_ws("\x1f", *[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in df.columns]))
        r = df.select(row.alias("a"), other.alias("b")).agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("a") % 1_000_003), F.sum("b")).first()
        return hashlib.sha256((df.schema.json() + repr(tuple(r))).encode()).hexdigest()

    @property
    def files(self):
        return files_of(self.root)

    def at(self, key: str) -> str:
        return f"{self.root.rstrip('/')}/{key[:2]}/{key}"

    def path(self, key: str) -> Path:
        """An entry's folder on a mounted file system."""
        return Path(self.at(key).removeprefix("file://"))

    def cached(self, stage: str, version: int, inputs: list[DataFrame], run: Callable[[], DataFrame], config: object = None, reusable: Callable[[DataFrame], bool] | None = None) -> DataFrame:
        began = perf_counter()
        key = self.key(stage, version, [self.fingerprint(d) for d in inputs], config)
        at, spark, files = self.at(key), inputs[0].sparkSession, self.files
        if files.exists(f"{at}/_SUCCESS"):
            try:
                df = spark.read.parquet(at)
                if reusable is None or reusable(df):
                    self.records.append((stage, key, True, perf_counter() - began))
                    return df
            except Exception:  # noqa: BLE001 - whatever cannot be read is a miss
                pass
        part = f"{self.root.rstrip('/')}/{key[:2]}/.{key}.{uuid.uuid4().hex}"
        run().write.parquet(part)
        files.write_text(f"{part}/_STAGE", stage)
        if files.exists(at):
            files.delete(at)
        files.rename(part, at)
        self.records.append((stage, key, False, perf_counter() - began))
        return spark.read.parquet(at)

    def entries(self) -> list[tuple[str, int]]:
        """(key, bytes) of everything shaped like an entry."""
        out = []
        for short in self.files.children(self.root):
            if len(short) == 2:
                for name in self.files.children(f"{self.root}/{short}"):
                    if _KEY.fullmatch(name) and name[:2] == short:
                        out.append((name, self.files.size(f"{self.root}/{short}/{name}")))
        return sorted(out)

    def stats(self) -> dict[str, object]:
        """Entries and bytes, of all and by kind: stages by their name, and blobs kept under the same root."""
        kinds: dict[str, list[int]] = {}
        for key, n in self.entries():
            note = f"{self.at(key)}/_STAGE"
            kinds.setdefault(self.files.read_text(note) if self.files.exists(note) else "stage", []).append(n)
        for short in self.files.children(self.root):
            for name in self.files.children(f"{self.root}/{short}") if len(short) == 2 else ():
                if name.endswith(".bin"):
                    kinds.setdefault("blob", []).append(self.files.size(f"{self.root}/{short}/{name}"))
        by = {k: {"entries": len(v), "bytes": sum(v)} for k, v in sorted(kinds.items())}
        return {"entries": sum(v["entries"] for v in by.values()), "bytes": sum(v["bytes"] for v in by.values()), "kinds": by}

    def clear(self) -> int:
        """Deletes only what is shaped like an entry; other files stay."""
        e = self.entries()
        for key, _ in e:
            self.files.delete(self.at(key))
        return len(e)


@dataclass
class BlobStore:
    """Bytes by their SHA-256. A damaged or missing blob is a miss, and putting it again repairs it."""

    root: str

    def _path(self, key: str) -> Path:
        if not _KEY.fullmatch(key):
            raise ValueError("not a key")
        return Path(self.root) / key[:2] / f"{key}.bin"

    def put(self, data: bytes) -> str:
        key = hashlib.sha256(data).hexdigest()
        if self.get(key) is None:
            p = self._path(key)
            p.parent.mkdir(parents=True, exist_ok=True)
            part = p.with_name(f".{uuid.uuid4().hex}")
            part.write_bytes(data)
            os.replace(part, p)
        return key

    def get(self, key: str) -> bytes | None:
        try:
            data = self._path(key).read_bytes()
        except FileNotFoundError:
            return None
        return data if hashlib.sha256(data).hexdigest() == key else None


def weights_digest(paths: list[str]) -> str:
    """SHA-256 over the sorted names, the sizes and the bytes of a model's weights, read piece by piece."""
    h = hashlib.sha256()
    for p in sorted(paths, key=os.path.basename):
        h.update(f"{os.path.basename(p)}\0{os.path.getsize(p)}\0".encode())
        with open(p, "rb") as f:
            while piece := f.read(1 << 20):
                h.update(piece)
    return h.hexdigest()


def file_fingerprint(paths: list[str]) -> str:
    """Of model files: each file's name, size and digest, then all of them."""
    rows = []
    for p in sorted(paths, key=os.path.basename):
        data = Path(p).read_bytes()
        rows.append(f"{os.path.basename(p)}\0{len(data)}\0{hashlib.sha256(data).hexdigest()}")
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()
