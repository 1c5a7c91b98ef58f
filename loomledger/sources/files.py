"""Files of caches and tables, on a mounted file system or on any that Hadoop knows by its scheme. Renames publish: a reader sees the old file or the new one."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path


def files_of(root: str) -> Local | Hadoop:
    scheme = str(root).split("://", 1)[0] if "://" in str(root) else "file"
    return Local() if scheme == "file" else Hadoop()


class Local:
    @staticmethod
    def _p(path: str) -> Path:
        return Path(str(path).removeprefix("file://"))

    def exists(self, path: str) -> bool:
        return self._p(path).exists()

    def read_text(self, path: str) -> str:
        return self._p(path).read_text(encoding="utf-8")

    def write_text(self, path: str, text: str) -> None:
        target = self._p(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        part.write_text(text, encoding="utf-8")
        os.replace(part, target)

    def rename(self, old: str, new: str) -> None:
        self._p(new).parent.mkdir(parents=True, exist_ok=True)
        self._p(old).rename(self._p(new))

    def delete(self, path: str) -> None:
        p = self._p(path)
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)

    def children(self, path: str) -> list[str]:
        p = self._p(path)
        return sorted(c.name for c in p.iterdir()) if p.is_dir() else []

    def size(self, path: str) -> int:
        p = self._p(path)
        return p.stat().st_size if p.is_file() else sum(f.stat().st_size for f in p.rglob("*") if f.is_file())


class Hadoop:
    """The same through the JVM of the running session."""

    def _at(self, path: str):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("a session is needed for files that are not local")
        p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, spark._jvm

    def exists(self, path: str) -> bool:
        fs, p, _ = self._at(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        fs, p, jvm = self._at(path)
        s = fs.open(p)
        try:
            return bytes(s.readAllBytes()).decode("utf-8")
        finally:
            s.close()

    def write_text(self, path: str, text: str) -> None:
        fs, p, jvm = self._at(path)
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        s = fs.create(part, True)
        try:
            s.write(bytearray(text.encode("utf-8")))
        finally:
            s.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(part, p)

    def rename(self, old: str, new: str) -> None:
        fs, p, jvm = self._at(old)
        target = jvm.org.apache.hadoop.fs.Path(str(new))
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"{old} cannot become {new}")

    def delete(self, path: str) -> None:
        fs, p, _ = self._at(path)
        fs.delete(p, True)

    def children(self, path: str) -> list[str]:
        fs, p, _ = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p, _ = self._at(path)
        return int(fs.getContentSummary(p).getLength())
