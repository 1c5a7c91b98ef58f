import io
import json
import urllib.error

import pytest

from loomledger.sources import artifacts, documents, files, providers


def test_local_files(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "b.md").write_text("\n# Title here \n\ntext")
    (root / "a+1 %.txt").write_text("no title")
    (root / "skip.csv").write_text("x")
    (root / "big.md").write_bytes(b"x" * 2000)
    (tmp_path / "outside.md").write_text("secret")
    (root / "link.md").symlink_to(tmp_path / "outside.md")
    (root / "dir.md").mkdir()
    df = documents.local_files(spark, str(root), "g", "src/", limit=1000)
    rows = {r.source.locator: r for r in df.collect()}
    assert set(rows) == {"src/b.md", "src/a+1 %.txt"} and rows["src/b.md"].title == "Title here" and rows["src/a+1 %.txt"].title == "a+1 %"
    assert rows["src/b.md"].source.independence_group == "g" and len(rows["src/b.md"].id) == 64
    assert documents.checked(df).count() == 2
    (root / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="not valid UTF-8"):
        documents.local_files(spark, str(root), "g").collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert documents.local_files(spark, str(empty), "g").count() == 0


def test_cache(spark, tmp_path):
    cache = artifacts.StageCache(str(tmp_path / "c"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    calls = []

    def run():
        calls.append(1)
        return df

    for d in (df, df.orderBy("t"), df.repartition(3)):
        assert cache.cached("s", 1, [d], run).count() == 2
    assert len(calls) == 1 and [h for _, _, h, _ in cache.records] == [False, True, True]
    cache.cached("s", 2, [df], run)
    cache.cached("s", 1, [df.limit(1)], run)
    assert len(calls) == 3 and cache.stats()["entries"] == 3 and cache.stats()["kinds"]["s"]["entries"] == 3
    (tmp_path / "c" / "keep.txt").write_text("x")
    key = cache.records[0][1]
    (cache.path(key) / "_SUCCESS").unlink()
    cache.cached("s", 1, [df], run)
    assert len(calls) == 4 and cache.clear() == 3 and (tmp_path / "c" / "keep.txt").exists()


def test_files_by_scheme(spark, tmp_path):
    for f, root in ((files.Local(), str(tmp_path / "a")), (files.Hadoop(), f"file://{tmp_path}/b")):
        assert not f.exists(f"{root}/x/y.txt")
        f.write_text(f"{root}/x/y.txt", "größer")
        f.write_text(f"{root}/x/y.txt", "größer!")
        f.rename(f"{root}/x/y.txt", f"{root}/z/w.txt")
        assert f.read_text(f"{root}/z/w.txt") == "größer!" and f.children(f"{root}/z") in (["w.txt"], [".w.txt.crc", "w.txt"]) and f.size(f"{root}/z") >= 9 and f.children(f"{root}/none") == []
        f.delete(f"{root}/z")
        assert not f.exists(f"{root}/z")
    assert isinstance(files.files_of("s3a://b/c"), files.Hadoop) and isinstance(files.files_of("/x"), files.Local) and isinstance(files.files_of("file:///x"), files.Local)


def test_settled_tables_are_swept(spark):
    from loomledger import tables

    df = tables.settle(spark.range(5).toDF("k"), "swept")
    assert df.count() == 5 and tables.sweep(spark) >= 1 and tables.sweep(spark) == 0


def test_blobs_and_artifacts(spark, tmp_path):
    store = artifacts.BlobStore(str(tmp_path))
    key = store.put(b"abc")
    assert store.get(key) == b"abc" and store.get("0" * 64) is None
    store._path(key).write_bytes(b"damaged")
    assert store.get(key) is None and store.put(b"abc") == key and store.get(key) == b"abc"
    with pytest.raises(ValueError):
        store.get("../etc")
    artifacts.write_artifact(spark.createDataFrame([(1, "ß")], "k long, t string"), str(tmp_path / "x.json"), "things")
    assert artifacts.read_artifact(str(tmp_path / "x.json"), "things") == [{"k": 1, "t": "ß"}]
    with pytest.raises(ValueError):
        artifacts.read_artifact(str(tmp_path / "x.json"), "others")
    assert json.loads((tmp_path / "x.json").read_text())["schema_version"] == 10


class Opener:
    def __init__(self, *replies):
        self.replies, self.calls = list(replies), 0

    def open(self, request, timeout):
        self.calls += 1
        r = self.replies.pop(0)
        if isinstance(r, int):
            raise urllib.error.HTTPError(request.full_url, r, "", {}, io.BytesIO(b"key-123 is wrong"))
        return io.BytesIO(r)


def test_http_policy():
    pauses = []
    o = Opener(429, 503, b'{"a": 1}')
    assert providers.post_json("http://127.0.0.1/x", {}, "key-123", sleep=pauses.append, opener=o) == {"a": 1} and pauses == [1.0, 2.0]
    with pytest.raises(RuntimeError, match=r"status 400: \[key\] is wrong"):
        providers.post_json("http://localhost/x", {}, "key-123", opener=Opener(400))
    with pytest.raises(RuntimeError):
        providers.post_json("http://localhost/x", {}, sleep=pauses.append, opener=Opener(500, 500, 500))
    with pytest.raises(ValueError, match="hosted elsewhere"):
        providers.post_json("https://api.example/x", {})
    with pytest.raises(ValueError, match="4 MiB"):
        providers.post_json("http://localhost/x", {}, opener=Opener(b"x" * (providers.MOST_BYTES + 1)))
    assert providers.is_local("http://10.0.0.1:8") and providers.is_local("http://[::1]/") and not providers.is_local("http://8.8.8.8")


def test_provider_checks():
    providers.check_vectors(["a"], [[1.0]])
    for bad in ([], [[]], [[float("nan")]]):
        with pytest.raises(ValueError):
            providers.check_vectors(["a"], bad)
    seen = []

    def ask(reasons):
        seen.append(reasons)
        return "no" if len(seen) < 2 else "3"

    assert providers.validated(ask, int) == 3 and seen[1] and "no" in seen[1][0]
    with pytest.raises(ValueError, match="has no kind"):
        providers.make("llm", "other")
