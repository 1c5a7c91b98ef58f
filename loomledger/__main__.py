"""python -m loomledger run FILE --out FOLDER [--cache FOLDER] | schemas FOLDER | cache FOLDER [--clear]"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="loomledger")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("file")
    r.add_argument("--out", required=True)
    r.add_argument("--cache", default=".loomledger-cache")
    s = sub.add_parser("schemas")
    s.add_argument("folder")
    c = sub.add_parser("cache")
    c.add_argument("folder")
    c.add_argument("--clear", action="store_true")
    a = top.parse_args(argv)
    if a.command == "cache":
        from loomledger.sources.artifacts import StageCache

        cache = StageCache(a.folder)
        print(json.dumps({"removed": cache.clear()} if a.clear else cache.stats()))
        return 0
    if a.command == "schemas":
        from loomledger.schemas import ARTIFACTS

        Path(a.folder).mkdir(parents=True, exist_ok=True)
        for kind, row in ARTIFACTS.items():
            (Path(a.folder) / f"{kind}.schema.json").write_text(json.dumps({"kind": kind, "row": row}, indent=2) + "\n")
        return 0
    try:
        from loomledger.plans import pipeline

        spec = pipeline.read_spec(a.file)
        from pyspark.sql import SparkSession

        result = pipeline.run(SparkSession.builder.appName("loomledger").getOrCreate(), spec, a.cache)
        pipeline.write(result, a.out)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for stage, key, hit, secs in result.cache.records:
        print(f"{stage:16} {'hit ' if hit else 'miss'} {secs:7.2f} s  {key[:12]}")
    return 1 if result.failed else 0


if __name__ == "__main__":
    sys.exit(main())
