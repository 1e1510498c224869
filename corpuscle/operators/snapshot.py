"""Snapshot manifests of a corpus directory: files with checksums, statistics, one id over all of it."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle import __version__
from corpuscle.sources import files

#: Entries that don't count for the id.
VOLATILE = ("snapshot_id", "created_at", "warnings")


class SnapshotError(ValueError):
    """A manifest or its corpus isn't what it should be."""


def safe_path(path: str) -> bool:
    """Relative, without parents, drives, schemes, NUL and backslash."""
    return bool(path) and not any(c in path for c in ("\0", "\\", ":")) and not PurePosixPath(path).is_absolute() and ".." not in PurePosixPath(path).parts


def canonical(payload: dict) -> str:
    return json.dumps({k: v for k, v in payload.items() if k not in VOLATILE}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def identity(payload: dict) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def artifact(path: str) -> str:
    """The kind of a file by its place."""
    return "log" if path.endswith((".log", "_log.txt")) else "source" if path.startswith("raw/") else "derived" if path.startswith("parsed/") else "metadata"


def build(spark: SparkSession, root: str, statistics: DataFrame | None = None) -> dict:
    """The manifest of all files below ``root``. Checksums are taken where the files are read; one row per file comes back."""
    files.refuse_links(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = str(base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()).rstrip("/") + "/"
    rows = files.tree(spark, root).collect()
    entries = sorted(({"path": r["path"].split(prefix, 1)[1], "size": r["size"], "sha256": r["sha256"]} for r in rows), key=lambda e: e["path"])
    wrong = [e["path"] for e in entries if not safe_path(e["path"])]
    if wrong:
        raise SnapshotError(f"unsafe path: {wrong[0]!r}")
    payload = {"schema": 1, "software": {"package": "corpuscle", "version": __version__}, "files": [e | {"artifact": artifact(e["path"])} for e in entries], "statistics": statistics.collect()[0].asDict() if statistics is not None else {}}
    return payload | {"snapshot_id": identity(payload), "created_at": datetime.now(timezone.utc).isoformat()}


def parsing_mode(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """(mode, warnings) told by the parse log: ``abstract_only``, ``full_text``, ``mixed`` or ``unknown``."""
    place = Path(root) / "parsed" / "parse_log.txt"
    if not place.is_file():
        return "unknown", ["Parsing mode is unknown: parsed/parse_log.txt is missing."]
    lines = spark.read.text(str(place))
    told = lambda pattern: F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)))
    # The effective mode counts; a log without it is read by the older heading.
    found = lines.select(F.lit(0).alias("rank"), told(r"effective_mode\s*=\s*(abstract|full_text|pdf)").alias("m")).unionByName(lines.select(F.lit(1).alias("rank"), told(r"(?i)Mode\s*:\s*(abstract|pdf)").alias("m")))
    modes = {(r["rank"], r["mode"]) for r in found.select("rank", F.when(F.lower("m") == "abstract", "abstract_only").otherwise("full_text").alias("mode")).distinct().collect()}
    own = {m for rank, m in modes if rank == min((r for r, _ in modes), default=0)}
    if len(own) > 1:
        return "mixed", ["Parsing log records more than one parsing mode."]
    return (own.pop(), []) if own else ("unknown", ["Parsing mode is unknown from the available parsing log."])


def verify(spark: SparkSession, root: str, manifest: dict) -> list[str]:
    """What differs between a manifest and the files: wrong id, missing, added and changed files."""
    problems = [] if identity(manifest) == manifest.get("snapshot_id") else ["the id doesn't fit the manifest"]
    now = {e["path"]: (e["size"], e["sha256"]) for e in build(spark, root)["files"]}
    then = {e["path"]: (e["size"], e["sha256"]) for e in manifest["files"]}
    problems += [f"missing: {p}" for p in sorted(then.keys() - now.keys())] + [f"added: {p}" for p in sorted(now.keys() - then.keys())]
    return problems + [f"changed: {p}" for p in sorted(then.keys() & now.keys()) if then[p] != now[p]]


def write(manifest: dict, path: str, corpus: str) -> None:
    """Writes a manifest at once or not at all; never inside the corpus, over a link or over another file than a manifest."""
    target = Path(path)
    if target.is_symlink() or Path(corpus).resolve() in target.resolve().parents:
        raise SnapshotError(f"not a place for a manifest: {path}")
    if target.exists():
        try:
            if json.loads(target.read_text()).get("schema") != manifest["schema"]:
                raise SnapshotError(f"another schema: {path}")
        except (json.JSONDecodeError, AttributeError) as error:
            raise SnapshotError(f"no manifest: {path}") from error
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".manifest-")
    with os.fdopen(handle, "w") as out:
        out.write(json.dumps(manifest, sort_keys=True, indent=2, default=str))
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, target)
