"""Sinks and run folders: guarded writes, stage markers, manifests, safe deletion."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table that must not exist yet; readers see it only when it is complete."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; a failed attempt adds nothing, because files count only once the job commits."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was committed (its success marker stands)."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def write_manifest(spark: SparkSession, folder: str, content: dict) -> None:
    """A small JSON with sorted keys beside the stages."""
    p, fs = _path(spark, folder.rstrip("/") + "/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(content, sort_keys=True, ensure_ascii=False).encode()))
    out.close()


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    path = folder.rstrip("/") + "/manifest.json"
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def same_inputs(spark: SparkSession, folder: str, content: dict) -> bool:
    """False for a fresh folder, True if the manifest is equal; a changed one is an error."""
    old = read_manifest(spark, folder)
    if old is None:
        return False
    if old != json.loads(json.dumps(content)):
        raise ValueError(f"inputs of {folder} changed; use another folder")
    return True


def delete(spark: SparkSession, root: str, name: str) -> None:
    """Delete one table under ``root``; a name that leads elsewhere is refused, an absent one ignored."""
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{name!r} is no name under {root}")
    p, fs = _path(spark, f"{root.rstrip('/')}/{name}")
    if fs.exists(p):
        fs.delete(p, True)
