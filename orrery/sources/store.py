"""Named tables with a manifest, and archives of them."""

from __future__ import annotations

import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ESSENTIAL, STRUCTURE, DRAWING = {".parquet", ".json", ".crc"}, {".pdb", ".gz"}, {".png", ".svg", ".pdf", ".html", ".pml"}


def save(tables: dict[str, DataFrame], path: str, notes: dict | None = None) -> None:
    """Each table as Parquet, and a manifest of their schemas as a JSON text table (any store that Spark writes)."""
    if not tables:
        raise ValueError("nothing to save")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = {"tables": {n: df.schema.jsonValue() for n, df in tables.items()}, "notes": notes or {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/_manifest").collect()))
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}, manifest["notes"]


def wanted(path: Path, drawings: bool = False, structures: bool = True) -> bool:
    end = path.suffix.lower()
    if end in DRAWING:
        return drawings
    if end in STRUCTURE:
        return structures or end == ".gz" and ".pdb" not in path.name
    return end in ESSENTIAL or "_manifest" in str(path) or path.name == "_SUCCESS"


def archive(folder: str, target: str, compression: str = "xz", drawings: bool = False, structures: bool = True) -> str:
    """A tar file (xz, bz2 or gz) of a saved local folder."""
    if compression not in ("xz", "bz2", "gz"):
        raise ValueError(f"unknown compression {compression!r}")
    root = Path(folder)
    with tarfile.open(target, f"w:{compression}") as tar:
        for f in sorted(p for p in root.rglob("*") if p.is_file() and wanted(p, drawings, structures)):
            tar.add(f, f.relative_to(root).as_posix())
    return target


def extract(source: str, folder: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    with tarfile.open(source) as tar:
        tar.extractall(folder, filter="data")
    return folder
