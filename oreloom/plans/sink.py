"""Sinks: a skill's folder written whole or not at all, and the registry file."""

from __future__ import annotations

import json
import shutil
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import document, upsert
from ..operators.validate import flat_bundle
from .skill_folders import SkillFolders


def install(temporary: Path, target: Path, overwrite: bool, tries: int = 5) -> None:
    """Move a finished folder into place; the old one comes back if that fails."""
    if target.exists() and not overwrite:
        raise FileExistsError(target)
    aside = target.with_name(f".{target.name}.{uuid.uuid4().hex[:8]}.old")
    if target.exists():
        target.rename(aside)
    for left in reversed(range(tries)):
        try:
            temporary.rename(target)
            break
        except OSError:
            if left:
                time.sleep(0.1)
                continue
            try:
                shutil.copytree(temporary, target)
                break
            except OSError:
                shutil.rmtree(target, ignore_errors=True)
                if aside.exists():
                    aside.rename(target)
                raise
    shutil.rmtree(aside, ignore_errors=True)
    shutil.rmtree(temporary, ignore_errors=True)


def write_skills(packages: DataFrame, output: str, overwrite: bool = False) -> None:
    """A folder for each package, on a file system that all executors see: all of them or none (``skill_folders``).

    Of packages with one skill_id the last in run order is written, as the registry has it.
    """
    last = F.struct(F.split("file_path", "/"), "start_byte", "ordinal")
    rows = packages.groupBy("skill_id").agg(F.max_by(F.struct("filename", "script_text", "skill_md"), last).alias("r")).select("skill_id", "r.*")
    rows = rows.where(flat_bundle(F.concat(F.lit("scripts/"), F.col("filename"))))
    rows.sparkSession.dataSource.register(SkillFolders)
    rows.write.format(SkillFolders.name()).option("replace", str(overwrite).lower()).mode("append").save(output)


def clean_legacy(output: str) -> list[str]:
    """Removes what the older layout left in an output folder: scripts, skills and skill_*; their names."""
    found = sorted(p for p in Path(output).glob("*") if p.is_dir() and not p.is_symlink() and (p.name in ("scripts", "skills") or p.name.startswith("skill_")))
    for folder in found:
        shutil.rmtree(folder)
    return [p.name for p in found]


def copy_skill(source: str, workspace: str) -> Path:
    """A skill's folder below the workspace's skills; caches stay behind, a copy that is there is kept."""
    target = Path(workspace) / "skills" / Path(source).name
    if not target.exists():
        temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex[:8]}.new")
        shutil.copytree(source, temporary, ignore=shutil.ignore_patterns("__pycache__", "*.pyc", ".pytest_cache"))
        install(temporary, target, overwrite=False)
    return target


def write_workspace_text(workspace: str, path: str, content: str) -> Path:
    """Writes a text file below the workspace's output or logs, nowhere else."""
    root = Path(workspace).resolve()
    target = (root / path).resolve()
    if not any(target.is_relative_to(root / name) and target != root / name for name in ("output", "logs")):
        raise ValueError("a workspace file must stay under output or logs")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content, encoding="utf-8")
    return target


def write_registry(new: DataFrame, output: str, existing: DataFrame | None = None) -> Path | None:
    """skills_registry.json of all entries; untouched if there is none."""
    merged = upsert(existing, new)
    text = document(merged, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).first()["json"]
    if not json.loads(text)["skills"]:
        return None
    path = Path(output) / "skills_registry.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_suffix(f".{uuid.uuid4().hex[:8]}.new")
    temporary.write_text(text + "\n", encoding="utf-8")
    temporary.replace(path)
    return path
