"""Settings of runs: experiment manifests, layered options, examples, calibrations, and the progress of a run.

The first four are small files that the driver reads; their values enter plans as literals. Progress is a table.
"""

from __future__ import annotations

import json
import tomllib
import warnings
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomtext.sources import progress

REQUIRED = ("name", "dataset", "detectors", "metrics", "slices")


@dataclass(frozen=True)
class Manifest:
    """An experiment: what is scored by what, how texts are changed, and how results are cut."""

    name: str
    dataset: str
    detectors: tuple
    metrics: tuple
    slices: tuple
    transforms: tuple = ()
    seed: int = 42


def read_manifest(path: str) -> Manifest:
    import yaml

    try:
        found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is no YAML: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    if lacking := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    changes = found.get("transforms") or []
    if not all(isinstance(t, dict) and {"operator", "intensities"} <= set(t) for t in changes):
        raise ValueError(f"{path}: each transform needs operator and intensities")
    changes = tuple({"operator": t["operator"], "intensities": [float(i) for i in t["intensities"]]} for t in changes)
    return Manifest(found["name"], found["dataset"], *[tuple(found[k]) for k in REQUIRED[2:]], changes, int(found.get("seed", 42)))


def write_manifest(manifest: Manifest, path: str) -> None:
    import yaml

    plain = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(manifest).items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(plain, sort_keys=False), encoding="utf-8")


def merged(base: dict, more: dict) -> dict:
    """base with the values of `more`: mappings merge, everything else is replaced."""
    both = lambda k: isinstance(base.get(k), dict) and isinstance(more[k], dict)
    return base | {k: merged(base[k], v) if both(k) else v for k, v in more.items()}


def typed(text: str):
    """A text as truth value, whole number, number or text, whichever fits first."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def layered(*layers: dict | str | None, overrides: dict[str, str] | None = None) -> dict:
    """Options from mappings or TOML files, later ones over earlier ones, then overrides by dotted names. Files that are missing count as empty."""
    out: dict = {}
    for layer in layers:
        if isinstance(layer, str):
            layer = tomllib.loads(Path(layer).read_text(encoding="utf-8")) if Path(layer).is_file() else {}
        out = merged(out, layer or {})
    for name, text in (overrides or {}).items():
        value = typed(text)
        for part in reversed(name.split(".")):
            value = {part: value}
        out = merged(out, value)
    return out


def read_examples(folder: str) -> dict[str, list[tuple[str, str]]]:
    """Pairs of input and output by domain, from one TOML file each. A bad file is left out with a warning."""
    found = {}
    for path in sorted(Path(folder).glob("*.toml")):
        try:
            found[path.stem] = [(p["input"], p["output"]) for p in tomllib.loads(path.read_text(encoding="utf-8")).get("pairs", [])]
        except (tomllib.TOMLDecodeError, KeyError, TypeError, UnicodeDecodeError) as e:
            warnings.warn(f"{path} is left out: {e}", stacklevel=2)
    return found


@dataclass(frozen=True)
class Calibration:
    """method is temperature_scaling, isotonic or slice_thresholds; see functions.signals.calibrated."""

    method: str
    version: str
    parameters: dict = field(default_factory=dict)


def read_calibration(path: str) -> Calibration:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return Calibration(found["method"], found["version"], found.get("parameters", {}))


def write_calibration(calibration: Calibration, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(calibration), indent=2), encoding="utf-8")


def save_progress(results: DataFrame, path: str, stage: str, batch: int | None = None) -> int:
    """Saves a stage's results (digest, chunk_id, ...) as the given or the next batch. Spark's commit keeps a broken write out of it."""
    return progress.save(results, path, stage, batch)


def load_progress(spark: SparkSession, path: str, docs: DataFrame, stage: str) -> DataFrame:
    """digest, chunk_id and result (JSON) of what was saved for documents that have not changed since: digests must be equal. The last batch wins."""
    return progress.load(spark, path, docs, stage)
