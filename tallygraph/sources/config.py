"""Settings of an experiment: three files merged by section, checked, and the names and folders that follow from them."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.sql import SparkSession

#: Sections that each file must have, and the intensities of a dataset that names none; fixed values.
NEEDED = {"base": ("paths", "evaluation"), "model": ("model", "training", "loss"), "dataset": ("dataset",)}
INTENSITIES = ("low", "medium", "high")


class Settings(NamedTuple):
    """base, model and dataset sections, the intensity or None, and what follows: names and folders."""

    base: dict[str, Any]
    model: dict[str, Any]
    dataset: dict[str, Any]
    intensity: str | None
    dataset_name: str
    experiment: str
    folders: dict[str, str]


def read_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """One small YAML or JSON file, from any store that Spark reads; an empty file has no sections."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} should be one file")
    if path.endswith(".json"):
        return json.loads(rows[0][0])
    try:
        import yaml
    except ImportError as e:
        raise ImportError(f"{path} is YAML, which needs a package that is not installed; write it as JSON") from e
    return yaml.safe_load(rows[0][0]) or {}


def check_intensity(dataset: dict[str, Any], intensity: str | None) -> None:
    """An error if the dataset needs an intensity and none is given, or does not have the one given."""
    own = dataset["dataset"]
    allowed = own.get("available_intensities", list(INTENSITIES))
    if intensity is None and own.get("requires_intensity", True):
        raise ValueError(f"dataset {own['theory']} needs an intensity of {allowed}")
    if intensity and intensity not in allowed:
        raise ValueError(f"intensity {intensity} is not one of {allowed}")


def dataset_name(dataset: dict[str, Any], intensity: str | None) -> str:
    """The prefix, with the intensity unless the dataset is a baseline."""
    own = dataset["dataset"]
    return own["prefix"] if own["theory"].lower() == "baseline" else f"{own['prefix']}_{intensity}"


def merge(base: dict[str, Any], model: dict[str, Any], dataset: dict[str, Any], intensity: str | None = None, root: str = ".") -> Settings:
    """Checked settings. Folders lie below paths.root of base, or ``root`` where that is empty; models of events with
    attention have graph and split folders of their own."""
    for name, sections in zip(NEEDED, (base, model, dataset)):
        for key in NEEDED[name]:
            if key not in sections:
                raise ValueError(f"the {name} settings have no section {key}")
    check_intensity(dataset, intensity)
    own, paths = base.get("experiment", {}), base["paths"]
    data = dataset_name(dataset, intensity)
    experiment = f"seed{own.get('seed', 42)}_{own.get('name', 'exp')}"
    model_name = model["model"]["name"].lower().replace(" ", "_")
    kind = "tgat_" if "tgat" in model_name else ""
    top = (paths.get("root") or root).rstrip("/")
    folders = {name: f"{top}/{paths[f'{kind}{name}s_dir']}/{data}" for name in ("graph", "split")}
    folders |= {name: f"{top}/{paths[f'{name}_dir']}/{data}/{experiment}/{model_name}" for name in ("results", "logs")}
    return Settings(base, model, dataset, intensity, data, experiment, folders)


def load(spark: SparkSession, model_path: str, dataset_path: str, base_path: str, intensity: str | None = None, root: str = ".") -> Settings:
    return merge(*(read_settings(spark, p) for p in (base_path, model_path, dataset_path)), intensity, root)


def save(spark: SparkSession, settings: Settings, path: str | None = None, **more: object) -> str:
    """The settings as one JSON line in the results folder."""
    path = path or f"{settings.folders['results']}/experiment_config"
    spark.createDataFrame([(json.dumps({**settings._asdict(), **more}),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
