"""Configuration: frozen dataclasses, presets, and readers and writers of JSON and INI files."""

from __future__ import annotations

import configparser
import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Image extensions of the retriever's scan.
IMAGE_FORMATS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")
METRICS = ("cosine", "dot_product", "euclidean", "manhattan")


@dataclass(frozen=True)
class RetrievalConfig:
    """Options of a search. on_long_text: skip (the row stays, without matches) or truncate (at a word)."""

    model_name: str = "ViT-B/32"
    model_type: str = "clip"
    blip_model_name: str | None = None
    device: str | None = None
    supported_formats: tuple[str, ...] = IMAGE_FORMATS
    auto_remove_duplicates: bool = True
    save_metadata: bool = True
    similarity_metric: str = "cosine"
    normalize_features: bool = True
    similarity_params: dict[str, Any] = field(default_factory=dict)
    default_top_k: int = 5
    min_similarity_threshold: float = 0.0
    batch_size: int = 1
    use_tqdm: bool = True
    verbose: bool = True
    save_search_history: bool = False
    output_format: str = "detailed"
    on_long_text: str = "skip"

    def __post_init__(self):
        if self.similarity_metric not in METRICS:
            raise ValueError(f"unknown similarity metric: {self.similarity_metric}")
        if self.on_long_text not in ("skip", "truncate"):
            raise ValueError(f"unknown policy for long texts: {self.on_long_text}")

    @property
    def max_chars(self) -> int:
        """The longest text that the encoder takes whole."""
        return 300 if self.model_type == "clip" else 2000


#: The six presets.
PRESETS = {
    "default": RetrievalConfig(),
    "vpr": RetrievalConfig(default_top_k=10, min_similarity_threshold=0.1),
    "fast": RetrievalConfig(similarity_metric="dot_product", normalize_features=False, batch_size=4, verbose=False, use_tqdm=False),
    "high_accuracy": RetrievalConfig(model_name="ViT-L/14", default_top_k=20, min_similarity_threshold=0.05),
    "blip": RetrievalConfig(model_type="blip", blip_model_name="Salesforce/blip-image-captioning-base", default_top_k=10, min_similarity_threshold=0.1),
    "blip_large": RetrievalConfig(model_type="blip", blip_model_name="Salesforce/blip-image-captioning-large", default_top_k=15, min_similarity_threshold=0.05),
}


@dataclass(frozen=True)
class RecallConfig:
    positive_dist_threshold: float = 25.0
    recall_values: tuple[int, ...] = (1, 5, 10, 20)
    use_labels: bool = True
    num_preds_to_save: int = 0
    save_only_wrong_preds: bool = False


@dataclass(frozen=True)
class PlaceConfig:
    """Metres of a cell, degrees of a heading bin, and how many cells and bins apart a group's classes are."""

    m: int = 10
    alpha: int = 30
    n: int = 5
    l: int = 2  # noqa: E741
    min_images_per_class: int = 10

    def cache_name(self) -> str:
        """Where a partition by these parameters is kept."""
        return f"places_M{self.m}_N{self.n}_alpha{self.alpha}_L{self.l}_mipc{self.min_images_per_class}"


@dataclass(frozen=True)
class GeoConfig:
    reference_path: str = ""
    query_path: str = ""
    output_path: str = "results.csv"
    top_k: int = 5
    utm_pattern: str = r"@(\d+\.?\d*)@(\d+\.?\d*)@.*\.jpg"
    debug: bool = False
    debug_n: int = 5
    debug_k: int = 3


def load_json(path: str, base: RetrievalConfig = RetrievalConfig()) -> RetrievalConfig:
    """base with the fields of a JSON file."""
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    if "supported_formats" in values:
        values["supported_formats"] = tuple(values["supported_formats"])
    return dataclasses.replace(base, **values)


def save_json(config, path: str) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(config), indent=2), encoding="utf-8")


def load_ini(path: str, section: str = "analyzer") -> GeoConfig:
    """Values may be quoted; unknown keys are refused."""
    parser = configparser.ConfigParser(interpolation=None)
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    kinds = {f.name: f.type for f in dataclasses.fields(GeoConfig)}
    out: dict[str, Any] = {}
    for key, value in parser[section].items():
        if key not in kinds:
            raise KeyError(key)
        value = value.strip("\"'")
        out[key] = {"int": int, "bool": lambda v: v.lower() in ("1", "true", "yes", "on")}.get(kinds[key], str)(value)
    return GeoConfig(**out)


def save_ini(config: GeoConfig, path: str, section: str = "analyzer") -> None:
    parser = configparser.ConfigParser(interpolation=None)
    parser[section] = {k: str(v) for k, v in dataclasses.asdict(config).items()}
    with open(path, "w", encoding="utf-8") as f:
        parser.write(f)


def load_yaml(path: str, base: RetrievalConfig = RetrievalConfig()) -> RetrievalConfig:
    """base with the fields of a YAML file; needs the yaml package."""
    import yaml

    values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if "supported_formats" in values:
        values["supported_formats"] = tuple(values["supported_formats"])
    return dataclasses.replace(base, **values)


def save_yaml(config, path: str) -> None:
    """The fields of a configuration as YAML; needs the yaml package."""
    import yaml

    values = {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(config).items()}
    Path(path).write_text(yaml.safe_dump(values, sort_keys=False, allow_unicode=True), encoding="utf-8")


def resolve(preset: str | None = None, file: str | None = None, **overrides: Any) -> RetrievalConfig:
    """A preset before a file before the defaults; overrides that are not None win."""
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    if preset is not None:
        base = PRESETS[preset]
    elif file is not None:
        base = load_yaml(file) if file.endswith((".yaml", ".yml")) else load_json(file)
    else:
        base = RetrievalConfig()
    return dataclasses.replace(base, **{k: v for k, v in overrides.items() if v is not None})
