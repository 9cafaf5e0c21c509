"""Settings from YAML or the environment, with defaults."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from terrafold.operators.training import TrainConfig


@dataclass(frozen=True)
class ExtractConfig:
    district_path: str = ""
    building_path: str = ""
    output_dir: str = "output"
    resolution: float = 1.0
    buffer: float = 10.0
    rounds: int = 30

    @classmethod
    def from_env(cls, prefix: str = "TERRAFOLD_") -> ExtractConfig:
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        return cls(**{k: t(os.environ[prefix + k.upper()]) for k, t in kinds.items() if prefix + k.upper() in os.environ})

    def checked(self) -> ExtractConfig:
        missing = [k for k in ("district_path", "building_path") if not getattr(self, k)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        if self.resolution <= 0 or self.buffer < 0 or self.rounds < 0:
            raise ValueError("resolution must be positive, buffer and rounds not negative")
        return self


#: Other names of settings in YAML files, and settings of the machine that have no meaning on a cluster.
NAMES = {
    "hidden_dim": "hidden", "num_heads": "heads", "num_layers": "layers", "num_classes": "classes", "lr": "rate", "smooth_temperature": "temperature",
    "num_neighbors": "fan_out", "gradient_accumulation_steps": "accumulation",
}
UNUSED = {"num_workers", "use_amp", "device", "enable_tensorboard", "log_interval", "train_ratio", "district_ids", "negative_slope", "add_self_loops"}


def train_config(path: str, **overrides) -> TrainConfig:
    """Settings of a YAML file (groups are flattened; unknown keys are reported)."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    flat = {k: v for group in raw.values() if isinstance(group, dict) for k, v in group.items()} | {k: v for k, v in raw.items() if not isinstance(v, dict)}
    known = {f.name for f in fields(TrainConfig)}
    flat = {NAMES.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in flat.items()}
    if unknown := sorted(set(flat) - known - UNUSED):
        logging.getLogger("terrafold").warning("settings without a meaning here: %s", ", ".join(unknown))
    return replace(TrainConfig(**{k: v for k, v in flat.items() if k in known}), **overrides)


def backup(config: object, path: str) -> bool:
    """A copy of the settings as JSON; a copy that can't be written only warns."""
    try:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(config), indent=1, default=str))
    except OSError as error:
        logging.getLogger("terrafold").warning("no copy of the settings: %s", error)
        return False
    return True
