"""Typed settings: defaults, then the user's TOML, the repository's TOML (or JSON), then environment variables WEFTLINE_SECTION__KEY."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class UserSettings:
    name: str = ""
    email: str = ""


@dataclass
class CoreSettings:
    threshold: float = 0.98
    magnitude_tolerance: float = 0.1
    delta_kind: str = "xor_float32"
    near_dedup: bool = True
    default_branch: str = "main"


@dataclass
class DeltaSettings:
    least_bytes: int = 512
    least_ratio: float = 0.0
    sparse_threshold: float = 1e-6
    strict: bool = False


@dataclass
class StorageSettings:
    compression: str = "zstd"
    mode: str = "a"


@dataclass
class IndexSettings:
    bits: int = 64
    tables: int = 4
    seed: int = 42


@dataclass
class CheckpointSettings:
    every_steps: int = 50
    every_epochs: int = 5
    keep_last: int = 3
    keep_best: int = 2
    patience: int = 5


@dataclass
class LoggingSettings:
    level: str = "WARN"


@dataclass
class Settings:
    user: UserSettings = field(default_factory=UserSettings)
    core: CoreSettings = field(default_factory=CoreSettings)
    delta: DeltaSettings = field(default_factory=DeltaSettings)
    storage: StorageSettings = field(default_factory=StorageSettings)
    index: IndexSettings = field(default_factory=IndexSettings)
    checkpoint: CheckpointSettings = field(default_factory=CheckpointSettings)
    logging: LoggingSettings = field(default_factory=LoggingSettings)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """Unknown sections and keys raise."""
        out = cls()
        for section, items in values.items():
            for key, value in items.items():
                set_nested(out, f"{section}.{key}", value)
        return out


_RANGES = {
    "core.threshold": (0.0, 1.0), "core.magnitude_tolerance": (0.0, 1.0), "delta.least_bytes": (0, None), "delta.least_ratio": (None, 1.0), "delta.sparse_threshold": (0.0, None),
    "index.bits": (1, 4096), "index.tables": (1, 64), "checkpoint.every_steps": (1, None), "checkpoint.every_epochs": (1, None), "checkpoint.keep_last": (0, None), "checkpoint.keep_best": (0, None), "checkpoint.patience": (1, None),
}
_CHOICES = {
    "core.delta_kind": ("raw", "int8", "int16", "sparse", "compressed", "xor_float32", "xor_bfloat16", "exponent_mantissa", "per_axis"),
    "storage.compression": ("zstd", "gzip", "snappy", "lz4", "none"),
    "storage.mode": ("r", "a", "w"),
    "logging.level": ("DEBUG", "INFO", "WARN", "ERROR"),
}


def get_nested(settings: Settings, path: str):
    at = settings
    for part in path.split("."):
        if not (is_dataclass(at) and part in {f.name for f in fields(at)}):
            raise KeyError(path)
        at = getattr(at, part)
    return at


def set_nested(settings: Settings, path: str, value) -> None:
    """Sets one value; texts become numbers or booleans where the default is one."""
    old = get_nested(settings, path)
    if is_dataclass(old):
        raise KeyError(f"{path} is a section")
    section, _, key = path.rpartition(".")
    setattr(get_nested(settings, section), key, _like(old, value))


def _like(old, value):
    if isinstance(old, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(old, (int, float)) and not isinstance(value, bool):
        return type(old)(value)
    return value


def check_value(path: str, value) -> str | None:
    """What is wrong with a value, or None."""
    low, high = _RANGES.get(path, (None, None))
    if low is not None and value < low or high is not None and value > high:
        return f"{path} must be between {low} and {high}, not {value}"
    if path in _CHOICES and value not in _CHOICES[path]:
        return f"{path} must be one of {', '.join(_CHOICES[path])}, not {value}"
    return None


def validate(settings: Settings) -> tuple[list[str], list[str]]:
    """Errors and warnings."""
    errors = [e for s in fields(settings) for f in fields(getattr(settings, s.name)) if (e := check_value(f"{s.name}.{f.name}", getattr(getattr(settings, s.name), f.name)))]
    warnings = []
    if not settings.user.name:
        warnings.append("user.name isn't set; commits have no author")
    if settings.index.bits % settings.index.tables:
        warnings.append("index.bits isn't a multiple of index.tables; the last bits are in no table")
    if settings.core.threshold < 0.9:
        warnings.append("core.threshold below 0.9 takes rather different tensors for near copies")
    return errors, warnings


def merged(base: dict, over: dict) -> dict:
    """Recursive merge; `over` wins."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _file(path: Path | None) -> dict:
    if path is None or not path.exists():
        return {}
    return json.loads(path.read_text()) if path.suffix == ".json" else tomllib.loads(path.read_text())


def _environment(environ) -> dict:
    out: dict = {}
    for name, value in environ.items():
        if name.startswith("WEFTLINE_") and "__" in name:
            section, _, key = name[len("WEFTLINE_") :].lower().partition("__")
            out.setdefault(section, {})[key] = value
    return out


def load(repository: str | None = None, user: str | None = None, environ=os.environ) -> Settings:
    """The settings that hold for a repository; invalid ones raise ValueError."""
    values = _file(Path(user) if user else Path.home() / ".config" / "weftline" / "config.toml")
    if repository is not None:
        folder = Path(repository)
        values = merged(values, _file(folder / "config.toml") or _file(folder / "config.json"))
    out = Settings.from_dict(merged(values, _environment(environ)))
    errors, _ = validate(out)
    if errors:
        raise ValueError("; ".join(errors))
    return out


def save(settings: Settings, path: str) -> None:
    """Writes all values as TOML."""
    text = lambda v: json.dumps(v) if isinstance(v, (str, bool)) else repr(v)
    lines = []
    for section, items in settings.to_dict().items():
        lines += [f"[{section}]", *(f"{k} = {text(v)}" for k, v in items.items()), ""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines))
