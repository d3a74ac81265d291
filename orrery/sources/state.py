"""Small state kept between runs, and the configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import store

SCHEMAS = {"dims": "iid long, sizes array<int>", "not_found": "filename string", "pending": "pos long, iid long"}


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A state table; an empty one where none was saved yet."""
    held = store.read(spark, f"{path}/{name}", SCHEMAS[name])
    return spark.createDataFrame([], SCHEMAS[name]) if held is None else held


def save(df: DataFrame, path: str, name: str) -> None:
    """The new state, or after a crash still the old one."""
    store.put(df, f"{path}/{name}")


@dataclass
class Config:
    home: str = ""
    host: str = "127.0.0.1"
    port: int = 5678
    cache_limit: int | None = None
    first_time_pn_limit: int | None = None
    disable_select: bool = False
    worker_delay_secs: int = 0
    safe_mode: bool = False
    download_hook_url: str | None = None
    static_dir: str | None = None
    upscaler_path: str | None = None
    username: str | None = None

    def at(self, name: str) -> str:
        return str(Path(self.home) / name) if self.home else name


def read_config(path: str, environ: dict[str, str] | None = None) -> Config:
    """JSON over the defaults, and the environment (ORRERY_<NAME>) over both; unknown keys are ignored."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    environ = os.environ if environ is None else environ
    out = Config(**{f.name: given[f.name] for f in fields(Config) if given.get(f.name) is not None})
    for f in fields(Config):
        if (v := environ.get(f"ORRERY_{f.name.upper()}")) is not None:
            like = getattr(out, f.name)
            setattr(out, f.name, v.lower() in ("1", "true") if isinstance(like, bool) or f.type == "bool" else int(v) if "int" in str(f.type) else v)
    return out
