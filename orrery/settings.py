"""Settings from the environment and from a file of assignments; the environment goes first, and blank values are unset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    model: str | None = None
    base_url: str | None = None
    api_key: str | None = None
    rerank: bool = True
    fusion_constant: int = 60

    @property
    def model_configured(self) -> bool:
        """A key or an address of one's own is enough."""
        return bool(self.api_key or self.base_url)


def _assignments(path: str | None) -> dict[str, str]:
    if path is None or not Path(path).exists():
        return {}
    lines = (x.split("=", 1) for x in Path(path).read_text().splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in lines}


def settings(environment: Mapping[str, str] | None = None, file: str | None = None, prefix: str = "ORRERY_") -> Settings:
    both = [os.environ if environment is None else environment, _assignments(file)]
    get = lambda name: next((v.strip() for d in both if (v := d.get(prefix + name)) and v.strip()), None)
    return Settings(get("MODEL"), get("BASE_URL"), get("API_KEY"), (get("RERANK") or "1").lower() not in ("0", "false", "no"), int(get("FUSION_CONSTANT") or 60))
