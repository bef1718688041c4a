"""Settings of the record pipeline: typed keys, a file that holds them in a section of its own, and their checks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

SECTION = "tracemill"


@dataclass(frozen=True)
class Key:
    kind: str
    default: str | int | bool
    choices: tuple[str, ...] = ()
    least: int | None = None

    def problem(self, value: str) -> str | None:
        """Why a value can't be set, or None."""
        if self.kind == "choice" and value not in self.choices:
            return f"one of {', '.join(self.choices)}"
        if self.kind == "int":
            if not value.lstrip("-").isdigit():
                return "an integer"
            if self.least is not None and int(value) < self.least:
                return f"at least {self.least}"
        if self.kind == "bool" and value.lower() not in ("true", "false"):
            return "true or false"
        return None


# Fixed values of the format: names, choices and defaults of settings.
KEYS = {
    "contribution_mode": Key("choice", "ad-hoc", ("ad-hoc", "continuous")),
    "min_quality_tier": Key("choice", "silver", ("gold", "silver", "bronze")),
    "consent_level": Key("choice", "full", ("anonymous", "trajectory_only", "metadata_only", "full")),
    "auto_submit_interval": Key("int", 0, least=0),
    "auto_submit": Key("bool", False),
    "llm_pii_scrub": Key("bool", True),
    "scrub_strictness": Key("choice", "high", ("low", "medium", "high")),
    "dataset_repo": Key("string", "owner/dataset"),
}


class Settings:
    """Settings in a JSON file (which YAML readers read too). Other sections of the file stay as they are."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _read(self) -> dict:
        try:
            found = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def _section(self) -> dict:
        own = self._read().get(SECTION, {})
        return own if isinstance(own, dict) else {}

    def get(self, key: str) -> str:
        """The value as text; the default where the file lacks it or can't be read."""
        if key not in KEYS:
            raise KeyError(f"unknown setting {key}; there are {', '.join(KEYS)}")
        return str(self._section().get(key, KEYS[key].default))

    def set(self, key: str, value: str) -> None:
        """true and false are kept as such, digits as a number, else text."""
        if key not in KEYS:
            raise KeyError(f"unknown setting {key}; there are {', '.join(KEYS)}")
        if (wrong := KEYS[key].problem(value)) is not None:
            raise ValueError(f"{key} must be {wrong}, not {value}")
        kept: str | int | bool = value
        if value.lower() in ("true", "false"):
            kept = value.lower() == "true"
        elif value.lstrip("-").isdigit():
            kept = int(value)
        whole = self._read()
        whole[SECTION] = self._section() | {key: kept}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(whole, indent=2), encoding="utf-8")

    def show(self) -> list[tuple[str, str, str]]:
        """(setting, value, where it comes from) of all settings."""
        own = self._section()
        return [(k, str(own.get(k, key.default)), "config" if k in own else "default") for k, key in KEYS.items()]
