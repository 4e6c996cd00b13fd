"""SRC17. A repository's own settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from tiergraph.errors import ConfigError

BACKENDS = ("local", "llama-server", "generic")


@dataclass(frozen=True)
class RepoConfig:
    """subsystems: folder to name, over what is detected; exclude: paths left out; the rest as named."""

    subsystems: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    module_depth: int | None = None
    languages: list[str] = field(default_factory=list)
    dependency_map: dict[str, str] = field(default_factory=dict)
    preserve_function_entities: bool = True
    summarize: bool | None = None
    summarizer_backend: str | None = None
    summarizer_model: str | None = None
    summarizer_input_char_budget: int | None = None
    identity: str | None = None


def parse(text: str) -> RepoConfig:
    """From YAML where its library is installed, else from JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        data = (yaml.safe_load(text) if yaml else json.loads(text)) or {}
    except Exception as e:
        raise ConfigError(f"settings can't be read: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError("settings must be a mapping")
    known = {f.name for f in fields(RepoConfig)}
    values = {k: v for k, v in data.items() if k in known}
    if isinstance(values.get("subsystems"), list):
        values["subsystems"] = {x["path"]: x["name"] for x in values["subsystems"]}
    if values.get("summarizer_backend") not in (None, *BACKENDS):
        raise ConfigError(f"unknown summarizer_backend {values['summarizer_backend']!r}")
    return RepoConfig(**values)


def input_budget(config: RepoConfig) -> int:
    """RM24. Characters a summary call may take: fixed for one backend, 2,000 to 64,000 for the others."""
    if config.summarizer_backend in (None, "local"):
        return 8_000
    return min(max(config.summarizer_input_char_budget or 24_000, 2_000), 64_000)
