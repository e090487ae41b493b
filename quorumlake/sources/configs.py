"""Configurations of judges, and what decision models are known to accept."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any



@dataclass(frozen=True)
class JudgeConfig:
    """A remote judge's settings, as a YAML file holds them."""

    model: str
    temperature: float | None = None
    max_tokens: int | None = None
    attempts: int = 3
    pause: float = 0.5
    concurrency: int = 8
    cache_path: str | None = None
    cache_seconds: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.model:
            raise ValueError("a judge needs a model")
        if self.attempts < 1 or self.concurrency < 1:
            raise ValueError("attempts and concurrency must be at least 1")

    @staticmethod
    def from_dict(data: Mapping[str, Any]) -> JudgeConfig:
        """Unknown keys go into ``extra``, for the transport to read."""
        names = {f.name for f in fields(JudgeConfig)} - {"extra"}
        own = {k: v for k, v in data.items() if k in names}
        return JudgeConfig(**own, extra=dict(data.get("extra", {})) | {k: v for k, v in data.items() if k not in names and k != "extra"})

    @staticmethod
    def from_yaml(text: str) -> JudgeConfig:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML configurations need PyYAML; dicts do not") from e
        data = yaml.safe_load(text)
        if not isinstance(data, dict):
            raise ValueError("a configuration is a mapping")
        return JudgeConfig.from_dict(data)

    def to_dict(self) -> dict[str, Any]:
        """Settings that differ from the defaults, and the model."""
        default = JudgeConfig(self.model)
        return {k: v for k, v in asdict(self).items() if k == "model" or v != getattr(default, k)}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)


def strictest(limits: list[int | None]) -> int | None:
    """The limit of calls at once where several judges share a provider: the lowest that is set."""
    return min((x for x in limits if x is not None), default=None)


def capabilities(model: str, registry: Mapping[str, Mapping[str, Any]]) -> Mapping[str, Any] | None:
    """What ``registry`` says a decision model accepts; a name with a provider's prefix matches only an entry
    of that provider."""
    provider, _, bare = model.rpartition("/")
    entry = registry.get(bare)
    return entry if entry is not None and provider in ("", entry.get("provider")) else registry.get(model)
