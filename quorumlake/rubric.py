"""Rubrics: criteria from Python data, JSON or YAML, and the table they become."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .schema import CRITERIA, NA_LABEL, NOMINAL_STRATEGIES, ORDINAL_STRATEGIES, local_table


@dataclass(frozen=True)
class Option:
    label: str
    value: float = 0.0
    na: bool = False

    def __post_init__(self) -> None:
        if not self.na and not 0 <= self.value <= 1:
            raise ValueError(f"option {self.label!r}: value {self.value} is outside 0 to 1")


@dataclass(frozen=True)
class Criterion:
    requirement: str
    weight: float = 10.0
    name: str | None = None
    options: tuple[Option, ...] | None = None
    scale_type: str = "ordinal"
    aggregation: str | None = None

    def __post_init__(self) -> None:
        if self.options is None:
            return
        if self.scale_type not in ("ordinal", "nominal"):
            raise ValueError(f"scale_type must be ordinal or nominal, not {self.scale_type!r}")
        allowed = ORDINAL_STRATEGIES if self.scale_type == "ordinal" else NOMINAL_STRATEGIES
        if self.aggregation is not None and self.aggregation not in allowed:
            raise ValueError(f"aggregation of a {self.scale_type} criterion must be one of {', '.join(allowed)}")
        if len(self.options) < 2 or sum(not o.na for o in self.options) < 2:
            raise ValueError("a choice needs two options, two of them scored")
        labels = [o.label.strip().lower() for o in self.options]
        if len(set(labels)) < len(labels):
            raise ValueError("option labels must differ beyond case and outer space")
        if not any(o.na for o in self.options) and NA_LABEL.lower() in labels:
            raise ValueError(f"a scored option cannot have the label {NA_LABEL!r} where no option abstains")

    @property
    def scale(self) -> str:
        return "binary" if self.options is None else self.scale_type

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Criterion:
        if "requirement" not in data:
            raise ValueError("requirement is missing")
        options = data.get("options")
        own = tuple(Option(str(o["label"]), float(o.get("value", 0.0)), bool(o.get("na", False))) for o in options) if options is not None else None
        return Criterion(str(data["requirement"]), float(data.get("weight", 10.0)), data.get("name"), own, data.get("scale_type", "ordinal"), data.get("aggregation"))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"weight": self.weight, "requirement": self.requirement}
        if self.name is not None:
            out["name"] = self.name
        if self.options is not None:
            out |= {"options": [{"label": o.label, "value": o.value} | ({"na": True} if o.na else {}) for o in self.options], "scale_type": self.scale_type}
        if self.aggregation is not None:
            out["aggregation"] = self.aggregation
        return out


@dataclass(frozen=True)
class Rubric:
    criteria: tuple[Criterion, ...]
    guidelines: str | None = field(default=None)

    def __post_init__(self) -> None:
        if not self.criteria:
            raise ValueError("a rubric needs a criterion")
        if self.guidelines is not None and not self.guidelines.strip():
            object.__setattr__(self, "guidelines", None)

    @staticmethod
    def from_dict(data: list | dict) -> Rubric:
        """A list of criteria or of sections with criteria, or a dict that holds one under ``rubric``,
        ``sections`` or ``criteria``, in this order, and perhaps ``guidelines``."""
        guidelines = None
        while isinstance(data, dict):
            guidelines = data.get("guidelines", guidelines)
            key = next((k for k in ("rubric", "sections", "criteria") if k in data), None)
            if key is None:
                raise ValueError("a rubric has criteria, sections or a rubric inside")
            data = data[key]
        flat: list[dict] = []
        for entry in data:
            flat += entry["criteria"] if isinstance(entry, dict) and "criteria" in entry else [entry]
        criteria = []
        for k, entry in enumerate(flat):
            try:
                criteria.append(Criterion.from_dict(entry))
            except (TypeError, KeyError, ValueError) as e:
                raise ValueError(f"criterion {k}: {e}") from e
        return Rubric(tuple(criteria), guidelines)

    @staticmethod
    def from_json(text: str) -> Rubric:
        return Rubric.from_dict(json.loads(text))

    @staticmethod
    def from_yaml(text: str) -> Rubric:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML rubrics need PyYAML; JSON ones do not") from e
        return Rubric.from_dict(yaml.safe_load(text))

    @staticmethod
    def from_file(path: str | Path) -> Rubric:
        readers = {".json": Rubric.from_json, ".yaml": Rubric.from_yaml, ".yml": Rubric.from_yaml}
        suffix = Path(path).suffix.lower()
        if suffix not in readers:
            raise ValueError(f"unknown rubric format {suffix!r}")
        return readers[suffix](Path(path).read_text(encoding="utf-8"))

    def to_dict(self) -> dict[str, Any] | list[dict[str, Any]]:
        own = [c.to_dict() for c in self.criteria]
        return {"guidelines": self.guidelines, "criteria": own} if self.guidelines else own

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per criterion."""
        rows = [
            (k, c.name, c.requirement, c.weight, c.scale, c.aggregation, None if c.options is None else [(i, o.label, o.value, o.na) for i, o in enumerate(c.options)])
            for k, c in enumerate(self.criteria)
        ]
        return local_table(spark, rows, CRITERIA)
