"""Settings of the engine: defaults, JSON loading and validation."""

from __future__ import annotations

import dataclasses
import json
import math
import operator
import os


def setting(default: float | None, least: float | None = None, above: float | None = None, most: float | None = None, below: float | None = None) -> float:
    """A field with its range."""
    return dataclasses.field(default=default, metadata={">=": least, ">": above, "<=": most, "<": below})


HOLDS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}

# The names of the retrieval strategies.
STRATEGIES = ("peak_only", "top_k_action", "peak_neighbors", "hybrid")


@dataclasses.dataclass(frozen=True)
class Config:
    """All tunable values with their ranges; builders take one and never read files themselves."""

    # Names and defaults of the settings.
    salient_thresh: float = 0.35
    candidate_thresh: float = 0.08
    peak_order: int = 3
    adaptive: bool = True
    alpha: float = setting(0.4, least=0)
    beta: float = setting(0.3, least=0)
    gamma: float = setting(0.3, least=0)
    retrieval_strategy: str = "hybrid"
    verify_high_thresh: float = setting(0.70, below=1)
    verify_low_thresh: float = setting(0.35, above=0)
    disable_nli: bool = False
    residual_weight: float = setting(0.5, least=0)
    motion_weight: float = setting(0.3, least=0)
    entropy_weight: float = setting(0.2, least=0)
    peak_distance: int = setting(5, above=0)
    peak_prominence: float = setting(0.05, least=0)
    persistence_threshold: float = setting(0.4, least=0, most=1)
    max_prominence: float = setting(0.5, above=0)
    nms_window: int | None = 10
    l2_retrieve_top_k: int = setting(5, above=0)
    l1_capacity: int = setting(64, above=0)
    l1_w_action: float = 0.30
    l1_w_query: float = 0.20
    l1_w_persist: float = 0.15
    l1_w_pagerank: float = 0.10
    l1_w_entropy: float = 0.10
    l1_w_hessian: float = 0.10
    l1_w_recency: float = 0.05

    def problems(self) -> list[str]:
        """What is out of range, in words; verification thresholds don't matter where entailment is off."""
        found = []
        for f in dataclasses.fields(self):
            if self.disable_nli and f.name.startswith("verify_"):
                continue
            value = getattr(self, f.name)
            found += [f"{f.name} = {value} isn't {sign} {bound}" for sign, bound in f.metadata.items() if bound is not None and not HOLDS[sign](value, bound)]
        if not self.disable_nli and self.verify_low_thresh >= self.verify_high_thresh:
            found.append("verify_low_thresh isn't below verify_high_thresh")
        if self.sum_of("_weight") <= 0:
            found.append("all signal weights are 0")
        if not math.isclose(self.sum_of("l1_w_"), 1, rel_tol=0, abs_tol=1e-4):
            found.append(f"the l1_w_ weights add up to {self.sum_of('l1_w_')} rather than 1")
        if self.retrieval_strategy not in STRATEGIES:
            found.append(f"retrieval_strategy {self.retrieval_strategy!r} is none of {STRATEGIES}")
        return found

    def sum_of(self, part: str) -> float:
        """The sum of the fields that have ``part`` in their names."""
        return sum(v for k, v in dataclasses.asdict(self).items() if part in k)

    def validate(self) -> Config:
        """Raise ValueError if a value is out of range; return self otherwise."""
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


def load_config(path: str | None = None) -> Config:
    """Settings from a JSON file; unknown keys are ignored, a missing file means defaults."""
    values = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    known = {f.name for f in dataclasses.fields(Config)}
    return Config(**{k: v for k, v in values.items() if k in known}).validate()
