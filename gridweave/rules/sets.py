"""Rule sets: pillars, topics and KPIs as plain data, with the fixed default set."""

from __future__ import annotations

from dataclasses import dataclass, field

from gridweave.rules import fixed


@dataclass(frozen=True)
class Topic:
    topic: str
    label: str
    pillar: str
    keywords: tuple[str, ...]
    required_kinds: tuple[str, ...] = ()
    kpi_patterns: tuple[str, ...] = ()
    weak_threshold: int = 2


@dataclass(frozen=True)
class Kpi:
    metric: str
    pillar: str
    keywords: tuple[str, ...]
    preferred_units: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    """Everything a coverage report is computed from. The order of topics and KPIs counts."""

    pillars: dict[str, str]
    pillar_keywords: dict[str, list[str]]
    topics: tuple[Topic, ...]
    kpis: tuple[Kpi, ...]
    owners: dict[str, str] = field(default_factory=dict)


def default_rules() -> RuleSet:
    return RuleSet(
        pillars=dict(fixed.PILLAR_LABELS),
        pillar_keywords={p: list(ws) for p, ws in fixed.PILLAR_KEYWORDS.items()},
        topics=tuple(Topic(t, label, p, tuple(ws), tuple(ks), tuple(ps), max(1, n)) for t, label, p, ws, ks, ps, n in fixed.TOPICS),
        kpis=tuple(Kpi(m, p, tuple(ws), tuple(us)) for m, p, ws, us in fixed.KPIS),
        owners=dict(fixed.PILLAR_OWNERS),
    )
