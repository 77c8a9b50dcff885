"""The evaluator catalogue and its configuration: the dimension every operator keys on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Evaluator:
    ord: int
    name: str
    chain: str  # input | output
    direction: str  # above | below
    threshold: float
    action: str  # redact | block | strip | flag
    enabled: bool = True


# Evaluator order, chain, flag direction, default threshold and action.
EVALUATORS: tuple[Evaluator, ...] = (
    Evaluator(0, "pii", "input", "above", 0.5, "redact"),
    Evaluator(1, "prompt_injection", "input", "above", 0.8, "block"),
    Evaluator(2, "topic_guardrail", "input", "below", 0.3, "block"),
    Evaluator(3, "toxicity", "output", "above", 0.7, "flag"),
    Evaluator(4, "exfiltration", "output", "above", 0.5, "strip"),
    Evaluator(5, "relevance", "output", "below", 0.3, "flag"),
    Evaluator(6, "hallucination", "output", "above", 0.5, "flag"),
    Evaluator(7, "faithfulness", "output", "below", 0.5, "flag"),
)
# Threshold of an evaluator without one, evaluators off unless switched on,
# evaluators left out of run scorecards.
FALLBACK_THRESHOLD = 0.8
OFF_BY_DEFAULT = ("topic_guardrail",)
NOT_IN_SCORECARDS = ("exfiltration",)

NAMES: tuple[str, ...] = tuple(e.name for e in EVALUATORS)
INPUT_NAMES: tuple[str, ...] = tuple(e.name for e in EVALUATORS if e.chain == "input")
SCORECARD_NAMES: tuple[str, ...] = tuple(n for n in NAMES if n not in NOT_IN_SCORECARDS)


def configure(
    overrides: Mapping[str, Mapping[str, object]] | None = None,
    base: Iterable[Evaluator] = EVALUATORS,
) -> tuple[Evaluator, ...]:
    """The catalogue with per-evaluator overrides, e.g. ``{"pii": {"action": "block"}}``."""
    overrides = overrides or {}
    return tuple(replace(e, **overrides.get(e.name, {})) for e in base)


def default_config() -> tuple[Evaluator, ...]:
    return configure({name: {"enabled": False} for name in OFF_BY_DEFAULT})


def enabled_names(config: Iterable[Evaluator]) -> list[str]:
    return [e.name for e in sorted(config, key=lambda e: e.ord) if e.enabled]


def lookup(evaluator: Column, config: Iterable[Evaluator], field: str, default=None) -> Column:
    """``config.field`` of the evaluator named in a column, as a CASE over the fixed catalogue.

    The catalogue is a handful of constants, so no join is needed.
    """
    expr = None
    for e in config:
        value = F.lit(getattr(e, field))
        expr = F.when(evaluator == e.name, value) if expr is None else expr.when(evaluator == e.name, value)
    return expr.otherwise(F.lit(default))
