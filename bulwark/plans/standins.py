"""Deterministic stand-in models, so that jobs around a model can run and be checked without one.

Each depends on text lengths only and has a SQL form next to it.
"""

from __future__ import annotations

import time

from bulwark.operators.scoring import Scorer


def _labels(_, texts: list[str]) -> list[dict[str, float]]:
    scores = [(len(t) * 7 % 101) / 100 for t in texts]
    return [{"Injection": s, "LEGIT": 1 - s} if len(t) % 9 else {"LEGIT": 1.0} for s, t in zip(scores, texts)]


INJECTION_LABELS = Scorer("prompt_injection", ("input_text",), score_batch=_labels, returns="map<string,double>")
INJECTION_SQL = (
    "CASE WHEN length(input_text) % 9 = 0 THEN CAST(0 AS DOUBLE) "
    "ELSE CAST(length(input_text) * 7 % 101 AS DOUBLE) / 100 END"
)


def _injection(_, texts: list[str]) -> list[float]:
    return [d.get("Injection", 0.0) for d in _labels(None, texts)]


INJECTION = Scorer("prompt_injection", ("input_text",), score_batch=_injection)


def _topic(_, texts: list[str]) -> list[float]:
    if any(len(t) % 11 == 0 for t in texts):
        raise ValueError("off the map")
    return [(len(t) * 11 % 97) / 100 for t in texts]


TOPIC = Scorer("topic_guardrail", ("input_text",), "input", "below", score_batch=_topic)
TOPIC_SQL = "CASE WHEN length(input_text) % 11 <> 0 THEN CAST(length(input_text) * 11 % 97 AS DOUBLE) / 100 END"


def _names(_, texts: list[str]) -> list[list[dict]]:
    """The first word of a text as a person, surely for texts of even length; and a date, unreported."""
    out = []
    for t in texts:
        word = t.split(" ")[0]
        score = 0.85 if len(t) % 2 == 0 else 0.4
        out.append(
            [{"type": "PERSON", "score": score, "start": 0, "end": len(word)}, {"type": "DATE_TIME", "score": 0.9, "start": 0, "end": len(t)}]
        )
    return out


NAMES = Scorer("names", ("text",), score_batch=_names, returns="array<struct<type:string,score:double,start:int,end:int>>")


def _toxicity(_, texts: list[str]) -> list[float]:
    return [(len(t) * 3 % 90) / 100 for t in texts]


TOXICITY = Scorer("toxicity", ("output_text",), "output", score_batch=_toxicity)
TOXICITY_SQL = "CAST(length(output_text) * 3 % 90 AS DOUBLE) / 100"


def _verbosity(_, texts: list[str]) -> list[float]:
    return [(len(t) % 71) / 100 for t in texts]


VERBOSITY = Scorer("verbosity", ("output_text",), "output", threshold=0.6, score_batch=_verbosity)


def _dimensions(_, texts: list[str]) -> list[dict[str, float]]:
    return [
        {"toxicity": len(t) % 83 / 100, "threat": len(t) % 59 / 100, "obscenity": len(t) % 97 / 100} for t in texts
    ]


TOXICITY_DIMENSIONS = Scorer(
    "toxicity_dimensions", ("text",), "output", score_batch=_dimensions, returns="map<string,double>"
)


def _relevance(_, inputs: list[str], outputs: list[str]) -> list[float]:
    return [((len(i) * 3 + len(o)) % 100) / 100 for i, o in zip(inputs, outputs)]


RELEVANCE = Scorer("relevance", ("input_text", "output_text"), "output", "below", score_batch=_relevance)
RELEVANCE_SQL = "CAST((length(input_text) * 3 + length(output_text)) % 100 AS DOUBLE) / 100"


def _consistency(_, documents: list[str], outputs: list[str]) -> list[float]:
    return [((len(d) * 5 + len(o)) % 101) / 100 for d, o in zip(documents, outputs)]


CONSISTENCY = Scorer("consistency", ("document", "output_text"), "output", score_batch=_consistency)


def _fragile(_, texts: list[str]) -> list[float]:
    """Fails a whole batch when any of its texts is unreadable."""
    for t in texts:
        if len(t) % 50 == 0:
            raise ValueError("unreadable text")
    return [(len(t) % 101) / 100 for t in texts]


FRAGILE = Scorer("readability", ("text",), score_batch=_fragile)


HANGS_FOR, HANGS_AT = 701, 7


def _hanging(_, texts: list[str]) -> list[float]:
    """Never returns on some texts."""
    while any(len(t) % HANGS_FOR == HANGS_AT for t in texts):
        time.sleep(60)
    return [(len(t) % 101) / 100 for t in texts]


HANGING = Scorer("patience", ("text",), score_batch=_hanging, timeout_ms=250, rows_per_call=64)
