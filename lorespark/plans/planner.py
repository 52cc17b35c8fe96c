"""Questions to retrieval plans: analysis, rules, steps and their costs. Driver-side, one string at a time."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from lorespark.functions import text as X

COSTS = {"vector": 1.0, "fulltext": 0.5, "graph": 1.5, "metadata": 0.3, "time": 0.3, "code": 1.0}
LIMITS = {"vector": 20, "fulltext": 20, "graph": 10, "code": 10}


@dataclass(frozen=True)
class Question:
    text: str
    intent: str
    keywords: tuple[str, ...]
    entities: tuple[str, ...]
    dates: tuple[str, ...]
    filters: dict[str, str] = field(default_factory=dict)
    confidence: float = 0.5
    comparison: bool = False
    code: bool = False


def _holds(q: str, phrases: tuple[str, ...]) -> bool:
    return any(q.startswith(p[1:]) if p[0] == "^" else p in q for p in phrases)


def analyse(text: str) -> Question:
    """Intent, keywords, entities, dates, flags and ``key:value`` filters of a question."""
    text = text.strip()
    low = text.lower()
    intent = next((name for name, phrases in X.INTENT_RULES if _holds(low, phrases) and (name != "temporal" or _holds(low, X.TEMPORAL_SIGNS))), "general")
    plain = ["".join(c for c in w if c.isalnum()) for w in text.split()]
    keywords = tuple(w for w in (p.lower() for p in plain) if len(w.encode()) > 1 and w not in X.STOP_WORDS)
    entities = tuple(p for p in plain[1:] if len(p.encode()) > 1 and p[0].isupper())
    dates = tuple(d for d in X.DATE_WORDS if d in low)
    filters = dict(m.groups() for m in re.finditer(r"\b(\w+):([\w-]+)", text))
    score = 0.5 + 0.2 * (intent != "general") + 0.1 * bool(entities) + 0.1 * bool(dates) + 0.1 * (len(keywords) > 2)
    return Question(text, intent, keywords, entities, dates, filters, min(1.0, score), _holds(low, X.COMPARISON_SIGNS), _holds(low, X.CODE_SIGNS))


def actions(q: Question) -> tuple[str, ...]:
    """Ordered rules to distinct actions; the default rule always fires."""
    both = ("vector", "fulltext")
    rules = (
        (q.intent == "temporal" or bool(q.dates), ("time", "vector")),
        (q.intent == "comparison" or q.comparison, (*both, "graph")),
        (q.intent == "entity_search" or bool(q.entities), (*both, "graph", "metadata")),
        (q.intent == "code_search" or q.code, ("code", "fulltext")),
        (q.intent == "listing", both),
        (q.intent == "analytical", ("metadata", "fulltext", "vector")),
        (q.intent == "factoid", both),
        (bool(q.filters), ("metadata",)),  # filters named in the question
        (True, both),
    )
    return tuple(dict.fromkeys(a for fires, found in rules if fires for a in found))


@dataclass(frozen=True)
class Step:
    kind: str
    limit: int | None
    cost: float


@dataclass(frozen=True)
class Plan:
    question: Question
    steps: tuple[Step, ...]

    @property
    def cost(self) -> float:
        return sum(s.cost for s in self.steps)

    def explain(self) -> str:
        q = self.question
        lines = [f"question {q.text!r}: intent {q.intent}, confidence {q.confidence:.2f}, cost {self.cost:.2f}"]
        return "\n".join(lines + [f"{i}. {s.kind}" + (f" limit {s.limit}" if s.limit else "") for i, s in enumerate(self.steps, 1)] + ["merge, rerank, build context"])


def plan(q: Question) -> Plan:
    """A step per action; a code search is a second, narrower vector step."""
    return Plan(q, tuple(Step(a, LIMITS.get(a), COSTS[a]) for a in actions(q)))


class PlanCache:
    """Question to plan for ``ttl`` seconds; the oldest entry goes first; a write clears it."""

    def __init__(self, size: int = 1000, ttl: float = 300.0, clock=time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[float, Plan]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, text: str) -> Plan:
        now = self.clock()
        held = self.entries.get(text)
        if held and now - held[0] < self.ttl:
            self.hits += 1
            return held[1]
        self.misses += 1
        made = plan(analyse(text))
        self.entries.pop(text, None)
        self.entries[text] = (now, made)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)
        return made

    def clear(self) -> None:
        self.entries.clear()
