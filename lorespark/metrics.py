"""Counters, latencies and costs of one engine object, and their text export."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np

from lorespark.functions.scores import EMBED, INPUT, OUTPUT


class Metrics:
    """Calls, errors and latencies by operation. ``percentile`` is over the latest ``keep`` calls of an operation."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, keep: int = 1000):
        self.clock, self.keep, self.started, self.lock = clock, keep, clock(), threading.Lock()
        self.calls: dict[str, int] = {}
        self.errors: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.latest: dict[str, list[float]] = {}

    @contextmanager
    def timed(self, operation: str) -> Iterator[None]:
        began, failed = self.clock(), True
        try:
            yield
            failed = False
        finally:
            took = self.clock() - began
            with self.lock:
                self.calls[operation] = self.calls.get(operation, 0) + 1
                self.errors[operation] = self.errors.get(operation, 0) + failed
                self.seconds[operation] = self.seconds.get(operation, 0.0) + took
                self.latest[operation] = [*self.latest.get(operation, []), took][-self.keep :]

    def mean(self, operation: str) -> float:
        return self.seconds.get(operation, 0.0) / max(self.calls.get(operation, 0), 1)

    def percentile(self, operation: str, q: float) -> float:
        held = self.latest.get(operation)
        return float(np.percentile(held, q)) if held else 0.0

    @property
    def uptime(self) -> float:
        return self.clock() - self.started

    def export(self, prefix: str = "lorespark") -> str:
        """One sample a line, in the text format that monitoring systems scrape."""
        lines = [f"# TYPE {prefix}_uptime_seconds gauge", f"{prefix}_uptime_seconds {self.uptime:.3f}"]
        for name, kind, values in (("calls_total", "counter", self.calls), ("errors_total", "counter", self.errors)):
            lines.append(f"# TYPE {prefix}_{name} {kind}")
            lines += [f'{prefix}_{name}{{operation="{op}"}} {n}' for op, n in sorted(values.items())]
        lines.append(f"# TYPE {prefix}_latency_seconds summary")
        for op in sorted(self.calls):
            lines += [f'{prefix}_latency_seconds{{operation="{op}",quantile="{q / 100:g}"}} {self.percentile(op, q):.6f}' for q in (50, 95, 99)]
            lines += [f'{prefix}_latency_seconds_sum{{operation="{op}"}} {self.seconds[op]:.6f}', f'{prefix}_latency_seconds_count{{operation="{op}"}} {self.calls[op]}']
        return "\n".join(lines) + "\n"


class CostTracker:
    """What was spent: embedding calls, input and output tokens; lookups are counted but free."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.embed_calls = self.input_tokens = self.output_tokens = self.lookups = 0

    def record(self, embed_calls: int = 0, input_tokens: int = 0, output_tokens: int = 0, lookups: int = 0) -> None:
        self.embed_calls += embed_calls
        self.input_tokens += input_tokens
        self.output_tokens += output_tokens
        self.lookups += lookups

    @staticmethod
    def estimate(embed_calls: int = 0, input_tokens: int = 0, output_tokens: int = 0) -> float:
        return embed_calls / 1000 * EMBED + input_tokens / 1000 * INPUT + output_tokens / 1000 * OUTPUT

    @property
    def total(self) -> float:
        return self.estimate(self.embed_calls, self.input_tokens, self.output_tokens)
