"""Driver-side control of a request: phases with outcomes, fallback, budgets. It starts Spark actions and holds no rows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError as PhaseTimeout
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Trace:
    """What became of each phase: (name, outcome, seconds, error)."""

    phases: list[tuple[str, str, float, str | None]] = field(default_factory=list)

    @property
    def degraded(self) -> bool:
        return any(outcome != "ok" for _, outcome, _, _ in self.phases)


def run_phase(trace: Trace, name: str, action: Callable, timeout: float | None = None, otherwise=None, required: bool = False, spark: SparkSession | None = None):
    """The action's result; a phase that fails or takes too long is noted and gives ``otherwise``, unless it is required. With a session, the Spark jobs of a phase that
    takes too long are cancelled by the tag that the phase gave them."""
    began, pool, tag = time.monotonic(), ThreadPoolExecutor(1), f"phase-{uuid.uuid4().hex}"
    note = lambda outcome, error=None: trace.phases.append((name, outcome, time.monotonic() - began, error))

    def tagged():
        if spark is None:
            return action()
        spark.sparkContext.addJobTag(tag)
        try:
            return action()
        finally:
            spark.sparkContext.removeJobTag(tag)

    try:
        result = pool.submit(tagged).result(timeout)
    except PhaseTimeout:
        if spark is not None:
            spark.sparkContext.cancelJobsWithTag(tag)
        note("timeout", f"over {timeout} s")
        if required:
            raise
        return otherwise
    except Exception as e:  # a phase may fail in any way; the outcome is told, not hidden
        note("failed", f"{type(e).__name__}: {e}")
        if required:
            raise
        return otherwise
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    note("ok")
    return result


def deep_or_fast(deep: Callable, fast: Callable, timeout: float | None = None, spark: SparkSession | None = None) -> tuple[object, Trace]:
    """Rows of a deep recall; after a timeout, a failure or no rows, those of one fast recall."""
    trace = Trace()
    rows = run_phase(trace, "deep", deep, timeout, spark=spark)
    if rows:
        return rows, trace
    return run_phase(trace, "fast", fast, required=True), trace


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """A ledger of tokens and cost: reserved before a call, settled after it. None is without limit."""

    tokens: int | None = None
    cost_micros: int | None = None
    calls: int | None = None
    used_tokens: int = 0
    used_cost: int = 0
    used_calls: int = 0
    reserved: int = 0

    def stop_reason(self, next_tokens: int = 0) -> str | None:
        """Why no further call may start: calls, cost or tokens."""
        if self.calls is not None and self.used_calls >= self.calls:
            return "calls"
        if self.cost_micros is not None and self.used_cost >= self.cost_micros:
            return "cost"
        if self.tokens is not None and self.used_tokens + self.reserved + next_tokens > self.tokens:
            return "tokens"
        return None

    def reserve(self, tokens: int) -> int:
        reason = self.stop_reason(tokens)
        if reason:
            raise BudgetExceeded(reason)
        self.reserved += tokens
        self.used_calls += 1
        return tokens

    def settle(self, reservation: int, tokens: int, cost_micros: int = 0) -> None:
        self.reserved -= reservation
        self.used_tokens += tokens
        self.used_cost += cost_micros
