"""Step functions of keyed event logic, shared by batch and stream.

A step takes the state of a key (a tuple, or None at first) and the time of
an event in seconds, and returns the new state and the decision. State is a
few numbers per key; nothing else is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

State = tuple[float, ...] | None
Step = Callable[[State, float], tuple[tuple[float, ...], bool]]


@dataclass(frozen=True)
class Automaton:
    """``fields`` names the state; after ``reset`` idle seconds the state no
    longer matters, so an ordered run may be cut there."""

    name: str
    step: Step
    fields: tuple[str, ...]
    reset: float


def sliding_dedup(window: float = 300.0) -> Automaton:
    """Pass unless within ``window`` of the last occurrence (passed or not)."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        return (t,), state is None or t - state[0] > window
    return Automaton("sliding", step, ("last",), window)


def tumbling_dedup(window: float = 300.0) -> Automaton:
    """Pass the first event of each aligned window."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        start = math.floor(t / window) * window
        return (start,), state is None or start != state[0]
    return Automaton("tumbling", step, ("window",), window)


def session_dedup(gap: float = 60.0, longest: float = 3600.0) -> Automaton:
    """Pass the first event of each session; a session ends after a quiet
    ``gap`` or when it has lasted ``longest``."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        fresh = state is None or t - state[1] > gap or t - state[0] >= longest
        return (t if fresh else state[0], t), fresh
    return Automaton("session", step, ("start", "last"), gap)


def adaptive_dedup(shortest: float = 60.0, longest: float = 3600.0, scale: float = 2.0, decay: float = 1800.0) -> Automaton:
    """Window grows with the number of events, which fades over ``decay``
    quiet seconds: shortest * (1 + ln(1 + count) * scale), clamped."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        if state is None:
            return (1.0, t, t), True
        count, last, passed = state
        faded = int(count * max(0.0, 1.0 - (t - last) / decay))
        window = shortest if faded == 0 else int(shortest * (1 + math.log(1 + faded) * scale))
        window = min(longest, max(shortest, window))
        ok = t - passed > window
        return (faded + 1.0, t, t if ok else passed), ok
    return Automaton("adaptive", step, ("count", "last", "passed"), max(decay, longest))


def fixed_throttle(limit: int, window: float = 60.0) -> Automaton:
    """Pass the first ``limit`` events of each aligned window."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        start = math.floor(t / window) * window
        n = state[1] + 1 if state is not None and state[0] == start else 1.0
        return (start, n), n <= limit
    return Automaton("fixed", step, ("window", "count"), window)


def sliding_throttle(limit: int, window: float = 60.0) -> Automaton:
    """Pass while current + previous * (1 - elapsed share) is below the limit;
    only passed events count."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        start = math.floor(t / window) * window
        now = before = 0.0
        if state is not None:
            if state[0] == start:
                now, before = state[1], state[2]
            elif state[0] == start - window:
                before = state[1]
        ok = now + before * (1.0 - (t - start) / window) < limit
        return (start, now + ok, before), ok
    return Automaton("sliding_window", step, ("window", "count", "previous"), 2 * window)


def token_bucket(capacity: float, refill: float) -> Automaton:
    """Pass when a token is left; tokens refill with time up to capacity. A
    refused event leaves the bucket as it was."""
    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        if state is None:
            return (capacity - 1.0, t), True
        tokens = min(capacity, state[0] + (t - state[1]) * refill)
        return ((tokens - 1.0, t), True) if tokens >= 1 else (state, False)
    return Automaton("token_bucket", step, ("tokens", "at"), capacity / refill)


def composite(*parts: Automaton) -> Automaton:
    """Pass when every part passes; parts after a refusal are not asked, so
    their state stays."""
    sizes = [len(p.fields) for p in parts]

    def step(state: State, t: float) -> tuple[tuple[float, ...], bool]:
        out: list[float] = []
        at, ok = 0, True
        for p, n in zip(parts, sizes):
            own = None if state is None or math.isnan(state[at]) else tuple(state[at:at + n])
            if ok:
                own, ok = p.step(own, t)
            out += list(own) if own is not None else [math.nan] * n
            at += n
        return tuple(out), ok
    names = tuple(f"{p.name}_{f}" for p in parts for f in p.fields)
    return Automaton("composite", step, names, max(p.reset for p in parts))
