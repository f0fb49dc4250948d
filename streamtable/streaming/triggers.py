"""Triggers as small state machines, and the panes of a window that they make.

A trigger says when a window fires. Its state is a plain dict, so that it can be kept with a key. Panes carry what fired: the
elements since the last pane (discarding), all so far (accumulating), or all so far after taking back the last pane (retracting).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DISCARDING, ACCUMULATING, RETRACTING = "discarding", "accumulating", "retracting"
EARLY, ON_TIME, LATE = "early", "on_time", "late"


@dataclass
class Moment:
    """What a trigger may look at: whether the watermark has passed the window's end, and the processing time in milliseconds."""

    ended: bool
    now: int


class Trigger:
    def start(self) -> dict:
        return {"done": False}

    def element(self, s: dict, at: Moment) -> None:
        pass

    def ready(self, s: dict, at: Moment) -> bool:
        return False

    def fired(self, s: dict, at: Moment) -> None:
        s["done"] = True

    def times(self, s: dict) -> list[int]:
        """Processing times at which to look again."""
        return []


class Never(Trigger):
    pass


class Always(Trigger):
    def ready(self, s, at):
        return True

    def fired(self, s, at):
        pass


@dataclass
class ElementCount(Trigger):
    n: int

    def start(self):
        return {"done": False, "n": 0}

    def element(self, s, at):
        s["n"] += 1

    def ready(self, s, at):
        return not s["done"] and s["n"] >= self.n


@dataclass
class AfterProcessingTime(Trigger):
    """A delay after the first element since the start, its end moved up to a multiple of align if given."""

    delay: int
    align: int | None = None

    def start(self):
        return {"done": False, "due": None}

    def element(self, s, at):
        if s["due"] is None:
            due = at.now + self.delay
            s["due"] = -(-due // self.align) * self.align if self.align else due

    def ready(self, s, at):
        return not s["done"] and s["due"] is not None and at.now >= s["due"]

    def times(self, s):
        return [] if s["done"] or s["due"] is None else [s["due"]]


class AfterSynchronizedProcessingTime(AfterProcessingTime):
    """Upstream stages have no clock of their own here, so this is the plain delay of 0."""

    def __init__(self):
        super().__init__(0)


@dataclass
class AfterEndOfWindow(Trigger):
    """Once the watermark passes the end; before that as often as early fires, and after it as often as late does."""

    early: Trigger | None = None
    late: Trigger | None = None

    def start(self):
        return {"done": False, "on_time": False, "early": self.early.start() if self.early else None, "late": self.late.start() if self.late else None}

    def element(self, s, at):
        if not s["on_time"] and not at.ended:
            if self.early:
                self.early.element(s["early"], at)
        elif s["on_time"] and self.late:
            self.late.element(s["late"], at)

    def ready(self, s, at):
        if s["done"]:
            return False
        if not s["on_time"]:
            return at.ended or bool(self.early and self.early.ready(s["early"], at))
        return bool(self.late and self.late.ready(s["late"], at))

    def fired(self, s, at):
        if not s["on_time"] and not at.ended:
            s["early"] = self.early.start()
        elif not s["on_time"]:
            s["on_time"] = True
            s["done"] = self.late is None
        else:
            s["late"] = self.late.start()

    def times(self, s):
        own = (self.late, s["late"]) if s["on_time"] else (self.early, s["early"])
        return own[0].times(own[1]) if own[0] and not s["done"] else []


@dataclass
class Repeat(Trigger):
    inner: Trigger

    def start(self):
        return {"done": False, "inner": self.inner.start()}

    def element(self, s, at):
        self.inner.element(s["inner"], at)

    def ready(self, s, at):
        return self.inner.ready(s["inner"], at)

    def fired(self, s, at):
        self.inner.fired(s["inner"], at)
        if s["inner"]["done"]:
            s["inner"] = self.inner.start()

    def times(self, s):
        return self.inner.times(s["inner"])


class Several(Trigger):
    def __init__(self, *parts: Trigger):
        self.parts = parts

    def start(self):
        return {"done": False, "parts": [p.start() for p in self.parts]}

    def element(self, s, at):
        for p, q in zip(self.parts, s["parts"], strict=True):
            if not q["done"]:
                p.element(q, at)

    def times(self, s):
        return [t for p, q in zip(self.parts, s["parts"], strict=True) if not q["done"] for t in p.times(q)]


class AfterAny(Several):
    def ready(self, s, at):
        return not s["done"] and any(p.ready(q, at) for p, q in zip(self.parts, s["parts"], strict=True))


class AfterAll(Several):
    """Once each part has been ready at some time."""

    def ready(self, s, at):
        for p, q in zip(self.parts, s["parts"], strict=True):
            if not q["done"] and p.ready(q, at):
                q["done"] = True
        return not s["done"] and all(q["done"] for q in s["parts"])


class AfterEach(Several):
    """The parts one after the other, each until it is done."""

    def element(self, s, at):
        for p, q in zip(self.parts, s["parts"], strict=True):
            if not q["done"]:
                p.element(q, at)
                return

    def ready(self, s, at):
        return next((p.ready(q, at) for p, q in zip(self.parts, s["parts"], strict=True) if not q["done"]), False)

    def fired(self, s, at):
        for p, q in zip(self.parts, s["parts"], strict=True):
            if not q["done"]:
                p.fired(q, at)
                break
        s["done"] = all(q["done"] for q in s["parts"])


class OrFinally(Several):
    """As main fires, until the other one does, which ends it."""

    def __init__(self, main: Trigger, until: Trigger):
        super().__init__(main, until)

    def ready(self, s, at):
        return not s["done"] and any(p.ready(q, at) for p, q in zip(self.parts, s["parts"], strict=True))

    def fired(self, s, at):
        (main, until), (m, u) = self.parts, s["parts"]
        if until.ready(u, at):
            s["done"] = True
        else:
            main.fired(m, at)
            s["done"] = m["done"]


def default_trigger() -> Trigger:
    """At the end of the window, and again for each late element."""
    return AfterEndOfWindow(late=ElementCount(1))


@dataclass
class Strategy:
    trigger: Trigger = field(default_factory=default_trigger)
    accumulation: str = DISCARDING
    closing: str = "if_non_empty"  # or "always": a last pane when the window is dropped
    on_time: str = "always"  # or "if_non_empty"


def new_state(strategy: Strategy) -> dict:
    return {"trigger": strategy.trigger.start(), "all": None, "new": None, "count": 0, "last": None, "index": 0, "late_index": 0, "ended": False, "closed": False}


class Combiner:
    """How values of a window come together. The default adds."""

    def add(self, a: Any, v: Any) -> Any:
        return a if v is None else v if a is None else a + v

    def empty(self) -> Any:
        return 0


def step(strategy: Strategy, s: dict, combiner: Combiner, values: list, at: Moment) -> list[dict]:
    """Takes elements in order, then time; returns the panes that fired."""
    panes = []
    for v in values:
        if s["closed"]:
            continue
        s["all"], s["new"], s["count"] = combiner.add(s["all"], v), combiner.add(s["new"], v), s["count"] + 1
        strategy.trigger.element(s["trigger"], at)
        panes += fire(strategy, s, combiner, at, after_element=True)
    panes += fire(strategy, s, combiner, at)
    return panes


def fire(strategy: Strategy, s: dict, combiner: Combiner, at: Moment, after_element: bool = False) -> list[dict]:
    if s["trigger"]["done"] or not strategy.trigger.ready(s["trigger"], at):
        return []
    first_after_end = at.ended and not s["ended"]
    if not s["count"] and not (first_after_end and strategy.on_time == "always" and s["all"] is not None):
        if not first_after_end:
            return []
        strategy.trigger.fired(s["trigger"], at)
        s["ended"] = True
        return []
    strategy.trigger.fired(s["trigger"], at)
    timing = EARLY if not at.ended else ON_TIME if first_after_end else LATE
    return emit(strategy, s, combiner, timing, at.ended)


def emit(strategy: Strategy, s: dict, combiner: Combiner, timing: str, ended: bool, last: bool = False) -> list[dict]:
    whole = strategy.accumulation != DISCARDING
    value = (s["all"] if whole else s["new"]) if s["count"] or whole else combiner.empty()
    out = []
    pane = {"is_first": s["index"] == 0, "is_last": last or s["trigger"]["done"], "timing": timing, "pane_index": s["index"], "on_time_index": -1 if timing == EARLY else s["late_index"]}
    if strategy.accumulation == RETRACTING and s["last"] is not None:
        out.append({"value": s["last"], "retraction": True, **pane})
    out.append({"value": value, "retraction": False, **pane})
    s["last"], s["new"], s["count"], s["index"] = value, None, 0, s["index"] + 1
    s["late_index"] += ended
    s["ended"] = s["ended"] or ended
    return out


def close(strategy: Strategy, s: dict, combiner: Combiner) -> list[dict]:
    """The window is dropped: what is left fires once more, or an empty pane if the strategy asks for one."""
    if s["closed"]:
        return []
    s["closed"] = True
    if s["count"] or strategy.closing == "always":
        return emit(strategy, s, combiner, LATE if s["ended"] else ON_TIME, True, last=True)
    return []
