"""Pipelines as named graphs of transforms over DataFrames, and jobs that run them.

A step's function takes the DataFrames of its inputs and returns one, or a dict of tagged ones. Nothing runs before a sink does:
the graph is for names, checks and pictures, and Catalyst fuses, prunes and orders. A collection that several sinks read can be shared.
"""

from __future__ import annotations

import enum
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Names of transforms that this library has an operator for. All others are refused when a pipeline is prepared.
KNOWN = frozenset(
    f"beam:transform:{n}:v1"
    for n in (
        "impulse create read teststream pubsub_read managed pardo flatten group_by_key group_by_key_wrapper combine_per_key combine_globally combine_per_key_precombine combine_per_key_merge_accumulators "
        "combine_per_key_extract_outputs combine_per_key_convert_to_accumulators combine_grouped_values group_into_batches group_into_batches_with_sharded_key to_string window_into merge_windows map_windows create_view reshuffle "
        "redistribute_by_key redistribute_arbitrarily write_files pubsub_write pubsub_write:v2 sdf_pair_with_restriction sdf_split_and_size_restrictions sdf_process_sized_element_and_restrictions sdf_truncate_sized_restrictions"
    ).split()
)
# Requirements of pipelines that are met.
REQUIREMENTS = frozenset(f"beam:requirement:pardo:{n}:v1" for n in "stateful splittable_dofn time_sorted_input".split())


@dataclass
class Step:
    name: str
    urn: str
    fn: Callable
    inputs: tuple[str, ...]


@dataclass
class Pipeline:
    name: str
    requirements: tuple[str, ...] = ()
    steps: dict[str, Step] = field(default_factory=dict)
    _made: dict[str, DataFrame | dict[str, DataFrame]] = field(default_factory=dict)

    def step(self, name: str, urn: str, fn: Callable, *inputs: str) -> Pipeline:
        """Adds a step. Inputs are names of earlier steps; "step:tag" is one of several outputs."""
        if name in self.steps:
            raise ValueError(f"there already is a step named {name}")
        if unknown := [i for i in inputs if i.partition(":")[0] not in self.steps]:
            raise ValueError(f"step {name} reads unknown steps: {', '.join(unknown)}")
        self.steps[name] = Step(name, urn, fn, inputs)
        return self

    def check(self) -> None:
        """Refuses unknown transforms and requirements that aren't met."""
        if bad := [r for r in self.requirements if r not in REQUIREMENTS]:
            raise ValueError(f"requirements not met: {', '.join(bad)}")
        if bad := [s.urn for s in self.steps.values() if s.urn not in KNOWN]:
            raise ValueError(f"unknown transforms: {', '.join(bad)}")

    def collection(self, name: str) -> DataFrame:
        """The output of a step, or of its tag ("step:tag"). Each step's function is called once."""
        step, _, tag = name.partition(":")
        if step not in self._made:
            s = self.steps[step]
            self._made[step] = s.fn(*(self.collection(i) for i in s.inputs))
        out = self._made[step]
        if isinstance(out, dict):
            return out[tag]
        return out

    def consumers(self, name: str) -> list[str]:
        return [s.name for s in self.steps.values() if any(i.partition(":")[0] == name for i in s.inputs)]

    def dot(self) -> str:
        """The graph in Graphviz form."""
        quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = [f"  {quote(s.name)} [shape=box, label={quote(s.name + chr(10) + s.urn)}];" for s in self.steps.values()]
        lines += [f"  {quote(i.partition(':')[0])} -> {quote(s.name)}" + (f" [label={quote(i.partition(':')[2])}]" if ":" in i else "") + ";" for s in self.steps.values() for i in s.inputs]
        return "\n".join([f"digraph {quote(self.name)} {{", *lines, "}"])


class State(enum.Enum):
    STOPPED = "stopped"
    STARTING = "starting"
    RUNNING = "running"
    DONE = "done"
    FAILED = "failed"
    CANCELLED = "cancelled"
    DRAINED = "drained"


FINAL = (State.DONE, State.FAILED, State.CANCELLED, State.DRAINED)


class Job:
    """A pipeline with sinks: step name -> function that writes a DataFrame, or starts a stream and returns its query."""

    jobs: dict[str, Job] = {}

    def __init__(self, pipeline: Pipeline, sinks: dict[str, Callable]):
        pipeline.check()
        if unknown := [s for s in sinks if s.partition(":")[0] not in pipeline.steps]:
            raise ValueError(f"sinks of unknown steps: {', '.join(unknown)}")
        self.id, self.pipeline, self.sinks = uuid.uuid4().hex, pipeline, sinks
        self.state, self.history, self.messages, self.queries = State.STOPPED, [(time.time(), State.STOPPED)], [], []
        Job.jobs[self.id] = self

    def _turn(self, state: State) -> None:
        self.state = state
        self.history.append((time.time(), state))

    def run(self) -> Job:
        """Runs all sinks; collections that several of them read are computed once. Streams go on until they end, or are cancelled or drained."""
        self._turn(State.STARTING)
        shared = []
        try:
            self._turn(State.RUNNING)
            for name, write in self.sinks.items():
                df = self.pipeline.collection(name)
                if not df.isStreaming and sum(s.partition(":")[0] == name.partition(":")[0] for s in self.sinks) > 1:
                    shared.append(df.persist())
                query = write(df)
                if hasattr(query, "awaitTermination"):
                    self.queries.append(query)
            for q in self.queries:
                q.awaitTermination()
            if self.state is State.RUNNING:
                self._turn(State.DONE)
        except Exception as e:
            if self.state not in (State.CANCELLED, State.DRAINED):
                self.messages.append((time.time(), "ERROR", str(e)))
                self._turn(State.FAILED)
                raise
        finally:
            for df in shared:
                df.unpersist()
        return self

    def _stop(self, state: State) -> State:
        if self.state not in FINAL:
            self._turn(state)
            for q in self.queries:
                q.stop()
        return self.state

    def cancel(self) -> State:
        return self._stop(State.CANCELLED)

    def drain(self) -> State:
        """Lets streams finish what has arrived, then stops them."""
        for q in self.queries:
            q.processAllAvailable()
        return self._stop(State.DRAINED)

    def metrics(self) -> list[dict]:
        return [q.lastProgress for q in self.queries]
