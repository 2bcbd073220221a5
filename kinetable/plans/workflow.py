"""Workflows of DataFrame nodes: a graph of steps that is put together lazily, so that Spark plans it as a whole."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.matching import Claim

Inputs = dict[str, DataFrame]
Run = Callable[[Inputs, dict], Inputs]


class Skip(Exception):
    """A node that has nothing to do with these inputs."""


@dataclass(frozen=True)
class Kind:
    """A kind of node: what it needs, what it gives, and its function."""

    name: str
    category: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Run
    defaults: dict = field(default_factory=dict)


KINDS: dict[str, Kind] = {}
ALIASES: dict[str, str] = {}


def node_kind(name: str, category: str, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = ("out",), aliases: tuple[str, ...] = (), **defaults) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in KINDS:
            raise ValueError(f"{name} is registered already")
        KINDS[name] = Kind(name, category, inputs, outputs, run, defaults)
        ALIASES.update(dict.fromkeys(aliases, name))
        return run

    return add


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    """From an output of one node to an input of another."""

    source: str
    output: str
    target: str
    input: str


def in_order(nodes: list[Node], edges: list[Edge]) -> list[Node]:
    """Sources first, in the order given among equals; nodes of a cycle come last."""
    waiting = {n.id: {e.source for e in edges if e.target == n.id and e.source != n.id} for n in nodes}
    known = {n.id for n in nodes}
    out: list[Node] = []
    while True:
        done = {n.id for n in out}
        ready = [n for n in nodes if n.id not in done and not (waiting[n.id] & known) - done]
        if not ready:
            return out + [n for n in nodes if n.id not in done]
        out += ready


def config_of(node: Node, bindings: dict[str, dict] | None = None) -> dict:
    """The kind's defaults, under the node's own, under the project's bindings."""
    kind = KINDS[ALIASES.get(node.kind, node.kind)]
    return kind.defaults | node.config | (bindings or {}).get(node.id, {})


def execute(nodes: list[Node], edges: list[Edge], given: dict[str, DataFrame], bindings: dict[str, dict] | None = None) -> tuple[dict[tuple[str, str], DataFrame], dict[str, str]]:
    """All outputs by (node, output), and the state of each node: done, skipped, or why it failed.

    ``given`` are the tables of nodes without inputs.  Several edges into one input are numbered name, name#2, ...
    """
    made: dict[tuple[str, str], DataFrame] = {}
    state: dict[str, str] = {}
    for node in in_order(nodes, edges):
        kind = KINDS[ALIASES.get(node.kind, node.kind)]
        inputs: Inputs = {"given": given[node.id]} if node.id in given else {}
        for e in edges:
            if e.target == node.id and (e.source, e.output) in made:
                n = sum(k.split("#")[0] == e.input for k in inputs)
                inputs[e.input if n == 0 else f"{e.input}#{n + 1}"] = made[e.source, e.output]
        if any(i not in inputs for i in kind.inputs):
            state[node.id] = "skipped"
            continue
        try:
            made |= {(node.id, k): v for k, v in kind.run(inputs, config_of(node, bindings)).items()}
            state[node.id] = "done"
        except Skip:
            state[node.id] = "skipped"
        except Exception as e:
            state[node.id] = f"failed: {e}"
    return made, state


def revision(nodes: list[Node], edges: list[Edge], bindings: dict[str, dict] | None = None) -> str:
    """Equal for equal graphs, whatever their order."""
    shape = {"nodes": sorted([n.id, n.kind, n.config] for n in nodes), "edges": sorted([e.source, e.output, e.target, e.input] for e in edges), "bindings": bindings or {}}
    return hashlib.sha256(json.dumps(shape, sort_keys=True, default=str).encode()).hexdigest()


def to_run(episodes: DataFrame, runs: DataFrame, revision_hash: str) -> DataFrame:
    """Episodes without a run of this revision that is queued, running or done: enqueuing them twice changes nothing."""
    held = runs.filter((F.col("revision") == revision_hash) & F.col("status").isin("queued", "running", "completed"))
    return episodes.join(held, "episode_id", "left_anti")


def upstream(node: str, nodes: list[Node], edges: list[Edge], category: str = "input") -> list[str]:
    """Nodes of a category that a node depends on, nearest first, without what lies beyond them."""
    kinds = {n.id: KINDS[ALIASES.get(n.kind, n.kind)].category for n in nodes}
    seen, found, level = {node}, [], [node]
    while level:
        level = [s for s in dict.fromkeys(e.source for t in level for e in edges if e.target == t) if s not in seen]
        seen |= {*level}
        found += [s for s in level if kinds[s] == category]
        level = [s for s in level if kinds[s] != category]
    return found


def completed(nodes: list[Node], edges: list[Edge], devices: dict[str, str], process: dict[str, str]) -> tuple[list[Node], list[Edge]]:
    """The graph with an input node for each device that has none, joined to a processing node of its kind, one that is
    without an input if there is any."""
    nodes, edges = list(nodes), list(edges)
    have = {n.config.get("device") for n in nodes}
    for device, kind in sorted(devices.items()):
        if device in have:
            continue
        own = Node(f"input_{device}", kind, {"device": device})
        nodes.append(own)
        if kind not in process:
            continue
        free = next((n for n in nodes if n.kind == process[kind] and not any(e.target == n.id for e in edges)), None)
        if free is None:
            free = Node(f"{process[kind]}_{device}", process[kind])
            nodes.append(free)
        edges.append(Edge(own.id, "out", free.id, "frames"))
    return nodes, edges


def claimed(available: set[str], claims: list[Claim]) -> dict[str, list[str]]:
    """The sources of each kind, in the order of the claims; a source goes to one kind only."""
    free = sorted(s.lower() for s in available)
    out: dict[str, list[str]] = {}
    for c in claims:
        own: list[str] = []
        for key in c.keys:
            own += [s for s in free if s not in own and (key.lower() in s or s in key.lower())][:1]
        if not own:
            fits = [s for s in free if (not c.words or any(w in s for w in c.words)) and not any(w in s for w in c.without)]
            own = fits if c.every else fits[:1] if c.words or c.without else []
        out[c.kind] = own
        free = [s for s in free if s not in own]
    return out
