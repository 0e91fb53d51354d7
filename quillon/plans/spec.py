"""The declaration of a model graph, kept as JSON.

``{"version": "0.1.0", "inputs": [...], "schema": [...], "functions": {...},
"constants": {...}, "nodes": [...], "outputs": [...], "verification": [...]}``

A node names an operator (``core.Clip``, ``model.Linear``), its inputs, its
outputs and attributes; an attribute ``{"const": name}`` stands for a
constant. The operator ``composite`` has nodes of its own, which see only
what ``bind`` hands in and hand out only what ``expose`` names.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..functions.expressions import BadFormat, GraphError, UserFunction

SUPPORTED = (0, 1)
ROLES = ("prediction", "probability", "score", "confidence", "decision", "distance", "cluster", "transformed", "label", "rank", "entity", "leaf", "other")
TYPES = ("number", "string", "tokens")


@dataclass
class Input:
    """name in the graph; column in the data (the same by default); width over 1 is an array column."""

    name: str
    type: str = "number"
    width: int = 1
    column: str | None = None


@dataclass
class Output:
    name: str
    role: str = ""
    value: str | None = None


@dataclass
class Node:
    op: str
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    nodes: list[Node] = field(default_factory=list)
    bind: dict[str, str] = field(default_factory=dict)
    expose: dict[str, str] = field(default_factory=dict)


@dataclass
class Feature:
    """A feature's policies (see functions.policies), applied to an input of that name."""

    name: str
    policy: dict


def feature_range(prefix: str, first: int, last: int, digits: int = 0) -> list[str]:
    """Names of a numbered range, e.g. x01, x02."""
    return [f"{prefix}{i:0{digits}d}" for i in range(first, last + 1)]


def _node(d: Mapping) -> Node:
    known = {"op", "inputs", "outputs", "attrs", "nodes", "bind", "expose"}
    if extra := set(d) - known:
        raise GraphError(f"a node has unknown fields: {', '.join(sorted(extra))}")
    one = lambda v: [v] if isinstance(v, str) else list(v)
    return Node(d["op"], one(d.get("inputs", ())), one(d.get("outputs", ())), dict(d.get("attrs", {})), [_node(n) for n in d.get("nodes", ())], dict(d.get("bind", {})), dict(d.get("expose", {})))


@dataclass
class Graph:
    inputs: list[Input]
    nodes: list[Node]
    outputs: list[Output]
    schema: list[Feature] = field(default_factory=list)
    functions: dict[str, UserFunction] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    verification: list[dict] = field(default_factory=list)
    version: str = "0.1.0"
    name: str = ""

    @classmethod
    def of(cls, d: Mapping) -> Graph:
        inputs = [Input(i) if isinstance(i, str) else Input(**i) for i in d.get("inputs", ())]
        outputs = [Output(o) if isinstance(o, str) else Output(**o) for o in d.get("outputs", ())]
        schema = [Feature(f["name"], {k: v for k, v in f.items() if k != "name"}) for f in d.get("schema", ())]
        functions = {k: UserFunction(tuple(f.get("params", ())), f["body"]) for k, f in d.get("functions", {}).items()}
        graph = cls(inputs, [_node(n) for n in d.get("nodes", ())], outputs, schema, functions, dict(d.get("constants", {})), list(d.get("verification", ())), d.get("version", ""), d.get("name", ""))
        graph.check()
        return graph

    def check(self) -> None:
        """Raises on what can't be compiled; only warns of an unsupported version, as the graph may well run."""
        names = [i.name for i in self.inputs]
        if len(set(names)) != len(names):
            raise GraphError("two inputs have one name")
        for i in self.inputs:
            if i.type not in TYPES or i.width < 1:
                raise GraphError(f"input {i.name}: unknown type {i.type}, or no width")
        if not self.outputs:
            raise GraphError("there are no outputs")
        for o in self.outputs:
            if o.role and o.role not in ROLES:
                raise GraphError(f"output {o.name}: unknown role {o.role}")
        parts = self.version.split(".")
        if not self.version or not all(p.isdigit() for p in parts) or tuple(map(int, parts[:2])) != SUPPORTED:
            warnings.warn(f"graph format {self.version or 'unknown'} is not {'.'.join(map(str, SUPPORTED))}.x", stacklevel=3)

    def to_dict(self) -> dict:
        d = asdict(self)
        d["schema"] = [{"name": f.name, **f.policy} for f in self.schema]
        d["functions"] = {k: {"params": list(f.params), "body": f.body} for k, f in self.functions.items()}
        return d

    @classmethod
    def loads(cls, data: str | bytes) -> Graph:
        try:
            return cls.of(json.loads(data))
        except (json.JSONDecodeError, UnicodeDecodeError) as e:
            raise BadFormat(f"this is no model graph: {e}") from e

    @classmethod
    def load(cls, path: str) -> Graph:
        return cls.loads(Path(path).read_bytes())

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict()))
