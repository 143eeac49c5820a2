"""Fused single-precision expressions: a small tree over input columns that becomes one projection.

Spark's whole-stage code evaluates the tree in one loop without intermediate columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a tree. Fixed values.
INPUTS, DEPTH, NODES = 8, 64, 1024


@dataclass(frozen=True)
class Node:
    """An operation on other nodes; ``value`` is an input's number or a constant."""

    op: str
    args: tuple[Node, ...] = ()
    value: float | int | None = None

    def size(self) -> tuple[int, int, int]:
        """Nodes, depth, inputs used."""
        parts = [a.size() for a in self.args]
        own = int(self.value) + 1 if self.op == "input" else 0
        return 1 + sum(p[0] for p in parts), 1 + max((p[1] for p in parts), default=0), max([own, *(p[2] for p in parts)])


def input_(number: int) -> Node:
    return Node("input", (), number)


def constant(value: float) -> Node:
    return Node("constant", (), value)


def absolute(x: Node) -> Node:
    return Node("abs", (x,))


def add(x: Node, y: Node) -> Node:
    return Node("add", (x, y))


def multiply(x: Node, y: Node) -> Node:
    return Node("multiply", (x, y))


def minimum(x: Node, y: Node) -> Node:
    return Node("min", (x, y))


def maximum(x: Node, y: Node) -> Node:
    return Node("max", (x, y))


def relu(x: Node) -> Node:
    return maximum(x, constant(0.0))


def compile_(tree: Node, *inputs: Column) -> Column:
    """The tree over columns, every step in single precision; ValueError beyond the bounds."""
    nodes, depth, used = tree.size()
    if nodes > NODES or depth > DEPTH or used > INPUTS or used > len(inputs):
        raise ValueError("the expression is too large or lacks inputs")
    make = {"abs": F.abs, "add": lambda a, b: a + b, "multiply": lambda a, b: a * b, "min": F.least, "max": F.greatest}

    def build(n: Node) -> Column:
        if n.op == "input":
            return inputs[int(n.value)].cast("float")
        if n.op == "constant":
            return F.lit(float(n.value)).cast("float")
        return make[n.op](*map(build, n.args)).cast("float")

    return build(tree)
