"""A compressed radix (Patricia) trie over byte strings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo : lo + 1] != b[lo : lo + 1] else lo + 1


class Node:
    """``edges``: first byte -> (label, child).  ``owner`` is set where a string ends."""

    __slots__ = ("edges", "owner")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.owner: Any = None


class Trie:
    """Byte strings with a value at each terminal node; ``held`` is the bytes of its labels."""

    #: Rough bytes of a node besides its label.
    NODE = 300

    def __init__(self) -> None:
        self.root, self.held, self.size = Node(), 0, 0

    def node(self, key: bytes) -> Node:
        """The terminal node of ``key``, made by splitting an edge where needed."""
        at, pos = self.root, 0
        while pos < len(key):
            edge = at.edges.get(key[pos])
            if edge is None:
                leaf = Node()
                at.edges[key[pos]] = (key[pos:], leaf)
                self.held += len(key) - pos + self.NODE
                return leaf
            label, child = edge
            if key.startswith(label, pos):
                at, pos = child, pos + len(label)
                continue
            cut = shared_prefix(label, key[pos : pos + len(label)])
            middle = Node()
            middle.edges[label[cut]] = (label[cut:], child)
            at.edges[key[pos]] = (label[:cut], middle)
            self.held += self.NODE
            at, pos = middle, pos + cut
        return at

    def items(self) -> Iterator[tuple[bytes, Any]]:
        """Every string with its value, without recursion."""
        stack = [(b"", self.root)]
        while stack:
            prefix, at = stack.pop()
            if at.owner is not None:
                yield prefix, at.owner
            stack += [(prefix + label, child) for label, child in at.edges.values()]
