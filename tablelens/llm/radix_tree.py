"""An adaptive radix tree over byte strings: inner nodes grow through four layouts, and paths without a branch are compressed."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Few children: their bytes in order beside them."""

    __slots__ = ("bytes", "children", "room")

    def __init__(self, room: int) -> None:
        self.bytes, self.children, self.room = bytearray(), [], room

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, child: Node) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
        else:
            self.bytes.insert(at, byte)
            self.children.insert(at, child)

    def full(self) -> bool:
        return len(self.children) == self.room

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.children)


class Indexed:
    """Up to 48 children: a table of 256 bytes says where a child stands."""

    __slots__ = ("place", "children")
    room = 48

    def __init__(self) -> None:
        self.place, self.children = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.place[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child: Node) -> None:
        if self.place[byte]:
            self.children[self.place[byte] - 1] = child
        else:
            self.children.append(child)
            self.place[byte] = len(self.children)

    def full(self) -> bool:
        return len(self.children) == self.room

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.children[at - 1]) for b, at in enumerate(self.place) if at)


class Direct:
    """Many children: one place per byte."""

    __slots__ = ("children",)
    room = 256

    def __init__(self) -> None:
        self.children: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        self.children[byte] = child

    def full(self) -> bool:
        return False

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, c) for b, c in enumerate(self.children) if c is not None)


Layout = Sorted | Indexed | Direct


def _grown(layout: Layout | None) -> Layout:
    if layout is None:
        return Sorted(4)
    larger: Layout = Sorted(16) if layout.room == 4 else Indexed() if layout.room == 16 else Direct()
    for byte, child in layout.items():
        larger.put(byte, child)
    return larger


class Node:
    """``prefix``: bytes after the one that led here; ``value``: of the key that ends here, if one does."""

    __slots__ = ("prefix", "value", "layout")

    def __init__(self, prefix: bytes, value: int | None = None) -> None:
        self.prefix, self.value, self.layout = prefix, value, None

    def get(self, byte: int) -> Node | None:
        return self.layout.get(byte) if self.layout else None

    def put(self, byte: int, child: Node) -> None:
        if self.layout is None or self.layout.full() and self.layout.get(byte) is None:
            self.layout = _grown(self.layout)
        self.layout.put(byte, child)

    def items(self) -> Iterator[tuple[int, Node]]:
        return self.layout.items() if self.layout else iter(())


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike, found by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Keys may be prefixes of one another; a key put again gets the later value."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def put(self, key: bytes, value: int) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at, above, led = self.root, 0, None, 0
        while True:
            same = common(node.prefix, key[at : at + len(node.prefix)])
            if same < len(node.prefix):  # the key leaves a compressed path, which is cut here
                upper = Node(node.prefix[:same])
                upper.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(led, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.get(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, led, node, at = node, key[at], child, at + 1

    def get(self, key: bytes) -> int | None:
        node, at = self.root, 0
        while node is not None:
            if key[at : at + len(node.prefix)] != node.prefix:
                return None
            at += len(node.prefix)
            if at == len(key):
                return node.value
            node, at = node.get(key[at]), at + 1
        return None

    def bottom_up(self) -> Iterator[tuple[Node, Node | None, int, int]]:
        """Every node after all below it: the node, the one above, the byte depths where its path begins and ends."""
        if self.root is None:
            return
        stack = [(self.root, None, 0, len(self.root.prefix), iter(self.root.items()))]
        while stack:
            node, above, begin, end, rest = stack[-1]
            for _, child in rest:
                stack.append((child, node, end, end + 1 + len(child.prefix), iter(child.items())))
                break
            else:
                stack.pop()
                yield node, above, begin, end
