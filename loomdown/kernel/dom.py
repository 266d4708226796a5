"""A mutable tree of document nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Node:
    __slots__ = ("attrs", "foreign", "grown", "hint", "kids", "kind", "name", "parent", "text")

    def __init__(self, kind: str, name: str = "", attrs: dict[str, str] | None = None, text: str = ""):
        self.kind, self.name, self.attrs, self.text = kind, name, attrs or {}, text
        self.kids: list[Node] = []
        self.parent: Node | None = None
        self.foreign = False
        self.grown = 0  # children put in less those taken out, other than at the end
        self.hint = 0  # its place among its siblings when last seen, less its parent's `grown` then

    @classmethod
    def element(cls, name: str, *kids: Node) -> Node:
        node = cls("element", name)
        detach_all(kids)
        for k in kids:
            node.append(k)
        return node

    @classmethod
    def of_text(cls, text: str) -> Node:
        return cls("text", text=text)

    def place(self) -> int:
        """Searched outwards from where it should be if all changes since it was last seen were before it."""
        kids = self.parent.kids
        low = high = max(0, min(self.hint + self.parent.grown, len(kids) - 1))
        while low >= 0 or high < len(kids):
            for i in (low, high):
                if 0 <= i < len(kids) and kids[i] is self:
                    self.hint = i - self.parent.grown
                    return i
            low, high = low - 1, high + 1
        raise ValueError("not among its parent's children")

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.kids[self.place()]
            self.parent.grown -= 1
            self.parent = None

    def append(self, node: Node) -> None:
        node.detach()
        self.take(node)

    def take(self, node: Node) -> None:
        """Appends a node without a parent."""
        node.parent, node.hint = self, len(self.kids) - self.grown
        self.kids.append(node)

    def put_before(self, *nodes: Node) -> None:
        """Moves the nodes to just before this one."""
        detach_all(nodes)
        at, up = self.place(), self.parent
        up.kids[at:at] = nodes
        up.grown += len(nodes)
        for i, node in enumerate(nodes, at):
            node.parent, node.hint = up, i - up.grown

    def unwrap(self) -> None:
        """Leaves the children in the node's place."""
        self.put_before(*list(self.kids))
        self.detach()

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in document order; the tree must not change meanwhile."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.kids:
                stack += node.kids[::-1]

    def all(self) -> list[Node]:
        """The nodes of walk(), as a list that survives changes."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            if node.kids:
                stack += node.kids[::-1]
        return out

    def below(self) -> Iterator[Node]:
        nodes = self.walk()
        next(nodes)
        return nodes

    def named(self, *names: str) -> list[Node]:
        """The elements of these names, at or below the node, as a list that survives changes."""
        return [n for n in self.all() if n.name in names and n.kind == "element"]

    def full_text(self) -> str:
        return "".join([n.text for n in self.all() if n.kind == "text"])

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def depth(self) -> int:
        return sum(1 for _ in self.above())


def detach_all(nodes: Iterable[Node]) -> None:
    """Takes many nodes out of their parents, in time that grows with their number and those parents' children."""
    by_parent: dict[int, list[Node]] = {}
    for node in nodes:
        if node.parent is not None:
            by_parent.setdefault(id(node.parent), []).append(node)
    for own in by_parent.values():
        if len(own) < 4:
            for node in own:
                node.detach()
            continue
        up, gone = own[0].parent, set(map(id, own))
        up.kids = [k for k in up.kids if id(k) not in gone]
        up.grown -= len(own)
        for i, kid in enumerate(up.kids):
            kid.hint = i - up.grown
        for node in own:
            node.parent = None
