"""Rooted trees: Newick, indices, clades, rerooting. Trees are small and stay on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Node:
    name: str = ""
    children: list[Node] = field(default_factory=list)
    length: float | None = None
    label: str = ""  # the name for outputs

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if not n.children]

    def walk(self) -> Iterator[Node]:
        """Parents first."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.children)

    def post(self) -> Iterator[Node]:
        """Children first, in order."""
        for c in self.children:
            yield from c.post()
        yield self

    def newick(self, attr: str = "name") -> str:
        return self._text(attr) + ";"

    def _text(self, attr: str) -> str:
        inner = f"({','.join(c._text(attr) for c in self.children)})" if self.children else ""
        return inner + getattr(self, attr) + (f":{self.length:g}" if self.length is not None else "")


def parse_newick(text: str) -> Node:
    """A tree of any number of children a node; names, lengths and comments in brackets are allowed."""
    parts = re.findall(r"[(),:;]|[^(),:;\s]+", re.sub(r"\[[^\]]*\]", "", text))
    root = cur = Node()
    stack: list[Node] = []
    i = 0
    while i < len(parts):
        p = parts[i]
        if p == "(":
            new = Node()
            cur.children.append(new)
            stack.append(cur)
            cur = new
        elif p == ",":
            if not stack:
                raise ValueError("a comma outside of brackets")
            cur = Node()
            stack[-1].children.append(cur)
        elif p == ")":
            if not stack:
                raise ValueError("a bracket too many")
            cur = stack.pop()
        elif p == ":":
            i += 1
            cur.length = float(parts[i])
        elif p == ";":
            break
        else:
            cur.name = p
        i += 1
    if stack:
        raise ValueError("a bracket is missing")
    return root


def species_of(text: str) -> tuple[list[tuple[str, str]], str]:
    """(species, accession) of each leaf ``species|accession``, and the outgroup: the root's first single leaf."""
    root = parse_newick(text)
    pairs = [tuple((n.name.split("|", 1) + [""])[:2]) for n in root.leaves()]
    alone = [c for c in root.children if not c.children]
    if not alone:
        raise ValueError("no child of the root is a single leaf, so there is no outgroup")
    return pairs, alone[0].name.split("|", 1)[0]


def index_leaves(root: Node, outgroup: str) -> dict[str, int]:
    """The outgroup is 0, the other leaves follow in order; inner nodes without a label get Node(i), children first."""
    names = [n.name for n in root.leaves()]
    if outgroup not in names:
        raise ValueError(f"{outgroup} is no leaf")
    out = {outgroup: 0} | {n: i for i, n in enumerate((x for x in names if x != outgroup), 1)}
    i = len(out)
    for n in root.post():
        if not n.children:
            n.label = n.label or n.name
        else:
            n.label = n.label or (n.name or ("ROOT" if n is root else f"Node({i})"))
            i += 1
    return out


def phylip_edges(outfile: str) -> list[tuple[str, str]]:
    """(from, to) of the table under ``between  and  length``."""
    out, inside = [], False
    for line in outfile.splitlines():
        words = line.split()
        if [w.lower() for w in words[:2]] == ["between", "and"]:
            inside, out = True, []
        elif inside and len(words) >= 2 and not set(words[0]) <= {"-"}:
            out.append((words[0], words[1]))
        elif inside and out and not words:
            break
    return out


def phylip_tree(outtree: str) -> str:
    """The first tree of a file that may begin with a count and wrap its lines."""
    joined = "".join(outtree.split())
    return joined[joined.index("(") : joined.index(";") + 1]


def parsimony_of(outfile: str) -> float | None:
    found = re.search(r"requires a total of\s+([\d.]+)", outfile)
    return float(found[1]) if found else None


def clades(edges: list[tuple[str, str]], outgroup: str) -> dict[str, frozenset[str]]:
    """Leaves below each inner node, seen from the outgroup's tip."""
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out: dict[str, frozenset[str]] = {}

    def below(node: str, parent: str) -> frozenset[str]:
        rest = [n for n in near[node] if n != parent]
        if not rest:
            return frozenset([node])
        found = frozenset().union(*(below(n, node) for n in rest))
        out[node] = found
        return found

    for n in near.get(outgroup, []):
        below(n, outgroup)
    return {k: v for k, v in out.items() if outgroup not in v and len(v) < len(near)}


def reroot(root: Node, outgroup: str) -> Node:
    """The tree with the outgroup as the root's last child, the rest as the first."""
    near: dict[int, list[Node]] = {}
    nodes = list(root.walk())
    for n in nodes:
        for c in n.children:
            near.setdefault(id(n), []).append(c)
            near.setdefault(id(c), []).insert(0, n)
    tip = next(n for n in nodes if not n.children and n.name == outgroup)

    def build(node: Node, parent: Node) -> list[Node]:
        rest = [n for n in near[id(node)] if n is not parent]
        kids = [k for n in rest for k in build(n, node)]
        if not node.children and not rest:
            return [Node(node.name)]
        return kids if len(kids) == 1 else [Node(node.name, kids)]

    start = near[id(tip)][0]
    rest = build(start, tip)
    return Node("", [*rest, Node(outgroup)])


def from_phylip(outtree: str, outfile: str, species: dict[str, str], outgroup: str) -> Node:
    """A PHYLIP tree with species' names, rooted on the outgroup, inner nodes named by the same sets of leaves."""
    root = reroot(parse_newick(phylip_tree(outtree)), outgroup)
    sets = {v: k for k, v in clades(phylip_edges(outfile), outgroup).items()}
    for i, n in enumerate(root.post()):
        if n.children:
            own = frozenset(x.name for x in n.leaves())
            n.label = "ROOT" if n is root else sets.get(own, f"Node({i})")
    for n in root.leaves():
        n.label = n.name = species.get(n.name, n.name)
    return root


@dataclass
class Flat:
    """Nodes in an order with parents first: parent's place, the leaf's column (-1 for inner nodes) and label."""

    parent: list[int]
    column: list[int]
    label: list[str]
    children: list[list[int]]

    @classmethod
    def of(cls, root: Node, columns: dict[str, int]) -> Flat:
        nodes = list(root.walk())
        at = {id(n): i for i, n in enumerate(nodes)}
        parent = [-1] * len(nodes)
        for n in nodes:
            for c in n.children:
                parent[at[id(c)]] = at[id(n)]
        return cls(parent, [-1 if n.children else columns[n.name] for n in nodes], [n.label or n.name for n in nodes], [[at[id(c)] for c in n.children] for n in nodes])
