"""Search for the most parsimonious tree. Sites are counted by pattern once; in each round the driver proposes trees, and
one pass of bit masks over the patterns scores them all. Only scores come to the driver.

A tree is a nested pair of columns, rooted beside column 0, the outgroup: ``(0, ((1, 2), 3))``. A parsimony score does not
depend on where the root is.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import settle

Tree = int | tuple

#: The bit of a letter; others may be any base.
BITS = {"A": 1, "C": 2, "G": 4, "T": 8}
MOST_TREES = 4096  # that a pass scores
WIDE = 12  # ingroup taxa up to which a round regrafts every subtree everywhere; beyond, a round swaps neighbours


def site_patterns(matrix: DataFrame) -> DataFrame:
    """pattern (a letter a taxon) and n, of the sites (taxa) that tell trees apart: at least two bases that two taxa have
    each."""
    known = F.filter("taxa", lambda b: b.isin(*BITS))
    telling = F.size(F.filter(F.array(*map(F.lit, BITS)), lambda b: F.size(F.filter(known, lambda x: x == b)) > 1)) > 1
    # what a base is called does not matter to a score: patterns of one form are one
    seen = F.array_distinct(known)
    form = F.transform("taxa", lambda b: F.when(b.isin(*BITS), F.array_position(seen, b)).otherwise(0))
    letters = F.array(F.lit("N"), *map(F.lit, BITS))
    pattern = F.array_join(F.transform(form, lambda i: F.get(letters, i.cast("int"))), "")
    own = settle(_counted(matrix), {"telling": telling}).where("telling").select(pattern.alias("pattern"), "n")
    return own.groupBy("pattern").agg(F.sum("n").alias("n"))


def _counted(matrix: DataFrame) -> DataFrame:
    """Distinct rows of bases and how many sites have them: what is told of a site is told once for all like it. A filter
    on what is told must not move before the count, so it is settled."""
    return matrix.groupBy("taxa").agg(F.count(F.lit(1)).alias("n"))


def constant_changes(matrix: DataFrame) -> DataFrame:
    """One row: the changes that sites which tell no trees apart need on any tree: a base more than the first each."""
    known = F.filter("taxa", lambda b: b.isin(*BITS))
    shared = F.size(F.filter(F.array(*map(F.lit, BITS)), lambda b: F.size(F.filter(known, lambda x: x == b)) > 1))
    return settle(_counted(matrix), {"shared": shared}).where("shared < 2").agg(F.coalesce(F.sum(F.greatest(F.size(F.array_distinct(known)) - 1, F.lit(0)) * F.col("n")), F.lit(0)).cast("long").alias("changes"))


def changes(tree: Tree, masks: np.ndarray) -> np.ndarray:
    """Fitch's changes of each pattern (a row of masks a taxon)."""
    cost = np.zeros(masks.shape[1], np.int64)

    def up(t: Tree) -> np.ndarray:
        if isinstance(t, int):
            return masks[t]
        a, b = up(t[0]), up(t[1])
        both = a & b
        np.add(cost, both == 0, out=cost)
        return np.where(both == 0, a | b, both)

    up(tree)
    return cost


def tree_scores(patterns: DataFrame, trees: list[Tree]) -> DataFrame:
    """tree (its number) and score, in one pass; of at most MOST_TREES."""
    if len(trees) > MOST_TREES:
        raise ValueError(f"{len(trees)} trees are more than {MOST_TREES}")
    table = np.full(256, 15, np.uint8)
    for letter, bit in BITS.items():
        table[ord(letter)] = bit

    def run(batches):
        total = np.zeros(len(trees), np.int64)
        for batch in batches:
            if batch.num_rows:
                text = "".join(batch.column(0).to_pylist()).encode()
                masks = np.ascontiguousarray(table[np.frombuffer(text, np.uint8)].reshape(batch.num_rows, -1).T)
                n = batch.column(1).to_numpy()
                total += [int(changes(t, masks) @ n) for t in trees]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32()), pa.array(total)], names=["tree", "score"])

    return patterns.select("pattern", "n").mapInArrow(run, "tree int, score long").groupBy("tree").agg(F.sum("score").alias("score"))


def score_trees(patterns: DataFrame, trees: list[Tree]) -> list[int]:
    """The score of each tree."""
    found = {r.tree: r.score for r in tree_scores(patterns, trees).collect()}
    return [found.get(i, 0) for i in range(len(trees))]


# ---------------------------------------------------------------- trees


def least(tree: Tree) -> int:
    return tree if isinstance(tree, int) else min(least(tree[0]), least(tree[1]))


def normal(tree: Tree) -> Tree:
    """The same tree with the child of the smaller leaf first."""
    if isinstance(tree, int):
        return tree
    a, b = normal(tree[0]), normal(tree[1])
    return (a, b) if least(a) < least(b) else (b, a)


def places(tree: Tree) -> Iterator[tuple[int, ...]]:
    """Paths to all subtrees, the tree itself first."""
    yield ()
    if not isinstance(tree, int):
        for i in (0, 1):
            yield from ((i, *p) for p in places(tree[i]))


def at(tree: Tree, path: tuple[int, ...]) -> Tree:
    for i in path:
        tree = tree[i]
    return tree


def put(tree: Tree, path: tuple[int, ...], new: Tree) -> Tree:
    if not path:
        return new
    i = path[0]
    own = put(tree[i], path[1:], new)
    return (own, tree[1]) if i == 0 else (tree[0], own)


def grafted(tree: Tree, part: Tree) -> Iterator[Tree]:
    """``part`` on each edge of a tree, the one above it too."""
    for p in places(tree):
        yield put(tree, p, (at(tree, p), part))


def swapped(tree: Tree) -> Iterator[Tree]:
    """Neighbour interchange: on each inner edge, either part below it changes places with the part beside it."""
    for p in places(tree):
        own = at(tree, p)
        if isinstance(own, int):
            continue
        for i in (0, 1):
            below, beside = own[i], own[1 - i]
            if not isinstance(below, int):
                a, b = below
                yield put(tree, p, ((beside, b), a))
                yield put(tree, p, ((a, beside), b))


def regrafted(tree: Tree) -> Iterator[Tree]:
    """Each subtree taken out and put on every other edge."""
    for p in places(tree):
        if p:
            rest = put(tree, p[:-1], at(tree, (*p[:-1], 1 - p[-1])))
            yield from grafted(rest, at(tree, p))


def newick(tree: Tree, names: list[str]) -> str:
    text = lambda t: names[t] if isinstance(t, int) else f"({text(t[0])},{text(t[1])})"
    return text(tree) + ";"


def from_newick(text: str, names: list[str]) -> Tree:
    """A binary tree of all names, rooted beside the first, wherever its root is; a root of three is one of two."""
    from ..plans.tree import parse_newick

    def nest(node) -> Tree:
        if not node.children:
            return names.index(node.name)
        parts = [nest(c) for c in node.children]
        return parts[0] if len(parts) == 1 else (parts[0], parts[1]) if len(parts) == 2 else tuple(parts)

    tree = nest(parse_newick(text))
    if isinstance(tree, tuple) and len(tree) == 3:
        tree = ((tree[0], tree[1]), tree[2])
    seen: list[int] = []

    def check(t: Tree) -> None:
        if isinstance(t, int):
            seen.append(t)
        elif len(t) != 2:
            raise ValueError("the tree is not binary")
        else:
            check(t[0])
            check(t[1])

    check(tree)
    if sorted(seen) != list(range(len(names))):
        raise ValueError("the tree's leaves are not the given names")
    above: Tree | None = None  # what lies on the other side of the root, as it moves down to the first leaf
    while tree != 0:
        i = 0 if least(tree[0]) == 0 else 1
        above = tree[1 - i] if above is None else (tree[1 - i], above)
        tree = tree[i]
    return 0 if above is None else (0, normal(above))


# ---------------------------------------------------------------- the search


def search(patterns: DataFrame, n_taxa: int, starts: int = 4, seed: int = 1, given: Tree | None = None) -> tuple[Tree, int]:
    """The best tree found and its score over ``patterns``: trees grown taxon by taxon in several orders, and the given
    one, climb together, each round in one pass. Equal scores go to the tree that is smaller as text."""
    best_of = lambda found: min(found, key=lambda x: (x[1], str(x[0])))

    def scored(trees) -> list[tuple[Tree, int]]:
        own, out = list(dict.fromkeys(map(normal, trees))), []
        for i in range(0, len(own), MOST_TREES):
            out += zip(own[i : i + MOST_TREES], score_trees(patterns, own[i : i + MOST_TREES]))
        return out

    ingroup = list(range(1, n_taxa))
    if n_taxa < 4:
        tree = ingroup[0] if ingroup else 0
        for t in ingroup[1:]:
            tree = (tree, t)
        tree = (0, tree) if ingroup else 0
        return tree, scored([tree])[0][1]
    rng = random.Random(seed)
    orders = [ingroup, *(rng.sample(ingroup, len(ingroup)) for _ in range(starts - 1))]
    grown: list[Tree] = [(o[0], o[1]) for o in orders]
    for k in range(2, len(ingroup)):
        options = [[(0, normal(t)) for t in grafted(tree, o[k])] for tree, o in zip(grown, orders)]
        found = dict(scored([t for own in options for t in own]))
        grown = [best_of((t, found[normal(t)]) for t in own)[0][1] for own in options]
    now = scored([*((0, t) for t in grown), *([given] if given is not None else [])])
    moves = regrafted if n_taxa <= WIDE + 1 else swapped
    done: dict[Tree, int] = {}
    while now:
        near = {t: [(0, normal(x)) for x in moves(t[1])] for t, _ in now}
        found = dict(scored([x for own in near.values() for x in own]))
        better = {}
        for t, s in now:
            x, sx = best_of((x, found[normal(x)]) for x in near[t])
            if sx < s:
                better[normal(x)] = sx
            else:
                done[t] = s
        now = list(better.items())
    return best_of(done.items())
