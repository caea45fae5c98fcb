"""Trees, parsimony and PHYLIP formats."""

import random

import pytest

from helixframe.operators import fitch
from helixframe.plans import tree as T



def drawn(seed):
    """A tree of five to eight species with nodes of two or three children, and an outgroup."""
    rng = random.Random(seed)
    parts = [f"s{i}" for i in range(rng.randint(4, 7))]
    while len(parts) > 1:
        rng.shuffle(parts)
        k = min(len(parts), 2 if seed % 2 else rng.choice((2, 3)))
        parts = [f"({','.join(parts[:k])})", *parts[k:]]
    return f"({parts[0]},outg);"


def recursive(node, bases, parent, label, out):
    """Sets and states the plain way; out gets (branch, old, new) and points that couldn't be resolved."""

    def up(n):
        if not n.children:
            return {bases[n.name]}
        sets = [up(c) for c in n.children]
        cur = sets[0]
        for s in sets[1:]:
            cur = cur & s or cur | s
        return cur

    own = up(node)
    if parent is None:
        if len(own) > 1:
            out.append(None)
            return
        state = next(iter(own))
    elif parent in own:
        state = parent
    elif len(own) > 1:
        out.append(None)
        return
    else:
        state = next(iter(own))
        out.append((f"{label}→{node.label}", parent, state))
    for c in node.children:
        recursive(c, bases, state, node.label, out)


@pytest.mark.parametrize("seed", range(4))
def test_fitch(spark, seed):
    rng = random.Random(seed)
    root = T.parse_newick(drawn(seed))
    columns = T.index_leaves(root, "outg")
    rows = [("c", i, "A", "G", [rng.choice("AACGT") for _ in columns]) for i in range(200)]
    frame = spark.createDataFrame(rows, "chrom string, pos int, left string, right string, taxa array<string>")
    got = {r["pos"]: r for r in fitch.resolve(frame, T.Flat.of(root, columns)).collect()}
    n = 0
    for _, pos, _, _, taxa in rows:
        out = []
        recursive(root, {name: taxa[k] for name, k in columns.items()}, None, "", out)
        assert sorted((c["branch"], c["old"], c["new"]) for c in got[pos]["changes"]) == sorted(x for x in out if x)
        assert got[pos]["ambiguous"] == out.count(None)
        n += len([x for x in out if x])
    assert n > 50


def test_newick():
    root = T.parse_newick("((a|X1:0.1,b|X2:0.2)n:0.5,c|X3);")
    assert T.species_of("((a|X1:0.1,b|X2:0.2)n:0.5,c|X3);") == ([("a", "X1"), ("b", "X2"), ("c", "X3")], "c")
    assert root.newick() == "((a|X1:0.1,b|X2:0.2)n:0.5,c|X3);"
    for bad in ("((a,b);", "a,b;", "(a,b));"):
        with pytest.raises(ValueError):
            T.parse_newick(bad)
    with pytest.raises(ValueError):
        T.species_of("((a,b),(c,d));")


#: Six taxa: 12 = (taxa1, 13), 13 = (taxa2, taxa3), 14 = (taxa4, taxa5).
EDGES = [(11, "taxa0"), (11, 12), (12, "taxa1"), (12, 13), (13, "taxa2"), (13, "taxa3"), (11, 14), (14, "taxa4"), (14, "taxa5")]
OUTFILE = "\nrequires a total of     31.000\n\n  between      and       length\n  -------      ---       ------\n" + "".join(f"    {a:>3}   {b:>10}   0.25\n" for a, b in EDGES) + "\nend\n"


def test_phylip():
    edges = T.phylip_edges(OUTFILE)
    assert len(edges) == len(EDGES) and T.parsimony_of(OUTFILE) == 31.0
    assert {k: v for k, v in T.clades(edges, "taxa0").items() if k != "11"} == {"12": {"taxa1", "taxa2", "taxa3"}, "13": {"taxa2", "taxa3"}, "14": {"taxa4", "taxa5"}}
    text = "1\n((taxa1:0.25,(taxa2:0.25,\ntaxa3:0.25):0.25):0.25,(taxa4:0.25,taxa5:0.25):0.25,taxa0:0.25);"
    root = T.from_phylip(text, OUTFILE, {f"taxa{i}": f"name{i}" for i in range(6)}, "taxa0")
    inner = {n.label: {x.name for x in n.leaves()} for n in root.walk() if n.children and n is not root}
    assert root.label == "ROOT" and inner["12"] == {"name1", "name2", "name3"} and inner["13"] == {"name2", "name3"} and inner["14"] == {"name4", "name5"}
    assert sorted(n.name for n in root.leaves()) == [f"name{i}" for i in range(6)] and root.children[-1].name == "name0"
