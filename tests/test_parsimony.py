"""The search for a tree against all trees of a few taxa, scored site by site."""

import json
import random

import pytest

from helixframe.operators import fitch
from helixframe.operators import parsimony as P
from helixframe.plans import cli, runs
from helixframe.plans import tree as T

NAMES = [f"taxa{i}" for i in range(7)]


def all_trees(n):
    trees = [(1, 2)]
    for k in range(3, n):
        trees = [t for tree in trees for t in P.grafted(tree, k)]
    return [(0, P.normal(t)) for t in trees]


def site_changes(tree, site):
    """One site, by sets."""
    def up(t):
        if isinstance(t, int):
            return {site[t]} if site[t] in "ACGT" else set("ACGT"), 0
        (a, x), (b, y) = up(t[0]), up(t[1])
        return (a & b, x + y) if a & b else (a | b, x + y + 1)

    return up(tree)[1]


def evolved(rng, tree, n, rate):
    """Sites that change along a tree."""
    def down(t, base, out):
        base = rng.choice("ACGT") if rng.random() < rate else base
        if isinstance(t, int):
            out[t] = base if rng.random() > 0.02 else "N"
        else:
            down(t[0], base, out)
            down(t[1], base, out)

    for _ in range(n):
        out = {}
        down(tree, rng.choice("ACGT"), out)
        yield [out[i] for i in range(len(out))]


def frame(spark, sites):
    return spark.createDataFrame([("c", i, "A", "C", s) for i, s in enumerate(sites)], "chrom string, pos int, left string, right string, taxa array<string>").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_all_trees(spark, tmp_path, seed):
    rng = random.Random(seed)
    trees = all_trees(7)
    assert len(trees) == len(set(trees)) == 945
    sites = list(evolved(rng, rng.choice(trees), 60, 0.4))  # noisy: many trees are near the best
    want = {t: sum(site_changes(t, s) for s in sites) for t in trees}
    got = runs.search_tree(spark, frame(spark, sites), NAMES, str(tmp_path), P.newick(trees[0], NAMES))["phylip"]
    assert got["score"] == min(want.values()) and got["given_score"] == want[trees[0]]
    assert want[P.from_newick(got["tree"], NAMES)] == got["score"] and got["ratio"] == got["given_score"] / got["score"]
    assert (tmp_path / "outtree").read_text().strip() == got["tree"]
    matrix = frame(spark, [[b if b != "N" else "A" for b in s] for s in sites])
    root = T.parse_newick(got["tree"])
    columns = {n: i for i, n in enumerate(NAMES)}
    plain = sum(site_changes(P.from_newick(got["tree"], NAMES), [b if b != "N" else "A" for b in s]) for s in sites)
    assert fitch.score(matrix, T.Flat.of(root, columns)).first().score == plain


def test_many_trees_in_one_pass(spark):
    rng = random.Random(3)
    trees = all_trees(6)
    sites = list(evolved(rng, trees[50], 200, 0.3))
    patterns = P.site_patterns(frame(spark, sites))
    constant = P.constant_changes(frame(spark, sites)).first().changes
    assert [s + constant for s in P.score_trees(patterns, trees)] == [sum(site_changes(t, s) for s in sites) for t in trees]
    assert patterns.count() < len({"".join(s) for s in sites})


def test_more_taxa_by_swaps(spark, monkeypatch):
    """Beyond WIDE the climb swaps neighbours; clean data give their own tree."""
    monkeypatch.setattr(P, "WIDE", 3)
    tree = (0, P.normal(((1, (2, 3)), ((4, 5), (6, (7, 8))))))
    sites = [s for s in evolved(random.Random(5), tree, 4000, 0.03)]
    found, _ = P.search(P.site_patterns(frame(spark, sites)), 9, 2)
    assert found == tree


def test_trees_as_text():
    rng = random.Random(6)
    for tree in rng.sample(all_trees(7), 40):
        text = P.newick(tree, NAMES)
        assert P.from_newick(text, NAMES) == tree
    # rooted elsewhere, and in three parts
    assert P.from_newick("((taxa2,taxa3),(taxa0,taxa1));", NAMES[:4]) == (0, (1, (2, 3)))
    assert P.from_newick("((taxa2:1,taxa3:2):1,taxa1,taxa0);", NAMES[:4]) == (0, (1, (2, 3)))
    with pytest.raises(ValueError, match="leaves"):
        P.from_newick("(taxa0,taxa1);", NAMES[:3])


def test_few_taxa_and_no_sites(spark, tmp_path):
    for n in (1, 2, 3):
        assert P.search(P.site_patterns(frame(spark, [["A"] * n])), n)[1] == 0
    assert runs.search_tree(spark, frame(spark, []), NAMES[:5], str(tmp_path), P.newick(all_trees(5)[0], NAMES))["phylip"]["ratio"] == 1.0


def test_command_line(spark, tmp_path):
    sites = list(evolved(random.Random(8), all_trees(5)[7], 300, 0.2))
    rows = ["chromosome,position,left,right,taxa0,taxa1,taxa2,taxa3,taxa4", *(",".join(["c", str(i), "A", "C", *s]) for i, s in enumerate(sites))]
    (tmp_path / "m.csv").write_text("\n".join(rows) + "\n")
    names = ["out", "b", "c", "d", "e"]
    assert cli.main(["phylip", "--matrix", str(tmp_path / "m.csv"), "--species-list", json.dumps(names), "--out", str(tmp_path / "o"), "--newick", "(out,(b,(c,(d,e))));"]) == 0
    got = json.loads((tmp_path / "o/run_summary.json").read_text())["phylip"]
    assert got["score"] == min(sum(site_changes(t, s) for s in sites) for t in all_trees(5)) <= got["given_score"]
