import random

import pytest
from pyspark.sql import functions as F

from quillion.operators import similarity
from quillion.operators.components import connected_components
from quillion.operators.findings import Config, findings
from quillion.operators.volume import volume
from quillion.sources.extract import with_sizes

SCHEMA = "path string, kind string, line_start int, line_end int, raw string, line_above string"


def blocks(spark, rows):
    return with_sizes(spark.createDataFrame([(p, k, a, z, raw, above) for p, k, a, z, raw, above in rows], SCHEMA))


def comment(path, words, above=None, start=1, lines=2, kind="comment"):
    return (path, kind, start, start + lines - 1, " ".join(words), above)


W = [f"w{i}" for i in range(24)]


def told(found):
    return sorted(
        (tuple((m.path, m.line_start) for m in r.members), (r.weakest_first.path, r.weakest_second.path), round(r.weakest_score, 6)) for r in found.collect()
    )


def test_chain_keeps_its_weakest_link(spark):
    left = ["x0", "x1", *W[2:]]
    right = [*W[:21], "y0", "y1", "y2"]
    got = told(similarity.clusters(blocks(spark, [comment("a.py", left), comment("b.py", W), comment("c.py", right)])))
    assert got == [((("a.py", 1), ("b.py", 1), ("c.py", 1)), ("b.py", "c.py"), 0.76)]


def test_boundary_copies_and_floor(spark):
    base = W[:16]
    rows = [comment("a.py", base), comment("b.py", base), comment("c.py", base[:12]), comment("one.py", base, lines=1), comment("few.py", base[:7]), comment("few2.py", base[:7])]
    assert told(similarity.clusters(blocks(spark, rows))) == [((("a.py", 1), ("b.py", 1)), ("a.py", "b.py"), 1.0)]
    assert told(similarity.clusters(blocks(spark, [comment("a.py", base), comment("a.py", base)]))) == []
    assert told(similarity.clusters(blocks(spark, []))) == []


def brute(rows):
    """Members, weakest pair and score by comparing everything."""
    big = sorted({(r[0], r[2], r[4]) for r in rows if len(r[4].split()) >= 8 and r[3] > r[2]})
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for *_, t in big]
    parent = list(range(len(big)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    edges = []
    for i in range(len(big)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.75:
                edges.append((s, j, i))
                parent[root(i)] = root(j)
    out = []
    for r in {root(i) for i in range(len(big))}:
        m = [i for i in range(len(big)) if root(i) == r]
        if len(m) > 1:
            s, a, b = min(e for e in edges if root(e[1]) == r)
            out.append((tuple((big[i][0], big[i][1]) for i in m), (big[a][0], big[b][0]), round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_random_corpora_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(40):
        t = [r.choice(W[:5]) for _ in range(r.randint(6, 12))] if i < 8 or r.random() < 0.3 else list(r.choice(rows)[4].split())
        if r.random() < 0.6:
            t[r.randrange(len(t))] = r.choice(W)
        rows.append(comment(f"f{i:02d}.py", t))
    rows += rows[:3]
    r.shuffle(rows)
    assert told(similarity.clusters(blocks(spark, rows).repartition(3))) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "l long, r long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "l long, r long")).count() == 0


def test_volume_boundary(spark):
    rows = [comment("c150.py", ["w"] * 150), comment("c151.py", ["w"] * 151), comment("d200.py", ["w"] * 200, kind="docstring"), comment("d201.py", ["w"] * 201, kind="docstring", lines=1)]
    assert {(r.path, r.code) for r in volume(blocks(spark, rows)).collect()} == {("c151.py", "TPX001"), ("d201.py", "TPX002")}
    assert volume(blocks(spark, rows[:1]), comment_max=0).count() == 1


def test_markers_before_clusters_and_ignore_before_markers(spark):
    rows = [comment("a.py", W), comment("b.py", W), comment("c.py", [*W[:21], "y0", "y1", "y2"], above="# !TPX003"), comment("z.py", [f"v{i}" for i in range(160)], above="# !TPX002")]
    got = findings(blocks(spark, rows)).collect()
    assert [(r.code, r.path) for r in got] == [("TPX003", "a.py"), ("TPX001", "z.py")]
    assert got[0].message == "a.py:1-2: TPX003 same explanation in 2 places: b.py:1-2 (weakest a.py:1-2 ~ b.py:1-2, similarity 1.000)"
    assert got[1].message == "z.py:1-2: TPX001 comment is 160 words long, over the 150-word limit — shorten it, or mark it with `# !TPX001` on the line above it"
    assert [r.code for r in findings(blocks(spark, rows), Config(ignore=("TPX003",))).collect()] == ["TPX001"]
    assert findings(blocks(spark, rows), Config(ignore=("TPX001", "TPX003"))).count() == 0


def test_order_of_input_changes_nothing(spark):
    rows = [comment(f"{c}.py", [f"{c}", *W[: 14 + i % 3]]) for i, c in enumerate("hgfedcba")]
    first = [r.message for r in findings(blocks(spark, rows)).collect()]
    assert first and first == [r.message for r in findings(blocks(spark, rows[::-1]).repartition(5)).collect()]


def test_many_members_are_folded(spark):
    got = findings(blocks(spark, [comment(f"m{i:02d}.py", W) for i in range(14)])).first()
    assert ", … and 3 more (weakest" in got.message and len(got.locations) == 14


def test_comparisons(spark):
    rows = [comment("a.py", W[:12]), comment("b.py", W[:12]), comment("c.py", W[6:20]), comment("d.py", [f"q{i}" for i in range(9)])]
    assert similarity.comparisons(blocks(spark, rows)).select(F.col("comparisons")).first()[0] == 2


def test_join_writes_no_text_and_lists_equal_sets_of_different_narratives(spark):
    turned = ["a", "b", "c", "a", "b", "c", "a", "b", "c"]
    rows = [comment("a.py", turned), comment("b.py", [*turned, "a"]), comment("c.py", W[:12]), comment("d.py", W[:12]), comment("e.py", W[:13])]
    groups, near = similarity.joined(blocks(spark, rows))
    first = {r.id: r.path for r in groups.select("id", "first.path").collect()}
    got = {(*sorted((first[r.l], first[r.r])), round(r.score, 6)) for r in near.collect()}
    assert got == {("a.py", "b.py", 1.0), ("c.py", "e.py", round(10 / 11, 6))}
    assert "narrative" not in groups.columns
