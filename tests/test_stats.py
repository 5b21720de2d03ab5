from pyspark.sql import functions as F

from quillion.operators import evaluate, stats


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", 7)], "k string, v int")
    got = {(r.k, r.percent): r.value for r in stats.nearest_rank(df, "v", (50, 90, 99), ["k"]).collect()}
    assert [got["a", p] for p in (50, 90, 99)] == [5, 9, 10] and got["b", 50] == 7
    assert stats.nearest_rank(df.limit(0), "v", (50,), []).first().value == 0


def test_common_text_is_still_counted_exactly(spark):
    df = spark.createDataFrame([(i, "same four words here", 1, 4, f"p{i}") for i in range(41)], "doc_id long, normalized string, size_lines int, size_words int, path string")
    assert stats.exact_groups(df).first().pairs == 820
    assert stats.capped(df).first().asDict() == {"capped_shingles": 2, "capped_blocks": 41}
    grid = {(r.min_lines, r.threshold): r.pairs for r in stats.threshold_grid(df).collect()}
    assert grid[1, 1.0] == 820 and grid[2, 0.5] == 0 and len(grid) == 25


def test_generated_and_first_party(spark):
    df = spark.createDataFrame([("# DO NOT EDIT\nx",), ('"""Generated by x',), ("IDs are generated by y",), ("\n" * 7 + "# generated by z",)], "t string")
    assert [r[0] for r in df.select(stats.looks_generated(F.col("t"))).collect()] == [True, True, False, False]
    df = spark.createDataFrame([("a/b.py",), ("Vendor/b.py",), ("x/p.egg-info/b.py",), ("x_pb2.py",), ("build.py",)], "p string")
    assert [r[0] for r in df.select(stats.in_first_party(F.col("p"))).collect()] == [True, False, False, False, True]


def test_islands(spark):
    df = spark.createDataFrame([("f", n) for n in (1, 2, 3, 7, 9, 10)], "k string, n int")
    assert sorted((r["first"], r["last"], r["n"]) for r in stats.islands(df, "k", "n").collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_samples(spark):
    df = spark.range(100).repartition(7)
    got = sorted(r.id for r in evaluate.uniform_sample(df, "id", 10).collect())
    assert got == [k * 99 // 9 for k in range(10)]
    assert evaluate.uniform_sample(df, "id", 100).count() == 100
    rows = spark.createDataFrame([("b", 1), ("b", 2), ("a", 5), ("a", 6), ("a", 7)], "g string, v int")
    assert [(r.g, r.v) for r in evaluate.round_robin(rows, "g", ["v"], 2, 3).collect()] == [("a", 5), ("b", 1), ("a", 6)]


def test_calibration(spark):
    df = spark.createDataFrame([("k", v) for v in (9, 8, 8, 8, 3)] + [("z", 1)], "kind string, v int")
    at = lambda n: {r.kind: (r.threshold, r.fired) for r in evaluate.calibrated_thresholds(df, "v", "kind", n).collect()}
    assert at(4)["k"] == (3, 4) and at(2)["k"] == (8, 1) and at(5)["k"] == (2, 5)
    assert at(3)["k"] == (3, 4) and at(1)["z"] == (0, 1) and "z" not in at(4)


def test_wilson_and_gate(spark):
    df = spark.createDataFrame([(11, 40), (0, 0)], "k int, n int")
    p, low, high = evaluate.wilson(F.col("k"), F.col("n"))
    a, b = df.select(F.round(p, 3), F.round(low, 3), F.round(high, 3), evaluate.gate(p, 0.4), evaluate.gate(p, None)).collect()
    assert tuple(a) == (0.275, 0.161, 0.428, "PASS", "RED") and tuple(b) == (None, None, None, "RED", "RED")


def test_verification(spark):
    drawn, recorded = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(map(tuple, evaluate.coverage(drawn, recorded, "id").collect())) == [(1, "not recorded"), (3, "not drawn")]
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int"), spark.createDataFrame([("x", 1), ("z", 2)], "k string, n int")
    assert sorted(r.k for r in evaluate.unexpected(a, b, "k").collect()) == ["y", "z"]


def test_first_after(spark):
    left = spark.createDataFrame([("f", 1), ("f", 5), ("g", 1)], "k string, n int")
    right = spark.createDataFrame([("f", 1), ("f", 3), ("f", 4)], "k string, n int")
    assert sorted((r.k, r.n, r.nxt) for r in evaluate.first_after(left, right, "k", "n", "nxt").collect() if r.nxt) == [("f", 1, 3)]


def test_inspected_pairs_have_copies_and_no_cap(spark):
    words = [f"w{i}" for i in range(40)]
    near = [" ".join(words[:-1] + [f"x{i}"]) for i in range(42)]
    texts = near + [near[0], "one two three four five six seven eight", "one two three four five six seven eight", "a b c", "a b c", "other words"]
    rows = [(i, t, 1 if i == 1 else 2, len(t.split())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, normalized string, size_lines int, size_words int")
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    want = {}
    for i, t, n, k in rows:
        for j, u, m, q in rows[i + 1 :]:
            if min(n, m) >= 2 and min(k, q) >= 8 and len(grams(t) & grams(u)) >= 0.75 * len(grams(t) | grams(u)):
                want[i, j] = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
    got = stats.inspect_findings(df).collect()
    assert {(r.l, r.r): r.score for r in got} == want and len(got) == len(want) and want[0, 42] == want[43, 44] == 1.0
