import random

import numpy as np
from pyspark.sql import functions as F

from quillion.operators import postings, stats
from quillion.plans.scratch import Scratch


def rows_of(spark, sets):
    made = spark.createDataFrame([(s,) for s in sets], "grams array<long>").repartition(3).withColumn("id", F.monotonically_increasing_id())
    return Scratch(spark, "test").keep(made)


def test_pairs_that_share_are_counted_in_cells_of_bits(spark, monkeypatch):
    r = random.Random(5)
    sets = [sorted({r.randrange(40) if r.random() < 0.02 else r.randrange(1000, 9000) for _ in range(r.randint(1, 12))} | ({7} if i % 5 == 0 else set())) for i in range(700)] + [[]]
    hashed = [[hash((g, 1)) * 0x9E3779B97F4A7C15 % (1 << 63) - (1 << 62) for g in s] for s in sets]
    wanted = sum(bool(set(a) & set(b)) for i, a in enumerate(sets) for b in sets[:i])
    for side in (1 << 17, 100):  # one side, and many of them
        monkeypatch.setattr(postings, "SIDE", side)
        assert postings.sharing_pairs(rows_of(spark, hashed)).first()["pairs"] == wanted
    monkeypatch.setattr(postings, "PAIRS", 10)
    assert postings.sharing_pairs(rows_of(spark, hashed)).first()["pairs"] == wanted
    assert postings.sharing_pairs(rows_of(spark, [])).first()["pairs"] == 0


def test_partners_by_rare_hashes_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    sets = [[x * 0x9E3779B97F4A7C15 % (1 << 63) for x in {r.randrange(60) for _ in range(r.randint(2, 9))} | ({99} if i % 4 else set())] for i in range(150)]
    sets += [s[:] for s in sets[:6]]
    rows = Scratch(spark, "test").keep(spark.createDataFrame([(1000 - i, bytearray(str(sorted(s)).encode()), s) for i, s in enumerate(sets)], "id long, t binary, grams array<long>").repartition(3))
    df = {g: sum(g in s for s in sets) for s in sets for g in s}
    of = {1000 - i: set(s) for i, s in enumerate(sets)}
    pairs = {(a, b) for a in of for b in of if a < b and of[a] != of[b] and any(df[g] <= 14 for g in of[a] & of[b])}
    monkeypatch.setattr(postings, "PAIRS", 50)
    got = postings.rare_partners(rows, 14).collect()
    assert sorted((x["l"], int(r)) for x in got for r in np.frombuffer(x["partners"], np.int64)) == sorted(pairs)
    near = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a, b in pairs}
    scored = stats.scored_pairs(rows.withColumn("size_lines", F.lit(2)).withColumn("size_words", F.lit(9)), 0.5, 14).collect()
    assert {(x["l"], x["r"]): x["score"] for x in scored} == {k: v for k, v in near.items() if v >= 0.5}
    # a sample has the pairs at places of all of them, and scores no others
    ordered, n = sorted(pairs), len(pairs)
    sample = {(x["l"], x["r"]): x["score"] for x in stats.sampled_pairs(rows, 20, 14).collect()}
    assert sample == {ordered[k * (n - 1) // 19]: near[ordered[k * (n - 1) // 19]] for k in range(20)}
