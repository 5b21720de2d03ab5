import random
import re
import time
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from quillion.llm import _vec, ngram_jaccard as nj
from quillion.plans.scratch import Scratch, no_old_shuffles

WORD = re.compile(r"[^\W_]+")


def grams(text, n=2):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, t=0.7):
    nodes = {}
    for i, x in sorted((i, x) for i, x in rows if i is not None and x):
        if grams(x):
            nodes.setdefault(grams(x), []).append(i)
    out = {}
    items = sorted((ids[0], g) for g, ids in nodes.items())
    for k, (a, g) in enumerate(items):
        for b, h in items[:k]:
            j = len(g & h) / len(g | h)
            if j >= t and a != b:
                p = (min(a, b), max(a, b))
                out[p] = max(j, out.get(p, 0))
    for ids in nodes.values():
        for b in set(ids) - {ids[0]}:
            out[ids[0], b] = 1.0
    return {k: round(v, 9) for k, v in out.items()}


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {(r.doc_id_a, r.doc_id_b): round(r.jaccard, 9) for r in nj.similar_pairs(df, **kw).collect()}


def corpus(seed, families=6, size=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 20, 60, 150]))]
        for _ in range(r.randint(1, size)):
            t = [r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.06, 0.15]) else x for x in base]
            rows.append((n, " ".join(t)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_ties_repeats_nulls_and_empty_texts(spark):
    rows = [(1, "A b c d"), (1, "A b c d"), (2, "a B, c d!"), (None, "a b c d"), (3, None), (4, ""), (5, " .,"), (6, "x"), (7, "X"), (8, "y"), (9, "d c b a"), (9, "a b c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_long_text_and_other_columns(spark):
    r = random.Random(1)
    long = " ".join(f"t{r.randrange(5000)}" for _ in range(400_000))
    rows = [(1, long), (2, long.replace("t17 ", "u ")), (3, "short one here")]
    df = spark.createDataFrame([(i, x, 0, 0, i, "p") for i, x in rows], "doc_id long, text string, a int, b int, n long, payload string")
    got = sorted(tuple(r) for r in nj.ngram_jaccard_join(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    kept = nj.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3]


def test_common_grams_weak_sets_and_passes(spark, monkeypatch):
    """Every path at once: all grams common, several parts a band, several passes a part."""
    monkeypatch.setattr(nj, "PART", 200)
    monkeypatch.setattr(nj, "PAIRS", 50)
    monkeypatch.setattr(nj, "BLOCK", 30)
    monkeypatch.setattr(nj, "isqrt", lambda n: 0)
    rows = corpus(11, families=8, size=40)
    real = nj.max if hasattr(nj, "max") else max
    monkeypatch.setattr(nj, "max", lambda *a: 3 if a == (32, 0) else real(*a), raising=False)
    assert run(spark, rows) == brute(rows)


def test_without_broadcast_of_ids(spark, monkeypatch):
    monkeypatch.setattr(nj, "FILTER_MAX", 0)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_thresholds(spark):
    rows = corpus(2)
    for t in (0.65, 1.0):
        assert run(spark, rows, threshold=t) == brute(rows, t)
    with pytest.raises(ValueError):
        nj.Bands(0.5)


def test_bands_hold_every_pair():
    b = nj.Bands(0.7)
    for n in range(1, 400):
        for m in range(n, 600):
            if b.similar_sizes(n, m):
                i = int(b.of(n))
                assert int(b.of(m)) in (i, i + 1)
                least = -(-7 * (n + m) // 17)  # the smallest overlap that is enough
                assert n + m - 2 * least <= b.k[i]
    assert (b.common >= 1).all() and (b.lo[:-1] >= b.joined).all()


def test_words_match_the_expression():
    texts = ["Ünïcode straße, x1 -- y_z", "", "a", "__", "tail ends", "1.5e3 ÀÉ"]
    w = _vec.words(texts)
    want = [(i, x) for i, t in enumerate(texts) for x in WORD.findall(t.lower())]
    assert [(int(d), texts[d][a:z].lower()) for d, a, z in zip(w.doc, w.start, w.end)] == want
    by: dict = {}
    for (_, x), h in zip(want, w.hash.tolist()):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_windows_do_not_cut_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000)) + "x" * 5000
    whole = _vec.words([text, "b c"])
    monkeypatch.setattr(_vec, "WINDOW", 64)
    cut = _vec.words([text, "b c"])
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_largest_sets_that_round_into_the_band_below(spark):
    n = 333
    bands = nj.Bands(nj.THRESHOLD)
    rounded = round(1.02 ** round(np.log(n) / np.log(1.02)))
    assert bands.of(rounded) < bands.of(n)
    begin, number = bands.routes({rounded: 2})
    assert number[bands.of(n)] >= 1 and begin[bands.of(n)] < number.sum()
    words = [f"w{i}" for i in range(n + 1)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))], "doc_id long, text string")
    got = [tuple(r) for r in nj.similar_pairs(df).collect()]
    assert got == [(1, 2, (n - 1) / (n + 1))]


def classes(rows, t=0.7):
    """`(doc_id, class_id, n_links)` by brute force, for ids with one text each."""
    sets = {i: grams(x or "") for i, x in rows if i is not None}
    linked = {i: {j for j, h in sets.items() if j != i and g and h and len(g & h) >= t * len(g | h)} for i, g in sets.items()}
    out = []
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := linked[todo.pop()] - seen)
            seen |= new
        out.append((i, min(seen), len(linked[i])))
    return sorted(out)


def test_classes_and_links(spark):
    rows = [*corpus(4), (900, None), (901, " "), (902, "alone here"), (None, "alone here"), (903, "alone here"), (902, "alone here")]
    rows += [(950 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in nj.ngram_jaccard_join(df).collect()) == classes(rows)
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in nj.drop_near_duplicates(df).collect())
    assert left == sorted([(True, 0), (False, 902), *((False, i) for i, c, _ in classes(rows) if i == c)])
    assert nj.ngram_jaccard_join(df.limit(0)).collect() == []


def test_clashing_columns_and_small_cells(spark, monkeypatch):
    monkeypatch.setattr(nj, "CELLS", 100)
    rows = corpus(6)
    df = spark.createDataFrame([(i, x, 1, 2, 3, 4) for i, x in rows], "doc_id long, text string, gone long, `a.b` long, node long, h1 long")
    assert sorted(tuple(r) for r in nj.ngram_jaccard_join(df).collect()) == classes(rows)
    kept = nj.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, c, _ in classes(rows) if i == c]


def test_pairs_inside_families_are_not_joined(spark, monkeypatch):
    """Families in cells of several chunks; their pairs don't go through the join."""
    monkeypatch.setattr(nj, "FAMILY", 5)
    monkeypatch.setattr(nj, "CHUNK_DOCS", 8)
    r = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(r.choice(base) if r.random() < 0.06 else x for x in base)) for i in range(60)]
    rows += [(1000 + i, x) for i, x in corpus(8, families=6, size=20)] + [(2000 + i, rows[i % 3][1]) for i in range(6)] + [(4, "another text of that id"), (5, rows[6][1])]
    joined, whole = [], nj._cells
    monkeypatch.setattr(nj, "_cells", lambda scratch, pairs: (joined.append(pairs.where("a < 1000 and b < 1000").count()), whole(scratch, pairs))[1])
    assert run(spark, rows) == brute(rows)
    assert joined[0] < 60 * 59 // 4
    rows = [x for x in rows if x not in rows[-2:]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in nj.ngram_jaccard_join(df).collect()) == classes(rows)
    assert sorted(x.doc_id for x in nj.drop_near_duplicates(df).collect()) == [i for i, c, _ in classes(rows) if i == c]


def test_pairs_that_share_a_sketch_by_chance_stay_in_their_part():
    """With several parts a band, only pairs that may reach the count leave a part, and no near pair is lost."""
    bands, r = nj.Bands(0.7), random.Random(4)
    unlike = [" ".join(["same", "two", "words", *(f"u{i}x{j}" for j in range(200))]) for i in range(40)]
    alike = [" ".join(f"a{i}x{j}" if r.random() > 0.1 else "other" for j in range(200)) for i in range(10) for _ in range(3)]
    texts = unlike + alike
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    share = lambda x: SimpleNamespace(value=x)
    for parts in (1, 2, 3, 4):
        number = np.full(len(bands.k), parts)
        routes = (np.cumsum(number) - number, number)
        out = pa.Table.from_batches(nj._emit(2, bands, share(np.zeros(1 << 24, np.uint8)), routes, share((np.zeros(0, np.int64), np.zeros(0, np.uint32))))(iter([batch])))
        total, need = {}, {}
        for p in set(out["part"].to_pylist()):
            mine = out.filter(pa.compute.equal(out["part"], p)).to_batches()
            for found in nj._candidates(bands, number)(iter(mine)):
                for a, b, n, least in zip(*(c.to_pylist() for c in found.columns)):
                    total[a, b], need[a, b] = total.get((a, b), 0) + n, least
        assert not [p for p in total if p[0] < 40 and p[1] < 40]
        assert {p for p in brute(list(enumerate(texts)))} <= {p for p in total if total[p] >= need[p]}


def test_no_split_of_the_shared_sketches_loses_a_pair():
    bands = nj.Bands(0.7)
    for parts in range(1, 60):
        number = np.full(len(bands.k), parts)
        common, (most, need) = bands.shared(number), bands.asked(number)
        assert (common >= bands.common).all() and (bands.k + common <= bands.lo[:-1]).all() and (need >= 1).all()
        # what is left is least where as many parts as can be have `most` each
        assert (common - most * parts >= need).all()
        assert parts == 1 or (most[bands.k >= 8 * (parts + 3)] >= 1).all()


def test_shuffle_files_go_with_their_plan(spark):
    def files():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in folders for p in Path(d.toString()).rglob("shuffle_*.data")}

    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    with no_old_shuffles(spark):
        kept = Scratch(spark, "shuffles").keep(spark.range(1000).repartition(3, "id"))
        until = time.time() + 20
        while files() - before and time.time() < until:
            time.sleep(0.2)
        assert not files() - before
    assert kept.count() == 1000 and spark.conf.get(key) == old


def test_a_long_run_is_not_walked_step_by_step():
    """Pairs of a run come some hundred thousand at a time, not in a step for each of its members in every pass."""

    class Counting(nj.Bands):
        calls = 0

        def similar_sizes(self, a, b):
            self.calls += 1
            return super().similar_sizes(a, b)

    m, bands = 3000, Counting(0.7)
    docs = np.zeros(m + 2, dtype=nj._DOC)
    docs["id"], docs["h"], docs["n"] = np.arange(m + 2), np.random.default_rng(1).permutation(m + 2), 30
    sketches = np.concatenate([np.full(m, 2), [4, 4, 6]]).astype(np.uint32)
    got = list(nj._pairs_of_runs(docs, [(sketches, np.append(np.arange(m), [m, m + 1, m]).astype(np.int32))], bands))
    pairs = {(a, b) for x, y, _ in got for a, b in zip(x.tolist(), y.tolist())}
    assert len(pairs) == sum(len(x) for x, *_ in got) == m * (m - 1) // 2 + 1 and (m, m + 1) in pairs
    assert bands.calls < 100
