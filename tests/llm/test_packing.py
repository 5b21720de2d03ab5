import random

import numpy as np
import pytest

from quillion.llm import packing, token_pack


def bins_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.bin, []).append(r)
    return out


def check(rows, sizes, capacity):
    """Every document whole and once, pieces in order, bins within capacity without gaps or overlap."""
    left = {}
    for r in rows:
        left.setdefault(r.doc_id, []).append((r.piece, r.size))
    want: dict = {}
    for d, n in sizes:
        if n and n > 0:
            want.setdefault(d, []).append(n)
    assert set(left) == set(want)
    for d, pieces in left.items():
        assert sum(s for _, s in pieces) == sum(want[d])
        if len(want[d]) == 1:
            assert sorted(p for p, _ in pieces) == list(range(len(pieces)))
            assert all(s == capacity for p, s in sorted(pieces)[:-1])
    for members in bins_of(rows).values():
        at = 0
        for r in sorted(members, key=lambda r: r.start):
            assert r.start == at
            at += r.size
        assert at <= capacity


def best_fit(sizes, capacity):
    """Number of bins of sequential best-fit decreasing."""
    gaps: list[int] = []
    for s in sorted((p for n in sizes for p in [capacity] * (n // capacity) + [n % capacity] if p), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed, capacity", [(0, 100), (1, 7), (2, 64)])
def test_against_sequential_best_fit(spark, seed, capacity):
    r = random.Random(seed)
    sizes = [(i, int(r.choice([r.expovariate(1 / 20), r.randint(1, 3 * capacity), 1])) + 1) for i in range(300)]
    df = spark.createDataFrame(sizes, "doc_id long, size long").repartition(3)
    rows = packing.pack(df, capacity).collect()
    check(rows, sizes, capacity)
    assert len(bins_of(rows)) <= 1.05 * best_fit([n for _, n in sizes], capacity) + 1
    again = packing.pack(df.repartition(5), capacity).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edges(spark):
    sizes = [(1, 5), (1, 5), (None, 3), (2, None), (3, 0), (4, -2), (5, 10), (6, 25), (7, 5)]
    df = spark.createDataFrame([(i, n, 0, 0) for i, n in sizes], "doc_id long, size long, bin long, piece long")
    rows = packing.pack(df, 10).collect()
    check(rows, sizes, 10)
    assert len(bins_of(rows)) == 6  # 53 of 60
    assert packing.pack(df.limit(0), 10).count() == 0
    assert packing.pack(df.where("size is null"), 10).count() == 0


def test_words_are_the_size(spark):
    docs = spark.createDataFrame([(1, "a b, c"), (2, None), (3, ""), (4, "x " * 5000)], "doc_id long, text string")
    assert {r.doc_id: r["size"] for r in packing.word_counts(docs).collect()} == {1: 3, 2: 0, 3: 0, 4: 5000}
    assert sum(r["size"] for r in packing.pack_documents(docs).collect()) == 5003


@pytest.mark.parametrize("seed", range(5))
def test_sweep_is_best_fit_of_one_round(seed):
    r = random.Random(seed)
    need = {r.randint(1, 30): r.randint(1, 6) for _ in range(8)}
    gaps = {r.randint(1, 40): r.randint(1, 6) for _ in range(8)}
    free = sorted(g for g, c in gaps.items() for _ in range(c))
    want = {}
    for s in sorted(need, reverse=True):
        left = need[s]
        for g in list(free):
            if left and g >= s:
                k = min(left, g // s)
                free.remove(g)
                left -= k
                want[s, g] = want.get((s, g), 0) + k
    got = {}
    used = {}
    for g, first, n, s, rank, each in packing.sweep(need, gaps):
        assert first == used.get(g, 0) and each * s <= g
        used[g] = first + n
        got[s, g] = got.get((s, g), 0) + n * each
    assert got == want and all(used[g] <= gaps[g] for g in used)


def decoded(rows, row, kind="<u2"):
    """Ids of each document's pieces, and checks of the other columns."""
    out = {}
    for r in rows:
        ids, pos, cu = np.frombuffer(r.input_ids, kind), np.frombuffer(r.position_ids, "<u2"), r.cu_seqlens
        assert len(ids) == row == len(pos) and cu[0] == 0 and cu[-1] <= row and len(cu) == len(r.doc_ids) + 1 == len(r.pieces) + 1
        assert (ids[cu[-1] :] == token_pack.PAD).all()
        for d, p, a, z in zip(r.doc_ids, r.pieces, cu[:-1], cu[1:]):
            assert (pos[a:z] == np.arange(z - a)).all() and z > a
            out.setdefault(d, []).append((p, ids[a:z]))
    return {d: [np.concatenate([x for _, x in sorted(v, key=lambda e: e[0])])] for d, v in out.items()}


def test_token_rows_round_trip(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["straße", "alpha", "x1", "\n\n", "don't", "日本", "..."]) for _ in range(r.randint(0, 400)))) for i in range(60)] + [(90, None), (91, ""), (92, " "), (93, "long word " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, shard string, row int").repartition(4)
    got = decoded(token_pack.pack_tokens(df, row=256, shards=3).collect(), 256)
    enc = token_pack.encoder(token_pack.VOCABULARY)
    want = {i: enc.encode_ordinary(t) for i, t in rows if t}
    assert set(got) == {i for i, ids in want.items() if ids}
    assert all(got[i][0].tolist() == want[i] for i in got)
    assert token_pack.pack_tokens(df.limit(0)).count() == 0


def test_token_rows_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, f"word {i % 3} " * (i % 11)) for i in range(80)], "doc_id long, text string")
    a, b = (sorted((r.shard, r.row, str(r.doc_ids), bytes(r.input_ids)) for r in token_pack.pack_tokens(df.repartition(n), row=32, shards=2).collect()) for n in (1, 6))
    assert a == b and len(a) > 10


def test_long_texts_are_encoded_in_parts_without_loss():
    text = ("The quick brown fox's den; 12345 élan vital \n\n\t tabs   spaces " * 4000) + "z" * 1000
    assert token_pack.encode(text).tolist() == token_pack.encoder(token_pack.VOCABULARY).encode_ordinary(text)


@pytest.mark.parametrize("seed", range(3))
def test_segment_tree_finds_the_best_fit(seed):
    r = random.Random(seed)
    lengths = np.array([r.randint(1, 64) for _ in range(300)])
    rows = token_pack.best_fit_decreasing(lengths, 64)
    assert sorted(i for x in rows for i in x) == list(range(300)) and all(lengths[x].sum() <= 64 for x in rows)
    assert len(rows) == best_fit(lengths.tolist(), 64)


def test_matrices_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * (i + 1)) for i in range(20)], "doc_id long, text string")
    packed = token_pack.pack_tokens(df, row=64, shards=2)
    shards = token_pack.write_matrices(packed, str(tmp_path))
    n = 0
    for s in shards:
        ids = np.fromfile(tmp_path / f"{s}.ids", "<u2").reshape(-1, 64)
        assert np.fromfile(tmp_path / f"{s}.pos", "<u2").shape == (ids.size,)
        n += len(ids)
    assert n == packed.count() and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
