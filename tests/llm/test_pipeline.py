import random
import re

from test_jaccard import brute
from test_packing import check
from test_text_operators import cut_by_hand

import corpus_pipeline
from quillion.llm import pii_crf


def good(line):
    s = line.strip()
    return bool(s) and s[-1] in ".!?" and s.count("|") < 3 and "licensed under" not in s.lower()


def by_hand(rows, items):
    """Texts by document after all stages, each by brute force."""
    kept = {}
    for i, t in rows:
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        fine = [x for x in lines if good(x)]
        if fine and 2 * sum(map(len, fine)) >= sum(map(len, lines)):
            kept[i] = "\n".join(fine)
    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(list(kept.items())):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    kept = {i: t for i, t in kept.items() if find(i) == i}
    out = {}
    for i, t in kept.items():
        got = cut_by_hand(t, items)
        if got:
            text = pii_crf.mask(got[0], pii_crf.find([got[0]])[0])
            out[i] = text
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(7)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, say(20)) for i in range(4)]
    rows = []
    for i in range(60):
        lines = [say(r.randint(5, 15)) for _ in range(r.randint(1, 6))]
        kind = i % 6
        if kind == 1:
            lines.append("Home | News | About | More.")
        elif kind == 2:
            lines.insert(1, items[i % 4][1])
        elif kind == 3:
            lines.append("Write to jo.12@mail1.example.com now.")
        elif kind == 4 and rows:
            lines = rows[-2][1].split("\n") + [say(1)]
        elif kind == 5:
            lines = ["no end here"] * 3 + lines[:1]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = by_hand(rows, items)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    assert {x.doc_id: x.text for x in at.collect()} == want
    assert all(x.n_chars == len(x.text) for x in at.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = [(i, len(re.findall(r"[^\W_]+", t))) for i, t in want.items()]
    check(out, sizes, 2048)


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
