import gzip
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillion.llm import pii_crf, warc

# personal data


def test_held_out_entities():
    wrong = total = 0
    texts = pii_crf.generated(400, seed=1234)
    for (text, want), got in zip(texts, pii_crf.find([t for t, _ in texts])):
        covered = lambda spans: {(i, k) for a, b, k in spans for i in range(a, b) if text[i].isalnum()}  # noqa: B023, E731
        a, b = covered(want), covered(got)
        wrong += len(a ^ b)
        total += len(a)
    assert wrong / total < 0.02


def test_known_kinds_and_decoys():
    text = 'Mail a.b12@mail3.example.com, call +1 (974) 555-3436 or see 144.137.247.239; card 4111111111111111. token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and order 2669109448945251, version 2.0 of 2021-05-01.'
    got = pii_crf.mask(text, pii_crf.find([text])[0])
    assert got == 'Mail <EMAIL>, call <PHONE> or see <IP>; card <CARD>. token = "<SECRET>" and order 2669109448945251, version 2.0 of 2021-05-01.'
    loud = "SEE TOKEN%% =** \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!! NOW!!"
    assert "9233A8" not in pii_crf.mask(loud, pii_crf.find([loud])[0])


def test_repeated_names_agree_over_a_distance():
    text = "Yesterday Mr. Loxin came by. " + "Then it rained for a while. " * 200 + "At last Loxin left."
    got = pii_crf.find([text])[0]
    assert [text[a:b] for a, b, k in got if k == "PERSON"] == ["Loxin", "Loxin"]
    alone = "At last Loxin left."
    assert pii_crf.find([alone])[0] == []


def test_messages_are_exact_on_a_tree():
    """On a graph without cycles belief propagation gives the marginals of the whole field."""
    g = pii_crf.Graph()
    g.add(0, "call +1 (974) 555-3436 and 7")
    crf = pii_crf.model()
    s, n, k = g.design() @ crf.unary, len(g.doc), len(pii_crf.LABELS)
    assert g.chain == [(0, 1), (1, 2)] and not g.skip and n == 4
    joint = np.zeros((k,) * n)
    for y in np.ndindex(*joint.shape):
        joint[y] = sum(s[i, y[i]] for i in range(n)) + sum(crf.chain[y[a], y[b]] for a, b in g.chain)
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    got = crf.marginals(g, rounds=200)
    for i in range(n):
        assert np.allclose(got[i], joint.sum(axis=tuple(j for j in range(n) if j != i)), atol=1e-3)


def test_numbers_written_with_spaces():
    kinds = lambda text: [(text[a:b], k) for a, b, k in pii_crf.find([text])[0]]
    assert kinds("card 4111 1111 1111 1111, then") == [("4111 1111 1111 1111", "CARD")] and kinds("3782 822463 10005") == [("3782 822463 10005", "CARD")]
    assert kinds("to DE89 3704 0044 0532 0130 00 or GB82 WEST 1234 5698 7654 32 now") == [("DE89 3704 0044 0532 0130 00", "IBAN"), ("GB82 WEST 1234 5698 7654 32", "IBAN")]
    assert kinds("555 123 4567") == [("555 123 4567", "PHONE")] and kinds("at +44 20 7946 0958 or 06 12 34 56 78") == [("+44 20 7946 0958", "PHONE"), ("06 12 34 56 78", "PHONE")]
    assert kinds("and 078 05 1120.") == [("078 05 1120", "SSN")]
    assert kinds("4111 1111 1111 1111 555 123 4567") == [("4111 1111 1111 1111", "CARD"), ("555 123 4567", "PHONE")]
    for decoy in ("4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "order 555 123 4567", "12 345 678", "2021 05 01"):
        assert kinds(decoy) == []


def test_names_without_a_title(spark):
    texts = ["my name is John Smith", "contact Jane Doe", "Contact Loxin Aretu today", "Ludwig van Beethoven slept", "Yesterday Anna came", "Yesterday Dr Jane Doe met Mary O'Brien", "Dear Loxin, how are you"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [r.text for r in pii_crf.report(df).orderBy("doc_id").collect()]
    assert got == ["my name is <PERSON>", "contact <PERSON>", "Contact <PERSON> today", "<PERSON> slept", "Yesterday <PERSON> came", "Yesterday Dr <PERSON> met <PERSON>", "Dear <PERSON>, how are you"]
    other = ["The General Public License says", "Apache License", "In New York And So On", "contact Customer Service", "Orre Orre"]
    assert pii_crf.find(other) == [[]] * len(other)


def test_masking_documents(spark):
    mail = "x.10@mail1.example.com"
    rows = [(1, f"a {mail} b", 99, "en"), (2, None, None, "en"), (3, "", 0, None), (None, mail, 1, "en"), (4, "no numbers", 10, "en"), (4, "no numbers", 10, "en"), (5, ("word " * 1000 + mail + " ") * 50, 1, "en")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, n_chars long, lang string, found string").repartition(3)
    out = pii_crf.mask_documents(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and out.count() == 7
    assert got[1].text == "a <EMAIL> b" and got[1].n_chars == 11 and got[2].text is None and got[3].text == "" and got[None].text == "<EMAIL>" and got[4].n_chars == 10
    assert got[5].text.count("<EMAIL>") == 50 and "@" not in got[5].text
    assert pii_crf.mask_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.found for r in pii_crf.report(df).collect()}[5] == "EMAIL:50"


def test_batches_do_not_change_labels():
    texts = [t for t, _ in pii_crf.generated(40, seed=5)]
    assert pii_crf.find(texts) == [pii_crf.find([t])[0] for t in texts]


# archives


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, type string, uri string, date string, digest string, payload binary, note string, state string")


def resolved(rows):
    first: dict = {}
    for i, k, u, d, g, *_ in rows:
        if k == "response" and g is not None:
            first[g] = min(first.get(g, (d, i, u)), (d, i, u))
    out, taken = [], set()
    for i, k, u, d, g, p, *_ in rows:
        if k not in ("response", "revisit") or g is None:
            out.append((i, "other", None, bytes(p or b"")))
        elif k == "response" and first[g] == (d, i, u) and g not in taken:
            taken.add(g)
            out.append((i, "original", None, bytes(p or b"")))
        elif g in first:
            out.append((i, "revisit", first[g][1], b""))
        else:
            out.append((i, "unresolved", None, b""))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [warc.FEW, 0])
def test_revisits_against_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    r = random.Random(0)
    rows = [(f"id{i}", r.choice(["response", "response", "revisit"]), f"u{r.randint(0, 5)}", f"2020-01-{r.randint(10, 20)}", f"sha1:{r.randint(0, 25)}", f"body{i}".encode(), "n", "s") for i in range(120)]
    rows += [("w", "warcinfo", "", "2020-01-01", None, b"info", "n", "s"), ("nd", "response", "u", "2020-01-01", None, b"x", "n", "s"), ("np", "response", "u", "2020-01-01", "sha1:e", None, "n", "s"), ("lone", "revisit", "u", "2020-01-01", "sha1:none", None, "n", "s")]
    rows += [("tie", "response", "u", "2020-01-01", "sha1:t", b"t", "n", "s")] * 2
    out = warc.resolve(records(spark, rows).repartition(4), few)
    assert sorted(((x.record_id, x.state, x.original_id, bytes(x.payload)) for x in out.collect()), key=str) == resolved(rows)
    assert "note" in out.columns and out.columns.count("state") == 1
    clash = records(spark, rows).toDF("record_id", "type", "uri", "date", "digest", "payload", "first", "a.b").withColumn("c0", F.create_map(F.lit("k"), F.lit(1))).withColumn("key", F.lit(None))
    out = warc.resolve(clash.withColumn("__digest", F.lit(1)), few)
    assert {"first", "a.b", "c0", "key", "__digest"} <= set(out.columns) and out.groupBy("state").count().where("state = 'original'").first()["count"] == len([x for x in resolved(rows) if x[1] == "original"])
    assert warc.resolve(records(spark, [])).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [("urn:a", "response", "http://x/1", "2020-01-01T00:00:00Z", "sha1:1", b"<p>\r\n\r\nbody\xff", "", ""), ("urn:b", "response", "http://x/2", "2020-01-02T00:00:00Z", "sha1:1", b"<p>\r\n\r\nbody\xff", "", ""), ("urn:c", "revisit", "http://x/3", "2020-01-03T00:00:00Z", "sha1:1", None, "", "")]
    written = warc.write_archive(warc.resolve(records(spark, rows)), str(tmp_path))
    assert sum(r.n for r in written.collect()) == 3 and not [f for f in os.listdir(tmp_path) if f.startswith(".")]
    back = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {k: (v.type, bytes(v.payload)) for k, v in back.items()} == {"urn:a": ("response", rows[0][5]), "urn:b": ("revisit", b""), "urn:c": ("revisit", b"")}
    raw = b"".join(gzip.decompress((tmp_path / f).read_bytes()) for f in os.listdir(tmp_path))
    assert raw.count(b"WARC-Refers-To: <urn:a>") == 2 and raw.count(b"WARC-Refers-To-Target-URI: http://x/1") == 2
    again = {r.record_id: r.state for r in warc.resolve(warc.read_archives(spark, str(tmp_path))).collect()}
    assert again == {"urn:a": "original", "urn:b": "revisit", "urn:c": "revisit"}


def test_parsing_plain_and_broken_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbodybo\r\n\r\n"
    got = warc.parse(one + one.replace(b"25", b"99"))
    assert [(r["record_id"], r["payload"]) for r in got] == [("urn:1", b"bodybo")] and re.fullmatch("sha1:[0-9a-f]{40}", got[0]["digest"])
    assert warc.parse(b"") == [] and warc.parse(b"nonsense") == []
    assert len(warc.parse(gzip.compress(one) + gzip.compress(one)[:-20])) == 1


def test_pages_captured_again(spark):
    df = spark.createDataFrame([(0, "u0", "a"), (4, "u1", "a"), (8, "u2", None), (3, "u", "x"), (None, "u", "y")], "page_id long, url string, html string")
    got = {r.record_id: (r.state, r.original_id) for r in warc.resolve(warc.from_pages(df).union(warc.captured_again(df))).collect()}
    assert got["urn:page:0:again"] == got["urn:page:4:again"] == got["urn:page:4"] == ("revisit", "urn:page:0")
    assert got["urn:page:8"] == got["urn:page:8:again"] == ("unresolved", None) and got["urn:page:null"][0] == "original" and len(got) == 8


def test_pages_as_records(spark):
    df = spark.createDataFrame([(0, "u0", "same"), (1, "u1", "same"), (2, "u2", None), (3, None, "x"), (None, "u", "same")], "page_id long, url string, html string")
    got = {r.page_id: (r.state, r.original_id) for r in warc.resolve(warc.from_pages(df)).collect()}
    assert got == {0: ("original", None), 1: ("revisit", "urn:page:0"), 2: ("unresolved", None), 3: ("original", None), None: ("revisit", "urn:page:0")}
