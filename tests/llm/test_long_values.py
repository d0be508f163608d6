"""Discovered personal data of any length."""

import hashlib
import random
import string

import pytest
from plumbline.llm import pii


def _value(rng, n, letters):
    return "".join(rng.choice(letters) for _ in range(n - 1)) + "7"


@pytest.mark.parametrize("n", [129, 200, 50_000])
def test_keyed_values_go_whole(spark, n):
    rng = random.Random(n)
    rows = [(i, f"set token={_value(rng, n, string.ascii_letters + string.digits)} here") for i in range(6)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.text for r in out} == {"set token=[IDENTIFIER] here"}


@pytest.mark.parametrize("before,n,letters", [("badge ", 70, string.ascii_lowercase), ("", 60, string.ascii_uppercase)])
def test_word_and_prefix_values(spark, before, n, letters):
    rng = random.Random(n)
    values = [("" if before else "QZX") + _value(rng, n, letters) for _ in range(6)]  # the digit comes last, far behind the value's start
    rows = [(i, f"see {before}{v} and token={v} now") for i, v in enumerate(values)]
    found = {r.doc_id: r["__x"] for r in pii._findings(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").selectExpr("doc_id", "transform(found, c -> struct(c.start, c.end)) AS __x").collect()}
    for i, v in enumerate(values):
        at = rows[i][1].index(v)
        assert (at, at + len(v)) in [tuple(x) for x in found[i]]


def test_dotted_and_single_values(spark):
    secret = "eyJhbGciOiJI.eyJzdWIiOiIx_2.c-3" + "x9" * 120
    texts = [f"the password={secret} stays", "a token: 'ab.cd.e1' here", "secret=QWxhZGRpbjpvcGVu1==, more", "passwd=p@ss9!word. End", "only password=abc12 short", "password=abcdef no digit"]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: "the password=[IDENTIFIER] stays", 1: "a token: '[IDENTIFIER]' here", 2: "secret=[IDENTIFIER], more", 3: "passwd=[IDENTIFIER]. End", 4: texts[4], 5: texts[5]}


def test_many_spans_and_clashing_names(spark):
    text = " ".join(f"u{i}@example.com password=abc{i}9def" for i in range(3000))
    rows = [(1, text, "a", "b", "c", "d"), (None, "mail x@y.zz", "a", "b", "c", "d"), (None, "mail x@y.zz", "a", "b", "c", "d"), (2, None, "a", "b", "c", "d"), (3, "", "a", "b", "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string, id_of_spans string, spans_of_text string, __own string")
    out = pii.redact(df)
    assert out.columns == df.columns and all(tuple(r)[2:] == ("a", "b", "c", "d") for r in out.collect())
    assert sorted((r.doc_id or 0, r.text) for r in out.where("doc_id is null or doc_id > 1").collect() if r.text) == [(0, "mail [EMAIL]")] * 2
    assert out.where("doc_id = 1").first().text == " ".join("[EMAIL] password=[IDENTIFIER]" for _ in range(3000))


def test_overlapping_candidates(spark):
    rows = spark.createDataFrame([(1, 7, [(10, 0, 20, 0), (30, 1, 40, 0)])], "doc_id long, print long, base array<struct<start:int,kind:int,end:int,instance:long>>")
    spans = [(0, 5), (0, 9), (5, 11), (12, 15), (20, 25), (21, 25), (25, 30), (39, 45), (40, 50), (28, 42)]
    taken = spark.createDataFrame([(1, 7, a, b) for a, b in spans], "doc_id long, print long, start int, end int")
    got = sorted((x.start, x.end) for x in pii._chosen(rows, taken).first().extra)
    free = [s for s in spans if not any(b < s[1] and s[0] < e for b, e in ((10, 20), (30, 40)))]
    assert got == sorted(s for s in free if not any(o[0] <= s[0] and s[1] <= o[1] and o != s for o in spans))


def test_pii_query(spark):
    sf = "/root/testdata/sf0.001"
    got = pii.op7_bootstrapped_pii(spark, sf).collect()
    found = {r.doc_id: r for r in pii.find_pii(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert sorted(found) == sorted(r.doc_id for r in got)
    names = [*pii.KINDS, "identifier"]
    for r in got:
        f = found[r.doc_id]
        line = lambda spans: ",".join(f"{names[s.kind]}:{s.start}:{s.end}" for s in spans)
        assert r.base_sha256 == hashlib.sha256(line(f.base).encode()).hexdigest() and r.spans == line(f.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.kind == k for s in f.base) for k in range(4)]
