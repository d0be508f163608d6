"""License scan, quality rules, hosts, personal data and toxicity: base columns against brute force, verdicts on small cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hosts, licenses, pii, quality, toxicity

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n", "one", "x" * 60_000, "1 " * 8000, "a@" + "b.c" * 3000, "+1" + " 2" * 5000, "Kelvin K İ GENERAL public\tLicense", "é" * 10]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "own") for i, t in enumerate(texts)], "doc_id long, text string, lang string, spans string").repartition(3)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- licenses ---

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_columns(spark):
    texts = EDGE + ["CC-BY cc.by cc by", "All rights reserved. all RIGHTS reserved all rights", "the GNU General Public License, version 3. general public public license"]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in documents(spark)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.createOrReplaceTempView("own")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in rows:
        base = [m for m in got[i].license_matches if m.base]
        starts = [m.start for m in base]
        assert (got[i].n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({m.label for m in base}))) == brute_license(t)
        assert all(0 < m.share <= 1 for m in got[i].license_matches)


@pytest.mark.parametrize(("sentence", "label"), [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0")])
def test_license_labels(spark, sentence, label):
    df = frame(spark, ["some words before. " + sentence + " and after", "apache version licensed under", "the mit of license"])
    got = {r.doc_id: {m.label for m in r.license_matches} for r in licenses.scan_licenses(df).collect()}
    assert label in got[0] and not got[1] and not got[2]


def test_license_tolerates_insertions_and_long_texts(spark):
    mit = licenses.OWN[-8].words
    texts = [
        "Licensed under the (well known) Apache License, as of 2004: Version 2.0",
        mit,
        mit.replace("without limitation", "without any limitation"),
        "deal in the software without restriction and nothing else of it",
        "general license public",
        "cc " * 3000 + "by",
    ]
    got = {r.doc_id: r.license_matches for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    labels = [{m.label for m in got[i] if not m.base} for i in range(len(texts))]
    assert labels == [{"apache-2.0"}, {"mit"}, {"mit"}, set(), set(), set()]
    assert [(m.label, m.start) for m in got[5]] == [("cc-by", 2999)]


def test_license_query_and_recall(spark):
    """Every licence line of a table is found, none is made up, and the query's columns follow from its matches."""
    sf = "/root/testdata/sf0.01"
    lines = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in licenses.op1_license_index(spark, sf).collect()}
    assert len(got) == len(rows)
    n = 0
    for r in rows:
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_license(r.text)
        want = {label for line, label in lines.items() if line in (r.text or "")}
        own = set(x.labels.split(",")) - set(PHRASES.values()) - {""}
        assert want == own, (r.doc_id, want, own)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and (x.score > 0) == bool(x.labels) and x.score <= 1
        n += len(want)
    assert n > 20


def test_license_edges(spark):
    df = spark.createDataFrame([(1, "general public license", "a", "b"), (1, "general public license", "a", "b"), (None, None, "a", "b")], "doc_id long, text string, tokens string, votes string")
    out = licenses.scan_licenses(df)
    assert out.columns == [*df.columns, "n_words", "license_matches"] and sorted(len(r.license_matches) for r in out.collect()) == [0, 1, 1]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


# --- quality ---


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark):
    r = random.Random(1)
    texts = EDGE + [" ".join(r.choice("abc") for _ in range(n)) for n in (2, 3, 8, 40)] + ["x y\nx y\n\n\n \nx y\n é#|"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, t, "en") for i, t in documents(spark)]
    got = {x.doc_id: x for x in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = brute_quality(t)
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (x.base_failed and x.kept)
    assert quality.judge_quality(frame(spark, []).limit(0)).count() == 0


def test_quality_keeps_prose_and_rejects_symbols(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    clean = next(t for _, t, _ in rows if len(t.split()) > 300 and "#" not in t and "|" not in t and t.count("!") < 3 and len(set(t.split())) > 150)
    rows += [(9001, clean, "en"), (9002, " ".join(f"{w}###" for w in clean.split()), "en"), (9003, clean.upper().replace(" ", "!! "), None)]
    got = {x.doc_id: x.kept for x in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[9001] and not got[9002] and not got[9003]


def test_quality_edges(spark):
    names = "doc_id long, text string, lang string, n_words string, kept string, __chars string, __text string, tokens string"
    rows = [(1, "some words of it", "en", "a", "a", "a", "a", "a")] * 2 + [(None, None, None, "a", "a", "a", "a", "a")]
    out = quality.judge_quality(spark.createDataFrame(rows, names))
    got = out.collect()
    assert sorted(r.n_words for r in got) == [0, 4, 4] and all(not r.kept and r.base_failed and r.tokens == "a" for r in got)
    assert quality.judge_quality(spark.createDataFrame([], names)).count() == 0


def test_quality_query(spark):
    got = {r.doc_id: r for r in quality.op2_divergence(spark, SF).collect()}
    rows = documents(spark)
    assert sorted(got) == sorted(i for i, _ in rows)
    for i, t in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_quality(t)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept)


def test_distance_by_definition():
    p, q = np.array([[2.0, 1.0, 1.0, 0.0]]), np.array([[0.25, 0.25, 0.0, 0.5]])
    m = [(a / 4 + b) / 2 for a, b in zip(p[0], q[0], strict=True)]
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert quality.distance(p, q)[0, 0] == pytest.approx(((kl(p[0] / 4) + kl(q[0])) / 2) ** 0.5)


# --- hosts ---


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = {"org/": True, "example.org/es/": False, "example.org/en/1": False, "com/fr/": True, "com/de/": False}
    fit = [n for n in rules if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.split("/", 1)[1])]
    best = max(fit, key=len, default=None)
    return host, path, best, None if best is None else "allow" if rules[best] else "block"


def test_hosts(spark):
    urls = [None, "", "nothing", "http://", "http://ORG/x", "HTTP://a.Example.org/es/1#x", "x://example.org/en/12?q", "x://myexample.org/en/1", "ftp://com/fr/", "http://a.com?x=/de/", "http://b.com/de/://com/fr/", "http://é.com/de/\n2"]
    rows = [(i, u) for i, u in enumerate(urls)] * 2 + [(100 + r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = hosts.judge_pages(spark.createDataFrame(rows, "page_id long, url string"), html=None).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        host, path, rule, verdict = brute_rule(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert hosts.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [(f"h{i}.bad.com", 1) for i in range(20) for _ in range(30)] + [(f"h{i}.good.com", 0) for i in range(20) for _ in range(30)] + [("new.bad.com", None), ("one.good.com", 1), ("new.good.com", None)]
    got = {r.host: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["new.bad.com"].bound > 0.5 > got["new.good.com"].mean
    assert got["new.good.com"].mean < got["one.good.com"].mean < 0.5 < got["h1.bad.com"].bound < got["h1.bad.com"].mean


def brute_outcome(html):
    seen = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html)
    w = len(re.findall(r"[^\x20\x09-\x0D]+", seen))
    return int(w < 50 or len(re.findall(r"[#*$%&|<>]", seen)) > 0.3 * w)


def test_page_outcomes(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.html, brute_outcome(r.html)) for r in pages.collect()] + [("<p>" + "word " * 50 + "</p>", 0), ("<p>" + "word " * 49, 1), ("<style>" + "a b " * 99 + "</style>c", 1), ("x# " * 60, 1), ("", 1)]
    got = spark.createDataFrame(rows, "html string, want int").withColumn("bad", hosts.page_outcome(F.col("html"))).collect()
    assert all(r.bad == r.want for r in got) and {r.bad for r in got} == {0, 1}
    assert spark.createDataFrame([(None,)], "html string").select(hosts.page_outcome(F.col("html")).alias("b")).first().b is None


def brute_posterior(outcomes):
    """Shrunk means and bounds host by host, in plain Python."""
    split = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])
    levels = [{}, {}, {}]
    for h, b in outcomes:
        d, s = split(h)
        for level, key in zip(levels, (h, d, s), strict=True):
            n, bad = level.get(key, (0, 0))
            level[key] = (n + (b is not None), bad + (b or 0))
    n, bad = (sum(v[i] for v in levels[2].values()) for i in (0, 1))
    parent, out = {k: (bad + 0.2) / (n + 2) for k in levels[2]}, {}
    for level, up in ((levels[2], lambda k: k), (levels[1], lambda k: k.split(".")[-1]), (levels[0], lambda k: split(k)[0])):
        mean = {k: parent[up(k)] for k in level}
        some = [(k, *level[k], mean[k] * (1 - mean[k])) for k in level if level[k][0] and 0 < mean[k] < 1]
        rest = sum(v * (n - 1) for _, n, _, v in some)
        rho = (sum(n * (b / n - mean[k]) ** 2 for k, n, b, _ in some) - sum(v for *_, v in some)) / rest if rest else 0
        m = min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0
        parent = {k: (level[k][1] + m * mean[k]) / (level[k][0] + m) for k in level}
        out = {k: (parent[k], parent[k] - 1.64 * (parent[k] * (1 - parent[k]) / (level[k][0] + m + 1)) ** 0.5) for k in level}
    return out


def test_reputation_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for d, share in (("bad.com", 0.8), ("good.com", 0.05), ("mid.org", 0.3), ("x.net", 0.1)):
        for h in range(6):
            rows += [(f"h{h}.{d}", int(r.random() < share) if r.random() < 0.9 else None) for _ in range(r.randrange(1, 60))]
    rows.append(("none.bad.com", None))
    want = brute_posterior(rows)
    got = hosts.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()
    assert {x.host: (x.mean, x.bound) for x in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_bad_hosts_are_blocked(spark):
    good, bad = "<p>" + "some words here " * 30 + "</p>", "<p>few</p>"
    rows = [(f"http://h{i % 5}.fine.net/p{i}", good) for i in range(100)] + [(f"http://h{i % 5}.spam.net/p{i}", bad if i % 10 else good) for i in range(100)]
    rows += [("http://h1.spam.net/x", None), ("http://new.spam.net/x", None), ("http://new.fine.net/x", None), (None, bad), ("http://10.0.0.1:80/x", good), ("http://a.spam.net/" + "long/" * 20_000, good)]
    df = spark.createDataFrame([(i, u, h, "own", "own") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, bad string, found string")
    got = {r.page_id: r for r in hosts.judge_pages(df).collect()}
    assert len(got) == len(rows) and all(r.bad == r.found == "own" for r in got.values())
    verdict = [got[i].verdict for i in range(len(rows))]
    assert set(verdict[:100]) == {"allow"} and set(verdict[100:200]) == {"block"}
    assert [verdict[i] for i in (200, 201, 202, 204)] == ["block", "block", "allow", "allow"] and got[203].host == ""
    assert got[204].host == "10.0.0.1:80" and got[205].reputation < got[201].reputation


def test_host_query(spark):
    got = hosts.op3_host_reputation(spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and 0 < r.reputation < 1


# --- personal data ---

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute_pii(t):
    out = []
    for k, (name, p) in enumerate(BASE):
        for m in re.finditer(p, t or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base(spark):
    r = random.Random(4)
    alphabet = ["a", ".", "@", "-", "1", "25", "256", " ", "+", "(", "é", "4012888888881881", "0", "_b", "\n"]
    texts = EDGE + ["".join(r.choice(alphabet) for _ in range(80)) for _ in range(150)] + ["1.2.3.4.5.6.7.8 é 001.2.3.255 1.2.3.256", "a@b.c_d@e.f.g. +1 (632) 555-4827 and 4012 8888 8888 1881-2", "𝒳 a@b.cd 1.1.1.1"]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in documents(spark)]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [tuple(s) for s in got[i].base] == brute_pii(t), t
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}


def test_pii_contexts_find_unseen_identifiers(spark):
    def word(i):
        return hashlib.md5(str(i).encode()).hexdigest()[:18]

    texts = [f"some text password={word(i)} more" for i in range(8)] + [f"plain badge: {word(i)} as a password={word(i)}" for i in range(20, 28)] + [f"later badge: {word(99)} alone", "clean words only 12 times", None]
    df = frame(spark, texts)
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert len(got[0]) == 1 and len(got[16]) == 1 and not got[17] and not got[18]
    cut = {r.doc_id: r for r in pii.redact(df).collect()}
    assert cut[16].text == "later badge: [IDENTIFIER] alone" and cut[17].text == texts[17] and cut[18].text is None and cut[0].spans == "own"
    again = pii.redact(frame(spark, ["a x@y.zz b +1 (632) 555-4827", "a x@y.zz b +1 (632) 555-4827"]))
    assert {r.text for r in again.collect()} == {"a [EMAIL] b [PHONE]"}
    assert pii.redact(df.limit(0)).count() == 0


# --- toxicity ---


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"w{hashlib.md5(str(i).encode()).hexdigest()[:5]}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [r.choice(words) for _ in range(60)]
        for _ in range(3 * bad):
            w[r.randrange(60)] = r.choice(["idiot", "scum", "blorgan", "blorgen", "blorgir"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "you idiot scum")]
    labels += [(3, None), (None, 1), (7, 0), (7, 0)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, lab).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= x.toxicity <= 1 for x in got)
    held = [x for x in got if x.h and x.doc_id is not None and x.doc_id < 900]
    assert 100 < len(held) < 260
    assert all((x.toxicity >= 0.5) == (x.doc_id % 6 == 0) for x in held)
    by = {x.doc_id: x.toxicity for x in got}
    assert by[5000] < 0.5 and by[5001] < 0.5 and by[None] >= 0.5
    kept = toxicity.without_toxic(df, lab)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.toxicity < 0.5}


def test_toxicity_without_labels(spark):
    df = frame(spark, ["you idiot, scum", "fine words", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.toxicity >= 0.5 for x in toxicity.score_toxicity(df, none).orderBy("doc_id").collect()] == [True, False, False]
    assert toxicity.score_toxicity(df.limit(0), none).count() == 0


def test_label_model_against_enumeration():
    """Votes drawn from a known tree: the model finds rates and correlated voters, and its posterior is Bayes' rule over all patterns."""
    rng = np.random.default_rng(4)
    n, share = 40_000, 0.2
    y = rng.random(n) < share
    fire = np.array([[0.05, 0.7], [0.1, 0.6], [0.02, 0.5], [0.2, 0.8]])
    v = (rng.random((n, 4)) < fire[:, y.astype(int)].T).astype(int)
    v = np.column_stack([v, np.where(rng.random(n) < 0.95, v[:, 0], 1 - v[:, 0])])  # a fifth voter copies the first
    patterns, at = np.unique(v, axis=0, return_inverse=True)
    weight = np.bincount(at).astype(float)
    gold = np.zeros((len(patterns), 2))
    np.add.at(gold, (at[:400], y[:400].astype(int)), 1)
    post = toxicity.label_model(patterns.astype(float), weight, gold)
    true = np.bincount(at, y) / weight
    often = weight > 200
    assert np.abs(post - true)[often].max() < 0.08
    mass = np.stack([np.bincount(at, ~y), np.bincount(at, y)]).astype(float)
    parent = toxicity.correlated_tree(patterns.astype(float), mass)
    assert parent[4] == 0 or parent[0] == 4
    rate = toxicity.voter_rates(patterns.astype(float), mass, parent)
    prior = np.array([0.8, 0.2])
    joint = np.empty((len(patterns), 2))
    for i, p in enumerate(patterns):
        for c in (0, 1):
            joint[i, c] = prior[c]
            for j, x in enumerate(p):
                r = rate[c, p[parent[j]] if parent[j] >= 0 else 0, j]
                joint[i, c] *= r if x else 1 - r
    assert toxicity.posterior(patterns.astype(float), rate, parent, prior) == pytest.approx(joint[:, 1] / joint.sum(axis=1))
    # counting the copy as a voter of its own would be surer than the data are
    alone = toxicity.posterior(patterns.astype(float), toxicity.voter_rates(patterns.astype(float), mass, np.full(5, -1)), np.full(5, -1), prior)
    assert np.abs(post - true)[often].max() < np.abs(alone - true)[often].max()


def test_toxicity_query(spark):
    got = toxicity.op8_weak_supervision(spark, SF).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_edges(spark):
    long = "fine words here " * 40_000
    rows = [(1, long, 0.5, "f"), (1, long, 0.5, "f"), (2, long + "idiot", 0.1, "f"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity double, features string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels)
    assert got.columns == ["doc_id", "features", "toxicity"] and got.count() == 4
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and {r.features for r in kept.collect()} <= {"f", None}
    assert toxicity.without_toxic(df.limit(0), labels.limit(0)).count() == 0
