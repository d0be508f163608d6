"""Toxicity by weak supervision.

Voters are lexicons of four languages, writing patterns, and lexicons induced
from a bounded sample of labelled rows (words and word beginnings that go with
the label). A generative label model of the votes of all documents has each
voter depend on the class and on one other voter: expectation maximisation
estimates how often each fires in either class (its accuracy) and how it goes
with that other one within the class (their correlation), and which other one
that is. Labels only say where it begins, and so which class is which. Its
posteriors are the labels on which a linear classifier is trained over
labelled and unlabelled documents alike, and that scores every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored
from .common import bounded, map_texts, table, unused, utf8, without

#: Common insults, a voter for each language.
LEXICONS = {
    "en": "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown imbecile jerk bastard dumb filthy vermin garbage",
    "de": "idiot dummkopf arschloch abschaum versager blödmann trottel dreckig widerlich wertlos erbärmlich schwachkopf",
    "fr": "idiot imbécile connard crétin salaud ordure minable débile abruti pathétique dégoûtant nul",
    "es": "idiota imbécil estúpido basura cabrón payaso escoria patético inútil asqueroso tonto perdedor",
}
#: Labelled rows to fit on, at most (those with the smallest hashes of their ids); features and induced voters, at most.
MOST_ROWS, MOST_FEATURES, INDUCED = 20_000, 2000, 10
#: Labelled positives that a feature needs, and its least precision.
LEAST_POSITIVE, LEAST_PRECISION = 4, 0.5
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"[!?]{2,}")


def features_of(text: str) -> set[str]:
    """Distinct lower-cased words, and their beginnings marked with a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "-" for n in BEGINNINGS for w in words if len(w) > n}


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32, as text, is divisible by 5; such rows are never learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counts(batches):
    """Documents and positive documents of each feature, per task."""
    seen, positive = Counter(), Counter()
    for b in batches:
        for label, data in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            found = features_of(data.decode())
            seen.update(found)
            if label:
                positive.update(found)
    rows = [(f, positive[f], k) for f, k in seen.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["feature", "positive", "n"])


def _induced(sample: DataFrame) -> list[str]:
    """Features that go with the label, strongest first."""
    counted = map_texts(sample.select("label", "text"), _counts, "feature string, positive long, n long").groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n"))
    strength = F.col("positive") * F.log2((F.col("positive") + 0.5) / (F.col("n") - F.col("positive") + 0.5))
    good = counted.where((F.col("positive") >= LEAST_POSITIVE) & (F.col("positive") >= LEAST_PRECISION * F.col("n")))
    rows = good.select("feature", strength.alias("s")).orderBy(F.desc("s"), "feature").limit(MOST_FEATURES).collect()
    return [r["feature"] for r in rows]


class Voters:
    """Features of a text and the voters' votes as bits."""

    def __init__(self, induced: list[str]):
        fixed = {lang: set(words.split()) for lang, words in LEXICONS.items()}
        self.names = [f"lexicon-{k}" for k in fixed] + ["dense", "shouting"] + [f"induced-{i}" for i in range(INDUCED)]
        self.features = {f: i for i, f in enumerate(dict.fromkeys([*induced, *sorted(set().union(*fixed.values()))]))}
        self.bits = np.zeros(len(self.features), np.int64)
        for f, i in self.features.items():
            self.bits[i] |= sum(1 << k for k, words in enumerate(fixed.values()) if f in words)
        for i, f in enumerate(induced):
            self.bits[self.features[f]] |= 1 << (len(fixed) + 2 + i % INDUCED)
        self.dense, self.shouting = 1 << len(fixed), 1 << (len(fixed) + 1)

    def of(self, text: str) -> tuple[list[int], int]:
        words = _WORD.findall(text.lower())
        distinct = set(words)
        have = self.features.get
        found = {i for w in distinct for f in (w, *(w[:n] + "-" for n in BEGINNINGS if len(w) > n)) if (i := have(f)) is not None}
        votes = 0
        for i in found:
            votes |= int(self.bits[i])
        whole = sum(1 for w in distinct if have(w) is not None)
        if whole >= 2 and whole * 100 >= len(words):
            votes |= self.dense
        if len(_SHOUT.findall(text)) * 20 > len(words):
            votes |= self.shouting
        return sorted(found), votes


def _vote(batches, held, features: str, votes: str):
    """Features and votes in place of the last column, the text."""
    voters: Voters = held.value
    for b in batches:
        found = [voters.of(x.decode()) for x in utf8(b.column(b.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.int32())], names=[*b.schema.names[:-1], features, votes])


def correlated_tree(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1 for the first): the tree of greatest mutual information within the classes."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for w in mass:
        whole, one = w.sum() + 1e-9, w @ votes
        both = (votes.T * w) @ votes
        for x in (0, 1):
            for y in (0, 1):
                n = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): whole - one[:, None] - one[None, :] + both}[x, y]
                apart = np.outer(one if x else whole - one, one if y else whole - one) / whole
                with np.errstate(divide="ignore", invalid="ignore"):
                    info += np.where((n > 1e-9) & (apart > 0), n * np.log(n / apart), 0)
    parent, near, of = np.full(m, -1), info[0].copy(), np.zeros(m, np.int64)
    out = np.arange(m) > 0
    for _ in range(m - 1):
        j = int(np.where(out, near, -np.inf).argmax())
        parent[j], out[j] = of[j], False
        near, of = np.maximum(near, info[j]), np.where(info[j] > near, j, of)
    return parent


def voter_rates(votes: np.ndarray, mass: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """P(voter fires | class, parent's vote) as [class, parent's vote, voter], drawn a little to the rate without the parent."""
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    alone = (mass @ votes + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)
    rate = np.stack([(mass @ ((above == x) * votes) + alone) / (mass @ (above == x) + 1) for x in (0, 1)], axis=1)
    return np.clip(rate, 1e-6, 1 - 1e-6)


def posterior(votes: np.ndarray, rate: np.ndarray, parent: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(class 1 | votes) of every pattern."""
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    fires = np.where(above == 1, rate[:, None, 1], rate[:, None, 0])
    log = (np.log(fires) * votes + np.log(1 - fires) * (1 - votes)).sum(axis=2) + np.log(prior)[:, None]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def label_model(votes: np.ndarray, weight: np.ndarray, gold: np.ndarray, rounds: int = 50, tree_rounds: int = 20) -> np.ndarray:
    """Posterior of label 1 for every distinct vote pattern.

    votes: patterns x voters (0/1); weight: documents of each pattern; gold:
    labelled (clean, toxic) documents of each, which only the first round
    counts. The tree is chosen anew in the first ``tree_rounds`` rounds.
    """
    mass = gold.T.astype(float)
    for i in range(rounds):
        if i < tree_rounds:
            parent = correlated_tree(votes, mass)
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        post = posterior(votes, voter_rates(votes, mass, parent), parent, prior)
        mass = np.stack([weight * (1 - post), weight * post])
    return post


def linear_fit(rows: list[list[int]], target: np.ndarray, n: int, ridge: float = 0.02, rounds: int = 400) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model of sparse 0/1 rows with soft targets."""
    at = np.concatenate([np.array([*r, n], np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], minlength=len(rows)), -30, 30)))
        g = np.bincount(at, (p - target)[row], minlength=n + 1) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def _score(batches, held, out: str):
    """The score in place of the last column, the features."""
    w = held.value
    for b in batches:
        z = [w[-1] + w[f].sum() if f else w[-1] for f in b.column(b.num_columns - 1).to_pylist()]
        score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], out])


def _sampled(rows: DataFrame, most_rows: int, *key: str) -> DataFrame:
    """At most so many rows, by a hash of the key under a limit that follows from the number of rows."""
    n = rows.count()
    if n > most_rows:
        least = -(1 << 63)
        rows = rows.where(F.xxhash64(*key) < F.lit(least + int((1 << 64) * 0.95 * most_rows / n)))
    return rows.limit(most_rows)


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, DataFrame, str]:
    """The linear weights, all rows with a column of their features in place of the text, and that column's name.

    Labels are learned from at most ``most_rows`` labelled ids that are not
    held out: of ids with several labels the greatest counts, null labels and
    null ids count not at all. Votes and their patterns are counted over all
    documents; the classifier is trained on the posteriors of at most
    ``most_rows`` documents that are not held out, labelled or not. Without
    labels the fixed lexicons alone decide.
    """
    sc = docs.sparkSession.sparkContext
    ids = F.col(f"`{doc_id}`")
    train = labels.where(ids.isNotNull() & F.col(label).isNotNull() & ~held_out(ids)).groupBy(ids.alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    train = stored(_sampled(train.withColumn("__key", F.col("__id").cast("string")), most_rows, "__key").drop("__key"), "labelled")
    own = docs.select(ids.alias("__id"), F.col(f"`{text}`").cast("string").alias("text"))
    induced = _induced(own.join(F.broadcast(train), "__id"))  # the sample's rows are bounded
    voters = Voters(induced)
    held = sc.broadcast(voters)
    features, votes = unused(docs, "features"), unused(docs, "votes")
    kept = docs.drop(text)
    base = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{text}`").cast("string").alias(votes))
    schema = T.StructType([*kept.schema.fields, T.StructField(features, T.ArrayType(T.IntegerType())), T.StructField(votes, T.IntegerType())])
    voted = stored(map_texts(base, lambda it: _vote(it, held, features, votes), schema), "votes")
    patterns = voted.groupBy(F.col(votes).alias("v")).agg(F.count("*").alias("n")).toPandas()  # at most 2 ** voters rows
    seen = voted.select(ids.alias("__id"), F.col(votes).alias("v")).join(F.broadcast(train), "__id")
    known = seen.groupBy("v", "label").agg(F.count("*").alias("n")).collect()  # as few
    if not known:
        return np.append(np.full(len(voters.features), 3.0), -2.0), voted, features
    at = {v: i for i, v in enumerate(patterns["v"])}
    gold = np.zeros((len(patterns), 2))
    for r in known:
        gold[at[r["v"]], r["label"]] = r["n"]
    fired = (patterns["v"].to_numpy()[:, None] >> np.arange(len(voters.names))) & 1
    post = label_model(fired.astype(float), patterns["n"].to_numpy(float), gold)
    some = voted.where(~held_out(ids)).select(F.col(features).alias("f"), F.col(votes).alias("v"), F.coalesce(ids.cast("string"), F.lit("")).alias("__id"))
    rows = _sampled(some, most_rows, "__id", "f").select("f", "v").collect()
    return linear_fit([r["f"] for r in rows], np.array([post[at[r["v"]]] for r in rows]), len(voters.features)), voted, features


def _scored(docs: DataFrame, weights: np.ndarray, voted: DataFrame, features: str, out: str) -> DataFrame:
    """The rows with the score as ``out`` in place of features and votes."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    rows = voted.select(*[F.col(f"`{c}`") for c in docs.columns if c in voted.columns], features)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.DoubleType())])
    return map_texts(rows, lambda it: _score(it, held, out), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> DataFrame:
    """Add ``toxicity`` (0 to 1) to every row; the text is not returned.

    Scores depend on texts alone; null texts count as empty. An input column
    ``toxicity`` is replaced, all others stay; repeated rows stay repeated, no
    rows give none. See `fit_toxicity` for what is learned from.
    """
    docs = without(docs, "toxicity")
    return _scored(docs, *fit_toxicity(docs, labels, doc_id, text, label, most_rows), "toxicity")


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: float = 0.5) -> DataFrame:
    """The rows whose score is under ``limit``, with their columns as they are, whatever these are named.

    Null and empty texts are scored like any other; a null id is no label's.
    Rows that go are named by id and hash of the text; texts are shuffled only
    if there are more of them than may be broadcast.
    """
    own = unused(docs, "own")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    narrow = keyed.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(own).alias("own"))
    scored = _scored(narrow, *fit_toxicity(narrow, labels.withColumnRenamed(doc_id, "doc_id"), label=label), "score")
    gone = stored(scored.where(F.col("score") >= limit).select(F.col("doc_id").alias("id"), F.col("own").alias("hash")).distinct(), "toxic")
    return keyed.join(bounded(gone), keyed[f"`{doc_id}`"].eqNullSafe(gone["id"]) & (keyed[own] == gone["hash"]), "left_anti").drop(own)


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    found = score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
