"""Toxicity by weak supervision.

Voters (fixed lexicons, patterns, and lexicons learned from labelled rows) vote
toxic, clean or nothing on every document.  A generative label model explains the
votes by a hidden label: each voter's accuracy given the label, and the correlations
among voters beyond it, as a tree in which a voter's vote depends on the label and on
one other voter's vote.  Both are estimated by EM over counts of vote patterns; given
labels, where there are any, take part in that estimation alone.  The posteriors of
the votes, and no label, then train a linear classifier on word features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, crc_mod, documents, mapped, only, signed, words

#: Common insults by sort, each list a voter.
LEXICONS = {
    "wits": "idiot idiots moron morons stupid dumb imbecile fool fools cretin dunce halfwit brainless clueless retard",
    "worth": "worthless pathetic loser losers useless nobody failure pitiful coward waste",
    "filth": "trash scum garbage filth filthy vermin disgusting gross slime dirtbag scumbag rat pig",
    "mockery": "clown clowns joke laughable ridiculous freak weirdo creep",
    "hate": "hate kill die murder hurt destroy burn hang shoot",
    "swearing": "damn crap hell bastard ass asshole bitch shit fuck fucking bullshit",
}
#: Words before an insult that address it to someone.
ADDRESS = "you your youre he she they are is such a an these those"
#: Learned words at most; voters see them in two halves, the stronger first.
LEARNED = 128


def word_key(w: str) -> int:
    return int(words(pa.array([w]), marks=False)[0][0])


def keys(text: str) -> np.ndarray:
    return np.array(sorted(word_key(w) for w in text.split()), U)


def hits(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted) or not len(h):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    return wanted[at] == h


class Voters:
    """Votes and features of texts; learned is (word hashes, log odds), strongest first."""

    def __init__(self, learned: np.ndarray, odds: np.ndarray):
        self.lists = [keys(x) for x in LEXICONS.values()]
        self.insults = np.unique(np.concatenate(self.lists[:4]))
        self.address = keys(ADDRESS)
        order = np.argsort(learned)
        self.learned, self.rank = learned[order], np.argsort(np.argsort(-odds))[order] if len(odds) else odds
        self.strong = np.sort(learned[: len(learned) // 4 + 1]) if len(learned) else learned
        self.names = [*LEXICONS, "addressed", "repeated", "shouted", "learned", "learned twice", "learned strong", "nothing found"]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(votes -1, 0 or 1 of each text and voter; features of each text)."""
        h, row, at, _ = words(texts, marks=False)
        n = len(at) - 1
        count = lambda mask: np.bincount(row[mask], minlength=n)
        size = np.maximum(np.diff(at), 1)
        found = [count(hits(h, x)) for x in self.lists]
        insult = hits(h, self.insults)
        before = hits(h, self.address)
        near = insult.copy()
        near[:1] = False
        near[1:] &= before[:-1] & (row[1:] == row[:-1])
        addressed, insulted = count(near), count(insult)
        own = hits(h, self.learned)
        known, strong = count(own), count(hits(h, self.strong))
        raw = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
        loud = np.array([x.count(b"!") for x in raw]) / size
        votes = [np.where(f > 0, 1, 0) for f in found]
        votes += [np.where(addressed > 0, 1, 0), np.where(insulted > 1, 1, 0), np.where((loud > 0.2) & (insulted > 0), 1, 0)]
        votes += [np.where(known > 0, 1, -1), np.where(known > 1, 1, 0), np.where(strong > 0, 1, 0), np.where(insulted + known == 0, -1, 0)]
        features = np.zeros((n, len(self.learned)))
        if own.any():
            np.add.at(features, (row[own], np.searchsorted(self.learned, h[own])), 1)
        dense = [np.log1p(f) for f in found] + [np.log1p(addressed), np.log1p(insulted), np.log1p(known), np.minimum(loud, 1), np.log1p(100 * insulted / size), np.log1p(100 * known / size)]
        return np.stack(votes, 1).astype(np.int8), np.hstack([np.stack(dense, 1), np.log1p(features)])


def training_labels(labels: DataFrame, limit: int) -> dict[int, int]:
    """Labels that may be learned from: at most limit rows, by a hash of their ids, of those whose crc32(doc_id) mod 5 is not 0."""
    rows = labels.where("doc_id is not null and toxic is not null").where(crc_mod() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return {r["doc_id"]: int(r["toxic"] > 0) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()}


def learned_words(sample: DataFrame, positives: int, negatives: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that mark label 1 most surely in sample (doc_id, text, toxic): hashes and log odds, strongest first."""

    def tally(batch: pa.RecordBatch) -> dict[str, object]:
        h, row, _, _ = words(batch.column("text"), marks=False)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        one = np.unique(np.stack([h, row.astype(U)], 1), axis=0) if len(h) else np.zeros((0, 2), U)
        word, at = np.unique(one[:, 0], return_inverse=True)
        t = toxic[one[:, 1].astype(np.int64)]
        return {"word": signed(word), "toxic": np.bincount(at, t, len(word)).astype(np.int64), "clean": np.bincount(at, 1 - t, len(word)).astype(np.int64)}

    tallied = mapped(sample, tally, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = (F.col("toxic") + 0.5) / (positives + 1), (F.col("clean") + 0.5) / (negatives + 1)
    odds = F.log(p / q)
    # a lower bound of the log odds, so that rare words need more evidence
    bound = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = tallied.where(F.col("toxic") >= 3).select("word", odds.alias("odds"), bound.alias("bound")).where("bound > 0.7").orderBy(F.desc("bound"), "word").limit(LEARNED).collect()
    return np.array([r["word"] for r in best], np.int64).view(U), np.array([r["bound"] for r in best])


class LabelModel:
    """P(label | votes), with accuracies and a tree of correlations, by EM."""

    def __init__(self, votes: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 30, smooth: float = 0.5):
        """label: 1, 0, or -1 where it is hidden; rows are patterns that occur count times."""
        self.smooth = smooth
        v = votes.astype(int) + 1
        known = label >= 0
        share = (count * (label == 1)).sum() / max(1, (count * known).sum())
        self.prior = min(max(share, 0.01), 0.5) if known.any() else 0.05
        self.parent = np.full(v.shape[1], -1)
        # without labels: what any voter calls toxic may be so
        first = np.where((v == 2).any(1), 0.5, 0.01)
        if known.any():  # the labelled patterns alone say where to begin
            self.fit(v[known], label[known].astype(float), count[known])
            first = self(votes)
        post = np.where(known, label, first)
        for i in range(rounds):
            if i in (3, 10):
                self.parent = self.tree(v, post, count)
            self.fit(v, post, count)
            self.prior = min(max((count * post).sum() / max(1e-9, count.sum()), 1e-3), 0.999)
            post = np.where(known, label, self(votes))

    def joint(self, v: np.ndarray, w: np.ndarray, i: int, j: int) -> np.ndarray:
        """How often voter i says the row's and voter j the column's vote."""
        return np.bincount(3 * v[:, i] + v[:, j], w, 9).reshape(3, 3)

    def fit(self, v: np.ndarray, post: np.ndarray, count: np.ndarray) -> None:
        """log P(vote of j | label, vote of its parent), for each voter: [label, parent's vote, vote]."""
        self.table = []
        for j, parent in enumerate(self.parent):
            of = []
            for w in (count * (1 - post), count * post):
                alone = np.bincount(v[:, j], w, 3) + self.smooth
                alone /= alone.sum()
                pair = self.joint(v, w, parent, j) if parent >= 0 else np.zeros((3, 3))
                pair = pair + 3 * self.smooth * alone  # little seen together: nearly as if independent
                of.append(np.log(pair / pair.sum(1, keepdims=True)))
            self.table.append(np.stack(of))
        #: The share of right votes among those that a voter gives.
        given = lambda j, x: (count * x * (v[:, j] != 1)).sum()
        self.accuracy = np.array([(count * (post * (v[:, j] == 2) + (1 - post) * (v[:, j] == 0))).sum() / max(1e-9, given(j, 1)) for j in range(v.shape[1])])

    def tree(self, v: np.ndarray, post: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Each voter's parent in the tree of greatest mutual information given the label; -1 for the root, and for voters that nothing is tied to."""
        k = v.shape[1]
        info = np.zeros((k, k))
        for w in (count * (1 - post), count * post):
            for i in range(k):
                for j in range(i):
                    p = self.joint(v, w, i, j) / max(1e-9, count.sum())
                    rows, columns, whole = p.sum(1, keepdims=True), p.sum(0, keepdims=True), max(p.sum(), 1e-12)
                    some = p > 0
                    info[i, j] += (p[some] * np.log(p[some] * whole / (rows * columns)[some])).sum()
        self.information = info = info + info.T
        parent, inside = np.full(k, -1), {0}
        while len(inside) < k:
            i, j = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda x: info[x])
            parent[j] = i if info[i, j] > 1e-6 else -1
            inside.add(j)
        return parent

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(int) + 1
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j, (parent, t) in enumerate(zip(self.parent, self.table, strict=True)):
            above = v[:, parent] if parent >= 0 else 0
            odds += (t[1] - t[0])[above, v[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, limit: int):
    """(voters, label model, coefficients, intercept), or None without rows to learn from.

    The classifier is fitted on at most limit rows, half of them with a vote for toxic
    (by a hash of their ids), each weighted for the rows that it stands for.
    """
    d = documents(docs)
    spark = docs.sparkSession
    known = training_labels(labels, limit)
    positives = sum(known.values())
    learned = np.zeros(0, U), np.zeros(0)
    if 0 < positives < len(known):
        ids = spark.createDataFrame(pa.table({"doc_id": pa.array(list(known), pa.int64()), "toxic": pa.array(list(known.values()), pa.int32())}))
        learned = learned_words(d.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"), positives, len(known) - positives)  # ids: at most limit rows
    voters = Voters(*learned)
    with Scratch(spark) as scratch:

        def vote(batch: pa.RecordBatch) -> dict[str, object]:
            votes, _ = voters(batch.column("text"))
            label = np.array([known.get(i, -1) for i in batch.column("doc_id").to_pylist()], np.int8)
            return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "votes": pa.array([v.tobytes() for v in votes], pa.binary()), "label": label.astype(np.int32), "some": (votes == 1).any(1)}

        # all rows that may be learned from vote
        rows = d.where(crc_mod() != 0).withColumn("h", F.xxhash64("doc_id", "text"))
        votes = scratch.keep(mapped(rows, vote, "doc_id long, h long, votes binary, label int, some boolean"))
        # patterns are few, whatever the input: most voters know two votes, none more than three
        patterns = votes.groupBy("votes", "label").agg(F.count("*").alias("n"), F.first("some").alias("some")).collect()
        if not patterns:
            return None
        table = np.array([np.frombuffer(r["votes"], np.int8) for r in patterns])
        model = LabelModel(table, np.array([r["label"] for r in patterns]), np.array([r["n"] for r in patterns], float))
        parts = []
        for some in (True, False):
            whole = sum(r["n"] for r in patterns if r["some"] == some)
            part = votes.where(F.col("some") == some).select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(limit // 2)
            parts.append(part.select("doc_id", "h", F.lit(float(whole)).alias("whole"), F.lit(some).alias("some")))
        ids = scratch.keep(parts[0].union(parts[1]))
        ids = ids.join(F.broadcast(ids.groupBy("some").agg(F.count("*").alias("k"))), "some").select("doc_id", "h", (F.col("whole") / F.col("k")).alias("stands"))

        def example(batch: pa.RecordBatch) -> dict[str, object]:
            votes, features = voters(batch.column("text"))
            post, stands = model(votes), batch.column("stands").to_numpy()
            return {"features": pa.array(list(np.concatenate([features, features])), pa.list_(pa.float64())), "label": np.repeat([1.0, 0.0], len(post)), "weight": np.concatenate([post * stands, (1 - post) * stands])}

        sample = rows.join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "stands")  # at most limit rows
        examples = scratch.keep(mapped(sample, example, "features array<double>, label double, weight double"))
        fit = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-3).fit(examples.select(array_to_vector("features").alias("features"), "label", "weight").where("weight > 0"))
        return voters, model, fit.coefficients.toArray(), float(fit.intercept)


def scored(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels gives (doc_id, toxic).

    limit bounds the labelled rows that learned words come from and the rows that the
    classifier is fitted on; votes are counted over all rows that may be learned
    from.  Without labels the fixed voters alone are weighed; without rows to learn
    from all scores are 0.  Null texts are scored as empty ones, texts of any length
    whole; rows without a doc_id are left out; rows that repeat are scored one by
    one, and of labels that contradict each other toxic holds; other columns are
    ignored.
    """
    got = trained(docs, labels, limit)

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        if got is None:
            s = np.zeros(batch.num_rows)
        else:
            voters, _, weights, intercept = got
            s = 1 / (1 + np.exp(-np.clip(voters(batch.column("text"))[1] @ weights + intercept, -50, 50)))
        return {"doc_id": batch.column("doc_id"), "score": s}

    out = mapped(documents(docs), score, "doc_id long, score double")
    return out.select("doc_id", (crc_mod() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> DataFrame:
    """docs without those that are predicted toxic; rows without a doc_id stay."""
    bad = scored(docs, labels, limit).where("predicted = 1").select("doc_id")
    return only(docs, bad, "left_anti")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """scored() of the whole table documents by the table labels; see there for nulls, empty and repeated rows."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
