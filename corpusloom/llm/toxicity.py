"""Toxicity by weak supervision.

Voters say toxic or abstain: words of lexicons (a list per language), texts with several
words of one lexicon, and patterns (words and word beginnings, there or frequent) mined
from labelled training rows. A generative label model, fitted to the votes alone, estimates
how often each voter fires in toxic and in clean documents and which voters fire together
in toxic ones. Its posterior labels train a linear classifier over words and word
beginnings, which scores every whole text. Given labels choose voters and calibrate the
final score; the label model never sees them.

Voters are mined from at most ``most_rows`` labelled documents, chosen by a hash, and the
classifier is fitted on these. The label model is fitted on all documents that aren't held
out: their votes are written once, equal ones as one row with its number, and each round of
expectation maximisation is a sum over that table in Spark.

Defined results: a null or empty text has no features and the score of the bias; without
labels of both classes every score is the smoothed share of label 1 (0.5 without any);
repeated rows are scored as rows; of repeated labels of a doc_id the largest counts, of
repeated training documents the smallest text; a null doc_id is never held out; a very
long text is scored whole, a text being in memory at a time; columns called held_out,
score and predicted are replaced, all others kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import linear
from corpusloom.llm.arrow_text import small_batches
from corpusloom.llm.shared import materialize, scratch
from corpusloom.llm.text_features import LEXICAL_FEATURES, add_scores, held_out, lexical_features, training_sample, word_feature

MOST_ROWS = 12_000
THRESHOLD = 0.3
#: Rows of votes, and voters, that a task spreads out at once.
VOTE_ROWS, VOTER_BLOCK = 2_000, 512
#: The fit ends when no rate moves by more than this share of itself; on sf0.1 later rounds move one vote vector, of 14 documents, over a half.
LEAST_MOVE = 0.01
#: Chosen on folds of the training rows.
MODEL_LEAST_Z, VOTER_LEAST_Z, LEAST_PRECISION = 2.5, 4.0, 0.8
#: Voters whose firing correlates this much are of one kind.
LEAST_CORRELATION = 0.25
#: Common insults of four languages.
LEXICONS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile jerk freak filth vermin coward garbage creep fool",
    "fr": "idiot idiote imbécile crétin connard connasse abruti abrutie ordure minable débile salaud salope bouffon racaille crapule pourriture lâche",
    "de": "idiot dummkopf trottel abschaum versager arschloch depp vollidiot schwachkopf mistkerl drecksau feigling blödmann widerling ekelhaft erbärmlich",
    "es": "idiota imbécil estúpido estúpida basura escoria inútil tonto cabrón gilipollas payaso asqueroso cobarde miserable patético canalla",
}


@dataclass
class Voters:
    """What votes: features (of the lexicons, then of the patterns), and lexicons of which a text has two words or more."""

    features: np.ndarray
    lexicons: list[np.ndarray]

    @classmethod
    def of(cls, lexicons: list[np.ndarray], patterns: np.ndarray) -> Voters:
        return cls(np.unique(np.concatenate([*lexicons, patterns])).astype(np.int64), lexicons)

    def __len__(self) -> int:
        return len(self.features) + len(self.lexicons)

    def fired(self, owner: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of (text, feature) pairs the (text, voter) pairs, in order."""
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        hit = self.features[at] == found
        texts, voters = [owner[hit]], [at[hit]]
        for i, words in enumerate(self.lexicons):
            several = np.flatnonzero(np.bincount(texts[0][np.isin(voters[0], np.searchsorted(self.features, words))], minlength=n) > 1)
            texts.append(several)
            voters.append(np.full(len(several), len(self.features) + i))
        texts, voters = np.concatenate(texts), np.concatenate(voters)
        order = np.lexsort([voters, texts])
        return texts[order], voters[order]


def vote(rows: list[np.ndarray], lexicons: list[np.ndarray], patterns: np.ndarray) -> np.ndarray:
    """Rows by voters, as ``Voters.fired`` says of each row.

    Voters that never fire, and all but the first of those that fire on the same rows, go.
    """
    votes = all_votes(rows, Voters.of(lexicons, patterns))
    votes = votes[:, votes.any(axis=0)]
    _, first = np.unique(np.packbits(votes, axis=0), axis=1, return_index=True)
    return votes[:, np.sort(first)]


def all_votes(rows: list[np.ndarray], voters: Voters) -> np.ndarray:
    votes = np.zeros((len(rows), len(voters)), bool)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    votes[voters.fired(owner, np.concatenate(rows) if rows else np.zeros(0, np.int64), len(rows))] = True
    return votes


def mine_voters(rows: list[np.ndarray], target: np.ndarray, least_z: float = VOTER_LEAST_Z, least_precision: float = LEAST_PRECISION) -> np.ndarray:
    """Features that point clearly and precisely to toxic rows, the most frequent first, one voter each."""
    ratio = linear.log_count_ratios(rows, target, LEXICAL_FEATURES, least_z)
    hits, total = linear.class_counts(rows, target, LEXICAL_FEATURES)
    found = np.flatnonzero((ratio > 0) & (hits >= least_precision * (total + 1)))
    return found[np.argsort(-hits[found], kind="stable")]


def connected(n: int, edges: np.ndarray) -> np.ndarray:
    """A number for each of ``n`` voters: those that pairs of ``edges`` connect share it."""
    root = np.arange(n)
    both = np.concatenate([edges, edges[:, ::-1]]).astype(np.int64)
    while True:
        new = root.copy()
        np.minimum.at(new, both[:, 0], root[both[:, 1]])
        new = new[new]
        if (new == root).all():
            return np.unique(root, return_inverse=True)[1]
        root = new


def correlated(i: np.ndarray, j: np.ndarray, together: np.ndarray, fires: np.ndarray, rows: int, least: float = LEAST_CORRELATION) -> np.ndarray:
    """Which of the pairs of voters fire together as much as voters of one kind do, given how often each fires."""
    share = fires / rows
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return together / rows - share[i] * share[j] >= least * spread[i] * spread[j]


def kinds_of(votes: np.ndarray, least: float = LEAST_CORRELATION) -> np.ndarray:
    """A number for each voter: those connected by correlated firing share it."""
    x = votes.astype(np.float32)
    together = x.T @ x
    i, j = np.nonzero(np.triu(together, 1))
    near = correlated(i, j, together[i, j].astype(float), votes.sum(axis=0).astype(float), len(x), least)
    return connected(votes.shape[1], np.stack([i[near], j[near]], axis=1))


@dataclass
class LabelModel:
    """A clean class (first) and toxic classes, each with its share and every voter's rate of firing in it.

    Inside a class voters fire independently, so what correlates voters among toxic
    documents is that its classes differ: one language's voters fire together, and their
    silence says nothing about another language.
    """

    shares: np.ndarray
    rates: np.ndarray

    def responsibilities(self, votes: np.ndarray) -> np.ndarray:
        odds = (np.log(self.rates) - np.log1p(-self.rates)).T.astype(np.float32)
        log = np.log(self.shares) + np.log1p(-self.rates).sum(axis=1) + (votes.astype(np.float32) @ odds).astype(float)
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        return new / new.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes."""
        return 1 - self.responsibilities(votes)[:, 0]

    def accuracies(self) -> np.ndarray:
        """Of the documents on which a voter fires, the share that is toxic."""
        hits = self.shares[:, None] * self.rates
        return hits[1:].sum(axis=0) / hits.sum(axis=0)

    def correlations(self) -> np.ndarray:
        """Correlation of each two voters among toxic documents, as the classes give it."""
        share = self.shares[1:] / self.shares[1:].sum()
        mean = share @ self.rates[1:]
        moved = self.rates[1:] - mean
        cov = (share[:, None] * moved).T @ moved
        spread = np.sqrt(mean * (1 - mean))
        return cov / np.outer(spread, spread)


def beginning(votes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Responsibilities to start from: each vote is right at least half of the time, independently, and a document is of the kinds that vote on it."""
    by_kind = np.stack([votes[:, kinds == k].sum(axis=1) for k in range(kinds.max() + 1)], axis=1).astype(float)
    fired = by_kind.sum(axis=1, keepdims=True)
    resp = np.where(fired > 0, by_kind / np.maximum(fired, 1) * (1 - 0.5**fired), 0.01 / by_kind.shape[1])
    return np.concatenate([1 - resp.sum(axis=1, keepdims=True), resp], axis=1)


def mass(votes: np.ndarray, counts: np.ndarray, kinds: np.ndarray, model: LabelModel | None) -> np.ndarray:
    """Per class its documents, and in further columns those on which each voter fires; a row of votes stands for ``counts`` documents."""
    resp = (beginning(votes, kinds) if model is None else model.responsibilities(votes)) * counts[:, None]
    return np.concatenate([resp.sum(axis=0)[:, None], resp.T @ votes.astype(float)], axis=1)


def maximised(sums: np.ndarray, smooth: float = 1.0) -> LabelModel:
    """The model that the sums ask for; no voter may fire more often in the clean class than in a toxic one.

    Rates are smoothed towards a voter's rate over all documents.
    """
    weight, hits = sums[:, 0], sums[:, 1:]
    rates = (hits + smooth * hits.sum(axis=0) / weight.sum()) / (weight[:, None] + smooth)
    rates[1:] = np.maximum(rates[1:], rates[0])
    return LabelModel((weight + 1e-3) / (weight + 1e-3).sum(), np.clip(rates, 1e-7, 1 - 1e-7))


def expectation_maximisation(sums_of: Callable[[LabelModel | None], np.ndarray], rounds: int = 100, least: float = LEAST_MOVE) -> LabelModel:
    """From the votes alone, until no rate or share moves by ``least`` of itself and a hundredth of ``least``."""
    model = maximised(sums_of(None))
    for _ in range(rounds - 1):
        old, model = model, maximised(sums_of(model))
        moved = np.abs(model.rates - old.rates) > least * old.rates + least / 100
        if not moved.any() and np.abs(model.shares - old.shares).max() < least / 100:
            break
    return model


def fit_label_model(votes: np.ndarray, rounds: int = 100) -> LabelModel:
    """The label model of votes in memory; there is a toxic class for each kind of voters."""
    kinds, ones = kinds_of(votes), np.ones(len(votes))
    return expectation_maximisation(lambda model: mass(votes, ones, kinds, model), rounds)


def vote_table(docs: DataFrame, voters: Voters) -> DataFrame:
    """votes (numbers of voters as bytes of int32) and n, the documents that have just these; every document that isn't held out counts."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in small_batches(batches, 0, 3_000_000):
            texts, fired = sent.value.fired(*lexical_features(batch.column(0)), batch.num_rows)
            cuts = np.searchsorted(texts, np.arange(batch.num_rows + 1))
            numbers = fired.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([numbers[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["votes"])

    found = docs.filter(~held_out()).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "votes binary")
    return materialize(found.groupBy("votes").agg(F.count("*").alias("n")).sortWithinPartitions("votes"), scratch(docs.sparkSession, "votes"))


def spread(batches, voters: int):
    """Rows by voters, and each row's n, of a vote table's batches, some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, VOTE_ROWS):
            part = batch.slice(at, VOTE_ROWS)
            own = [np.frombuffer(v, np.int32) for v in part.column(0).to_pylist()]
            votes = np.zeros((len(own), voters), bool)
            votes[np.repeat(np.arange(len(own)), [len(v) for v in own]), np.concatenate(own)] = True
            yield votes, part.column(1).to_numpy().astype(float)


def voters_that_count(table: DataFrame, voters: int) -> tuple[np.ndarray, np.ndarray]:
    """Voters that fire, but for all but the first of those that fire on the same documents, and their kinds.

    Tasks add up how often two voters fire together, a block of voters at a time; only
    correlated pairs reach the driver.
    """

    def fires(batches):
        total = np.zeros(voters)
        for votes, n in spread(batches, voters):
            total += n @ votes
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there].astype(np.int64))], names=["voter", "n"])

    count = np.zeros(voters)
    for r in table.mapInArrow(fires, "voter int, n long").groupBy("voter").agg(F.sum("n").alias("n")).collect():
        count[r["voter"]] = r["n"]
    rows = table.agg(F.sum("n")).first()[0] or 0

    def pairs(at: int):
        def run(batches):
            together = np.zeros((min(VOTER_BLOCK, voters - at), voters))
            for votes, n in spread(batches, voters):
                together += (votes[:, at : at + VOTER_BLOCK] * n[:, None]).T @ votes
            i, j = np.nonzero(np.triu(together, at + 1))
            yield pa.RecordBatch.from_arrays([pa.array(i + at, pa.int32()), pa.array(j, pa.int32()), pa.array(together[i, j].astype(np.int64))], names=["i", "j", "n"])

        return table.mapInArrow(run, "i int, j int, n long")

    found = reduce(DataFrame.unionByName, [pairs(at) for at in range(0, voters, VOTER_BLOCK)]).groupBy("i", "j").agg(F.sum("n").alias("n"))
    sent = table.sparkSession.sparkContext.broadcast(count)

    def near(batches):
        for b in batches:
            i, j, n = (b.column(k).to_numpy() for k in range(3))
            yield b.filter(pa.array(correlated(i, j, n.astype(float), sent.value, rows)))

    got = found.mapInArrow(near, found.schema).toArrow()
    i, j, n = (got.column(k).to_numpy() for k in range(3))
    same = (n == count[i]) & (n == count[j])
    there = count > 0
    there[j[same]] = False
    kept = np.flatnonzero(there)
    place = np.full(voters, -1)
    place[kept] = np.arange(len(kept))
    edges = np.stack([place[i], place[j]], axis=1)
    return kept, connected(len(kept), edges[(edges >= 0).all(axis=1)])


def fit_to_table(table: DataFrame, voters: int, kept: np.ndarray, kinds: np.ndarray, rounds: int = 100) -> LabelModel:
    """The label model of all documents of a vote table; each round is one pass over it."""
    shape = (int(kinds.max()) + 2, len(kept) + 1)

    def sums_of(model: LabelModel | None) -> np.ndarray:
        sent = table.sparkSession.sparkContext.broadcast((kept, kinds, model))

        def run(batches):
            total = np.zeros(shape)
            own, of, now = sent.value
            for votes, n in spread(batches, voters):
                total += mass(votes[:, own], n, of, now)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

        got = table.mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        sent.unpersist()
        total = np.zeros(shape)
        total.flat[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return total

    return expectation_maximisation(sums_of, rounds)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS) -> linear.LinearModel:
    rows, target = training_sample(docs, labels, label, lexical_features, most_rows)
    if not 0 < target.sum() < len(target):
        return linear.fit([], np.zeros(0), target, LEXICAL_FEATURES)
    voters = Voters.of([np.array([word_feature(w) for w in words.split()]) for words in LEXICONS.values()], mine_voters(rows, target))
    table = vote_table(docs, voters)
    kept, kinds = voters_that_count(table, len(voters))
    posterior = fit_to_table(table, len(voters), kept, kinds).posterior(all_votes(rows, voters)[:, kept]) if len(kept) else np.zeros(len(rows))
    return linear.fit(rows, posterior, target, LEXICAL_FEATURES, MODEL_LEAST_Z)


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted."""
    scored = add_scores(docs, fit(train_docs, labels, label), lexical_features)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
