"""Toxicity by weak supervision.

Voters look for words of fixed lexicons, for words and word beginnings that marked documents have far more often than
others, and for patterns. Every document of the corpus is voted on, and the counts of vote patterns feed a generative
model: a hidden class, and for each voter how often it fires in either class. Expectation maximisation estimates these
accuracies; what two voters still share given the class is their correlation, and correlated voters weigh less.
The model's posteriors label a bounded sample, on which a linear classifier over words is trained; it scores all texts.

Marks of held-out ids are never read: the sample, of at most SAMPLE marked documents by hash of the id, leaves them out.
The votes are counted over all documents, at every size.

Cases. A null or empty text has no words and scores by the constant alone. Ids with several labels count with their
mean. Null labels and null ids teach nothing; without any label the fixed lexicons and patterns remain. Columns other
than `doc_id` and `text` are not read. Repeated rows are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import by_batch, by_row, held_out, learnable, staged

SAMPLE, VOCABULARY, LEAST_DF = 20_000, 60_000, 3
#: Mined tokens at most, the voters they are dealt to, and the log odds and marked documents that a mined token has at least.
MINED, SHARDS, ODDS, LEAST_TOXIC = 600, 6, 3.5, 4
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 6)

# Common insults of four languages, a voter each.
LEXICONS = {
    "en_mind": "idiot moron stupid dumb imbecile fool cretin dimwit",
    "en_worth": "loser worthless pathetic trash scum garbage vermin filth",
    "en_disgust": "disgusting clown freak pig creep ugly nasty vile",
    "de": "idiot dummkopf trottel arschloch abschaum versager widerlich blödmann",
    "fr": "idiot imbécile connard crétin minable ordure débile abruti",
    "es": "idiota imbécil estúpido basura escoria inútil asqueroso payaso",
}
#: Patterns: an insult addressed to somebody, letters replaced by signs, shouting.
PATTERNS = {
    "addressed": re.compile(r"\b(?:you|you're|du|tu|vous|usted)\s+(?:are\s+|bist\s+|es\s+)?(?:an?\s+|ein\s+|un\s+)?(?:idiot|moron|loser|stupid|clown|scum|trottel|imbécile|idiota)", re.I),
    "disguised": re.compile(r"\b[a-z]+[@$!*013][a-z@$!*013]*[@$!*013][a-z]+\b", re.I),
    "shouted": re.compile(r"(?:\b[A-Z]{3,}\b[!\s]+){4}"),
}
VOTERS = [*LEXICONS, *(f"mined_{i}" for i in range(SHARDS)), *PATTERNS]


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text, the beginnings of longer ones, and those that several of them share."""
    words = set(WORD.findall((text or "").lower()))
    found = set(words)
    for n in BEGINNINGS:
        starts = [w[:n] for w in words if len(w) > n]
        once = set(starts)
        found.update(["^" + s for s in once])
        if len(once) < len(starts):
            found.update(["^^" + s for s, k in Counter(starts).items() if k > 1])
    return found


@dataclass
class Voters:
    lexicons: list[frozenset[str]]

    def __call__(self, text: str | None, found: set[str]) -> int:
        """A bit for each voter that fires."""
        bits = sum(1 << i for i, words in enumerate(self.lexicons) if not words.isdisjoint(found))
        text = text or ""
        return bits | sum(1 << i for i, p in enumerate(PATTERNS.values(), len(self.lexicons)) if p.search(text))


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # [2, voters]: how often each voter fires, by class
    weight: np.ndarray  # less than 1 where voters repeat each other
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for rows of votes."""
        log = np.where(votes[:, None, :] > 0, np.log(self.fires), np.log(1 - self.fires)) @ self.weight
        odds = np.log(self.prior / (1 - self.prior)) + log[:, 1] - log[:, 0]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 from vote bits."""
    return (np.asarray(bits, np.int64)[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


def fit_label_model(bits: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> LabelModel:
    """Accuracies and correlations from the counts of vote patterns, without labels."""
    votes, n = unpacked(bits), counts.astype(float)
    total = max(1.0, n.sum())
    prior = min(max(prior, 0.01), 0.5)
    rate = (n @ votes + 0.5) / (total + 1)
    # Voters start out as rare in the clean class and as common in the other as the prior lets them be.
    fires = np.clip(np.stack([0.2 * rate, np.minimum(0.9, 0.5 * rate / prior + 0.2)]), 1e-4, 0.95)
    model = LabelModel(prior, fires, np.ones(len(VOTERS)), np.eye(len(VOTERS)))
    for k in range(rounds):
        p = model.posterior(votes)
        parts = np.stack([n * (1 - p), n * p])
        sums = parts.sum(1)
        # Pseudo-counts hold voters that hardly ever fire.
        model.fires = np.clip((parts @ votes + np.array([[0.02], [1.0]])) / (sums[:, None] + 2.0), 1e-5, 0.999)
        model.prior = float(np.clip((sums[1] + 1) / (total + 2), 0.5 * prior, 2 * prior))
        if k % 10 == 9:
            shared = np.zeros((len(VOTERS),) * 2)
            for c in (0, 1):
                rest = votes - model.fires[c]
                shared += (rest * parts[c][:, None]).T @ rest
            spread = np.sqrt(np.maximum(np.diag(shared), 1e-9))
            model.correlation = shared / np.outer(spread, spread)
            model.weight = 1 / (np.maximum(0, model.correlation) * (model.correlation > 0.05)).sum(0).clip(1)
    return model


def train(rows: list[np.ndarray], target: np.ndarray, size: int, steps: int = 150, decay: float = 6e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of present features, by gradient steps scaled to each feature."""
    which = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    w, bias = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))) if len(target) else -2.0
    seen, seen_bias = np.full(size, 1e-8), 1e-8
    held = np.ones(size)
    held[size - len(VOTERS) :] = 0.05  # votes are trusted more than single words
    for _ in range(steps if len(target) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(which, w[cols], len(rows)) + bias, -30, 30)))
        rest = (p - target) / len(target)
        g = np.bincount(cols, rest[which], size) + decay * w * held
        seen += g * g
        seen_bias += rest.sum() ** 2
        w -= 0.3 * g / np.sqrt(seen)
        bias -= 0.1 * rest.sum() / np.sqrt(seen_bias)
    return w, bias


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # of the tokens, then of the voters
    bias: float
    voters: Voters
    labels: LabelModel

    def of(self, bits: int, ids: list[int]) -> float:
        """Score from votes and token numbers."""
        x = self.bias + self.weights[ids].sum() if ids else self.bias
        x += sum(w for i, w in enumerate(self.weights[len(self.index) :].tolist()) if bits >> i & 1)
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))

    def score(self, text: str | None) -> float:
        found = tokens(text)
        return self.of(self.voters(text, found), [self.index[t] for t in found if t in self.index])


_SEEN = "doc_id bigint, bits int, ids array<int>"


def fit(docs: DataFrame, labels: DataFrame, mark: str = "toxic") -> tuple[Model, DataFrame]:
    """Voters, their label model over all documents, and a classifier on the posteriors of a bounded sample; and the votes and tokens of all documents."""
    sample = learnable(labels, mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = staged(sample, "toxicity-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")  # at most SAMPLE ids
    known = by_row(texts, lambda text, y: (text, sorted(tokens(text)), y), "text string, tokens array<string>, y double")
    known = staged(known, "toxicity-known")
    per_token = known.select(F.explode("tokens").alias("token"), "y").groupBy("token").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    vocabulary = per_token.where(f"n >= {LEAST_DF}").orderBy(F.desc("n"), "token").limit(VOCABULARY).toPandas()
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()

    # A token tells if it is far more common in marked documents, and in at least a few of them.
    odds = np.log(((vocabulary["toxic"] + 0.1) / (toxic + 0.2)) / ((vocabulary["n"] - vocabulary["toxic"] + 0.5) / (n - toxic + 1))) if n else np.zeros(0)
    telling = vocabulary.assign(odds=odds, strength=odds * np.sqrt(vocabulary["toxic"]))
    telling = telling[(telling["odds"] > ODDS) & (telling["toxic"] >= LEAST_TOXIC)].nlargest(MINED, "strength")["token"].tolist()
    shards = [frozenset(telling[i::SHARDS]) for i in range(SHARDS)]
    voters = Voters([*(frozenset(words.split()) for words in LEXICONS.values()), *shards])

    index = {t: i for i, t in enumerate(vocabulary["token"])}

    def described(ids, texts):
        for doc_id, text in zip(ids, texts):
            found = tokens(text)
            yield doc_id, voters(text, found), [index[t] for t in found if t in index]

    seen = staged(by_batch(docs.select("doc_id", "text"), described, _SEEN), "toxicity-seen")
    patterns = seen.groupBy("bits").count().toPandas()  # at most 2 ** voters rows
    labels_of = fit_label_model(patterns["bits"].to_numpy(), patterns["count"].to_numpy(), toxic / n if n else 0.1)

    size = len(index) + len(VOTERS)

    def taught(group: pd.DataFrame) -> pd.DataFrame:
        votes = unpacked(group["bits"].to_numpy())
        rows = [np.concatenate([np.asarray(ids, np.int32), (len(index) + np.flatnonzero(v)).astype(np.int32)]) for ids, v in zip(group["ids"], votes)]
        w, bias = train(rows, labels_of.posterior(votes), size)
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    # One task trains, on at most SAMPLE ids; the driver gets the weights.
    sampled = seen.join(F.broadcast(sample), "doc_id").select("bits", "ids", F.lit(0).alias("all"))
    found = sampled.groupBy("all").applyInPandas(taught, "w binary, bias double").collect()
    if found:
        w, bias = np.frombuffer(found[0]["w"]), found[0]["bias"]
    else:  # no labels: the voters themselves
        w, bias = np.zeros(size), -2.0
        w[len(index) :] = (np.log(labels_of.fires[1]) - np.log(labels_of.fires[0])) * labels_of.weight
    return Model(index, w, bias, voters, labels_of), seen


def score(seen: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of votes and tokens."""

    def rows(doc_ids, bits, ids):
        scores = [model.of(b, i) for b, i in zip(bits, ids)]
        return ((d, s, int(s >= threshold)) for d, s in zip(doc_ids, scores))

    scored = by_batch(seen.select("doc_id", "bits", "ids"), rows, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, from one pass over the texts and another over the sample's."""
    model, seen = fit(docs, labels)
    return score(seen, model)
