"""Toxicity by weak supervision: lexicon and pattern voters, a generative model of their votes, a linear classifier.

1. Voters: words and word beginnings found in labelled rows (``mined_lexicon``), a fixed lexicon, and patterns.
2. Label model (``LabelModel``): the votes, and the given label as one more noisy voter, come from a hidden class.  Expectation
   maximisation estimates every voter's accuracy; correlated voters hang together in a tree for each class.
3. A logistic regression learns the posterior labels from the voters' counts; its sigmoid is the score.

Only the fit uses a bounded sample of labelled rows (``rows_per_class`` of each label, about); scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.tables import map_columns, written

LEXICON = frozenset("""idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown clowns jerk imbecile filth vermin
    dumbass bastard bitch asshole retard crap shit fuck fucking""".split())
WORDS = re.compile(r"[^\W\d_]+")
PATTERNS = ("lexicon", "lexicon_rate", "shouted", "exclaimed", "masked")
MASKED = re.compile(r"\b\w[*@#$!]{2,}\w*|\b[a-z]*[@$][a-z@$]*\b", re.I)


def keys_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of 5 and 7 letters, marked by a hyphen."""
    return (word, *(f"{word[:n]}-" for n in (5, 7) if len(word) > n))


def patterns_of(text: str, words: list[str]) -> list[float]:
    """Fixed voters: lexicon hits, their share, words in capitals, exclamation marks and masked words, as log counts."""
    n = max(1, len(words))
    hits = sum(w in LEXICON for w in words)
    shouted = sum(w.isupper() and len(w) > 3 for w in WORDS.findall(text)) if not text.islower() else 0
    return [np.log1p(hits), np.log1p(1000 * hits / n), np.log1p(100 * shouted / n), np.log1p(100 * text.count("!") / n), np.log1p(len(MASKED.findall(text)))]


def counts_of(words: list[str], voters: dict[str, int]) -> dict[int, int]:
    """How often each mined voter is met."""
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    found: dict[int, int] = {}
    for w, n in seen.items():
        for key in keys_of(w):
            if (v := voters.get(key)) is not None:
                found[v] = found.get(v, 0) + n
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """About ``rows_per_class`` labelled rows of each class, chosen by a hash of the id, and the share taken of each."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, rows_per_class / n) for k, n in totals.items()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) / (1 << 20)
    taken = known.where(draw < F.coalesce(*[F.when(F.col("toxic") == k, F.lit(s)) for k, s in share.items()], F.lit(0.0)))
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(taken), id_col)    # the sample's size is bounded
    return rows.select("text", "toxic"), share


LEAST_ODDS = 6.0


def mined_lexicon(sample: DataFrame, most: int = 256, least: int = 3) -> list[str]:
    """Words and beginnings that speak for a toxic label, best first, at most ``most``.

    Evidence is counted once for each pair of neighbouring words, so copies of a text do not count again; a key must pass
    a likelihood-ratio test at a level that falls with the number of keys tested, and its odds of standing in a toxic row must be
    ``LEAST_ODDS`` times those of all evidence, a bound that can be met whatever share of the sample is toxic."""
    def run(texts, toxic):
        rows = set()
        for text, label in zip(texts, toxic):
            words = WORDS.findall(text.lower())
            for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                if len(word) > 2:
                    near = f"{before} {after}"
                    rows |= {(key, label, near) for key in keys_of(word)}
        keys, labels, near = zip(*rows) if rows else ((), (), ())
        return [list(keys), list(labels), list(near)]
    seen = map_columns(sample, ["text", "toxic"], run, "key string, toxic int, near string")
    counts = seen.select("key", "toxic", F.xxhash64("near").alias("near")).distinct().groupBy("key").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= least)
    counts = written(counts, "evidence")
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not total.n or not total.a or not total.b:
        return []
    rate = total.a / (total.a + total.b)
    n = F.col("a") + F.col("b")
    term = lambda x, expected: F.when(x > 0, x * F.log(x / (n * expected))).otherwise(0.0)
    ratio = 2 * (term(F.col("a"), rate) + term(F.col("b"), 1 - rate))
    odds = (F.col("a") + 0.5) / (F.col("b") + 0.5)
    good = counts.withColumn("ratio", ratio).where((odds > LEAST_ODDS * total.a / total.b) & (F.col("ratio") > 2 * np.log(total.n) + 6))
    return [r.key for r in good.orderBy(F.desc("ratio"), "key").limit(most).collect()]


class LabelModel:
    """P(votes | class) with one tree of dependent voters per class; the given label is a voter outside the tree."""

    def __init__(self, votes: np.ndarray, given: np.ndarray, rounds: int = 8, trust: float = 0.97):
        self.posterior = np.where(given > 0, trust, 1 - trust)
        n, m = votes.shape
        for _ in range(rounds):
            weight = np.stack([1 - self.posterior, self.posterior])
            total = weight.sum(1) + 1e-9
            logs = np.log(total / total.sum())[:, None].repeat(n, 1)
            for y in (0, 1):
                right = min(0.999, max(trust, (weight[y] * (given == y)).sum() / total[y]))
                logs[y] += np.log(np.where(given == y, right, 1 - right))
                if m:
                    logs[y] += self.tree(votes, weight[y], total[y])
            self.posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))

    @staticmethod
    def tree(votes: np.ndarray, weight: np.ndarray, total: float) -> np.ndarray:
        """Log likelihood of every row under the voters' rates and the strongest dependences between them."""
        on = (weight @ votes + 0.5) / (total + 1)
        both = ((votes * weight[:, None]).T @ votes + 0.25) / (total + 1)
        cells = [both, on[:, None] - both, on[None, :] - both, 1 - on[:, None] - on[None, :] + both]
        alone = [on[:, None] * on[None, :], on[:, None] * (1 - on)[None, :], (1 - on)[:, None] * on[None, :], (1 - on)[:, None] * (1 - on)[None, :]]
        gain = sum(np.maximum(c, 1e-9) * np.log(np.maximum(c, 1e-9) / np.maximum(a, 1e-12)) for c, a in zip(cells, alone))
        m = len(on)
        parent, best, done = np.full(m, -1), np.full(m, -np.inf), np.zeros(m, bool)
        best[0] = 0.0
        for _ in range(m):
            j = int(np.argmax(np.where(done, -np.inf, best)))
            done[j] = True
            nearer = ~done & (gain[j] > best)
            parent[nearer], best[nearer] = j, gain[j][nearer]
        out = np.zeros(len(votes))
        for j in range(m):
            p = parent[j]
            given_on, given_off = (on[j], on[j]) if p < 0 else (both[j, p] / on[p], (on[j] - both[j, p]) / (1 - on[p]))
            rate = np.clip(given_off if p < 0 else np.where(votes[:, p] > 0, given_on, given_off), 1e-4, 1 - 1e-4)
            out += np.where(votes[:, j] > 0, np.log(rate), np.log(1 - rate))
        return out


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the first is the constant) of a ridge logistic regression on soft targets, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (target - p)) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    voters: dict[str, int]
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        text = text or ""
        words = WORDS.findall(text.lower())
        fixed = len(PATTERNS)
        z = self.weights[0] + float(np.dot(self.weights[1:1 + fixed], patterns_of(text, words)))
        for v, n in counts_of(words, self.voters).items():
            z += self.weights[1 + fixed + v] * np.log1p(n)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 6000, most_voters: int = 256, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Voters, label model and classifier from about ``rows_per_class`` labelled rows of each class.

    ``labels`` has ``id_col`` and toxic (0/1); a document labelled more than once has the label of most of its rows, null
    labels and ids do not count.  Without labels of both classes the score rests on the lexicon alone."""
    sample, share = labelled_sample(docs, labels, rows_per_class, id_col, text_col)
    sample = written(sample, "labelled")
    keys = mined_lexicon(sample, most_voters)
    voters = {key: i for i, key in enumerate(keys)}

    def run(texts, toxic):
        rows = []
        for text in texts:
            words = WORDS.findall(text.lower())
            found = counts_of(words, voters)
            rows.append((patterns_of(text, words), list(found), list(found.values())))
        fixed, index, counts = zip(*rows) if rows else ((), (), ())
        return [list(toxic), [[float(v) for v in x] for x in fixed], list(index), list(counts)]
    rows = map_columns(sample, ["text", "toxic"], run, "toxic int, fixed array<double>, voters array<int>, counts array<int>").collect()    # bounded by the sample
    width = 1 + len(PATTERNS) + len(voters)
    given = np.array([r.toxic for r in rows], float)
    if not len(given) or given.min() == given.max():
        weights = np.zeros(width)
        weights[:2] = -3.0, 4.0
        return ToxicityModel(voters, weights)
    x = np.zeros((len(rows), width - 1))
    for i, r in enumerate(rows):
        x[i, :len(PATTERNS)] = r.fixed
        x[i, [len(PATTERNS) + v for v in r.voters]] = np.log1p(r.counts)
    fires = (x > np.where(np.arange(width - 1) < len(PATTERNS), np.median(x, 0), 0)).astype(float)
    target = LabelModel(fires, given).posterior
    weights = logistic(x, target, np.ones(len(rows)))
    weights[0] += np.log(share[0] / share[1])    # back from the sample's share of classes to that of all labelled rows
    return ToxicityModel(voters, weights)


def scores(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None, text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``carry`` (doc_id) of every row and the score of its whole text; a null text is an empty one.

    Rows are independent: null ids, ties and repeated rows stay as they are; columns not carried are left out."""
    return map_columns(docs, [text_col], lambda texts: [[model.score(t) for t in texts]], f"{name} double", carry or ["doc_id"])
