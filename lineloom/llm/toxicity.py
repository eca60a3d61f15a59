"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings) and patterns. A generative label model
estimates, for each voter, how often it fires on either class, and how voters fire together beyond what
the class explains; voters that repeat each other count for less. Its posterior labels train a linear
classifier over lexicon counts, which scores every text.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that the model is fitted on: those with the least hash of their id.
SAMPLE = 2500
THRESHOLD = 0.7
#: Words that open a lexicon where no labels tell more.
OPENING = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
PATTERNS = {
    "shouting": re.compile(r"(?:\b[^\W\d_a-z]{4,}[!?]+\s*){3}"),
    "you are": re.compile(r"\byou(?:'re| are)(?: an?| such an?)? (?:" + "|".join(OPENING) + r")\b", re.I),
}
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
VOTERS = 80
ENTRIES = 400


def entries(text: str | None) -> set[str]:
    """Words and word beginnings (marked by a ``*``) of a text."""
    words = {w for w in WORDS.findall((text or "").lower()) if len(w) > 2}
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def lexicon(toxic: list[str], clean: list[str]) -> list[str]:
    """Entries that mark toxic texts, greedily chosen so that each adds texts the others miss.

    Texts are gone through one by one; only counts and the few likely entries are held.
    """
    hits: Counter = Counter()
    for text in toxic:
        hits.update(entries(text))
    hits = Counter({e: n for e, n in hits.items() if n >= 3})
    misses = Counter(e for text in clean for e in entries(text) & hits.keys())
    a, b = max(len(toxic), 1), max(len(clean), 1)
    likely = {e for e in hits if (hits[e] / a) / ((misses[e] + 0.5) / b) > 15}
    best = sorted(likely, key=lambda e: (-(hits[e] - 10 * misses[e]), len(e), e))[:ENTRIES]
    holders: dict[str, set[int]] = {e: set() for e in best}
    for i, text in enumerate(toxic):
        for entry in entries(text) & holders.keys():
            holders[entry].add(i)
    chosen, covered = [], set()
    while len(chosen) < VOTERS and best:
        entry = max(best, key=lambda e: (len(holders[e] - covered) - 2 * misses[e], -len(e), e))
        if len(holders[entry] - covered) < 2:
            break
        chosen.append(entry)
        covered |= holders[entry]
        best.remove(entry)
    return chosen + [w for w in OPENING if w not in chosen]


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 20) -> np.ndarray:
    """Posterior probability of the toxic class for each row of 0/1 ``votes``.

    Expectation and maximisation over the voters' firing rates per class. A voter that does not fire
    abstains; that none fires is the vote of one more voter. What two voters share beyond the class is
    their correlation within classes; a voter's evidence is divided by one plus the correlations it has.
    The given labels ``start`` anchor the estimation as a voter that is right in 19 of 20 cases; the
    posterior returned is that of the voters alone.
    """
    votes = np.hstack([votes, ~votes.any(1, keepdims=True)]).astype(float)
    label = np.log(19) * (2 * start.astype(float) - 1)
    odds = 2 * label
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-np.clip(odds + label, -30, 30)))
        on = (votes * post[:, None]).sum(0) + 0.5
        off = (votes * (1 - post)[:, None]).sum(0) + 0.05
        p, q = on / (post.sum() + 1), off / ((1 - post).sum() + 1)
        rest = votes - post[:, None] * p - (1 - post)[:, None] * q
        spread = np.sqrt((rest**2).mean(0)) + 0.02  # a voter that the class explains shares nothing
        shared = np.clip((rest.T @ rest) / len(votes) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(shared, 1)
        odds = np.log(prior / (1 - prior)) + votes @ (np.log(p / q) / shared.sum(1))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2e-6, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    keep = np.full(x.shape[1], ridge * weight.sum())
    keep[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Voters and weights; small enough to go along with a task."""

    def __init__(self, voters: list[str]):
        self.voters = {v: i for i, v in enumerate(voters)}
        self.starts = {n: {v[:-1]: i for v, i in self.voters.items() if v.endswith("*") and len(v) == n + 1} for n in PREFIXES}
        self.heads = {v[:3] for v in voters}
        self.weights: list[float] = []

    def votes(self, text: str | None) -> np.ndarray:
        """How often each voter fires, patterns last."""
        out = np.zeros(len(self.voters) + len(PATTERNS))
        heads = self.heads
        for word in [w for w in WORDS.findall((text or "").lower()) if w[:3] in heads]:
            if word in self.voters:
                out[self.voters[word]] += 1
            for n, starts in self.starts.items():
                if len(word) > n and word[:n] in starts:
                    out[starts[word[:n]]] += 1
        for i, pattern in enumerate(PATTERNS.values()):
            out[len(self.voters) + i] = bool(pattern.search(text or ""))
        return out

    @staticmethod
    def inputs(votes: np.ndarray) -> np.ndarray:
        return np.hstack([np.minimum(votes, 1), np.log1p(votes.sum(1, keepdims=True)), votes.sum(1, keepdims=True) > 0])

    def score(self, text: str | None) -> float:
        x = self.inputs(self.votes(text)[None])[0]
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30))))


def held_out(id_column: Column) -> Column:
    """Rows that no label is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled rows of each class, none of them held out.

    Without labels of both classes, the opening lexicon alone decides.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64(id_col), id_col).limit(sample) for c in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col(id_col).alias("id"), "toxic")
    # Nothing but id and text: other columns of the documents may have any name.
    own = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = own.join(F.broadcast(some), "id").select("id", "text", "toxic")
    rows = [(r[1] or "", r[2]) for r in texts.dropDuplicates(["id"]).collect()]
    gold = np.array([y for _, y in rows], float)
    if not len(gold) or gold.min() == gold.max():
        model = Model(list(OPENING))
        model.weights = [-4.0] + [2.0] * (len(OPENING) + len(PATTERNS)) + [0.0, 4.0]
        return model
    model = Model(lexicon([t for t, y in rows if y], [t for t, y in rows if not y]))
    votes = np.array([model.votes(t) for t, _ in rows])
    prior = sizes[1] / (sizes[0] + sizes[1])
    soft = label_model(np.minimum(votes, 1), gold, gold.mean())
    # The sample has both classes alike; their weights bring the true shares back.
    weight = np.where(gold == 1, prior / gold.mean(), (1 - prior) / (1 - gold.mean()))
    model.weights = linear(Model.inputs(votes), soft, weight).tolist()
    return model


def toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row.

    Only the text enters a score. A null text scores as an empty one; repeated rows stay repeated;
    other columns are ignored. An id with several labels counts as toxic if one of them says so.
    """
    model = fit(documents, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return rows.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``documents``, with their own columns, that score below the threshold."""
    model = fit(documents, labels, id_col, text_col)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([model.score(t) for t in batch.to_pylist()], pa.float64())

    score = F.arrow_udf(run, "double")
    return documents.filter(score(F.col(text_col)) < threshold)
