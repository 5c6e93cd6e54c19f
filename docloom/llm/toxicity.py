"""Toxicity by a classifier chain.

The chain predicts its categories in order.  Each category has a logistic model
over the presence of selected words and a few measures of style; every later model
also sees the probabilities of the earlier categories.  In training these
come from out-of-fold predictions, so a later model learns from probabilities as
unsure as those it will meet.

Words are selected over the labelled sample in Spark; the models are then fitted on
that bounded sample and applied to every whole text in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, store

WORD = re.compile(r"[^\W\d_]+")
#: Style measures, each a share of characters or words.
STYLE = ("upper", "symbol", "exclaim", "repeat")


@dataclass
class Chain:
    """A fitted chain: the categories in order, the words, and one weight vector each."""

    categories: tuple[str, ...]
    words: tuple[str, ...]
    weights: list[np.ndarray] = field(default_factory=list)
    cut: float = 0.5


def _terms(text: str) -> tuple[set[str], list[float]]:
    found = WORD.findall(text.lower())
    terms = set(found)
    n = max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
    symbol = sum(map(text.count, "#*$%&|<>")) / n
    return terms, [upper, symbol, text.count("!") / n, 1 - len(terms) / max(1, len(found))]


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        rows = [_terms(x or "") for x in b.column("text").to_pylist()]
        arrays = [b.column("doc_id"), pa.array([sorted(t) for t, _ in rows], pa.list_(pa.string())), pa.array([s for _, s in rows], pa.list_(pa.float64())), b.column("targets"), b.column("version")]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "terms", "style", "targets", "version"])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 12) -> np.ndarray:
    """Weights of a logistic model with a small ridge penalty, by damped Newton steps; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _probability(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 4.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, sample_rows: int = 20_000, words_per_category: int = 128, min_z: float = 4.0, folds: int = 5, l2: float = 1.0) -> Chain:
    """Fit the chain on at most about ``sample_rows`` labelled documents.

    ``labels`` has ``doc_id`` and one 0/1 column per category; a null label counts as
    0, several rows of one document as their maximum.  The sample takes documents by a
    hash of the id, and rows equal in id and text once; where one id bears so many
    texts that it is still too large, it takes those by a hash of both.  Without any labelled document every probability is 0.5 or below
    and nothing is flagged.
    """
    target = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in categories])
    labels = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), target.alias("y"))
    labels = labels.groupBy("doc_id").agg(*[F.max(F.col("y")[i]).alias(f"y{i}") for i in range(len(categories))])
    labels = labels.select("doc_id", F.array(*[f"y{i}" for i in range(len(categories))]).alias("targets"))
    share = min(1.0, sample_rows / max(1, labels.count()))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the sample has a fixed bound on its rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").withColumn("version", F.xxhash64("text"))
    sample = rows.mapInArrow(_sample_terms, "doc_id long, terms array<string>, style array<double>, targets array<double>, version long")
    sample = store(sample.dropDuplicates(["doc_id", "version"]), "toxicity-sample")
    # ids are picked by chance, so their number may exceed the bound by a little
    if (held := sample.count()) > 1.1 * sample_rows:
        sample = sample.where(F.pmod(F.xxhash64("version", "doc_id"), F.lit(1_000_000)) < int(sample_rows / held * 1_000_000))
    words = _select_words(sample, len(categories), words_per_category, min_z)
    chain = Chain(tuple(categories), tuple(words))
    got = sample.select("doc_id", F.array_intersect("terms", F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")).alias("terms"), "style", "targets")
    rows = sorted(((r.doc_id, r.terms, r.style, r.targets) for r in got.collect()), key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return chain
    index = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words) + len(STYLE)))
    for i, r in enumerate(rows):
        x[i, [index[w] for w in r[1]]] = 1
        x[i, len(words) :] = r[2]
    y = np.array([r[3] for r in rows])
    fold = np.array([(r[0] * 0x9E3779B97F4A7C15 % 2**64) >> 32 for r in rows]) % folds
    for c in range(len(categories)):
        held = np.zeros(len(rows))
        for f in range(folds):
            out = fold == f
            if out.any() and (~out).any():
                held[out] = _probability(np.hstack([x[out], np.ones((out.sum(), 1))]) @ _logistic(x[~out], y[~out, c], l2))
        chain.weights.append(_logistic(x, y[:, c], l2))
        x = np.hstack([x, held[:, None]])
    chain.cut = _threshold(x[:, -1], y[:, -1])
    return chain


def _select_words(sample: DataFrame, n_categories: int, top: int, min_z: float) -> list[str]:
    """The words whose share among a category's documents differs most from the rest, by a two-proportion z score."""
    total = sample.agg(F.count("*").alias("n"), *[F.sum(F.col("targets")[i]).alias(f"p{i}") for i in range(n_categories)]).first()
    if not total.n:
        return []
    counts = sample.select(F.explode("terms").alias("word"), "targets").groupBy("word").agg(F.count("*").alias("n"), *[F.sum(F.col("targets")[i]).alias(f"p{i}") for i in range(n_categories)]).where("n >= 5")
    words: set[str] = set()
    for i in range(n_categories):
        pos, neg = total[f"p{i}"], total.n - total[f"p{i}"]
        if not pos or not neg:
            continue
        both = F.col("n") / total.n
        z = (F.col(f"p{i}") / pos - (F.col("n") - F.col(f"p{i}")) / neg) / F.sqrt(both * (1 - both) * (1 / pos + 1 / neg) + 1e-12)
        words |= {r.word for r in counts.select("word", F.abs(z).alias("z")).where(F.col("z") >= min_z).orderBy(F.desc("z"), "word").limit(top).collect()}
    return sorted(words)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut on held-out probabilities with the fewest errors, halfway (in log odds) between its neighbours."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(p, kind="stable")
    q, t = np.clip(p[order], 1e-9, 1 - 1e-9), y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    between = np.concatenate([[True], q[1:] > q[:-1], [True]])
    best = np.flatnonzero(between & (errors == errors[between].min()))[0]
    logit = np.log(q / (1 - q))
    low, high = logit[best - 1] if best else logit[0] - 1, logit[best] if best < len(q) else logit[-1] + 1
    return float(_probability(np.array([(low + high) / 2]))[0])


def _scores(texts: list[str | None], chain: Chain) -> np.ndarray:
    """The probability of each category, in chain order, for each text."""
    index = {w: i for i, w in enumerate(chain.words)}
    known = index.keys()
    x = np.zeros((len(texts), len(index) + len(STYLE)))
    for i, text in enumerate(texts):
        terms, style = _terms(text or "")
        x[i, [index[w] for w in terms & known]] = 1
        x[i, len(index) :] = style
    for w in chain.weights:
        x = np.hstack([x, _probability(x @ w[:-1] + w[-1])[:, None]])
    return x[:, len(index) + len(STYLE) :] if chain.weights else np.zeros((len(texts), len(chain.categories)))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per input row: ``doc_id``, ``p_<category>`` in chain order, ``rejected`` boolean.

    Null and empty texts have no word and get the probability of the intercept.
    ``rejected`` is true where the last category reaches the chain's cut.
    """
    columns = ", ".join(f"p_{c} double" for c in chain.categories)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = _scores(b.column("text").to_pylist(), chain)
            flagged = p[:, -1] >= chain.cut if chain.weights else np.zeros(len(p), bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(flagged)], names=["doc_id", *[f"p_{c}" for c in chain.categories], "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, f"doc_id long, {columns}, rejected boolean")


#: The categories of the ``labels`` table, in chain order.
CATEGORIES = ("low_quality", "toxic")


def targets(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns.

    Scores travel with the row, so nothing is joined and repeated ids are judged each by its text.
    """
    chain = fit(docs, targets(labels), CATEGORIES)
    return keep(docs, chain)


def keep(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the rejected rows, in one pass over whole rows."""
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            if chain.weights:
                b = b.filter(pa.array(_scores(b.column(names.index("text")).to_pylist(), chain)[:, -1] < chain.cut))
            yield b

    return docs.mapInArrow(apply, docs.schema)
