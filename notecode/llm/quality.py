"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own shape and that of the lines before and after it;
neighbouring labels are tied by transition weights. The probability of each line being good comes from
the forward-backward recursions, and a document's score is their mean weighted by line length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.llm.texts import map_rows

SAMPLE = 6_000  # labelled documents that a model is fitted on at most
CHAIN = 64  # lines of a training chain; longer documents give several
ROUNDS = 120
_CLASSES = 8  # kinds of characters: line feed, blank, lower, upper, digit, stop, bar, other sign

_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    if not _kinds:
        table = np.full(0x110000, 7, np.uint8)
        for code in range(0x110000):
            sign = chr(code)
            if sign.isspace():
                table[code] = 1
            elif sign.isupper():
                table[code] = 3
            elif sign.isalpha():
                table[code] = 2
            elif sign.isdigit():
                table[code] = 4
        for sign in ".,;:'\"?()-":
            table[ord(sign)] = 5
        table[ord("|")] = 6
        table[10] = 0
        _kinds.append(table)
    return _kinds[0]


def line_shapes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Shape of each line that holds more than white space, and its length.

    A text without such a line has one line of length 1 whose shape is all zero but for the last entry.
    """
    lines = (text or "").split("\n")
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kind_table()[raw]
    ends = kinds == 0
    line = np.cumsum(ends) - ends
    counts = np.bincount(line * _CLASSES + kinds, minlength=len(lines) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    full = np.flatnonzero(counts[:, 2:].sum(axis=1) > 0)
    if not len(full):
        return np.eye(1, 13, 12), np.ones(1)
    rows, seen = [], set()
    for k in full:
        words = lines[k].split()
        distinct = len(set(words))
        again = lines[k] in seen
        seen.add(lines[k])
        last = lines[k].rstrip()[-1:]
        rows.append((len(words), distinct / len(words), again, last in ".?!", sum(len(w) <= 3 for w in words) / len(words)))
    own = np.array(rows, float)
    counts = counts[full]
    chars = counts.sum(axis=1)
    letters = np.maximum(counts[:, 2] + counts[:, 3], 1)
    shape = np.column_stack(
        (
            counts[:, 3] / letters,
            counts[:, 7] / chars,
            counts[:, 4] / chars,
            counts[:, 6] / chars,
            counts[:, 5] / chars,
            np.log1p(own[:, 0]),
            letters / own[:, 0] / 10,
            own[:, 1],
            own[:, 2],
            own[:, 3],
            own[:, 4],
            own[:, 0] <= 3,
            np.zeros(len(full)),
        )
    )
    return shape, chars


def with_neighbours(shape: np.ndarray) -> np.ndarray:
    """Each line's shape, the shapes of the lines before and after, whether there are such, and a constant."""
    none = np.zeros((1, shape.shape[1]))
    n = len(shape)
    first, last = np.arange(n) == 0, np.arange(n) == n - 1
    return np.column_stack((shape, np.vstack((none, shape[:-1])), np.vstack((shape[1:], none)), first, last, np.ones(n)))


def _add(a, b):
    return np.logaddexp(a, b)


def _chain_gradient(scores: np.ndarray, labels: np.ndarray, pair: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """For chains of equal length: log likelihood, P(good) by line, expected label pairs.

    ``scores`` (chains x lines) are the scores of good against bad; each chain has one label.
    """
    n, steps = scores.shape
    ahead = np.zeros((steps, n, 2))
    ahead[0, :, 1] = scores[:, 0]
    for t in range(1, steps):
        before = ahead[t - 1][:, :, None] + pair
        ahead[t] = _add(before[:, 0], before[:, 1])
        ahead[t, :, 1] += scores[:, t]
    total = _add(ahead[-1, :, 0], ahead[-1, :, 1])
    behind = np.zeros((n, 2))
    good = np.zeros((n, steps))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        good[:, t] = np.exp(ahead[t, :, 1] + behind[:, 1] - total)
        if t:
            coming = behind + np.column_stack((np.zeros(n), scores[:, t]))
            joint = ahead[t - 1][:, :, None] + pair + coming[:, None, :] - total[:, None, None]
            pairs += np.exp(joint).sum(axis=0)
            both = pair + coming[:, None, :]
            behind = _add(both[:, :, 0], both[:, :, 1])
    path = labels * scores.sum(axis=1) + (steps - 1) * np.where(labels, pair[1, 1], pair[0, 0])
    return float((path - total).sum()), good, pairs


def fit(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, penalty: float = 1.0) -> np.ndarray:
    """Weights of a model: mean and scale of every feature, its weight, and the four transitions.

    Every line of a document carries the document's label. The penalised likelihood is climbed by
    adaptive steps; rows of equal length form one batch.
    """
    chains: dict[int, list[tuple[np.ndarray, int]]] = {}
    parts = []
    for text, label in zip(texts, labels):
        rows = with_neighbours(line_shapes(text)[0])
        parts.append(rows)
        for i in range(0, len(rows), CHAIN):
            chains.setdefault(len(rows[i : i + CHAIN]), []).append((rows[i : i + CHAIN], label))
    every = np.vstack(parts)
    mean, scale = every.mean(axis=0), every.std(axis=0)
    fixed = scale < 1e-9
    mean[fixed], scale[fixed] = 0.0, 1.0
    batches = [
        ((np.stack([c for c, _ in of]) - mean) / scale, np.array([bool(y) for _, y in of])) for _, of in sorted(chains.items())
    ]
    total = sum(x.shape[0] for x, _ in batches)
    theta = np.zeros(len(mean) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        gradient = -penalty * theta
        pair = theta[-4:].reshape(2, 2)
        for x, y in batches:
            _, good, pairs = _chain_gradient(x @ theta[:-4], y, pair)
            gradient[:-4] += np.einsum("ij,ijk->k", y[:, None] - good, x)
            seen = (x.shape[1] - 1) * np.array([[(~y).sum(), 0], [0, y.sum()]])
            gradient[-4:] += (seen - pairs).ravel()
        gradient /= total
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return np.concatenate((mean, scale, theta))


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def line_marginals(scores: list[float], pair: np.ndarray) -> list[float]:
    """P(good) of each line, by forward and backward recursions on the log odds of the two labels."""
    (bb, bg), (gb, gg) = pair.tolist()
    ahead, behind, odds = [], 0.0, [0.0] * len(scores)
    for k, score in enumerate(scores):
        carried = 0.0
        if k:
            m = ahead[-1]
            carried = bg - bb + _softplus(m + gg - bg) - _softplus(m + gb - bb)
        ahead.append(score + carried)
    for k in range(len(scores) - 1, -1, -1):
        odds[k] = ahead[k] + behind
        m = scores[k] + behind
        behind = gb - bb + _softplus(m + gg - gb) - _softplus(m + bg - bb)
    return [1 / (1 + math.exp(-x)) if x > 0 else math.exp(x) / (1 + math.exp(x)) for x in np.clip(odds, -700, 700).tolist()]


def score_text(text: str | None, model: np.ndarray) -> float:
    """Length-weighted mean of the line marginals of one text."""
    shape, chars = line_shapes(text)
    n = (len(model) - 4) // 3
    mean, scale, weights = model[:n], model[n : 2 * n], model[2 * n : 3 * n]
    scores = ((with_neighbours(shape) - mean) / scale) @ weights
    good = line_marginals(scores.tolist(), model[-4:].reshape(2, 2))
    return float(np.dot(good, chars) / chars.sum())


def constant(share: float) -> np.ndarray:
    """A model that scores every line alike."""
    n = with_neighbours(line_shapes("")[0]).shape[1]
    odds = math.log((share + 1e-9) / (1 - share + 1e-9))
    return np.concatenate((np.zeros(n), np.ones(n), np.eye(1, n, n - 1)[0] * odds, np.zeros(4)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, seed: str = "quality") -> list[float]:
    """Weights fitted on the texts of at most ``sample`` rows of ``labels(doc_id, label)``.

    Those with the least digests of their id are taken: chosen among the labels alone, so that only
    their texts move. The bound is on the fitted rows only; they go to one task. Rows whose label is
    not 0 or 1, or whose id is null, are ignored. Without rows every text scores 0.5, with one label
    only that label.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string")))
    chosen = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "label", order.alias("_order"))
    chosen = F.broadcast(chosen.orderBy("_order", "label").limit(sample))  # no more than ``sample`` rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, "doc_id").select("text", "label", "_order").repartition(1)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pd.concat(batches).sort_values(["_order", "label", "text"])
        labels = rows["label"].astype(int).tolist()
        texts = [t if isinstance(t, str) else None for t in rows["text"]]
        model = fit(texts, labels, rounds) if len(set(labels)) == 2 else constant(float(labels[0]))
        yield pd.DataFrame({"place": np.arange(len(model)), "weight": model})

    found = rows.mapInPandas(train, "place long, weight double").collect()
    return [r["weight"] for r in sorted(found)] or constant(0.5).tolist()


def score(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each input row: 0 bad to 1 good, over the whole text.

    Null, empty and blank texts count as one empty line. Null ids and repeated rows are kept, other
    columns ignored; an empty table gives no rows.
    """
    weights = np.array(model)
    name = docs.schema[id_col].dataType.simpleString()

    def scored(batch):
        yield {"doc_id": batch.column(0), "score": [score_text(t, weights) for t in batch.column(1).to_pylist()]}

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), scored, f"doc_id {name}, score double")
