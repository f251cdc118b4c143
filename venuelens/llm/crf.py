"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are its own measures and those of its two neighbours; forward-backward gives
the probability that it is good. A document's evidence is the mean of these marginals weighted by line length, together
with the share of bad text, which a logistic curve turns into a probability.

Only documents have labels. Training first gives every line the label of its document; then lines of bad documents that
the model finds good become good, except the worst line of a document, and the model is trained again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import map_rows, narrow

#: Bound of the training sample: at most so many labelled documents of either label, the first by a hash of their id.
SAMPLE_PER_LABEL = 1500
#: Training sequences are pieces of at most so many lines; all lines of the sample are used.
TRAINING_LINES = 64
HELD_OUT_PART, PARTS = 0, 5
THRESHOLD = 0.3
BATCH_LINES = 20_000

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:'\"()-"
SIGNS = b"!?#*$%&|<>@=+_~^/\\{}[]`"
N_OWN = 14


def line_measures(lines: list[bytes]) -> list[tuple]:
    """Raw numbers of every line of a document; a line without a word is left out before."""
    seen: dict[bytes, int] = {}
    out = []
    for line in lines:
        words = line.split()
        n = len(line)
        earlier = seen.get(line, 0)
        seen[line] = earlier + 1
        letters = sum(map(len, words))
        out.append((n, len(words), letters, len(set(words)), n - len(line.translate(None, UPPER)),
                    n - len(line.translate(None, DIGITS)), n - len(line.translate(None, MARKS)),
                    n - len(line.translate(None, SIGNS)), len(words[-1]), min(earlier, 3), len(max(words, key=len)),
                    words[0][:1].isupper(), line.rstrip()[-1:] in b".!?:", len({w[-3:] for w in words})))
    return out


def own_features(raw: np.ndarray) -> np.ndarray:
    """Measures as ratios and logarithms: lines of any length are alike."""
    n, words, letters, distinct, upper, digits, marks, signs, last, earlier, longest, capital, end, tails = raw.T
    return np.column_stack([np.log1p(n), np.log1p(words), letters / words, distinct / words, upper / n, digits / n, marks / n,
                            signs / n, np.log1p(last), earlier, np.log1p(longest), capital, end, tails / words])


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zeros at the ends), and which end it is."""
    ends = np.cumsum(sizes)
    first = np.zeros(len(x), bool)
    last = np.zeros(len(x), bool)
    first[(ends - sizes)[sizes > 0]] = True
    last[(ends - 1)[sizes > 0]] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([x, before, after, first, last, np.ones(len(x))])


def forward_backward(score: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) per line, expected moves summed over all lines, log normaliser) of sequences laid end to end.

    ``score`` is the evidence for good against bad per line, ``move[a, b]`` that of b after a (0 bad, 1 good). All
    sequences advance together, the longest first, so a step costs a few array operations.
    """
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    starts = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    alpha = np.zeros((len(score), 2))
    beta = np.zeros((len(score), 2))
    alpha[:, 1] = score
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    for t in range(1, steps):
        at = starts[:live[t]] + t
        came = alpha[at - 1]
        alpha[at, 0] += np.logaddexp(came[:, 0] + move[0, 0], came[:, 1] + move[1, 0])
        alpha[at, 1] += np.logaddexp(came[:, 0] + move[0, 1], came[:, 1] + move[1, 1])
    for t in range(steps - 2, -1, -1):
        at = starts[:live[t + 1]] + t
        good = beta[at + 1, 1] + score[at + 1]
        bad = beta[at + 1, 0]
        beta[at, 0] = np.logaddexp(move[0, 0] + bad, move[0, 1] + good)
        beta[at, 1] = np.logaddexp(move[1, 0] + bad, move[1, 1] + good)
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    marginal = np.exp(both[:, 1] - total)
    inner = np.ones(len(score), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(alpha[to - 1, a] + move[a, b] + b * score[to] + beta[to, b] - total[to]).sum()
    return marginal, expected, float(total[starts].sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    curve: np.ndarray
    empty: float

    def marginals(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = with_neighbours((own - self.mean) / self.scale, sizes)
        return forward_backward(x @ self.weights, sizes, self.move)[0]


def document_evidence(marginal: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document with lines: log-odds of the length-weighted mean marginal, share of bad text, and 1."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.maximum(np.bincount(doc, length, len(sizes)), 1)
    mean = np.clip(np.bincount(doc, length * marginal, len(sizes)) / whole, 1e-6, 1 - 1e-6)
    bad = np.bincount(doc, length * (marginal < 0.5), len(sizes)) / whole
    return np.column_stack([np.log(mean / (1 - mean)), bad, np.ones(len(sizes))])


def adam(gradient, at: np.ndarray, steps: int, rate: float) -> np.ndarray:
    first, second = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, steps + 1):
        g = gradient(at)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        at = at - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return at


def fit_chain(x: np.ndarray, sizes: np.ndarray, good: np.ndarray, steps: int, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    to = np.ones(n, bool)
    to[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    to = np.flatnonzero(to)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[to - 1].astype(int), good[to].astype(int)), 1)

    def gradient(p):
        w, move = p[:-4], p[-4:].reshape(2, 2)
        marginal, expected, _ = forward_backward(x @ w, sizes, move)
        return np.append(x.T @ (marginal - good) / n + penalty * w, ((expected - seen) / n).ravel() + penalty * p[-4:])

    p = adam(gradient, np.zeros(x.shape[1] + 4), steps, 0.1)
    return p[:-4], p[-4:].reshape(2, 2)


def train(documents: list[tuple[int, bytes]], priors: tuple[float, float], steps: int = 120) -> Model:
    """A model from (label, float32 measures of all lines) of the sample; ``priors`` are the true shares of the labels."""
    labels = np.array([q for q, _ in documents], float)
    raws = [np.frombuffer(b, np.float32).reshape(-1, N_OWN).astype(float) for _, b in documents]
    sizes = np.array([len(r) for r in raws], np.int64)
    weight = np.where(labels == 1, priors[1] / max(labels.sum(), 1), priors[0] / max((1 - labels).sum(), 1))
    empty = sizes == 0
    empty_rate = float((weight[empty] @ labels[empty] + 1e-9) / (weight[empty].sum() + 2e-9))
    raw = np.concatenate([r for r in raws if len(r)] or [np.ones((0, N_OWN))])
    if not len(raw) or labels.min(initial=1) == labels.max(initial=0):
        # nothing to tell apart: every document gets the share of good labels
        share = min(max(priors[1], 1e-6), 1 - 1e-6)
        return Model(np.zeros(N_OWN), np.ones(N_OWN), np.zeros(3 * N_OWN + 3), np.zeros((2, 2)),
                     np.array([0, 0, np.log(share / (1 - share))]), share)
    own = own_features(raw)
    mean, scale = own.mean(0), own.std(0) + 1e-6
    x = with_neighbours((own - mean) / scale, sizes)
    pieces = np.concatenate([np.append(np.full(s // TRAINING_LINES, TRAINING_LINES), s % TRAINING_LINES) for s in sizes])
    pieces = pieces[pieces > 0]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    good = labels[doc].astype(bool)
    for _ in range(2):
        weights, move = fit_chain(x, pieces, good, steps)
        marginal = forward_backward(x @ weights, sizes, move)[0]
        worst = np.full(len(sizes), np.inf)
        np.minimum.at(worst, doc, marginal)
        good = (labels[doc] == 1) | ((marginal > 0.5) & (marginal > worst[doc]))
    weights, move = fit_chain(x, pieces, good, steps)
    model = Model(mean, scale, weights, move, np.zeros(3), empty_rate)
    evidence = document_evidence(model.marginals(own, sizes), raw[:, 0], sizes)[~empty]
    y, w = labels[~empty], weight[~empty] / weight[~empty].sum()
    spread = np.array([5.0, 1.0, 1.0])
    e = evidence / spread

    def gradient(p):
        return e.T @ (w * (1 / (1 + np.exp(-e @ p)) - y)) + 1e-3 * p * np.array([1, 1, 0])

    model.curve = adam(gradient, np.zeros(3), 400, 0.1) / spread
    return model


def lines_of(text: str | None) -> list[bytes]:
    return [x for x in (text or "").encode().split(b"\n") if x.split()]


def score_rows(rows: Iterable[tuple], model: Model) -> Iterator[tuple]:
    """(doc_id, held_out, score) of (doc_id, held_out, text) rows."""
    held, raw, sizes = [], [], []

    def flush():
        own = np.array(raw, float).reshape(-1, N_OWN)
        size = np.array(sizes, np.int64)
        marginal = model.marginals(own_features(own), size) if len(own) else np.zeros(0)
        z = document_evidence(marginal, own[:, 0], size) @ model.curve
        scores = np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), model.empty)
        for (doc_id, held_out), s in zip(held, scores.tolist()):
            yield doc_id, held_out, s

    for doc_id, held_out, text in rows:
        lines = lines_of(text)
        raw += line_measures(lines)
        sizes.append(len(lines))
        held.append((doc_id, held_out))
        if len(raw) >= BATCH_LINES or len(held) >= 4096:
            yield from flush()
            held, raw, sizes = [], [], []
    if held:
        yield from flush()


def measure_rows(rows: Iterable[tuple]) -> Iterator[tuple]:
    for label, text in rows:
        yield label, np.array(line_measures(lines_of(text)), np.float32).tobytes()


def held_out_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % PARTS == HELD_OUT_PART, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                   sample_per_label: int = SAMPLE_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document row, from a model of the labelled rows that are not held out.

    The model sees texts only. Labels that are null or neither 0 nor 1 are not used, a document with several labels
    counts as 0 if one is 0. Without labels of both kinds all scores are the share of label 1 (1/2 without any). A null
    or empty text, or one without a word, gets the share of label 1 among such sample texts (1/2 without any). Rows
    with equal or null ids are scored one by one; a null id is not held out; an empty table gives no rows.
    """
    plain = narrow(docs, doc_id=doc_id, text=text)
    known = (narrow(labels, doc_id=doc_id, label=label).filter("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).filter(~held_out_column()))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    priors = ((counts.get(0, 0) / total, counts.get(1, 0) / total) if total else (0.5, 0.5))
    sample = None
    for q in (0, 1):
        own = known.filter(F.col("label") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_label)
        sample = own if sample is None else sample.unionByName(own)
    # at most 2 * sample_per_label ids
    texts = plain.join(F.broadcast(sample), "doc_id").select("label", "text")
    rows = map_rows(texts, measure_rows, "label int, measures binary").collect()
    model = train(sorted((r.label, bytes(r.measures)) for r in rows), priors)

    def run(rows):
        return score_rows(rows, model)

    scored = map_rows(plain.select("doc_id", held_out_column().alias("held_out"), "text"), run,
                      "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
