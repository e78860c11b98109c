"""Toxic spans by a linear-chain conditional random field over words.

Labels are given for documents alone. Words (and word beginnings) that a likelihood-ratio test finds
bound to toxic documents label the tokens of toxic documents; the field is trained on these labelled
tokens, with the word, its first and its last bytes as features, and its two states' transitions. A
sequence is a sentence, or ``longest`` words of a longer one, so every word of a text is in one.
Forward-backward marginals, in log odds and over all sequences of a block at once, give each word's
probability. A document's score is a logistic function of their sum and maximum, fitted on the other
half of the sample; runs of words over one half are the offending spans, in code points.

The sample (``labelled_sample``) is bounded by ``toxic_docs``, ``clean_docs`` and ``max_chars``.

Defined results: a null or empty text has no word, no span, and the score of a text without
suspicion. Without labels of both kinds, every score is the share of label 1 among those there are,
0.0 if none. Rows are judged alone, so ties and repeated rows get equal scores, whatever rows are beside them; an empty table gives
an empty table; other columns are not read (scoring) or pass through unchanged (filtering).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.sampling import fitted, held_out, labelled_sample
from textveil.llm.textblock import Block, blocks, mix, totals

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


@dataclass(frozen=True)
class FieldSettings:
    toxic_docs: int = 1500
    clean_docs: int = 3000
    max_chars: int = 32768
    bits: int = 18
    longest: int = 128
    rounds: int = 30
    rate: float = 0.7
    decay: float = 1e-3
    threshold: float = 0.5
    span_threshold: float = 0.5


@dataclass
class FieldModel:
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2, from state to state
    document: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))
    constant: float | None = None
    settings: FieldSettings = field(default_factory=FieldSettings)


class Tokens:
    """Words of a block with their features, and the sequences that they form."""

    def __init__(self, block: Block, settings: FieldSettings):
        self.starts, self.ends, self.first = block.spans(_WORD[block.data])
        n = len(self.starts)
        shift = np.uint64(64 - settings.bits)
        word = block.hashes(self.starts, self.ends, lower=True)
        head = block.hashes(self.starts, np.minimum(self.starts + 5, self.ends), lower=True)
        tail = block.hashes(np.maximum(self.ends - 4, self.starts), self.ends, lower=True)
        self.word, self.head = word, mix(head + np.uint64(1))
        self.features = [(x >> shift).astype(np.int64) for x in (self.word, self.head, mix(tail + np.uint64(2)))]
        stops = np.concatenate([[0], np.cumsum(_STOP[block.data])])
        begins = np.zeros(n, dtype=bool)
        begins[self.first[:-1][self.first[:-1] < n]] = True
        begins[1:] |= stops[self.starts[1:]] > stops[self.ends[:-1]]
        begin = np.flatnonzero(begins)
        place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        begins |= place % settings.longest == 0
        self.begin = np.flatnonzero(begins)
        self.length = np.diff(np.append(self.begin, n))

    def owners(self, base: int) -> np.ndarray:
        """The text of each word, counted from ``base``."""
        return base + np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def emissions(tokens: Tokens, model: FieldModel) -> np.ndarray:
    out = np.full(len(tokens.starts), model.bias)
    for f in tokens.features:
        out += model.weights[f]
    return out


def log_odds(s: np.ndarray, begin: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of state 1 against state 0; their sum is the marginal's log odds."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    forward, backward = s.copy(), np.zeros(len(s))
    for t in range(1, len(active)):
        at = begin[: active[t]] + t
        a = forward[at - 1]
        forward[at] += np.logaddexp(moves[0, 1], a + moves[1, 1]) - np.logaddexp(moves[0, 0], a + moves[1, 0])
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        b = s[at] + backward[at]
        backward[at - 1] = np.logaddexp(moves[1, 0], moves[1, 1] + b) - np.logaddexp(moves[0, 0], moves[0, 1] + b)
    return forward, backward


def marginals(tokens: Tokens, model: FieldModel) -> np.ndarray:
    forward, backward = log_odds(emissions(tokens, model), tokens.begin, tokens.length, model.moves)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One, the logarithm of the expected number of toxic words, and the largest marginal.

    Probabilities are summed as integers, in units of 2**-40, so that other texts of the block change nothing.
    """
    n = len(first) - 1
    out = np.ones((n, 3))
    out[:, 1] = np.log(totals(np.rint(p * 2.0**40).astype(np.int64), first) / 2.0**40 + 1e-4)
    out[:, 2] = 0
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full, 2] = np.maximum.reduceat(p, first[full])
    return out


def _bound(values: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Values whose documents are toxic far more often than others are, by a likelihood-ratio test. A document has a value once."""
    value, at = np.unique(values, return_inverse=True)
    bad = np.bincount(at, weights=toxic[owner], minlength=len(value))
    good = np.bincount(at, minlength=len(value)) - bad
    n1, n0 = max(toxic.sum(), 1), max(len(toxic) - toxic.sum(), 1)
    rate = (bad + good) / (n1 + n0)

    def likely(k, n, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    ratio = 2 * (likely(bad, n1, bad / n1) + likely(good, n0, good / n0) - likely(bad, n1, rate) - likely(good, n0, rate))
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((good + 0.5) / (n0 + 1))
    return value[(odds > 2.5) & (ratio > 18.0) & (bad >= 3)]


def _bound_words(held: list[Block], settings: FieldSettings, y: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """The words, and the word beginnings, that are bound to the toxic ones of the chosen documents."""
    number = np.cumsum(chosen) - 1
    values, owners = [[], []], [[], []]
    for block in held:
        t = Tokens(block, settings)
        owner = t.owners(block.first)
        inside = chosen[owner]
        own = number[owner[inside]]
        for i, value in enumerate((t.word[inside], t.head[inside])):
            once = np.unique(mix(value ^ mix(own.astype(np.uint64))), return_index=True)[1]
            values[i].append(value[once])
            owners[i].append(own[once])
    return [_bound(np.concatenate(v), np.concatenate(o), y[chosen]) for v, o in zip(values, owners, strict=True)]


def _taken(t: Tokens, chosen: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features and labels of the words of the chosen sequences, and the sequences' lengths."""
    length = t.length[chosen]
    at = np.repeat(t.begin[chosen] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return [f[at].astype(np.int32) for f in t.features], label[at], length


def _fit_document(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
    return w


def fit(sample: list[tuple[str, int]], settings: FieldSettings | None = None) -> FieldModel:
    settings = settings or FieldSettings()
    model = FieldModel(np.zeros(1 << settings.bits), -4.0, np.zeros((2, 2)), settings=settings)
    y = np.array([k for _, k in sample], dtype=float)
    if len(set(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    # Texts are cut into words again for each pass, block by block, so only what training takes is held.
    held = [*blocks(pa.array([t for t, _ in sample], pa.string()))]
    first_half = np.arange(len(y)) % 2 == 0 if len(y) >= 400 else np.ones(len(y), dtype=bool)
    bound = _bound_words(held, settings, y, first_half)

    # Sequences to train on: all with a toxic word, and twelve clean ones for each.
    hits, clean, base = [], [], 0
    for block in held:
        t = Tokens(block, settings)
        owner = t.owners(block.first)
        label = (np.isin(t.word, bound[0]) | np.isin(t.head, bound[1])) & (y[owner] == 1) & first_half[owner]
        hit = np.add.reduceat(label, t.begin) > 0 if len(t.begin) else np.zeros(0, dtype=bool)
        hits.append(_taken(t, np.flatnonzero(hit), label))
        clean.append(base + np.flatnonzero(~hit & first_half[owner[t.begin]] & (y[owner[t.begin]] == 0)))
        base += len(t.begin)
    clean = np.concatenate(clean)
    n_hits = sum(len(h[2]) for h in hits)
    drawn = np.sort(clean[np.argsort(mix(clean.astype(np.uint64)))[: max(4000, 12 * n_hits)]])
    base = 0
    for block in held:
        t = Tokens(block, settings)
        own = drawn[np.searchsorted(drawn, base) : np.searchsorted(drawn, base + len(t.begin))] - base
        hits.append(_taken(t, own, np.zeros(len(t.starts), dtype=bool)))
        base += len(t.begin)
    features = [np.concatenate([h[0][i] for h in hits]) for i in range(3)]
    target = np.concatenate([h[1] for h in hits]).astype(float)
    length = np.concatenate([h[2] for h in hits])
    del hits
    begin = np.cumsum(length) - length
    inner = np.ones(len(target), dtype=bool)
    inner[begin] = False
    inner = np.flatnonzero(inner)
    state = target.astype(int)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (state[inner - 1], state[inner]), 1)
    squares, bias_square, move_squares = np.full(len(model.weights), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    n = max(len(target), 1)
    for _ in range(settings.rounds):
        s = np.full(len(target), model.bias)
        for f in features:
            s += model.weights[f]
        forward, backward = log_odds(s, begin, length, model.moves)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
        grad = sum(np.bincount(f, weights=target - p, minlength=len(model.weights)) for f in features) / n - settings.decay * model.weights / n
        squares += grad**2
        model.weights += settings.rate * grad / np.sqrt(squares)
        g = float((target - p).sum()) / n
        bias_square += g * g
        model.bias += settings.rate * g / bias_square**0.5
        a, b = forward[inner - 1], s[inner] + backward[inner]
        logits = np.stack([np.full(len(a), model.moves[0, 0]), model.moves[0, 1] + b, a + model.moves[1, 0], a + model.moves[1, 1] + b])
        logits = np.exp(logits - logits.max(axis=0))
        g = (seen_moves - (logits / logits.sum(axis=0)).sum(axis=1).reshape(2, 2)) / n
        move_squares += g**2
        model.moves += 0.1 * settings.rate * g / np.sqrt(move_squares)
    model.weights = model.weights.astype(np.float32)
    x = []
    for block in held:
        t = Tokens(block, settings)
        x.append(document_features(marginals(t, model), t.first))
    x = np.concatenate(x)
    rest = ~first_half if (~first_half).any() else first_half
    model.document = _fit_document(x[rest], y[rest])
    return model


def score_block(block: Block, model: FieldModel, spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of a block's texts, and each text's toxic spans."""
    tokens = Tokens(block, model.settings)
    if model.constant is not None:
        return np.full(block.n, model.constant), [[] for _ in range(block.n)]
    p = marginals(tokens, model)
    x = document_features(p, tokens.first)
    logit = x[:, 0] * model.document[0] + x[:, 1] * model.document[1] + x[:, 2] * model.document[2]  # a matrix product may depend on how many rows there are
    scores = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    found: list[list[dict]] = [[] for _ in range(block.n)]
    hot = np.flatnonzero(p > model.settings.span_threshold) if spans else []
    if len(hot):
        points = block.points()
        owner = np.searchsorted(tokens.first, hot, side="right") - 1
        for run in np.split(np.arange(len(hot)), np.flatnonzero((np.diff(hot) > 1) | (np.diff(owner) > 0)) + 1):
            d = int(owner[run[0]])
            zero = points[block.offsets[d]]
            found[d].append({"start": int(points[tokens.starts[hot[run[0]]]] - zero), "end": int(points[tokens.ends[hot[run[-1]]]] - zero), "score": float(p[hot[run]].max())})
    return scores, found


SPANS = "array<struct<start:long,end:long,score:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: FieldSettings | None = None) -> FieldModel:
    s = settings or FieldSettings()
    return fitted(labelled_sample(docs, labels, "toxic", {0: s.clean_docs, 1: s.toxic_docs}, s.max_chars, id_col, text_col), lambda sample: fit(sample, s))


def score_toxicity(docs: DataFrame, model: FieldModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted, spans`` of every document. One pass, no shuffle; the model is a bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_block(b, shared.value) for b in blocks(batch.column(1))]
            scores = np.concatenate([s for s, _ in parts]) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array([x for _, f in parts for x in f], _SPANS)], [id_col, "score", "spans"])

    source = docs.select(id_col, text_col)
    out = source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double, spans {SPANS}")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"), "spans")


def keep_civil(docs: DataFrame, model: FieldModel, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, whole."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [score_block(b, shared.value, spans=False)[0] < shared.value.settings.threshold for b in blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
