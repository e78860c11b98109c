"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``passage_words`` words. Each passage is encoded by how it is written
(shares of characters and words of several kinds, repetition, lengths) and by a hashed projection of
its words' beginnings and ends. A hidden layer turns this into h; gated attention, softmax over the
text of w . (tanh(V h) * sigmoid(U h)), weighs its passages; the weighted sum is scored by a logistic
unit. All of it is learned together, from labels of whole documents, by Adam on a sample that
``per_label`` and ``max_chars`` bound. The output is then calibrated on the part of the sample that
was not trained on. Scoring works on multiples of powers of two, small enough that doubles hold all
products and sums exactly; so a score depends on the text alone, not on the order of a sum, which
matrix products choose by how many rows they get.

Defined results: every text has a score from 0 to 1; a null or empty text is one passage without
words. Without labels of both kinds, every score is the share of label 1 among those there are, 0.5
if none. Rows are judged alone, so ties and repeated rows get equal scores, whatever rows are beside them; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.sampling import fitted, held_out, labelled_sample
from textveil.llm.textblock import Block, blocks


@dataclass(frozen=True)
class BagSettings:
    passage_words: int = 64
    per_label: int = 1500
    max_chars: int = 32768
    hashed: int = 64
    hidden: int = 24
    gate: int = 12
    epochs: int = 30
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7


@dataclass
class BagModel:
    settings: BagSettings
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SYMBOL, _STOP, _COMMA, _LOUD = _class(b"#*$%&|<>{}[]\\^~@=+_/"), _class(b"."), _class(b",;:"), _class(b"!?")
_NEWLINE = _class(b"\n")
_KINDS = (_UPPER, _DIGIT, _LETTER, _SYMBOL, _STOP, _COMMA, _LOUD, _NEWLINE)
N_PLAIN = len(_KINDS) + 7


def encode(block: Block, settings: BagSettings) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and the first passage of each text and the end: one passage a text at least."""
    starts, ends, first = block.words()
    n = np.diff(first)
    passages = np.maximum(-(-n // settings.passage_words), 1)
    bag = np.concatenate([[0], np.cumsum(passages)])
    owner = np.repeat(np.arange(block.n), passages)
    place = np.arange(bag[-1]) - bag[owner]
    begin = np.minimum(first[owner] + place * settings.passage_words, first[owner + 1])
    end = np.minimum(begin + settings.passage_words, first[owner + 1])
    count = end - begin
    full = count > 0
    x = np.zeros((len(owner), N_PLAIN + settings.hashed), dtype=np.float32)
    if not len(starts):
        return x, bag
    a = np.where(full, starts[np.minimum(begin, len(starts) - 1)], 0)
    b = np.where(full, ends[np.maximum(end - 1, 0)], 0)
    size = np.maximum(b - a, 1)
    for i, kind in enumerate(_KINDS):
        sums = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.cumsum(kind[block.data], dtype=np.int32, out=sums[1:])
        x[:, i] = (sums[b] - sums[a]) / size
    word = block.hashes(starts, ends)
    length = (ends - starts).astype(np.float64)
    some = np.maximum(count, 1)

    def share(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return (sums[end] - sums[begin]) / some

    mean = share(length)
    i = len(_KINDS)
    x[:, i] = np.log1p(mean)
    x[:, i + 1] = np.sqrt(np.maximum(share(length**2) - mean**2, 0)) / (mean + 1)
    x[:, i + 2] = share(np.concatenate([[0], word[1:] == word[:-1]]))
    upper = _UPPER[block.data[starts]]
    x[:, i + 3] = share(upper)
    x[:, i + 4] = share(length == 1)
    x[:, i + 5] = np.log1p(count) / np.log1p(settings.passage_words)
    inside = np.repeat(np.arange(len(owner)), count)
    x[:, i + 6] = _again(word, inside, len(owner)) / some
    half = settings.hashed // 2
    for j, part in enumerate((block.hashes(starts, np.minimum(starts + 2, ends)), block.hashes(np.maximum(ends - 2, starts), ends))):
        hashed = np.bincount(inside * half + (part % np.uint64(half)).astype(np.int64), minlength=len(owner) * half).reshape(len(owner), half)
        x[:, N_PLAIN + j * half : N_PLAIN + (j + 1) * half] = np.sqrt(hashed.astype(np.float32) / some[:, None].astype(np.float32))
    return x, bag


def _again(word: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """How many words of each passage it holds already: its words less its distinct ones."""
    # The passage in the upper bits, 40 bits of the word below.
    key = np.sort((inside.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    again = key[1:][key[1:] == key[:-1]] >> np.uint64(40)
    return np.bincount(again.astype(np.int64), minlength=n)


def forward(x: np.ndarray, bag: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Logits of the bags, and what the backward pass needs."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    owner = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
    e = np.exp(e - np.maximum.reduceat(e, bag[:-1])[owner])
    a = e / np.add.reduceat(e, bag[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, bag[:-1], axis=0)
    return z @ p["c"] + p["d"], {"h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner}


def fixed(x: np.ndarray, bits: int, most: float = 16.0) -> np.ndarray:
    """The nearest multiples of ``2**-bits``, from -most to most."""
    return np.rint(np.clip(x, -most, most) * 2.0**bits) / 2.0**bits


def logits(x: np.ndarray, bag: np.ndarray, model: BagModel) -> np.ndarray:
    """Logits of the bags as ``forward`` has them, up to rounding, from sums that are exact in any order (below 2**53 units)."""
    p = {k: fixed(v, 16) for k, v in model.layers.items()}
    h = fixed(np.tanh(fixed((x - model.mean) / model.spread, 12, 32.0) @ p["W"] + p["b"]), 16)
    e = fixed(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))), 16) @ p["w"]
    owner = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
    e = fixed(np.exp(e - np.maximum.reduceat(e, bag[:-1])[owner]), 30)
    a = fixed(e / np.add.reduceat(e, bag[:-1])[owner], 30)
    z = fixed(np.add.reduceat(a[:, None] * h, bag[:-1], axis=0), 20)
    return z @ p["c"] + p["d"]


def backward(x: np.ndarray, kept: dict[str, np.ndarray], p: dict[str, np.ndarray], slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the sum of ``slope * logit``."""
    h, t, g, a, z, owner = (kept[k] for k in ("h", "t", "g", "a", "z", "owner"))
    to_z = slope[:, None] * p["c"][None, :]
    to_h = a[:, None] * to_z[owner]
    to_e = a * ((h - z[owner]) * to_z[owner]).sum(axis=1)
    to_t, to_g = to_e[:, None] * p["w"] * g * (1 - t**2), to_e[:, None] * p["w"] * t * g * (1 - g)
    to_h = (to_h + to_t @ p["V"].T + to_g @ p["U"].T) * (1 - h**2)
    return {"W": x.T @ to_h, "b": to_h.sum(axis=0), "V": h.T @ to_t, "U": h.T @ to_g, "w": (t * g).T @ to_e, "c": z.T @ slope, "d": slope.sum()}


def fit(sample: list[tuple[str, int]], settings: BagSettings | None = None) -> BagModel:
    s = settings or BagSettings()
    model = BagModel(s)
    y = np.array([k for _, k in sample], dtype=float)
    if len(set(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    parts = [encode(b, s) for b in blocks(pa.array([t for t, _ in sample], pa.string()))]
    x = np.concatenate([p[0] for p in parts]).astype(np.float64)
    counts = np.concatenate([np.diff(p[1]) for p in parts])
    bag = np.concatenate([[0], np.cumsum(counts)])
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.spread
    rng = np.random.default_rng(s.seed)
    train = rng.random(len(y)) < 0.8
    shapes = {"W": (x.shape[1], s.hidden), "b": (s.hidden,), "V": (s.hidden, s.gate), "U": (s.hidden, s.gate), "w": (s.gate,), "c": (s.hidden,), "d": ()}
    p = {k: rng.normal(0, 1 / np.sqrt(max(v[0] if v else 1, 1)), v) if k not in "bd" else np.zeros(v) for k, v in shapes.items()}
    first, second = {k: np.zeros(v) for k, v in shapes.items()}, {k: np.zeros(v) for k, v in shapes.items()}
    weight = np.where(y == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean())) if 0 < y[train].mean() < 1 else np.ones(len(y))
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(np.flatnonzero(train))
        for chosen in np.array_split(order, max(len(order) // 128, 1)):
            rows = np.concatenate([np.arange(bag[i], bag[i + 1]) for i in chosen])
            own = np.concatenate([[0], np.cumsum(counts[chosen])])
            logit, kept = forward(x[rows], own, p)
            slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[chosen]) * weight[chosen] / len(chosen)
            step += 1
            for k, grad in backward(x[rows], kept, p, slope).items():
                grad = grad + s.decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] - s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = {k: np.asarray(v) for k, v in p.items()}
    rest = ~train if len(set(y[~train])) == 2 else train
    scored = np.concatenate([logits(*q, model) for q in parts])
    model.calibration = _calibrate(scored[rest], y[rest], weight[rest])
    return model


def _calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25) -> tuple[float, float]:
    """Slope and offset of a logistic function of the logits, by damped Newton steps from a slope of 1."""
    x, v = np.stack([logit, np.ones(len(logit))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1.0, 1.0])
        v = v + np.linalg.solve(hessian, x.T @ (weight * (y - q)) - np.array([v[0] - 1.0, v[1]]))
    return float(max(v[0], 0.05)), float(v[1])


def score_block(block: Block, model: BagModel) -> np.ndarray:
    if model.constant is not None:
        return np.full(block.n, model.constant)
    x, bag = encode(block, model.settings)
    return 1 / (1 + np.exp(-np.clip(model.calibration[0] * logits(x, bag, model) + model.calibration[1], -40, 40)))


def fit_bags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: BagSettings | None = None) -> BagModel:
    s = settings or BagSettings()
    return fitted(labelled_sample(docs, labels, "quality", {0: s.per_label, 1: s.per_label}, s.max_chars, id_col, text_col), lambda sample: fit(sample, s))


def score_quality(docs: DataFrame, model: BagModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document. One pass, no shuffle; the model is a bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_block(b, shared.value) for b in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [id_col, "score"])

    source = docs.select(id_col, text_col)
    out = source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))
