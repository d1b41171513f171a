"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network as what its hash and what its hashed character 4-grams tell:
smoothed log odds of toxic against other labelled documents (for the grams their largest
and their mean). A GRU reads a window of words forward and one backward, attention pools
their states, a linear layer scores the window. All overlapping windows of a text are
scored; the document's score is the calibrated logistic of its highest window.

The model is trained in numpy, in one task, on at most `SAMPLE` labelled documents in
the order of a hash: a bounded, documented sample. Inputs of a training document come
from the counts of the other folds only, so a word seen once teaches nothing false.

A null or empty text is a window without words and gets a score like any other. A
document labelled several times counts as toxic if any label says so; null labels do not
count. Without labels of both kinds every score is 0. Repeated rows score alike. An
empty table gives an empty result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallybook.llm.text import Words, mix, pieces, release, words

SAMPLE = 4000
FOLDS = 4
WINDOW = 48
STRIDE = 32
HIDDEN = 6
INPUTS = 3
SLOTS = 1 << 18
# Documents' worth of prior in a word's odds.
PRIOR = 4.0
STEPS = 600
BATCH = 128
RATE = 0.01

# everything but letters and digits, in ASCII, parts words
GAPS = np.ones(256, bool)
GAPS[128:] = False
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

Model = dict[str, np.ndarray]


def grams(found: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 4-byte grams of the chosen words, with marks at both ends, and bounds."""
    size = found.ends[which] - found.starts[which]
    # mark, mark, bytes, mark: at least one gram for any word
    bounds = np.concatenate([[0], np.cumsum(size + 3)])
    line = np.full(bounds[-1] + 3, 1, np.uint64)
    at = np.repeat(found.starts[which] - np.cumsum(np.concatenate([[0], size[:-1]])), size) + np.arange(size.sum())
    to = np.repeat(bounds[:-1] + 2 - np.cumsum(np.concatenate([[0], size[:-1]])), size) + np.arange(size.sum())
    line[to] = found.data[at].astype(np.uint64) + np.uint64(2)
    # grams starting at each word's first size positions
    n = bounds[-1]
    whole = line[:n] | line[1 : n + 1] << np.uint64(10) | line[2 : n + 2] << np.uint64(20) | line[3 : n + 3] << np.uint64(30)
    return (mix(whole) >> np.uint64(46)).astype(np.int64), bounds


class Lexicon:
    """Distinct words of some texts: their slots, grams, and which word each is."""

    def __init__(self, texts: pa.Array):
        found = words(texts, fold=True, gaps=GAPS)
        self.bounds = found.bounds
        hashes, first, self.which = np.unique(found.hashes, return_index=True, return_inverse=True)
        self.slots = (hashes >> np.uint64(46)).astype(np.int64)
        self.grams, self.gram_bounds = grams(found, first)

    def inputs(self, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        """INPUTS values per word; the last row, all zero, stands for no word."""
        out = np.zeros((len(self.slots) + 1, INPUTS), np.float32)
        if len(self.slots):
            held = gram_odds[self.grams]
            begin = self.gram_bounds[:-1]
            # the three positions at a word's end see the next word's marks only
            out[:-1, 0] = word_odds[self.slots]
            out[:-1, 1] = np.maximum.reduceat(held, begin)
            out[:-1, 2] = np.add.reduceat(held, begin) / np.diff(self.gram_bounds)
        return out


def odds(toxic: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    seen = toxic + other
    return np.log((toxic + PRIOR * share) / (seen + PRIOR) / share).astype(np.float32)


def window_bounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of all overlapping windows of all texts."""
    counts = np.diff(bounds)
    n = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(counts)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    # the last window ends with the text
    start = np.minimum(number * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, bounds[:-1][text] + start, np.minimum(counts[text], WINDOW)


def gather(inputs: np.ndarray, which: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Inputs of windows as (steps, INPUTS, windows) and which steps are words."""
    steps = max(1, int(size.max()))
    at = start + np.arange(steps)[:, None]
    real = np.arange(steps)[:, None] < np.maximum(size, 1)
    words_here = np.full(at.shape, len(inputs) - 1)
    inside = np.arange(steps)[:, None] < size
    words_here[inside] = which[at[inside]]
    return np.ascontiguousarray(inputs[words_here].transpose(0, 2, 1)), real


def new_model(seed: int = 5) -> Model:
    made = np.random.default_rng(seed)
    model: Model = {}
    for way in "fb":
        model[f"w{way}"] = made.standard_normal((3 * HIDDEN, INPUTS)) * 0.5
        model[f"u{way}"] = made.standard_normal((3 * HIDDEN, HIDDEN)) * 0.3
        model[f"c{way}"] = np.zeros((3 * HIDDEN, 1))
    model["attend"] = made.standard_normal((HIDDEN, 2 * HIDDEN)) * 0.3
    model["weigh"] = made.standard_normal((1, HIDDEN)) * 0.3
    model["out"] = made.standard_normal((1, 2 * HIDDEN)) * 0.3
    model["bias"] = np.zeros((1, 1))
    return {k: v.astype(np.float32) for k, v in model.items()}


def read_way(model: Model, way: str, x: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, HIDDEN, windows) of the GRU that reads forward (f) or backward (b).

    Gates are tanh(a / 2) / 2 + 1 / 2, the logistic of a.
    """
    steps, _, n = x.shape
    w, u, c = model[f"w{way}"], model[f"u{way}"], model[f"c{way}"]
    states = np.empty((steps, HIDDEN, n), np.float32)
    h = np.zeros((HIDDEN, n), np.float32)
    every = bool(real.all())
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        a = w @ x[t] + c
        b = u @ h
        gates = np.tanh((a[: 2 * HIDDEN] + b[: 2 * HIDDEN]) * 0.5) * 0.5 + 0.5
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        new = np.tanh(a[2 * HIDDEN :] + r * b[2 * HIDDEN :])
        moved = new + z * (h - new)
        after = moved if every else np.where(real[t], moved, h)
        if keep is not None:
            keep.append((t, h, z, r, new, b[2 * HIDDEN :]))
        h = after
        states[t] = h
    return states


def forward(model: Model, x: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    tapes = ([], []) if keep is not None else (None, None)
    states = np.concatenate(
        [read_way(model, "f", x, real, tapes[0]), read_way(model, "b", x, real, tapes[1])], axis=1
    )
    hidden = np.tanh(np.matmul(model["attend"], states))
    weight = np.matmul(model["weigh"], hidden)[:, 0]
    weight = np.where(real, weight, -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (states * weight[:, None]).sum(axis=0)
    if keep is not None:
        keep.update(x=x, real=real, tapes=tapes, states=states, hidden=hidden, weight=weight, pooled=pooled)
    return (model["out"] @ pooled + model["bias"])[0]


def backward(model: Model, kept: dict, grad: np.ndarray) -> Model:
    """Gradients of all parameters, given those of the windows' logits."""
    g = {k: np.zeros_like(v) for k, v in model.items()}
    states, hidden, weight, pooled = (kept[k] for k in ("states", "hidden", "weight", "pooled"))
    g["out"] = (pooled @ grad)[None]
    g["bias"] = grad.sum().reshape(1, 1)
    d_pooled = model["out"].T * grad
    d_states = weight[:, None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=1)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["weigh"] = np.einsum("tn,thn->h", d_score, hidden)[None]
    d_hidden = model["weigh"].T[None] * d_score[:, None] * (1 - hidden**2)
    g["attend"] = np.einsum("thn,tsn->hs", d_hidden, states)
    d_states = d_states + np.matmul(model["attend"].T, d_hidden)
    for way, tape, rows in (("f", kept["tapes"][0], slice(0, HIDDEN)), ("b", kept["tapes"][1], slice(HIDDEN, None))):
        u = model[f"u{way}"]
        d_next = np.zeros_like(states[0, :HIDDEN])
        for t, h, z, r, new, recalled in reversed(tape):
            d_after = d_states[t, rows] + d_next
            d_moved = np.where(kept["real"][t], d_after, 0)
            d_new = d_moved * (1 - z) * (1 - new**2)
            d_z = d_moved * (h - new) * z * (1 - z)
            d_r = d_new * recalled * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new])
            d_b = np.concatenate([d_z, d_r, d_new * r])
            g[f"w{way}"] += d_a @ kept["x"][t].T
            g[f"c{way}"] += d_a.sum(axis=1, keepdims=True)
            g[f"u{way}"] += d_b @ h.T
            d_next = d_after - d_moved + d_moved * z + u.T @ d_b
    return g


def logits(model: Model, inputs: np.ndarray, which: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The highest window logit of each text."""
    text, start, size = window_bounds(bounds)
    found = np.empty(len(text), np.float32)
    order = np.argsort(size, kind="stable")
    for first in range(0, len(order), 4096):
        some = order[first : first + 4096]
        found[some] = forward(model, *gather(inputs, which, start[some], size[some]))
    begin = np.searchsorted(text, np.arange(len(bounds) - 1))
    return np.maximum.reduceat(found, begin) if len(found) else found


def train(texts: pa.Array, toxic: np.ndarray) -> Model | None:
    """A model from labelled texts; None if they are not of both kinds."""
    if toxic.all() or not toxic.any():
        return None
    lexicon = Lexicon(texts)
    count = np.diff(lexicon.bounds)
    doc = np.repeat(np.arange(len(texts)), count)
    # documents with each word, and with each gram, by fold and label
    kind = (np.arange(len(texts)) % FOLDS) * 2 + toxic
    pairs = np.unique(doc * len(lexicon.slots) + lexicon.which)
    pair_doc, pair_word = np.divmod(pairs, max(1, len(lexicon.slots)))
    cells = 2 * FOLDS * SLOTS
    held = [np.bincount(kind[pair_doc] * SLOTS + lexicon.slots[pair_word], minlength=cells)]
    held.append(np.zeros(cells, np.int64))
    # a few documents at a time: they have many grams
    for first in range(0, len(texts), 100):
        some = slice(*np.searchsorted(pair_doc, [first, first + 100]))
        docs_here, words_here = pair_doc[some], pair_word[some]
        widths = np.diff(lexicon.gram_bounds)[words_here]
        begin = lexicon.gram_bounds[words_here] - np.cumsum(widths) + widths
        place = np.repeat(begin, widths) + np.arange(widths.sum())
        grams_here = np.unique(np.repeat(docs_here, widths) * SLOTS + lexicon.grams[place])
        of, slot = np.divmod(grams_here, SLOTS)
        held[1] += np.bincount(kind[of] * SLOTS + slot, minlength=cells)
    tables = [h.reshape(FOLDS, 2, SLOTS).astype(np.float32) for h in held]
    share = float(toxic.mean())
    fold_inputs = [
        lexicon.inputs(*(odds(t.sum(axis=0)[1] - t[f][1], t.sum(axis=0)[0] - t[f][0], share) for t in tables))
        for f in range(FOLDS)
    ]
    # of each text the windows that look worst, and another one of clean texts
    text, start, size = window_bounds(lexicon.bounds)
    made = np.random.default_rng(11)
    look = np.empty(len(text), np.float32)
    for f in range(FOLDS):
        here = np.flatnonzero(text % FOLDS == f)
        for first in range(0, len(here), 4096):
            some = here[first : first + 4096]
            x, real = gather(fold_inputs[f], lexicon.which, start[some], size[some])
            look[some] = np.where(real, x[:, 0] + x[:, 1], -np.inf).max(axis=0)
    order = np.lexsort((-look, text))
    rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    chosen = order[rank < np.where(toxic[text[order]], 3, 1)]
    clean = np.flatnonzero(~toxic[text])
    chosen = np.concatenate([chosen, made.choice(clean, min(len(clean), len(texts)), replace=False)])
    model = new_model()
    first_moment = {k: np.zeros_like(v) for k, v in model.items()}
    second_moment = {k: np.zeros_like(v) for k, v in model.items()}
    by_fold = [chosen[text[chosen] % FOLDS == f] for f in range(FOLDS)]
    by_fold = [here for here in by_fold if len(here)]
    for step in range(1, STEPS + 1):
        here = by_fold[step % len(by_fold)]
        some = made.choice(here, min(BATCH, len(here)), replace=False)
        f = int(text[some[0]] % FOLDS)
        x, real = gather(fold_inputs[f], lexicon.which, start[some], size[some])
        kept: dict = {}
        p = 1 / (1 + np.exp(-forward(model, x, real, kept)))
        grad = ((p - toxic[text[some]]) / len(some)).astype(np.float32)
        rate = RATE * (1 - step / (STEPS + 1))
        for k, d in backward(model, kept, grad).items():
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * d
            second_moment[k] = 0.99 * second_moment[k] + 0.01 * d * d
            mean, spread = first_moment[k] / (1 - 0.9**step), second_moment[k] / (1 - 0.99**step)
            model[k] = (model[k] - rate * mean / (np.sqrt(spread) + 1e-8)).astype(np.float32)
    # calibration on whole texts, each with the inputs of its fold
    highest = np.empty(len(texts), np.float32)
    for f in range(FOLDS):
        highest_here = logits(model, fold_inputs[f], lexicon.which, lexicon.bounds)
        highest[np.arange(len(texts)) % FOLDS == f] = highest_here[np.arange(len(texts)) % FOLDS == f]
    model["scale"] = logistic_fit(highest.astype(float), toxic.astype(float))
    model["word_odds"], model["gram_odds"] = (
        odds(t.sum(axis=0)[1], t.sum(axis=0)[0], share) for t in tables
    )
    return model


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic regression on one input, held near slope 1, offset 0.

    Newton steps are bounded: a few separable texts would drive them apart.
    """
    start, held = np.array([1.0, 0.0]), np.array([1.0, 0.1])
    beta = start.copy()
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(100):
        p = logistic(design @ beta)
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(held)
        move = np.linalg.solve(curve, design.T @ (p - y) + held * (beta - start))
        beta = beta - np.clip(move, -0.5, 0.5)
        beta[0] = max(beta[0], 0.05)
    return beta


def train_model(docs: DataFrame, labels: DataFrame, may_learn: Column) -> bytes:
    """The pickled model for `doc_id, text` and `doc_id, toxic`; `may_learn` filters `doc_id`."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    # a row per document, in an order that does not depend on partitions
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    ordered = texts.orderBy(F.xxhash64("doc_id"), "doc_id").coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        model = None
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            toxic = table.column("toxic").to_numpy() > 0
            text = table.column("text")
            model = train(text.chunk(0) if text.num_chunks == 1 else pa.concat_arrays(text.chunks), toxic)
        held = []
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    fitted = ordered.mapInArrow(fit, "model binary").first()
    return pickle.dumps(None) if fitted is None else bytes(fitted.model)


def score(docs: DataFrame, model: bytes, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` with `toxic_score` (0 to 1) and `toxic_flag` (1 from the threshold on)."""
    names = docs.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model)
        for batch in batches:
            for part in pieces(batch):
                found = np.zeros(part.num_rows)
                if net is not None:
                    lexicon = Lexicon(part.column("text"))
                    inputs = lexicon.inputs(net["word_odds"], net["gram_odds"])
                    slope, offset = net["scale"]
                    z = logits(net, inputs, lexicon.which, lexicon.bounds) * slope + offset
                    found = logistic(z.astype(float))
                flag = (found >= threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found), pa.array(flag)], names=[*names, "toxic_score", "toxic_flag"]
                )
        release()

    added = [StructField("toxic_score", DoubleType()), StructField("toxic_flag", IntegerType())]
    return docs.mapInArrow(read, StructType([*docs.schema.fields, *added]))
