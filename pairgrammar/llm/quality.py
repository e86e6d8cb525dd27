"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm.common import bounded_sample, map_texts, remainder_is_one, text_part

PARTS = 768  # sampled documents a label, at most
PART_CHARS = 6000  # characters of each
ROUNDS = 300
RIDGE = 1e-4
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_PLAIN = b" \t.,;:'\"?-()"
_STOPS = (b".", b"?", b"!", b":", b'"', b"'", b")")


def line_features(line: bytes) -> list[float]:
    """Shape of one line: what its characters are, how its words end, how often they repeat."""
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    letters = n - len(line.translate(None, _LETTERS))
    upper = n - len(line.translate(None, _UPPER))
    digits = n - len(line.translate(None, _DIGITS))
    plain = n - len(line.translate(None, _PLAIN))
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        1.0, 0.0, math.log1p(n) / 8, letters / n, upper / max(1, letters), digits / n, (n - letters - digits - plain) / n,
        min(1.0, (n - k + 1) / k / 20), len(set(words)) / k, again / k, line.endswith(_STOPS) + 0.0,
        line.count(b"|") / k, line.count(b"!") / k, min(1.0, len(max(words, key=len)) / 60)]


WIDTH = len(line_features(b"")) * 3


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line (its own shape, the previous line's, the next one's) and the lines' lengths."""
    lines = text.split(b"\n")
    own = np.array([line_features(x) for x in lines])
    rows = np.zeros((len(lines), WIDTH))
    k = own.shape[1]
    rows[:, :k] = own
    rows[1:, k:2 * k] = own[:-1]
    rows[:-1, 2 * k:] = own[1:]
    return rows, np.array([len(x) + 1.0 for x in lines])


def _chain(unary: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages (normalised) and the log of each step's sum, for chains side by side.

    ``unary``: (steps, chains, 2) log potentials; ``turn``: 2 x 2 log potentials of neighbours.
    """
    steps = len(unary)
    push, move = np.exp(unary - unary.max(axis=2, keepdims=True)), np.exp(turn)
    ahead, back, scale = np.empty_like(push), np.empty_like(push), np.empty(push.shape[:2])
    for t in range(steps):
        x = push[t] if t == 0 else push[t] * (ahead[t - 1] @ move)
        scale[t] = x.sum(axis=1)
        ahead[t] = x / scale[t][:, None]
    back[-1] = 1.0
    for t in range(steps - 2, -1, -1):
        back[t] = (push[t + 1] * back[t + 1]) @ move.T / scale[t + 1][:, None]
    return ahead, back, np.log(scale) + unary.max(axis=2)


def fit(texts: list[tuple[bytes, int]], rounds: int = ROUNDS) -> dict | None:
    """Weights that make the labels likely, every line bearing its document's label.

    Gradient steps (Adam) on the mean conditional log likelihood of the chains, both labels weighing
    alike. Without documents of both labels there is no model.
    """
    if len({y for _, y in texts}) < 2:
        return None
    made = [(document_features(t)[0], y) for t, y in texts]
    mean, spread = np.concatenate([m for m, _ in made]).mean(axis=0), np.concatenate([m for m, _ in made]).std(axis=0)
    spread[spread < 1e-9], mean[0] = 1.0, 0.0
    mean[spread == 1.0] = 0.0
    made.sort(key=lambda x: len(x[0]))
    share = {y: sum(1 for _, z in made if z == y) for y in (0, 1)}
    packs = []
    for i in range(0, len(made), 128):
        part = made[i:i + 128]
        steps = max(len(m) for m, _ in part)
        x, on = np.zeros((steps, len(part), WIDTH)), np.zeros((steps, len(part)))
        for j, (m, _) in enumerate(part):
            x[:len(m), j], on[:len(m), j] = (m - mean) / spread, 1.0
        y = np.array([z for _, z in part])
        packs.append((x, on, y, np.array([0.5 / share[z] for z in y]) / np.maximum(1, on.sum(axis=0))))
    weight, turn = np.zeros(WIDTH), np.zeros((2, 2))
    first, second = [np.zeros(WIDTH), np.zeros((2, 2))], [np.zeros(WIDTH), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        grad = [RIDGE * weight, RIDGE * turn]
        for x, on, y, each in packs:
            unary = np.zeros((*on.shape, 2))
            unary[:, :, 1] = (x @ weight) * on
            alive = on[1:, :, None, None]
            ahead, back, _ = _chain_padded(unary, turn, on)
            here = ahead * back
            here /= here.sum(axis=2, keepdims=True)
            grad[0] += np.einsum("sc,scf->f", (here[:, :, 1] - y) * on * each, x)
            if len(on) > 1:
                push = np.exp(unary - unary.max(axis=2, keepdims=True))
                pair = ahead[:-1, :, :, None] * np.exp(turn) * (push * back)[1:, :, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                truth = np.zeros((len(y), 2, 2))
                truth[np.arange(len(y)), y, y] = 1.0
                grad[1] += ((pair - truth) * alive * each[None, :, None, None]).sum(axis=(0, 1))
        for i, (value, g) in enumerate(((weight, grad[0]), (turn, grad[1]))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            value -= 0.05 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return {"weight": weight / spread, "shift": float(-(mean / spread) @ weight), "turn": turn}


def _chain_padded(unary: np.ndarray, turn: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_chain`` for chains of unlike lengths: the backward message is one at a chain's own end."""
    ahead, back, scale = _chain(unary, turn)
    push, move = np.exp(unary - unary.max(axis=2, keepdims=True)), np.exp(turn)
    back[-1] = 1.0
    for t in range(len(unary) - 2, -1, -1):
        x = (push[t + 1] * back[t + 1]) @ move.T
        x /= x.sum(axis=1, keepdims=True)
        back[t] = np.where(on[t + 1][:, None] > 0, x, 1.0)
    return ahead, back, scale


def good_share(text: bytes | None, model: dict | None) -> float:
    """Mean over lines of the marginal probability of ``good``, weighted by the lines' lengths.

    The forward and backward passes keep one number a line: the odds of good against bad.
    """
    if model is None:
        return 0.5
    rows, size = document_features(text or b"")
    push = np.exp(np.clip(rows @ model["weight"] + model["shift"], -30, 30)).tolist()
    (bb, bg), (gb, gg) = np.exp(model["turn"]).tolist()
    n = len(push)
    ahead, odds = [0.0] * n, 1.0
    for t, p in enumerate(push):
        odds = p if t == 0 else p * (bg + gg * odds) / (bb + gb * odds)
        ahead[t] = odds
    total, odds = 0.0, 1.0
    size = size.tolist()
    for t in range(n - 1, -1, -1):
        both = ahead[t] * odds
        total += size[t] * both / (1.0 + both)
        p = push[t] * odds
        odds = (gb + gg * p) / (bb + bg * p)
    return total / sum(size)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict | None:
    """A field fitted on at most ``PARTS`` labelled documents a label, ``PART_CHARS`` characters of each.

    Labels come from rows whose crc32 remainder by 3 is not 1. Labels other than 0 and 1 teach
    nothing; a document labelled both ways counts as bad.
    """
    ids = docs.select(F.col(key).alias("key")).where(~remainder_is_one("key", 3))
    marked = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~remainder_is_one("key", 3))
        .groupBy("key").agg(F.min("y").alias("y")).join(ids, "key", "left_semi"))
    picks = F.broadcast(bounded_sample(marked, "key", "y", PARTS))
    parts = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(picks, "key")
        .groupBy("key", "label", "h").agg(F.min(text_part(F.coalesce("text", F.lit("")), F.col("h"), PART_CHARS)).alias("part")).collect())
    return fit([((r["part"] or "").encode(), r["label"]) for r in sorted(parts, key=lambda r: (r["h"], r["key"]))])


def rate(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns), ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5) of every row.

    Null and empty texts are one empty line. Every line of a text is labelled; nothing but the text
    enters the score, so repeated rows score alike. Without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts):
            scores = [good_share(t, own) for t in texts]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
        return work

    return map_texts(docs, text, keep, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
