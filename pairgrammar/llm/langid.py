"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgrammar.llm.common import bounded_sample, map_texts, remainder_is_one, text_part

MODEL_BYTES = 96 << 10  # training text of all languages together
PARTS = 64  # sampled documents a language, at most
PART_CHARS = 512  # characters of each
STRIP = 512  # bytes parsed in one strip
LEAST_SPAN, LEAST_CHARS = 2.0, 64  # a text this long with shorter phrases is in no learned language
PAD = 0xFF  # no byte of UTF-8
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# ASCII letters in lower case, other ASCII a blank, bytes of other characters as they are
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """Letters in words, one blank between them."""
    return b" ".join(text.translate(_FOLD).split())


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``data``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    suffix, reach, last = [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        reach.append(reach[last] + 1)
        suffix.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = suffix[at]
        if at >= 0:
            hit = step[at][c]
            if reach[hit] == reach[at] + 1:
                suffix[new] = hit
            else:
                twin = len(step)
                step.append(dict(step[hit]))
                reach.append(reach[at] + 1)
                suffix.append(suffix[hit])
                suffix[hit] = suffix[new] = twin
                while at >= 0 and step[at].get(c) == hit:
                    step[at][c] = twin
                    at = suffix[at]
        last = new
    return step


def build_model(samples: dict[str, bytes]) -> dict:
    """Dense tables of all automata, laid end to end.

    An entry is twice the next row offset, plus 1 where the longest match ends and a phrase begins.
    """
    samples = {k: v for k, v in sorted(samples.items()) if v}
    seen = sorted(set(b"".join(samples.values())))
    lut = np.zeros(256, np.int32)
    for i, c in enumerate(seen):
        lut[c] = i + 1
    width = len(seen) + 2
    lut[PAD] = width - 1
    tables, starts, base = [], [], 0
    for data in samples.values():
        steps = suffix_automaton(data)
        table = np.empty((len(steps), width), np.int64)
        fresh = np.full(width, base * width * 2 + 1, np.int64)
        for c, to in steps[0].items():
            fresh[lut[c]] = (base + to) * width * 2 + 1
        for s, moves in enumerate(steps):
            row = table[s]
            row[:] = fresh
            for c, to in moves.items() if s else ():  # at the start every symbol begins a phrase
                row[lut[c]] = (base + to) * width * 2
            row[width - 1] = (base + s) * width * 2
        tables.append(table)
        starts.append(base * width)
        base += len(steps)
    flat = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
    return {"langs": list(samples), "bits": [math.log2(len(v) + 1) for v in samples.values()], "lut": lut, "starts": np.array(starts, np.int64), "table": flat.astype(np.int32) if flat.size == 0 or flat.max() < 2**31 else flat}


def phrase_counts(texts: list[bytes], model: dict) -> np.ndarray:
    """Phrases of every text under every language, strips of ``STRIP`` bytes parsed side by side."""
    strips = [-(-len(t) // STRIP) for t in texts]
    flat = np.frombuffer(b"".join(t.ljust(k * STRIP, b"\xff") for t, k in zip(texts, strips)), np.uint8)
    symbols = np.ascontiguousarray(model["lut"][flat].reshape(-1, STRIP).T)
    table = model["table"]
    state = np.repeat(model["starts"].astype(table.dtype)[:, None], symbols.shape[1], axis=1)
    count = np.zeros(state.shape, np.int32)
    for row in symbols:
        state += row
        state = table.take(state)
        count += state & 1
        state >>= 1
    owner = np.repeat(np.arange(len(texts)), strips)
    return np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], axis=1)


def predict_texts(texts: list[bytes | None], model: dict) -> tuple[list[str], list[float], list[float]]:
    """Language, confidence and bytes a phrase of each text."""
    langs, scores, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    have = [i for i, t in enumerate(texts) if t and model["langs"] and _LETTER.search(t.decode("utf-8", "replace"))]
    if not have:
        return langs, scores, spans
    clean = [folded(texts[i]) for i in have]
    counts = phrase_counts(clean, model)
    cost = counts * np.array(model["bits"])
    order = np.argsort(cost, axis=1, kind="stable")
    for n, i in enumerate(have):
        best = order[n, 0]
        langs[i] = model["langs"][best]
        spans[i] = len(clean[n]) / counts[n, best]
        second = cost[n, order[n, 1]] if len(order[n]) > 1 else math.inf
        scores[i] = 1.0 if second == math.inf else float(second / (cost[n, best] + second))
    return langs, scores, spans


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Automata from at most ``PARTS`` documents a language, ``PART_CHARS`` characters of each.

    Learns from rows with a key, a text and a language whose crc32 remainder by 3 is not 1. All
    languages share ``MODEL_BYTES``, so the tables have at most 2 * MODEL_BYTES rows of 258 entries.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~remainder_is_one("key", 3))
    picks = bounded_sample(rows.where(F.length("text") > 0), "key", "lang", PARTS)
    parts = (
        rows.join(F.broadcast(picks.select("key", "h", F.col("label").alias("lang"))), ["key", "lang"])
        .groupBy("lang", "h").agg(F.min(text_part(F.col("text"), F.col("h"), PART_CHARS)).alias("part")).collect())
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in parts:
        by.setdefault(r["lang"], []).append((r["h"], folded((r["part"] or "").encode())))
    share = MODEL_BYTES // max(1, len(by))
    return build_model({k: b" ".join(p for _, p in sorted(v))[:share].strip() for k, v in by.items()})


def identify(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns), ``lang_pred``, ``score`` and ``span`` of every row.

    A text that is null or has no letter is ``und`` with score 0. Texts are parsed whole, in strips;
    a tie goes to the language that sorts first. Repeated rows are judged alike; without a learned
    language everything is ``und``. score is the runner-up's cost over both costs (0.5 to 1).
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts):
            langs, scores, spans = predict_texts(texts, own)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.float64())]
        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("span", T.DoubleType())]
    return map_texts(docs, text, keep, fields, make)
