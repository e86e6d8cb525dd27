"""Word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairgrammar.llm.common import map_texts, tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
START = b" "  # stands before every word, so pieces that begin a word differ from those inside


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file with one base64 piece and one rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def build(pieces: list[bytes]) -> tuple[dict[int, int], list[int], list[int]]:
    """``step`` (node * 256 + byte to node), ``fail`` and ``popped`` of the vocabulary trie.

    Reading stops at a node when no child fits; then ``popped`` pieces are certain under longest
    match first, and what has been read beyond them is spelled by the path to ``fail``. -1: nothing
    can be matched. Only counts are kept, no piece.
    """
    step: dict[int, int] = {}
    whole = [False]
    parent: list[tuple[int, int]] = [(0, 0)]
    for piece in pieces:
        node = 0
        for c in piece:
            to = step.get(node << 8 | c)
            if to is None:
                to = step[node << 8 | c] = len(whole)
                whole.append(False)
                parent.append((node, c))
            node = to
        whole[node] = bool(piece)
    fail, popped = [-1] * len(whole), [0] * len(whole)
    children: list[list[int]] = [[] for _ in whole]
    for node in range(1, len(whole)):
        children[parent[node][0]].append(node)
    queue = deque(children[0])
    while queue:
        node = queue.popleft()
        queue.extend(children[node])
        if whole[node]:
            fail[node], popped[node] = 0, 1
            continue
        up, c = parent[node]
        back, count = fail[up], popped[up]
        while back >= 0 and back << 8 | c not in step:
            count += popped[back]
            back = fail[back]
        if back >= 0:
            fail[node], popped[node] = step[back << 8 | c], count
    return step, fail, popped


def piece_count(word: bytes, automaton: tuple[dict[int, int], list[int], list[int]]) -> int:
    """Pieces of one word under longest match first; 0 if some part matches no piece."""
    step, fail, popped = automaton
    node = count = 0
    for c in word:
        to = step.get(node << 8 | c)
        while to is None:
            if fail[node] < 0:
                return 0
            count += popped[node]
            node = fail[node]
            to = step.get(node << 8 | c)
        node = to
    while node > 0:
        count += popped[node]
        node = fail[node]
    return 0 if node < 0 else count


def count_pieces(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``row`` (the kept columns), ``n_words``, ``n_tokens`` and ``n_unknown`` of every whole text.

    Words (A-Z lowered) are cut into pieces by longest match first. A word that cannot be matched is one
    unknown token, counted in ``n_tokens`` too. Null and empty texts have none. The
    vocabulary is a file of fixed size; repeated words are looked up, so time goes with distinct words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(read_vocabulary(vocabulary)))

    def make():
        automaton = shared.value

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > 500_000:
                    self.clear()
                value = self[word] = piece_count(START + word, automaton)
                return value
        known = Known()

        def work(texts):
            words, total, odd = [], [], []
            for t in texts:
                counts = list(map(known.__getitem__, tokens(t)))
                unknown = counts.count(0)
                words.append(len(counts))
                total.append(sum(counts) + unknown)
                odd.append(unknown)
            return [pa.array(words, pa.int64()), pa.array(total, pa.int64()), pa.array(odd, pa.int64())]
        return work

    return map_texts(docs, text, keep, [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")], make)
