"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Where a state has no edge for the next byte, the automaton pops the
pieces that greedy longest-match is then sure of and moves along the failure link; only their number is kept, computed
for each state in advance, so no piece is ever built and each byte is looked at once.

A word is a maximal run without white space, written with the mark of a word's beginning in front; byte-level
vocabularies hold every byte, so no word is unknown there. With other vocabularies a word that cannot be cut is one
unknown piece. Counts follow from whole words, each counted once for every batch it occurs in.

Defined results: a null text has no words and no pieces, like an empty one; ids are passed on as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import parts, table
from .packing import byte_alphabet

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
NONE = -1
REMEMBERED = 300_000
LONG = 64


def byte_level_pieces(path: str = VOCABULARY) -> tuple[bytes, list[bytes]]:
    """The mark of a word's beginning and all pieces, as bytes: in front of a word the mark is the byte of a space."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, added = byte_alphabet(), {t["content"] for t in model["added_tokens"]}
    return b" ", [bytes(letters[c] for c in token) for token in model["model"]["vocab"] if token not in added]


class Automaton:
    """States 0 (before a word) and 1 (inside a word, at the beginning of a piece), then one for each longer prefix.

    pops[s] and fails[s]: how many pieces are sure when state s has no edge, and where to go on (-1: the word is unknown).
    Edges lie in one hash table of (state, byte) keys, open addressing, in arrays that ship to any task.
    """

    def __init__(self, mark: bytes, pieces: Iterable[bytes]) -> None:
        children: list[dict[int, int]] = [{}, {}]
        whole: list[bool] = [False, False]

        def insert(root: int, piece: bytes) -> None:
            at = root
            for byte in piece:
                nxt = children[at].get(byte)
                if nxt is None:
                    nxt = children[at][byte] = len(children)
                    children.append({})
                    whole.append(False)
                at = nxt
            whole[at] = at != root

        for piece in pieces:
            # Pieces that begin a word grow from state 0; a piece without the mark continues a word.
            insert(0 if piece.startswith(mark) else 1, piece)
        fails, pops = [NONE] * len(children), [0] * len(children)
        queue = [0, 1]
        for at in queue:  # breadth first
            for byte, child in children[at].items():
                queue.append(child)
                if whole[child]:
                    fails[child], pops[child] = 1, 1
                    continue
                n, z = pops[at], fails[at]
                while z != NONE and byte not in children[z]:
                    n, z = n + pops[z], fails[z]
                if z != NONE:
                    fails[child], pops[child] = children[z][byte], n
        self.mark = mark
        self.fails, self.pops = np.array(fails, dtype=np.int32), np.array(pops, dtype=np.int32)
        keys = np.array([s << 8 | b for s, edges in enumerate(children) for b in edges], dtype=np.int64)
        targets = np.array([t for edges in children for t in edges.values()], dtype=np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.targets = np.full(1 << bits, NONE, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):  # all keys try a slot; of those that meet in a free one the first stays
            free = self.keys[slots[left]] == NONE
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slots[left], return_index=True)[1]] = True
            won = left[free & first]
            self.keys[slots[won]], self.targets[slots[won]] = keys[won], targets[won]
            left = left[~(free & first)]
            taken = self.keys[slots[left]] != NONE
            slots[left[taken]] = (slots[left[taken]] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The targets of edges; -1 where there is none."""
        keys = states.astype(np.int64) << 8 | letters
        slots, out = self._slot(keys), np.full(len(keys), NONE, dtype=np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.targets[slots[open_[hit]]]
            open_ = open_[~hit & (held != NONE)]
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, all words side by side, byte by byte; an unknown word is one piece."""
        out = np.zeros(len(words), dtype=np.int64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):  # words of about one length together, so that padding stays small
            longest = max(LONG, 2 * len(words[order[at]]))
            end = at
            while end < len(order) and len(words[order[end]]) <= longest and (end - at) * longest < 1 << 24:
                end += 1
            out[order[at:end]] = self._counts([self.mark + words[i] for i in order[at:end]])
            at = end
        return out

    def _counts(self, words: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in words])
        width = int(size.max())
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        state, count = np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        for k in range(width):
            live = np.flatnonzero((size > k) & (state != NONE))
            while len(live):
                nxt = self.step(state[live], letters[live, k])
                state[live[nxt != NONE]] = nxt[nxt != NONE]
                live = live[nxt == NONE]
                count[live] += self.pops[state[live]]
                state[live] = self.fails[state[live]]
                live = live[state[live] != NONE]
        live = np.flatnonzero((state != NONE) & (state != 1))
        while len(live):  # the word's end fits no edge
            count[live] += self.pops[state[live]]
            state[live] = self.fails[state[live]]
            live = live[(state[live] != NONE) & (state[live] != 1)]
        return np.where(state == NONE, 1, count)


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str = VOCABULARY) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*byte_level_pieces(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(path), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for texts in parts(batch.column(1)):
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list({w for ws in words for w in ws if w not in known})
                known.update(zip(new, machine.counts(new).tolist(), strict=True))
                n_words += map(len, words)
                n_tokens += [sum(map(known.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_tokens, type=pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
