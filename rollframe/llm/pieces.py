"""Token counts: greedy longest-match word pieces by a linear automaton, without building the pieces."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, read_words, received, send

ROOT = 0
LONG_WORD = 64


class PieceAutomaton:
    """A trie of the vocabulary with failure links.

    Where no edge goes on, the longest pieces of what was read are popped until
    the remainder is a trie path with such an edge.  ``popped[v]`` counts the
    pieces popped on the way from ``v`` to ``fail[v]``; -1 in ``fail`` says that
    no way leads on.  Edges are one sorted array of node * 256 + byte.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        edges: dict[int, int] = {}
        whole = [False]
        parent = [(0, 0)]
        for piece in pieces:
            at = ROOT
            for byte in piece:
                key = at * 256 + byte
                if key not in edges:
                    edges[key] = len(whole)
                    whole.append(False)
                    parent.append((at, byte))
                at = edges[key]
            whole[at] = at != ROOT
        fail, popped = [-1] * len(whole), [0] * len(whole)
        below: list[list[int]] = [[] for _ in whole]
        for key, to in edges.items():
            below[key >> 8].append(to)
        queue = deque(below[ROOT])
        while queue:
            v = queue.popleft()
            queue.extend(below[v])
            if whole[v]:
                fail[v], popped[v] = ROOT, 1
                continue
            u, byte = parent[v]
            z, n = fail[u], popped[u]
            while z >= 0 and z * 256 + byte not in edges:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = edges[z * 256 + byte], n
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.targets = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int32)
        self.fail, self.popped = np.array(fail, dtype=np.int32), np.array(popped, dtype=np.int32)

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The nodes behind the edges, -1 where there is none."""
        keys = nodes.astype(np.int64) * 256 + bytes_
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.targets[at], -1)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: int | None) -> np.ndarray:
        """Pieces of each word ``data[start:end]`` (after the byte ``lead``); 1 for a word that can't be cut into pieces."""
        lengths = ends - starts
        out = np.zeros(len(starts), dtype=np.int64)
        short = lengths <= LONG_WORD
        for i in np.flatnonzero(~short):
            out[i] = self.count_one(data[starts[i] : ends[i]].tobytes(), lead)
        order = np.flatnonzero(short)
        order = order[np.argsort(-lengths[order], kind="stable")]
        starts, lengths = starts[order], lengths[order]
        node = np.full(len(order), ROOT, dtype=np.int32)
        total = np.zeros(len(order), dtype=np.int64)
        lost = np.zeros(len(order), dtype=bool)

        def read(active: np.ndarray, bytes_: np.ndarray) -> None:
            while len(active):
                to = self.step(node[active], bytes_)
                good = to >= 0
                node[active[good]] = to[good]
                active, bytes_ = active[~good], bytes_[~good]
                total[active] += self.popped[node[active]]
                back = self.fail[node[active]]
                lost[active[back < 0]] = True
                active, bytes_, back = active[back >= 0], bytes_[back >= 0], back[back >= 0]
                node[active] = back

        if lead is not None:
            read(np.arange(len(order)), np.full(len(order), lead))
        for at in range(int(lengths.max(initial=0))):
            active = np.arange(np.searchsorted(-lengths, -at, "left"))
            active = active[~lost[active]]
            read(active, data[starts[active] + at])
        rest = np.flatnonzero((node != ROOT) & ~lost)
        while len(rest):
            total[rest] += self.popped[node[rest]]
            node[rest] = self.fail[node[rest]]
            lost[rest[node[rest] < 0]] = True
            rest = rest[node[rest] > ROOT]
        out[order] = np.where(lost, 1, total)
        return out

    def count_one(self, word: bytes, lead: int | None) -> int:
        """The same for one long word, byte by byte."""
        if not hasattr(self, "edges"):
            self.edges = dict(zip(self.keys.tolist(), self.targets.tolist()))
        node = total = 0
        for byte in (word if lead is None else bytes([lead]) + word):
            while (to := self.edges.get(node * 256 + byte)) is None:
                total += int(self.popped[node])
                node = int(self.fail[node])
                if node < 0:
                    return 1
            node = to
        while node > ROOT:
            total += int(self.popped[node])
            node = int(self.fail[node])
        return 1 if node < 0 else total

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "edges"}


def byte_level_pieces(vocabulary: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file; a piece that begins a word begins with a space.

    Such files write each byte as one printable character: printable Latin-1
    bytes as themselves, the others as the characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(vocabulary, encoding="utf-8") as f:
        content = json.load(f)
    special = {t["content"] for t in content["added_tokens"]}
    return [bytes(letters[c] for c in p) for p in content["model"]["vocab"] if p not in special]


def _count(sent, lead: int | None):
    def run(batches):
        automaton: PieceAutomaton = received(sent)
        powers = Powers()
        for batch in batches:
            words = np.zeros(batch.num_rows, dtype=np.int64)
            pieces = np.zeros(batch.num_rows, dtype=np.int64)
            for w in read_words(batch.column("text"), powers):
                _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                each = automaton.count(w.data, w.starts[first], w.ends[first], lead)[back]
                upto = np.r_[0, np.cumsum(each)]
                own = slice(w.first, w.first + len(w))
                words[own], pieces[own] = np.diff(w.bounds), upto[w.bounds[1:]] - upto[w.bounds[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(pieces)], names=["doc_id", "n_words", "n_tokens"]
            )

    return run


def count_pieces(docs: DataFrame, pieces: list[bytes], lead: str | None = " ") -> DataFrame:
    """Words and greedy longest-match pieces of each row of ``docs`` (doc_id, text).

    Each word, after ``lead``, is cut from the left into the longest pieces of
    the vocabulary; a word that can't be cut to its end is one (unknown) piece.
    The automaton, a few megabytes as the vocabulary is, goes to the executors.

    Null and empty texts have 0 words and 0 pieces; one row per input row,
    repeated rows and null ids included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = send(docs.sparkSession, PieceAutomaton(pieces))
    return rows.mapInArrow(_count(sent, None if lead is None else ord(lead)), "doc_id long, n_words long, n_tokens long")
