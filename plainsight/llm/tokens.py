"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8), by a pair occurrence index.

Texts are cut into pieces by the vocabulary's pattern. The new pieces of an Arrow batch are laid out in one
linked list of symbols; an index maps each mergeable pair to all its positions; ranks that are active are taken
in ascending order and applied to all positions at once, and the lists of the pairs that arise are updated.
Pieces already encoded in a partition are remembered, within a bound that only costs time.

Defined cases: null and empty texts give an empty list; lone surrogates cannot occur in Spark strings; names
of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pattern of pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per partition.
REMEMBERED = 300_000
#: Pieces encoded in one go.
BLOCK = 200_000
_SHIFT = 20


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairIndexEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.merged: dict[int, int] = {}  # packed pair to the rank of its union, -1 if it has none

    def _rank(self, pair: int) -> int:
        r = self.ranks.get(self.token[pair >> _SHIFT] + self.token[pair & ((1 << _SHIFT) - 1)], -1)
        self.merged[pair] = r
        return r

    def _listed(self, sym, nxt, at, where: dict, active: list) -> None:
        """Enter the mergeable pairs that begin at positions ``at`` into the index."""
        pairs = sym[at] << _SHIFT | sym[nxt[at]]
        kinds, which = np.unique(pairs, return_inverse=True)
        merged = self.merged
        rank = np.array([r if (r := merged.get(k)) is not None else self._rank(k) for k in kinds.tolist()], np.int64)[which]
        keep = rank >= 0
        if not keep.all():
            at, pairs, rank = at[keep], pairs[keep], rank[keep]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, pairs, rank = at[order], pairs[order], rank[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for lo, hi in zip(cuts, cuts[1:]):
            r = int(rank[lo])
            if r in where:
                where[r].append((at[lo:hi], pairs[lo:hi]))
            else:
                where[r] = [(at[lo:hi], pairs[lo:hi])]
                heappush(active, r)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of every piece; the pieces are merged together, rank by rank."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)  # a wall of -1 ends every piece
        n = int(ends[-1]) if len(pieces) else 0
        sym = np.full(n + 1, -1, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        sym[:n][inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.arange(1, n + 2)
        nxt[n] = n
        prv = np.arange(-1, n)
        prv[0] = n
        where: dict[int, list] = {}
        active: list[int] = []
        self._listed(sym, nxt, np.flatnonzero((sym[:n] >= 0) & (sym[1:] >= 0)), where, active)
        while active:
            r = heappop(active)
            entries = where.pop(r)
            at, pairs = entries[0] if len(entries) == 1 else map(np.concatenate, zip(*entries))
            at = at[(sym[at] << _SHIFT | sym[nxt[at]]) == pairs]  # spots that an earlier merge took are gone
            if len(at) > 1:
                at.sort()
                chained = nxt[at[:-1]] == at[1:]
                if chained.any():  # overlapping spots merge from the left, every other one of a chain
                    index = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), index, 0))
                    at = at[(index - head) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            sym[gone] = -2
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            left = before[sym[before] >= 0]
            right = at[sym[after] >= 0]
            new = np.concatenate([left, right])
            if len(left) and len(right):
                new = np.unique(new)
            if len(new):
                self._listed(sym, nxt, new, where, active)
        alive = sym[:n] >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        starts = ends - sizes - 1
        return sym[:n][alive].astype(np.int32), total[ends] - total[starts]


def encoded(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``. The vocabulary (of fixed size) is read here and travels with the tasks."""
    ranks = read_vocabulary(vocabulary)

    def run(batches):
        import regex

        cut = regex.compile(PATTERN).findall
        encoder = PairIndexEncoder(ranks)
        known: dict[str, int] = {}
        flat = counts = np.empty(0, np.int32)
        for b in batches:
            pieces = [cut(t) if t else [] for t in b.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known, flat, counts = {}, np.empty(0, np.int32), np.empty(0, np.int32)
            new = list({p for ps in pieces for p in ps if p not in known})
            for at in range(0, len(new), BLOCK):
                block = new[at : at + BLOCK]
                ids, sizes = encoder.encode([p.encode() for p in block])
                known.update(zip(block, range(len(known), len(known) + len(block))))
                flat, counts = np.concatenate([flat, ids]), np.concatenate([counts, sizes])
            starts = np.concatenate([[0], np.cumsum(counts)])
            seq = np.array([known[p] for ps in pieces for p in ps], np.int64)
            per_piece = counts[seq] if len(seq) else np.empty(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(per_piece)])
            spots = np.repeat(starts[seq] - upto[:-1], per_piece) + np.arange(upto[-1]) if len(seq) else np.empty(0, np.int64)
            edges = np.concatenate([[0], np.cumsum([len(ps) for ps in pieces])]).astype(np.int64)
            values = pa.array(flat[spots.astype(np.int64)], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(upto[edges], pa.int32()), values)
            yield pa.record_batch([b.column(0), lists], names=["id", "ids"])

    rows = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", key)
