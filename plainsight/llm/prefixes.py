"""Shared parts of the set-similarity joins: word sets, a global rarity order, signatures of boxes, verification.

Words are ordered by the number of records that hold them. Similarity 3/4 lets a record of n words miss at most
d = n - ceil(3 n / 4) of them in a partner. Its prefix, the rarest words, is divided into boxes by how frequent the
words are: of a box of class k two partners must share at least k words, that is a box of c words may miss c - k.
The prefix ends where these budgets, each plus one, add up to d + 1, so by the general pigeonhole principle every
pair shares k words of some box of class k, and each combination of k words of a box is one signature.

Class k holds the words up to n_records * (GROUP / n_records) ** (1 / k) records: k independent words of it meet
in GROUP records at most, however large the collection is. Long records divide every class by hash into further
boxes, as many as their length allows, so their signatures stay in proportion to their words.

Records of one length scheme meet each other; a record whose partners may be so short that they fall into the
scheme before is entered there too, as a guest. Of the shortest records (up to four words) a partner shares a
whole subset, so their signatures are exactly the subsets of the sizes that similarity allows.

``GROUP`` decides cost, not results: the scheme loses no pair.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records that independent words of one signature meet in, at most.
GROUP = 64
#: Frequent words held in memory; beyond, their counts are joined by a shuffle.
HELD = 200_000
#: Similarity of word sets, as a fraction.
NUM, DEN = 3, 4
SEGMENTS = 8
_BITS = 128 // SEGMENTS
DEPTH = 4
#: Cells of one block of combinations.
_CELLS = 1 << 21


def word_hashes(key: str = "key"):
    return F.transform(F.array_distinct(F.split(key, " +")), lambda w: F.when(w != "", F.xxhash64(w)))


def with_words(classes: DataFrame) -> DataFrame:
    """``rep``, ``w`` (the hashes of its distinct words) and ``tag``, which signatures carry along."""
    tag = F.col("tag") if "tag" in classes.columns else F.lit(0)
    return classes.select("rep", F.array_compact(word_hashes()).alias("w"), tag.cast("int").alias("tag")).where(F.size("w") > 0)


def frequent_words(sets: DataFrame, group: int) -> DataFrame:
    return sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") > group)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


# --- length schemes ------------------------------------------------------------------------------------------------


def scheme_of(n: np.ndarray) -> np.ndarray:
    """0 up to four words, 1 up to eight, 2 up to 31, then one for each power of two."""
    n = np.asarray(n)
    return np.where(n < 5, 0, np.where(n < 9, 1, np.where(n < 32, 2, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 2)))


def boxes_of(scheme: np.ndarray) -> np.ndarray:
    """Boxes of each class. With depth D they cost at most boxes * D (D - 1) / 2 words, which the least length of the
    scheme can spare: ceil(3 n / 4) - 1.
    """
    scheme = np.asarray(scheme, np.int64)
    least = np.left_shift(1, np.minimum(np.maximum(scheme + 2, 5), 40))
    return np.where(scheme < 3, 1, (NUM * least // DEN - 1) // (DEPTH * (DEPTH - 1) // 2))


def least_partner(n: np.ndarray) -> np.ndarray:
    return -(-NUM * np.asarray(n) // DEN)


@lru_cache(None)
def subset_sizes(n: int) -> tuple[int, ...]:
    """Overlaps that a record of n words can have with a similar one, the shorter of which has four words or fewer."""
    sizes = set()
    for b in range(1, 2 * n + 1):
        if min(n, b) <= 4:
            sizes |= {s for s in range(1, min(n, b) + 1) if s * (NUM + DEN) >= NUM * (n + b)}
    return tuple(sorted(sizes))


@lru_cache(4096)
def _combos(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


# --- signatures of a batch -----------------------------------------------------------------------------------------


def _sketches(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Parity sketch: every word flips one bit of 128; differing bits never outnumber differing words."""
    bit = (_mix(flat) % np.uint64(128)).astype(np.int64)
    grid = np.bincount(row * 128 + bit, minlength=rows * 128).reshape(rows, 128) & 1
    return np.packbits(grid.astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def _hashed(tokens: np.ndarray, combos: np.ndarray, salt) -> np.ndarray:
    """One hash for each combination (columns) of each group of tokens (rows), whatever their order."""
    out = np.zeros((len(tokens), len(combos)), np.uint64)
    for c in combos.T:
        out += tokens[:, c]
    return _mix(_mix(out + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salt, np.uint64).reshape(-1, 1))).astype(np.int64)


def _blocks(count: int, width: int):
    step = max(1, _CELLS // max(width, 1))
    return ((at, min(at + step, count)) for at in range(0, count, step))


def _subset_signatures(mixed, start, n, who):
    """(signature, record, position 0) of the subsets of the shortest records."""
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        tokens = mixed[start[rows][:, None] + np.arange(size)]
        for s in subset_sizes(int(size)):
            combos = _combos(int(size), s)
            sig = _hashed(tokens, combos, s)
            yield sig.ravel(), np.repeat(who[rows], len(combos)), np.zeros(sig.size, np.int64)


def _box_signatures(mixed, df, start, n, who, scheme, records, group):
    """(signature, record, position) of the boxes of each record's prefix. Words come in order of rarity.

    The position is that of the combination's first word less the words that partners may share before it
    without a signature: so many fewer than k in every earlier box.
    """
    boxes = boxes_of(scheme)
    depth = np.where(scheme < 2, DEPTH - 1, DEPTH)
    total = int(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    token = start[row] + pos
    m, f = mixed[token], df[token]
    kind = np.ones(total, np.int64)
    for k in range(1, DEPTH):
        kind += f > records * (group / records) ** (1 / k)
    kind = np.minimum(kind, depth[row])
    sub = np.where(kind > 1, (_mix(m + np.uint64(17)) % boxes[row].astype(np.uint64)).astype(np.int64), 0)
    order = np.lexsort((pos, sub, kind, row))
    first = np.ones(total, bool)
    r, k_, s_ = row[order], kind[order], sub[order]
    first[1:] = (r[1:] != r[:-1]) | (k_[1:] != k_[:-1]) | (s_[1:] != s_[:-1])
    place = np.arange(total)
    inside = np.empty(total, np.int64)
    inside[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    gain = (inside >= kind - 1).astype(np.int64)
    before = np.cumsum(gain) - gain
    before -= np.repeat(before[np.cumsum(n) - n], n)
    d = n - least_partner(n)
    prefix = before <= d[row]

    at = np.flatnonzero(prefix & (kind == 1))
    salt = scheme[row[at]] * 8 + 8
    yield _hashed(m[at][:, None], _combos(1, 1), salt).ravel(), who[row[at]], pos[at]

    held = order[prefix[order] & (kind[order] > 1)]
    if not len(held):
        return
    r, k_, s_ = row[held], kind[held], sub[held]
    cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k_[1:] != k_[:-1]) | (s_[1:] != s_[:-1])]))
    count = np.diff(np.append(cut, len(held)))
    shapes = k_[cut] * (1 << 32) + count
    for shape in np.unique(shapes):
        k, c = int(shape >> 32), int(shape & ((1 << 32) - 1))
        if c < k:
            continue
        combos = _combos(c, k)
        groups = cut[shapes == shape]
        for lo, hi in _blocks(len(groups), len(combos)):
            tokens = held[groups[lo:hi][:, None] + np.arange(c)]
            lead = row[tokens[:, 0]]
            sig = _hashed(m[tokens], combos, scheme[lead] * 8 + 8 + k)
            slack = boxes[lead] * ((k - 1) * (k - 2) // 2) + (boxes[lead] - 1) * (k - 1)
            where = pos[tokens][:, combos[:, 0]] - slack[:, None]
            yield sig.ravel(), np.repeat(who[lead], len(combos)), where.ravel()


def batch_signatures(flat, off, df, records: int, group: int):
    """(signature, record, position, guest) in blocks, for sets laid out in a row; df is 0 up to ``group``."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, df, row))
    mixed, df = _mix(flat[order]), df[order]
    own = scheme_of(n)
    for guest, scheme in ((False, own), (True, scheme_of(least_partner(n)))):
        who = np.flatnonzero(scheme != own) if guest else np.flatnonzero(n > 0)
        for short in (True, False):
            some = who[(scheme[who] == 0) == short]
            if len(some):
                parts = _subset_signatures(mixed, off[some], n[some], some) if short else _box_signatures(mixed, df, off[some], n[some], some, scheme[some], records, group)
                for sig, whose, pos in parts:
                    yield sig, whose, pos, np.full(len(sig), guest)


def signatures(sets: DataFrame, sketches: bool = False, held: int | None = None, group: int | None = None) -> DataFrame:
    """``sig``, ``rep``, ``tag``, ``n``, ``pos``, ``guest`` (and the sketch ``s0``, ``s1``), for a join on ``sig``.

    Two guests of a scheme need not be joined there: they meet in their own.
    """
    held, group = HELD if held is None else held, GROUP if group is None else group
    freq = frequent_words(sets, group)
    records = max(sets.count(), 1)
    known = freq.limit(held + 1).collect()
    names = ["sig", "rep", "tag", "n", "pos", "guest"] + ["s0", "s1"] * sketches
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()] + [pa.int64(), pa.int64()] * sketches
    schema = "sig long, rep long, tag int, n int, pos int, guest boolean" + ", s0 long, s1 long" * sketches

    def emit(b, flat, off, df):
        rep, tag, n = np.asarray(b.column("rep")), np.asarray(b.column("tag")), np.diff(off)
        sketch = _sketches(flat, np.repeat(np.arange(len(n)), n), len(n)) if sketches else None
        for sig, who, pos, guest in batch_signatures(flat, off, df, records, group):
            parts = [sig, rep[who], tag[who], n[who], pos, guest] + ([sketch[who, 0], sketch[who, 1]] if sketches else [])
            yield pa.record_batch([pa.array(x, t) for x, t in zip(parts, types)], names=names)

    def unnest(col):
        return np.asarray(col.flatten()), np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))]).astype(np.int64)

    if len(known) <= held:
        order = sorted((r["word"], r["df"]) for r in known)
        word = np.array([w for w, _ in order], np.int64)
        count = np.array([c for _, c in order], np.int64)

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                flat, off = unnest(b.column("w"))
                df = np.zeros(len(flat), np.int64)
                if len(word):
                    k = np.minimum(np.searchsorted(word, flat), len(word) - 1)
                    df = np.where(word[k] == flat, count[k], 0)
                yield from emit(b, flat, off, df)

        return sets.mapInArrow(run, schema)

    # more frequent words than are held: their counts go to the words by a shuffle
    counted = (
        sets.select("rep", "tag", F.explode("w").alias("word"))
        .join(freq, "word", "left")
        .groupBy("rep", "tag")
        .agg(F.collect_list(F.struct("word", F.coalesce("df", F.lit(0)).alias("df"))).alias("x"))  # a set's own words
        .select("rep", "tag", "x.word", "x.df")
    )

    def run_counted(batches):
        for b in batches:
            if b.num_rows:
                flat, off = unnest(b.column("word"))
                yield from emit(b, flat, off, unnest(b.column("df"))[0])

    return counted.mapInArrow(run_counted, schema)


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives whose word sets, compared as strings, reach the similarity."""
    words = classes.select("rep", F.array_remove(F.array_distinct(F.split("key", " +")), "").alias("w"))
    both = (
        pairs.join(words.select(F.col("rep").alias("a"), F.col("w").alias("wa")), "a")
        .join(words.select(F.col("rep").alias("b"), F.col("w").alias("wb")), "b")
        .withColumn("common", F.size(F.array_intersect("wa", "wb")))
    )
    union = F.size("wa") + F.size("wb") - F.col("common")
    return both.where(F.col("common") * DEN >= union * NUM).select("a", "b")
