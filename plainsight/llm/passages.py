"""Evaluation passages inside training text (problem 9), by one Aho-Corasick automaton.

Any ``window`` consecutive words of an item contain one of its aligned chunks of half as many words, so the automaton
holds the chunks: ten times fewer and half as long as the windows. Each text is scanned once; around a chunk, the
windows that contain it are looked up whole. Offsets of the words are mapped back to the text as it stands.

The items are a stated query set. They travel as broadcasts of at most ``HELD`` words, read from the items one block
after the other, so neither the driver nor a worker holds more than a block; a Python worker builds its automaton
once. Items beyond one block (some seven thousand of sixty words) take a further scan for each.

Defined cases: null and empty texts and items hold nothing; items of fewer words than a window are never
found; items listed under several ids are reported under each; null ids of items are ignored, a repeated
document is reported as often as it comes in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.forms import _WORD, default_folder, fold, words
from plainsight.session import spread

WINDOW = 10
#: Words of the items of one automaton.
HELD = 400_000


class Matcher:
    """The automaton of the chunks of some items, and the items of each of their windows."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window, self.chunk = window, (window + 1) // 2
        windows: dict[str, set[int]] = {}
        self.chunks = ahocorasick.Automaton()
        for i, text in items:
            w = words(fold(text))
            for k in range(len(w) - window + 1):
                windows.setdefault(" ".join(w[k : k + window]), set()).add(i)
            for k in range(0, len(w) - self.chunk + 1 if len(w) >= window else 0, self.chunk):
                line = f" {' '.join(w[k : k + self.chunk])} "
                self.chunks.add_word(line, len(line))
        self.windows = {k: tuple(sorted(v)) for k, v in windows.items()}
        if windows:
            self.chunks.make_automaton()

    def runs(self, found: list[str]) -> dict[int, list[list[int]]]:
        """Item to its maximal runs of overlapping or adjacent windows, as ranges of the text's words."""
        out: dict[int, list[list[int]]] = {}
        if len(found) < self.window or not self.windows:
            return out
        hits = [last + 1 - n for last, n in self.chunks.iter(f" {' '.join(found)} ")]
        if not hits:
            return out
        place, at = {}, 0
        for k, w in enumerate(found):
            place[at] = k
            at += len(w) + 1
        done = -1
        for h in hits:  # in order of their ends, so of their starts: chunks have equally many words
            k = place[h]
            for s in range(max(done + 1, k + self.chunk - self.window, 0), min(k, len(found) - self.window) + 1):
                done = s
                for i in self.windows.get(" ".join(found[s : s + self.window]), ()):
                    mine = out.setdefault(i, [])
                    if mine and s <= mine[-1][1]:
                        mine[-1][1] = s + self.window
                    else:
                        mine.append([s, s + self.window])
        return out


#: The matcher of this Python worker, by the block it was built from.
_built: dict[str, Matcher] = {}


def _matcher(block: str, shared: Broadcast, window: int) -> Matcher:
    if block not in _built:
        _built.clear()
        _built[block] = Matcher(shared.value, window)
    return _built[block]


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    spark, block, held = items.sparkSession, [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if block and held >= HELD:
            yield spark.sparkContext.broadcast(block)
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += r["text"].count(" ") + 1
    yield spark.sparkContext.broadcast(block)


def _word_offsets(text: str) -> list[tuple[int, int]]:
    """Where each word of the consistent form stands in the text; lower() may lengthen a letter."""
    form, back = default_folder().aligned(text)
    low, at = [], []
    for c, o in zip(form, back):
        x = c.lower()
        low.append(x)
        at += [o] * len(x)
    at.append(len(text))
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(low))]


def _scan(docs: DataFrame, shared: Broadcast, window: int, offsets: bool) -> DataFrame:
    block = uuid.uuid4().hex
    names, types = ["doc_id", "item_id"], [pa.int64(), pa.int64()]
    if offsets:
        names, types = [*names, "first_char", "end_char"], [*types, pa.int32(), pa.int32()]

    def run(batches):
        matcher, folder = _matcher(block, shared, window), default_folder()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and (runs := matcher.runs(_WORD.findall(folder(text).lower()))):
                    if offsets:
                        spots = _word_offsets(text)
                        out += ((doc, i, spots[s][0], spots[e - 1][1]) for i, mine in runs.items() for s, e in mine)
                    else:
                        out += ((doc, i) for i in runs)
            columns = zip(*out) if out else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'int'}" for n, t in zip(names, types)))


def contained_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, offsets: bool = True) -> DataFrame:
    """``doc_id``, ``item_id`` and a range of characters of the document: one row for each maximal run of windows.

    Without ``offsets`` one row for each item that a document holds.
    """
    rows = spread(docs.select("doc_id", "text"))
    return reduce(DataFrame.unionByName, [_scan(rows, block, window, offsets) for block in _blocks(items)])


def leak_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained_items(docs, items, offsets=False)


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold it."""
    hits = leak_pairs(docs, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    return items.select("item_id", "source").join(hits, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
