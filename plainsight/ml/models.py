"""The screening model: features, selection over group-safe folds, calibration, refit and scoring.

Vocabularies, document frequencies, scales and classifiers come from all training rows. A classifier is one task's
work, so the fits of a grid of folds and costs run beside each other. Scoring covers all rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from plainsight.constants import SIGNALS
from plainsight.functions.text import char_wb_ngrams, word_ngrams, word_tokens, words
from plainsight.ml import linear, primal
from plainsight.operators import scaling, terms
from plainsight.operators.codes import placed_within
from plainsight.session import Scratch, spread

#: Training rows up to which a classifier takes the products of every two of them, of four bytes each; beyond, ``primal`` fits it.
FIT_ROWS = 8_000


@dataclass(frozen=True)
class Recipe:
    """What a model is made of. ``size`` terms of ``text`` beside the scaled ``numbers``."""

    terms: Callable[[Column], Column]
    text: str
    size: int
    numbers: tuple[str, ...] = tuple(SIGNALS)
    c: float = 1.0
    balanced: bool = False
    oversample: bool = True
    #: Sizes of n-grams that the workers cut, of characters inside words or else of words; they are the ``terms``.
    cut: tuple[int, int] = (1, 3)
    inside: bool = False

    @property
    def pieces(self) -> Column:
        """What a worker gets of a text: its words."""
        whole = words(F.col(self.text)) if self.inside else word_tokens(F.col(self.text))
        return F.coalesce(whole, F.array().cast("array<string>"))


CURRENT = Recipe(lambda t: char_wb_ngrams(t, 2, 6), "text", 30_000, cut=(2, 6), inside=True)
# Fixed value: the cost of the older model.
LEGACY = Recipe(lambda t: word_ngrams(t, 1, 3), "clean_text", 300, c=2.124280213720889, balanced=True)
KEYWORDS = Recipe(lambda t: word_ngrams(t, 1, 3), "clean_text", 300, numbers=(), oversample=False)


# --- features ------------------------------------------------------------------------------------------------------


@dataclass
class Fitted:
    """Terms with their place and idf, and the scale of every number."""

    vocabulary: list[tuple[str, int, float]]
    robust: dict[str, tuple[float, float]]
    power: dict[str, tuple[float, float, float]]
    recipe: Recipe

    @property
    def width(self) -> int:
        return len(self.vocabulary) + len(self.recipe.numbers)

    @property
    def plain(self) -> tuple:
        """What workers need of it, without functions."""
        scales = [(*self.robust.get(x, (0.0, 1.0)), *self.power.get(x, (1.0, 0.0, 1.0))) for x in self.recipe.numbers]
        return (*self.recipe.cut, self.recipe.inside), self.vocabulary, scales


def counted(df: DataFrame, recipe: Recipe, row: str = "row_id", also: list[str] | None = None) -> DataFrame:
    """Terms of every row with their counts; ``also`` carries further columns of the row along."""
    return terms.term_counts(df.select(row, *(also or []), recipe.text), row, recipe.terms(F.col(recipe.text)), also)


def cut_terms(low: int, high: int, inside: bool, among: set[str] | None = None, held: int = 50_000) -> Callable[[list[str]], list[str]]:
    """From the words of a text to its terms, as often as they occur. ``among`` keeps terms of these words only."""

    def of_words(pieces: list[str]) -> list[str]:
        runs: list[list[str]] = [pieces]
        if among is not None:
            runs = [[]]
            for w in pieces:
                if w in among:
                    runs[-1].append(w)
                elif runs[-1]:
                    runs.append([])
        return [w if n == 1 else " ".join(run[i : i + n]) for run in runs for n in range(low, high + 1) for i, w in enumerate(run[: len(run) - n + 1])]

    if not inside:
        return of_words
    # what frequent words hold is kept
    known: dict[str, list[str]] = {}

    def of_word(w: str) -> list[str]:
        padded = f" {w} "
        out = [padded[i : i + n] for n in range(low, min(high, len(padded)) + 1) for i in range(len(padded) - n + 1)]
        if len(known) >= held:
            known.clear()
        known[w] = out
        return out

    def of(pieces: list[str]) -> list[str]:
        out: list[str] = []
        for w in pieces:
            out += known.get(w) or of_word(w)
        return out

    return of


#: Terms whose counts a worker holds before it hands them on.
_HELD = 500_000


#: Words that may be named to the workers.
_NAMED = 100_000


def tallied(data: DataFrame, recipe: Recipe, flags: list[str]) -> DataFrame:
    """``term`` with its rows (df) and occurrences (n) among the rows of each flag, from all rows.

    A run of words occurs no more often than each of them. So where single words alone fill the vocabulary, runs are
    counted of words that are as frequent as its last one; what else there is could not be in it.
    """
    low, high = recipe.cut
    if recipe.inside or high == 1:
        return _tally(data, recipe, flags, low, high, None)
    ones = Scratch(data.sparkSession, "words").save(_tally(data, recipe, flags, 1, 1, None), "counts")
    least = [ones.where(F.col(f"df_{f}") >= 2).select(f"n_{f}").orderBy(F.desc(f"n_{f}")).limit(recipe.size).agg(F.count("*"), F.min(f"n_{f}")).first() for f in flags]
    among = None
    if low == 1 and all(k == recipe.size for k, _ in least):
        frequent = ones.where(reduce(lambda a, b: a | b, [F.col(f"n_{f}") >= n for f, (_, n) in zip(flags, least)]))
        found = [r[0] for r in frequent.select("term").limit(_NAMED + 1).collect()]
        among = set(found) if len(found) <= _NAMED else None
    return _tally(data, recipe, flags, low, high, among)


def _tally(data: DataFrame, recipe: Recipe, flags: list[str], low: int, high: int, among: set[str] | None) -> DataFrame:
    """Rows are told apart by their set of flags alone, and counted where they are read: no table of a row's terms is made."""
    inside = recipe.inside
    shared = data.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cut_terms(low, high, inside, shared.value)
        rows: dict[int, Counter] = defaultdict(Counter)
        times: dict[int, Counter] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for bits, df in rows.items():
                n = times[bits]
                yield pa.record_batch([pa.array([bits] * len(df), pa.int64()), pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([n[t] for t in df], pa.int64())], names=["bits", "term", "df", "n"])
            rows.clear(), times.clear()

        for b in batches:
            for k, (bits, pieces) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                found = cut(pieces)
                rows[bits].update(set(found))
                times[bits].update(found)
                if k % 500 == 499 and sum(map(len, rows.values())) > _HELD:
                    yield from handed()
        yield from handed()

    bits = sum((F.when(F.col(f), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(flags)), F.lit(0).cast("long"))
    source = spread(data.select(bits.alias("bits"), recipe.pieces.alias("pieces")).where("bits > 0"))
    tall = source.mapInArrow(run, "bits long, term string, df long, n long")
    among = [(f, F.col("bits").bitwiseAND(F.lit(1 << k)) != 0) for k, f in enumerate(flags)]
    return tall.groupBy("term").agg(*[F.coalesce(F.sum(F.when(on, F.col(x))), F.lit(0)).alias(f"{x}_{f}") for f, on in among for x in ("df", "n")])


def fit_features(data: DataFrame, counts: DataFrame, recipe: Recipe, flags: list[str]) -> list[Fitted]:
    """For each of the ``flags`` (columns that mark training rows in both tables) the features fitted on its rows."""
    by = counts.groupBy("term").agg(*[x for f in flags for x in (F.count_if(f).alias(f"df_{f}"), F.coalesce(F.sum(F.when(F.col(f), F.col("tf"))), F.lit(0)).alias(f"n_{f}"))])
    return features_of(data, by, recipe, flags)


def features_of(data: DataFrame, by: DataFrame, recipe: Recipe, flags: list[str]) -> list[Fitted]:
    """The same from the counts of ``tallied``.

    Smoothed idf over the terms of two rows or more, robust scales, then Yeo-Johnson. All parts share the passes.
    """
    names, scratch = list(recipe.numbers), Scratch(data.sparkSession, "terms")
    by = scratch.save(by, "counts")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    # equal rows of flags and numbers count as one row and how often it occurs
    data = scratch.save(data.groupBy(*flags, *names).agg(F.count("*").alias("_n")), "numbers")
    cells = [F.percentile(F.when(F.col(f), F.col(x)), quarters, F.col("_n")).alias(f"{k}:{x}") for k, f in enumerate(flags) for x in names]
    seen = data.agg(*[F.coalesce(F.sum(F.when(F.col(f), F.col("_n"))), F.lit(0)).alias(f) for f in flags], *cells).first()
    robust = [{x: (q[1], (q[2] - q[0]) or 1.0) for x in names if (q := seen[f"{k}:{x}"]) is not None} for k in range(len(flags))]
    scaled = {f"{k}:{x}": F.when(F.col(f), (F.col(x) - robust[k][x][0]) / robust[k][x][1]) for k, f in enumerate(flags) for x in robust[k]}
    power = scaling.power_parameters(data.select("_n", *[c.alias(n) for n, c in scaled.items()]), [*scaled], count="_n") if scaled else {}
    out = []
    for k, f in enumerate(flags):
        top = by.where(F.col(f"df_{f}") >= 2).orderBy(F.desc(f"n_{f}"), "term").limit(recipe.size)
        known = sorted((r[0], r[1]) for r in top.select("term", f"df_{f}").collect())  # at most ``size`` rows
        vocabulary = [(t, at, float(np.log((1.0 + seen[f]) / (1.0 + df)) + 1.0)) for at, (t, df) in enumerate(known)]
        out.append(Fitted(vocabulary, robust[k], {x: power[f"{k}:{x}"] for x in robust[k] if f"{k}:{x}" in power}, recipe))
    return out


def vectors(df: DataFrame, counts: DataFrame, fitted: list[Fitted], row: str = "row_id") -> DataFrame:
    """``row``, ``part``, ``idx``, ``val`` under each of the fitted features: sublinear counts by idf, of length 1, then the scaled numbers."""
    spark = df.sparkSession
    flat = [(k, *t) for k, f in enumerate(fitted) for t in f.vocabulary]
    table = spark.createDataFrame(pa.table({n: pa.array([t[i] for t in flat], kind) for i, (n, kind) in enumerate((("part", pa.int32()), ("term", pa.string()), ("at", pa.int32()), ("idf", pa.float64())))}))
    cell = F.struct("at", ((F.log("tf") + 1.0) * F.col("idf")).alias("w"))
    # the table is bounded by the recipe's size and the parts
    cells = counts.select(row, "term", "tf").join(F.broadcast(table), "term").groupBy(row, "part").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["w"] * c["w"]))
    cells = cells.withColumn("norm", norm).select(row, "part", F.col("cells.at").alias("at"), F.transform("cells", lambda c: c["w"] / F.col("norm")).alias("w"))
    names = fitted[0].recipe.numbers
    scales = [(k, len(f.vocabulary), [(*f.robust.get(x, (0.0, 1.0)), *f.power.get(x, (1.0, 0.0, 1.0))) for x in names]) for k, f in enumerate(fitted)]
    scales = spark.createDataFrame(scales, "part int, base int, scales array<struct<mid: double, width: double, lam: double, mean: double, dev: double>>")
    rows = df.crossJoin(F.broadcast(scales))  # one row a part
    raw = F.array(*[F.coalesce(F.col(x), F.lit(0)).cast("double") for x in names]) if names else F.array().cast("array<double>")
    numbers = F.zip_with(raw, "scales", lambda x, q: (scaling.yeo_johnson((x - q["mid"]) / q["width"], q["lam"]) - q["mean"]) / q["dev"])
    spots = F.transform("scales", lambda _, i: (F.col("base") + i).cast("int"))
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    return rows.select(row, "part", spots.alias("spots"), numbers.alias("numbers")).join(cells, [row, "part"], "left").select(
        row, "part", F.concat(F.coalesce("at", none[0]), "spots").alias("idx"), F.concat(F.coalesce("w", none[1]), "numbers").alias("val")
    )


def local_vectors(plain: tuple) -> Callable[[list, list], linear.Rows]:
    """The same for a worker's rows, from their pieces and numbers, under ``Fitted.plain``."""
    kind, vocabulary, scales = plain
    among = None if kind[2] else {w for t, _, _ in vocabulary for w in t.split(" ")}
    cut, place = cut_terms(*kind, among, held=0), {t: at for t, at, _ in vocabulary}
    idf, size, more = np.array([x for _, _, x in vocabulary]), len(vocabulary), len(scales)
    # the places of what frequent words hold are kept
    known: dict[str, list[int]] = {}

    def places(pieces: list[str]) -> list[int]:
        out: list[int] = []
        for w in pieces:
            if (found := known.get(w)) is None:
                if len(known) >= 50_000:
                    known.clear()
                found = known[w] = [place[t] for t in cut([w]) if t in place]
            out += found
        return out

    def of(pieces: list, numbers: list) -> linear.Rows:
        n = len(pieces)
        raw = np.array([*map(list, numbers)], float).reshape(n, more)
        moved = np.empty_like(raw)
        for k, (mid, width, lam, mean, dev) in enumerate(scales):
            moved[:, k] = (scaling.yeo_johnson_of((raw[:, k] - mid) / width, lam) - mean) / dev
        found = [places(x) if kind[2] else [place[t] for t in cut(x) if t in place] for x in pieces]
        flat = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        row = np.repeat(np.arange(n), [*map(len, found)])
        cells, times = np.unique(row * max(size, 1) + flat, return_counts=True)
        row, at = np.divmod(cells, max(size, 1))
        w = (np.log(times) + 1.0) * (idf[at] if size else 0.0)
        norm = np.sqrt(np.bincount(row, w * w, n))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + more)])
        idx, val = np.empty(ends[-1], np.int64), np.empty(ends[-1])
        spots = np.arange(len(cells)) + row * more
        idx[spots], val[spots] = at, w / norm[row]
        spots = ends[1:, None] - more + np.arange(more)
        idx[spots], val[spots] = size + np.arange(more), moved
        return linear.Rows(ends, idx, val)

    return of


# --- fits in tasks -------------------------------------------------------------------------------------------------


def _numbers(recipe: Recipe) -> Column:
    return F.array(*[F.coalesce(F.col(x), F.lit(0)).cast("double") for x in recipe.numbers]) if recipe.numbers else F.array().cast("array<double>")


def _code(names: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("pattern_category")) - 1).cast("int")


def _weights(rows: primal.Blocks, y: np.ndarray, classes: int, costs: list[float], recipe: Recipe) -> list[np.ndarray]:
    """Weights for each cost, from all ``rows``; the costs share their products, or else their neighbours."""
    weight = None
    if recipe.balanced:
        weight = len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))
    if len(y) > FIT_ROWS:
        mix, label = primal.oversampled_mix(rows, y, len(recipe.numbers)) if recipe.oversample else (linear.plain(len(y)), y)
        return primal.svm_weights(rows, mix, label, classes, costs, weight)
    whole = rows.whole()
    products = linear.gram(whole)
    mix, label = linear.oversampled_mix(products, y) if recipe.oversample else (linear.plain(len(y)), y)
    return [linear.weights_of(whole, beta, rows.width) for beta in linear.linear_svms(products, mix, label, classes, costs, weight)]


@dataclass
class Part:
    """A fit: the rows it learns from and the rows it scores."""

    train: Column
    test: Column
    costs: tuple[float, ...] = (1.0,)


class Fits:
    """Parts of one table whose features are fitted together, from all training rows of each, in one pass over the texts.

    The classifier of a part takes all its rows in one task, at six bytes a term of each; so are they scored that it holds out.
    """

    def __init__(self, data: DataFrame, parts: list[Part], names: list[str], recipe: Recipe, row: str = "row_id"):
        self.spark, self.parts, self.names, self.recipe, self.row = data.sparkSession, parts, names, recipe, row
        self.scratch, self.kind = Scratch(data.sparkSession, "fits"), data.schema[row].dataType.simpleString()
        flags = {f"_t{k}": F.coalesce(p.train, F.lit(False)) for k, p in enumerate(parts)}
        tests = {f"_e{k}": F.coalesce(p.test, F.lit(False)) for k, p in enumerate(parts)}
        keep = dict.fromkeys([row, "pattern_category", recipe.text, *recipe.numbers])
        data = data.select(*[F.coalesce(F.col(x), F.lit(0)).alias(x) if x in recipe.numbers else x for x in keep], *[c.alias(x) for x, c in (flags | tests).items()])
        data = self.scratch.save(data, "data")
        self.fitted = features_of(data, tallied(data, recipe, [*flags]), recipe, [*flags])
        roles = [F.when(F.col(f"_t{k}") | F.col(f"_e{k}"), F.struct(F.lit(k).alias("part"), F.col(f"_t{k}").alias("train"))) for k in range(len(parts))]
        some = data.withColumn("r", F.array_compact(F.array(*roles))).where(F.size("r") > 0)
        self.rows = self.scratch.save(some.select(row, _code(names).alias("y"), "r", recipe.pieces.alias("pieces"), _numbers(recipe).alias("numbers")), "rows")
        self.scratch.drop("data")
        self.saved = 0

    def margins(self, which: list[int], costs: list[float] | None = None, weights: bool = False) -> DataFrame:
        """``part``, ``c``, ``row``, ``y``, ``margins``: what each part's model says of the rows it has not seen; with ``weights``, ``w`` in a row of its own."""
        row, recipe, classes, spark = self.row, self.recipe, len(self.names), self.spark
        shared = {k: spark.sparkContext.broadcast(self.fitted[k].plain) for k in which}
        widths = {k: self.fitted[k].width for k in which}
        asked = {k: [*map(float, costs or self.parts[k].costs)] for k in which}
        at = F.element_at(F.create_map(*[F.lit(int(x)) for k, p in enumerate(which) for x in (p, k)]), F.col("part"))
        many = self.rows.select(row, "y", F.explode("r").alias("r"), "pieces", "numbers").select(row, "y", "r.*", "pieces", "numbers").where(F.col("part").isin([*which]))
        # one task a fit: a hash of the parts would put some into one task
        many = many.select("part", row, "y", "train", "pieces", "numbers").repartitionById(len(which), at).sortWithinPartitions("part", row)
        names, kind = ["part", "c", row, "y", "margins", "w"], to_arrow_type(many.schema[row].dataType)

        def fitted(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, blocks, y, held = local_vectors(shared[part].value), [], [], []
            for b in batches:
                for lo in range(0, len(b), primal.BLOCK):
                    x = b.slice(lo, primal.BLOCK)
                    rows, train = primal.packed(of(x.column(4).to_pylist(), x.column(5).to_pylist()), widths[part]), x.column(3).to_numpy(zero_copy_only=False).astype(bool)
                    if train.any():
                        blocks.append(rows.take(np.flatnonzero(train)))
                        y.append(x.column(2).to_numpy(zero_copy_only=False)[train].astype(np.int64))
                    if not train.all():
                        held.append((rows.take(np.flatnonzero(~train)), x.select([1, 2]).take(pa.array(np.flatnonzero(~train)))))
            found = _weights(primal.Blocks(blocks, widths[part]), np.concatenate(y), classes, asked[part], recipe) if y else []
            for c, w in zip(asked[part], found):
                for rows, x in held:
                    n = len(rows)
                    yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([c] * n), x.column(0), x.column(1), pa.array([*linear.margins(rows, w)], pa.list_(pa.float64())), pa.nulls(n, pa.binary())], names=names)
                if weights:
                    blank = pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64()))
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([c]), *blank, pa.array([w.astype("<f8").tobytes()], pa.binary())], names=names)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def of_parts() -> Iterator[tuple[int, pa.RecordBatch]]:
                for b in batches:
                    parts = b.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
                    yield from ((int(parts[lo]), b.slice(lo, hi - lo)) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)

            for part, own in groupby(of_parts(), lambda x: x[0]):
                yield from fitted(part, (b for _, b in own))

        out = many.mapInArrow(fit, f"part int, c double, {row} {self.kind}, y int, margins array<double>, w binary")
        self.saved += 1
        out = self.scratch.save(out, f"margins{self.saved}")
        return out if weights else out.drop("w")

    def models(self, wholes: dict[int, list[int]], c: float) -> dict[int, Model]:
        """For each of the parts its model, with sigmoids from the pooled margins of other parts. All fits run beside each other."""
        out = self.margins([*dict.fromkeys([*wholes, *[k for v in wholes.values() for k in v]])], [c], weights=True)
        blobs = {r["part"]: r["w"] for r in out.where(F.col("w").isNotNull() & F.col("part").isin([*wholes])).select("part", "w").collect()}  # a few models
        made = {}
        for k, held in wholes.items():
            scored = out.where(F.col("w").isNull() & F.col("part").isin(held)) if held else None
            sigmoids = calibrated(scored, len(self.names)) if held else []
            f = self.fitted[k]
            made[k] = Model(self.names, f, np.frombuffer(bytes(blobs[k]), "<f8").reshape(f.width + 1, len(self.names)), c, sigmoids)
        self.scratch.drop(f"margins{self.saved}")
        return made


def held_out(data: DataFrame, parts: list[Part], names: list[str], recipe: Recipe, row: str = "row_id") -> DataFrame:
    """``part``, ``c``, ``row``, ``y``, ``margins``: what each part's model says of the rows it has not seen."""
    return Fits(data, parts, names, recipe, row).margins([*range(len(parts))])


def leading(margins: Column) -> Column:
    return (F.array_position(margins, F.array_max(margins)) - 1).cast("int")


def macro_f1(confusion: list[tuple[int, int, int]]) -> float:
    """Of (true, predicted, rows): mean F1 over the union of labels."""
    labels = {x for y, p, _ in confusion for x in (y, p)}
    scores = []
    for v in labels:
        both = sum(n for y, p, n in confusion if y == v == p)
        either = sum(n * ((y == v) + (p == v)) for y, p, n in confusion)
        scores.append(2 * both / either if either else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def class_names(data: DataFrame) -> list[str]:
    return [r[0] for r in data.select("pattern_category").distinct().orderBy("pattern_category").collect()]


GRID = (0.5, 1.0, 2.0)


def fold_parts(fold: str, k: int, also: Column | None = None) -> list[Part]:
    """A part for each of ``k`` folds, held out of the rows of column ``fold`` (of those where ``also`` holds)."""
    also = F.lit(True) if also is None else also
    return [Part(also & (F.col(fold) != f), also & (F.col(fold) == f)) for f in range(k)]


def ranked(fits: Fits, which: list[int], grid: tuple[float, ...] = GRID) -> list[tuple[float, float, float]]:
    """(c, mean, deviation) of macro F1 over the parts, best first: mean descending, then deviation ascending."""
    scored = fits.margins(which, [*grid])
    table: dict[tuple[float, int], list] = {}
    for r in scored.groupBy("c", "part", "y", leading(F.col("margins")).alias("p")).count().collect():  # folds by classes squared
        table.setdefault((r["c"], r["part"]), []).append((r["y"], r["p"], r["count"]))
    fits.scratch.drop(f"margins{fits.saved}")
    out = []
    for c in grid:
        values = [macro_f1(v) for (cost, _), v in table.items() if cost == c]
        out.append((c, float(np.mean(values)), float(np.std(values))))
    return sorted(out, key=lambda x: (-x[1], x[2]))


def _folds(data: DataFrame) -> int:
    return data.agg(F.max("fold")).first()[0] + 1


def selected_cost(data: DataFrame, names: list[str], recipe: Recipe = CURRENT, grid: tuple[float, ...] = GRID) -> list[tuple[float, float, float]]:
    """``ranked`` over the folds of ``data``."""
    k = _folds(data)
    return ranked(Fits(data, fold_parts("fold", k), names, recipe), [*range(k)], grid)


@dataclass
class Model:
    names: list[str]
    fitted: Fitted
    weights: np.ndarray
    cost: float = 1.0
    sigmoids: list[tuple[float, float]] = field(default_factory=list)


def whole_part(on: Column | None = None) -> Part:
    return Part(F.lit(True) if on is None else on, F.lit(False))


def fitted_model(data: DataFrame, names: list[str], c: float, recipe: Recipe = CURRENT, row: str = "row_id") -> Model:
    """A model of all rows of ``data``; where it has folds, sigmoids from the pooled margins of the rows held out of each."""
    k = _folds(data) if "fold" in data.columns else 0
    return Fits(data, [*fold_parts("fold", k), whole_part()], names, recipe, row).models({k: [*range(k)]}, c)[k]


def predicted(df: DataFrame, model: Model, row: str = "row_id") -> DataFrame:
    """``row``, ``margins`` and, of a calibrated model, ``probs`` for every row of ``df``; the model is broadcast (bounded by terms and classes)."""
    recipe = model.fitted.recipe
    shared = df.sparkSession.sparkContext.broadcast((model.fitted.plain, model.weights))
    kind = df.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, weights = shared.value
        of = local_vectors(plain)
        for b in batches:
            m = linear.margins(of(b.column(1).to_pylist(), b.column(2).to_pylist()), weights)
            yield pa.record_batch([b.column(0), pa.array([*m], pa.list_(pa.float64()))], names=[row, "margins"])

    out = spread(df.select(row, recipe.pieces.alias("pieces"), _numbers(recipe).alias("numbers"))).mapInArrow(run, f"{row} {kind}, margins array<double>")
    return probabilities(out, model.sigmoids) if model.sigmoids else out


# --- oversampling on dense vectors ---------------------------------------------------------------------------------


def neighbours(df: DataFrame, row: str, vector: str, label: str, k: int = 5, block: int = 512) -> DataFrame:
    """``row``, ``neighbour``, ``place``: the k nearest rows of the same class (exact, Euclidean, ties by id).

    Rows meet in blocks: each class is cut into blocks of about ``block`` rows by hash, every pair of blocks is
    one task's product of two small matrices and keeps k per row at once; the partial lists then merge. A class
    of any size is spread over its pairs of blocks.
    """
    base = df.select(F.col(row).alias("r"), F.col(label).alias("y"), F.col(vector).cast("array<double>").alias("x"))
    sizes = base.groupBy("y").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = base.join(sizes, "y").withColumn("b", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"))
    left = cut.select("y", F.col("b").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), "r", "x")
    other = cut.select(*[F.col(c).alias(c) for c in cut.columns])
    right = other.select(F.col("y").alias("y2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p2"), F.col("b").alias("q2"), F.col("r").alias("r2"), F.col("x").alias("x2"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"r": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})
        x, y = np.stack(a["x"]), np.stack(b["x"])
        ids = b["r"].to_numpy()
        d = ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1) if x.size * len(y) < 5e7 else np.stack([((y - v) ** 2).sum(1) for v in x])
        d[a["r"].to_numpy()[:, None] == ids[None, :]] = np.inf
        out = []
        for i, r in enumerate(a["r"]):
            best = np.lexsort((ids, d[i]))[:k]
            out += [(r, ids[j], d[i][j]) for j in best if np.isfinite(d[i][j])]
        return pd.DataFrame(out, columns=["r", "neighbour", "d"])

    partial = left.groupBy("y", "p", "q").cogroup(right.groupBy("y2", "p2", "q2")).applyInPandas(
        lambda a, b: nearest(a, b.rename(columns={"r2": "r", "x2": "x"})), "r long, neighbour long, d double"
    )
    place = F.row_number().over(Window.partitionBy("r").orderBy("d", "neighbour"))
    return partial.withColumn("place", place).where(F.col("place") <= k).select(F.col("r").alias(row), "neighbour", "place")


def oversampled(df: DataFrame, row: str, vector: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Every class raised to the largest one: new vectors between a row and one of its k class neighbours.

    ``vector`` is an array of doubles. Classes of one row are copied. New rows have a null ``row``; ``base`` and
    ``other`` are the two rows a vector lies between, and ``u`` its place between them.
    """
    base = df.select(row, label, F.col(vector).cast("array<double>").alias(vector))
    sizes = base.groupBy(label).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    need = sizes.select(label, "n", (F.lit(most) - F.col("n")).alias("need")).where("need > 0")
    minority = base.join(need, label)
    order = F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(1 << 32))
    placed = placed_within(minority, label, order, row, "_at", "_size")
    times = F.floor(F.col("need") / F.col("n")) + (F.col("_at") <= F.col("need") % F.col("n")).cast("int")
    drawn = placed.withColumn("_times", times.cast("int")).where("_times > 0")
    drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    pick = (F.pmod(F.xxhash64(row, "_copy", F.lit(seed)), F.lit(k)) + 1).cast("int")
    near = neighbours(minority, row, vector, label, k).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("place", "neighbour"))).alias("near"))
    paired = drawn.join(near, row, "left").withColumn("other", F.coalesce(F.try_element_at("near", F.least(pick, F.coalesce(F.size("near"), F.lit(1)))), F.col(row)))
    other = base.select(F.col(row).alias("other"), F.col(vector).alias("_v"))
    u = F.pmod(F.xxhash64(row, "_copy", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    mixed = F.zip_with(vector, "_v", lambda a, b: a + F.col("u") * (b - a))
    kind = df.schema[row].dataType
    made = paired.join(other, "other").withColumn("u", u).select(F.lit(None).cast(kind).alias(row), label, mixed.alias(vector), F.col(row).alias("base"), "other", "u")
    null = F.lit(None).cast(kind)
    return base.select(row, label, vector, null.alias("base"), null.alias("other"), F.lit(None).cast("double").alias("u")).unionByName(made)


# --- calibration ---------------------------------------------------------------------------------------------------


def calibrated(scored: DataFrame, classes: int, label: str = "y", raw: str = "margins", rounds: int = 15) -> list[tuple[float, float]]:
    """Sigmoid (slope, intercept) per class from held-out margins, by Newton steps over smoothed targets.

    One aggregate a round serves all classes, so the rows are read ``rounds`` times however many classes there are.
    """
    spark = scored.sparkSession
    each = scored.select(F.posexplode(F.col(raw)).alias("c", "m"), F.col(label).cast("int").alias("y"))
    hit = (F.col("y") == F.col("c")).cast("int").alias("hit")
    margins = Scratch(spark, "margins").save(each.select("c", "m", hit), "margins")
    hits = {r["c"]: (r["k"], r["n"]) for r in margins.groupBy("c").agg(F.sum("hit").alias("k"), F.count("*").alias("n")).collect()}
    fit = {c: (1.0, 0.0) for c in range(classes)}
    p = 1.0 / (1.0 + F.exp(-(F.col("m") * F.col("slope") + F.col("intercept"))))
    target = F.when(F.col("hit") == 1, F.col("yes")).otherwise(F.col("no"))
    w, e = p * (1.0 - p), target - p
    for _ in range(rounds if hits else 0):
        # the parameters come as rows, so every round runs the same compiled plan
        now = [(c, *fit[c], (k + 1) / (k + 2), 1 / (n - k + 2)) for c, (k, n) in hits.items()]
        table = spark.createDataFrame(now, "c int, slope double, intercept double, yes double, no double")
        sums = margins.join(F.broadcast(table), "c").groupBy("c").agg(*[F.sum(x) for x in (e * F.col("m"), e, w * F.col("m") * F.col("m"), w * F.col("m"), w)])
        for c, ga, gb, haa, hab, hbb in sums.collect():
            haa, hbb = haa + 1e-6, hbb + 1e-6
            det = haa * hbb - hab * hab
            step_a, step_b = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            longest = max(abs(step_a), abs(step_b), 5.0) / 5.0
            fit[c] = (fit[c][0] + step_a / longest, fit[c][1] + step_b / longest)
    return [fit[c] for c in range(classes)]


def probabilities(scored: DataFrame, sigmoids: list[tuple[float, float]], raw: str = "margins") -> DataFrame:
    """Adds ``probs``: sigmoids of the margins, scaled to sum 1; uniform where all vanish."""
    m = F.col(raw)
    each = F.array(*[1.0 / (1.0 + F.exp(-(m[c] * a + b))) for c, (a, b) in enumerate(sigmoids)])
    total = F.aggregate(each, F.lit(0.0), lambda x, y: x + y)
    k = len(sigmoids)
    return scored.withColumn("probs", F.when(total > 0, F.transform(each, lambda p: p / total)).otherwise(F.array(*[F.lit(1.0 / k)] * k)))


# --- probes --------------------------------------------------------------------------------------------------------


def _scored_rows(out: DataFrame) -> float:
    """Macro F1 of predictions whose rows stand for ``n`` each."""
    return macro_f1([tuple(r) for r in out.groupBy("y", "prediction").agg(F.sum("n")).collect()])  # classes squared


def probe(data: DataFrame, name: str, columns: list[str]) -> tuple[str, float]:
    """Macro F1 of a class-balanced logistic model on few columns; ``data`` has pattern_category and side."""
    return _probed(data.groupBy("pattern_category", "side", *columns).agg(F.count("*").alias("n")), name, columns)


def _probed(groups: DataFrame, name: str, columns: list[str]) -> tuple[str, float]:
    """The same of groups of equal rows, which count ``n`` times: the loss sums over them what it sums over the rows."""
    groups = Scratch(groups.sparkSession, "probe").save(groups, name)
    train = groups.where("side = 'train'")
    by = train.where("pattern_category is not null").groupBy("pattern_category").agg(F.sum("n").alias("_rows"))
    total = by.agg(F.sum("_rows").alias("_total"), F.count("*").alias("_k"))
    weights = by.crossJoin(total).select("pattern_category", (F.col("_total") / (F.col("_k") * F.col("_rows"))).alias("_each"))  # one row on the right
    weighted = train.join(weights, "pattern_category").withColumn("weight", F.col("_each") * F.col("n"))
    stages = [
        StringIndexer(inputCol="pattern_category", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=columns, outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=100),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    return name, _scored_rows(model.transform(groups.where("side = 'test'").withColumn("weight", F.lit(1.0))))


def grouped_vectors(data: DataFrame, flags: list[str], recipe: Recipe, scratch: Scratch) -> list[DataFrame]:
    """For each of the flags ``pattern_category``, ``train``, ``x`` and ``n``: rows of equal class, side and features as one, and their number.

    The features are fitted on the flagged rows, for all flags in one pass; ``x`` is sparse.
    """
    data = scratch.save(data.select("pattern_category", *flags, recipe.text, *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in recipe.numbers]), "rows")
    fitted = features_of(data, tallied(data, recipe, flags), recipe, flags)
    kind, out = "pattern_category string, train boolean, idx array<int>, val array<double>", []
    for f, flag in zip(fitted, flags):
        shared = data.sparkSession.sparkContext.broadcast(f.plain)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = local_vectors(shared.value)
            for b in batches:
                rows = of(b.column(2).to_pylist(), b.column(3).to_pylist())
                cells = [pa.ListArray.from_arrays(pa.array(rows.at, pa.int32()), pa.array(x, t)) for x, t in ((rows.idx, pa.int32()), (rows.val, pa.float64()))]
                yield pa.record_batch([b.column(0), b.column(1), *cells], names=["pattern_category", "train", "idx", "val"])

        rows = spread(data.select("pattern_category", F.coalesce(F.col(flag), F.lit(False)).alias("train"), recipe.pieces.alias("pieces"), _numbers(recipe).alias("numbers"))).mapInArrow(run, kind)
        groups = scratch.save(rows.groupBy("pattern_category", "train", "idx", "val").agg(F.count("*").alias("n")), f"groups_{flag}")
        width = max(f.width, 1)
        vector = F.udf(lambda idx, val, width=width: SparseVector(width, idx, val), VectorUDT())
        out.append(groups.select("pattern_category", "train", vector("idx", "val").alias("x"), "n"))
    return out


def keyword_probe(data: DataFrame, recipe: Recipe = KEYWORDS) -> tuple[str, float]:
    """The same on TF-IDF of the words alone, fitted on the training side."""
    data = data.withColumn("_train", F.col("side") == "train")
    (groups,) = grouped_vectors(data, ["_train"], recipe, Scratch(data.sparkSession, "keywords"))
    side = F.when(F.col("train"), "train").otherwise("test")
    return _probed(groups.select("pattern_category", side.alias("side"), F.col("x").alias("words"), "n"), "keyword_only", ["words"])


#: Parts in which a tree draws rows that are equal.
COPIES = 32


def tree_baseline(data: DataFrame, sides: list[str], recipe: Recipe = LEGACY, trees: int = 105, depth: int = 9) -> list[float]:
    """For each of the columns ``sides`` macro F1 on its test rows of a forest over the older features, fitted on all its training rows.

    A forest of as many trees as deep stands for boosted trees, which Spark has for two classes only. A tree draws equal
    rows one by one; more than ``COPIES`` of them it draws in so many parts of equal weight.
    """
    scratch, names = Scratch(data.sparkSession, "trees"), class_names(data)
    data = data.withColumns({f"_train_{x}": F.col(x) == "train" for x in sides})
    out = []
    for k, groups in enumerate(grouped_vectors(data, [f"_train_{x}" for x in sides], recipe, scratch)):
        groups = scratch.save(groups.withColumn("y", _code(names).cast("double")), f"coded{k}")
        drawn = groups.where("train").withColumn("_copies", F.least("n", F.lit(COPIES))).withColumn("weight", F.col("n") / F.col("_copies"))
        drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("x", "y", "weight")
        forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=42)
        out.append(_scored_rows(forest.fit(spread(drawn)).transform(groups.where("not train"))))
    return out


# --- files ---------------------------------------------------------------------------------------------------------


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Vocabulary, scales, weights and sigmoids as one parquet row; the recipe stays in code."""
    f = model.fitted
    row = (model.names, f.vocabulary, [(k, *v) for k, v in f.robust.items()], [(k, *v) for k, v in f.power.items()], bytearray(model.weights.astype("<f8").tobytes()), model.cost, model.sigmoids)
    schema = (
        "names array<string>, vocabulary array<struct<term: string, at: int, idf: double>>, robust array<struct<name: string, mid: double, width: double>>, "
        "power array<struct<name: string, lam: double, mean: double, dev: double>>, weights binary, cost double, sigmoids array<struct<slope: double, intercept: double>>"
    )
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, recipe: Recipe = CURRENT) -> Model:
    r = spark.read.parquet(path).first()
    fitted = Fitted([tuple(x) for x in r["vocabulary"]], {x[0]: (x[1], x[2]) for x in r["robust"]}, {x[0]: tuple(x[1:]) for x in r["power"]}, recipe)
    return Model(list(r["names"]), fitted, np.frombuffer(bytes(r["weights"]), "<f8").reshape(fitted.width + 1, len(r["names"])), r["cost"], [tuple(x) for x in r["sigmoids"]])
