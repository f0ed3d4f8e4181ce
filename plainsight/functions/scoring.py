"""Scores of a model as columns: probabilities, leading class, abstention, active signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainsight.constants import BENIGN, SIGNALS

# Display names of the signals, and of the one class shown under another name.
SIGNAL_NAMES = dict(zip(SIGNALS, [
    "urgency words", "scarcity words", "confirm-shaming wording", "cancellation friction", "social-proof wording",
    "late-fee wording", "discount claim", "negative-option wording", "exclamation marks", "question marks",
    "number present", "time reference",
]))
DISPLAY = {"Trick Question": "Trick Wording (model label: Trick Question)"}
NO_SIGNALS = "none of the 12 listed signals"


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Zero-based; of equal maxima the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_classes(scores: Column, names: list[str], k: int = 5) -> Column:
    """Names of the ``k`` best scores, best first, ties by place."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.element_at(F.array(*[F.lit(n) for n in names]), p["i"] + 1))


def classical_status(label: Column) -> Column:
    """Of a model that never abstains."""
    return F.when(label == BENIGN, "no textual signal").otherwise("potential")


def signal_json() -> Column:
    """The signals of a row as one JSON object, in contract order."""
    return F.to_json(F.struct(*SIGNALS))


def status(label: Column, score: Column, threshold: float = 0.5) -> Column:
    return F.when(score < threshold, "inconclusive").when(label == BENIGN, "no_signal").otherwise("signal")


def display_label(label: Column) -> Column:
    shown = label
    for name, other in DISPLAY.items():
        shown = F.when(label == name, other).otherwise(shown)
    return shown


def active_signals() -> Column:
    """The non-zero signals of a row with their values, in contract order."""
    parts = [
        F.when(F.col(s) != 0, F.concat(F.lit(f"{SIGNAL_NAMES[s]} ("), F.col(s).cast("string"), F.lit(")"))) for s in SIGNALS
    ]
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", NO_SIGNALS).otherwise(text)


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)
