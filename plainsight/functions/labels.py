"""Mapping of source categories to the fourteen classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainsight.constants import BENIGN

# Cues of the decision list, matched literally on lower-cased text.
SHAME_CUES = ["no thanks", "i don't want", "prefer to pay", "hate saving", "i prefer"]
QUESTION_CUES = ["?", "yes,", "no,", "opt-in", "uncheck", "pre-checked"]
CANCEL_CUES = ["cancel", "membership", "subscription", "renew", "bill", "fee", "hotline"]
FEE_CUES = ["fee", "charge", "tax", "cost", "surcharge", "processing", "booking"]


def map_label(category: Column, text: Column, cues: dict[str, list[str]] | None = None) -> Column:
    """Class of a row from its source category, by cues where a category splits. Unknown and null are benign."""
    c = {"shame": SHAME_CUES, "question": QUESTION_CUES, "cancel": CANCEL_CUES, "fee": FEE_CUES} | (cues or {})
    low = F.lower(F.coalesce(text, F.lit("")))

    def says(kind: str) -> Column:
        hits = [low.contains(x) for x in c[kind]]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    return (
        F.when(category == "Not Dark Pattern", BENIGN)
        .when(category.isin("Urgency", "Scarcity"), "False Urgency")
        .when(category == "Social Proof", "Disguised Advertisement")
        .when((category == "Misdirection") & says("shame"), "Confirm Shaming")
        .when((category == "Misdirection") & says("question"), "Trick Question")
        .when(category == "Misdirection", "Interface Interference")
        .when((category == "Obstruction") & says("cancel"), "Subscription Trap")
        .when(category == "Obstruction", "Interface Interference")
        .when((category == "Sneaking") & says("fee"), "Drip Pricing")
        .when(category == "Sneaking", "Basket Sneaking")
        .when(category == "Forced Action", "Forced Action")
        .otherwise(BENIGN)
    )


def binary_label(category: Column) -> Column:
    return (category != BENIGN).cast("int")
