"""Results depend on them character by character, so they are stated as plain text."""

from __future__ import annotations

# The fourteen classes in code order.
CLASSES = [
    "Bait and Switch", "Basket Sneaking", "Confirm Shaming", "Disguised Advertisement", "Drip Pricing",
    "False Urgency", "Forced Action", "Interface Interference", "Nagging", "Not a Dark Pattern",
    "Rogue Malware", "SaaS Billing", "Subscription Trap", "Trick Question",
]
BENIGN = "Not a Dark Pattern"

# The twelve signals in contract order.
SIGNALS = [
    "urgency_kw_count", "scarcity_kw_count", "shame_phrase_flag", "cancel_diff_score", "social_proof_flag",
    "price_drip_flag", "discount_claim_flag", "neg_option_flag", "exclamation_count", "question_count",
    "number_present", "time_reference_flag",
]

# Regular expressions of the signals, matched on lower-cased text.
URGENCY = [
    "hurry", "limited time", "ends in", "only.*hours", "today only", "flash sale", "act now", "last chance",
    "don't miss", "expires", "clock is ticking", "ending soon", "deal ends", "final hours", "sale ends",
    "countdown", "before it'?s gone",
]
SCARCITY = [
    r"only \d+ left", "low stock", "selling fast", "almost gone", "high demand", r"\d+ remaining",
    "last remaining", "few left", "running out", "limited stock", r"\d+ in stock", "nearly sold out",
]
SHAME = [
    "no thanks.*don't want", "i don't need", "no.*i prefer.*paying", "no.*i hate", "no thanks", "prefer to pay",
    "hate saving", "dont want", "i'?ll pay full", "i don'?t like saving", "no, i'?m fine paying",
]
CANCEL = [
    "to cancel.*call", "email.*unsubscribe", "to stop.*write", "cancel.*call.*1-800", "registered mail", "hotline",
    "loyalty department", "chat with our live agent", "cancellation fee", "call.*to cancel", "business hours",
    "retention team",
]
SOCIAL = [
    "people.*viewing", "people.*bought", "added.*cart.*recently", "watching this", "others.*looking", "purchased a",
    r"\d+ people", "customers? are", "booked in the last", "sold in the last",
]
DRIP = [
    "processing fee", "service charge", "convenience fee", "booking fee", "taxes.*not included", "resort fee",
    "cleaning fee", "handling cost", "admin surcharge", "handling fee", "added at checkout", "surcharge",
    "not included in", "extra fee",
]
DISCOUNT = [r"\d+% off", "save ₹", r"save \$", "was.*now", "you save", "coupon", "discount", "deal", "offer"]
NEG_OPTION = [
    "pre-ticked", "opted in", "already selected", "auto-renew", "pre-selected", "checked by default", "pre-checked",
    "automatically renew", "auto-debit", "uncheck", "leave.*box.*unchecked",
]
TIME_WORDS = "hour|minute|day|tonight|today|soon|week|month|year"

# Slot terms that a skeleton masks.
SLOT_TERMS = [
    "Tata CLiQ", "Flipkart", "Meesho", "IndiaMART", "Snapdeal", "AJIO", "Amazon Prime Video", "Fitbit",
    "Google Drive", "Hostinger", "Reliance Smart Bazaar", "Amazon", "Myntra", "Croma", "MakeMyTrip", "BigBasket",
    "JioGames", "Paytm Money",
    "sneakers", "headphones", "smartwatch", "backpack", "jacket", "blender", "office chair", "yoga mat",
    "coffee maker", "desk lamp", "phone case", "sunglasses", "water bottle", "bluetooth speaker", "air fryer",
    "wallet",
    "service charge", "processing fee", "convenience fee", "admin surcharge", "handling fee", "cleanup cost",
    "booking charge", "platform fee", "payment gateway fee", "fulfilment fee", "packaging fee",
    "Protect Promise Fee", "Offer Handling Fee", "Payment Handling Fee", "small cart charge", "handling charge",
    "delivery charge", "pick up charge", "surge fee", "rain fee", "high demand fee",
    "7 days", "15 days", "1 month", "3 months", "6 months", "1 year",
    "Quick Heal", "K7 Total Security", "TallyPrime", "Busy Accounting", "Zoho Books", "Microsoft 365",
    "GST Invoice", "Bank Statement", "Aadhaar Copy", "PAN Card Copy", "Insurance Policy", "Salary Slip",
    "shipping protection", "priority handling", "extended warranty", "loss protection", "theft insurance",
    "carbon offset", "gift wrapping", "express processing", "damage cover", "installation support",
    "E-commerce", "Fintech", "Travel", "Food Delivery", "Streaming", "Telecom", "Healthcare", "Education",
]

# Skeleton patterns, in the order of their application.
CURRENCY = r"[₹$]\s?\d[\d,]*(?:\.\d+)?"
PERCENT = r"\d+\s?%"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
