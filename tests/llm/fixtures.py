"""Small tables with nulls, blanks, ties, repeated rows, long texts and guises; brute-force answers."""

import collections
import itertools
import random

from plainsight.llm.forms import copy_keys, fold, words
from plainsight.llm.skeletons import template

SCHEMA = "row_id long, page_id string, text string, source string, rep long, key string, k string, form string"


def texts(rng):
    names = ["Kalo", "Miru", "Tesan", "Vodi", "Pelu", "Rando", "Jistu", "Gemo", "Fulan", "Zobi"]
    kinds = [
        "Only {n} left of the {a} {b} by {c}",
        "Hurry {a} {b}, the sale of {c} ends in {n} hours at {d}",
        "Colour: {a} {b}; Plan: {c}; Size: {d} {n}",
        "{a} {b} was added to your cart by {c} for ${n}",
    ]
    return rng.choice(kinds).format(n=rng.randrange(9), **dict(zip("abcd", rng.sample(names, 4))))


def guise(rng, t):
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t)
    return rng.choice(
        [
            t, t.upper(), t + "!", t.replace(" ", "  "), t.replace(" ", " "), t.replace("a", "а"), wide, t.replace("o", "o​"),
            "; ".join(reversed(t.split("; "))), t.replace("; ", " | "), " ".join(reversed(t.split(" "))), t + " today", t.replace("e", "é"), t.replace("e", "é"),
        ]
    )


def features(seed=3, n=160):
    rng = random.Random(seed)
    base = [texts(rng) for _ in range(30)]
    rows = []
    for i in range(n):
        t = guise(rng, rng.choice(base)) if rng.random() < 0.8 else texts(rng)
        page = rng.choice(["hot"] * 3 + [f"p{rng.randrange(60)}", None, " ", "0012", "12"])
        rows.append((i * 7 % 997, page, t, rng.choice(["x", "y", None])))
    rows += [(5001, "hot", None, "x"), (5002, None, "", None), (5003, None, " \t​", "x"), (5004, "p1", "!!!", "y"), (5005, None, "???", None)]
    rows += [(5006, None, "long word " * 20000, "x"), (5007, None, "Long, word " * 20000, "x"), (None, "p2", base[0], "x")]
    rows += [(5008, None, "A lone text", "x"), (5009, "a lone text", "other words", "x"), (5010, "a lone text", "further words", "x"), (5011, "row 5003", "!", "x")]
    rows += [(5020, None, "Colour: Kalo Miru\nPlan: Tesan, Colour Vodi", "x"), (5021, None, "Colour: Kalo Miru Plan: Tesan, Colour Vodi", "y"), (5022, None, "Plan: Tesan Colour Vodi; Colour: Kalo Miru", None)]
    rows += [(5023, None, "plan tesan colour: vodi | colour: kalo miru", "x"), (5024, None, "Plan: A; A note", "x"), (5025, None, "A note; Plan: A", "x"), (5026, None, "no", "x"), (5027, None, "no no", "x")]
    rows.append(rows[0])
    return [(*r, 1, "clash", "clash", "clash") for r in rows]


def plan(rows, seed=5):
    rng = random.Random(seed)
    out = [(r[0], rng.choice(["train"] * 3 + ["validation", "test"])) for r in {r[0]: r for r in rows if r[0] is not None}.values() if rng.random() < 0.9]
    out = [x for x in out if x[0] not in (5008, 5009, 5010)] + [(5008, "test"), (5009, "train"), (5010, "train")]
    return out + out[:5] + [(None, "train"), (999_999, "test"), (4, None)]


def live(rows):
    """Distinct rows that are a case of problems 2 to 5: id to form."""
    return {r[0]: fold(r[2]) for r in rows if r[0] is not None and r[2] is not None and fold(r[2]).strip()}


def copies(rows):
    """Least row to all rows of its class: united by the words in order and by the set of labelled fields."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, f in live(rows).items():
        for k in enumerate(copy_keys(f)):
            if k[1] is not None:
                parent[find(i)] = find(k)
    by = collections.defaultdict(list)
    for i in live(rows):
        by[find(i)].append(i)
    return {min(v): v for v in by.values()}


def near(rows):
    forms = live(rows)
    sets = {i: set(words(f)) for i, f in forms.items()}
    keys = {i: k for k, v in copies(rows).items() for i in v}
    return {
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if keys[a] != keys[b] and sets[a] | sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])
    }


def groups(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        if r[0] is None:
            continue
        find(r[0])
        if r[1] is not None and r[1].strip():
            parent[find(r[0])] = find("p" + r[1])
        if r[2] is not None and fold(r[2]).strip():
            parent[find(r[0])] = find("t" + template(fold(r[2])))
    out = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None:
            out[find(r[0])].add(r[0])
    return list(out.values())
