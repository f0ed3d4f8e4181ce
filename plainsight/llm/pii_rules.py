"""Shapes, validators and cue words of personal information (problem 10): what proposes, what decides, what scores.

A proposal is taken from a score of ``THRESHOLD``. A valid checksum reaches it alone. A failing one rejects the shape
wherever its plan demands the check: always for cards and accounts, and for identity numbers where the text names the
plan. Where the text only says "identity number", no plan is known and the name decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

THRESHOLD = 0.5
#: Characters before a proposal in which cue words count.
BEFORE = 48


def _rx(p: str, flags: int = 0) -> re.Pattern:
    return re.compile(p, flags)


# --- validators ----------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616 check of an account number (country letters first)."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def verhoeff(digits: str) -> bool:
    """Check by the dihedral group of order ten."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    turn = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    c = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch)
        for _ in range(k % 8):
            d = turn[d]
        c = times(c, d)
    return c == 0


def mod11_10(digits: str) -> bool:
    """ISO 7064, hybrid system 11,10."""
    p = 10
    for c in digits[:-1]:
        p = ((p + int(c)) % 10 or 10) * 2 % 11
    return (p + int(digits[-1])) % 10 == 1


def key97(digits: str) -> bool:
    """A number followed by 97 less its remainder by 97."""
    return len(digits) > 2 and 97 - int(digits[:-2]) % 97 == int(digits[-2:])


# Check letters by remainder of 23.
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def letter23(code: str) -> bool:
    number = str("XYZ".find(code[0])) + code[1:-1] if code[0] in "XYZ" else code[:-1]
    return number.isdigit() and _LETTERS[int(number) % 23] == code[-1]


def aadhaar(digits: str) -> bool:
    return digits[0] in "23456789" and verhoeff(digits)


def issued_card(digits: str) -> bool:
    return digits[0] in "3456" and luhn(digits)


def issued_area(digits: str) -> bool:
    """A social security number that may have been issued."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


#: By number of digits: the check of a plan, and the words that name it.
NUMBER_PLANS: dict[int, tuple[Callable[[str], bool], re.Pattern]] = {
    9: (luhn, _rx(r"\b(?:social insurance|sin\b)")),
    11: (mod11_10, _rx(r"\b(?:steuer-?id|steueridentifikationsnummer|idnr)")),
    12: (aadhaar, _rx(r"\b(?:aadhaar|aadhar|uidai)")),
    15: (key97, _rx(r"\b(?:sécurité sociale|nir\b|insee)")),
}
_NIF = _rx(r"\b(?:nif|nie|dni)\b")


# --- e-mail and phone ----------------------------------------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_DOT_WORD = r"\s?[\[({<]\s?dot\s?[\])}>]\s?"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_USER = r"\w(?:[\w%+'-]|\.(?=\w))*"
EMAIL = _rx(rf"(?<![\w.%+'-]){_USER}(?:{_DOT_WORD}[\w+-]+)*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?![\w-])", re.I)
EMAIL_WORDS = _rx(rf"(?<![\w.%+'-]){_USER}(?:\sdot\s[a-z0-9_+-]+)*\s(?:at)\s{_LABEL}(?:\s(?:dot)\s{_LABEL})+(?![\w-])", re.I)
SIGN = _rx(r"@|[\[({<]\s?at\s?[\])}>]")

_END = r"(?![\w-]|[.,]\d)"
#: Shapes of phone numbers by the score they start from; one pass finds them all.
PHONE_SCORE = {"code": 0.7, "area": 0.7, "ten": 0.6, "trunk": 0.5, "pairs": 0.5, "solid": 0.3, "split": 0.2}
PHONE = _rx(
    r"(?=[+(\d])(?<![\w+.-])(?:"
    rf"(?P<code>\+\d{{1,3}}[ .-]?(?:\(0?\d{{1,4}}\)[ .-]?)?\d{{1,5}}(?:[ .-]?\d{{2,6}}){{1,4}}){_END}"
    rf"|(?P<area>\([2-9]\d{{2}}\)[ .-]?\d{{3}}[ .-]\d{{4}}){_END}"
    rf"|(?<!\()(?P<ten>[2-9]\d{{2}}(?P<gap>[ .-])\d{{3}}(?P=gap)\d{{4}}){_END}"
    rf"|(?<!\()(?P<pairs>0[1-9](?:[ .-]\d{{2}}){{4}}){_END}"
    r"|(?<!\()(?P<trunk>0\d{2,4}[ ./-]\d{3,4}[ .-]?\d{3,4})(?![\w-]|[ .,]\d{3})"
    rf"|(?<!\()(?P<solid>0\d{{9,10}}){_END}"
    rf"|(?<!\()(?P<split>[6-9]\d{{4}}[ -]?\d{{5}}){_END})"
)
PHONE_FOR = _rx(r"\b(?:call|tel|telephone|phone|fone|mobile|cell|whatsapp|sms|text me|rang|ring|reach|number is|contact|fax|dial|handy|teléfono|móvil|téléphone|telefon)\b", re.I)
# Least and most digits of a number with its country code, where the plan fixes them.
_PLAN = {"1": (11, 11), "44": (11, 12), "91": (12, 12), "33": (11, 11), "34": (11, 11), "49": (9, 14), "39": (8, 13), "61": (11, 11)}


def planned(number: str) -> tuple[int, bool]:
    """Where a number with country code ends, and whether its plan allows it: digits beyond it belong to the next words."""
    digits = re.sub(r"\D", "", number)
    least, most = next((n for code, n in _PLAN.items() if digits.startswith(code)), (8, 15))
    while sum(c.isdigit() for c in number) > most and (cut := re.search(r"[ .-]+\d+$", number)):
        number = number[: cut.start()]
    return len(number), sum(c.isdigit() for c in number) >= least


#: Ends of sentences; "no." ends none.
SENTENCE = _rx(r"(?<!\bno)[.!?]\s|\n")
NOT_PERSONAL = _rx(r"\b(?:tracking|order|invoice|batch|build|code|inv|lot|ticket|reference|ref|version|parcel no|sku|isbn|serial|model|item|account under)\b[^.!?\n]{0,24}$", re.I)

# --- identity, card and account numbers ----------------------------------------------------------------------------

ID_FOR = _rx(
    r"\b(?:passport|social security|ssn|social insurance|tax (?:number|id|no|code)|taxpayer|tin\b|identity (?:card|number|no|document)|id (?:card|number|no)|identification|national (?:identity|id|insurance)|"
    r"driv(?:ing|er'?s?)(?:['’]s)? licen[cs]e|licen[cs]e (?:no|number)|aadhaar|aadhar|pan\b|voter id|nino|ni number|personalausweis|ausweis|reisepass|führerschein|steuer|"
    r"dni|nif|nie\b|pasaporte|seguridad social|carn[eé] de conducir|passeport|carte d'identité|sécurité sociale|permis de conduire)", re.I,
)
CARD_FOR = _rx(r"\b(?:credit card|debit card|card (?:number|no|ending)|visa|mastercard|amex|kreditkarte|tarjeta|carte bancaire)", re.I)
#: Numbers of digits alone, searched in lower case.
NUMBER = _rx(
    r"(?=\d)(?<![\w/.,+-])(?:(?P<social>\d{3}-\d{2}-\d{4})|(?P<letter>\d{8}-?[a-z])"
    r"|(?P<digits>\d{4}(?P<g>[ -])\d{4}(?P=g)\d{4}(?:(?P=g)\d{4}(?:(?P=g)\d{1,3})?)?|\d{4}[ -]\d{6}[ -]\d{5}|\d{3}(?P<h>[ -])\d{3}(?P=h)\d{3}"
    r"|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d|\d{2} \d{3} \d{3} \d{3}|\d{8,19}))(?![\w-])"
)
#: Numbers that begin with letters, searched in lower case, by the score they start from.
LETTERED = _rx(
    r"(?<![\w-])[a-z](?=[a-z]{0,4}[- ]?\d)(?:(?:(?<=[xyz])(?P<foreigner>\d{7}-?[a-z])|(?P<tax>[a-z]{4}\d{4}[a-z])|(?P<licence>[a-z]-\d{4}-\d{7}|[a-z][- ]?\d{2}[- ]?(?:19|20)\d{9})"
    r"|(?P<driver>[a-z9]{4}\d{6}[a-z0-9]{2}\d[a-z]{2})|(?P<passport>[a-z]?\d{6,8})|(?P<insured>[a-z] ?\d{2} ?\d{2} ?\d{2} ?[a-d]))(?![\w-])"
    r"|(?P<account>[a-z]\d{2}(?: ?[a-z0-9]{4}){2}))"
)
LETTER_SCORE = {"foreigner": 0.1, "tax": 0.6, "licence": 0.6, "driver": 0.3, "passport": 0.2, "insured": 0.5}
# Lengths of account numbers by country.
_LENGTH = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22,
    "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}


def account_at(low: str, start: int) -> tuple[int, bool] | None:
    """Where the account number that begins here ends, and whether its length and check digits are right.

    None where no country has such a number. What lies inside one, right or wrong, is no other number.
    """
    size = _LENGTH.get(low[start : start + 2].upper())
    at, code = start, ""
    while size and at < len(low) and len(code) < size:
        c = low[at]
        if c.isascii() and c.isalnum():
            code += c
        elif c != " " or low[at - 1] == " ":
            break
        at += 1
    if not size or not code[2:4].isdigit():
        return None
    return at, len(code) == size and not low[at : at + 1].isalnum() and mod97(code.upper())


def number_score(shape: str, piece: str, lead: str) -> tuple[float, str]:
    """Score and type of a number of digits; ``lead`` is what stands before it, in lower case."""
    digits = "".join(c for c in piece if c.isdigit())
    named, other = bool(ID_FOR.search(lead)), 0.5 * bool(NOT_PERSONAL.search(lead))
    if shape == "social":
        return (0.6 if issued_area(digits) else 0.3) + 0.5 * named - other, "id_number"
    if shape == "letter":
        return _checked(0.1, letter23(digits + piece[-1].upper()), bool(_NIF.search(lead)), named) - other, "id_number"
    if 13 <= len(digits) <= 19 and (not named or CARD_FOR.search(lead)) and digits[0] in "3456":
        return (0.55 if issued_card(digits) else -1.0) + 0.3 * bool(CARD_FOR.search(lead)) - other, "card_number"
    if len(digits) in NUMBER_PLANS:
        check, plan = NUMBER_PLANS[len(digits)]
        # nine or eleven digits in a row are too common for one check digit
        sure = check(digits) and (len(digits) >= 12 or len(piece) > len(digits))
        return _checked(0.1, sure, bool(plan.search(lead)) and not check(digits), named) - other, "id_number"
    return 0.1 + 0.5 * named - other, "id_number"


def _checked(base: float, valid: bool, demanded: bool, named: bool) -> float:
    return base + (0.5 if valid else -1.0 if demanded else 0.0) + 0.5 * named


def lettered_score(shape: str, piece: str, lead: str) -> float:
    code = "".join(c for c in piece if c.isalnum()).upper()
    named, other = bool(ID_FOR.search(lead)), 0.5 * bool(NOT_PERSONAL.search(lead))
    if shape == "foreigner":
        return _checked(0.1, letter23(code), bool(_NIF.search(lead)), named) - other
    base = LETTER_SCORE[shape]
    if shape == "tax" and code[3] not in "ABCFGHJLPT":  # the fourth letter tells the kind of taxpayer
        base = 0.3
    return base + 0.5 * named - other


# --- street addresses ----------------------------------------------------------------------------------------------

_ROAD = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|boulevard|blvd|terrace|crescent|court|ct|way|place|pl|square|sq|marg|gardens|row|parade|grove|hill|mews|walk|highway|hwy)"
_FIRST = r"\d{1,5}(?: ?[a-z](?![\w'’]))?(?:[/-]\d{1,3}[a-z]?)?"
_LAST = r"\d{1,5}[a-z]?(?:[/-]\d{1,3}[a-z]?)?(?![\w/]|[.,]\d)"
_NAME = r"[^\W\d_][\w'’-]+"
_COUNTED = r"(?!(?:seconds?|minutes?|mins?|hours?|days?|weeks?|months?|years?|times?|people|customers?|clicks?|screens?|members?|items?|percent|am|pm)\b)"
_RUE = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "quai", "impasse")
_CALLE = ("calle", "avenida", "plaza", "paseo", "carrera", "camino", "via", "vía", "viale", "piazza", "corso")
_WEG = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "damm", "ufer")
#: Shapes of street addresses in lower case: pattern, score, and words one of which must occur.
STREET = [
    (_rx(rf"(?=\d)(?<![\w/.,$₹€£-]){_FIRST},?[ \t]+{_COUNTED}(?:{_NAME}[ \t]+){{1,3}}?{_ROAD}\b"), 0.25, ()),
    (_rx(rf"(?=\d)(?<![\w/.,$₹-]){_FIRST},?[ \t]+(?:{'|'.join(_RUE)})[ \t]+(?:(?:de la|de l'|de|du|des|d')\s*)?{_NAME}"), 0.35, _RUE),
    (_rx(rf"(?<![\w])(?:{'|'.join(_CALLE)})[ \t]+(?:(?:de la|de los|de las|del|de|della|dei)[ \t]+)?(?:{_NAME}[ \t]+)?{_NAME},?[ \t]+{_LAST}"), 0.35, _CALLE),
    (_rx(rf"(?<![\w'’-])(?:[^\W\d_][\w'’-]*(?:{'|'.join(map(re.escape, _WEG))})|{_NAME}[ \t](?:straße|strasse|str\.|allee|platz|weg|gasse|ring))[ \t]+{_LAST}"), 0.25, _WEG),
]
STREET_FOR = _rx(
    r"(?:\b(?:liv(?:e|es|ed|ing) (?:at|in)|address|addr|sen[dt] (?:it )?(?:from|to)|ship(?:ped)? (?:it )?(?:from|to)|went to|deliver(?:ed|y)? (?:it )?to|home|moved? to|resid(?:e|es|ing)(?: at)?|old place|house (?:is )?at|door(?: is)? at|"
    r"wohn[et]|adresse|anschrift|vive en|vivo en|dirección|habite|domicili)\b|=|\bat$)", re.I,
)
STREET_NOT = _rx(r"\b(?:top|only|took|after|build|batch|the|first|last|all|no)\s*$", re.I)
#: Lower-case words that may follow an address; any other makes a compound of the street word, as in "road bikes".
_AFTER = frozenset("and or in at to near is was are for on with by from instead where since next opposite off but so because when until before after if not the a an my our your que y en à et und im am bei".split())
_FOLLOWING = _rx(r" ([a-zà-ÿ]+)")


def street_score(base: float, text: str, start: int, end: int, cased: bool) -> float:
    """``cased``: the text distinguishes capitals at all."""
    lead = text[max(0, start - BEFORE) : start]
    words = re.findall(r"[^\W\d_]{2,}", text[start:end])
    # the street word and particles may stand small
    own = [w for w in words if w.lower() not in _RUE and w.lower() not in _CALLE and len(w) > 3] or words
    score = base + (0.3 if own[0][0].isupper() else -0.2) * cased
    score += 0.35 * bool(STREET_FOR.search(lead)) - 0.5 * bool(STREET_NOT.search(lead))
    after = _FOLLOWING.match(text, end)
    return score - 0.4 * bool(after and after[1] not in _AFTER)


# --- names ---------------------------------------------------------------------------------------------------------

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+"
_MIXED = r"[A-ZÀ-ÖØ-Þ](?:['’][A-Z])?[a-zà-öø-ÿ'’]+(?:[A-Z][a-zà-öø-ÿ]+)?"
_UP = r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’]+"
_LOW = r"[a-zà-öø-ÿ][a-zà-öø-ÿ'’]+"
_PARTICLE = r"(?:(?:de la|de|da|di|von|van der|van|del|al|bin|le|la)\s+)?"


def _person(given: str, family: str, initial: str) -> str:
    double = rf"{_PARTICLE}{family}(?:-{family})?"
    return rf"(?:{double},\s+{given}(?:\s+{initial}\.)*|{given}(?:-{given})?(?:\s+{initial}\.)*\s+{double})(?![\w-])"


PERSONS = [_rx(_person(_CAP, _MIXED, "[A-Z]")), _rx(_person(_UP, _UP, "[A-Z]")), _rx(_person(_LOW, _LOW, "[a-z]"))]
TITLE = _rx(r"(?:mr|mrs|ms|miss|dr|prof|herr|frau|señor|señora|sr|sra|mme)\b\.?\s+", re.I)
GAP = _rx(r"[\s\"'“(]{0,3}")
#: Words that lead up to a name, by what they add; the name follows at once.
LEADS = {
    0.6: (
        "my name is", "name is", "name:", "name=", "name :", "i am", "i'm", "this is", "regards,", "regards", "sincerely,", "yours,", "signed,", "signed by", "dear", "contact:", "contact person:", "customer:", "customer",
        "from:", "to:", "attn:", "holder:", "holder=", "cardholder", "sent by", "by phone with", "agent", "patient", "tenant", "passenger", "patient:", "tenant:", "passenger:", "guest:", "agent:", "my husband", "my wife", "my son", "my daughter", "my brother", "my sister", "my mother", "my father", "colleague", "neighbour", "manager", "nurse", "named", "mein name ist", "ich heiße", "je m'appelle",
        "me llamo", "mi nombre es", "mr.", "mrs.", "ms.", "dr.", "prof.", "mr", "mrs", "ms", "miss", "herr", "frau", "señor", "señora", "mme",
    ),
    0.4: ("—", "–"),
    0.35: (
        "spoke to", "spoke with", "talked to", "talked with", "speak to", "speak with", "met with", "ask for", "asked for", "helped by", "handled by", "on behalf of", "left it with", "hier ist", "habe mit",
    ),
    0.3: (
        "wrote to", "reply from", "emailed", "asked", "told", "thanks,", "thank you,", "thanks", "hi", "hello", "belongs to", "belonging to", "last week",
        "yesterday", "today", "this morning", "contact", "contacted", "met", "saw", "son of", "daughter of", "wife of", "husband of", "mit", "avec", "con",
    ),
}
#: What a person does, right after the name.
TAIL = _rx(
    r",?\s+(?:(?:has |had )?(?:never )?(?:said|says|wrote|writes|told|tells|signed|signs|called|calls|answered|replied|replies|asked|asks|e?-?mailed|phoned|agreed|refused|promised|explained|confirmed|complained|reported|closed|opened|left|lives?|works?|moved|paid|met|sent|rang)\b"
    r"|(?:was|is) (?:told|asked|charged|born|married|angry|sorry|upset|rude|helpful|kind|friendly)\b|who\b|whose\b|at the (?:desk|counter|door|reception)|from (?:billing|support|sales|accounts?|reception|customer|the )|and (?:his|her|their)\b|['’]s (?:email|phone|address|number|passport|account|wife|husband|son|daughter)\b)",
    re.I,
)
# Given names that are common in English, German, French, Spanish, Hindi and Arabic.
GIVEN = (
    "aaron adam ahmed aisha alan albert alejandro alex alexander alice amelia amir amit amy ana andrea andrew angela anil anita anna anne anthony antonio arjun arthur asha barbara beatriz benjamin bruno camille "
    "carlos carmen caroline catherine charles charlotte chloe christian christine clara claire claudia daniel david deepak diana diego divya elena elizabeth emily emma eric eva fabian farid fatima felix fernando "
    "florian frank gabriel george grace greta hannah hans hassan heinz helen helga henry ibrahim ines irene isabel jack jacob james jan jane javier jean jennifer jessica joao johann john jonas jorge jose joseph juan julia julian "
    "karen karin karl kavita kevin khalid kiran klaus lakshmi laura leila leon linda louis lucas lucia luis lukas manuel marco maria marie mark markus martin mary matthew maximilian meera michael miguel mohammed monika "
    "nadia neha nicolas nina noah oliver olivia omar oscar pablo patricia paul pedro peter philip pierre pooja priya rachel rahul rajesh ravi rebecca richard robert rosa ruth samuel sandra sanjay sara sarah simon sofia sophie "
    "stefan stephen steven sunita susan tara teresa thomas ursula victor vijay vikram viktor vincent william wolfgang yusuf zara"
).split()
#: Small words that are no part of a name written without capitals.
_NO_NAME = frozenset("a an the not on in at to of for and or is was are be so no yes very here there who that this it with from by as my your his her their our all same still just also now then".split())
#: Words of addressees that are no person.
_NO_PERSON = frozenset("customer customers service support team sir madam sales billing accounts department office company store shop hotel help desk manager friends colleagues all everyone".split())
_ARTICLE = _rx(r"\b(?:the|a|an|this|that|our|der|die|das|le|la|el)\s*$", re.I)


def person_score(text: str, start: int, end: int, lead: float) -> float:
    """What leads up to the name, its shape, what follows and what speaks against it."""
    piece = text[start:end]
    words = re.findall(r"[^\W\d_]+", piece.lower())
    score = lead + 0.3 * bool(TAIL.match(text, end)) + 0.2 * bool(re.search(r"\s\w\.", piece))
    score += 0.35 * any(w in _GIVEN for w in words) - any(w in _NO_PERSON for w in words)
    if piece.islower():
        return score - 0.1 - (any(w in _NO_NAME for w in words))
    return score + 0.15 - 0.4 * bool(_ARTICLE.search(text[max(0, start - 6) : start]) and not lead)


_GIVEN = frozenset(GIVEN)
