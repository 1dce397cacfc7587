"""Private data replaced by surrogates of the same kind.

Detected entities: e-mail and IP addresses (both versions), phone, card and account numbers (IBAN),
national ids, secrets in hexadecimal and keys of well-known forms, and names after a form of
address. Every distinct entity of the corpus gets one surrogate, made from a keyed hash, so that
mentions of one entity stay mentions of one (coreference). A surrogate has its entity's type,
format (digits stay digits, letters keep case and script, punctuation stays; country codes, card
brands, check digits and private networks stay what they are) and, for names, the gender of the
form of address. A surrogate that two entities drew, or that is itself an entity of the corpus, is
drawn again, until all differ (distinctness); draws get longer after some attempts, so that a free
one always exists.

The key is the caller's. Whoever has it can recompute surrogates; without one in the session's
configuration (``KEY_SETTING``) a session draws its own and forgets it.

A name is replaced word by word. The last word is the family name, one entity in all spellings and
under all titles; given names before it take the gender that the document tells, and an initial
becomes that of the given name's surrogate. In a document, a name's words are found without a
title too.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, byte_texts, written
from .decontamination import with_texts

KEY_SETTING = "spark.ledgerloom.surrogateKey"
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 "
    "65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: The check letter of a Spanish id by its number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Forms of keys whose beginning tells what they are for.
TOKENS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}"
    r"|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|sk-[0-9A-Za-z_-]{20,}|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}")
#: What of a key stays: the beginning that tells its kind.
TOKEN_HEAD = re.compile(
    r"AKIA|ASIA|gh[opsur]_|github_pat_|xox[abprs]-|AIza|[sr]k_(?:live|test)_|sk-|eyJ")
#: Forms of address by gender (n: not told).
TITLES = {
    "m": "Mr|Sir|Herr|Monsieur|Señor|Don|господин|г-н",
    "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mademoiselle|Señora|Señorita|Doña|госпожа|г-жа",
    "n": "Dr|Prof",
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Erik Felix Hugo Ivan Jonas Karl Leo Martin Nils Oscar "
    "Pablo Rafael Simon Thomas Victor Walter",
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Ida Julia Klara Laura Maria "
    "Nora Olga Paula Rosa Sofia Teresa Vera",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Дмитрий Егор Иван Максим Николай Павел",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Лидия Мария Ольга Татьяна",
}
CONSONANTS = {
    "latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστφχ",
    "hebrew": "בגדזחטכלמנפקרש", "arabic": "بتجدرزسشطفقكلم", "kana": "カキサシタテナニハマヤラ",
    "han": "王李張劉陳楊黃趙周吳徐孫", "hangul": "김이박최정강조윤장임한오",
}
VOWELS = {
    "latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιου", "hebrew": "אויע", "arabic": "اوي",
    "kana": "アイウエオンリル", "han": "明文華美英國志安平玉", "hangul": "민서지현우영수진은호",
}
#: Letters of the scripts; names in others get Latin letters.
SCRIPTS = {
    "cyrillic": "[Ѐ-ӿ]", "greek": "[Ͱ-Ͽἀ-῿]", "hebrew": "[א-ת]", "arabic": "[ء-ي]", "kana": "[ぁ-ヿ]",
    "han": "[一-鿿]", "hangul": "[가-힣]", "latin": "",
}
#: Letters that are initials: the first group begins given names of both lists.
INITIALS = {
    "latin": ("abcdefhijklmnoprstv", "gquwxyz"), "cyrillic": ("авдеим", "бгжзклнопрстуфхцчшэюя"),
    "greek": ("", "αβγδεζηθικλμνξοπρστυφχψω"),
}
PARTICLES = "von|van|de|der|den|del|della|di|da|do|dos|das|du|des|la|le|zu|zum|zur|ter|ten|y|e|bin|al|el"
_UPPER = r"[^\W\d_a-zß-öø-ÿа-џα-ώ]"
_WORD = (rf"(?:{_UPPER}[^\W\d_]+|{_UPPER}(?=['’][^\W\d_]{{2}}))"
         rf"(?:['’](?=[^\W\d_]{{2}})[^\W\d_]+|[-‐‑]{_UPPER}[^\W\d_]+)*")
_INITIAL = rf"{_UPPER}(?:\.(?:[-‐‑]?{_UPPER}\.)* ?|(?= ) )"
NAME = rf"(?:{_INITIAL}|(?:{PARTICLES}) |{_WORD} ){{0,7}}{_WORD}"
#: The words of a name, and what may be one in the rest of its document.
_KEPT = frozenset(PARTICLES.split("|"))
NAME_PART = re.compile(rf"(?<!\w)(?:{_WORD}|{_UPPER}(?!\w))")
_TITLED = "|".join(f"(?P<{g}>{words})" for g, words in TITLES.items())
#: What separates groups of a phone number; an address after a number is no group of it.
_SEP = r"[ \u00a0\u202f./\u2010-\u2013-]"
_GROUP = rf"{_SEP}?(?!(?:\d{{1,3}}\.){{3}}\d)\d{{2,4}}"
#: International numbers, and the national forms of fr, de (also gb), es and en (us).
PHONES = (
    rf"(?<!\w)\+1{_SEP}?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{4}}(?!\d)",
    r"(?:(?<!\w)\+|(?<![\w+])(?<!\d[.,/-])00)3[34]"
    rf"{_SEP}?(?:\(0\){_SEP}?)?[1-9](?:{_SEP}?\d){{8}}(?!\d)",
    r"(?:(?<!\w)\+(?=(?:\W{0,3}\d){7})|(?<![\w+])(?<!\d[.,/-])00(?=[1-9](?:\W{0,3}\d){8}))\d{1,3}"
    rf"{_SEP}?(?:\(0\){_SEP}?)?\(?\d{{1,4}}\)?(?:{_GROUP}){{2,4}}(?:-\d{{1,5}})?(?!\d)",
    r"(?<![\w+])(?<!\d[.,/-])(?:"
    rf"0[1-9](?:{_SEP}\d\d){{4}}|0[1-9]\d{{8,9}}"
    r"|(?:\(0[1-9]\d{1,3}\) ?|0[1-9]\d{1,3}(?: ?[/-] ?|[ \u00a0\u202f]))"
    r"(?:\d{6,9}(?:-\d{1,5})?(?!\d)|\d(?:[ -]?\d){5,8})"
    r"|[6-9]\d\d(?:(?:[ -]\d{3}){2}|(?:[ -]\d\d){3})|[89]\d[ -]\d{3}[ -]\d\d[ -]\d\d"
    r"|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w|[.,]\d)",
)
#: Words before a number without separators that tell it from other numbers.
PHONE_CUE = (r"(?i:t[eé]l(?:[eé](?:f|ph)on[eo]?)?|phone|(?:tele)?fax|m[oó]vil|mobile?|handy|cell)"
             r"[.:]{0,2} ?")
ENTITY = re.compile(
    r"(?P<email>[\w.+-]+@(?:[_-]+\.)*[_-]*[^\W_][\w-]*(?:\.[\w-]+)+)"
    rf"|(?P<token>(?<![\w-])(?:{TOKENS})(?![\w-]))"
    r"|(?P<hex>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<ipsix>(?<![\w:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<dni>(?<![\w.-])\d{8}-?[A-HJ-NP-TV-Z](?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    rf"|(?P<phone>{'|'.join(PHONES)})"
    rf"|(?<!\w){PHONE_CUE}(?P<cued>\d{{7,12}}(?!\w|[.,]\d))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]))"
    rf"|(?<!\w)(?:{_TITLED})\.? (?:(?:Dr|Prof)\.? )*(?P<name>{NAME})"
)
#: Only a text with one of these can hold an entity.
HINT = re.compile(rb"[@+0-9]|[0-9A-Fa-f]{32}|gh[opsur]_|github_pat_|xox[abprs]-|AIza|k_live_|k_test_|sk-|eyJ|" + "|".join(
    w for words in TITLES.values() for w in words.split("|")).encode())
#: After so many void draws the next ones are one character longer.
LONGER_AFTER = 8
KINDS = (
    "email", "token", "hex", "ipsix", "iban", "ssn", "dni", "ip", "phone", "cued", "card", "name")
#: Digits of a phone number that not all its spellings have: exit code, and zero after a country code.
_OPTIONAL = re.compile(r"(^00|\(0\))")


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """``(from, to, kind)`` of each entity; a name's kind carries its gender, as in ``name_f``.

    A mention of a name without a title, in a document that has it with one, is ``name_n``.
    """
    return [(a, b, kind) for a, b, kind, _ in _mentions(text)]


def _mentions(text: str) -> list[tuple[int, int, str, bool]]:
    """Entities, and whether each is a name with a title."""
    found, named = [], False
    for m in ENTITY.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        if kind in _VALID and not _VALID[kind](m[kind]):
            continue
        if kind == "card" and len(re.sub(r"\D", "", m[kind])) not in range(13, 20):
            continue
        if kind == "name":
            named = True
            found.append((*m.span(kind), f"name_{next((g for g in TITLES if m[g]), 'n')}", True))
        else:
            found.append((*m.span(kind), "phone" if kind == "cued" else kind, False))
    return _with_untitled(text, found) if named else found


def _words(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The words and initials of a name; particles stay as they are."""
    words = [m.span() for m in NAME_PART.finditer(text, a, b)]
    return [w for w in words[:-1] if text[slice(*w)].casefold() not in _KEPT] + words[-1:]


def _with_untitled(text: str, found: list[tuple[int, int, str, bool]]) -> list:
    known = {canonical("name", text[a:b]) for x, y, _, titled in found if titled
             for a, b in _words(text, x, y) if b - a > 1}
    out, at = [], 0
    for entity in [*found, (len(text), len(text), "", False)]:
        last = None
        for m in NAME_PART.finditer(text, at, entity[0]):
            if canonical("name", m[0]) not in known:
                continue
            if last is not None and text[last[1] : m.start()] == " ":
                last = out[-1] = (last[0], m.end(), "name_n", False)
            else:
                last = (*m.span(), "name_n", False)
                out.append(last)
        out.append(entity)
        at = entity[1]
    return out[:-1]


def entity_parts(text: str) -> list[tuple[int, int, str, str, str | None]]:
    """``(from, to, kind, entity, reported kind)`` of what is replaced: entities, and words of names.

    The kind of a family name is ``name``, that of a given name ``name_`` and the gender that the
    document tells; an ``initial`` follows from its letter. The reported kind is None for the later
    words of a name.
    """
    found = _mentions(text)
    names, families, told = {}, set(), {}
    for a, b, kind, titled in found:
        if kind.startswith("name"):
            names[a] = [(*w, canonical("name", text[slice(*w)])) for w in _words(text, a, b)]
            if titled:
                families.add(names[a][-1][2])
                for _, _, key in names[a]:
                    told.setdefault(key, set()).update({kind[-1]} - {"n"})
    out = []
    for a, b, kind, _ in found:
        if a not in names:
            out.append((a, b, kind, canonical(kind, text[a:b]), kind))
            continue
        for k, (x, y, key) in enumerate(names[a]):
            if y - x == 1:
                part = "initial"
            elif key in families:
                part = "name"
            else:
                own = {kind[-1]} - {"n"} or told[key] or told[names[a][-1][2]]
                part = f"name_{min(own) if len(own) == 1 else 'n'}"
            out.append((x, y, part, key, None if k else kind))
    return out


def _ip_version_6(value: str) -> bool:
    try:
        return len(ipaddress.IPv6Address(value).compressed.replace("::", ":").split(":")) > 2
    except ValueError:
        return False


def iban_rest(value: str) -> int:
    """1 for an account number with valid check digits."""
    text = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


#: Entities that have check digits or a grammar of their own; others of that form are left alone.
_VALID = {
    "ipsix": _ip_version_6, "iban": lambda v: iban_rest(v) == 1,
    "dni": lambda v: DNI_LETTERS[int(v[:8]) % 23] == v[-1],
}


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    if digits[:1] in ("1", "7"):
        return digits[:1]
    return digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def card_brand(digits: str) -> str:
    """The beginning of a card number that tells its brand."""
    return digits[:1] if digits[0] == "4" else digits[:4] if digits[:4] == "6011" else digits[:2]


def canonical(kind: str, value: str) -> str:
    """What mentions of one entity share: digits of a number (after ``+`` with a country code),
    lower case of an address or name, an account number without spaces."""
    if kind == "phone":
        digits = re.sub(r"\D", "", _OPTIONAL.sub("", value))
        return f"+{digits}" if value.startswith(("+", "00")) else digits
    if kind == "card":
        return re.sub(r"\D", "", value)
    if kind in ("iban", "dni"):
        return re.sub("[ -]", "", value)
    if kind == "ipsix":
        return ipaddress.IPv6Address(value).exploded
    if kind in ("email", "hex"):
        return value.lower()
    if kind.startswith("name"):
        return re.sub("[‐‑]", "-", value.casefold().replace("’", "'"))
    return value


def luhn(digits: str) -> int:
    """0 for a card number with a valid check digit."""
    twice = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10


class _Draws:
    """Numbers drawn from a keyed hash of an entity and the count of attempts."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed = key, f"{kind}\0{entity}\0{attempt}".encode()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            made = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256)
            self.left, self.block = self.left + made.digest(), self.block + 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """A canonical replacement for a canonical entity."""
    draw, longer = _Draws(key, kind, entity, attempt), attempt // LONGER_AFTER
    if kind == "hex":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(entity) + longer))
    if kind == "ip":
        return _address(draw, entity, attempt)
    if kind == "ipsix":
        # The first group tells the kind of network; eight groups are left to draw from.
        return ":".join([entity[:4], *(f"{1 + draw.below(0xFFFE):04x}" for _ in range(7))])
    if kind == "token":
        # Signed tokens are three parts, of which two begin alike.
        dotted = [entity] if not entity.startswith("eyJ") else entity.split(".")
        heads = [m[0] if (m := TOKEN_HEAD.match(part)) else "" for part in dotted]
        return ".".join(
            head + "".join(_like(draw, c) for c in part[len(head):])
            for head, part in zip(heads, dotted)) + "".join(_like(draw, "a") for _ in range(longer))
    if kind == "iban":
        # Digits for digits and letters for letters; the country and valid check digits stay.
        rest = "".join(_like(draw, c) for c in entity[4:] + "0" * longer)
        return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + rest):02d}{rest}"
    if kind == "ssn":
        area = 1 + draw.below(898)
        return f"{area + (area >= 666):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}" + (
            "0" * longer)
    if kind == "dni":
        number = f"{draw.below(10**8):08d}"
        return number + "0" * longer + DNI_LETTERS[int(number) % 23]
    if kind == "phone":
        # A country code stays; so does how a national number begins, which tells its kind.
        international = entity.startswith("+")
        head = f"+{country_code(entity[1:])}" if international else entity[:2 if entity[0] == "0" else 1]
        return head + _digits(draw, len(entity) - len(head) + longer)
    if kind == "card":
        head = card_brand(entity)
        digits = head + _digits(draw, len(entity) - len(head) + longer)
        return digits[:-1] + str(-luhn(digits[:-1] + "0") % 10) if luhn(entity) == 0 else digits
    if kind == "email":
        local, _, domain = entity.partition("@")
        head, _, tail = domain.rpartition(".")
        return f"{_word(draw, local + 'a' * longer)}@{_word(draw, head)}.{tail}"
    return _name(draw, kind, entity.casefold(), key, attempt)


def _digits(draw: _Draws, n: int) -> str:
    return "".join(str(draw.below(10)) for _ in range(n))


def _like(draw: _Draws, c: str) -> str:
    """A digit for a digit and a letter of the same case for a letter."""
    if c.isdigit():
        return str(draw.below(10))
    if not c.isalpha():
        return c
    new = "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
    return new.upper() if c.isupper() else new


#: First numbers of public addresses, without blocks that hold private or reserved ones.
_PUBLIC = [str(n) for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]


def _address(draw: _Draws, entity: str, attempt: int) -> str:
    """Addresses of private networks, the loop-back included, stay in one, public ones public.

    What is small is used up at some time: later draws come from the largest private network, and
    after very many, where hardly an address is free, from those of version 6.
    """
    parts = entity.split(".")
    private = parts[0] in ("10", "127") or parts[:2] == ["192", "168"] or (
        parts[0] == "172" and parts[1].isdigit() and 16 <= int(parts[1]) < 32)
    head = parts[:1] if parts[0] in ("10", "127") else parts[:2] if private else [
        _PUBLIC[draw.below(len(_PUBLIC))]]
    if attempt >= LONGER_AFTER and private:
        head = ["10"]
    if attempt >= 8 * LONGER_AFTER:
        return ":".join(["fd00" if private else "2001"] + [f"{draw.below(1 << 16):x}" for _ in range(7)])
    return ".".join([*head, *(str(1 + draw.below(254)) for _ in range(4 - len(head)))])


def script_of(text: str) -> str:
    return next(s for s, letters in SCRIPTS.items() if re.search(letters, text))


@lru_cache(maxsize=4096)
def initial(letter: str, key: bytes) -> str:
    """The lower-case letter that stands for an initial: another one, different for each."""
    low = unicodedata.normalize("NFD", letter)[0].casefold()[0]
    others = CONSONANTS[script_of(letter)]
    letters = next((g for groups in INITIALS.values() for g in groups if low in g), others)
    order = sorted({*letters, low}, key=lambda c: hmac.digest(key, f"initial\0{c}".encode(), "sha256"))
    return order[(order.index(low) + 1) % len(order)]


def _name(draw: _Draws, kind: str, entity: str, key: bytes, attempt: int) -> str:
    """A word of a name: hyphens and apostrophes stay, a given name begins as its initial does."""
    script, longer = script_of(entity), attempt // LONGER_AFTER
    pairs = (CONSONANTS[script], VOWELS[script])
    short = script in ("han", "hangul", "kana")
    gender = (kind[-1] if kind[-1] in "mf" else "mf"[draw.below(2)]) if "_" in kind else ""
    out = []
    for nth, piece in enumerate(re.split("(['-])", entity)):
        size = max(1 if short else 5, len(piece)) + draw.below(3) + longer
        if nth % 2:
            out.append(piece)
        elif len(piece) == 1 and len(entity) > 1:
            out.append(pairs[0][draw.below(len(pairs[0]))])
        else:
            begin = initial(piece[0], key) if gender and not nth else ""
            fits = [w.lower() for w in GIVEN.get((script, gender), "").split()
                    if begin and w.lower().startswith(begin)]
            if fits and not attempt:
                out.append(fits[0])
                continue
            turn = 0 if begin and begin in pairs[1] else len(begin)
            word = begin + "".join(pairs[(i + turn) % 2][draw.below(len(pairs[(i + turn) % 2]))]
                                   for i in range(size - len(begin)))
            if begin and script in ("latin", "cyrillic") and (word[-1] in pairs[1]) == (gender == "m"):
                word += pairs[0][draw.below(len(pairs[0]))] if gender == "m" else pairs[1][0]
            out.append(word)
    return "".join(out)


def _word(draw: _Draws, text: str) -> str:
    """Letters for letters and digits for digits and other numerals."""
    return "".join(
        "abcdefghijklmnopqrstuvwxyz"[draw.below(26)] if c.isalpha()
        else str(draw.below(10)) if c.isalnum() else c for c in text)


def in_format(kind: str, value: str, new: str) -> str:
    """A canonical surrogate in the spelling of one mention: its separators and upper case."""
    if kind in ("phone", "card"):
        digits = iter(new.lstrip("+"))
        pieces = _OPTIONAL.split(value) if kind == "phone" else [value]
        return "".join(
            x if n % 2 else "".join(next(digits) if c.isdigit() else c for c in x)
            for n, x in enumerate(pieces)) + "".join(digits)
    if kind in ("hex", "ipsix"):
        if kind == "ipsix" and "::" in value:
            new = ipaddress.IPv6Address(new).compressed
        return new.upper() if value.isupper() else new
    if kind == "iban" and " " in value:
        return " ".join(new[k : k + 4] for k in range(0, len(new), 4))
    if kind == "dni" and "-" in value:
        return f"{new[:-1]}-{new[-1]}"
    if kind == "email" and len(new) == len(value):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(value, new))
    if kind.startswith("name"):
        old = re.split("(['’‐‑-])", value)
        return "".join(
            c if n % 2 else w.upper() if c.isupper() and len(c) > 1 else w.capitalize()
            for n, (c, w) in enumerate(zip(old, re.split("(['-])", new))))
    return new


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, surrogate`` for distinct entities; all surrogates of a kind differ.

    Each round draws for the entities that have none yet; of those that drew the same one keeps
    it, and a draw that an earlier round gave away, or that is an entity itself, is void.
    """
    batches(entities.sparkSession)
    group = F.regexp_extract("kind", "^[a-z]+", 0)
    todo = written(entities.select("kind", "entity").distinct().withColumn("group", group), "entities")
    known = todo.select("group", F.col("entity").alias("surrogate"))
    done, attempt = None, 0
    while not todo.isEmpty():
        def draw(parts: Iterator[pa.RecordBatch], attempt=attempt) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                new = [surrogate(k, e, key, attempt) for k, e in zip(
                    batch["kind"].to_pylist(), batch["entity"].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(new, pa.string())],
                    names=[*batch.schema.names, "surrogate"])

        drawn = todo.mapInArrow(
            draw, "kind string, entity string, group string, surrogate string")
        drawn = drawn.join(known, ["group", "surrogate"], "left_anti")
        if done is not None:
            drawn = drawn.join(done.select("group", "surrogate"), ["group", "surrogate"], "left_anti")
        first = drawn.groupBy("group", "surrogate").agg(
            F.min(F.struct("entity", "kind")).alias("first"))
        given = first.select("first.kind", "first.entity", "group", "surrogate")
        done = written(given if done is None else done.unionByName(given), "surrogates")
        todo = written(
            todo.join(done, ["kind", "entity"], "left_anti").select(*todo.columns), "entities-left")
        attempt += 1
    return done if done is not None else todo.withColumn("surrogate", F.col("entity"))


_own_keys: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's configuration, else one drawn for this session."""
    if given := spark.conf.get(KEY_SETTING, None):
        return given.encode()
    return _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def replace_private(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the new length in ``n_chars``; all else stays.

    Null and empty texts and texts without entities stay as they are. Repeated rows and entities
    get the same surrogates, also in another run with the same key. Texts are searched once and
    written with what was found; only rows with entities are joined and rewritten.
    """
    return _replaced(docs, key)


def private_report(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_entities, kinds`` after replacement, for every row."""
    return _replaced(docs.select("doc_id", "text"), key, report=True)


def _replaced(docs: DataFrame, key: bytes, report: bool = False) -> DataFrame:
    batches(docs.sparkSession)
    parts = T.StructType()
    for name, kind in (("at", "integer"), ("to", "integer"), ("kind", "string"), ("entity", "string"),
                       ("value", "string"), ("report", "string")):
        parts = parts.add(name, kind)
    span_type = pa.list_(pa.struct([
        ("at", pa.int32()), ("to", pa.int32()), ("kind", pa.string()), ("entity", pa.string()),
        ("value", pa.string()), ("report", pa.string())]))

    def entities_in(batch: pa.RecordBatch) -> list[list[dict]]:
        out = []
        for raw in byte_texts(batch["text"]):
            found: list[dict] = []
            if raw and HINT.search(raw):
                text = raw.decode()
                for a, b, kind, entity, report in entity_parts(text):
                    found.append({"at": a, "to": b, "kind": kind, "value": text[a:b],
                                  "entity": entity, "report": report})
            out.append(found)
        return out

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = pa.array([x or None for x in entities_in(batch)], span_type)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found], names=[*batch.schema.names, "_llm_spans"])

    held = T.StructType([*docs.schema.fields, T.StructField("_llm_spans", T.ArrayType(parts))])
    searched = written(docs.mapInArrow(search, held).withColumn(
        "_llm_row", F.monotonically_increasing_id()), "searched-rows")
    private = searched.filter("_llm_spans is not null")
    mentions = private.select("_llm_row", F.posexplode("_llm_spans").alias("_nth", "_span")).select(
        "_llm_row", "_nth", "_span.kind", "_span.entity").filter("kind != 'initial'")
    given = surrogates(mentions, key).select("kind", "entity", "surrogate")
    named = mentions.join(given, ["kind", "entity"]).groupBy("_llm_row").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "surrogate"))).alias("_llm_new"))
    rows = private.join(named, "_llm_row").drop("_llm_row")

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            new = {}
            for k, (text, found, given) in enumerate(zip(
                batch["text"].to_pylist(), batch["_llm_spans"].to_pylist(), batch["_llm_new"].to_pylist())):
                out, at, drawn = [], 0, {y["_nth"]: y["surrogate"] for y in given}
                for nth, x in enumerate(found):
                    spelled = (in_format(x["kind"], x["value"], drawn[nth]) if nth in drawn
                               else initial(x["value"], key).upper())
                    out += [text[at : x["at"]], spelled]
                    at = x["to"]
                new[k] = "".join(out) + text[at:]
            kept = batch.drop_columns(["_llm_new"] if report else ["_llm_spans", "_llm_new"])
            yield with_texts(kept, new)

    clean = searched.filter("_llm_spans is null").select(*docs.columns)
    if not report:
        return rows.mapInArrow(rewrite, docs.schema).unionByName(clean)
    told = F.filter(F.transform("_llm_spans", lambda s: s["report"]), lambda k: k.isNotNull())
    changed = rows.mapInArrow(rewrite, held).select(
        "doc_id", "text", F.size(told).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(told)).alias("kinds"))
    same = clean.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"),
                        F.array().cast("array<string>").alias("kinds"))
    return changed.unionByName(same)
