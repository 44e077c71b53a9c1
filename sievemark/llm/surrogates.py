"""Operator 10: personal data is replaced by keyed surrogates of the same type, gender, script and format.

A value is canonical when case and layout are set aside (``Ann@X.org`` and ``ann@x.org``, one phone number
with dots or blanks). Each canonical value is read as a number whose digits are the places of its characters
in their alphabets: digits, vowels and consonants of a script, hexadecimal digits of a secret. A keyed
Feistel network P permutes the numbers of a format, and the surrogate is ``P⁻¹(P(x) + 1)``: one cycle
through all values of the format, so no two values share a surrogate, none is its own, and the same value
gets the same surrogate in every document, without any table. Given names of the list are permuted among
the names of their gender and script, other names by letters among the names that the list lacks. A given name
that the list lacks takes the gender of the form of address before it and shows it by its ending. Signs,
blanks, country codes, leading zeros, prefixes of access keys, top-level domains and letter case stay where they
were, the Luhn property of a card number stays as it was, and check digits of an account number are made anew.

Names are found after a form of address or by a listed given name. Then every other place in the document where
a word of such a name stands with a capital gets the same surrogate, unless the document also has the word in
lower case (``Mr Will``, ``will``); in writing without case, words of two characters or more do.

``collisions`` checks this on the corpus: it counts, in Spark, surrogates that stand for more than one
canonical value and values that kept themselves; ``pseudonymised`` raises if there is one.

Digits of any script are read by their decimal value and written in their script again; letters of a script
without an alphabet of its own here share one with the letters of their kind in their Unicode page.

Cases: null and empty texts stay null and empty. A value without letters and digits has a single form: it is
masked with ``*`` (or stays, if it is a mask already), its entity says so, and the check leaves it out.
Texts of any length are read whole. Equal rows give equal results; an empty table gives an empty table.
Columns of the input with the name of an output are replaced, the text among them.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import with_columns
from sievemark.session import stored

KINDS = ("email", "phone", "card", "iban", "national", "ip", "secret", "name")
KEY = b"replace this key in production"
ROUNDS = 8

# Given names by gender and script, lower case.
GIVEN = {
    ("f", "latin"): ("anna", "bea", "carla", "diana", "elena", "fiona", "greta", "helga", "ines", "julia", "karin", "laura", "maria", "nina", "olga", "paula", "rosa", "sara", "tina", "vera",
                     "alice", "amy", "emily", "emma", "jane", "jennifer", "linda", "lucy", "margaret", "mary", "rachel", "susan", "camille", "claire", "sophie", "carmen", "lucia", "pilar", "heike", "ursula"),
    ("m", "latin"): ("adam", "boris", "carlos", "david", "emil", "felix", "georg", "hugo", "ivan", "jakob", "karl", "luis", "marco", "niels", "otto", "pablo", "ralf", "stefan", "tomas", "viktor",
                     "andrew", "brian", "charles", "george", "henry", "james", "john", "kevin", "michael", "peter", "robert", "william", "louis", "pierre", "alejandro", "javier", "miguel", "dieter", "jürgen", "wolfgang"),
    ("f", "cyrillic"): ("анна", "вера", "галина", "дарья", "елена", "зоя", "ирина", "лариса", "мария", "нина"),
    ("m", "cyrillic"): ("антон", "борис", "виктор", "глеб", "денис", "егор", "иван", "кирилл", "лев", "михаил"),
}
# Forms of address and the gender they show.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": "", "господин": "m", "госпожа": "f",
}
SHORT = frozenset(("Mr", "Mrs", "Ms", "Dr", "Prof"))  # forms of address that take a full stop
# Endings that show the gender of a surrogate for a given name outside the list, by script; no listed name has one.
ENDINGS = {("f", "latin"): "elia", ("m", "latin"): "ello", ("f", "cyrillic"): "елия", ("m", "cyrillic"): "ослав"}
# The letter that words of the texts get behind such an ending.
MARKS = {"latin": "e", "cyrillic": "е"}
# Country calling codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# What public services put before their access keys, lower case.
KEY_PREFIXES = ("sk-", "sk_live_", "sk_test_", "pk_live_", "pk_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "akia")
# Letters of each script, vowels first, then consonants.
LETTERS = (
    ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    ("àáâãäåèéêëìíîïòóôõöøùúûü", "çðñýþÿß"),
    ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
    ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъьіїґ"),
)
# First and last code point of writing systems without case, each one alphabet.
BLOCKS = ((0x05D0, 0x05EA), (0x0620, 0x064A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))

_alphabet_of = {c: (a, i) for pair in LETTERS for a in pair for i, c in enumerate(a)}
_alphabet_of |= {c: ("0123456789", i) for i, c in enumerate("0123456789")}
_hex_of = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}
_given = {n: k for k, names in GIVEN.items() for n in names}


def _set_place(c: str) -> tuple[str, int] | None:
    found = _alphabet_of.get(c)
    if found is None and ord(c) > 0x500:
        for first, last in BLOCKS:
            if first <= ord(c) <= last:
                return f"{first}-{last}", ord(c) - first
    return found


def _script(c: str) -> tuple[str, str, bool]:
    return unicodedata.category(c), unicodedata.name(c, "").partition(" ")[0], _fold(c) == c


@functools.lru_cache(1 << 16)
def _place(c: str) -> tuple[str, int] | None:
    found = _set_place(c)
    if found is None and c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return f"{zero}-{zero + 9}", ord(c) - zero
    if found is None and c.isalpha():
        page = ord(c) & ~0x7F
        alphabet = "".join(x for x in map(chr, range(page, page + 0x80)) if _script(x) == _script(c) and _set_place(x) is None)
        return alphabet, alphabet.index(c)
    return found


def _radix(alphabet: str) -> int:
    if "-" in alphabet:
        first, last = map(int, alphabet.split("-"))
        return last - first + 1
    return len(alphabet)


def _symbol(alphabet: str, i: int) -> str:
    return chr(int(alphabet.split("-")[0]) + i) if "-" in alphabet else alphabet[i]


class Permutation:
    """A keyed permutation of range(n): a Feistel network over an even number of bits, walked back into range."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.size = (self.half + 7) // 8
        self.keys = [hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), salt=bytes([r])).digest() for r in range(ROUNDS)]

    def _f(self, r: int, x: int) -> int:
        out = b""
        block = 0
        while len(out) < self.size:
            out += hashlib.blake2b(x.to_bytes(self.size, "little") + bytes([block]), key=self.keys[r]).digest()
            block += 1
        return int.from_bytes(out[: self.size], "little") & self.mask

    def _pass(self, x: int, rounds: range, forward: bool) -> int:
        a, b = x >> self.half, x & self.mask
        for r in rounds:
            if forward:
                a, b = b, a ^ self._f(r, b)
            else:
                a, b = b ^ self._f(r, a), a
        return a << self.half | b

    def __call__(self, x: int) -> int:
        x = self._pass(x, range(ROUNDS), True)
        while x >= self.n:
            x = self._pass(x, range(ROUNDS), True)
        return x

    def inverse(self, x: int) -> int:
        x = self._pass(x, range(ROUNDS - 1, -1, -1), False)
        while x >= self.n:
            x = self._pass(x, range(ROUNDS - 1, -1, -1), False)
        return x

    def next(self, x: int) -> int:
        """The next value on one cycle through all n values: never x itself if n is above 1."""
        return self.inverse((self(x) + 1) % self.n)


def shifted(key: bytes, kind: str, canonical: str, hexadecimal: bool = False, accept: Callable[[str], bool] | None = None) -> str:
    """The surrogate of a canonical value within its format; ``accept`` limits it to values of one class."""
    places = [(_hex_of.get(c) if hexadecimal else None) or _place(c) for c in canonical]
    n, x = 1, 0
    for p in places:
        if p:
            x, n = x * _radix(p[0]) + p[1], n * _radix(p[0])
    if n == 1:
        return "*" * len(canonical)
    form = "".join(f"[{p[0]}]" if p else c for p, c in zip(places, canonical, strict=True))
    permutation = Permutation(key, f"{kind}:{form}", n)
    while True:  # ends: the cycle comes back to the value itself, which is of its class
        x = permutation.next(x)
        rest, out = x, []
        for p, c in zip(reversed(places), reversed(canonical), strict=True):
            if p:
                rest, i = divmod(rest, _radix(p[0]))
                c = _symbol(p[0], i)
            out.append(c)
        made = "".join(reversed(out))
        if accept is None or accept(made):
            return made


def _still(kind: str, canonical: str) -> bool:
    """Whether a value has a single form, so that it can only be masked."""
    moving = canonical.rpartition(".")[0] if kind == "email" else canonical
    return all(p is None or _radix(p[0]) == 1 for p in map(_place, moving))


def dressed(made: str, original: str) -> str:
    """Letter case of the original, character by character."""
    return "".join(m.upper() if o.isupper() and len(m.upper()) == 1 else m for m, o in zip(made, original, strict=True))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _fold(value: str) -> str:
    """Lower case without changing the length."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _digits_only(value: str) -> str:
    """The digits of any script as 0-9."""
    return "".join(str(unicodedata.decimal(c)) for c in value if c.isdecimal())


def _as_in(c: str, digit: str) -> str:
    """A digit 0-9 in the script of ``c``."""
    return chr(ord(c) - unicodedata.decimal(c) + int(digit))


def _relaid(made: str, layout: str, skip: int = 0) -> str:
    """Digits put into the digit places of a layout, after ``skip`` digits that stay."""
    rest = iter(made)
    seen = 0
    out = []
    for c in layout:
        if c.isdecimal():
            seen += 1
            c = c if seen <= skip else _as_in(c, next(rest))
        out.append(c)
    return "".join(out)


def email(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    stem, dot, top = value.rpartition(".")
    canonical = _fold(stem)
    made = shifted(key, "email:" + _fold(top), canonical)
    return [("email", canonical + "." + _fold(top), made + "." + _fold(top), dressed(made, stem) + dot + top)]


def phone(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    digits = _digits_only(value)
    if value.startswith("+"):
        keep = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3
        fixed = f"+{digits[:keep]} "
        made = shifted(key, "phone:" + digits[:keep], digits[keep:])
    else:  # numbers with a trunk zero keep it, the others get none
        keep = int(digits[0] == "0")
        fixed = digits[:keep]
        made = shifted(key, f"phone:national {keep}", digits[keep:], accept=lambda d: keep or d[0] != "0")
    return [("phone", fixed + digits[keep:], fixed + made, _relaid(made, value, keep))]


def card(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    digits = _digits_only(value)
    valid = luhn(digits)
    made = shifted(key, "card", digits, accept=lambda d: luhn(d) == valid)
    return [("card", digits, made, _relaid(made, value))]


def national(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    digits = _digits_only(value)
    made = shifted(key, "national", digits)
    return [("national", digits, made, _relaid(made, value))]


def _remainder(account: str) -> int:
    """The number of an account, country and check digits last and letters as 10 to 35, modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def is_iban(value: str) -> bool:
    account = value.replace(" ", "")
    return 15 <= len(account) <= 34 and _remainder(account) == 1


def iban(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    account = value.replace(" ", "")
    inner = shifted(key, "iban:" + account[:2], account[4:].lower()).upper()
    made = f"{account[:2]}{98 - _remainder(account[:2] + '00' + inner):02d}{inner}"
    rest = iter(made)
    return [("iban", account, made, "".join(c if c == " " else next(rest) for c in value))]


def ip(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    x = 0
    for part in value.split("."):
        x = x << 8 | int(part)
    x = Permutation(key, "ip", 1 << 32).next(x)
    made = ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    text = "".join(_as_in(value[0], c) if c != "." else c for c in made)
    return [("ip", ".".join(str(int(p)) for p in value.split(".")), made, text)]


def _short(address: str) -> str:
    return ipaddress.IPv6Address(address).compressed


def is_ipv6(value: str) -> bool:
    try:
        groups = re.findall(r"\w+", _short(value))
    except ValueError:
        return False
    return re.search(r"\d", value) is not None and (len(groups) > 3 or len(groups) > 1 and max(map(len, groups)) > 2)


def ipv6(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    canonical = _short(value)
    made = shifted(key, "ipv6", canonical, True, accept=lambda a: _short(a) == a)
    return [("ip", canonical, made, made.upper() if value.upper() == value and value.lower() != value else made)]


def _key_prefix(folded: str) -> str:
    return next((p for p in KEY_PREFIXES if folded.startswith(p) and len(folded) > len(p)), "")


def secret(key: bytes, value: str, _: str) -> list[tuple[str, str, str, str]]:
    folded = _fold(value)
    prefix = _key_prefix(folded)
    inner = folded[len(prefix) :]
    hexadecimal = all(c in _hex_of for c in inner)
    kind = ("hex" if hexadecimal else "secret") + (":" + prefix if prefix else "")
    made = prefix + shifted(
        key, kind, inner, hexadecimal,
        accept=lambda m: (prefix or not _key_prefix(m)) and (hexadecimal or not all(c in _hex_of for c in m)),
    )
    return [("secret", folded, made, dressed(made, value))]


def _letter_script(word: str) -> str:
    names = {unicodedata.name(c, "").partition(" ")[0] for c in word if c.isalpha()}
    return names.pop().lower() if len(names) == 1 else ""


_marked = re.compile("|".join(f"(?:{e}){MARKS[script]}*$" for (_, script), e in ENDINGS.items()))


def _dressed_word(made: str, word: str) -> str:
    """A name in the case of another one: capitals throughout, a capital, or character by character."""
    if len(made) == len(word):
        return dressed(made, word)
    if word.isupper() and len(word) > 1:
        return made.upper()
    return made[:1].upper() + made[1:] if word[:1].isupper() else made


def _word(key: bytes, word: str, gender: str = "") -> tuple[str, str, str, str]:
    """One word of a name: (kind, canonical, surrogate, text).

    Surrogates with an ending of ENDINGS belong to given names outside the list alone: other words never get one,
    and those that have such an ending themselves get one more letter of MARKS behind it.
    """
    folded = _fold(word)
    listed = _given.get(folded)
    if listed:
        names = GIVEN[listed]
        made = names[Permutation(key, "given:" + ":".join(listed), len(names)).next(names.index(folded))]
        text = made[:1].upper() + made[1:] if word[:1].isupper() else made
        return ("name", folded, made, made.upper() if word.isupper() and len(word) > 1 else text)
    ending = ENDINGS.get((gender, _letter_script(word)))
    if ending:
        made = shifted(key, f"name:{gender}", folded) + ending
        return ("name", f"{folded} {gender}", made, _dressed_word(made, word))
    mark = _marked.search(folded)
    if mark:
        stem = folded[: mark.start()]
        made = (shifted(key, "name:marked", stem) if stem else "") + mark[0] + MARKS[_letter_script(mark[0])]
    else:
        made = shifted(key, "name", folded, accept=lambda n: n not in _given and not _marked.search(n))
    return ("name", folded, made, _dressed_word(made, word))


def name(key: bytes, value: str, gender: str) -> list[tuple[str, str, str, str]]:
    """The words of a name; after a form of address the first of several words is a given name of that gender."""
    words = value.split()
    return [_word(key, w, gender if i == 0 and len(words) > 1 else "") for i, w in enumerate(words)]


_capital = r"[^\W\d_a-zß-öø-ÿа-я]"
_part = rf"(?:{_capital}['’])?{_capital}\w+(?:[-'’]{_capital}\w+)*"
_gender_of = TITLES | {t.upper(): g for t, g in TITLES.items()}
_titles = "|".join(sorted(_gender_of, key=len, reverse=True))
_short_titles = "|".join(t for t in sorted(_gender_of, key=len, reverse=True) if t.title() in SHORT)
_forms = sorted({f for n in _given for f in (n[:1].upper() + n[1:], n.upper())}, key=len, reverse=True)
_words = r"token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key"
_plain = r"""[^\s"'`,;<>(){}\[\]]"""
PATTERNS = (
    ("secret", re.compile(rf"""(?i)\b(?:{_words})\b["']?\s*[:=]\s*(?:["']([^"'\s]{{6,}})["']|(?={_plain}*\d)({_plain}{{5,}}[\w=/+$!-])(?![\w(\[.]))"""), secret, None),
    ("secret", re.compile(r"(?<![\w-])((?:sk-|[sp]k_(?:live|test)_|gh[pousr]_|xox[abp]-|AKIA)(?=[\w-]*\d)[\w-]{16,})(?![\w-])"), secret, None),
    ("email", re.compile(r"[\w.+%-]*\w@\w[\w-]*(?:\.\w[\w-]*)*\.[^\W\d_]{2,}"), email, None),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), iban, is_iban),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"), card, None),
    ("phone", re.compile(
        r"(?<!\w)\+\d(?:[ ().\-/\u00a0]{0,3}\d){7,14}(?!\w)"
        r"|(?<!\w)\+\d{1,3}[^\w\n+]{1,6}\d{2,4}(?:[^\w\n+]{1,6}\d{2,4}){1,4}(?!\w)"
        r"|(?<![\w+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"
        r"|(?<![\w+./:-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-])|(?<![\w+./:-])0[1-9](?:[ .-]\d\d){4}(?![\w-])"), phone, None),
    ("national", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), national, None),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"), ip, None),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"), ipv6, is_ipv6),
    ("name", re.compile(
        rf"\b(?:(?:(?:(?:{_short_titles})\b\.?|(?:{_titles})\b)\s+)+(?!(?:{_titles})\b)({_part}(?:\s{_capital}\.(?=\s{_capital}))?(?:\s{_part}){{0,2}})"
        rf"|((?:{'|'.join(_forms)})(?:\s{_capital}\.(?=\s{_capital}))?(?:\s{_part}){{1,2}}))"), name, None),
)
# Substrings without which a pattern of secrets finds nothing.
_key_signs = {PATTERNS[0][1]: (":", "="), PATTERNS[1][1]: (*(p for p in KEY_PREFIXES if p != "akia"), "AKIA")}
_digit = re.compile(r"\d")
_named = re.compile("|".join(map(re.escape, sorted([*_gender_of, *_forms], key=len, reverse=True))))
_title = re.compile(rf"\b(?:{_titles})\b")
_token = re.compile(r"\w+(?:[-'’]\w+)*")
_inner = re.compile(r"\w+")


class _Taken:
    """Spans without overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Keeps the span if nothing of it is taken."""
        i = bisect.bisect_right(self.starts, start)
        if i and self.ends[i - 1] > start or i < len(self.starts) and self.starts[i] < end:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def _hint(text: str, m: re.Match, start: int) -> str:
    """The gender that the forms of address before a name show."""
    return next((g for t in _title.findall(text[m.start() : start]) if (g := _gender_of[t])), "")


def spans(text: str, taken: _Taken | None = None) -> list[tuple[int, int, str, Callable, str]]:
    """(start, end, kind, maker, gender) of the entities, in order and without overlap: earlier kinds of PATTERNS win."""
    taken = taken or _Taken()
    found: list[tuple[int, int, str, Callable, str]] = []
    digits = _digit.search(text) is not None
    for kind, pattern, make, valid in PATTERNS:
        if kind == "email" and "@" not in text or kind in ("card", "phone", "ip", "iban", "national") and not digits and make is not ipv6:
            continue
        if kind == "name" and not _named.search(text) or make is ipv6 and text.count(":") < 2:
            continue
        if kind == "secret" and not any(sign in text for sign in _key_signs[pattern]):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex or 0)
            if (valid is None or valid(text[start:end])) and taken.take(start, end):
                found.append((start, end, kind, make, _hint(text, m, start) if kind == "name" else ""))
    return sorted(found, key=lambda s: s[:2])


def _mentions(text: str, known: dict[str, tuple[str, str, str]], taken: _Taken) -> Iterator[tuple[int, int, str]]:
    """(start, end, folded) of further places where the words of ``known`` stand."""
    places, lower = [], set()
    for m in _token.finditer(text):
        parts = [m] if _fold(m[0]) in known else _inner.finditer(text, *m.span())
        for part in parts:
            folded = _fold(part[0])
            if folded not in known:
                continue
            cased = part[0].upper() != part[0].lower()
            if cased and part[0] == folded:
                lower.add(folded)
            elif cased or len(folded) > 1:
                places.append((*part.span(), folded))
    for start, end, folded in places:
        if folded not in lower and taken.take(start, end):
            yield start, end, folded


def replaced(key: bytes, text: str) -> tuple[str, list[tuple[str, str, str, int, int, bool]]]:
    """The text with surrogates, and (kind, canonical, surrogate, start, end, masked) of each replaced value."""
    taken = _Taken()
    made: list[tuple[int, int, str, list[tuple[str, str, str, str]]]] = []
    known: dict[str, tuple[str, str, str]] = {}
    for start, end, kind, make, hint in spans(text, taken):
        parts = make(key, text[start:end], hint)
        new = parts[0][3]
        if kind == "name":  # blanks between the words stay
            gaps = re.findall(r"\s+", text[start:end])
            new = "".join(p[3] + g for p, g in zip(parts, [*gaps, ""], strict=True))
            for word, part in zip(text[start:end].split(), parts, strict=True):
                known.setdefault(_fold(word), part[:3])
        made.append((start, end, new, parts))
    for start, end, folded in _mentions(text, known, taken) if known else ():
        new = _dressed_word(known[folded][2], text[start:end])
        made.append((start, end, new, [(*known[folded], new)]))
    out, at, told = [], 0, []
    for start, end, new, parts in sorted(made, key=lambda m: m[:2]):
        out += [text[at:start], new]
        at = end
        told += [(k, canonical, surrogate, start, end, _still(k, canonical)) for k, canonical, surrogate, _ in parts]
    out.append(text[at:])
    return "".join(out), told


SPAN = pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("masked", pa.bool_())])
OUTPUTS = "{text} string, entities array<struct<kind:string,value:string,surrogate:string,start:long,end:long,masked:boolean>>"


def with_surrogates(docs: DataFrame, text: str = "text", key: bytes = KEY, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the text replaced, and ``entities``: what was replaced, by what, and where it stood."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, told = [], []
        for value in batch.column(text).to_pylist():
            new, found = (value, []) if not value else replaced(key, value)
            texts.append(new)
            told.append([dict(zip(SPAN.names, f, strict=True)) for f in found])
        return {text: pa.array(texts, pa.string()), "entities": pa.array(told, pa.list_(SPAN))}

    return with_columns(docs, OUTPUTS.format(text=f"`{text}`"), compute, keep)


def collisions(entities: DataFrame) -> DataFrame:
    """Kinds and surrogates that stand for several values, or for themselves: empty if all is right. Masked values are left out."""
    spans_ = entities.select(F.explode("entities").alias("e"))
    if "masked" in entities.schema["entities"].dataType.elementType.names:
        spans_ = spans_.where("not e.masked")
    each = spans_.select("e.kind", "e.value", "e.surrogate").distinct()
    shared = each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return shared.unionByName(each.where("value = surrogate").select("kind", "surrogate"))


def pseudonymised(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """:func:`with_surrogates`, written once, checked for collisions and read back."""
    made = stored(with_surrogates(docs, text, key), "surrogates")
    if not collisions(made).isEmpty():
        raise ValueError("two values share a surrogate, or one kept itself")
    return made
