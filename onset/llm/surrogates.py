"""Keyed permutations of strings that keep their format.

A string's format says which characters stand at which places; within a format
the strings are the numbers below some N, and :func:`shifted` permutes those
numbers under a key with no number left where it was. So one string always gets
the same surrogate, different strings of a format get different ones, and the
format stays. Long strings are permuted part by part.

Defined cases: functions take strings, never null; a string without letters or
digits, the empty one included, has no other of its format and stays; strings of
any length are permuted whole; equal strings have equal surrogates.
"""

from __future__ import annotations

import hashlib
import string
import unicodedata
from functools import lru_cache

#: Alphabets by script and case. A letter is replaced within its alphabet; a letter
#: or digit of none of them within the like characters of its block of 256.
ALPHABETS = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "çñßýÿ", "ÇÑÝ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
]
_OF = {c: (letters, i) for letters in ALPHABETS for i, c in enumerate(letters)}
ROUNDS = 6
#: Characters that are permuted as one number: half of it is less than a digest.
PART = 64


def _halves(n: int) -> tuple[int, int]:
    """a * b >= n, about equal and close to it."""
    a = 1 << (n.bit_length() + 1) // 2
    return a, -(-n // a)


def _round(key: bytes, tweak: str, n: int, i: int, half: int) -> int:
    data = f"{tweak}\0{n:x}\0{i}\0{half:x}".encode()
    size = min(64, max(16, n.bit_length() // 8 + 9))
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=size).digest(), "big")


def _permute(key: bytes, tweak: str, n: int, x: int, back: bool) -> int:
    """A Feistel network over a * b, walked until the value is below ``n``."""
    a, b = _halves(n)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, tweak, n, i, left)) % b
            else:
                left = (left + sign * _round(key, tweak, n, i, right)) % a
        x = left * b + right
        if x < n:
            return x


def shifted(key: bytes, tweak: str, n: int, x: int, by: int = 1) -> int:
    """Where ``x`` goes among the numbers below ``n``; never to itself if n > 1
    and ``by`` is no multiple of n."""
    return _permute(key, tweak, n, (_permute(key, tweak, n, x, False) + by) % n, True)


@lru_cache(maxsize=1 << 14)
def alphabet(char: str) -> tuple[str, int] | None:
    """The characters that may stand for ``char`` and its place among them; null
    for all but letters and digits, which stay."""
    if char in _OF:
        return _OF[char]
    if not char.isalnum():
        return None
    block, kind = ord(char) & ~0xFF, unicodedata.category(char)
    like = "".join(c for c in map(chr, range(block, block + 256)) if unicodedata.category(c) == kind and c not in _OF)
    return like, like.index(char)


def same_format(key: bytes, tweak: str, text: str, by: int = 1) -> str:
    """``text`` with its letters and digits replaced within their alphabets; all
    else stays where it is. Long texts go part by part."""
    if len(text) > PART:
        return "".join(same_format(key, f"{tweak}{at}", text[at : at + PART], by) for at in range(0, len(text), PART))
    places = [alphabet(c) for c in text]
    n, x = 1, 0
    for p in places:
        if p:
            n, x = n * len(p[0]), x * len(p[0]) + p[1]
    if n == 1:
        return text
    form = "".join(p[0][0] if p else c for c, p in zip(text, places, strict=True))
    x = shifted(key, f"{tweak}\0{form}", n, x, by)
    out = []
    for c, p in zip(reversed(text), reversed(places), strict=True):
        if p:
            x, i = divmod(x, len(p[0]))
            c = p[0][i]
        out.append(c)
    return "".join(reversed(out))


def until(found, text: str, good) -> str:
    """``found`` of ``text``, of that again, and so on until it is ``good``. Where
    ``text`` is good itself, this permutes the good strings."""
    new = found(text)
    while not good(new):
        new = found(new)
    return new


def hexadecimal(key: bytes, tweak: str, text: str, by: int = 1) -> str:
    """As :func:`same_format` for hexadecimal digits, upper case if the old ones
    are; what stands between them stays. Long texts go part by part."""
    if len(text) > PART:
        return "".join(hexadecimal(key, f"{tweak}{at}", text[at : at + PART], by) for at in range(0, len(text), PART))
    digits = "".join(c for c in text if c in string.hexdigits)
    form = "".join("0" if c in string.hexdigits else c for c in text)
    new = f"{shifted(key, f'{tweak}{form}', 16 ** len(digits), int(digits, 16), by):0{len(digits)}x}"
    it = iter(new.upper() if text == text.upper() and text != text.lower() else new)
    return "".join(next(it) if c in string.hexdigits else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card(key: bytes, text: str, by: int = 1) -> str:
    """A valid card number of the same issuer digit and grouping."""
    digits = "".join(c for c in text if c.isdigit())
    inner = same_format(key, f"card{digits[0]}", digits[1:-1], by)
    new = next(x for x in (digits[0] + inner + str(d) for d in range(10)) if luhn(x))
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban(key: bytes, text: str, by: int = 1) -> str:
    s = text.replace(" ", "")
    inner = same_format(key, f"iban{s[:2]}", s[4:], by)
    check = 98 - int("".join(str(int(c, 36)) for c in inner + s[:2] + "00")) % 97
    it = iter(f"{s[:2]}{check:02d}{inner}")
    return "".join(next(it) if c != " " else c for c in text)


def ipv4(key: bytes, text: str, by: int = 1) -> str:
    """An address with a first number of 1 to 223 if the old one has it, else
    one without."""
    a, *rest = map(int, text.split("."))
    low = int.from_bytes(bytes(rest), "big")
    firsts = range(1, 224) if 1 <= a <= 223 else [0, *range(224, 256)]
    x = shifted(key, f"ip{len(firsts)}", len(firsts) << 24, firsts.index(a) << 24 | low, by)
    return ".".join(map(str, [firsts[x >> 24], *(x & 0xFFFFFF).to_bytes(3, "big")]))


def number(key: bytes, tweak: str, text: str) -> int:
    """A number that depends on the key and the text."""
    return _round(key, tweak, 0, 0, int.from_bytes(text.encode(), "big"))


@lru_cache(maxsize=1 << 16)
def from_list(key: bytes, tweak: str, names: tuple[str, ...], name: str, by: int = 1) -> str:
    return names[shifted(key, tweak, len(names), names.index(name), by)]
