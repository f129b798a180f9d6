"""Personal data: detection, and surrogates in its place.

Each detected entity gets a replacement of its type that depends on the secret key
and the entity alone, by a permutation of the strings of its format (see
:mod:`onset.llm.surrogates`): the same entity has the same surrogate in all
documents, and different entities of a type and format have different ones. Names
keep gender, script and case, cards and bank accounts their check digits, addresses
and keys their format.

Within a document a surrogate is checked against the other surrogates and against
the words that stay. A name that collides gets one that no first draw gives: a given
name of ``SPARE``, which are not detected and so no one's first surrogate, or a
family name of three parts. It is the same wherever that name collides. Other types
keep their surrogate: two of different types that look alike stand for two entities
still, since they replace strings that looked alike too or by a chance of one in the
size of their format. :func:`collisions` counts what is left over a whole table.

Whoever has the key can undo the permutations, so it is no part of the program:
:func:`session_key` takes it from a setting.

Defined cases: a null text stays null and has no entities; an empty text stays
empty; texts of any length are read whole; overlapping matches go to the one that
begins first, then to the longer; repeated rows each return; an empty table gives
an empty result; further columns are carried by :func:`with_surrogates`.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onset.llm import surrogates as S
from onset.llm.common import bound_batches, release

#: The setting of the key, in hexadecimal. Spark hides settings of that name.
KEY_SETTING = "spark.onset.surrogates.secret"
#: Given names by gender and script: what is detected, and what stands for it.
GIVEN = {
    ("f", "latin"): tuple("Mary Patricia Jennifer Linda Barbara Susan Jessica Margaret Sarah Karen Nancy Lisa Emma Olivia Emily Hannah Laura Julia Alice Charlotte Elizabeth Rachel Helen Sophie Camille Chloé Élodie Claire Marie Yvonne Ursula Monika Sabine Petra Heike Katharina Ingrid Carmen Lucía Beatriz Pilar Elena Isabel Ana".split()),
    ("m", "latin"): tuple("James John Robert Michael William David Joseph Charles Thomas Daniel Matthew Mark Paul Steven Andrew George Edward Peter Henry Oliver Jack Samuel Jacques François Philippe Pierre Antoine Étienne Wolfgang Jürgen Klaus Hans Stefan Andreas Matthias Günther Pablo Javier Miguel Carlos José Luis Diego Fernando".split()),
    ("f", "cyrillic"): tuple("Анна Мария Ольга Татьяна Наталья Светлана Екатерина Людмила Елена Ирина Юлия Марина".split()),
    ("m", "cyrillic"): tuple("Иван Сергей Дмитрий Алексей Николай Владимир Михаил Юрий Александр Андрей Павел Максим".split()),
    ("f", "greek"): tuple("Μαρία Ελένη Κατερίνα Σοφία Δήμητρα Βασιλική Άννα Ειρήνη".split()),
    ("m", "greek"): tuple("Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης Γιάννης Μιχάλης".split()),
}
#: Names of the same kinds that are not detected, for those whose surrogate collides.
SPARE = {
    ("f", "latin"): tuple("Perpetua Ermintrude Philippa Rosalind Clotilde Walburga Edeltraud Eufemia".split()),
    ("m", "latin"): tuple("Algernon Peregrine Barnaby Thaddeus Hippolyte Ottokar Wendelin Anselmo".split()),
    ("f", "cyrillic"): tuple("Пелагея Аглая Фёкла Марфа".split()),
    ("m", "cyrillic"): tuple("Еремей Пахом Савелий Лука".split()),
    ("f", "greek"): tuple("Κλεοπάτρα Ευδοκία Θάλεια Αριάδνη".split()),
    ("m", "greek"): tuple("Αρίσταρχος Λεωνίδας Περικλής Θεόφιλος".split()),
}
#: Titles before a name, with the gender that they tell.
TITLES = {"Mr": "m", "Mr.": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Dr.": "", "Prof.": ""}
_GENDER = {name: where for where, names in GIVEN.items() for name in names}
_UPPER = {name.upper(): name for name in _GENDER if name.upper() not in _GENDER}
_CAP = r"[^\W\d_a-zà-ÿ][^\W\d_]+"
_given = "|".join(sorted(map(re.escape, [*_GENDER, *_UPPER]), key=len, reverse=True))
_titles = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
PERSON = re.compile(rf"\b(?:(?P<title>{_titles}) (?:(?P<g1>{_given}) )?(?P<f1>{_CAP}(?:-{_CAP})?)|(?P<g2>{_given}) (?P<f2>{_CAP}(?:-{_CAP})?))(?!\w)")
#: One of these words must be in a text that has a person; to look the words up is
#: cheaper than the pattern.
_HINTS = frozenset(re.findall(r"\w+", " ".join([*TITLES, *_GENDER, *_UPPER])))

_DIGIT, _WORD = re.compile(r"\d"), re.compile(r"\w+")
PATTERNS = [
    ("ipv4", re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)", re.A)),
    ("card", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", re.A)),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])", re.A)),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A)),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.A)),
    ("key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A)),
]
#: Types that may have no digit, and what their text must hold, looked for first.
MAC = re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b(?![:-])", re.A)
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])", re.A)
#: User and password of an address.
USERINFO = re.compile(r"://([^\s/:@?#]+):([^\s/@]+)@")
NEEDS = {"ipv4": ".", "ssn": "-"}
#: Types with check digits: how many letters and digits at least, and the check.
CHECKED = {"card": (13, lambda x: S.luhn(re.sub(r"\D", "", x))), "iban": (15, S.iban_valid)}
#: A value in quotes goes to the closing one. Others go to white space, a tag or the
#: next name and value, less the symbols at their end.
SECRET = re.compile(
    r"(?i)(?<![^\W_])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}"
    r"(?:\"((?:\\.|[^\"\\\n]){6,})\"|'((?:\\.|[^'\\\n]){6,})'|[\"']?((?:(?![&,;|][\"']?\w+[\"']?[=:]|</?\w+>)\S){6,}(?<![\"'#*$%&|<>,;])))"
)
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
_LOCAL, _DOMAIN = re.compile(r"[\w.%+'-]"), re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        right = _DOMAIN.match(text, at + 1)
        if right:
            start = at  # no letter of a local part is @, so each is looked at once
            while start and _LOCAL.match(text[start - 1]):
                start -= 1
            while start < at and text[start] in ".'-%+":
                start += 1
            if start < at:
                yield start, right.end()
        at = text.find("@", at + 1)


def _checked(pattern: re.Pattern, text: str, least: int, valid: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Of each start of a match the longest part of ``least`` letters and digits or
    more that ends with a group and has right check digits."""
    at = 0
    while m := pattern.search(text, at):
        a, at = m.start(), m.start() + 1
        for b in range(m.end(), a, -1):
            if text[b - 1].isalnum() and not text[b : b + 1].isalnum() and sum(c.isalnum() for c in text[a:b]) >= least and valid(text[a:b]):
                yield a, b
                at = b
                break


def _ipv6(text: str) -> bool:
    """An address, of four groups or with a digit, so that no word is one."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text) or sum(map(bool, text.split(":"))) >= 4


def entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of each entity, in order and apart from each other."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in PATTERNS:
            if NEEDS.get(kind, "") not in text:
                continue
            if kind in CHECKED:
                found += [(a, b, kind) for a, b in _checked(pattern, text, *CHECKED[kind])]
                continue
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if text.count(":") > 4 or text.count("-") > 4:
        found += [(m.start(), m.end(), "mac") for m in MAC.finditer(text)]
    if "::" in text or text.count(":") >= 7:
        found += [(m.start(), m.end(), "ipv6") for m in IPV6.finditer(text) if _ipv6(m[0])]
    if "@" in text and "://" in text:
        found += [(*m.span(g), "secret") for m in USERINFO.finditer(text) for g in (1, 2) if any(c.isalnum() for c in m[g])]
    if "=" in text or ":" in text:
        found += [(*m.span(m.lastindex), "secret") for m in SECRET.finditer(text) if any(c.isalnum() for c in m[m.lastindex])]
    if "PRIVATE KEY" in text:
        found += [(m.start() + m[0].index("\n") if "\n" in m[0] else m.start(), m.end() - len(m[0]) + m[0].rindex("-----END"), "secret") for m in PEM.finditer(text)]
    if not _HINTS.isdisjoint(_WORD.findall(text)):
        families = set()
        for m in PERSON.finditer(text):
            name = "g1" if m["g1"] else "g2" if m["g2"] else None
            if name:
                found.append((*m.span(name), "given"))
            family = "f1" if m["f1"] else "f2"
            families.add(m[family])
            found.append((*m.span(family), "family"))
        if families:  # later mentions by the family name alone
            again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, families), key=len, reverse=True)) + r")(?!\w)")
            found += [(*m.span(), "family") for m in again.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def _given_name(key: bytes, tweak: str, names: dict, text: str) -> str:
    """Another name of the gender, script and case."""
    plain = _UPPER.get(text, text)
    known, to = GIVEN[_GENDER[plain]], names[_GENDER[plain]]
    new = S.from_list(key, tweak, to, plain) if to is known else to[S.number(key, tweak, plain) % len(to)]
    return new.upper() if plain != text else new


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        return f"{S.same_format(key, 'local', local)}@{'.'.join([*(S.same_format(key, 'label', x) for x in labels[:-1]), labels[-1]])}"
    if kind == "card":
        return S.card(key, text)
    if kind == "iban":
        return S.iban(key, text)
    if kind == "ipv4":
        return S.ipv4(key, text)
    if kind == "phone" and text[0] == "+":  # the country stays
        country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)[0]
        return country + S.same_format(key, f"phone{country}", text[len(country) :])
    if kind == "key":
        head = re.match(r"[A-Z]{4}|[a-z]+[-_]", text)[0]
        return head + S.same_format(key, head, text[len(head) :])
    if kind == "given":
        return _given_name(key, "given", GIVEN, text)
    if kind in ("mac", "ipv6"):
        return S.hexadecimal(key, kind, text)
    if kind == "secret":  # hexadecimal ones among themselves, so the two ways never meet
        if _HEX.fullmatch(text):
            return S.until(lambda x: S.hexadecimal(key, kind, x), text, lambda x: x.isdigit() == text.isdigit())
        new = S.until(lambda x: S.same_format(key, kind, x), text, lambda x: not _HEX.fullmatch(x))
        # no letter has another of its kind: text of the same length by its digest
        return new if new != text else hashlib.blake2b(text.encode(), key=key[:64], digest_size=32).hexdigest() * (len(text) // 64 + 1)
    return S.same_format(key, kind, text)


def second(kind: str, text: str, key: bytes) -> str | None:
    """What no first surrogate of the type can be; null for types without it."""
    if kind == "given":
        return _given_name(key, "spare", SPARE, text)
    if kind == "family":
        parts = [surrogate(kind, text, hashlib.blake2b(key, person=bytes([i]), digest_size=32).digest()) for i in range(2)]
        return "-".join([surrogate(kind, text, key), *(x.replace("-", "") for x in parts)])
    return None


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities at their old places."""
    new, spans = _replace(text, key)
    return new, [x[:3] for x in spans]


def _replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    spans = entities(text) if text else []
    if not spans:
        return text, []
    chosen: dict[tuple[str, str], str] = {}
    for a, b, kind in spans:
        if (kind, text[a:b]) not in chosen:
            chosen[kind, text[a:b]] = surrogate(kind, text[a:b], key)
    names = [x for x in chosen if x[0] in ("given", "family")]
    if names:
        gaps = zip([0, *(b for _, b, _ in spans)], [*(a for a, _, _ in spans), len(text)], strict=True)
        stay = {w for a, b in gaps for w in _WORD.findall(text[a:b])}
        often = Counter(chosen.values())
        for x in names:
            if chosen[x] in stay or often[chosen[x]] > 1:
                chosen[x] = second(*x, key)
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], chosen[kind, text[a:b]]]
        at = b
    return "".join([*parts, text[at:]]), [(a, b, kind, chosen[kind, text[a:b]]) for a, b, kind in spans]


def session_key(spark: SparkSession) -> bytes:
    """The key of ``KEY_SETTING``; where it is unset, one that is drawn for this
    session and kept there. Set it to have the same surrogates in other sessions."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, named)
    return bytes.fromhex(named)


def _mark(key: bytes, *parts: str) -> int:
    """A keyed digest as a long, which tells entities apart and no more."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), key=key, person=b"mark", digest_size=8).digest(), "big", signed=True)


def with_surrogates(docs: DataFrame, text: str = "text", key: bytes | None = None, found: str = "pii") -> DataFrame:
    """``docs`` with the surrogates in ``text``, and a column ``found`` of the
    entities: an array of start, end (in the old text), type, and keyed digests of
    the entity and of its surrogate. ``key``: :func:`session_key` by default."""
    key = key or session_key(docs.sparkSession)
    bound_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("old", pa.int64()), ("new", pa.int64())])

    @F.arrow_udf("text string, found array<struct<start: int, end: int, type: string, old: long, new: long>>")
    def run(texts: pa.Array) -> pa.Array:
        release()
        new, found = [], []
        for old in texts.to_pylist():
            text, spans = _replace(old, key)
            new.append(text)
            found.append([{"start": a, "end": b, "type": k, "old": _mark(key, k, old[a:b]), "new": _mark(key, k, x)} for a, b, k, x in spans])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(found, pa.list_(span))], ["text", "found"])

    made = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), run(docs[text]).alias("made"))
    return made.select(*(F.col("made.text" if c == text else f"doc.`{c}`").alias(c) for c in docs.columns), F.col("made.found").alias(found))


def table_collisions(done: DataFrame, found: str = "pii") -> DataFrame:
    """:func:`collisions` of the result of :func:`with_surrogates`: ``type``, ``new``,
    and the digests of two entities that it stands for."""
    rows = done.select(F.explode(found).alias("x")).select("x.type", "x.old", "x.new")
    return collisions(rows, "type", "old", "new")


def collisions(rows: DataFrame, kind: str, old: str, new: str) -> DataFrame:
    """Surrogates that stand for more than one entity of a type, of rows of type,
    entity and surrogate. Empty where distinctness held."""
    return rows.groupBy(kind, new).agg(F.min(old).alias("least"), F.max(old).alias("most")).where("least <> most")
