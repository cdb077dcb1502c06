"""Surrogates for personal data: keyed, of the same type and format, one for each entity.

Every replacement is a keyed permutation of all texts of the entity's format. So equal
entities get equal surrogates in every document without a lookup table, different ones
get different surrogates, and none keeps its value. Letters stay letters of their
script, case and sound (vowel or consonant), digits stay digits; numbers with a check
digit keep it right or wrong; given names come from the same gender and script.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# fixed values: letter classes of each script, given names by gender and script, titles by gender
CLASSES = (
    "0123456789",
    "aeiouy",
    "bcdfghjklmnpqrstvwxz",
    "áàâäãåæéèêëíìîïóòôöõøœúùûüýÿ",
    "çñßšžčćłńśź",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρσςτφχψ",
)
GIVEN = {
    ("m", "latin"): "James Michael Robert David William Thomas Richard Charles Daniel Matthew Hans Klaus Jürgen "
    "Wolfgang Günther Pierre Jacques François Philippe Laurent José Carlos Javier Miguel Francisco",
    ("f", "latin"): "Mary Patricia Jennifer Elizabeth Barbara Margaret Dorothy Michelle Katherine Rebecca Ursula "
    "Sabine Heike Gudrun Monika Françoise Brigitte Sylvie Nathalie Véronique María Carmen Pilar Dolores Lucía",
    ("m", "cyrillic"): "Иван Сергей Дмитрий Андрей Алексей Николай Владимир Михаил Павел Виктор",
    ("f", "cyrillic"): "Ольга Елена Наталья Татьяна Ирина Светлана Марина Людмила Галина Екатерина",
}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Sir господин",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Lady госпожа",
    "n": "Dr Prof",
}
_FAMILY_ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин")

_NAMES = {name: (kind, i) for kind, text in GIVEN.items() for i, name in enumerate(text.split())}
_TITLE = {t: g for g, text in TITLES.items() for t in text.split()}
_CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][a-zß-öø-ÿšžčćłńśźœα-ωа-яё]+"
_ALT = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<secret>(?i:\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b[ \t]*[=:][ \t]*)"
    r"(?P<q>[\"']?)(?P<secret_value>[A-Za-z0-9_+/\-]{8,}={0,2})(?P=q))"
    r"|(?P<email>(?<![A-Za-z0-9À-ɏЀ-ӿ._%+\-])[A-Za-z0-9À-ɏЀ-ӿ][A-Za-z0-9À-ɏЀ-ӿ._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<ssn>(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,5}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){5,13}"
    r"|\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))"
    rf"|(?P<person>\b(?:(?P<title>{_ALT(_TITLE)})\.?[ ](?P<first>{_CAP})(?:[ ](?P<last>{_CAP}))?"
    rf"|(?P<given>{_ALT(_NAMES)})[ ](?P<family>{_CAP}))\b)"
)
# an entity stands on one line, which holds one of these marks or a title or given name
_MARK = re.compile(r"[0-9@=:]")
_WORDS = re.compile(r"\w+")
_PEOPLE = frozenset(_NAMES) | frozenset(_TITLE)


class Keyed:
    """Keyed permutations of ``0 .. n-1`` for any ``n``, none of which keeps a value."""

    rounds = 6

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _noise(self, tweak: str, n: int, turn: int, half: int, below: int) -> int:
        data = f"{tweak}|{n}|{turn}|{half}".encode()
        width = (below.bit_length() + 7) // 8 + 8
        out = b"".join(
            hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=64).digest() for i in range(width // 64 + 1)
        )
        return int.from_bytes(out[:width], "big") % below

    def _mix(self, tweak: str, n: int, x: int, forward: bool) -> int:
        """A Feistel network over a grid of at least ``n`` cells, walked until it is inside."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for turn in range(self.rounds) if forward else reversed(range(self.rounds)):
                sign = 1 if forward else -1
                if turn % 2:
                    right = (right + sign * self._noise(tweak, n, turn, left, b)) % b
                else:
                    left = (left + sign * self._noise(tweak, n, turn, right, a)) % a
            x = left * b + right
            if x < n:
                return x

    def moved(self, tweak: str, n: int, x: int) -> int:
        """Where ``x`` goes: one step along a keyed cycle through all values."""
        if n < 2:
            return x
        return self._mix(tweak, n, (self._mix(tweak, n, x, True) + 1) % n, False)


def _class(char: str) -> str | None:
    return next((c for c in CLASSES if char in c), None)


def permuted(keyed: Keyed, kind: str, text: str, alphabet: str | None = None) -> str:
    """``text`` (lower case) moved among all texts of its format.

    Each letter or digit stays in its class, or in ``alphabet`` if it is given and
    holds it; other characters stay.
    """
    classes = [alphabet if alphabet and c in alphabet else _class(c) for c in text]
    size = value = 0
    form = "".join("." if c is None else c[0] for c in classes)
    fixed = "".join(t for t, c in zip(text, classes) if c is None)
    size = 1
    for char, c in zip(text, classes):
        if c:
            value, size = value * len(c) + c.index(char), size * len(c)
    value = keyed.moved(f"{kind}|{form}|{fixed}", size, value)
    out = []
    for char, c in zip(reversed(text), reversed(classes)):
        if c:
            value, at = divmod(value, len(c))
            out.append(c[at])
        else:
            out.append(char)
    return "".join(reversed(out))


def _as_written(new: str, old: str) -> str:
    """``new`` in the case of ``old``, letter by letter."""
    cased = (n.upper() if o != o.lower() and len(n.upper()) == 1 else n for n, o in zip(new, old))
    return "".join(cased)


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refilled(text: str, chars: str) -> str:
    """``text`` with its letters and digits replaced in turn."""
    fresh = iter(chars)
    return "".join(next(fresh) if c.isalnum() else c for c in text)


def _name_part(keyed: Keyed, kind: str, word: str) -> str:
    """A family or unknown given name: letters of the same script and sound; endings that tell gender stay."""
    low = word.lower()
    ending = next((e for e in _FAMILY_ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")
    stem = low[: len(low) - len(ending)]
    new = stem
    for _ in range(64):  # a permutation of the rest: names of the list are walked over
        new = permuted(keyed, kind + ending, new)
        if (new + ending).capitalize() not in _NAMES or new == stem:
            break
    return _as_written(new + ending, word)


def _given(keyed: Keyed, word: str) -> str:
    if word not in _NAMES:
        return _name_part(keyed, "given", word)
    (gender, script), at = _NAMES[word]
    names = GIVEN[gender, script].split()
    return names[keyed.moved(f"given|{gender}|{script}", len(names), at)]


def surrogate(keyed: Keyed, found: re.Match) -> tuple[str, str, str, int, int]:
    """Kind, canonical value, replacement, and the place of what is replaced."""
    kind = found.lastgroup if found.lastgroup in KINDS else next(k for k in KINDS if found[k])
    text = found[kind]
    start, end = found.span(kind)
    if kind == "secret":
        text = found["secret_value"]
        start, end = found.span("secret_value")
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            new = permuted(keyed, "hex", text.lower(), "0123456789abcdef")
            return kind, text.lower(), new.upper() if text.isupper() else new, start, end
        return kind, text, _as_written(permuted(keyed, kind, text.lower()), text), start, end
    if kind == "email":
        local, _, domain = text.lower().partition("@")
        names, _, top = domain.rpartition(".")
        new = permuted(keyed, kind, f"{local}@{names}") + "." + top
        return kind, text.lower(), _as_written(new, text), start, end
    if kind == "ip":
        value = 0
        for part in text.split("."):
            value = value * 256 + int(part)
        new = keyed.moved(kind, 2**32, value)
        return kind, ".".join(str(int(p)) for p in text.split(".")), ".".join(str(new >> s & 255) for s in (24, 16, 8, 0)), start, end
    if kind == "person":
        if found["title"]:
            first, last = found["first"], found["last"]
            if last:
                new = f"{_given(keyed, first)} {_name_part(keyed, 'family', last)}"
                return kind, f"{first} {last}", new, found.start("first"), found.end("last")
            if first in _NAMES:
                return kind, first, _given(keyed, first), found.start("first"), found.end("first")
            return kind, first, _name_part(keyed, "family", first), found.start("first"), found.end("first")
        new = f"{_given(keyed, found['given'])} {_name_part(keyed, 'family', found['family'])}"
        return kind, f"{found['given']} {found['family']}", new, start, end
    plain = "".join(c for c in text if c.isalnum())
    if kind == "card":
        body = permuted(keyed, kind, plain[:-1])
        check = (int(plain[-1]) - _luhn(plain[:-1]) + _luhn(body)) % 10
        return kind, plain, _refilled(text, f"{body}{check}"), start, end
    if kind == "iban":
        body = permuted(keyed, kind, plain[4:].lower()).upper()
        shifted = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        right = shifted(plain[4:] + plain[:4]) == 1
        check = 98 - shifted(body + plain[:2] + "00")
        check = f"{check:02d}" if right else plain[2:4]
        return kind, plain, _refilled(text, plain[:2] + check + body), start, end
    if kind == "phone" and text.startswith("+"):
        kept = 1 if plain[0] in "17" else 2  # the country code stays
        return kind, f"+{plain}", _refilled(text, plain[:kept] + permuted(keyed, kind, plain[kept:])), start, end
    return kind, plain, _refilled(text, permuted(keyed, kind, plain)), start, end


KINDS = ("secret", "email", "iban", "ssn", "card", "phone", "ip", "person")
ENTITY = "array<struct<kind:string,start:int,end:int,surrogate:string,entity:long>>"


def replaced_text(keyed: Keyed, text: str | None) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and what was replaced (places in the text as given)."""
    if not text:
        return text, []
    people = not _PEOPLE.isdisjoint(_WORDS.findall(text))
    if not people and not _MARK.search(text):
        return text, []
    parts, found, at, line = [], [], 0, 0
    while line <= len(text):
        stop = text.find("\n", line)
        stop = len(text) if stop < 0 else stop
        if people or _MARK.search(text, line, stop):
            for match in PATTERN.finditer(text, line, stop):
                kind, value, new, start, end = surrogate(keyed, match)
                parts += [text[at:start], new]
                at = end
                digest = hashlib.blake2b(f"{kind}|{value}".encode(), key=keyed.key, digest_size=8).digest()
                entity = int.from_bytes(digest, "big", signed=True)
                found.append({"kind": kind, "start": start, "end": end, "surrogate": new, "entity": entity})
        line = stop + 1
    return "".join([*parts, text[at:]]), found


def with_surrogates(rows: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``rows`` with surrogates in ``text``, and ``entities``: what was replaced, in order.

    ``entities`` gives kind, place in the given text (code points), surrogate and a keyed
    64-bit digest of the entity, never the entity. One narrow pass: surrogates need only
    the key. A null text stays null, repeated rows are treated alike.
    """
    rest = [c for c in rows.columns if c != text]
    kinds = StructType.fromDDL(f"entities {ENTITY}")
    schema = StructType([*rows.select(*rest).schema.fields, *StructType().add("text", StringType()).fields, *kinds.fields])
    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("entity", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for batch in batches:
            done = [replaced_text(keyed, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([t for t, _ in done], pa.string()), pa.array([f for _, f in done], pa.list_(item))],
                [*rest, "text", "entities"],
            )

    return rows.select(F.col(text).cast("string"), *rest).mapInArrow(run, schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """Kinds and surrogates that stand for several entities, and entities with several surrogates.

    The check over the whole corpus: entities are counted by digest, letter case and
    punctuation aside, combined map-side. Empty if distinctness and coreference hold.
    """
    new = F.col("e.surrogate")
    same = (
        F.when(F.col("e.kind").isin("card", "iban", "phone", "ssn"), F.regexp_replace(new, r"[ ().\-]", ""))
        .when(F.col("e.kind") == "email", F.lower(new))
        .when(new.rlike("^[0-9A-F]+$"), F.lower(new))
        .otherwise(new)
    )
    each = replaced.select(F.explode("entities").alias("e")).select("e.kind", same.alias("surrogate"), "e.entity")
    seen = each.distinct()
    shared = seen.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("surrogate").alias("value"), "n")
    split = seen.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("entity").cast("string").alias("value"), "n")
    return shared.unionByName(split)


def checked_surrogates(rows: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """:func:`with_surrogates`, after the collision check over all rows; an error if it fails.

    The permutations rule collisions out; the check guards the letter classes, the name
    lists and the formats against mistakes before a corpus is written.
    """
    found = collisions(with_surrogates(rows, key, text)).limit(5).collect()
    if found:
        raise ValueError(f"surrogates collide: {found}")
    return with_surrogates(rows, key, text)
