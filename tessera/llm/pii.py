"""Surrogates for personal data: what is found in a text is replaced by something of the same kind and shape.

How it scales: detection and replacement are one narrow pass without any table of entities. A surrogate is a keyed permutation of the entity's own format, so equal
entities get equal surrogates everywhere and different ones different ones, by construction, in any number of tasks. A check over the corpus, one aggregation of
different pairs, confirms that before texts are replaced, and takes another key if it fails.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network; longer entities are replaced in parts of so many characters.
ROUNDS, CHUNK = 8, 64

#: First names by script and gender: fixed values, a name is replaced by another of its list.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Clara Diana Elena Emma Eva Fiona Greta Hanna Helena Irene Isabel Julia Karen Laura Lena Linda Lucia Maria Marta Mary Monica Nina Nora Olivia Paula Rosa Sandra Sara Silvia Sofia Susan Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Andreas Anton Bruno Carl Carlos Daniel David Diego Eric Felix Frank Georg Henry Hugo Jacob James John Jonas Jorge Joseph Karl Leon Louis Lucas Luis Marc Martin Max Michael Oscar Paul Peter Pierre Robert Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
#: Titles that show a name, and endings of names that show gender or descent and stay; none of these ends in another: fixed values.
TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Dr", "Prof", "г-н", "г-жа")
ENDINGS = ("ова", "ева", "ина", "ская", "цкая", "ов", "ев", "ин", "ский", "цкий", "ович", "евич", "овна", "евна", "ova", "eva", "ina", "ska", "skaya", "ov", "ev", "ski", "sky", "skiy", "ovich", "ovna", "sson", "sdóttir", "opoulos", "opoulou")
VOWELS = frozenset("aeiouyаеёиоуыэюяіїєαεηιουω")
#: Keys that the check over a corpus may try, one after the other.
KEYS = 8

#: Kinds in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": r"""(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*)["']?(?P<secret>[A-Za-z0-9_+/.=-]{8,})["']?""",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{40,64}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # without + or brackets, not what a number in groups of thousands looks like
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])|\(\d{2,4}\)[ .-]?|(?<!\d[ .])(?!\d{1,2}(?P<by>[ .])\d{3}(?:(?P=by)\d{3})*(?![\w-]))(?!\d{1,3}(?P<of>[ .])000(?:(?P=of)000)*(?!\w))\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.])\+\d{8,15}(?!\w)",
    "name": r"\b(?P<title>" + "|".join(TITLES) + r")\.? (?P<name>[^\W\d_a-zа-я]\w+(?:-[^\W\d_]\w+)?(?: [^\W\d_a-zа-я]\w+)?)",
}
DETECT = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these has no entity. Arrow's \b and \d know ASCII alone, so neither is used.
HINT = r"@|\p{Nd}|[A-Za-z0-9_-]{20}|xox[abprs]-|eyJ|(?i:token|secret|passw|pwd|api.?key|access.?key)|(?:" + "|".join(TITLES) + r")\.? "

#: Names that are replaced by others of their list, and beginnings of keys that keep them.
LISTED = frozenset(n for listed in NAMES.values() for n in listed)
KNOWN = re.compile(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|[0-9a-f]+$")

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Everyday alphabets of other scripts; what is in none is replaced within its block, script and case.
_PLAIN = ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: Scripts without spaces between words.
_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR")


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0].partition("-")[0]


@lru_cache(100_000)
def alphabet(c: str) -> str:
    """The characters that may stand for a letter or digit: the set that it is in itself, so these sets are disjoint. Anything else has none."""
    for known in (_DIGITS, _LOWER, _UPPER, *_PLAIN):
        if c in known:
            return known
    if c.isascii() or not (c.isalpha() or c.isdecimal()):
        return ""
    kind, script, block = unicodedata.category(c), _script(c), ord(c) & ~0xFF
    same = (chr(k) for k in range(block, block + 256) if unicodedata.category(chr(k)) == kind and _script(chr(k)) == script)
    return "".join(x for x in same if not any(x in known for known in _PLAIN))


@lru_cache(100_000)
def spoken(c: str) -> str:
    """`alphabet` less what is a vowel where `c` is none, or the other way round, so that a name can still be said."""
    vowel = lambda x: unicodedata.normalize("NFD", x)[0].lower() in VOWELS
    return "".join(x for x in alphabet(c) if vowel(x) == vowel(c))


def ending(name: str) -> str:
    """The ending of a name that stays: one of ENDINGS after two letters or more."""
    return next((e for e in ENDINGS if name.endswith(e) and len(name) >= len(e) + 2), "")


def canonical(iban: str) -> bool:
    """Whether the two check digits are those that ISO 7064 gives for the rest."""
    plain = iban.replace(" ", "")
    return plain[2:4] == with_check97(plain[:2], plain[4:])[2:4]


def with_check97(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


class Surrogates:
    """Keyed replacements."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(100_000)(self._of)

    def number(self, label: str, x: int, size: int) -> int:
        """A keyed permutation of range(size): a Feistel network over the next even number of bits, walked until it is back in range."""
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            a, b = x >> half, x & ((1 << half) - 1)
            for k in range(ROUNDS):
                mixed = hmac.new(self.key, f"{label}|{size}|{k}|{b}".encode(), sha256).digest()
                a, b = b, a ^ (int.from_bytes(mixed, "little") & ((1 << half) - 1))
            x = a << half | b
            if x < size:
                return x

    def other(self, label: str, x: int, size: int) -> int:
        """The same without fixed points, for size > 1: a permutation conjugated with a turn by one."""
        if size < 2:
            return x
        spot = self.place(label, x, size)
        return self.number(label, (spot + 1) % size, size)

    def place(self, label: str, x: int, size: int) -> int:
        """The inverse of `number`."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            a, b = x >> half, x & ((1 << half) - 1)
            for k in reversed(range(ROUNDS)):
                mixed = hmac.new(self.key, f"{label}|{size}|{k}|{a}".encode(), sha256).digest()
                a, b = b ^ (int.from_bytes(mixed, "little") & ((1 << half) - 1)), a
            x = a << half | b
            if x < size:
                return x

    def shaped(self, label: str, text: str, hexadecimal: bool = False, letters: Callable[[str], str] = alphabet) -> str:
        """Digits, small and capital letters each replaced by others of their kind and script, all else kept; different texts of one shape stay different."""
        if len(text) > CHUNK:
            return "".join(self.shaped(f"{label}|{k}", text[k : k + CHUNK], hexadecimal, letters) for k in range(0, len(text), CHUNK))
        sets = [(_HEX if c in _HEX else "") if hexadecimal else letters(c) for c in text]
        x, size = 0, 1
        for c, s in zip(text, sets, strict=True):
            if s:
                x, size = x * len(s) + s.index(c), size * len(s)
        shape = "".join("." if s else c for c, s in zip(text, sets, strict=True)) + "".join(s[:1] for s in sets)
        x, out = self.other(f"{label}|{shape}", x, size), []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                x, k = divmod(x, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def _of(self, kind: str, entity: str) -> str:
        if kind == "email":
            name, host = entity.rsplit("@", 1)
            *labels, top = host.split(".")
            return f"{self.shaped('user@' + host, name)}@{'.'.join([*labels[:-1], self.shaped('host', labels[-1])])}.{top}"
        if kind in ("ip", "card") and not entity.isascii():
            return self.shaped(kind, entity)
        if kind == "ip":
            return ".".join(str(b) for b in self.other("ip", int.from_bytes(bytes(map(int, entity.split("."))), "big"), 1 << 32).to_bytes(4, "big"))
        if kind == "card" and luhn(entity):
            digits = [c for c in entity if c.isdigit()]
            return refill(entity, with_check(self.shaped("card" + digits[0], "".join(digits[1:-1])), digits[0]))
        if kind == "card":
            return self.walked("card", entity, luhn)
        if kind == "iban":
            plain = entity.replace(" ", "")
            if not entity.isascii() or not canonical(entity):
                return entity[:2] + self.walked("iban" + entity[:2], entity[2:], lambda x: x.isascii() and canonical(entity[:2] + x))
            new = iter(with_check97(plain[:2], self.shaped("iban" + plain[:2], plain[4:])))
            return "".join(c if c == " " else next(new) for c in entity)
        if kind == "phone":
            lead = re.match(r"\+\d{1,3}(?=[ .(-])", entity)
            keep = lead.end() if lead else entity.startswith("+")
            return entity[:keep] + self.shaped("phone" + entity[:keep], entity[keep:])
        if kind == "key":
            lead = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|", entity).end()
            return entity[:lead] + self.shaped("secret" + entity[:lead], entity[lead:], bool(re.fullmatch("[0-9a-f]+", entity)))
        if kind == "secret":
            return self.walked(kind, entity, KNOWN.match) if not re.fullmatch("[0-9a-f]+", entity) else self.shaped(kind, entity, True)
        if kind == "name":
            return " ".join(map(self.name, entity.split(" ")))
        return self.shaped(kind, entity)

    def walked(self, label: str, text: str, taken: Callable[[str], object], letters: Callable[[str], str] = alphabet) -> str:
        """`shaped`, again and again until the result is none that another rule may give: a permutation of the texts that are not `taken`."""
        text = self.shaped(label, text, letters=letters)
        while taken(text):
            text = self.shaped(label, text, letters=letters)
        return text

    def name(self, name: str) -> str:
        """A listed first name becomes another of its list, so of its script and gender, whatever its title; any other name one of the same shape.

        Vowels become vowels of the script and other letters others, and an ending that shows gender stays.
        """
        for listed in NAMES.values():
            if name in listed:
                return listed[self.other("name" + listed[0], listed.index(name), len(listed))]
        if tail := ending(name):
            return self.walked("name" + tail, name.removesuffix(tail), lambda x: x + tail in LISTED, spoken) + tail
        return self.walked("name", name, lambda x: x in LISTED or ending(x), spoken)


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def with_check(middle: str, first: str) -> str:
    return next(first + middle + d for d in _DIGITS if luhn(first + middle + d))


def refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def entities(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, from, to) of what is found, from left to right; the parts of a name that stands after a title are names wherever else the text has them."""
    found, parts = [], set()
    for m in DETECT.finditer(text):
        kind = next(k for k in PATTERNS if m.group(f"k_{k}") is not None)
        a, b = m.span(kind if kind in ("secret", "name") else f"k_{kind}")
        found.append((kind, a, b))
        if kind == "name":
            parts.update(text[a:b].split(" "))
    if parts:
        bounded = lambda x: re.escape(x) if _script(x[0]) in _UNSPACED else rf"(?<!\w){re.escape(x)}(?!\w)"
        mention, at, more = re.compile("|".join(map(bounded, sorted(parts, key=lambda x: (-len(x), x))))), 0, []
        for a, b in [*((a, b) for _, a, b in found), (len(text), len(text))]:
            more += [("name", m.start(), m.end()) for m in mention.finditer(text, at, a)]
            at = b
        found = sorted(found + more, key=lambda x: x[1])
    yield from found


def replaced(text: str, surrogates: Surrogates) -> tuple[str, Counter]:
    """The text with surrogates, and how many entities of each kind it had."""
    out, at, kinds = [], 0, Counter()
    for kind, a, b in entities(text):
        out += [text[at:a], surrogates.of(kind, text[a:b])]
        at = b
        kinds[kind] += 1
    return "".join([*out, text[at:]]), kinds


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """(surrogate, n_entities, is_entity): surrogates that stand for several different entities of `docs` (doc_id, text), or that are entities of the corpus themselves.

    The check over the whole corpus: different entities meet by hash of the surrogate, combined on the map side. By construction no row has n_entities over 1; one
    with is_entity says that a surrogate happens to be somebody else's: another key avoids it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key.encode())
        for batch in batches:
            texts = batch.column(0).filter(pc.match_substring_regex(pc.fill_null(batch.column(0), ""), HINT)).to_pylist()
            found = {(surrogates.of(kind, text[a:b]), text[a:b]) for text in texts for kind, a, b in entities(text)}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["surrogate", "entity"])

    pairs = docs.select("text").mapInArrow(run, "surrogate string, entity string").distinct()
    made, own = F.struct("surrogate", F.lit(1).alias("n"), F.lit(False).alias("own")), F.struct(F.col("entity").alias("surrogate"), F.lit(0).alias("n"), F.lit(True).alias("own"))
    met = pairs.select(F.inline(F.array(made, own))).groupBy("surrogate").agg(F.sum("n").alias("n_entities"), F.bool_or("own").alias("is_entity"))
    return met.where("n_entities > 1 or (n_entities = 1 and is_entity)")


def distinct_key(docs: DataFrame, key: str) -> str:
    """`key`, or the first of those made from it for which no two different entities of `docs` share a surrogate."""
    for turn in range(KEYS):
        tried = f"{key}|{turn}" if turn else key
        if not collisions(docs, tried).where("n_entities > 1").limit(1).count():
            return tried
    raise ValueError("no key keeps the surrogates of different entities apart")


def surrogated(docs: DataFrame, key: str) -> DataFrame:
    """`docs` (doc_id, text and other columns) with `text` less its personal data, and with n_entities (int) and entities, a map from kind to number.

    Kinds: email, secret, key, iban, ip, card, ssn, phone, name (after a title, and its parts elsewhere in that text). A surrogate depends on `key`, kind and entity alone, so coreference holds across
    the corpus; within a format the mapping is a permutation, so different entities stay different, which is checked over `docs` before it is used (`distinct_key`). Domain
    levels above the last but one, country codes, card networks' first digits and the validity of check digits (cards, IBANs) are kept. Defined cases: a null text stays null and an empty one
    empty, with no entities; repeated rows get equal texts; a null doc_id changes nothing; columns n_entities and entities that were there are replaced; an empty
    table gives no rows.
    """
    docs = docs.drop("n_entities", "entities")
    key = distinct_key(docs, key)
    names = docs.columns
    spot = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key.encode())
        for batch in batches:
            column = batch.column(spot)
            hint = pc.match_substring_regex(pc.fill_null(column, ""), HINT).to_numpy(zero_copy_only=False)
            texts, found = [], []
            for value, look in zip(column, hint, strict=True):
                text, kinds = replaced(value.as_py(), surrogates) if look else (value, {})
                texts.append(text if look else value.as_py())
                found.append(list(kinds.items()))
            columns = list(batch.columns)
            columns[spot] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sum(n for _, n in x) for x in found], pa.int32()), pa.array(found, pa.map_(pa.string(), pa.int32()))], [*names, "n_entities", "entities"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_entities", T.IntegerType()), T.StructField("entities", T.MapType(T.StringType(), T.IntegerType()))]))
