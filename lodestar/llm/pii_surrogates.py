"""Personal data replaced by surrogates: keyed, of the same type and format, distinct and consistent.

An entity is a type and a value. Its surrogate comes from a keyed hash, so it is the same
wherever the value stands and can't be traced back without the key. Entities of the corpus are
then held against each other: a surrogate that is some entity's value, or another entity's
surrogate, is drawn again, so different values stay different. Names are drawn by their words:
a word has one surrogate in the whole corpus, so full names, family names and later mentions
without an honorific still agree.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import removed, written
from .common import fresh, join_frequent, prepare, slices, stable, with_fields

#: Draws that keep the format; later ones, when a format is nearly used up, make the surrogate longer, so that they always end.
SAME_FORMAT_DRAWS = 12
#: Entities of texts that are broadcast to them, and entities of one value that one task may join.
FEW_ENTITIES, OFTEN = 1 << 20, 1 << 15

# Honorifics by gender (f, m), and letters that make names in a script.
HONORIFICS = {"Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Господин": "m", "Госпожа": "f", "Dr": "n", "Prof": "n", "Professor": "n"}
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v".split(), "a e i o u".split(), {"f": "a", "m": "n"}),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), {"f": "а", "m": "н"}),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ".split(), "α ε ι ο υ".split(), {"f": "α", "m": "ς"}),
    "armenian": ("բ գ դ զ լ կ հ մ ն պ ս տ ր".split(), "ա ե ի ո".split(), {"f": "ա", "m": "ն"}),
}

#: Words inside names that stay as they are: particles before a family name, and what follows it.
PARTICLES = frozenset("van von der den dem zu zur de del della di da dos das du la le les las los y e bin ibn al el d l".split())
SUFFIXES = frozenset(("Jr", "Sr", "II", "III", "IV"))
#: Capitals by which initials of a script are exchanged; other scripts have those near their letters.
CAPITALS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
#: Characters around a letter among which the other letters of its script are looked for.
BLOCK = 128

_LETTERS = r"(?:[^\W\d_][\u0300-\u036f]*)+"
_NAME = rf"{_LETTERS}(?:[-'’]{_LETTERS})*"
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"), 0),
    ("aws_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), 0),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})"), 1),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"), 0),
    ("ipv6", re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.]*[\w:])"), 0),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]?\d{5,8})(?!\d)"), 0),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0),
    ("card", re.compile(r"(?<![\d.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])"), 0),
    ("name", re.compile(r"\b(?:" + "|".join(sorted(HONORIFICS, key=len, reverse=True)) + r")\.?(?:[ \u00a0]{1,3}|[ \u00a0]?\r?\n[ \u00a0]{0,3})(?:(?:Dr|Prof|Dipl|Ing|Mag|med|rer|nat|phil|jur|habil)\b\.?[- \u00a0])*"), 0),
]
#: Words that a person's own name follows, in any language of the patterns.
INTRODUCTIONS = ("my name is", "My name is", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo")
_INTRODUCED = re.compile(r"(?<!\w)(?:" + "|".join(INTRODUCTIONS) + r")[ \u00a0]")
_DIGIT, _WORDY = re.compile(r"\d"), re.compile(r"(?i)passw|pwd|secret|token|api.?key|access.?key")
_HONOR = re.compile("|".join(sorted(HONORIFICS, key=len, reverse=True)))
_WORD, _PART, _TOKEN = re.compile(_NAME), re.compile(_LETTERS), re.compile(rf"(?<!\w){_NAME}(?!\w)")
_OWNED, _BETWEEN = re.compile(r"['’]s?$"), re.compile(r"\.?\s{0,2}")


def luhn(digits: str) -> int:
    """What the Luhn sum of digits is short of a multiple of ten; 0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _holds(kind: str, value: str) -> bool:
    if kind == "card":
        return 13 <= sum(c.isdigit() for c in value) <= 19
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15
    if kind == "ipv6":
        return any(c.isdigit() for c in value) and value.count(":") <= 7
    if kind == "iban":
        plain = value.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return bool(value)


def _capital(word: str) -> bool:
    return any(p[:1].isupper() for p in re.split("[-'’]", word))


def _name_end(text: str, start: int) -> int:
    """Where the run of capitalised words, initials and particles from start ends; start if there is none."""
    at = end = start
    while m := _WORD.match(text, at):
        word = _OWNED.sub("", m[0]) if m[0][-1] == "s" else m[0]
        if _capital(word):
            end = m.start() + len(word)
        elif word not in PARTICLES:
            break
        if end == m.start() + len(word) < m.end():  # Smith's
            break
        at = m.end()
        if len(word) == 1 and _capital(word) and text[at : at + 1] == ".":
            at += 1
            if text[at : at + 1] not in (" ", "\u00a0"):  # J.R. Smith
                continue
        if text[at : at + 1] not in (" ", "\u00a0"):
            break
        at += 1
    return end


def _word_key(word: str) -> str:
    """What words of one spelling share: SMITH is Smith."""
    return word.capitalize() if len(word) > 1 and word.isupper() else word


def _core(value: str) -> list[re.Match]:
    """A name's words without particles and suffixes, the family name last."""
    words = list(_WORD.finditer(value))
    return [w for w in words if w[0] not in PARTICLES and w[0] not in SUFFIXES] or words[-1:]


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions, outside of found, of its names: all words, the first and the last, or the family name alone."""
    known: dict[tuple[str, ...], str] = {}
    for _, _, kind, value in found:
        if kind.startswith("name_"):
            core = [_word_key(w[0]) for w in _core(value)]
            every = [_word_key(w[0]) for w in _WORD.finditer(value)]
            for words in (every, core, [core[0], core[-1]], core[-1:]):
                if len(words) > 1 or len(words[0]) > 1:  # a lone letter is no mention
                    known.setdefault(tuple(words), kind)
    if not known:
        return []
    lengths: dict[str, set[int]] = {}
    for words in known:
        lengths.setdefault(words[0], set()).add(len(words))
    covered = bytearray(len(text))
    for s, e, _, _ in found:
        covered[s:e] = b"\1" * (e - s)
    tokens = []
    for m in _TOKEN.finditer(text):
        bare = _OWNED.sub("", m[0]) if m[0][-1] == "s" else m[0]
        tokens.append((m.start(), m.start() + len(bare), _word_key(bare)))
    out, i = [], 0
    while i < len(tokens):
        start, step = tokens[i][0], 1
        for n in sorted(lengths.get(tokens[i][2], ()), reverse=True):
            run = tokens[i : i + n]
            kind = known.get(tuple(w for _, _, w in run))
            if kind and not any(covered[start : run[-1][1]]) and all(_BETWEEN.fullmatch(text, a[1], b[0]) for a, b in zip(run, run[1:], strict=False)):
                out.append((start, run[-1][1], kind, text[start : run[-1][1]]))
                step = n
                break
        i += step
    return out


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) in order; where two overlap, the earlier pattern of the list wins.

    A name is the whole run of capitalised words and initials behind an honorific or an
    introduction ("my name is") and has the honorific's gender in its type, n if it has none. Where the text has it again, in full or its family name
    alone, that is an entity too.
    """
    if not text:
        return []
    digit, wordy, honor = _DIGIT.search(text), _WORDY.search(text), _HONOR.search(text)
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, group in PATTERNS:
        if (kind == "email" and "@" not in text) or (kind == "secret" and not wordy) or (kind == "name" and not honor) or (kind not in ("email", "secret", "name") and not digit):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(group)
            value, named = m[group], kind
            if kind == "name":
                start, end = m.end(), _name_end(text, m.end())
                value = text[start:end]
                named = f"name_{HONORIFICS[_HONOR.match(m[0])[0]]}"
            if _holds(kind, value) and not any(s < end and start < e for s, e, _, _ in found):
                found.append((start, end, named, value))
    for m in _INTRODUCED.finditer(text) if "m" in text else ():
        start, end = m.end(), _name_end(text, m.end())
        if end > start and not any(s < end and start < e for s, e, _, _ in found):
            found.append((start, end, "name_n", text[start:end]))
    return sorted(found + _mentions(text, found))


class _Draw:
    """Numbers from a keyed hash of an entity and the draw."""

    def __init__(self, key: bytes, kind: str, value: str, draw: int) -> None:
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{value}\0{draw}".encode(), hashlib.sha256).digest(), 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.bits < 64:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
            self.n, self.bits = self.n + 1, 256
        self.pool, out = divmod(self.pool, n)
        self.bits -= n.bit_length()
        return out


def _like(text: str, draw: _Draw) -> str:
    """Digits for digits, letters for letters of the same case, and all else as it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return "".join(
        str(draw.below(10)) if c.isdigit() else letters[draw.below(26)] if "a" <= c <= "z" else letters[draw.below(26)].upper() if "A" <= c <= "Z" else c for c in text
    )


def _hex_like(text: str, draw: _Draw) -> str:
    digits = "0123456789abcdef"
    return "".join(digits[draw.below(16)] if c in digits else digits[draw.below(16)].upper() if c in "ABCDEF" else c for c in text)


def _script(text: str) -> str:
    """The script of a text's first letter, as Unicode names it."""
    first = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(first, "LATIN").split()[0].split("-")[0].lower()


@lru_cache(maxsize=4096)
def _near(letter: str, small: bool) -> str:
    """Small letters or capitals of a letter's script, from around it."""
    start = ord(letter) // BLOCK * BLOCK
    every = [c for c in map(chr, range(start, start + BLOCK)) if c.isalpha() and _script(c) == _script(letter)]
    return "".join(c for c in every if (c.islower() if small else c.isupper())) or "".join(every)


def _sounds(word: str) -> tuple[list[str] | str, list[str] | str, dict[str, str]]:
    """What words of a script are made of: two kinds of letters that alternate, and endings by gender where the script has some here."""
    if _script(word) in SYLLABLES:
        return SYLLABLES[_script(word)]
    letters = _near(next(c for c in word if c.isalpha()), True)
    return letters, letters, {}


def _capitals(letter: str) -> str:
    return CAPITALS.get(_script(letter)) or _near(letter, False)


def _name_parts(kind: str, value: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, word) of what is replaced in a name: word_f or word_m for given names, word_ for
    the family name, which has no gender; initial for a lone letter before it."""
    core, out = _core(value), []
    for w in core:
        given = kind[-1] if w is not core[-1] else ""
        for p in _PART.finditer(value, w.start(), w.end()):
            if p[0] not in PARTICLES:
                lone = given and len(p[0]) == 1 and p[0] in _capitals(p[0])
                out.append((p.start(), p.end(), "initial" if lone else f"word_{given}", _word_key(p[0])))
    return out


def _person(key: bytes, kind: str, value: str, words: dict[tuple[str, str], str]) -> str:
    """A name with the surrogates of its words, by type and word, in their places and cases."""
    out, end = [], 0
    for s, e, role, word in _name_parts(kind, value):
        part = value[s:e]
        made = _initial(key, word) if role == "initial" else words[role, word]
        cased = made.upper() if part.isupper() and len(part) > 1 or role == "initial" else made.capitalize() if part[0].isupper() else made
        out += [value[end:s], cased]
        end = e
    return "".join([*out, value[end:]])


def _initial(key: bytes, letter: str) -> str:
    """The next letter on a keyed round of the script's capitals: never the same, never that of another letter."""
    order = sorted(_capitals(letter), key=lambda c: hmac.new(key, f"initial\0{c}".encode(), hashlib.sha256).digest())
    return order[(order.index(letter) + 1) % len(order)]


def _name_word(key: bytes, kind: str, word: str, draw: int) -> str:
    """A word in small letters that ends as its gender does; later draws have more syllables."""
    d = _Draw(key, kind, word, draw)
    consonants, vowels, last = _sounds(word)
    made = "".join(consonants[d.below(len(consonants))] + vowels[d.below(len(vowels))] for _ in range(3 + d.below(2) + draw // 2))
    return made[:-1] + last["f"] if kind == "word_f" and last else made + last["m"] if kind == "word_m" and last else made


def surrogate(key: bytes, kind: str, value: str, draw: int) -> str:
    """The surrogate of an entity at a draw; draws from SAME_FORMAT_DRAWS on are longer, but for addresses,
    whose numbers then have any length."""
    d = _Draw(key, kind, value, draw)
    more = draw >= SAME_FORMAT_DRAWS
    if kind == "email":
        return addressed(_local(key, value, draw), surrogate(key, "domain", value.rpartition("@")[2].lower(), 0))
    if kind == "domain":
        out = f"{_like(value.rpartition('.')[0], d)}{_like('x9' * 4, d) if more else ''}.example"
    elif kind == "ip":
        span = {n: (0, 256) for n in (1, 2, 3)} if more else {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        out = ".".join(str(span[len(o)][0] + d.below(span[len(o)][1])) for o in value.split("."))
    elif kind == "ipv6":
        out = _hex_like(value, d)
    elif kind == "card":
        places = [i for i, c in enumerate(value) if c.isdigit()]
        chars = list(value[0] + _like(value[1:], d))
        if luhn("".join(value[i] for i in places)) == 0:  # a valid number gets a valid one
            chars[places[-1]] = "0"
            chars[places[-1]] = str(luhn("".join(chars[i] for i in places)))
        out = "".join(chars)
    elif kind == "iban":
        plain = value.replace(" ", "")
        body = _like(plain[4:], d)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        made = iter(f"{plain[:2]}{check:02d}{body}")
        out = "".join(c if c == " " else next(made) for c in value)
    elif kind == "aws_key":
        out = value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in value[4:])
    elif kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        out = _hex_like(value, d)
    elif kind == "phone" and value[0] == "+":
        country = re.match(r"\+\d{1,3}", value)[0]
        out = country + _like(value[len(country) :], d)
    elif kind.startswith("word_"):
        out = _name_word(key, kind, value, draw)
    elif kind.startswith("name_"):
        out = _person(key, kind, value, {(k, w): _name_word(key, k, w, draw) for _, _, k, w in _name_parts(kind, value)})
    else:
        out = _like(value, d)
    return out + str(d.below(10**9)) if more and kind not in ("domain", "ip") and not kind.startswith(("word_", "name_")) else out


def _local(key: bytes, value: str, draw: int) -> str:
    """An address with another part before its own domain."""
    d = _Draw(key, "email", value, draw)
    local, _, domain = value.rpartition("@")
    return f"{_like(local, d)}{_like('x9' * 4, d) if draw >= SAME_FORMAT_DRAWS else ''}@{domain}"


def addressed(address: str, domain: str) -> str:
    """An address at another domain."""
    return f"{address.rpartition('@')[0]}@{domain}"


def in_case_of(value: str, made: str) -> str:
    """What was made for an address in small letters, with capitals where the value has them before its last dot."""
    end = min(value.rfind("."), len(made))
    return "".join(m.upper() if v.isupper() else m for v, m in zip(value[:end], made[:end], strict=True)) + made[end:]


_FOUND = "array<struct<start:int,end:int,kind:string,value:string>>"
_ARROW_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
#: A text is known by two hashes, as its entities depend on nothing else.
_KEYS = {"k1": F.xxhash64, "k2": lambda text: F.xxhash64(F.lit(1), text)}


def found_in(docs: DataFrame) -> DataFrame:
    """(k1, k2, found) of distinct texts that have entities: the one pass that looks for them."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                hits = [(a, b, e) for t, a, b in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) if (e := entities(t))]
                found = [[{"start": s, "end": e, "kind": k, "value": v} for s, e, k, v in h[2]] for h in hits]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array(found, _ARROW_FOUND)], names=["k1", "k2", "found"])

    keyed = docs.select("text", *(f("text").alias(n) for n, f in _KEYS.items()))
    return written(keyed.mapInArrow(run, f"k1 long, k2 long, found {_FOUND}").dropDuplicates(["k1", "k2"]), "entities")


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value): no surrogate is any value of
    its kind, and no two entities of a kind share one, but a family name alone has the same for
    any gender, and a full name for a gender and none. Each draw settles all that don't clash.

    Clashes of names are settled by word, so that a word has the same surrogate in all names: a given
    name without a gender is taken for the one that the corpus has it with elsewhere, of two the female
    one. Domains are settled on their own, and addresses by what is before their domain.
    """

    def drawn(draw: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(surrogate=[_local(key, v, draw) if k == "email" else surrogate(key, k, v, draw) for k, v in zip(b["kind"], b["value"], strict=True)])

        return run

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(k, v, role, w) for k, v in zip(b["kind"], b["value"], strict=True) for _, _, role, w in _name_parts(k, v) if role != "initial"}
            yield pd.DataFrame(sorted(rows), columns=["kind", "value", "role", "word"], dtype=object)

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_person(key, k, v, {(x["role"], x["word"]): x["surrogate"] for x in own}) for k, v, own in zip(b["kind"], b["value"], b["own"], strict=True)]
            yield b[["kind", "value"]].assign(surrogate=made)

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["kind", "value"]].assign(surrogate=[addressed(a, d) for a, d in zip(b["address"], b["other"], strict=True)])

    found = stable(found.select("kind", "value").distinct())
    is_name = F.col("kind").startswith("name_")
    named = written(found.where(is_name).mapInPandas(words, "kind string, value string, role string, word string"), "named")
    given = named.where("role <> 'word_'").groupBy("word").agg(F.count("*").alias("n"), F.max(F.col("role") == "word_f").alias("f"), F.max(F.col("role") == "word_m").alias("m"))
    unsure = join_frequent(named.where("role = 'word_n'"), stable(given), "word", "n", OFTEN)
    sure = named.where("role <> 'word_n'").withColumn("as", F.col("role"))
    taken_for = written(sure.unionByName(unsure.select("kind", "value", "role", "word", F.when(F.col("f"), "word_f").when(F.col("m"), "word_m").otherwise("word_n").alias("as"))), "named")
    removed(named)
    domain = F.element_at(F.split("value", "@"), -1)
    domains = found.where("kind = 'email'").select(F.lit("domain").alias("kind"), domain.alias("value")).distinct()
    units = stable(found.where(~is_name).union(domains).union(taken_for.select("as", "word").distinct()))
    family = F.split("kind", "_")[0]  # names clash whatever their gender, and whatever the case of a word
    taken = units.select(family.alias("family"), F.when(family == "word", F.lower("value")).otherwise(F.col("value")).alias("surrogate")).distinct()
    pending, settled, draw = units, None, 0
    while True:
        made = pending.mapInPandas(drawn(draw), "kind string, value string, surrogate string").withColumn("family", family)
        made = stable(made.join(taken, ["family", "surrogate"], "left_anti"))
        first = made.groupBy("family", "surrogate").agg(F.min(F.struct("value", "kind")).alias("who"))
        good = stable(first.select(F.col("who")["kind"].alias("kind"), F.col("who")["value"].alias("value"), "surrogate"))
        settled = good if settled is None else settled.union(good)
        pending = stable(pending.join(good, ["kind", "value"], "left_anti"))
        if not pending.limit(1).count():
            break
        taken = taken.union(good.select(family.alias("family"), "surrogate"))
        draw += 1
    is_word = F.col("kind").startswith("word_")
    times = taken_for.groupBy("as", "word").agg(F.count("*").alias("n"))
    of_word = stable(settled.where(is_word).select(F.col("kind").alias("as"), F.col("value").alias("word"), "surrogate").join(times, ["as", "word"]))
    own = join_frequent(taken_for, of_word, ["as", "word"], "n", OFTEN).groupBy("kind", "value").agg(F.collect_list(F.struct("role", "word", "surrogate")).alias("own"))
    addresses = settled.where("kind = 'email'").select("kind", "value", F.col("surrogate").alias("address"), domain.alias("domain"))
    of_domain = settled.where("kind = 'domain'").select(F.col("value").alias("domain"), F.col("surrogate").alias("other"))
    of_domain = stable(of_domain.join(addresses.groupBy("domain").agg(F.count("*").alias("n")), "domain"))
    schema = "kind string, value string, surrogate string"
    mail = join_frequent(addresses, of_domain, "domain", "n", OFTEN).select("kind", "value", "address", "other").mapInPandas(moved, schema)
    return settled.where(~is_word & ~F.col("kind").isin("email", "domain")).union(own.mapInPandas(composed, schema)).union(mail)


def _replaced(docs: DataFrame, key: bytes) -> tuple[DataFrame, str]:
    """docs with surrogates in its text, and a count of replaced mentions, whose name is second.

    Texts are looked through once. Their entities meet surrogates as narrow rows, and what is to
    be put where is broadcast to the texts while it is little; beyond that texts are joined.
    """
    found = found_in(docs)
    unit = F.when(F.col("e")["kind"] == "email", F.lower(F.col("e")["value"])).otherwise(F.col("e")["value"])
    mentions = written(found.select("k1", "k2", F.explode("found").alias("e")).select("k1", "k2", F.col("e")["kind"].alias("kind"), unit.alias("value"), "e"), "mentions")
    times = mentions.groupBy("kind", "value").agg(F.count("*").alias("n"))
    mapping = written(surrogates(mentions, key).join(times, ["kind", "value"]), "surrogates")
    put = join_frequent(mentions, mapping, ["kind", "value"], "n", OFTEN).select("k1", "k2", F.struct(F.col("e")["start"].alias("start"), F.col("e")["end"].alias("end"), "kind", "surrogate").alias("p"))
    put = written(put.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("p")).alias("puts")), "puts")
    few = (put.agg(F.sum(F.size("puts"))).first()[0] or 0) <= FEW_ENTITIES
    k1, k2, salt, puts, count = fresh(docs, "_k1", "_k2", "_salt", "_puts", "n_entities")
    keyed = docs.withColumns({k1: _KEYS["k1"](F.col("text")), k2: _KEYS["k2"](F.col("text"))})
    put = put.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("puts").alias(puts))
    if few:
        joined = keyed.join(F.broadcast(put), [k1, k2], "left")
    else:  # copies of a text are spread by where they are read
        joined = keyed.withColumn(salt, F.spark_partition_id() % 16).join(put.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(15)))), [k1, k2, salt], "left")
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                texts, counts = [], []
                for text, known in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                    out, end = [], 0
                    for p in known or ():
                        made = in_case_of(text[p["start"] : p["end"]], p["surrogate"]) if p["kind"] == "email" else p["surrogate"]
                        out += [text[end : p["start"]], made]
                        end = p["end"]
                    texts.append("".join([*out, text[end:]]) if known else text)
                    counts.append(len(known or ()))
                columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names[:width], count])

    return joined.select(*docs.columns, puts).mapInArrow(run, with_fields(docs.schema, (count, T.LongType()))), count


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in its text, in docs' own columns; rows and all other columns stay."""
    rows, count = _replaced(docs, key)
    return rows.drop(count)


def private_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates, n_entities.

    A null or empty text stays as it is with no entities. Repeated rows get the same text; a
    null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    rows, count = _replaced(docs.select("doc_id", "text"), key)
    return rows.select("doc_id", "text", F.col(count).alias("n_entities"))
