"""Personal data: keyed surrogates of the same type, script, gender and format, distinct and the same everywhere."""

from __future__ import annotations

import functools
import hashlib
import hmac
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import U64, bit_filter, map_slices, may_hold, settled, signed, text_arrays

# Titles that announce a person's name, by gender.
MALE = ["Mr", "Sir", "Herr", "Señor", "Sr", "Don", "Monsieur"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Mademoiselle"]

# A name: parts of any number, initials between them; a first part in capitals may be followed by others. 's is not a part's end.
TAIL = r"(?:['-](?!s\b)[\p{L}\p{M}]+)"
FIRST = rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]+{TAIL}*|{TAIL}+)"
LATER = rf"\p{{Lu}}(?:[\p{{Ll}}\p{{M}}][\p{{L}}\p{{M}}]*{TAIL}*|{TAIL}+)"
INITIALS = r"(?:\p{Lu}\.[ ])*"
NAME = rf"{INITIALS}(?:\p{{Lu}}{{2,}}(?:[ ]\p{{Lu}}{{2,}})+\b|{FIRST}(?:[ ]{INITIALS}{LATER})*)"

PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("secret", r"(?i:(?<=\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?))[A-Za-z0-9_\-+/]{8,}"),
    ("key", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w-])(?:\d[ -]?){12,18}\d(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<![\w.])\+\d{8,14}(?!\w)"),
    ("male", rf"(?<=\b(?:{'|'.join(MALE)})\.?[ ]){NAME}"),
    ("female", rf"(?<=\b(?:{'|'.join(FEMALE)})\.?[ ]){NAME}"),
]
ENTITY = "|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS)
# A pattern of Arrow's matcher, which takes linear time, that every line with an entity matches: a digit (newer ones are all beyond U+FFFF), an at sign, a
# word for a secret (of the letters in it only s and k have another form outside ASCII), how a key begins, or a title and a space.
MAY_HOLD = (
    r"[0-9@\x{17F}\x{212A}\x{10000}-\x{10FFFF}]|\p{Nd}|(?i:password|passwd|pwd|token|secret|key)|AKIA|gh[pousr]_|sk-|xox[abprs]-|(?:"
    + "|".join(MALE + FEMALE) + r")\.?[ ]"
)
MOST_BITS = 1 << 28  # of the filter of texts with entities: 32 MB
VOWELS = "aeiou"
# How the given names of men and women end, by script: the letters to draw from.
ENDINGS = {"man": ("bdklmnrst", "бвдклмнрст"), "woman": ("a", "а")}
ROUNDS = 4  # of drawing before surrogates of values that still collide grow by a sign a round

COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"  # calling codes

GIVEN = {"male": "man", "female": "woman"}
NAMES = ("man", "woman", "family")  # types of the parts of names

_FIND = regex.compile(ENTITY)
_PART = regex.compile(r"[^ .-]+")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of the entities of a text, from left to right."""
    return [(m.start(), m.end(), m.lastgroup, m.group()) for m in _FIND.finditer(text)]


def found_in(texts: pa.Array) -> dict[int, list[tuple[int, int, str, str]]]:
    """The entities of each text that has any; no entity crosses a line, so only the lines that may hold one are searched."""
    some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, MAY_HOLD), False).to_numpy(zero_copy_only=False))
    out = {}
    for i, text in zip(some.tolist(), texts.take(pa.array(some)).to_pylist()):
        lines = text.split("\n")
        hold, at, own = pc.match_substring_regex(pa.array(lines), MAY_HOLD).to_pylist(), 0, []
        for line, may in zip(lines, hold):
            own += [(at + s, at + e, k, v) for s, e, k, v in find(line)] if may else []
            at += len(line) + 1
        if own:
            out[i] = own
    return out


def _lowered(text: str) -> str:
    """``text`` in lower case if it can be put back."""
    low = text.lower()
    return low if len(low) == len(text) and all(c in (d, d.upper()) for c, d in zip(text, low)) else text


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """(type, normal form) of what an entity consists of: each part of a name, of other entities the whole.

    Numbers agree whatever separates their digits, addresses and names whatever their case. The last part of a name is the family's, for
    men and women alike; those before it are a man's or a woman's.
    """
    if kind in ("male", "female"):
        parts, own = _PART.findall(value), GIVEN[kind]
        return [(own if i < len(parts) - 1 else "family", _lowered(part)) for i, part in enumerate(parts)]
    if kind in NAMES:
        return [(kind, _lowered(value))]
    if kind in ("card", "ssn", "phone", "iban"):
        plain = "".join(str(unicodedata.decimal(c, c)) for c in value if c.isalnum())
        return [(kind, "+" + plain if value.startswith("+") else plain)]
    return [(kind, _lowered(value) if kind == "email" else value)]


def _cased(old: str, new: str) -> str:
    """``new`` in the case of ``old``; signs behind its end take the last one's."""
    last = len(old) - 1
    return "".join(c.upper() if old[min(i, last)].isupper() else c for i, c in enumerate(new))


def laid_out(kind: str, value: str, known: dict[tuple[str, str], str]) -> str:
    """The replacement of an entity as it is written, from the surrogates of its units."""
    if kind in ("male", "female") or kind in NAMES:
        parts = iter(units(kind, value))
        return _PART.sub(lambda m: _cased(m.group(), known[next(parts)]), value)
    [unit] = units(kind, value)
    new = known[unit]
    if kind == "email":
        return _cased(value, new) if unit[1] != value and len(new) == len(value) else new
    if kind not in ("card", "ssn", "phone", "iban"):
        return new
    signs, out = iter(new.removeprefix("+")), []
    for c in value:
        d = next(signs) if c.isalnum() else c
        out.append(chr(ord(c) - unicodedata.decimal(c) + int(d)) if c.isdecimal() else d)
    return "".join(out) + "".join(signs)


def mentions(found: list[tuple[int, int, str, str]], text: str) -> list[tuple[int, int, str, str]]:
    """``found`` and, between them, the further mentions of the parts of its names, as entities of the part's type."""
    kinds = {}
    for _, _, kind, value in found:
        for part, (own, _) in zip(_PART.findall(value), units(kind, value)) if kind in ("male", "female") else []:
            if len(part) > 1:
                for form in (part, part.upper(), part.capitalize() if part.isupper() else part):
                    if _lowered(form) == _lowered(part):
                        kinds.setdefault(form, own)
    if not kinds:
        return found
    again = regex.compile(r"(?<![\p{L}\p{M}\p{N}_])\L<forms>(?![\p{L}\p{M}\p{N}_])", forms=list(kinds))
    out, at = [], 0
    for entity in [*found, (len(text), len(text), "", "")]:
        out += [(m.start(), m.end(), kinds[m.group()], m.group()) for m in again.finditer(text, at, entity[0])]
        out.append(entity)
        at = entity[1]
    return out[:-1]


def _draws(key: bytes, kind: str, value: str, attempt: int):
    """Endless keyed numbers for an entity."""
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{value}\0{attempt}\0{block}".encode(), hashlib.sha256)
        block += 1


def _letter(old: str, draw: int, draw2: int) -> str:
    """A letter of the same script and case; of Latin ones a vowel for a vowel, so that names can be spoken."""
    code, number = ord(old), draw * 256 + draw2
    if old.isascii():
        pool = VOWELS if old.lower() in VOWELS else "bcdfghjklmnpqrstvwxyz"
        new = pool[number % len(pool)]
        return new.upper() if old.isupper() else new
    for low, high in ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x905, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)):
        if low <= ord(old.lower()[0]) <= high:
            new = chr(low + number % (high - low + 1))
            new = "σ" if new == "ς" else new
            return new.upper() if old.isupper() else new
    latin = "áéíóúàèìòùâêîôûäëïöüñç"
    if old.lower() in latin:
        new = latin[number % len(latin)]
        return new.upper() if old.isupper() else new
    pool = [c for c in _letters(code >> 7, unicodedata.category(old), unicodedata.name(old, "").split(" ")[0]) if c != old]
    new = pool[number % len(pool)] if pool else VOWELS[number % len(VOWELS)]
    return new.upper() if not pool and old.isupper() else new


@functools.cache
def _letters(block: int, category: str, script: str) -> list[str]:
    """The letters of a script and case in a block of 128 characters, those that come back from the other case."""
    block_of = map(chr, range(block << 7, (block + 1) << 7))
    return [c for c in block_of if unicodedata.category(c) == category and unicodedata.name(c, "").split(" ")[0] == script and c in (c.upper().lower(), c.lower().upper())]


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10


def _longer(kind: str, value: str, extra: int) -> str:
    """``value`` with ``extra`` more signs, where a surrogate of its kind may have them."""
    if kind == "ip":
        return value + ".1" * extra
    if kind == "email":
        at = value.index("@")
        return value[:at] + "n" * extra + value[at:]
    if kind in ("male", "female") or kind in NAMES:
        at = max(i for i, c in enumerate(value) if c.isalpha())
        return value[:at] + value[at].lower() * extra + value[at:]
    return value + "0" * extra


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity: same type, length, separators, letter case and script.

    Card numbers keep their first digit and whether their check digit holds, addresses stay addresses, hexadecimal secrets stay
    hexadecimal, e-mail addresses keep their last label. Given names of men and women end as ENDINGS says, others keep a last vowel.
    From the attempt ROUNDS on a surrogate is longer by one sign for each attempt, so that no format runs out of forms.
    """
    draw = _draws(key, kind, value, attempt)
    value = _longer(kind, value, max(attempt - ROUNDS + 1, 0))
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in value.split("."))
    hexa = kind in ("secret", "key") and regex.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None
    fixed: set[int] = set()
    if kind == "email":
        fixed = set(range(value.rindex("."), len(value)))
    elif kind in ("card", "ssn", "phone"):
        digits = [i for i, c in enumerate(value) if c.isdigit()]
        fixed = set(digits[:1])
        if kind == "phone" and value.startswith("+"):
            fixed = set(range(len(regex.match(COUNTRY, value).group())))
    elif kind == "iban":
        fixed = {0, 1}
    elif kind == "key":
        fixed = set(range(len(regex.match(r"AKIA|gh._|sk-|xox.-", value).group())))
    elif kind in ("male", "female", "family") and value[-1].lower() in VOWELS:
        fixed = {len(value) - 1}
    out = []
    for i, c in enumerate(value):
        if i in fixed:
            out.append(c)
        elif hexa:
            new = "0123456789abcdef"[next(draw) % 16]
            out.append(new.upper() if value.isupper() else new)
        elif c.isdigit():
            out.append(str(next(draw) % 10))
        elif c.isalpha():
            out.append(_letter(c, next(draw), next(draw)))
        else:
            out.append(c)
    if kind in ENDINGS and len(out) > 1:
        for letters, script in zip(ENDINGS[kind], ("LATIN", "CYRILLIC")):
            if unicodedata.name(out[-1], "").startswith(script):
                new = letters[next(draw) % len(letters)]
                out[-1] = new.upper() if out[-1].isupper() else new
    if kind == "card":
        places = [i for i, c in enumerate(out) if c.isdigit()]
        valid = _luhn([int(c) for c in value if c.isdigit()]) == 0
        rest = _luhn([int(out[i]) for i in places[:-1]] + [0])
        if valid:
            out[places[-1]] = str(-rest % 10)
        elif (int(out[places[-1]]) + rest) % 10 == 0:
            out[places[-1]] = str((int(out[places[-1]]) + 1) % 10)
    return "".join(out)


def _proposed(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, value, attempt) with a new surrogate each."""

    def run(batches):
        for batch in batches:
            made = [surrogate(k, v, key, n) for k, v, n in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["type", "value", "attempt", "surrogate"])

    return entities.select("type", "value", "attempt").mapInArrow(run, "type string, value string, attempt int, surrogate string")


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, value, surrogate) for distinct (type, value): no two values, of whatever types, share a surrogate, and none is a real value.

    Values whose surrogate collides are drawn again, all but the smallest of those that share it. After ROUNDS rounds their surrogates
    grow by a sign a round, and the forms at least fivefold, so that drawing ends where a format has fewer forms than values.
    """
    real = entities.select(F.col("value").alias("surrogate"))
    table = settled(_proposed(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        own = F.struct("value", "type")
        shared = table.groupBy("surrogate").agg(F.min(own).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        taken = table.join(real, "surrogate", "left_semi").select("type", "value")
        again = table.join(shared, "surrogate").where(own != F.col("owner")).select("type", "value").unionByName(taken).distinct()
        again = settled(again, "colliding")
        if again.isEmpty():
            return table.select("type", "value", "surrogate")
        moved = table.join(again, ["type", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        table = settled(table.join(again, ["type", "value"], "left_anti").unionByName(_proposed(moved, key)), "surrogates")


def _keys(texts: pa.Array) -> np.ndarray:
    """128-bit keys of texts as two 64-bit halves; those of nulls are of no account."""
    data, offsets = text_arrays(texts)
    made = b"".join(hashlib.blake2b(data[lo:hi], digest_size=16).digest() for lo, hi in zip(offsets[:-1], offsets[1:]))
    return np.frombuffer(made, dtype=U64).reshape(-1, 2)


SPANS = "array<struct<start: int, end: int, kind: string, value: string>>"


def entity_table(texts: DataFrame) -> DataFrame:
    """(h1, h2, spans): the entities of every different text that has any, by the key of the text."""

    def detect(part: pa.RecordBatch) -> pa.RecordBatch | None:
        found = found_in(part.column("text"))
        if not found:
            return None
        rows = pa.array(list(found))
        texts = part.column("text").take(rows)
        spans = [[dict(zip(("start", "end", "kind", "value"), x)) for x in mentions(own, text)] for own, text in zip(found.values(), texts.to_pylist())]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        keys = _keys(texts)
        return pa.RecordBatch.from_arrays([signed(keys[:, 0]), signed(keys[:, 1]), pa.array(spans, kind)], names=["h1", "h2", "spans"])

    return map_slices(texts, "text", f"h1 long, h2 long, spans {SPANS}", detect).dropDuplicates(["h1", "h2"])


def _edits(found: DataFrame, key: bytes) -> DataFrame:
    """(h1, h2, edits): what stands at the spans of each text instead."""

    def parts(batches):
        for batch in batches:
            rows = []
            for h1, h2, spans in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(h1, h2, *u) for u in dict.fromkeys(u for x in spans for u in units(x["kind"], x["value"]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["h1", "h2", "type", "value"])

    def lay(batches):
        for batch in batches:
            edits = []
            for spans, own in zip(batch.column("spans").to_pylist(), batch.column("own").to_pylist()):
                known = {(x["type"], x["value"]): x["surrogate"] for x in own}
                edits.append([{"start": x["start"], "end": x["end"], "new": laid_out(x["kind"], x["value"], known)} for x in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(edits, kind)], names=["h1", "h2", "edits"])

    met = settled(found.mapInArrow(parts, "h1 long, h2 long, type string, value string"), "entities")
    table = surrogate_table(met.select("type", "value").distinct(), key)
    known = settled(met.join(table.hint("merge"), ["type", "value"]), "known").groupBy("h1", "h2").agg(F.collect_list(F.struct("type", "value", "surrogate")).alias("own"))
    both = found.join(known.hint("merge"), ["h1", "h2"]).select("h1", "h2", "spans", "own")
    return both.mapInArrow(lay, "h1 long, h2 long, edits array<struct<start: int, end: int, new: string>>")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_entities and text, with every detected entity replaced by its surrogate.

    An entity has the same surrogate wherever it occurs and however its number is spaced, different entities have different ones, also across types,
    and without the key they can't be traced back. A family name has one surrogate for men and women, a given name one for each; in a text with a name
    further mentions of its parts are replaced, and counted, too.

    Texts are searched once. What stands at their spans is kept by the key of the text, so rows of equal texts, rows that share an id and rows without one
    are all treated alike; only texts that a bit filter of those keys passes are moved. A null text stays null and an empty one empty, both with 0 entities.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    edits = settled(_edits(settled(entity_table(rows.select("text")), "found"), key), "edits")
    held = rows.sparkSession.sparkContext.broadcast(bit_filter(edits.select("h1"), MOST_BITS))

    def keyed(part: pa.RecordBatch) -> pa.RecordBatch:
        keys = _keys(part.column("text"))
        may = pa.array(may_hold(held.value, keys[:, 0]) & ~np.array(part.column("text").is_null()))
        columns = [*part.columns, signed(keys[:, 0]), signed(keys[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "h1", "h2"]).filter(may)

    def rest(part: pa.RecordBatch) -> pa.RecordBatch:
        may = may_hold(held.value, _keys(part.column("text"))[:, 0]) & ~np.array(part.column("text").is_null())
        none = pa.array(np.zeros(part.num_rows, np.int64))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), none, part.column("text")], names=["doc_id", "n_entities", "text"]).filter(pa.array(~may))

    def replace(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, texts = [], []
        for text, edits in zip(part.column("text").to_pylist(), part.column("edits").to_pylist()):
            pieces, at = [], 0
            for x in edits or []:
                pieces += [text[at : x["start"]], x["new"]]
                at = x["end"]
            counts.append(len(edits or []))
            texts.append("".join(pieces) + text[at:])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_entities", "text"])

    schema = "doc_id long, n_entities long, text string"
    moved = map_slices(rows, "text", "doc_id long, text string, h1 long, h2 long", keyed).join(edits.hint("merge"), ["h1", "h2"], "left")
    return map_slices(moved.select("doc_id", "text", "edits"), "text", schema, replace).unionByName(map_slices(rows, "text", schema, rest))
