"""Surrogates for personal data: detected entities give way to keyed, type-consistent replacements.

Detected are mail addresses, IPv4 addresses, payment card numbers with a valid check digit, telephone numbers, secrets after a
telling name, and personal names after a title.  A surrogate is drawn from a keyed digest of the entity, so one entity has one surrogate
wherever it occurs (coreference), and keeps what the type and the writing fix: punctuation and length of numbers, check digit
and first digits of cards, valid octets, the structure of addresses, letter case, hexadecimal or not, gender and script of names.

Distinctness is checked over the whole corpus: two entities of a type must not share a surrogate, and no surrogate may be an entity
that occurs.  Entities that lose such a collision draw again with the next counter until none is left.  Only their counters
travel back to the documents; everything else is drawn where the text is.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import row_keyed, written

KEY = b"surrogates"
DRAWS = 64

# Titles by gender, and name parts by script and gender.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Signora", "Г-жа", "Госпожа"),
          "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Господин"),
          "n": ("Dr", "Prof", "Professor", "Д-р")}
GIVEN = {("latin", "f"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"),
         ("latin", "m"): ("Adam", "Daniel", "Felix", "Hugo", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"),
         ("latin", "n"): ("Alex", "Charlie", "Jamie", "Kim", "Lou", "Morgan", "Robin", "Sam", "Sascha", "Toni"),
         ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"),
         ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Семён"),
         ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава")}
SYLLABLES = {"latin": ("ba", "den", "fal", "gor", "hal", "ker", "lin", "mar", "nes", "pol", "ros", "sel", "tor", "ven", "wal", "zim"),
             "cyrillic": ("бе", "вор", "гал", "дем", "зим", "кор", "лан", "мир", "нов", "пол", "рос", "сав", "тар", "фед", "хол", "чер")}
DOMAINS = ("example.com", "example.net", "example.org")

_titles = "|".join(sorted((re.escape(t) for group in TITLES.values() for t in group), key=len, reverse=True))
PATTERNS = {
    "secret": r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s*[:=]\s*["']?)(?P<secret>[A-Za-z0-9_\-/+]{16,})""",
    "mail": r"(?P<mail>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))",
    "ip": r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))",
    "card": r"(?P<card>(?:(?<![\w.+-])|(?<=\d-))\d(?:[ -]?\d){12,18}(?!\w|\.\d))",
    "phone": r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))",
    "name": rf"\b(?P<title>{_titles})\b\.?[ \u00a0](?P<name>[^\W\d_a-zа-я][\w'’-]*(?:[ \u00a0][^\W\d_a-zа-я][\w'’-]*){{0,2}})",
}
FINDER = re.compile("|".join(PATTERNS.values()))
NO_CARD = re.compile("|".join(p for kind, p in PATTERNS.items() if kind != "card"))
GROUP = re.compile(r"[ -]?(\d+)")
AFTER = re.compile(r"\w|\.\d")  # what may not follow a card
HINT = re.compile(rf"[@\d]|\b(?:{_titles})\b|(?i:token|secret|passw|api.?key|access.?key)")
GENDER = {t.lower(): g for g, group in TITLES.items() for t in group}


def luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a valid number."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))


def card_end(text: str, start: int) -> int | None:
    """End of the longest valid card number that starts here and takes whole groups of digits."""
    digits, at, best = "", start, None
    while (m := GROUP.match(text, at)) and len(digits) + len(m[1]) <= 19:
        digits, at = digits + m[1], m.end()
        if len(digits) >= 13 and luhn(digits) % 10 == 0 and len(set(digits)) > 1 and not AFTER.match(text, at):
            best = at
    return best


def first_of_run(text: str, at: int, end: int) -> tuple[int, int | None, re.Match | None]:
    """What starts first at a group of a run of digits: (start, end, None) of a card, or (start, None, match) of another entity.
    (end of the run, None, None) if nothing does."""
    while at < end:
        if close := card_end(text, at):
            return at, close, None
        if m := NO_CARD.match(text, at):
            return at, None, m
        at = GROUP.match(text, at).end()
        at += at < end  # the space or hyphen
    return end, None, None


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender) of the entities of a text, left to right.  Numbers that only look like cards are none.

    Where a run of groups of digits is no card, each of its groups may still start one, or something else.
    """
    if not text or not HINT.search(text):
        return []
    found, at = [], 0
    while m := FINDER.search(text, at):
        if m.lastgroup == "card":
            at, close, m = first_of_run(text, *m.span())
            if close:
                found.append((at, close, "card", ""))
                at = close
            if not m:
                continue
        kind = "name" if m.lastgroup == "title" else m.lastgroup
        start, end = m.span(kind)
        found.append((start, end, kind, GENDER[m["title"].lower()] if kind == "name" else ""))
        at = end
    return found


def identity(kind: str, value: str, gender: str) -> str:
    """What makes two mentions the same entity: case and spacing of addresses and names, punctuation of numbers do not count."""
    if kind in ("card", "phone"):
        return re.sub(r"[^\d]", "", value)
    if kind == "name":
        return gender + ":" + " ".join(value.lower().split())
    return value if kind == "secret" else value.lower()


class _Draw:
    """A keyed stream of choices for one entity."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.text, self.block, self.pool = key, "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.block.to_bytes(4, "big") + self.text, sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def of(self, choices: str | tuple[str, ...]) -> str:
        return choices[self.below(len(choices))]


def _letters(draw: _Draw, text: str) -> str:
    """Letters and digits of the same sort and case; everything else stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(draw.of("0123456789"))
        elif c.isalpha():
            new = draw.of("бвгдежзиклмнопрстуфхч" if "а" <= c.lower() <= "я" else "abcdefghijklmnopqrstuvwxyz")
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _in_form(value: str, digits: str) -> str:
    """The digits in the places of the value's digits."""
    each = iter(digits)
    return "".join(next(each) if c.isdigit() else c for c in value)


def canonical(kind: str, entity: str, counter: int, key: bytes = KEY) -> str:
    """The surrogate of an identity in plain form: lower case, no punctuation in numbers."""
    draw = _Draw(key, kind, entity, str(counter))
    if kind == "card":
        # the first digit names the scheme and stays; the last one makes the number valid
        body = entity[0] + "".join(draw.of("0123456789") for _ in entity[1:-1])
        return body + str(-luhn(body + "0") % 10)
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        tail = "".join(draw.of("0123456789") for _ in entity[keep:])
        return entity[:keep] + (tail[:3] + "555" + tail[6:] if len(tail) == 10 else tail)
    if kind == "ip":
        return ".".join(str(draw.below(256)) for _ in range(4))
    if kind == "mail":
        local, domain = entity.rsplit("@", 1)
        # one domain has one surrogate, so mails that share it still do
        place = _Draw(key, "domain", domain)
        return f"{_letters(draw, local)}@{_letters(place, domain.rsplit('.', 1)[0].split('.')[0])}.{place.of(DOMAINS)}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
            hexits = "0123456789abcdef" if entity == entity.lower() else "0123456789ABCDEF"
            return "".join(draw.of(hexits) for _ in entity)
        return _letters(draw, entity)
    gender, name = entity.split(":", 1)
    words = name.split()
    script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in name) else "latin"
    given = [draw.of(GIVEN[script, gender]) for _ in words[:-1]]
    family = "".join(draw.of(SYLLABLES[script]) for _ in range(2 + min(counter, 8)))
    return " ".join([*given, family]).lower()


def in_form_of(kind: str, value: str, surrogate: str) -> str:
    """The surrogate written as the mention is: its punctuation and letter case."""
    if kind in ("card", "phone"):
        return _in_form(value, surrogate)
    if kind in ("ip", "secret"):
        return surrogate
    if value.isupper():
        return surrogate.upper()
    if kind == "name":
        gaps = re.findall(r"\s+", value) or [" "]
        words = [w.capitalize() for w in surrogate.split()]
        return "".join(w + (gaps[i] if i < len(words) - 1 else "") for i, w in enumerate(words))
    return surrogate if value.islower() or kind != "mail" else "".join(
        c.upper() if i < len(value) and value[i].isupper() else c for i, c in enumerate(surrogate))


def rewrite(text: str | None, counter_of: Callable[[str, str], int], key: bytes = KEY) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    found = detect(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, gender in found:
        value = text[start:end]
        entity = identity(kind, value, gender)
        out += [text[at:start], in_form_of(kind, value, canonical(kind, entity, counter_of(kind, entity), key))]
        at = end
    return "".join([*out, text[at:]]), len(found)


ENTITY = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("entity", pa.string())])


def _entities(docs: DataFrame) -> DataFrame:
    """(key, kind, entity) of every document, each entity once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *e) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for e in sorted({(kind, identity(kind, text[s:t], g)) for s, t, kind, g in detect(text)})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ENTITY, strict=True)], schema=ENTITY)

    return docs.select("key", "text").mapInArrow(run, "key long, kind string, entity string")


def _draw_all(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate for the current counter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [canonical(k, e, c, key) for k, e, c in zip(*(x.to_pylist() for x in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], ["kind", "entity", "counter", "surrogate"])

    return entities.select("kind", "entity", "counter").mapInArrow(run, "kind string, entity string, counter int, surrogate string")


def _plain(kind: str, entity: str) -> Column:
    """An entity as surrogates are written, to compare the two."""
    return F.when(F.col(kind) == "name", F.substring_index(entity, ":", -1)).otherwise(F.col(entity))


def settle(entities: DataFrame, key: bytes = KEY, draws: int = DRAWS) -> DataFrame:
    """(kind, entity, counter) for distinct entities, such that surrogates are distinct within a kind and no entity occurs as one.

    Every round draws for all entities that have none yet; of those that draw the same, the least by digest keeps it if none had
    it before.  Rounds end when nothing is open; a space too small for its entities raises.
    """
    names = entities.select("kind", _plain("kind", "entity").alias("surrogate")).distinct()
    fixed = None
    waiting = entities.select("kind", "entity").withColumn("counter", F.lit(0))
    for _ in range(draws):
        drawn = written(_draw_all(waiting, key), "pii-drawn")
        free = drawn.join(names, ["kind", "surrogate"], "left_anti")
        if fixed is not None:
            free = free.join(fixed.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min_by(F.struct("entity", "counter"), F.struct(F.xxhash64("entity"), "entity")).alias("w"))
        won = won.select("kind", "w.entity", "w.counter", "surrogate")
        fixed = written(won if fixed is None else fixed.unionByName(won), "pii-fixed")
        waiting = written(drawn.join(fixed.select("kind", "entity"), ["kind", "entity"], "left_anti")
                          .select("kind", "entity", (F.col("counter") + 1).alias("counter")), "pii-waiting")
        if not waiting.limit(1).count():
            return fixed
    raise RuntimeError("too many entities for the surrogates of their kind")


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, count_name: str | None = None) -> DataFrame:
    """The rows of ``docs`` with surrogates in their texts; all other columns stay.  ``count_name`` adds the number of replaced mentions.

    Null, empty and clean texts stay as they are; repeated rows are treated alike; an empty table gives an empty table.  ``key`` decides all
    surrogates: who has it can draw them again, nobody can read an entity out of one.
    """
    names = [c for c in docs.columns if c != count_name]
    rows = row_keyed(docs.select(*names), id_col, text_col)
    named = rows.select(F.col("__key").alias("key"), F.col(text_col).alias("text"))
    mentions = written(_entities(named), "pii-mentions")
    settled = settle(mentions.select("kind", "entity").distinct(), key)
    # what drew again, by document: few, and as a written table of known size it is broadcast when small and shuffled when not
    redrawn = written(mentions.join(settled.filter("counter > 0"), ["kind", "entity"])
                      .groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("kind", "entity", "counter")).alias("__again")), "pii-again")
    where = names.index(text_col)
    schema = rows.select(*names).schema
    if count_name:
        schema = schema.add(count_name, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, again in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                counters = {(a["kind"], a["entity"]): a["counter"] for a in again or []}
                new, n = rewrite(text, lambda kind, entity, own=counters: own.get((kind, entity), 0), key)
                texts.append(new)
                counts.append(n)
            columns = list(batch.columns[: len(names)])
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(counts, pa.int32())] if count_name else []), names + ([count_name] if count_name else []))

    return rows.join(redrawn, "__key", "left").select(*names, "__again").mapInArrow(run, schema)
