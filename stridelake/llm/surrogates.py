"""PII: detected entities get keyed, type-consistent surrogates, distinct and the same in the whole corpus.

1. Each text is scanned for mail addresses, phone numbers, IP addresses, card and account numbers, social security
   numbers and personal names. An entity is its kind and its canonical form: two spellings of a number are one.
2. The distinct entities of the corpus get surrogates that follow from a key: same kind, script and length, names of
   the same gender. Where two would get the same one, or one that is another's real value, the later draws again;
   rounds go on until none collide. So different entities stay different, and one entity is one everywhere.
3. The surrogates go back to their documents and are set in with the format found: signs between digits, letter case.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, text_of
from stridelake.session import staged

#: First names that are known and drawn from, by script and gender.
FIRST = {
    ("latin", "f"): "anna maria sophie laura julia emma claire marie lucia elena carmen sarah emily olivia alice mary linda susan karen lisa",
    ("latin", "m"): "peter thomas michael john james robert david paul martin lukas pierre louis jean carlos miguel antonio jose william george henry",
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина татьяна светлана",
    ("cyrillic", "m"): "иван сергей алексей дмитрий николай андрей михаил виктор",
    ("greek", "f"): "ελένη μαρία κατερίνα σοφία",
    ("greek", "m"): "γιώργος νίκος δημήτρης κώστας",
}
LAST = {
    "latin": "miller fischer weber martin bernard moreau garcia lopez sanchez taylor wilson clark walker becker wagner dubois romero torres allen young",
    "cyrillic": "петров смирнов кузнецов попов соколов лебедев козлов новиков",
    "greek": "παππάς νικολάου γεωργίου δημητρίου",
}
TITLE = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "señora": "f"}
KNOWN = {name: gender for (_, gender), names in FIRST.items() for name in names.split()}
SYLLABLES = {
    "latin": "ba de fi go lu ma ne ri so ta ve ka lo mi ra".split(),
    "cyrillic": "ба де ки ло ма не ри со та ве".split(),
    "greek": "βα δε κι λο μα νε ρι σο τα".split(),
}
ENDING = {("latin", "f"): "na", ("latin", "m"): "n", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("greek", "f"): "να", ("greek", "m"): "ς"}

UPPER, LOWER = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩА-ЯЁ", "a-zß-öø-ÿά-ώα-ωа-яё"
CAPITAL = re.compile(rf"(?<!\w)(?:[{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)*|[{UPPER}]{{2,}})(?!\w)")
BETWEEN = re.compile(r"\.?[ \t]+")
EMAIL = re.compile(r"\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
NUMBER = re.compile(r"(?<![\w.])\+?\(?\d[\d ().-]{5,}\d(?![\w])")
IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
PHONE = re.compile(
    r"\+\d[\d ().-]{6,}\d$|\(\d{2,4}\) ?\d{3}[ .-]?\d{3,4}$|\d{3}([ .-])\d{3}\1\d{4}$"
    r"|0\d(?P<sign>[ .-])\d{2}(?:(?P=sign)\d{2}){3}$|0\d{2,4} \d{5,8}$"
)
SSN = re.compile(r"\d{3}-\d{2}-\d{4}$")
CARD = re.compile(r"\d{13,19}$|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}$|3[47]\d{2}(?P<sign>[ -])\d{6}(?P=sign)\d{5}$")
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = re.compile(rf"(?<![\w:])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)(?![\w:])")
DIGITS = re.compile(r"\d")

ROUNDS = 100
#: Attempts after which numbers grow.
CROWDED = 24
#: What any mention has in it: a digit, an at sign, or one of the names and titles as a word (a Java pattern).
POSSIBLE = (
    r"[@\p{Nd}]|(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(KNOWN.keys() | TITLE.keys())) + r")(?![\p{L}\p{N}_])"
)


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def luhn(digits: str) -> int:
    """0 for a valid number."""
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10


def iban_remainder(value: str) -> int:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def numbers(text: str) -> Iterator[tuple[str, str, int, int]]:
    for m in NUMBER.finditer(text):
        value, start = m[0], m.start()
        # What looks like several numbers in a row is cut at blanks that no format has.
        for part in [value] if PHONE.match(value) or CARD.match(value) else value.split(" "):
            at = text.index(part, start)
            start = at + len(part)
            part = part.rstrip(".-()") if not PHONE.match(part) else part
            digits = "".join(DIGITS.findall(part))
            for kind, pattern in (("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
                if pattern.match(part):
                    canonical = part if kind == "ip" else ("+" if part.startswith("+") else "") + digits
                    yield kind, canonical, at, at + len(part)
                    break


def long_addresses(text: str) -> Iterator[tuple[str, str, int, int]]:
    """IPv6 addresses of three groups or more with a digit: shorter ones may be names of code."""
    for m in IPV6.finditer(text):
        if len(re.findall(GROUP, m[0])) < 3 or not DIGITS.search(m[0]):
            continue
        try:
            yield "ipv6", ipaddress.IPv6Address(m[0]).exploded, m.start(), m.end()
        except ValueError:
            continue


def names(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Known first names and what follows a title, with the surname behind; and later mentions of either part."""
    tokens = [(m[0].lower(), m.start(), m.end()) for m in CAPITAL.finditer(text)]
    kinds: dict[str, str] = {}
    for i, (word, _, end) in enumerate(tokens):
        follows = i + 1 < len(tokens) and BETWEEN.fullmatch(text, end, tokens[i + 1][1])
        gender = KNOWN.get(word)
        if gender and follows:
            kinds.setdefault(word, f"first_{gender}")
            if tokens[i + 1][0] not in KNOWN and tokens[i + 1][0] not in TITLE:
                kinds.setdefault(tokens[i + 1][0], "last")
        elif word in TITLE and follows and tokens[i + 1][0] not in TITLE:
            after = tokens[i + 1][0]
            kinds.setdefault(after, f"first_{TITLE[word]}" if after in KNOWN else "last")
    for word, start, end in tokens if kinds else []:
        if word in kinds:
            yield kinds[word], word, start, end


def mentions(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical value, start, end) in code points, in order and without overlap; the earlier kind wins."""
    found = []
    if "@" in text:
        found += [("email", m[0].lower(), m.start(), m.end()) for m in EMAIL.finditer(text)]
    for m in IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if 15 <= len(value) <= 34 and iban_remainder(value) == 1:
            found.append(("iban", value, m.start(), m.end()))
    if ":" in text:
        found += long_addresses(text)
    found += numbers(text)
    found += names(text)
    taken: list[tuple] = []  # in order of place
    for mention in found:
        at = bisect(taken, mention[2], key=lambda m: m[2])
        if (at == 0 or taken[at - 1][3] <= mention[2]) and (at == len(taken) or taken[at][2] >= mention[3]):
            taken.insert(at, mention)
    return taken


class Draw:
    """A stream of choices that follows from the key, the entity and the number of the attempt."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.block, self.left = key, "\0".join(what).encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        while len(self.left) < 4:
            self.left += hmac.new(self.key, self.what + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value * n >> 32

    def like(self, text: str) -> str:
        """Same length; digits, and letters of Latin, Cyrillic and Greek, for others of their kind."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
                letters = letters.get(script_of(c), "abcdefghijklmnopqrstuvwxyz")
                drawn = letters[self.below(len(letters))]
                out.append(drawn.upper() if c.isupper() else drawn)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate. A form that few values fit grows from attempt to attempt: addresses
    by letters after a few, numbers by digits when their own length seems used up."""
    draw = Draw(key, kind, value, str(attempt))
    if kind in ("phone", "card", "iban", "ssn") and attempt >= CROWDED:
        value += "0" * ((attempt - CROWDED) // 4 + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        grown = local + "a" * (attempt // 4)
        return f"{draw.like(grown)}@{'.'.join(draw.like(x) for x in labels[:-1])}.example"
    if kind == "ipv6":
        # The range that is set aside for examples.
        drawn = ["2001", "0db8", *(f"{draw.below(1 << 16):04x}" for _ in range(6))]
        return ":".join(drawn)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "phone":
        return value[:2] + draw.like(value[2:]) if value.startswith("+") else draw.like(value)
    if kind == "card":
        body = value[0] + draw.like(value[1:-1])
        check = draw.below(10) if luhn(value) else next(d for d in range(10) if luhn(f"{body}{d}") == 0)
        return f"{body}{check}"
    if kind == "iban":
        body = draw.like(value[4:])
        return f"{value[:2]}{98 - iban_remainder(value[:2] + '00' + body):02d}{body}"
    if kind == "ssn":
        return draw.like(value)
    script = script_of(value)
    gender = kind[-1]
    known = LAST[script] if kind == "last" else FIRST[script, gender]
    if attempt < 3:
        pool = known.split()
        return pool[draw.below(len(pool))]
    made = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 4))
    return made if kind == "last" else made + ENDING[script, gender]


def fitted(kind: str, original: str, new: str) -> str:
    """A surrogate in the format of the place: signs between the digits or letters as there, case as there."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(new.lstrip("+"))
        # What a crowded form has grown by stands at the end.
        return "".join(next(signs) if c.isalnum() else c for c in original) + "".join(signs)
    if kind == "ipv6":
        short = ipaddress.IPv6Address(new).compressed
        return short.upper() if original.upper() == original and original.lower() != original else short
    if original.isupper():
        return new.upper()
    if kind in ("email", "ip"):
        return new
    return "-".join(part.capitalize() for part in new.split("-"))


def replaced(text: str, new_of: dict[tuple[str, str], str]) -> str:
    out, last = [], 0
    for kind, value, start, end in mentions(text):
        out += [text[last:start], fitted(kind, text[start:end], new_of[kind, value])]
        last = end
    return "".join(out) + text[last:]


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc_id, text_key, text in zip(frame["doc_id"], frame["text_key"], frame["text"]):
            out += [(doc_id, text_key, *m) for m in dict.fromkeys((k, v) for k, v, _, _ in mentions(text))]
        columns = pd.DataFrame(out, columns=["doc_id", "text_key", "kind", "value"])
        columns["doc_id"] = columns["doc_id"].astype("Int64")
        yield columns


def _drawn(key: bytes):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["kind"], frame["value"], frame["attempt"])
            yield frame.assign(surrogate=[surrogate(key, k, v, int(a)) for k, v, a in rows])

    return work


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, surrogate for the distinct entities (kind, value): no two alike within a kind, none a real value.

    Genders share the first names' space. In each round those that collide, but for the first by attempt and value,
    and those that hit a real value draw again.
    """
    schema = "kind string, value string, attempt int, surrogate string"
    space = F.when(F.col("kind").startswith("first"), "first").otherwise(F.col("kind"))
    table = entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
    table = staged(table.mapInPandas(_drawn(key), schema), "pii-drawn")
    real = table.select(space.alias("space"), F.col("value").alias("surrogate")).distinct()
    for _ in range(ROUNDS):
        spaced = table.withColumn("space", space)
        winners = spaced.groupBy("space", "surrogate").agg(
            F.min(F.struct("attempt", "value", "kind")).alias("winner"), F.count("*").alias("n")
        )
        judged = spaced.join(winners, ["space", "surrogate"]).join(
            real.withColumn("is_real", F.lit(True)), ["space", "surrogate"], "left"
        )
        lost = F.coalesce("is_real", F.lit(False)) | (F.struct("attempt", "value", "kind") != F.col("winner"))
        judged = staged(judged.select("kind", "value", "attempt", "surrogate", lost.alias("lost")), "pii-judged")
        if judged.where("lost").isEmpty():
            return judged.select("kind", "value", "surrogate")
        again = judged.where("lost").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        again = again.mapInPandas(_drawn(key), schema)
        table = staged(judged.where("NOT lost").select("kind", "value", "attempt", "surrogate").unionByName(again), "pii-drawn")
    raise RuntimeError("surrogates still collide")


def _rewritten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, spans, counts = [], [], []
        for text, known in zip(frame["text"], frame["known"]):
            if known is None or not len(known):
                texts.append(text), spans.append(""), counts.append(0)
                continue
            new_of = {(x["kind"], x["value"]): x["surrogate"] for x in known}
            found = mentions(text)
            texts.append(replaced(text, new_of))
            spans.append(",".join(f"{k}:{a}:{b}" for k, _, a, b in found))
            counts.append(len(found))
        ids = frame["doc_id"].astype("Int64").array
        yield pd.DataFrame({"doc_id": ids, "text": texts, "n_entities": counts, "spans": spans})


def pseudonymise(docs: DataFrame, key: bytes = b"corpus") -> DataFrame:
    """One row for each document: doc_id, text with surrogates, n_entities, spans (kind:start:end in the old text).

    Found are mail, IPv4 and IPv6 addresses, phone numbers with a country code, in brackets, in threes and fours, in twos
    behind a zero, or with a dialling code, cards, IBANs, SSNs, and persons by known first names or titles. Not found are
    persons without either, names in lower case, postal addresses, numbers of other countries' offices, and phone
    numbers written in one run of digits.

    The same key gives the same surrogates for the same corpus. A null text counts as empty. Null and repeated ids
    are kept as they are: rows are told apart by id and text. An empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    keyed = narrow.withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id bigint, text_key bigint, kind string, value string"
    # Most texts have no mention for sure: they are passed on as they are, and not shuffled.
    possible = F.col("text").rlike(POSSIBLE)
    plain = keyed.where(~possible).select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("spans")
    )
    keyed = keyed.where(possible)
    found = staged(keyed.mapInPandas(_found, schema).distinct(), "pii-found")
    table = surrogate_table(found, key)
    known = (
        found.join(table, ["kind", "value"])
        .groupBy(F.col("doc_id").alias("known_id"), F.col("text_key").alias("known_key"))
        .agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("known"))
    )
    known = staged(known, "pii-known")
    same = keyed["doc_id"].eqNullSafe(known["known_id"]) & (keyed["text_key"] == known["known_key"])
    out = "doc_id bigint, text string, n_entities bigint, spans string"
    rewritten = keyed.join(known, same, "left").select("doc_id", "text", "known").mapInPandas(_rewritten, out)
    return plain.unionByName(rewritten)
