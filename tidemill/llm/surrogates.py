"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Every entity found has a canonical form. A keyed function turns it into a surrogate of the
same kind: digits for digits, letters of the same script and case for letters, valid check digits where they
were valid, given names of the same gender. Mentions of one entity get one surrogate
everywhere, each written in its own format; the parts of a name are entities of their own, so that
"Mrs Anna Berg" and "Mrs Berg" still belong together.

Two different entities must not get one surrogate, and no surrogate may be a real entity of the corpus: all
distinct entities are checked for that in rounds, and whoever loses draws again. Tasks compute
surrogates themselves; only the few entities that drew more than once are looked up.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemill.llm.common import texts_of
from tidemill.session import materialize

# Titles by gender, common given names by gender and script, surnames by script.
TITLES = {
    "male": "Mr Herr Herrn Monsieur Señor Sr Mister господин г-н".split(),
    "female": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Sra госпожа г-жа".split(),
}
GIVEN = {
    ("male", "latin"): (
        "James John Robert Michael William David Richard Joseph Thomas Daniel Matthew Anthony Mark Paul Steven Andrew Peter "
        "Hans Klaus Jürgen Stefan Wolfgang Pierre Jean Michel Philippe Alain Antonio Manuel José Carlos Javier Miguel Luis"
    ).split(),
    ("female", "latin"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna "
        "Ursula Monika Petra Sabine Renate Marie Nathalie Isabelle Sylvie Catherine María Carmen Ana Isabel Laura Cristina Marta"
    ).split(),
    ("male", "cyrillic"): "Иван Сергей Александр Дмитрий Андрей Алексей Михаил Николай Владимир Павел Олег Юрий".split(),
    ("female", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Нина".split(),
}
SURNAMES = {
    "latin": (
        "Adler Baker Carter Dalton Ellis Foster Garner Harding Irving Jansen Keller Lambert Mercer Norton Osborne Parker "
        "Quinn Ramsey Sutton Thorne Underhill Vaughn Walker Yates Zeller Bergmann Fischer Moreau Navarro Ortega"
    ).split(),
    "cyrillic": "Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков Зайцев Орлов Крылов".split(),
}

_capital = r"[^\W\d_a-zа-яё][\w'’-]+"
_titled = re.compile(
    rf"\b(?P<title>{'|'.join(map(re.escape, sorted(sum(TITLES.values(), []), key=len, reverse=True)))})\.? "
    rf"(?:(?P<given>{_capital}) )?(?P<last>{_capital})"
)
_given_first = re.compile(rf"\b(?P<given>{'|'.join(sorted(sum(GIVEN.values(), []), key=len, reverse=True))}) (?P<last>{_capital})\b")
_titles = tuple(title + mark for title in sum(TITLES.values(), []) for mark in (" ", ". "))
_ending = re.compile(r"(?<=\w\w)(?:['’-]+s?)$")
_gender = {title: gender for gender, titles in TITLES.items() for title in titles}
_gender_of_given = {name: gender for (gender, _), names in GIVEN.items() for name in names}
_given_names = frozenset(_gender_of_given)

# Looked for around a mark that is found first, so that long runs of letters cost nothing.
_local_part = re.compile(r"[\w.%+-]{1,64}$")
_domain = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_ip = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_card = re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w])")
_ssn = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_phone = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w])")
_iban = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_access = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")
_label = re.compile(r"(\w+)[\"']?\s{0,3}$")
_assigned = re.compile(r"[=:]\s{0,3}[\"']?([^\s\"'<>,;]{6,})")
_secret_labels = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key")
_hex = re.compile(r"\b[0-9a-fA-F]{32,}\b")
_digit = re.compile(r"\d")
_word = re.compile(r"\w+")
_compound = re.compile(r"\w+(?:['’-]+\w+)*")

#: So many times an entity draws a surrogate as long as itself; and so many rounds there are before an error.
SAME_LENGTH, MOST_ROUNDS = 8, 200

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя"


def script_of(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def iban_valid(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of what is found, in order, without overlaps; the first kind found wins.

    Names found beside a title or a listed given name are then looked for in the rest of the text, as whole words with a capital.
    """
    found: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, kind: str, canonical: str) -> None:
        found.append((start, end, kind, canonical))

    def add_surname(start: int, last: str) -> None:
        last = _ending.sub("", last)  # "Mrs Berg's" names the same person
        add(start, start + len(last), f"surname:{script_of(last)}", last.lower())

    if "@" in text:
        for m in _domain.finditer(text):
            local = _local_part.search(text[max(0, m.start() - 64) : m.start()])
            if local:
                add(m.start() - len(local[0]), m.end(), "email", (local[0] + m[0]).lower())
    if "=" in text or ":" in text:
        reached = 0
        for mark in re.finditer("[=:]", text):
            if mark.start() < reached:
                continue
            label = _label.search(text[max(0, mark.start() - 40) : mark.start()])
            if label and label[1].lower().endswith(_secret_labels) and (m := _assigned.match(text, mark.start())):
                value = m[1].rstrip(".)]}")
                if any(c.isalpha() or c.isdigit() for c in value):  # else a mask or a line, which nothing can be drawn for
                    add(m.start(1), m.start(1) + len(value), "secret", value)
                reached = m.end()
    if _digit.search(text):
        if "AKIA" in text or "ASIA" in text:
            for m in _access.finditer(text):
                add(*m.span(), "access_key", m[0])
        for kind, pattern in (("iban", _iban), ("ip", _ip), ("card", _card), ("ssn", _ssn), ("phone", _phone)):
            for m in pattern.finditer(text):
                plain = re.sub(r"[^\w.]" if kind == "ip" else r"[\W_]", "", m[0])
                if kind != "iban" or iban_valid(plain):
                    add(*m.span(), kind, plain)
        words = text.split()
        if max(map(len, words), default=0) >= 32:
            for m in _hex.finditer(text):
                add(*m.span(), "secret", m[0])
    if any(title in text for title in _titles):
        for m in _titled.finditer(text):
            gender = _gender[m["title"]]
            if m["given"]:
                add(*m.span("given"), f"given:{gender}:{script_of(m['given'])}", m["given"].lower())
            add_surname(m.start("last"), m["last"])
    if not _given_names.isdisjoint(_word.findall(text)):  # what the pattern finds is such a run of letters
        for m in _given_first.finditer(text):
            add(*m.span("given"), f"given:{_gender_of_given[m['given']]}:{script_of(m['given'])}", m["given"].lower())
            add_surname(m.start("last"), m["last"])
    kept, reached = [], 0
    for _, entity in sorted(enumerate(found), key=lambda pair: (pair[1][0], pair[0])):
        if entity[0] >= reached:
            kept.append(entity)
            reached = entity[1]
    names: dict[str, str] = {}
    for _, _, kind, canonical in kept:
        if kind.startswith(("given:", "surname:")):
            names.setdefault(canonical, kind)
    return _with_further_mentions(text, kept, names) if names else kept


def _with_further_mentions(text: str, found: list[tuple[int, int, str, str]], names: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """``found`` and the words between that are one of ``names``, alone or as a part of a compound ("Berg's", "Berg-Haus")."""
    out, at = [], 0
    for start, end, *about in [*found, (len(text), len(text))]:
        for compound in _compound.finditer(text, at, start):
            whole = compound[0].lower() in names
            for m in [compound] if whole else _word.finditer(text, *compound.span()):
                # A word that what is found cuts off is not whole.
                cut = m.start() == at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")
                cut = cut or m.end() == start < len(text) and (text[start].isalnum() or text[start] == "_")
                if not cut and not m[0][0].islower() and (canonical := m[0].lower()) in names:
                    out.append((*m.span(), names[canonical], canonical))
        if about:
            out.append((start, end, *about))
        at = end
    return out


class _Stream:
    """Keyed numbers, as many as are asked for."""

    def __init__(self, key: bytes, *about: str) -> None:
        self.key, self.about, self.block, self.left = key, "\x1f".join(about).encode(), 0, []

    def below(self, limit: int) -> int:
        if not self.left:
            digest = hmac.new(self.key, self.about + b"\x1e%d" % self.block, hashlib.sha256).digest()
            self.left = [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 32, 4)]
            self.block += 1
        return self.left.pop() % limit


def _redrawn(text: str, stream: _Stream) -> str:
    """Digits for digits, letters of the same script and case for letters; all else stays."""
    hexadecimal = len(text) >= 8 and not text.isdigit() and all(c in "0123456789abcdefABCDEF" for c in text)
    out = []
    for c in text:
        if hexadecimal:
            new = "0123456789abcdef"[stream.below(16)]
            out.append(new.upper() if c.isupper() else new)
        elif c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            letters = CYRILLIC if "Ѐ" <= c <= "ӿ" else LATIN
            new = letters[stream.below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical form of the ``attempt``-th surrogate of an entity.

    Whoever draws more than ``SAME_LENGTH`` times has too small a pool: each further attempt then adds a character. Addresses,
    which cannot grow, move to 10.x.y.z from 192.168.x.y, and after twice as many attempts to any address.
    """
    stream = _Stream(key, kind, entity, str(attempt))
    more = max(0, attempt - SAME_LENGTH)
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        # Addresses of one domain stay together.
        return f"{_redrawn(local + 'x' * more, stream)}@{_redrawn(host, _Stream(key, 'domain', domain))}.{top}"
    if kind == "ip":
        first, second, *_ = parts = entity.split(".")
        fixed = {"10": 1, "127": 1}.get(first, 2 if (first, second) in {("192", "168")} else 0)
        if more and fixed == 2:
            parts, fixed = ["10"], 1
        if attempt > 2 * SAME_LENGTH:
            fixed = 0
        drawn = [str(1 + stream.below(223 if i == 0 else 254)) for i in range(4)]
        return ".".join(parts[:fixed] + drawn[fixed:])
    if kind == "card":
        body = entity[0] + _redrawn(entity[1:-1] + "0" * more, stream)
        valid = luhn(entity)
        ends = [d for d in "0123456789" if luhn(body + d) == valid]
        return body + ends[stream.below(len(ends))]
    if kind == "iban":
        body = _redrawn(entity[4:] + "0" * more, stream)
        return next(iban for n in range(2, 99) if iban_valid(iban := f"{entity[:2]}{n:02d}{body}"))
    if kind == "phone":
        fixed = 1 if entity[0] == "1" else 2
        return entity[:fixed] + _redrawn(entity[fixed:] + "0" * more, stream)
    if kind == "access_key":
        return entity[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[stream.below(32)] for _ in entity[4:])
    if kind.startswith("given:"):
        _, gender, script = kind.split(":")
        names = GIVEN[gender, script]
        return "-".join(names[stream.below(len(names))].lower() for _ in range(1 + attempt))
    if kind.startswith("surname:"):
        names = SURNAMES[kind.split(":")[1]]
        return "-".join(names[stream.below(len(names))].lower() for _ in range(2 + attempt))
    return _redrawn(entity + ("0" if entity.isdigit() else "x") * more, stream)


def written_like(mention: str, kind: str, canonical: str) -> str:
    """A canonical surrogate in the format of a mention: its separators, its capitals."""
    if kind.startswith(("given:", "surname:")):
        return canonical.upper() if mention.isupper() and len(mention) > 1 else canonical.title()
    if kind == "email":
        return canonical.upper() if mention.isupper() else canonical
    if kind in ("card", "iban", "phone", "ssn"):
        rest = iter(canonical)
        return "".join([next(rest) if c.isalnum() else c for c in mention]) + "".join(rest)
    return canonical


@lru_cache(maxsize=200_000)
def _first(key: bytes, kind: str, entity: str) -> str:
    return surrogate(key, kind, entity, 0)


def replaced(text: str, key: bytes, redrawn: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, kind) of what was replaced, as places in the original."""
    out, at, spans = [], 0, []
    for start, end, kind, entity in entities(text):
        attempt = redrawn.get((kind, entity), 0)
        new = _first(key, kind, entity) if not attempt else surrogate(key, kind, entity, attempt)
        out += [text[at:start], written_like(text[start:end], kind, new)]
        spans.append((start, end, kind))
        at = end
    return "".join(out) + text[at:], spans


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(number, kind, entity) for number, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True) for _, _, kind, entity in entities(text)]
        number, kind, entity = zip(*dict.fromkeys(pairs)) if pairs else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(kind, pa.string()), pa.array(entity, pa.string())], names=["text_hash", "kind", "entity"])


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [surrogate(key, *row) for row in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=[*batch.schema.names, "surrogate"])

    return run


_DRAWN = "kind string, entity string, attempt int, surrogate string"


def drawn_again(found: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``entity``, ``attempt`` of all entities whose first surrogate was not free.

    In each round everyone's present surrogate is compared with all others' and with all real entities; of
    several entities with one surrogate the one of fewest attempts, then the smallest, keeps it. Rounds end when nobody loses. Pools
    grow with attempts, except that of all addresses: a corpus that leaves none free is an error.
    """
    people = materialize(found.select("kind", "entity").distinct(), "entities").rows
    current = materialize(people.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), _DRAWN), "surrogates")
    for _ in range(MOST_ROUNDS):
        taken = current.rows.groupBy("kind", "surrogate").agg(
            F.min(F.struct("attempt", "entity")).alias("owner"), F.count(F.lit(1)).alias("n")
        )
        real = people.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        taken = taken.join(real, ["kind", "surrogate"], "left").where("n > 1 OR real")
        taken = materialize(taken, "clashes")
        if not taken.count:
            return current.rows.where("attempt > 0").select("kind", "entity", "attempt")
        judged = current.rows.join(taken.rows, ["kind", "surrogate"], "left")
        loses = F.col("n").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("owner.entity") != F.col("entity")))
        drawn = judged.select("kind", "entity", (F.col("attempt") + loses.cast("int")).alias("attempt"))
        following = materialize(drawn.mapInArrow(_draw(key), _DRAWN), "surrogates")
        current.drop()
        current = following
    raise ValueError(f"after {MOST_ROUNDS} rounds some entities have no surrogate of their own")


def _apply(key: bytes, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = batch.column(batch.num_columns - 1).to_pylist()
            done = [
                replaced(text, key, {(row["kind"], row["entity"]): row["attempt"] for row in rows or ()})
                for text, rows in zip(texts_of(batch, place), again, strict=True)
            ]
            columns = batch.columns[:-1]
            columns[place] = pa.array([text for text, _ in done], pa.string())
            spans = [[{"kind": kind, "start": start, "end": end} for start, end, kind in spans] for _, spans in done]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            columns += [pa.array([len(row) for row in spans], pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_entities", "entities"])

    return run


def replace_entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, ``n_entities``, and ``entities`` (kind, start, end in the original text).

    Row by row, all columns kept; null and empty texts come back empty without entities, repeated rows
    repeated and alike. Columns of ``docs`` named like the new ones give way to them. The same key gives the same surrogates
    for the same corpus; whoever has no key cannot tell entities from surrogates.
    """
    docs = docs.drop(*({"n_entities", "entities"} - {text}))
    hashed = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    found = materialize(hashed.mapInArrow(_extract, "text_hash long, kind string, entity string"), "mentions").rows
    again = drawn_again(found, key)
    # What a text has to look up is a part of the text: one row per text, however often it occurs.
    known = found.join(again, ["kind", "entity"]).groupBy("text_hash")
    known = materialize(known.agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("again")), "drawn_again").rows
    marked = docs.join(known, F.xxhash64(F.coalesce(docs[text], F.lit(""))) == known["text_hash"], "left")
    marked = marked.select(*(docs[name] for name in docs.columns), known["again"])
    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([*fields, StructField("n_entities", LongType()), StructField("entities", ArrayType(span))])
    return marked.mapInArrow(_apply(key, docs.columns.index(text)), schema)
