"""Personal data: detection and keyed surrogates.

Every detected entity is replaced by one of the same type, script, gender and format, computed from
a secret key and the entity alone, so that mentions of one entity agree across the corpus.
Listed given names are permuted inside the names of their script and gender.  For all other types the
distinct entities of the corpus form a table; two entities that draw the same surrogate, or one that
draws a real entity, are told apart by drawing anew, until surrogates are as distinct as entities.
Spaces that run short grow with the attempts: emails and secrets get longer, private addresses leave their
block; after ``RELAXED`` attempts a surrogate may be another entity's real value, but no other's surrogate.

Mentions in other formats of the same entity ("+1 (212) 555-0100", "(212) 555-0100"; "SMITH", "Smith";
"2001:0db8:0:0:0:0:0:1", "2001:db8::1") share their surrogate and keep their own format.

Names are found by a listed given name before a surname, by a title, by a phrase such as "my name is", and
before an address in brackets; later mentions of either name are found in any case.  Card numbers have an
issuer's first digit and a valid check digit.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlink.llm.store import keep

DEFAULT_KEY = b"for tests only: give a secret key"

# Given names by script and gender, titles by gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "f"): "Alice Amelia Andrea Anna Beatriz Camille Carla Carmen Caroline Catherine Charlotte Claire Clara Elena Elizabeth Emily Emma Eva Frieda Gabriela Hannah Heidi Helen Ingrid Isabel Jane Jennifer Jessica Johanna Julia Karen Katharina Laura Linda Louise Lucia Margaret Maria Martha Mary Monika Nancy Natalie Olivia Patricia Rachel Rebecca Rosa Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Valentina Victoria".split(),
    ("latin", "m"): "Adam Albert Alejandro Alexander Andrew Antonio Benjamin Carlos Charles Christian Daniel David Diego Eduardo Eric Felix Fernando Francisco Frank George Hans Heinrich Henri Henry Hugo Jack Jacques James Javier John Jorge Joseph Juan Julian Karl Klaus Leon Louis Lucas Manuel Marc Martin Matthew Michael Miguel Nicolas Oliver Oscar Patrick Paul Pedro Peter Philip Pierre Richard Robert Samuel Stefan Thomas William".split(),
    ("cyrillic", "f"): "Александра Анастасия Анна Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Αλεξάνδρα Άννα Βασιλική Ειρήνη Ελένη Ευαγγελία Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Ανδρέας Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Dr": "", "Prof": ""}
SYLLABLES = {
    "latin": "bar bel ber bran cal car cor dal del den dor fal fen gal gor har hol kel ker lan lor mal mar mel mer mon nor pel per ran ros sal sel tal tor val ver vin wal win".split(),
    "cyrillic": "бар бел вер вол гор дор жар зел кар кор лан лер мар мел нор пол рад рос сав сел тар тор хол чер".split(),
    "greek": "βαλ γαρ δελ ζαν καρ κορ λαν μαν μελ νικ παλ ρας σαλ ταρ φιλ χαρ".split(),
}
ENDINGS = {"latin": {"": "son er ley field man well ton berg".split()}, "cyrillic": {"f": "ова ева ина".split(), "": "ов ев ин".split()}, "greek": {"": "ίδης όπουλος άκης ίου".split()}}
GIVEN_ENDINGS = {"latin": {"f": "a ina elle".split(), "m": "o us in".split(), "": "y is en".split()}, "cyrillic": {"f": "а ия".split(), "m": "ан ор".split(), "": "и".split()}, "greek": {"f": "α η".split(), "m": "ος ης".split(), "": "ι".split()}}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_GENDER = {name.casefold(): (script, g) for (script, g), names in GIVEN.items() for name in names}
_EMAIL = re.compile(r"(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+")
_SECRET = re.compile(r"(?i)(?<![A-Za-z])(?:token|api[_-]?key|access[_-]?key|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?([^\s\"'<>]{8,})")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMERIC = re.compile(r"(?<![\w.])(?:\+|\()?\d(?:[\d().\- ]{5,}\d|[\d.]{5,})(?!\w)")
_IP4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
_PHONE = re.compile(r"(?<!\d)(?:\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}([.\- ])\d{3}\1\d{4}|1[.\- ]\(?\d{3}\)?[.\- ]\d{3}[.\- ]\d{4})(?!\d)")
_SSN = re.compile(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)")
_UP = "A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ"
_TITLE = "Mr|Mrs|Ms|Miss|Herr|Frau|Señora?|Monsieur|Madame|Dr|Prof"
_CAPITAL = rf"[{_UP}]\w+(?:[\-'’]\w+)*"
_NAME = re.compile(rf"(?<!\w)(?:({_TITLE})\.? )?({_CAPITAL})(?: [{_UP}]\.)?(?: ({_CAPITAL}))?(?!\w)")
# Phrases after which a full name stands.
PHRASES = ("my name is", "full name:", "name:", "signed by", "signed,", "sincerely,", "regards,", "contact:", "contact person:", "attn:", "mein name ist", "ich heiße", "me llamo", "mi nombre es", "je m'appelle", "mon nom est", "меня зовут")
_PHRASE = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, PHRASES))})\s({_CAPITAL}) (?:[{_UP}]\. )?({_CAPITAL})(?!\w)")
_BEFORE_ADDRESS = re.compile(rf"(?<!\w)({_CAPITAL}) (?:[{_UP}]\. )?({_CAPITAL}) ?[<(](?=[\w.%+\-]+@)")
_MENTION = re.compile(rf"(?<!\w){_CAPITAL}(?!\w)")


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "")
            return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"
    return "latin"


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _phone(mention: str) -> str:
    """Ten digits for a number of the North American plan, with or without its 1; the digits, with a plus if there is one, of others."""
    digits = re.sub(r"[^\d+]", "", mention)
    bare = digits.lstrip("+")
    return bare[-10:] if len(bare) == 11 and bare[0] == "1" or len(bare) == 10 and bare == digits else digits


def _is_card(digits: str) -> bool:
    return digits[0] in "23456" and luhn(digits) == 0


def _address6(mention: str) -> str | None:
    """The full form of an IPv6 address; two bare letter groups around a double colon are none."""
    groups = [g for g in mention.split(":") if g]
    if len(groups) < 2 or len(groups) == 2 and not any(c.isdigit() for c in groups[0]):
        return None
    try:
        return ipaddress.IPv6Address(mention).exploded
    except ValueError:
        return None


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities (start, end, type, normal form) of a text, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text)]
        if "::" in text or text.count(":") >= 7:
            found += [(m.start(), m.end(), "ip6", full) for m in _IP6.finditer(text) if (full := _address6(m[0]))]
    for m in _NUMERIC.finditer(text):
        part, at = m[0], m.start()
        for kind, pattern in (("ip", _IP4), ("card", _CARD), ("phone", _PHONE), ("ssn", _SSN)):
            for x in pattern.finditer(part):
                digits = re.sub(r"[^\d]", "", x[0])
                if kind == "ip" and any(int(o) > 255 for o in x[0].split(".")) or kind == "card" and not _is_card(digits):
                    continue
                found.append((at + x.start(), at + x.end(), kind, x[0] if kind == "ip" else _phone(x[0]) if kind == "phone" else digits))
                part = part[: x.start()] + "#" * len(x[0]) + part[x.end() :]
    found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if _iban_rest(m[0].replace(" ", "")) == 1]
    found += _names(text)
    out: list[tuple[int, int, str, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _bare(word: str) -> str:
    """A name without the ending of the possessive."""
    return word[:-2] if word.endswith(("'s", "’s")) else word


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Given names and surnames: those that a list, a title, a phrase or an address shows, then all further mentions of them."""
    known: dict[str, tuple[str, str]] = {}

    def learn(given: str | None, surname: str, gender: str) -> None:
        if given:
            given = _bare(given).casefold()
            who = _GENDER.get(given)
            known.setdefault(given, ("given", f"{who[0]}:{who[1]}:{given}") if who else ("forename", f"{script_of(given)}:{gender}:{given}"))
            gender = who[1] if who else gender
        surname = _bare(surname).casefold()
        script = script_of(surname)
        known.setdefault(surname, ("surname", f"{script}:{gender if script == 'cyrillic' else ''}:{surname}"))

    for m in _NAME.finditer(text):
        title, first, last = m.groups()
        if title:
            learn(first if last else None, last or first, TITLES.get(title, ""))
        elif last and not first.isupper() and not last.isupper() and first.casefold() in _GENDER:
            learn(first, last, "")
    lower = text.lower()
    for pattern, there in ((_PHRASE, any(p in lower for p in PHRASES)), (_BEFORE_ADDRESS, "@" in text)):
        for m in pattern.finditer(text) if there else ():
            learn(m[1], m[2], "")
    if not known:
        return []
    out = []
    for m in _MENTION.finditer(text):
        word = _bare(m[0])
        got = known.get(word.casefold())
        if got:
            out.append((m.start(), m.start() + len(word), *got))
    return out


class _Stream:
    """An endless keyed stream of numbers."""

    def __init__(self, key: bytes, *about: str):
        self.key, self.about, self.n, self.pool = key, "\x1f".join(about).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.about + b"\x1e%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        got, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return got % n


def _like(text: str, s: _Stream) -> str:
    """Characters of the same classes: digit, letter of the script and case; others stay."""
    hexed = len(text) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
    out = []
    for c in text:
        if hexed:
            d = "0123456789abcdef"[s.below(16)]
            out.append(d.upper() if text.isupper() else d)
        elif c.isdigit():
            out.append(str(s.below(10)))
        elif c.isalpha():
            letters = LETTERS[script_of(c)]
            d = letters[s.below(len(letters))]
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the surrogate of an entity, drawn for the attempt-th time."""
    s = _Stream(key, kind, norm, str(attempt))
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        reserved = "example" in labels
        return _like(local, s) + _like("a" * max(0, attempt - 1), s) + "@" + ".".join(x if reserved or k == len(labels) - 1 else _like(x, s) for k, x in enumerate(labels))
    if kind == "ip":
        a, b, *_ = map(int, norm.split("."))
        if attempt > 3 and a in (10, 127, 172, 192):
            a, b = (10, 0) if attempt <= RELAXED else (0, 0)
        head = [10] if a == 10 else [192, 168] if (a, b) == (192, 168) else [172, 16 + s.below(16)] if a == 172 and 16 <= b < 32 else [127] if a == 127 else []
        while not head or head[0] in (10, 127, 172, 192) and len(head) == 1 and a not in (10, 127):
            head = [1 + s.below(223)]
        return ".".join(map(str, head + [1 + s.below(254) for _ in range(4 - len(head))]))
    if kind == "ip6":
        # Groups of zeros stay, so that short forms stay short, while there is room.
        return ":".join(g if g == "0000" and attempt < 2 else f"{1 + s.below((1 << 16) - 1):04x}" for g in norm.split(":"))
    if kind == "phone":
        plus, digits = norm.startswith("+"), norm.lstrip("+")
        fixed = max(0, len(digits) - 10) if plus else 0
        if len(digits) - fixed < 7:
            fixed = 0
        tail = "".join(str(2 + s.below(8)) if k == 0 else str(s.below(10)) for k in range(len(digits) - fixed))
        return "+" * plus + digits[:fixed] + tail
    if kind == "card":
        body = norm[0] + "".join(str(s.below(10)) for _ in norm[1:-1])
        return body + next(c for c in "0123456789" if luhn(body + c) == 0)
    if kind == "iban":
        body = _like(norm[4:], s)
        moved = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{98 - moved:02d}{body}"
    if kind in ("surname", "forename"):
        script, gender, _ = norm.split(":", 2)
        ends = ENDINGS[script].get(gender) or ENDINGS[script][""] if kind == "surname" else GIVEN_ENDINGS[script][gender]
        syllables = SYLLABLES[script]
        name = "".join(syllables[s.below(len(syllables))] for _ in range(2 + s.below(2) + min(attempt, 6))) + ends[s.below(len(ends))]
        return f"{script}:{gender}:{name}"
    return _like(norm, s) + _like("a" if norm.islower() else "A" if norm.isupper() else "7", s) * max(0, attempt - 3) * (kind == "secret")


def given_name(key: bytes, norm: str) -> str:
    """A keyed permutation, without fixed points, of the names of the script and gender."""
    script, gender, name = norm.split(":", 2)
    names = [n.casefold() for n in GIVEN[script, gender]]
    ring = sorted(names, key=lambda n: hmac.new(key, f"{script}{gender}{n}".encode(), hashlib.sha256).digest())
    return f"{script}:{gender}:{ring[(ring.index(name) + 1) % len(ring)]}"


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the format of a mention; of a number with more digits, as one with its country's, the last ones are replaced."""
    if kind in ("phone", "card", "ssn"):
        digits = new.lstrip("+")
        own = [c for c in mention if c.isdigit()]
        held = iter(own[: max(0, len(own) - len(digits))] + list(digits))
        return "".join(next(held) if c.isdigit() else c for c in mention)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind in ("given", "forename", "surname"):
        new = new.split(":", 2)[2]
        return new.upper() if mention.isupper() else "-".join(x.capitalize() for x in new.split("-"))
    if kind == "ip6":
        groups = [g for g in mention.split(":") if g]
        full = any(len(g) == 4 and g[0] == "0" for g in groups)
        short = ipaddress.IPv6Address(new).compressed if "::" in mention else ":".join(g if full else f"{int(g, 16):x}" for g in new.split(":"))
        return short.upper() if mention.upper() == mention and mention.lower() != mention else short
    if kind == "email":
        return new.upper() if mention.upper() == mention and any(c.isalpha() for c in mention) else new
    return new


def replace(text: str, found: list[tuple[int, int, str, str]], known: dict[tuple[str, str], str], key: bytes) -> str:
    """The text with the entities that ``detect`` has found replaced."""
    out, at = [], 0
    for start, end, kind, norm in found:
        new = given_name(key, norm) if kind == "given" else known[kind, norm]
        out += [text[at:start], render(kind, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]])


ENTITY = "array<struct<start:int,end:int,kind:string,norm:string>>"
_ENTITY = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))


def _find(at: int) -> Callable:
    """All rows with the entities of their text."""

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind", "norm"), e, strict=True)) for e in detect(t)] if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ENTITY)], names=[str(k) for k in range(batch.num_columns + 1)])

    return run


def _write(at: int, key: bytes) -> Callable:
    """Rows with found entities and the surrogates of theirs -> the rows with the new text and the number of entities."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 2
            texts, counts = [], []
            for text, found, known in zip(*(batch.column(c).to_pylist() for c in (at, n, n + 1)), strict=True):
                texts.append(replace(text, [(e["start"], e["end"], e["kind"], e["norm"]) for e in found], {(k["kind"], k["norm"]): k["new"] for k in known or []}, key))
                counts.append(len(found))
            columns = [*batch.columns[:n], pa.array(counts, pa.int64())]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(n + 1)])

    return run


#: Attempts after which a surrogate may equal a real value, and after which the space of a type counts as exhausted.
RELAXED, LAST = 8, 64


def _draw(key: bytes, attempt: int, rule: Callable[[bytes, str, str, int], str]) -> Callable:
    def run(batches):
        for batch in batches:
            new = [rule(key, kind, norm, attempt) for kind, norm in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "norm", "new"])

    return run


def assign(entities: DataFrame, key: bytes, rule: Callable[[bytes, str, str, int], str] = surrogate) -> DataFrame:
    """Distinct (kind, norm) -> (kind, norm, new), new distinct inside a kind and never a real entity of it."""
    real = entities.select("kind", F.col("norm").alias("new"))
    done, todo, attempt = None, entities, 0
    while True:
        drawn = keep(todo.mapInArrow(_draw(key, attempt, rule), "kind string, norm string, new string"), "drawn")
        free = drawn.where("norm <> new")
        if attempt <= RELAXED:
            free = free.join(real, ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "new"], "left_anti")
        won = keep(free.groupBy("kind", "new").agg(F.min("norm").alias("norm")).select("kind", "norm", "new"), "won")
        done = won if done is None else done.unionByName(won)
        todo = keep(drawn.select("kind", "norm").join(won, ["kind", "norm"], "left_anti"), "todo")
        if todo.isEmpty():
            return done
        attempt += 1
        if attempt > LAST:
            raise ValueError(f"no surrogates are left for some of {[r[0] for r in todo.select('kind').distinct().collect()]}")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes = DEFAULT_KEY, count_col: str | None = "n_entities") -> DataFrame:
    """The rows and columns of ``docs`` with the entities of the text replaced, and their number.

    Null and empty texts, and texts without an entity, stay as they are, with 0; an empty table stays empty.
    Repeated rows are treated alike.  ValueError if a type has fewer possible values than entities.  Other columns pass through, whatever their names (``count_col`` replaces one
    of its name; None leaves it out).
    """
    names = [c for c in docs.columns if c != count_col]
    rows = docs.select(*(F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(names)))
    at, n = names.index(text_col), len(names)
    fields = [T.StructField(str(k), f.dataType, True) for k, f in enumerate(rows.schema.fields)]
    found = rows.mapInArrow(_find(at), T.StructType([*fields, T.StructField(str(n), T._parse_datatype_string(ENTITY))]))
    # One pass finds everything; what it has read is written beside it, so that the texts are not searched again.
    found = keep(found.withColumn("row", F.monotonically_increasing_id()), "found", compression="zstd")
    touched = found.where(F.size(str(n)) > 0)
    mentions = touched.select("row", F.explode(str(n)).alias("e")).where("e.kind <> 'given'").select("row", "e.kind", "e.norm").distinct()
    entities = keep(mentions.select("kind", "norm").distinct(), "entities")
    lists = mentions.join(assign(entities, key), ["kind", "norm"]).groupBy("row").agg(F.collect_list(F.struct("kind", "norm", "new")).alias("known"))
    joined = touched.join(lists, "row", "left").select(*(str(k) for k in range(n + 1)), "known")
    schema = T.StructType([*fields, T.StructField(str(n), T.LongType())])
    others = found.where(F.size(str(n)) <= 0).select(*(str(k) for k in range(n)), F.lit(0).cast("long").alias(str(n)))
    out = joined.mapInArrow(_write(at, key), schema).unionByName(others)
    columns = [F.col(str(k)).alias(c) for k, c in enumerate(names)]
    return out.select(*columns, *([F.col(str(n)).alias(count_col)] if count_col else []))
