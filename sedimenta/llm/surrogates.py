"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is a keyed permutation of all values of the same format, without fixed points: two values never get the same one, a value gets
the same one in every document (coreference), and none keeps its own. Digits stay digits, vowels vowels of their script, case
and separators stay where they are; a card number and an IBAN keep whether their check digits are right, a telephone number its country code, an address
of a network its range (private, loopback, link-local or public), a date of birth is a date again; a known given name becomes another of its gender
and script, and other names keep a last vowel, which tells the gender in many languages. A person is found after a title or by a known given name before a surname; each part of the name is then replaced wherever the document
has it, before or after, by the same surrogate.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.rows import tidy

KINDS = ("email", "secret", "iban", "ipv4", "ipv6", "birth", "ssn", "phone", "card", "person")
SCHEMA = "doc_id long, text string, n_entities int, " + ", ".join(f"n_{k} int" for k in KINDS)
# Titles by gender (f, m, or u where it tells none), and common given names by script and gender.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Doña Госпожа Κυρία".split(),
    "m": "Mr Mister Sir Herr Monsieur Señor Господин Κύριος".split(),
    "u": "Dr Prof Professor".split(),
}
GIVEN = {
    "f": [(
        "Mary Anna Emma Laura Julia Sarah Alice Clara Sophie Marie Elena Lucía Carmen Greta Ingrid Hannah Elizabeth Jennifer Linda Susan Jessica Karen Margaret Emily "
        "Olivia Charlotte Katharina Claudia Sabine Ursula Johanna Françoise Nathalie Isabelle Camille Chloé Juliette María Ana Isabel Sofía Beatriz Giulia Francesca Zofia Agnieszka Magdalena Astrid"
    ).split(), "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(), "Μαρία Ελένη Άννα Σοφία Κατερίνα".split()],
    "m": [(
        "John James Robert Peter Thomas Paul Martin Daniel Pierre Louis Jean Carlos Miguel Hans Karl Stefan William Richard Michael David Joseph Charles Christopher Matthew "
        "Anthony Andrew Wolfgang Jürgen Klaus Dieter Matthias Friedrich François Nicolas Antoine Olivier Étienne José Antonio Francisco Javier Alejandro Giovanni Marco Tomasz Krzysztof Lars Sven"
    ).split(), "Иван Пётр Сергей Алексей Николай Андрей Михаил Павел".split(), "Γιώργος Νίκος Πέτρος Ανδρέας Παύλος".split()],
}
#: Letters that may stand for each other; upper case goes with lower.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüœ", "çñýÿšžß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αειουηω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "٠١٢٣٤٥٦٧٨٩"]
CLASS = {c: k for k, letters in enumerate(CLASSES) for c in letters}
RANGES = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939)]
TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
PARTICLE = "von van der den de del la di da du zu"
GIVEN_NAMES = frozenset(n for scripts in GIVEN.values() for names in scripts for n in names)
LISTED = "|".join(sorted(GIVEN_NAMES, key=len, reverse=True))
BEFORE = rf"(?:(?:{'|'.join(PARTICLE.split())}|[^\W\d_]\.)[ ])*"
# What stands before a date of birth.
BORN = r"DOB:?|D\.O\.B\.:?|[Dd]ate[ ]of[ ][Bb]irth:?|[Bb]irth[ ]?date:?|[Bb]orn(?:[ ]on)?:?|[Gg]eboren[ ]am|[Gg]eburtsdatum:?|[Nn]ée?[ ]le|[Dd]ate[ ]de[ ]naissance:?|[Nn]acid[oa][ ]el|[Ff]echa[ ]de[ ]nacimiento:?"
BORN_BEFORE = 2030
#: Country codes of two digits; those of one are 1 and 7, all others have three.
TWO_DIGITS = frozenset(map(str, [20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98]))
#: Ranges of addresses (first, size in bits) that a surrogate doesn't leave.
NETWORKS = [(10 << 24, 24), (127 << 24, 24), ((169 << 8 | 254) << 16, 16), ((172 << 8 | 16) << 16, 20), ((192 << 8 | 168) << 16, 16)]
NAME = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
ENTITY = re.compile(
    rf"""(?P<email>(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?![\w-]))
    |(?P<secret>(?<![A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Z0-9])|(?<=password=)[^\s"'<>&]{{6,}}|(?<=["'])[0-9a-fA-F]{{32,}}(?=["'])|(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{{32,}}(?![0-9A-Za-z]))
    |(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
    |(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}}::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}})?|::[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}})(?![\w:]))
    |(?P<birth>(?<!\w)(?:{BORN})[ ]?(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}(?P<mark>[./-])\d{{1,2}}(?P=mark)\d{{4}})(?!\d))
    |(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<phone>(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}(?!\w)|(?<![\w(])(?:\(\d{{3}}\)[ ]?|\d{{3}}[.-])\d{{3}}[.-]\d{{4}}(?!\w))
    |(?P<card>(?<![\w.])\d(?:[ -]?\d){{12,18}}(?!\w))
    |(?P<person>(?<!\w)(?:(?:{TITLE})\.?[ ])+{BEFORE}{NAME}(?:[ ]{BEFORE}{NAME}){{0,2}}|(?<!\w)(?:{LISTED})(?:[ ](?:{LISTED})(?!\w))*[ ]{BEFORE}{NAME})""",
    re.X,
)
DIGIT, NAMED, NAMES = re.compile(r"[\d@]|A[KS]IA"), re.compile(rf"(?<!\w)(?:(?:{TITLE})\.?|{LISTED})[ ]"), re.compile(rf"(?<!\w){NAME}")
OWN = re.compile("['’]s$")


class Permutation:
    """A keyed permutation of 0 .. size-1 without fixed points: a Feistel network, walked until it lands inside, around a shift by one."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size, self.half = size, (max(2, size - 1).bit_length() + 1) // 2
        self.mac = hashlib.blake2b(f"{label}:{size}".encode(), key=key[:64], digest_size=64)

    def _round(self, k: int, x: int) -> int:
        mac = self.mac.copy()
        mac.update(bytes([k]) + x.to_bytes(self.half // 8 + 1, "big"))
        digest = mac.digest()
        while len(digest) * 8 < self.half:
            mac.update(b"+")
            digest += mac.digest()
        return int.from_bytes(digest, "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, rounds: range) -> int:
        mask = (1 << self.half) - 1
        while True:
            left, right = x >> self.half, x & mask
            for k in rounds:
                if rounds.step > 0:
                    left, right = right, left ^ self._round(k, right)
                else:
                    left, right = right ^ self._round(k, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        return self._walk((self._walk(x, range(8)) + 1) % self.size, range(7, -1, -1))


def _upper(c: str) -> str:
    return "ẞ" if c == "ß" else c.upper()


def _lower(text: str) -> str:
    """In lower case, but for letters that upper case would not bring back."""
    return "".join(c.lower() if len(c.lower()) == 1 and _upper(c.lower()) == c else c for c in text)


def _alphabet(c: str) -> tuple[object, int, int]:
    """Class, place in it and size of it; size 1 for what stays."""
    low = _lower(c)
    if low in CLASS:
        k = CLASS[low]
        return k, CLASSES[k].index(low), len(CLASSES[k])
    if c.isdecimal():
        value = unicodedata.decimal(c)
        return (ord(c) - value, ord(c) - value + 9), value, 10
    for a, b in RANGES:
        if a <= ord(c) <= b:
            return (a, b), ord(c) - a, b - a + 1
    return c, 0, 1


def permuted(text: str, key: bytes, kind: str) -> str:
    """Another text of the same format: each symbol comes from its own class, all symbols together are permuted."""
    found = [_alphabet(c) for c in text]
    size, rank = 1, 0
    for _, place, n in found:
        size, rank = size * n, rank * n + place
    rank = Permutation(key, f"{kind}:{[str(k) for k, _, n in found if n > 1]}", size)(rank)
    out = []
    for c, (k, _, n) in zip(reversed(text), reversed(found), strict=True):
        rank, place = divmod(rank, n)
        new = c if n == 1 else CLASSES[k][place] if isinstance(k, int) else chr(k[0] + place)
        out.append(_upper(new) if n > 1 and c != _lower(c) else new)
    return "".join(reversed(out))


def _refill(text: str, symbols: str, at: str = r"\d") -> str:
    it = iter(symbols)
    return re.sub(at, lambda m: next(it), text)


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = sum(x - 9 * (x > 9) for x in (int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(digits))))
    return -total % 10


def _card(text: str, key: bytes) -> str:
    d = re.sub(r"\D", "", text)
    new = permuted(d[:-1], key, "card")
    return _refill(text, new + chr(ord(d[-1]) - int(d[-1]) + (luhn(new) + int(d[-1]) - luhn(d[:-1])) % 10))


def _ipv4(text: str, key: bytes) -> str:
    n = 0
    for x in text.split("."):
        n = n * 256 + int(x)
    inside = next(((a, bits) for a, bits in NETWORKS if a <= n < a + (1 << bits)), None)
    if inside:
        n = inside[0] + Permutation(key, f"ipv4:{inside[0]}", 1 << inside[1])(n - inside[0])
    else:
        public = Permutation(key, "ipv4", 1 << 32)
        n = public(n)
        while any(a <= n < a + (1 << bits) for a, bits in NETWORKS):  # walked on, which keeps it one to one
            n = public(n)
    zero = ord(text[0]) - int(text[0])
    return ".".join("".join(chr(zero + int(c)) for c in str(n >> s & 255)) for s in (24, 16, 8, 0))


def _ipv6(text: str, key: bytes) -> str:
    """The first 16 bits, which tell the kind of network, stay."""
    n = int(ipaddress.IPv6Address(text))
    head, bits = n >> 112, (1 << 112) - 1
    return str(ipaddress.IPv6Address(head << 112 | Permutation(key, f"ipv6:{head}", 1 << 112)(n & bits)))


def _date(text: str) -> tuple[datetime.date, str] | None:
    """The date and the order of its parts; a day of a month where both orders would do."""
    parts = [int(x) for x in re.split("[./-]", text)]
    for order_ in ("ymd",) if len(re.match(r"\d+", text)[0]) == 4 else ("dmy", "mdy"):
        held = dict(zip(order_, parts, strict=True))
        try:
            return datetime.date(held["y"], held["m"], held["d"]), order_
        except ValueError:
            continue
    return None


def _birth(text: str, key: bytes) -> str:
    """Another day from 1900 on and before BORN_BEFORE, written in the same way; what is no date of those years is permuted by its digits."""
    written = re.search(r"\d[\d./-]*$", text)[0]
    label, found = text[: -len(written)], _date(written)
    if not found or not 1900 <= found[0].year < BORN_BEFORE:
        return label + permuted(written, key, "no birth")
    start, wide = datetime.date(1900, 1, 1).toordinal(), len(re.split("[./-]", written)[1]) == 2
    day = datetime.date.fromordinal(start + Permutation(key, "birth", datetime.date(BORN_BEFORE, 1, 1).toordinal() - start)(found[0].toordinal() - start))
    mark = re.search("[./-]", written)[0]
    return label + mark.join(f"{day.year:04d}" if c == "y" else f"{day.month if c == 'm' else day.day:0{2 if wide else 1}d}" for c in found[1])


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: bytes) -> str:
    """The country stays, and whether the check digits are right; check digits that no account has stay as they are."""
    solid = text.replace(" ", "")
    new = permuted(text[4:], key, f"iban{text[:2]}")
    given = int(solid[2:4])
    if 2 <= given <= 98:
        right, fresh = (98 - _mod97(x + solid[:2] + "00") for x in (solid[4:], new.replace(" ", "")))
        given = (given - right + fresh - 2) % 97 + 2
    return f"{text[:2]}{given:02d}{new}"


def country_code(text: str) -> str:
    digits = "".join(str(unicodedata.decimal(c)) for c in re.match(r"\+(\d{0,3})", text)[1])
    return text[: 1 + (1 if digits[:1] in ("1", "7") else 2 if digits[:2] in TWO_DIGITS else len(digits))]


def _phone(text: str, key: bytes) -> str:
    """The country code stays where one is given."""
    code = country_code(text) if text[0] == "+" else ""
    rest = text[len(code) :]
    return code + _refill(rest, permuted(re.sub(r"\D", "", rest), key, f"phone{code}"))


def _email(text: str, key: bytes) -> str:
    """The domain's last label stays; people of one domain stay together."""
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{_cased(local, permuted(_lower(local), key, 'local'))}@{_cased(name, permuted(_lower(name), key, 'domain'))}.{top}"


def _cased(like: str, new: str) -> str:
    return "".join(_upper(n) if c != _lower(c) else n for c, n in zip(like, new, strict=True))


def _given(name: str, key: bytes) -> str:
    for gender, scripts in GIVEN.items():
        for k, names in enumerate(scripts):
            if name in names:
                return names[Permutation(key, f"given:{gender}:{k}", len(names))(names.index(name))]
    if name.isupper() and name.capitalize() in GIVEN_NAMES:
        return _given(name.capitalize(), key).upper()
    ending = name[-1] if len(name) > 2 and name[-1].lower() in "aeiouаеиоуяαηο" else ""
    other = lambda x: permuted(x[: len(x) - len(ending)], key, f"name{ending.lower()}") + ending
    new = other(name)
    while new.capitalize() in GIVEN_NAMES:
        new = other(new)
    return new


def _person(text: str, key: bytes) -> str:
    title, names = re.match(rf"((?:(?:{TITLE})\.?[ ])*)(.*)", text, re.S).groups()
    return title + "".join(_given(n, key) if k % 2 == 0 and n not in PARTICLE.split() else n for k, n in enumerate(re.split(r"([ -]|['’]s(?![^\W\d_]))", names)))


def _parts(text: str) -> set[str]:
    """The words of a person's name that stand for the person, as written and in capitals."""
    names = re.sub(rf"^(?:(?:{TITLE})\.?[ ])+", "", text)
    parts = {n for n in re.split(r"[ -]|['’]s(?![^\W\d_])", names) if len(n) > 1 and n[-1] != "." and n not in PARTICLE.split()}
    return parts | {n.upper() for n in parts} | {n.capitalize() for n in parts if n.isupper()}


def mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What was found, and every other place of a part of a found person's name."""
    parts = {p for a, b, kind in found if kind == "person" for p in _parts(text[a:b])}
    if not parts:
        return found
    out, k = list(found), 0
    for m in NAMES.finditer(text):
        at = m.start()
        while k < len(found) and found[k][1] <= at:
            k += 1
        whole = OWN.sub("", m[0])
        for word in [whole] if whole in parts else whole.split("-"):
            end = at + len(word)
            if word in parts and not (k < len(found) and found[k][0] < end):
                out.append((at, end, "person"))
            at = end + 1
    return sorted(out)


def surrogate(kind: str, text: str, key: bytes) -> str:
    by = {"email": _email, "ipv4": _ipv4, "ipv6": _ipv6, "birth": _birth, "iban": _iban, "phone": _phone, "card": _card, "person": _person}
    if kind == "secret":
        if not re.fullmatch(r"[0-9a-fA-F]{32,}", text):
            head = 4 if re.match("AKIA|ASIA", text) else 0
            new = permuted(text[head:], key, f"secret{text[:head]}")
            while not head and re.match("AKIA|ASIA|[0-9a-fA-F]{32,}$", new):  # those are surrogates of other formats
                new = permuted(new, key, "secret")
            return text[:head] + new
        low = text.lower()
        n = Permutation(key, f"secret:{len(low)}", 16 ** len(low))(int(low, 16))
        return _cased(text, f"{n:0{len(low)}x}")
    if kind == "ssn":
        return _refill(text, permuted(re.sub(r"\D", "", text), key, "ssn"))
    return by[kind](text, key)


def canonical(kind: str, value: str) -> str:
    """One form for all ways to write a value: addresses as numbers, hexadecimal keys in lower case."""
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(value))
    if kind == "birth":
        written = re.search(r"\d[\d./-]*$", value)[0]
        found = _date(written)
        return found[0].isoformat() if found and 1900 <= found[0].year < BORN_BEFORE else written
    return value.lower() if kind == "secret" and re.fullmatch(r"[0-9a-fA-F]{32,}", value) else value


def entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each; none overlap, none goes past its line, and only lines with a digit, @, title or given name are looked at
    before the parts of the names found there are looked for everywhere."""
    titled = (any(t in text for ts in TITLES.values() for t in ts) or any(n in text for n in GIVEN_NAMES)) and NAMED.search(text)
    if not titled and not DIGIT.search(text) and "password=" not in text:
        return []
    out, at = [], 0
    for line in text.split("\n"):
        if DIGIT.search(line) or titled and NAMED.search(line) or "password=" in line:
            out += [(at + m.start(), at + m.end(), next(k for k in KINDS if m[k] is not None)) for m in ENTITY.finditer(line)]
        at += len(line) + 1
    return mentions(text, out)


class Replacer:
    """Rewrites texts; `settled` holds the surrogates of (kind, canonical value) that collided in the corpus."""

    def __init__(self, key: str, settled: dict[tuple[str, str], str] | None = None) -> None:
        self.key, self.settled = key.encode(), settled or {}
        self.known = lru_cache(1 << 16)(self._surrogate)

    def _surrogate(self, kind: str, value: str) -> str:
        return self.settled.get((kind, canonical(kind, value))) or surrogate(kind, value, self.key)

    def __call__(self, text: str) -> tuple[str, list[str]]:
        found, out, at = entities(text), [], 0
        for start, end, kind in found:
            out += (text[at:start], self.known(kind, text[start:end]))
            at = end
        return "".join(out) + text[at:] if found else text, [kind for *_, kind in found]


def replace_entities(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the text with surrogates, and how many entities of each kind it had.

    Null texts stay null, texts without entities come out as they were, and very long texts are rewritten whole. Repeated rows
    give equal results; a null key stays null; other columns are ignored. The same secret gives the same surrogates in every run.
    All values of the corpus are checked for collisions first; values that collide get other surrogates.
    """
    settled = settle(surrogate_table(docs, secret, text), secret)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        replace = Replacer(secret, settled)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(1):
                new, kinds = replace(value.as_py()) if value.is_valid else (None, [])
                texts.append(new)
                counts.append((len(kinds), *map(kinds.count, KINDS)))
            columns = zip(*counts, strict=True) if counts else ((),) * (len(KINDS) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int32()) for c in columns)], names=["doc_id", "text", "n_entities", *(f"n_{k}" for k in KINDS)])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def surrogate_table(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """(kind, value, surrogate) of every different entity of all texts, values in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        replace = Replacer(secret)
        for batch in batches:
            rows = {(kind, canonical(kind, t[a:b]), canonical(kind, replace.known(kind, t[a:b]))) for t in batch.column(0).to_pylist() if t for a, b, kind in entities(t)}
            columns = zip(*rows, strict=True) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "value", "surrogate"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "kind string, value string, surrogate string").distinct()


def surrogate_collisions(table: DataFrame) -> DataFrame:
    """The collision check over the whole corpus: surrogates that stand for several values, and the least of these; none is expected."""
    return table.groupBy("kind", "surrogate").agg(F.count_distinct("value").alias("n"), F.min("value").alias("least")).where(F.col("n") > 1)


def settle(table: DataFrame, secret: str) -> dict[tuple[str, str], str]:
    """Other surrogates, that no value has, for all values that share one but the least of them."""
    clashes, out = surrogate_collisions(table).collect(), {}
    for clash in clashes:
        same = table.where((F.col("kind") == clash["kind"]) & (F.col("surrogate") == clash["surrogate"]) & (F.col("value") != clash["least"]))
        for value in sorted(r["value"] for r in same.select("value").distinct().collect()):
            new, k = clash["surrogate"], 0
            while new == value or (clash["kind"], new) in {(kind, s) for (kind, _), s in out.items()} or not table.where((F.col("kind") == clash["kind"]) & (F.col("surrogate") == new)).isEmpty():
                new, k = surrogate(clash["kind"], value, f"{k}:{secret}".encode()), k + 1
                if k > 1000:
                    raise ValueError(f"no surrogate of kind {clash['kind']} is left for a value")
            out[clash["kind"], value] = new
    return out
