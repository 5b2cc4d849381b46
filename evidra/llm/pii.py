"""Private data replaced by keyed, type-consistent surrogates.

Detected: e-mail addresses, phone numbers, payment cards (with a valid checksum), IPv4 and MAC addresses, social security
numbers, IBANs, cloud access keys, assigned secrets (password, token, key ... = value), and names: after a title, or a listed
given name before a capitalised word. Dotted numbers after words such as "version" or "section" are no addresses. An
entity's surrogate is a keyed permutation of its form: digits stay digits, capitals capitals, hex stays hex, octets stay octets;
separators, country codes, top-level domains, key prefixes and card issuer digits stay. A phone number ends with its country's known
count of digits, where all have as many. Cards keep their checksum's remainder, so valid ones stay valid; IBANs get right check digits.

Names are replaced word by word, and every other mention of a name's part in its document too, so that parts agree wherever they
stand alone. A listed name followed by a word for a place, an institution or a thing is left. A listed given or family name becomes
another one of the same script and gender. Other words keep script, capitals, the pattern of vowels and consonants, and their last letter,
which marks gender in many languages; their permutation goes on until it gives no listed name, so listed names come from
listed names only. Where nothing in the form can vary, the surrogate is keyed letters.

All permutations are bijections on a form, and map an entity to itself only by a chance that the check below finds: different
entities never share a surrogate, and an entity has the same surrogate in every document, letter case and separators aside
(coreference). Each task so replaces without seeing others' entities. A check over all distinct entities confirms it: a group-by on
keyed digests of (type, surrogate) counts the entities; a type with a collision, or with an entity that is its own surrogate, gets
its next key, until none has one. Only the number of each type's key goes to the tasks.

Defined results: null text: null, no entities; empty text: unchanged; texts without private data are unchanged, byte by
byte; repeated rows get equal results; empty table: no rows; other columns pass through unless their names, in whatever case,
clash with entities or n_entities.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import map_batches, slices, without

#: The key of the registered query; a user passes one of their own.
KEY = b"evidra surrogates"

#: The forms of private data.
GIVEN = {
    "latin female": "Alice Amelia Angela Anna Barbara Camille Carla Caroline Catherine Christina Claire Clara Elena Elisabeth Emily Emma Eva Hannah Helena Ida Isabel Johanna Julia Katharina Laura Linda Lucia "
    "Margaret Maria Marie Monika Nora Olivia Patricia Rosa Sabine Sarah Silvia Sofia Susanne Teresa Valentina",
    "latin male": "Alexander Andrew Antonio Carlos Charles Daniel David Edward Felix François George Giovanni Henri Hugo James Javier Johannes John José Juan Julien Klaus Leo Luis Lukas Marco Martin Matthias Michael "
    "Miguel Nicolas Oscar Pablo Paul Peter Pierre Robert Simon Stefan Thomas Victor Walter William",
    "cyrillic female": "Анна Екатерина Елена Ирина Клара Мария Наталья Ольга Светлана Татьяна",
    "cyrillic male": "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Пётр Сергей",
    "greek female": "Άννα Ελένη Μαρία Σοφία", "greek male": "Γιώργος Κώστας Νίκος Πέτρος",
    "arabic female": "سارة فاطمة ليلى مريم", "arabic male": "أحمد علي عمر محمد",
    "hebrew female": "לאה רבקה רחל שרה", "hebrew male": "אברהם דוד יוסף משה",
}
#: Family names that become each other, by script, and by gender where it shows.
FAMILY = {
    "latin": "Bauer Becker Bernard Brown Davis Dubois Durand Evans Fernandez Fischer Garcia Gomez Hoffmann Jackson Johnson Jones Keller Laurent Leroy Lopez Martinez Meyer Miller Moore Moreau Morel Novak Perez Petit "
    "Richter Rodriguez Roux Ruiz Sanchez Schmidt Schneider Smith Taylor Torres Vogel Wagner Weber Williams Wilson",
    "cyrillic female": "Васильева Иванова Кузнецова Морозова Новикова Петрова Попова Смирнова Соколова Фёдорова",
    "cyrillic male": "Васильев Иванов Кузнецов Морозов Новиков Петров Попов Смирнов Соколов Фёдоров",
}
#: Words after or before a listed given name that make it a place, an institution or a thing.
NO_PERSON = frozenset(
    "Academy Avenue Award Beach Boulevard Bridge Castle Cathedral Church Clinic College Foundation Garden Gardens Hall High Highway Hospital House Institute Island Lake Lane Law Library Medal Memorial Mountain Museum "
    "Palace Park Paradox Platz Port Saint San Santa Plaza Principle Prize River Road School Square Station Straße Strasse Street Syndrome Theatre Theater Theorem Tower University Universität Université Universidad Village".split()
)
NOT_ADDRESSES = r"(?i)\b(?:version|release|revision|section|chapter|article|clause|ver|rev|v)[ .:]{0,2}$|§ ?$"
TITLES = r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Sr\.|Sra\.|Srta\.|Herr|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señor|Señora|Señorita|г-н|г-жа)"
IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9A-Za-z])"
#: Digits after the country code, where all of a country's numbers have as many.
PHONE_DIGITS = {1: 10, 7: 10, 30: 10, 31: 9, 33: 9, 34: 9, 41: 9, 45: 8, 47: 8, 48: 9, 61: 9, 90: 10, 91: 10, 351: 9, 420: 9}
FIXED_PHONE = r"\+(?:" + "|".join(rf"{c}(?:[ .-]?\(0\))?(?:[ .-]?\(?[0-9]\)?){{{n - 1}}}[ .-]?[0-9]" for c, n in PHONE_DIGITS.items()) + ")(?![0-9])"
#: Numbers of other lengths: nine digits or more before a blank and a dotted number, or else groups of digits, of which none begins an address.
ENDED_PHONE = r"\+[0-9](?:[ .-]?\(?[0-9]\)?){7,13}?[ .-]?[0-9](?= [0-9]+[.][0-9])"
LONG_PHONE = rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?|[0-9]{{1,4}}[ .-]?)[0-9]{{2,4}}(?:(?: (?!{IP})|[.-])?[0-9]{{2,4}}){{1,3}}"
GIVEN_NAMES = [n for names in GIVEN.values() for n in names.split()]
#: A capitalised word, or one of a script without capitals.
WORD = r"[^\W\d_a-zà-ÿа-яё][^\W\d_]+"
CAPITALS = r"[^\W\d_a-zà-ÿа-яё]{2,}(?!\w)"
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9_][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?i:\b(?:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token|private[_-]?key))(?: ?= ?[\"']?| ?: ?(?:[\"']|(?=[^\s\"']*[0-9])))(?P<secret>[A-Za-z0-9+/_.~!@#$%^&*-]{6,}={0,2})",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<access_key>[A-Z0-9]{16})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.+-])[3-6](?:[0-9]{12,18}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": rf"(?<![0-9A-Za-z(+.-])(?:{FIXED_PHONE}|{ENDED_PHONE}|{LONG_PHONE}|\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}})(?![0-9])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ip": IP,
    "name": rf"(?<!\w){TITLES} (?P<name>{WORD}(?:[ -]{WORD}){{0,2}})",
    "known": rf"(?<!\w)(?P<known>(?:{'|'.join(GIVEN_NAMES)})(?:[ -]{WORD}){{1,2}}|(?:{'|'.join(n.upper() for n in GIVEN_NAMES if n.upper() != n)})(?:[ -]{CAPITALS}){{1,2}})",
}
TYPES = list(PATTERNS)
TITLE_WORDS = [t.replace("\\", "") + " " for t in TITLES[3:-1].split("|")]


@functools.cache
def finder(kinds: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(f"(?P<{t}_>{PATTERNS[t]})" for t in kinds))


def possible(text: str) -> tuple[str, ...]:
    """The types that the text's characters allow for, in the order in which they are tried."""
    found = set()
    if "@" in text:
        found.add("email")
    if ("=" in text or ":" in text) and KEY_WORD.search(text):
        found.add("secret")
    if "AKIA" in text or "ASIA" in text:
        found.add("access_key")
    if ONE_DIGIT.search(text):
        runs = NUMBER.findall(text)
        if any(len(r) >= 7 for r in runs):
            found |= {"card", "ssn", "phone", "ip"}
        if IBAN_START.search(text):
            found.add("iban")
    if ":" in text and MAC_START.search(text):
        found.add("mac")
    if any(t in text for t in TITLE_WORDS):
        found.add("name")
    if GIVEN_NAME.search(text):
        found.add("known")
    return tuple(t for t in TYPES if t in found)


GIVEN_NAME = re.compile(rf"(?:{'|'.join([*GIVEN_NAMES, *(n.upper() for n in GIVEN_NAMES)])})[ -]")
BEFORE = re.compile(r"(\w+) $")
NOT_ADDRESS = re.compile(NOT_ADDRESSES)
KEY_WORD = re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|key|token) ?[=:]")
ONE_DIGIT = re.compile("[0-9]")
NUMBER = re.compile(r"[0-9][0-9 ().-]*")
IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
MAC_START = re.compile(r"[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:")


@dataclass
class Span:
    kind: str
    start: int
    end: int
    text: str


def luhn(digits: str) -> int:
    """The checksum's remainder; 0 for valid numbers."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10


def iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def detect(text: str) -> list[Span]:
    kinds = possible(text)
    if not kinds:
        return []
    found = []
    for m in finder(kinds).finditer(text):
        kind = next(t for t in kinds if m.group(f"{t}_") is not None)
        inner = kind if kind in ("secret", "access_key", "name", "known") else f"{kind}_"
        if kind == "iban" and iban_rest(m.group().replace(" ", "")) != 1 or kind == "card" and luhn(re.sub("[ -]", "", m.group())):
            continue
        if kind == "ip" and NOT_ADDRESS.search(text[max(0, m.start() - 16) : m.start()]):
            continue
        if kind == "known" and not person(text, *m.span(inner)):
            continue
        found.append(Span("name" if kind == "known" else kind, *m.span(inner), m.group(inner)))
    return with_mentions(text, found)


def person(text: str, start: int, end: int) -> bool:
    """Whether a listed given name with the words after it stands for a person: none of them, nor the next or the last word, names a
    place or the like, and no article goes before."""
    after = re.match(r" (\w+)", text[end : end + 40])
    before = BEFORE.search(text[max(0, start - 20) : start])
    around = [*re.split("[ -]", text[start:end]), after.group(1) if after else "", before.group(1) if before else ""]
    return not any(w.capitalize() in NO_PERSON for w in around if w)


def with_mentions(text: str, found: list[Span]) -> list[Span]:
    """found, and every other word of the text that is a part of one of its names, as it stands there, capitalised or in capitals: one who is named
    in full once is named by a part elsewhere."""
    parts = {w for s in found if s.kind == "name" for w in re.split("[ -]", s.text) if len(w) > 1}
    if not parts:
        return found
    words = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted({x for w in parts for x in (w, w.upper(), w.capitalize())}, key=len, reverse=True))) + r")(?!\w)")
    out, at = [], 0
    for s in [*found, Span("", len(text), len(text), "")]:
        for m in words.finditer(text, at, s.start):
            if person(text, *m.span()):
                out.append(Span("name", *m.span(), m.group()))
        if s.kind:
            out.append(s)
        at = s.end
    return out


VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
LETTERS = [*VOWELS.values(), *CONSONANTS.values(), "àáâãäåèéêëìíîïòóôõöøùúûüæ", "çñ", "άέήίόύώ"]


@functools.cache
def letters_like(c: str) -> str | None:
    """The small letters among which c varies: its class, or else those of its kind in its run of 128 code points."""
    if named_ := next((a for a in LETTERS if c in a), None):
        return named_
    kind = lambda x: (unicodedata.category(x), x.upper() != x)
    run = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    like = "".join(x for x in run if kind(x) == kind(c) and single_case(x) and not any(x in a for a in LETTERS))
    return like if c in like and len(like) > 1 else None


def single_case(x: str) -> bool:
    """A small or caseless letter whose capital is one letter that leads back to it."""
    return x.isalpha() and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x


@dataclass
class Form:
    """An entity as numbers: values[i] below bases[i] change; render() puts changed values back into the form."""

    values: list[int]
    bases: list[int]
    render: Callable[[list[int]], str]
    tag: str = ""
    rest: list[str] = field(default_factory=list)


def spelled(text: str, classes: list[str | None]) -> Form:
    """Characters with an alphabet vary in it, in lower case; the others stay. Capitals stay capitals."""
    places = [i for i, a in enumerate(classes) if a]

    def render(values: list[int]) -> str:
        out = list(text)
        for i, v in zip(places, values, strict=True):
            c = classes[i][v]
            out[i] = c.upper() if text[i].isupper() else c
        return "".join(out)

    values = [classes[i].index(text[i].lower()) for i in places]
    kept = "".join(c.lower() if a is None else "?" for c, a in zip(text, classes, strict=True))
    return Form(values, [len(classes[i]) for i in places], render, kept)


DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX = DIGITS + "abcdef"


def by_class(text: str) -> list[str | None]:
    if len(text) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return [HEX] * len(text) if text.upper() != text.lower() else [DIGITS] * len(text)
    return [DIGITS if c in DIGITS else SMALL if c.lower() in SMALL else None for c in text]


def digits_form(text: str, kept: int = 0, tail: int = 0) -> Form:
    """Digits vary but the first and last few; separators do not count for the entity."""
    places = [i for i, c in enumerate(text) if c in DIGITS]
    vary = places[kept : len(places) - tail]

    def render(values: list[int]) -> str:
        out = list(text)
        for i, v in zip(vary, values, strict=True):
            out[i] = str(v)
        return "".join(out)

    digits = "".join(text[i] for i in places)
    return Form([int(text[i]) for i in vary], [10] * len(vary), render, f"{digits[:kept]}:{len(digits)}")


#: The listed names, in small letters, of each listed name's script and gender, given and family names apart.
LISTED = {n.lower(): [x.lower() for x in names.split()] for names in [*FAMILY.values(), *GIVEN.values()] for n in names.split()}


def named(text: str) -> Form:
    """Letters vary among those like them in their script; a word's last letter stays."""
    classes: list[str | None] = []
    for i, c in enumerate(text):
        last = i + 1 == len(text) or not text[i + 1].isalpha()
        low = c.lower()
        own = len(low) == 1 and low.upper() in (c, c.upper()) and (c == low or c == low.upper())
        classes.append(letters_like(low) if own and not last else None)
    return spelled(text, classes)


class Surrogates:
    """Surrogates under a key; tweaks: the number of the key in use for each type."""

    def __init__(self, key: bytes, tweaks: dict[str, int] | None = None) -> None:
        self.key, self.tweaks = key, tweaks or {}
        self.known: dict[tuple[str, str], str] = {}

    def mac(self, *parts: str) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def permuted(self, kind: str, form: Form) -> list[int]:
        """A bijection without fixed points: each value but the first of several is shifted by a keyed function of all
        others, twice, and at last the first by one that is never nothing."""
        values, bases = list(form.values), form.bases
        tag = f"{kind}\x1e{self.tweaks.get(kind, 0)}\x1e{form.tag}\x1e{','.join(map(str, bases))}"
        for round_ in "ab":
            for i in range(1, len(values)):
                others = ",".join(map(str, values[:i] + values[i + 1 :]))
                values[i] = (values[i] + self.mac(tag, round_, str(i), others)) % bases[i]
        if values:
            values[0] = (values[0] + 1 + self.mac(tag, "z", ",".join(map(str, values[1:]))) % (bases[0] - 1)) % bases[0]
        return values

    def drawn(self, kind: str, text: str) -> str:
        """Keyed letters for a text in whose form nothing varies; collisions() sees to it that they are its own."""
        draw = self.mac(kind, str(self.tweaks.get(kind, 0)), "drawn", text.lower())
        new = "".join(SMALL[draw // 26**i % 26] for i in range(max(2, len(text))))
        return new.capitalize() if new != text.lower() else new[::-1]

    def name_word(self, word: str) -> str:
        """A word of a name: a listed one becomes the next of its list in a keyed order, any other a permutation."""
        if own := LISTED.get(word.lower()):
            order = sorted(own, key=lambda n: self.mac("name", str(self.tweaks.get("name", 0)), "listed", n))
            new = order[(order.index(word.lower()) + 1) % len(order)]
            return new.upper() if word.isupper() else new if word.islower() else new.capitalize()
        new, form = word, named(word)
        if not form.values:
            return self.drawn("name", word)
        while (new := self.shaped("name", named(new))).lower() in LISTED:
            pass
        return new

    def shaped(self, kind: str, form: Form) -> str:
        return form.render(self.permuted(kind, form))

    def make(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.rpartition("@")
            names, _, top = domain.rpartition(".")
            host = self.shaped("domain", spelled(names, by_class(names)))
            form = spelled(local, by_class(local))
            form.tag += f"@{domain.lower()}"
            return f"{self.shaped(kind, form)}@{host}.{top}"
        if kind == "phone":
            code = re.match(r"\+[0-9]{1,3}", text)
            head = code.group() if code and not text[code.end()].isdigit() else text[:2] if code else ""
            form = digits_form(text[len(head) :])
            return head + self.shaped(kind, form)
        if kind == "card":
            form = digits_form(text, kept=1, tail=1)
            rest = luhn(re.sub("[ -]", "", text))
            form.tag += f":{rest}"
            body = self.shaped(kind, form)[:-1]
            return body + str((rest - luhn(re.sub("[ -]", "", body) + "0")) % 10)
        if kind == "ip":
            octets = [int(o) for o in text.split(".")]
            vary = [i for i in range(4) if i or 1 <= octets[0] <= 223]
            form = Form(
                [octets[i] - (i == 0) for i in vary], [223 if i == 0 else 256 for i in vary],
                lambda v: ".".join(str(o) for o in ([v[0] + 1, *v[1:]] if 0 in vary else [octets[0], *v])), str(len(vary)) + ("" if 0 in vary else text.split(".")[0]),
            )
            return self.shaped(kind, form)
        if kind == "mac":
            return self.shaped(kind, spelled(text, [HEX if c.lower() in HEX else None for c in text]))
        if kind == "ssn":
            return self.shaped(kind, digits_form(text))
        if kind == "iban":
            compact = text.replace(" ", "")
            form = spelled(compact, [None] * 4 + by_class(compact[4:]) if not re.fullmatch("[0-9A-F]+", compact[4:]) else [None] * 4 + [DIGITS if c in DIGITS else SMALL for c in compact[4:]])
            form.tag = f"{compact[:2]}:{len(compact)}:{form.tag[4:]}"
            changed = self.shaped(kind, form)
            check = 98 - iban_rest(changed[:2] + "00" + changed[4:])
            letters = iter(changed[:2] + f"{check:02d}" + changed[4:])
            return "".join(c if c == " " else next(letters) for c in text)
        if kind == "name":
            return "".join(x if x in " -" else self.name_word(x) for x in re.split("([ -])", text))
        form = spelled(text, by_class(text))
        return self.shaped(kind, form) if form.values else self.drawn(kind, text)

    def of(self, kind: str, text: str) -> str:
        if (kind, text) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, text] = self.make(kind, text)
        return self.known[kind, text]

    def replaced(self, text: str) -> tuple[str, list[dict]]:
        """The text with surrogates, and what was replaced: type, place in the new text, surrogate."""
        spans = detect(text)
        if not spans:
            return text, []
        out, at, found, length = [], 0, [], 0
        for s in spans:
            new = self.of(s.kind, s.text)
            out += [text[at : s.start], new]
            length += s.start - at
            found.append({"type": s.kind, "start": length, "end": length + len(new), "surrogate": new})
            length += len(new)
            at = s.end
        return "".join([*out, text[at:]]), found


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind in ("phone", "card", "iban"):
        return re.sub(r"[ ().-]", "", text)
    return text.lower() if kind in ("email", "mac", "name") else text


ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surrogate", T.StringType())])
MADE = T.StructType([T.StructField("type", T.StringType()), T.StructField("entity", T.BinaryType()), T.StructField("surrogate", T.BinaryType()), T.StructField("kept", T.BooleanType())])


def collisions(docs: DataFrame, key: bytes, tweaks: dict[str, int], text: str = "text", make: type = Surrogates) -> list[str]:
    """Types in which different entities of docs would get one surrogate, or one itself. Only keyed digests are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own = make(key, tweaks)
        digest = lambda *x: hashlib.blake2b("\x1f".join(x).encode(), key=key[:64], digest_size=16).digest()
        for batch in batches:
            for some in slices(batch, 1024):
                spans = {(s.kind, s.text) for t in some.column(0).to_pylist() for s in detect(t)}
                if spans:
                    yield {"type": [k for k, _ in spans], "entity": [digest(k, canonical(k, t)) for k, t in spans], "surrogate": [digest(k, canonical(k, own.of(k, t))) for k, t in spans], "kept": [canonical(k, own.of(k, t)) == canonical(k, t) for k, t in spans]}

    made = map_batches(docs.where(F.col(text).isNotNull()).select(text), MADE, run)
    by = made.groupBy("type", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b"), F.bool_or(F.col("kept")).alias("kept"))
    return [r.type for r in by.where("a <> b OR kept").select("type").distinct().collect()]  # TYPES at most


def surrogates(docs: DataFrame, key: bytes, text: str = "text", make: type = Surrogates) -> DataFrame:
    """docs with private data replaced, entities (type, start, end, surrogate in the new text) and n_entities."""
    tweaks: dict[str, int] = {}
    while found := collisions(docs, key, tweaks, text, make):
        tweaks |= {t: tweaks.get(t, 0) + 1 for t in found}
    kept = without(docs, "entities", "n_entities")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("n_entities", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own = make(key, tweaks)
        for batch in batches:
            for some in slices(batch, 256):
                new = [own.replaced(t) if t is not None else (None, []) for t in some.column(text).to_pylist()]
                yield {c: some.column(c) for c in kept} | {text: [t for t, _ in new], "entities": [e for _, e in new], "n_entities": [len(e) for _, e in new]}

    return map_batches(docs.select(*kept), schema, run)
