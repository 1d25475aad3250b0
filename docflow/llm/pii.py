"""Personal data replaced by surrogates of the same type.

Found are e-mail addresses, phone numbers, IP addresses, payment cards (Luhn), IBANs (mod 97),
social security numbers and names: after a title or words that introduce one, a known first name before a surname, and
each word of a name found so wherever else it stands in the document. A
surrogate keeps the type and the format: letters stay letters of their script and case, digits
stay digits, separators stay, check digits are valid again, and a first name is replaced by one
of the same gender and script: a listed one by a listed one, any other by one with sounds of the same classes in
the same places and the same ending. Names are replaced word by word, a word by the same one throughout a document, so that
parts of a name refer to the same person as before.

Surrogates come from keyed permutations of each format's own values (a Feistel network over the
changeable characters), so that different entities get different surrogates and the same entity
gets the same one in every document, without a table of them. The collision check is by document:
a surrogate that equals an original of the document, or one given to another entity there, is
drawn again with the next tweak. After DRAWS of these a wider format is drawn from: any letters for
a first name, any country code, a whole IPv6 address, and then names and mailboxes grown by a letter.

Edge cases: a null text stays null and has none; an empty text stays; one row out for each row in;
repeated ids are handled alike; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow

SCHEMA = "doc_id long, n_entities long, spans string, text string"

# Titles with their gender, and first names by script and gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f",
    "Dr": "x", "Prof": "x", "Doctor": "x", "Professor": "x", "Господин": "m", "Госпожа": "f",
}
FIRST_NAMES = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Michel Philippe Alain Jacques José Antonio Manuel Francisco Carlos Miguel Luis Pedro Pablo".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Emma Laura Julia Ursula Monika Petra Sabine Claudia Marie Nathalie Isabelle Sylvie Catherine Françoise María Carmen Josefa Isabel Dolores Pilar Teresa Lucía Elena".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Борис".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
}
GENDERED = {name: key for key, names in FIRST_NAMES.items() for name in names}
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
VOWELS = set("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿаеиоуыэюяαεηιουω")
#: Consonants that can stand for each other without making a word hard to say.
SOUNDS = ["bcdgkpt", "fhsvwz", "lr", "mn", "jqxy", "бвгдкпт", "жзсхцчшщ", "лр", "мн"]
SOUND_OF = {c: s for s in SOUNDS for c in s} | {c: s.upper() for s in SOUNDS for c in s.upper()}
VOWELS |= {c.upper() for c in VOWELS if c != "ÿ"}

EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# Any run of groups with two colons, compressed or with a dotted end; ``is_ip`` judges it.
IPV6 = re.compile(r"(?<!\w)(?<![0-9A-Fa-f:]:)(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{0,38}(?:[0-9A-Fa-f]|::|:(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?!\w|:[\w:]|\.[0-9])")
IPV4 = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")
CARD = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?|[0-9]{1,5}[ .-])|\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![\w-])|(?<![\w.])\+[0-9]{8,15}(?!\w)")
#: Numbers without separators: with a trunk prefix, or after a word for a telephone.
COMPACT = re.compile(r"(?<![\w.+-])0[1-9][0-9]{8,11}(?![\w-]|\.[0-9])")
CALLED = re.compile(r"(?i)(?<!\w)(?:tel|tel[eé]fono|t[eé]l[eé]phone|telefon|phone|mobile|cell|fax|handy|call|called|text|whatsapp)(?: (?:is|at|me|me at|number|no|nr))?[.:]{0,2} ?([0-9]{7,15})(?![\w-]|\.[0-9])")
WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:[-'][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)*"
GIVEN = f"(?:{'|'.join(GENDERED)})"
KNOWN = f"{GIVEN}(?: {GIVEN})* {WORD}"
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({KNOWN}|{WORD}(?: {WORD})?)")
FULL = re.compile(rf"(?<!\w){KNOWN}")
NUMBER = re.compile(r"(?<![\w.+-])[0-9]{7,15}(?![\w-]|\.[0-9])")
#: Words after which a name comes, and others after which two capitalised words are one, in the languages of the titles.
INTRODUCED = re.compile(
    rf"(?<!\w)(?:(?i:this is|my name is|signed by|yours sincerely,|kind regards,|best regards,|ich heiße|mein name ist|je m'appelle|me llamo|mi nombre es|меня зовут)[ \n]({WORD}(?: {WORD}){{0,2}})"
    rf"|(?i:i am|i'm|ich bin|je suis|soy|contact|dear|regards,)[ \n]({WORD}(?: {WORD}){{1,2}}))(?!\w)"
)
SINGLE = re.compile(WORD)
DATE = re.compile(r"[0-9]{4}([-. ])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-. ])[0-9]{2}\2[0-9]{4}")
DIGIT = re.compile(r"[0-9]")
#: Surrogates drawn from a format before a wider one is taken.
DRAWS = 1000
Entity = tuple[str, int, int]


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn_sum(number: str) -> int:
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(number)))


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def is_ip(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def is_iban(text: str) -> bool:
    return 15 <= len(flat := text.replace(" ", "")) <= 34 and iban_rest(flat) == 1


def detect(text: str) -> list[Entity]:
    """Entities by place; where two overlap, the kind that is listed first stays."""
    found: list[Entity] = []
    if "@" in text:
        found += (("email", *m.span()) for m in EMAIL.finditer(text))
    if DIGIT.search(text) or "::" in text:
        for kind, pattern, valid in (
            ("iban", IBAN, is_iban),
            ("ip", IPV6, lambda x: x != "::" and is_ip(x)),
            ("ip", IPV4, is_ip),
            ("card", CARD, lambda x: luhn_sum(digits(x)) % 10 == 0),
            ("ssn", SSN, bool),
            ("phone", PHONE, lambda x: 7 <= len(digits(x)) <= 15 and not DATE.fullmatch(x)),
        ):
            found += ((kind, *m.span()) for m in pattern.finditer(text) if valid(m[0]))
    if DIGIT.search(text):
        found += (("phone", *m.span()) for m in COMPACT.finditer(text))
        called = [("phone", *m.span(1)) for m in CALLED.finditer(text)]
        numbers = {text[s:e] for _, s, e in called}
        found += called + ([("phone", *m.span()) for m in NUMBER.finditer(text) if m[0] in numbers] if numbers else [])
    names = [("name", m.start(2), m.end(2)) for m in TITLED.finditer(text)]
    names += (("name", *m.span()) for m in FULL.finditer(text))
    names += (("name", *m.span(m.lastindex)) for m in INTRODUCED.finditer(text))
    if names:  # their words, wherever else they stand
        known = {w for _, s, e in names for w in text[s:e].split(" ")}
        names += (("name", *m.span()) for m in SINGLE.finditer(text) if m[0] in known and not text[m.end() : m.end() + 1].isalnum() and not text[max(0, m.start() - 1) : m.start()].isalnum())
    found += names
    taken: list[Entity] = []
    starts: list[int] = []
    for e in found:  # those taken are kept by place, so that only neighbours need a look
        i = bisect(starts, e[1])
        if (not i or taken[i - 1][2] <= e[1]) and (i == len(taken) or e[2] <= starts[i]):
            taken.insert(i, e)
            starts.insert(i, e[1])
    return taken


def permuted(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the vectors whose i-th number is below sizes[i]."""
    half = (len(values) + 1) // 2
    parts, limits = [list(values[:half]), list(values[half:])], [sizes[:half], sizes[half:]]
    for r in range(8):
        here, other = r % 2, 1 - r % 2
        seed = f"{tweak}|{r}|{sizes}|{parts[other]}".encode()
        stream = hashlib.blake2b(seed, key=key, digest_size=64).digest()
        while len(stream) < 4 * len(parts[here]):
            stream += hashlib.blake2b(stream[-64:], key=key, digest_size=64).digest()
        parts[here] = [(v + int.from_bytes(stream[4 * i : 4 * i + 4], "big")) % n for i, (v, n) in enumerate(zip(parts[here], limits[here], strict=True))]
    return parts[0] + parts[1]


def same_format(text: str, key: bytes, tweak: str, fixed: set[int] = frozenset(), ranges: dict[int, str] | None = None) -> str:
    """``text`` with each letter and digit outside ``fixed`` permuted within its alphabet."""
    at = [i for i, c in enumerate(text) if c in ALPHABET_OF and i not in fixed]
    letters = [(ranges or {}).get(i, ALPHABET_OF[text[i]]) for i in at]
    new = permuted([a.index(text[i]) for i, a in zip(at, letters, strict=True)], [len(a) for a in letters], key, tweak)
    out = list(text)
    for i, a, v in zip(at, letters, new, strict=True):
        out[i] = a[v]
    return "".join(out)


def same_hex(text: str, key: bytes, tweak: str) -> str:
    """``text`` with its hexadecimal digits permuted, letters to letters."""
    letters = {i: "abcdef" if c in "abcdef" else "ABCDEF" for i, c in enumerate(text) if c in "abcdefABCDEF"}
    return same_format(text, key, tweak, ranges=letters)


def ip_surrogate(text: str, key: bytes, tweak: str) -> str:
    if ":" in text:
        head, colon, tail = text.rpartition(":")
        if "." in tail:
            return f"{same_hex(head, key, tweak)}{colon}{ip_surrogate(tail, key, tweak)}"
        return same_hex(text, key, tweak)
    parts = [int(x) for x in text.split(".")]
    base, sizes = [1 if 1 <= parts[0] <= 223 else 0, 0, 0, 0], [223 if 1 <= parts[0] <= 223 else 256, 256, 256, 256]
    return ".".join(str(b + v) for b, v in zip(base, permuted([p - b for p, b in zip(parts, base, strict=True)], sizes, key, tweak), strict=True))


def card_surrogate(text: str, key: bytes, tweak: str) -> str:
    at = [i for i, c in enumerate(text) if c.isdigit()]
    new = same_format(text, key, tweak, {at[0], at[-1]})
    check = -luhn_sum(digits(new)[:-1] + "0") % 10
    return new[: at[-1]] + str(check) + new[at[-1] + 1 :]


def iban_surrogate(text: str, key: bytes, tweak: str) -> str:
    new = same_format(text, key, tweak, {0, 1, 2, 3})
    check = 98 - iban_rest(new[:2] + "00" + new[4:].replace(" ", ""))
    return f"{new[:2]}{check:02d}{new[4:]}"


def phone_surrogate(text: str, key: bytes, tweak: str) -> str:
    code = re.match(r"\+(?:1|[0-9]{1,3}(?=[ .(-])|[0-9]{2})", text)
    fixed = set(range(code.end())) if code else set()
    # a digit of 2 to 9 that opens a group stays one, as area and exchange codes need
    openers = {m.start(): "23456789" for m in re.finditer(r"(?<![0-9])[2-9]", text)}
    return same_format(text, key, tweak, fixed, openers)


def email_surrogate(text: str, key: bytes, tweak: str) -> str:
    local, _, domain = text.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return f"{same_format(local, key, tweak + '|local')}@{same_format(host, key, tweak + '|host')}{dot}{top}"


def name_surrogate(word: str, role: str, key: bytes, tweak: str) -> str:
    """A word of a name for another one: a listed first name for one of the same list, others keep script, case and sound. ``role`` is
    the gender of a first name where it is known (m, f), or ``last``."""
    if word in GENDERED:
        names = FIRST_NAMES[GENDERED[word]]
        return names[permuted([names.index(word)], [len(names)], key, tweak + "|first")[0]]
    return pronounceable(word, key, f"{tweak}|{role}", role != "last")


def pronounceable(word: str, key: bytes, tweak: str, ending: bool) -> str:
    """``word`` with vowels permuted among vowels and consonants among those of like sound; with ``ending`` its last letter stays, as
    it often tells the gender of a first name."""
    alike = lambda x: SOUND_OF.get(x) or "".join(c for c in ALPHABET_OF[x] if (c in VOWELS) == (x in VOWELS))
    ranges = {i: alike(x) for i, x in enumerate(word) if x in ALPHABET_OF}
    return same_format(word, key, tweak, {len(word) - 1} if ending else frozenset(), ranges)


MAKERS = {"ip": ip_surrogate, "card": card_surrogate, "iban": iban_surrogate, "phone": phone_surrogate, "email": email_surrogate, "ssn": same_format}


def wider(kind: str, text: str, gender: str, key: bytes, tweak: int, level: int) -> str:
    """A surrogate from a larger space than the text's own format, growing with ``level``."""
    drawn = f"{kind}{tweak}|wide"
    if kind == "name":
        more = ("а" if text[-1] in ALPHABETS[5] + ALPHABETS[6] + "ёЁ" else "a") * (level - 1)
        return same_format(text + more, key, f"{drawn}|{gender}")
    if kind == "email":
        return email_surrogate("a" * level + text, key, drawn)
    if kind == "phone":
        return same_format(text, key, drawn)
    if kind == "ip" and ":" in text:
        full = ipaddress.ip_address(text).exploded
        return same_format(full, key, drawn, ranges={i: "0123456789abcdef" for i, c in enumerate(full) if c != ":"})
    return MAKERS[kind](text, key, drawn)


@lru_cache(maxsize=100_000)
def surrogate(kind: str, text: str, gender: str, key: bytes, tweak: int) -> str:
    if tweak >= DRAWS:
        return wider(kind, text, gender, key, tweak, tweak // DRAWS)
    if kind == "name":
        return name_surrogate(text, gender, key, f"{kind}{tweak}")
    return MAKERS[kind](text, key, f"{kind}{tweak}")


def gender_before(text: str, start: int) -> str:
    words = text[max(0, start - 24) : start].replace(".", "").split()
    return TITLES.get(words[-1], "x") if words else "x"


def replace(text: str, key: bytes) -> tuple[str, list[Entity]]:
    """The text with surrogates, and the entities that it had."""
    entities = detect(text)
    if not entities:
        return text, entities
    parts = [(kind, text[s:e], s, e) if kind != "name" else (kind, word, s + at, s + at + len(word)) for kind, s, e in entities for word, at in (name_words(text[s:e]) if kind == "name" else [("", 0)])]
    originals = {part for _, part, *_ in parts}
    roles = name_roles(text, entities)
    given: dict[tuple[str, str], str] = {}
    used: set[str] = set()
    out, at = [], 0
    for kind, part, s, e in parts:
        if (kind, part) not in given:
            for tweak in count():
                new = surrogate(kind, part, roles.get(part, "last") if kind == "name" else "", key, tweak)
                if new not in originals and new not in used:
                    break
            given[kind, part] = new
            used.add(new)
        out += (text[at:s], given[kind, part])
        at = e
    return "".join(out) + text[at:], entities


def name_words(name: str) -> list[tuple[str, int]]:
    """The words of a name and where they begin in it."""
    return [(m[0], m.start()) for m in re.finditer(r"[^ ]+", name)]


def name_roles(text: str, entities: list[Entity]) -> dict[str, str]:
    """The gender of words that are first names beside others after a title that tells it."""
    found: dict[str, str] = {}
    for kind, s, e in entities:
        if kind == "name" and " " in text[s:e] and (gender := gender_before(text, s)) in "mf":
            found.setdefault(text[s:e].split(" ")[0], gender)
    return found


def pseudonymise(docs: DataFrame, key: str = "surrogates-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_entities, spans, text``: the text with surrogates; spans as kind:start:end of
    the original, by place, in code points with exclusive ends."""
    secret = hashlib.blake2b(key.encode()).digest()

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            texts, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                new, found = (None, []) if text is None else replace(text, secret)
                texts.append(new)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in found))
            return [batch.column("doc_id"), counts, spans, texts]

        return columns

    return map_arrow(id_text(docs, id_col, text_col), make, SCHEMA)
