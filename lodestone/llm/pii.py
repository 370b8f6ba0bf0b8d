"""Operator 10: personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Each entity gets a surrogate of its own type, drawn from SHA-256 of a key and the entity's canonical form: the same entity
gets the same surrogate everywhere, in whatever case or punctuation it is written, and keeps those. Letters become
letters, digits digits; card numbers that pass the Luhn test and IBANs that pass mod 97 still pass; e-mail hosts under
example.com, .org or .net stay there and others move to .example; private IPv4 ranges stay private.

A name after a title is replaced word by word, so "Mr Smith", "Mr. Smith" and "Herr John Smith" keep one family name:
titles and particles stay, the last word is the family name, the words before it are given names of the title's gender
(after a title that tells none, of a gender drawn from the word), initials move along the alphabet by a keyed step. The
script stays. Words are what must be distinct, and names then are.

Distinctness is checked, not hoped for: the distinct entities of the corpus are written to a table, and those whose
surrogate another entity also drew, or that is itself an entity of the corpus, draw again until none is left, or ``LAST_DRAW`` is reached.

The texts are searched once and written with what was found. Surrogates are drawn once for each distinct entity and joined
to the places; only texts with an entity take part in a join, so what moves is their share of the corpus, whatever its size.

Results for odd input: null text stays null with no entities; empty text stays empty; repeated rows are replaced alike;
ids are carried as they are; an empty table gives no rows; further columns of the input are kept (but
``n_entities`` and ``entity_types``, which are replaced). Of more than ``NAME_WORDS`` capitalised words behind a title the first ones are
the name. A corpus with more entities than a format without a wider form has room for (SSNs, cards, IBANs, secrets) is an error after ``LAST_DRAW`` draws.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.io import small, written
from lodestone.llm.common import unused

KEY = "lodestone"
#: Country codes of phones.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: Draws within an entity's own format; a draw gives a name one more syllable. What clashes after them is assigned by rank (small
#: ranges of IPv4) or drawn in a wider format, until nothing clashes.
DRAWS = 12
#: The last draw; entities that still clash then are an error. Formats that can be widened never come there.
LAST_DRAW = 64
#: Private IPv4 ranges of 65,536 addresses.
SMALL_RANGE = r"^(192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\."

#: Titles by gender of the person they stand before ("" where they tell none). Fixed values.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "": ["Dr", "Prof"],
}
#: Given names by script and gender. Fixed values.
GIVEN = {
    ("latin", "m"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ольга"],
    ("greek", "m"): ["Άρης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
    ("greek", "f"): ["Άννα", "Βάσω", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: Syllables of invented family names by script. Fixed values.
SYLLABLES = {
    "latin": ["ba", "del", "fen", "gor", "hal", "jen", "kor", "lam", "mer", "nov", "pel", "ras", "sim", "tor", "vel", "wen"],
    "cyrillic": ["ба", "вел", "гор", "дан", "жел", "зем", "кал", "лев", "мир", "нов", "пет", "рад", "сол", "тих", "фед", "чер"],
    "greek": ["βα", "γε", "δη", "ζα", "θε", "κο", "λα", "μα", "νι", "πα", "ρο", "σα", "τα", "φω", "χα", "ψα"],
}

#: Words of a name behind a title; what follows in capitals beyond them is no longer the name, as in a headline.
NAME_WORDS = 5
_TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True)) + ")\\.? "
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A word of a name: an initial or a capitalised word, behind particles.
_WORD = r"(?:(?:von|van|vom|zu|zur|zum|de|del|della|der|den|di|da|do|dos|das|du|la|le|los|las|ten|ter|bin|ibn|al|el) ){0,3}(?:[dl]['’])?(?:\p{Lu}\.(?:-?\p{Lu}\.)*+|\p{Lu}[\p{L}\p{M}'’\-]*+)"
#: Patterns by type, in order of precedence; "us" and "national" are phones without a country code.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?:(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|sk-[A-Za-z0-9_\-]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,20}PRIVATE KEY-----)",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?!000|666)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "phone": r"(?:(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}|\+[0-9]{1,3}[ .\-/]?(?:\([0-9]{1,4}\)[ .\-/]?)?[0-9]{1,4}(?:[ .\-/]?[0-9]{2,4}){2,5}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}|\(0[0-9]{1,4}\)(?:[ .\-/]?[0-9]{2,4}){2,3})(?![0-9])",
    "us": r"[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "national": r"(?:(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}|(?:1[ .\-])?[2-9][0-9]{2}[ .\-][0-9]{3}[ .\-][0-9]{4}|0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4}|(?<![A-Za-z0-9]..|[0-9][.,]..)[0-9]{8}(?![A-Za-z]))|0[1-9][0-9]{1,4}(?: ?/ ?|[ \-])[0-9]{2,4}(?:[ \-]?[0-9]{2,4}){1,2}|[6-9][0-9]{2}(?: [0-9]{3} [0-9]{3}|(?: [0-9]{2}){3})|9[0-9] [0-9]{3} [0-9]{2} [0-9]{2})(?![0-9]|-[0-9])",
    "name": f"(?:{_TITLE}){{1,6}}{_WORD}(?: {_WORD}){{0,{NAME_WORDS - 1}}}+",
}
#: What may stand directly before an entity of a type, as look-behinds of the characters that may not. Letters outside ASCII,
#: as in text without spaces, may stand before all; ASCII letters before what begins with a digit or a title.
BEFORE = {
    "email": r"(?<![A-Za-z0-9._%+\-])",
    "secret": "(?<![A-Za-z0-9])",
    "iban": "(?<![A-Za-z0-9])",
    "ipv4": r"(?<![0-9]|[0-9]\.)",
    "ssn": "(?<![0-9]|[0-9]-)",
    "phone": "(?<![A-Za-z0-9+])",
    "us": "(?<![0-9]|[0-9]-)",
    "national": "(?<![0-9]|[0-9]-)",
    "card": r"(?<![0-9]|[0-9]\.)",
    "name": "",
}
#: The first character of a type; it only saves trying.
FIRST = {"email": r"[A-Za-z0-9._%+\-]", "secret": r"[A-Za-z0-9\-]", "iban": "[A-Z]", "ipv4": "[0-9]", "ssn": "[0-9]", "phone": "[+(]", "us": "[0-9]", "national": "[0-9]", "card": "[0-9]", "name": r"\p{Lu}"}
#: Behind an ASCII letter or digit only a digit or a capital can begin an entity, so nothing is tried at the other letters of a word.
ANY = r"(?:(?<![A-Za-z0-9])|(?=[0-9\p{Lu}]))(?:" + "|".join(f"(?={FIRST[k]}){BEFORE[k]}(?:{PATTERNS[k]})" for k in PATTERNS) + ")"
#: A text without any of these has no entity, and is not searched.
MAYBE = "[0-9@]|AKIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ|PRIVATE KEY-----|[a-f]{32}|[A-F]{32}|" + _TITLE
#: What a secret keeps at its start and end.
SECRET_HEAD = "^(AKIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
SECRET_TAIL = "(-----END [A-Z ]{0,20}PRIVATE KEY-----)$"
#: A word of a name as a unit: this mark, two letters for its part in the name, the mark, the word.
MARK = "\x1f"
#: Alphabets of initials, in their order. Fixed values.
INITIALS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and appears once in the plan, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def type_of(entity: Column) -> Column:
    """The type of a matched string."""
    return reduce(lambda rest, kind: F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit("phone" if kind in ("us", "national") else kind)).otherwise(rest), reversed(list(PATTERNS)), F.lit("name"))


def canonical(entity: Column, kind: Column) -> Column:
    """What makes two writings of a type one entity: digits, with "+" before a country code, and letters without case; for e-mail
    and words of names the text without case; for IPv4 and secrets with a prefix the text."""
    digits = F.regexp_replace(F.lower(F.replace(entity, F.lit("(0)"), F.lit(""))), "[^a-z0-9]", "")
    phone = F.concat(F.when(entity.rlike(r"^(?:\+|1[ .\-])"), F.lit("+")).otherwise(F.lit("")), digits)
    as_is = (kind == "ipv4") | entity.rlike(SECRET_HEAD) & (kind == "secret")
    return F.when((kind == "email") | (kind == "name"), F.lower(entity)).when(as_is, entity).when(kind == "phone", phone).otherwise(F.regexp_replace(F.lower(entity), "[^a-z0-9]", ""))


def title_of(entity: Column) -> Column:
    """The titles that a name begins with, and the space behind them; "" for other entities."""
    return F.regexp_extract(entity, f"^((?:{_TITLE}){{1,6}}){_WORD}", 1)


def units_of(entity: Column) -> Column:
    """What is replaced by itself: the entity, or the words of a name, each marked by its part: "gm", "gf", "g?" for given names by
    gender, "fa" for the family name, "in" for initials, "as" for particles, which stay."""

    def words(title: Column) -> Column:
        of = lambda g: title.rlike("(?:^| )(?:" + "|".join(TITLES[g]) + ")[. ]")
        given = F.when(of("m"), F.lit("gm")).when(of("f"), F.lit("gf")).otherwise(F.lit("g?"))

        def marked(all_words: Column) -> Column:
            def one(word: Column, i: Column) -> Column:
                part = F.when(word.rlike(r"^(?:\p{Lu}\.(?:-?\p{Lu}\.)*)$"), F.lit("in")).when(word.rlike(r"^\p{Ll}+$"), F.lit("as")).when(i == F.size(all_words) - 1, F.lit("fa")).otherwise(given)
                return F.concat(F.lit(MARK), part, F.lit(MARK), word)

            return F.transform(all_words, one)

        return F.when(title == "", F.array(entity)).otherwise(let(F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " "), marked))

    # Only a capital letter, as all titles have, can begin a name.
    return F.when(entity.rlike(r"^\p{Lu}"), let(title_of(entity), words)).otherwise(F.array(entity))


def whole_of(entity: Column, units: Column) -> Column:
    """The entity put together from its units."""
    plain = F.transform(units, lambda u: F.regexp_replace(u, f"^{MARK}..{MARK}", ""))
    return F.when(F.element_at(units, 1).startswith(MARK), F.concat(title_of(entity), F.array_join(plain, " "))).otherwise(F.element_at(units, 1))


def key_of(unit: Column) -> Column:
    """Type and canonical form: equal for all writings of one entity, different for any two entities."""
    return let(type_of(unit), lambda kind: F.concat_ws("\x1f", kind, canonical(unit, kind)))


def _number(stream: Column, at: Column) -> Column:
    """The byte of the hexadecimal stream at a place (from 0; 96 bytes, then from the start)."""
    return F.conv(F.substring(stream, (F.pmod(at, F.lit(96)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(seed: Column) -> Column:
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(3)))


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(values)), " "), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _char(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(number, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _letters(text: Column, stream: Column, first: int | Column = 0) -> Column:
    """Letters and digits replaced, case and everything else kept; numbers are taken by place among letters and digits, so
    punctuation doesn't change them. ``first``: how many of those to keep at the start."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(whole: Column):
        def at(i: Column) -> Column:
            place = F.length(F.regexp_replace(F.substring(whole, F.lit(1), i), "[^A-Za-z0-9]", "")) - 1

            def char(c: Column, p: Column, n: Column) -> Column:
                new = F.when(c.rlike("[0-9]"), _char("0123456789", n)).when(c.rlike("[a-z]"), _char(lower, n)).when(c.rlike("[A-Z]"), _char(upper, n)).otherwise(c)
                return F.when(p < first, c).otherwise(new) if isinstance(first, Column) or first else new

            return let(F.substring(whole, i, F.lit(1)), lambda c: let(place, lambda p: let(_number(stream, p), lambda n: char(c, p, n))))

        return at

    whole = let(text, lambda t: F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), one(t)), ""))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(whole)


def _secret(e: Column, stream: Column) -> Column:
    """Letters and digits behind the prefix replaced, by their place; a key of any length in one pass."""
    hexadecimal = e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    alphabets = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]

    def body(head: Column, tail: Column) -> Column:
        chars = F.split(F.substring(e, F.length(head) + 1, F.length(e) - F.length(head) - F.length(tail)), "")

        def char(c: Column, n: Column) -> Column:
            new = F.when(hexadecimal & ~e.rlike("[A-F]"), _char("0123456789abcdef", n)).when(hexadecimal, _char("0123456789ABCDEF", n))
            for cls, alphabet in alphabets:
                new = new.when(c.rlike(cls), _char(alphabet, n))
            return new.otherwise(c)

        return F.concat(head, F.array_join(F.transform(chars, lambda c, i: let(_number(stream, i), lambda n: char(c, n))), ""), tail)

    return let(F.regexp_extract(e, SECRET_HEAD, 1), lambda head: let(F.regexp_extract(e, SECRET_TAIL, 1), lambda tail: body(head, tail)))


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def luhn(text: Column) -> Column:
    """The Luhn sum of the digits modulo 10; 0 for a valid number."""
    backwards = F.reverse(_digits(text))
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10


def mod97(text: Column) -> Column:
    """An IBAN's remainder: 1 for a valid one."""
    plain = F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise(a))


def _card(e: Column, stream: Column) -> Column:
    def checked(new: Column) -> Column:
        stem = F.substring(new, F.lit(1), F.length(new) - 1)
        fixed = F.concat(stem, F.pmod(F.lit(10) - luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))
        return F.when(luhn(e) == 0, fixed).otherwise(new)

    return let(_letters(e, stream, first=1), checked)


def _iban(e: Column, stream: Column) -> Column:
    def checked(new: Column) -> Column:
        country, rest = F.substring(new, 1, 2), F.substring(new, F.lit(5), F.length(new))
        fixed = F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)
        return F.when(mod97(e) == 1, fixed).otherwise(new)

    return let(_letters(e, stream, first=4), checked)


def _email(e: Column, stream: Column) -> Column:
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    reserved = F.regexp_extract(host, r"(?i)(\.?example\.(?:com|org|net))$", 1)
    own = F.when(reserved != "", F.substring(host, F.lit(1), F.length(host) - F.length(reserved))).otherwise(F.regexp_replace(host, r"\.[A-Za-z]+$", ""))
    mixed = _letters(F.concat(local, F.lit("@"), own), stream)
    return F.concat(mixed, F.when(reserved != "", reserved).otherwise(F.lit(".example")))


def _ipv4(e: Column, stream: Column) -> Column:
    kept = F.when(e.rlike("^(?:10|127)\\."), 1).when(e.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\."), 2).otherwise(0)
    return F.array_join(F.transform(F.split(e, r"\."), lambda o, i: F.when(i < kept, o).otherwise((F.pmod(_number(stream, i * 2) * 256 + _number(stream, i * 2 + 1), F.lit(254)) + 1).cast("string"))), ".")


def _syllable(parts: list[str], stream: Column):
    return lambda i: _pick(parts, _number(stream, i + 50))


def _word(unit: Column, stream: Column, attempt: Column) -> Column:
    """The surrogate of a marked word of a name, marked alike; a draw gives it one more name or syllable."""
    part, word = F.substring(unit, 2, 2), F.substring(unit, F.lit(5), F.length(unit))
    female = (part == "gf") | (part == "g?") & (F.pmod(_number(stream, F.lit(40)), F.lit(2)) == 1)
    script = F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    given = family = F.lit("")
    for s, parts in SYLLABLES.items():
        made = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), _syllable(parts, stream)), ""))
        family = F.when(script == s, made).otherwise(family)
        for g, is_g in (("m", ~female), ("f", female)):
            names = F.array_join(F.transform(F.sequence(F.lit(0), attempt), _syllable(GIVEN[s, g], stream)), "-")
            given = F.when((script == s) & is_g, names).otherwise(given)
    new = F.when(part == "fa", family).otherwise(given)
    new = F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(new)
    apart = F.regexp_extract(word, "^([dl]['’])", 1)
    return F.concat(F.substring(unit, 1, 4), apart, new)


def _initials(unit: Column, key: str) -> Column:
    """Initials moved along their alphabet by a step that the key alone gives, so different ones stay different."""
    step = int.from_bytes(hashlib.sha256(f"{key}\x1finitials".encode()).digest()[:4], "big")
    moved = "".join(a[(i + 1 + step % (len(a) - 1)) % len(a)] for a in INITIALS for i in range(len(a)))
    return F.concat(F.substring(unit, 1, 4), F.translate(F.substring(unit, F.lit(5), F.length(unit)), "".join(INITIALS), moved))


def surrogate(e: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit at a draw (from 0)."""

    def of(kind: Column, stream: Column) -> Column:
        # The country code, or without one the first digit, is kept, and behind 1 or 0 another; they come from the canonical form, so all writings agree.
        form = canonical(e, F.lit("phone"))
        kept = F.when(form.startswith("+"), F.length(F.regexp_extract(form, COUNTRY, 1)) + form.startswith("+1").cast("int")).when(form.startswith("0"), F.lit(2)).otherwise(F.lit(1))
        phone = let(kept, lambda k: F.replace(_letters(F.replace(e, F.lit("(0)"), F.lit("\x01")), stream, first=k), F.lit("\x01"), F.lit("(0)")))
        ssn = F.concat(F.lit("9"), _letters(F.substring(e, F.lit(2), F.length(e)), stream))
        # Formats that are nearly used up: one more letter or digit for each draw beyond DRAWS, or a larger range of addresses.
        more = F.greatest(F.lit(0), attempt - (DRAWS - 1))
        wider = lambda x: F.when(more > 0, F.concat(F.repeat(F.lit("a"), more), x)).otherwise(x)
        ranged = F.when(attempt >= 3 * DRAWS, F.lit("0.0.0.0")).when(attempt >= DRAWS, F.regexp_replace(e, SMALL_RANGE, "10.0.")).otherwise(e)
        phone = F.when(more > 0, F.concat(phone, F.substring(F.translate(stream, "abcdef", "012345"), F.lit(1), more))).otherwise(phone)
        choice = {"email": _email(wider(e), stream), "secret": _secret(e, stream), "iban": _iban(e, stream), "ipv4": _ipv4(ranged, stream), "ssn": ssn, "phone": phone, "card": _card(e, stream)}
        return reduce(lambda rest, k: F.when(kind == k, choice[k]).otherwise(rest), reversed(list(choice)), _word(e, stream, attempt))

    seed = lambda kind: _stream(F.concat_ws("\x1f", F.lit(key), kind, canonical(e, kind), attempt.cast("string")))
    drawn = let(type_of(e), lambda kind: let(seed(kind), lambda stream: of(kind, stream)))
    return F.when(e.startswith(f"{MARK}as{MARK}"), e).when(e.startswith(f"{MARK}in{MARK}"), _initials(e, key)).otherwise(drawn)


def found_in(text: str) -> Column:
    """The entities of a text, in order."""
    whole = F.col(text).cast("string")
    return F.when(whole.rlike(MAYBE), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def ranked(drawn: DataFrame, clash: DataFrame) -> DataFrame:
    """(key, fixed): free addresses for the clashing ones of small ranges, by rank; those that find none are left out."""
    prefix = F.regexp_extract("entity", SMALL_RANGE, 1)
    left = drawn.join(clash, "key").filter(F.col("key").startswith("ipv4")).select("key", prefix.alias("prefix")).filter("prefix <> ''").distinct()
    used = drawn.join(clash, "key", "left_anti").select(F.substring_index("drawn", "\x1f", -1).alias("value")).union(drawn.select(F.col("entity").alias("value")))
    place = F.explode(F.sequence(F.lit(0), F.lit(254 * 254 - 1)))
    values = left.select("prefix").distinct().select("prefix", place.alias("n")).select("prefix", F.format_string("%s.%d.%d", "prefix", (F.col("n") / 254).cast("int") + 1, F.col("n") % 254 + 1).alias("value"))
    # A window holds one range, 64,516 values at most.
    free = values.join(used.distinct(), "value", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.sha2("value", 256))))
    asked = left.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("key")))
    return asked.join(free, ["prefix", "rank"]).select("key", F.col("value").alias("fixed"))


def surrogates(marked: DataFrame, found: str, key: str = KEY) -> DataFrame:
    """(entity, one): every unit of the corpus in each of its writings, and its surrogate, so that no two entities share one and
    none is an entity of the corpus. ``found``: the column with the entities."""
    entity = marked.select(F.explode(found).alias("entity")).distinct().select(F.explode(units_of(F.col("entity"))).alias("entity")).distinct()
    entities = written(entity.withColumn("key", key_of(F.col("entity"))), "entities")
    # Particles and initials are no entities by themselves.
    entity = ~F.col("entity").rlike(f"^{MARK}(?:as|in){MARK}")
    corpus = entities.filter(entity).select(F.col("key").alias("drawn")).distinct()
    now, none = entities.withColumn("attempt", F.lit(0)), F.lit(None).cast("string")
    now = now.withColumns({"given": none, "one": none})
    for turn in range(LAST_DRAW + 1):
        one = F.when(F.col("attempt") == turn, F.coalesce("given", surrogate(F.col("entity"), F.col("attempt"), key))).otherwise(F.col("one"))
        drawn = written(now.withColumn("one", one).withColumn("drawn", key_of(F.col("one"))), "draws")
        checked = drawn.filter(entity)
        # An assigned surrogate wins, then the least attempt: what stands is not drawn again.
        winner = checked.groupBy("drawn").agg(F.min(F.struct(F.col("given").isNull().alias("open"), "attempt", "key")).alias("first"), F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").select("drawn", F.col("first.key").alias("winner"))
        clash = checked.join(winner, "drawn").filter("key <> winner").select("key")
        clash = written(clash.unionByName(checked.join(corpus, "drawn", "left_semi").select("key")).distinct(), "clashes")
        if clash.isEmpty():
            return drawn.select("entity", "one")
        again = clash.withColumn("next", F.lit(turn + 1))
        if turn == DRAWS - 1:
            again = again.join(ranked(drawn, clash), "key", "left")
        else:
            again = again.withColumn("fixed", none)
        now = drawn.join(again, "key", "left").withColumn("attempt", F.coalesce("next", "attempt")).withColumn("given", F.coalesce("fixed", "given")).select("entity", "key", "attempt", "given", "one")
    kinds = [r[0] for r in clash.select(F.substring_index("key", "\x1f", 1)).distinct().limit(20).collect()]
    raise ValueError(f"after {LAST_DRAW} draws entities are left without a surrogate of their own: the formats of {', '.join(sorted(kinds))} are full")


def _woven(text: str, surrogates: Column) -> Column:
    gaps = F.split(F.col(text), ANY, -1)
    return F.when(F.size(surrogates) == 0, F.col(text)).otherwise(F.array_join(F.zip_with(gaps, F.concat(surrogates, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), ""))


def replace_in(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced and ``n_entities`` and ``entity_types`` added."""
    found, new, row = (unused(docs, c) for c in ("_found", "_new", "_row"))
    # The texts are searched once; the rows' numbers are those of this table.
    marked = written(docs.withColumn(found, found_in(text)).withColumn(row, F.monotonically_increasing_id()), "marked")
    named = surrogates(marked, found, key)
    each = marked.filter(F.size(found) > 0).select(row, F.posexplode(found).alias("_at", "_entity"))
    each = each.select(row, "_at", F.posexplode(units_of(F.col("_entity"))).alias("_part", "entity")).join(small(named), "entity")
    drawn = each.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("_at", "_part"), "one"))).alias(new))
    hits = marked.filter(F.size(found) > 0).join(drawn, row)
    unit = lambda i: lambda _, j: F.element_at(F.col(new), F.struct(i.alias("_at"), j.alias("_part")))
    hits = hits.withColumn(new, F.transform(found, lambda e, i: whole_of(e, F.transform(units_of(e), unit(i)))))
    counted = {"n_entities": F.size(found).cast("bigint"), "entity_types": F.array_sort(F.array_distinct(F.transform(found, type_of)))}
    own = [c for c in docs.columns if c not in counted]
    out = hits.withColumns(counted).withColumn(text, _woven(text, F.col(new))).select(*own, *counted)
    none = {"n_entities": F.lit(0).cast("bigint"), "entity_types": F.array().cast("array<string>")}
    return marked.filter(F.size(found) == 0).withColumns(none).select(*own, *counted).unionByName(out)
