"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one regular expression: mail and IP addresses, payment
cards, bank accounts, social-security and telephone numbers, keys and passwords
after their names, and titled person names in Latin or Cyrillic letters. An
entity is reduced to what identifies it (a telephone number to its last ten
digits without a leading 0, a mail address to lower case, an IPv6 address to its
eight groups, a person name to its words in lower case), so all its spellings get
one surrogate, poured back into the spelling at hand. A word without a title that
is part of a titled name in the same text gets that name's surrogate. Not found:
names never titled in their text, telephone numbers of bare digits with neither a
plus nor a word such as "call" before them, and words of all titles other than
those below.

A person is known by the name's words: titles only choose the gender, over all
tables. Where a name has titles of one gender, its given names are of that gender
under every title; where it has both or none, they fit either.

A surrogate is drawn from a keyed hash of the entity: digits for digits,
letters for letters of the same case, a valid check digit for a card that had
one, octets of the same length. A name's word becomes one word of the same gender and
script: one of a list, or, where that is taken, syllables with an ending, one
syllable more with every draw. Parts of a hyphenated word keep their hyphen, words
in capitals stay so. An initial becomes the letter a keyed number of places on.
Collision checks make surrogates distinct: where two entities of a kind (or two
name words of any kind) draw the same one, or one draws something that is a real
entity of the tables, all but the first draw again with the next number, until
none is left. Initials are too few for that: theirs differ from one another, but
may be real elsewhere, and initials outside the two alphabets may share one.

The distinct spellings and entities are tables of their own. A text's entities are
joined to them by place and come back as an array in that order; what belongs to a
text is known by its doc_id and a digest of it, so rows that share a doc_id, or
have none, have nothing of one another's.

Defined cases: a null text stays null, with no entities; an empty text stays
empty. Repeated rows stay and become equal texts. An empty table gives an empty
result. All other columns are kept.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

KEY = "tidebar"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_LONG = "[A-Za-z0-9_/+.-]{8,}"
_MALE = r"(?:Mr|Mister|Sir|Herrn?|Señor|Sr|Monsieur|Signore?)\.?"
_FEMALE = r"(?:Mrs|Ms|Miss|Frau|Fräulein|Señorita|Señora|Srta|Sra|Madame|Mademoiselle|Mme|Mlle|Signora)\.?"
_EITHER = r"(?:Dr|Doctor|Professor|Prof|Mx)\.?"
_MALE_C, _FEMALE_C, _EITHER_C = r"(?:г-н|господин)", r"(?:г-жа|госпожа)", r"(?:д-р|доктор|проф\.|профессор)"
_ANY = rf"(?:{_MALE}|{_FEMALE}|{_EITHER}|{_MALE_C}|{_FEMALE_C}|{_EITHER_C})"
#: Words within a name that stay as they are.
_SMALL = "(?:van|von|der|den|de|del|della|di|da|do|dos|du|la|le|zu|zum|zur|bin|ibn|al|el|ter|ten)"


def _name(title: str, script: str) -> str:
    """A title, more titles, and any number of words: capitalized, with hyphens and apostrophes, or an initial."""
    word = rf"[\p{{{script}}}&&\p{{Lu}}](?:[\p{{{script}}}\p{{M}}]|['’](?=\p{{Lu}}))+"
    word = rf"(?:{word}(?:-{word})*|[\p{{{script}}}&&\p{{Lu}}]\.(?= ?\p{{Lu}}))"
    return rf"{title}(?: {_ANY})*(?: {_SMALL}){{0,3}} {word}(?:(?: {_SMALL}){{0,3}} {word})*"


#: Kind: what its spellings look like, in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}\p{M}\p{N}.%+_-])[\p{L}\p{M}\p{N}_.%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}",
    "ip6": rf"(?<![:.])(?=[0-9A-Fa-f:]*\d)(?=[0:]*[1-9A-Fa-f])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "card": r"(?<![.+])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{13,19})(?!\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![.+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\+(?=(?:[ .()-]{0,2}\d){8,15}(?!\d))[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,12}){1,5}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|0\d{2,4}[ /-]\d{6,8}|\(0\d{1,4}\) ?\d{3,4}[ .-]?\d{3,4})(?!\d)",
    "call": r"(?i:call|cell|fax|mobile|phone|tel|telephone)(?:[.:]|:? )? ?\d{10,11}(?!\d)",
    # passwords may be letters alone; what follows the other words needs a digit
    "secret": rf"(?i:(?:token|secret|api_?key)\s{{0,2}}[=:]\s{{0,2}}[\"']?(?=[A-Za-z_/+.-]*\d)|passw(?:or)?d\s{{0,2}}[=:]\s{{0,2}}[\"']?){_LONG}",
    "access": r"A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name_m": _name(_MALE, "IsLatin"),
    "name_f": _name(_FEMALE, "IsLatin"),
    "name_n": _name(_EITHER, "IsLatin"),
    "name_mc": rf"(?<!\S){_name(_MALE_C, 'IsCyrillic')}",
    "name_fc": rf"(?<!\S){_name(_FEMALE_C, 'IsCyrillic')}",
    "name_nc": rf"(?<!\S){_name(_EITHER_C, 'IsCyrillic')}",
}
#: The kinds by the characters with which they may start, so that most places are left after one look.
_STARTS = {"[0-9A-Fa-f]": ("ip6",), "[0-9+(]": ("ip", "card", "ssn", "phone"), "[A-Z]": ("access", "iban", "name_m", "name_f", "name_n"), "[CcFfMmPpTt]": ("call",), "[AaPpSsTt]": ("secret",), "[гдп]": ("name_mc", "name_fc", "name_nc"), r"[\p{L}\p{N}_.%+-]": ("email",)}
#: A text with an entity has one of these.
_TITLES = ("Mr", "Mis", "Herr", "Señor", "Sr", "Sir", "Signor", "Monsieur", "Ms", "Mx", "Frau", "Fräulein", "Mad", "Mme", "Mlle", "Dr", "Doctor", "Prof", "г-н", "г-жа", "госп", "д-р", "доктор", "проф")
#: Names for surrogates that are drawn first, by the kind of word.
NAMES = {
    "given_m": "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Rafael Simon Thomas Victor",
    "given_f": "Alice Bertha Clara Diana Emma Flora Greta Helena Irene Julia Katharina Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera",
    "given_n": "Alex Andrea Ariel Blake Charlie Dominique Eden Finley Gale Harper Jamie Kim Lee Marion Noel Robin Sasha Toni Val Yael",
    "family": "Adler Bauer Carter Dalton Ellis Fischer Garcia Hoffman Iverson Jensen Keller Lambert Moreau Navarro Olsen Parker Quinn Romero Santos Turner Ullman Vargas Weber Young Zeller",
    "given_mc": "Алексей Борис Виктор Григорий Дмитрий Евгений Иван Кирилл Леонид Михаил Николай Олег Павел Роман Сергей Тимур",
    "given_fc": "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья Татьяна",
    "given_nc": "Валя Женя Лёша Паша Саша Слава Шура Тоня Стася Мика",
    "family_c": "Белый Волк Громов Дубов Ежов Жуков Зимин Ильин Котов Лесной Мороз Носов Орлов Попов Рыбак Седов",
}
#: Syllables of the names drawn after those, by script, and their endings by the kind of word.
SYLLABLES = {
    "": "ba be bo da de do fa fe ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te to va ve vi vo",
    "c": "ба ве ви га го да де за ка ке ко ла ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си со та те ти то",
}
ENDINGS = {
    "given_m": "ld n nd r rd rt x",
    "given_f": "lia lla na nna ria ssa tta",
    "given_n": "ff l m sh y",
    "family": "berg dal ford ker ler lund mann ner rson ston well",
    "given_mc": "л м н р с т х",
    "given_fc": "ля лия на нна ра рия та",
    "given_nc": "ня ша ся",
    "family_c": "вич дзе ев ко лев нов ренко цын швили",
}
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")
_FOUND = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?={start})(?:{'|'.join(KINDS[k] for k in kinds)})" for start, kinds in _STARTS.items()) + ")"


def found_in(text: Column) -> Column:
    """All spellings of entities in a text, in order."""
    return F.regexp_extract_all(text, F.lit(_FOUND), F.lit(0))


def _worth_searching(text: Column) -> Column:
    out = text.rlike("[0-9@]|(?i:passw)")
    for title in _TITLES:
        out = out | F.contains(text, F.lit(title))
    return out


def _kind(spelling: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(spelling.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _name_words(spelling: Column) -> Column:
    """The words of a name after its titles."""
    return F.split(F.regexp_replace(spelling, f"^(?:{_ANY} )+", ""), " ")


def _is_small(word: Column) -> Column:
    return word.rlike(f"^{_SMALL}$")


def _groups(spelling: Column) -> Column:
    """The eight groups of an IPv6 address, those left out as 0."""
    half = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(F.lower(spelling), "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    left, right = half(0), half(1)
    return F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)


def _parts(kind: Column, spelling: Column, gender: Column) -> Column:
    """What identifies the entity: an array of (kind, value, whether it stands in capitals)."""

    def one(name: Column | str, value: Column, capitals: Column | None = None) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("kind"), value.alias("value"), (F.lit(False) if capitals is None else capitals).alias("capitals"))

    words = F.filter(_name_words(spelling), lambda w: ~_is_small(w))
    given = F.concat(F.lit("given_"), gender, F.when(kind.endswith("c"), "c").otherwise(""))
    family = F.when(kind.endswith("c"), "family_c").otherwise("family")

    def parts_of(w: Column, i: Column) -> Column:
        of = F.when(i == F.size(words) - 1, family).otherwise(given)
        return F.transform(F.split(w, "-"), lambda c: one(F.when(c.endswith("."), F.lit("initial")).otherwise(of), F.lower(c), F.when((F.length(c) > 1) & (c == F.upper(c)), True).otherwise(False)))

    names = F.flatten(F.transform(words, parts_of))
    return (
        F.when(kind == "email", F.array(one("email", F.lower(spelling))))
        .when(kind.isin("phone", "call"), F.array(one("phone", F.regexp_replace(F.right(_digits(spelling), F.lit(10)), r"^0+(?=\d{6})", ""))))
        .when(kind == "ip6", F.array(one("ip6", F.array_join(F.transform(_groups(spelling), lambda g: F.lpad(g, 4, "0")), ":"))))
        .when(kind.isin("card", "ssn"), F.array(one(kind, _digits(spelling))))
        .when(kind == "iban", F.array(one(kind, F.replace(spelling, F.lit(" "), F.lit("")))))
        .when(kind == "secret", F.array(one(kind, F.regexp_extract(spelling, r"[=:]\s{0,2}[\"']?(.*)$", 1))))
        .when(kind.startswith("name_"), names)
        .otherwise(F.array(one(kind, spelling)))
    )


def _letters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _number(h: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a hash of 64 hexadecimal digits, around the circle."""
    return F.conv(F.substring(h, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")


def _from(first: int, n: Column) -> Column:
    return F.char(F.lit(first) + n % 26)


def _like(value: Column, h: Column) -> Column:
    """Letters for letters of the same case and digits for digits; the rest stays."""
    def letter(c: Column, i: Column) -> Column:
        n = _number(h, i)
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{Lu}"), _from(65, n)).when(c.rlike(r"\p{L}"), _from(97, n)).otherwise(c)

    return F.array_join(F.transform(_letters(value), letter), "")


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """The sum of a card's digits from its end, every other one doubled."""
    terms = F.transform(F.reverse(_letters(digits)), lambda c, i: F.when(i % 2 == first_doubled, F.array(F.lit(0), F.lit(2), F.lit(4), F.lit(6), F.lit(8), F.lit(1), F.lit(3), F.lit(5), F.lit(7), F.lit(9))[c.cast("int")]).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b)


def _surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, value, F.lit(attempt)), 256)
    like = _like(value, h)
    body = F.concat(F.left(value, F.lit(1)), F.substring(like, F.lit(2), F.length(value) - 2))
    card = F.when(_luhn_sum(value, 1) % 10 == 0, F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string"))).otherwise(like)
    octet = lambda c, i: F.when(F.length(c) == 1, 1 + _number(h, i) % 9).when(F.length(c) == 2, 10 + _number(h, i) % 90).otherwise(100 + _number(h, i) % 155).cast("string")
    host = F.substring_index(value, "@", -1)
    mail = F.concat(F.substring_index(like, "@", 1), F.lit("@"), F.substring(like, F.locate("@", value) + 1, F.length(host) - F.length(F.substring_index(host, ".", -1))), F.substring_index(host, ".", -1))
    nibble = lambda n: F.substring(F.lit("0123456789abcdef"), n + 1, F.lit(1))
    six = F.array_join(F.transform(F.split(value, ":"), lambda g, i: F.when(g == "0000", g).otherwise(F.concat(nibble(1 + _number(h, 3 * i) % 15), *[nibble(_number(h, 3 * i + k) % 16) for k in (1, 2)], nibble(_number(h, 3 * i + 1).bitwiseAND(240) / 16)))), ":")
    hexadecimal = F.left(F.concat(h, F.sha2(h, 256), F.sha2(F.concat(h, h), 256)), F.length(value))
    out = (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), octet), "."))
        .when(kind == "ip6", six)
        .when(kind == "phone", F.concat((2 + _number(h, F.lit(30)) % 8).cast("string"), F.substring(like, F.lit(2), F.length(like))))
        .when(kind == "card", card)
        .when((kind == "secret") & value.rlike("^[0-9a-f]{8,192}$"), hexadecimal)
        .when(kind == "access", F.concat(F.left(value, F.lit(4)), F.substring(like, F.lit(5), F.length(like))))
        .when(kind == "iban", F.concat(F.left(value, F.lit(2)), F.substring(like, F.lit(3), F.length(like))))
        .otherwise(like)
    )
    for name, pool in NAMES.items():
        first, last = pool.split(), ENDINGS[name].split()
        if attempt:  # one more syllable with every draw, so that names never run out
            syllables = SYLLABLES["c" if name.endswith("c") else ""].split()
            drawn = F.initcap(F.concat(*[_one_of(syllables, _number(h, F.lit(j))) for j in range(1 + attempt)], _one_of(last, _number(h, F.lit(30)))))
        else:
            drawn = _one_of(first, _number(h, F.lit(0)))
        out = F.when(kind == name, drawn).otherwise(out)
    return out


def _one_of(words: list[str], n: Column) -> Column:
    return F.array(*[F.lit(w) for w in words])[n % len(words)]


def _initial(value: Column, key: str) -> Column:
    """For an initial with its point, the letter a keyed number of places on in its alphabet."""
    letter, h = F.upper(F.left(value, F.lit(1))), F.sha2(F.lit(f"{key}|initial"), 256)
    out = F.substring(F.lit(ALPHABETS[0]), _number(F.sha2(F.concat(F.lit(f"{key}|"), letter), 256), F.lit(0)) % 26 + 1, F.lit(1))
    for alphabet in ALPHABETS:
        at, on = F.instr(F.lit(alphabet), letter), 1 + _number(h, F.lit(0)) % (len(alphabet) - 1)
        out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + on) % len(alphabet) + 1, F.lit(1))).otherwise(out)
    return F.concat(out, F.lit("."))


def _put_names(spelling: Column, surrogates: Column) -> Column:
    """The words of a name after its titles, each with the surrogates of its parts; small words stay."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("seen"))

    def step(a: Column, w: Column) -> Column:
        n = F.when(_is_small(w), 0).otherwise(F.size(F.split(w, "-")))
        word = F.when(n == 0, w).otherwise(F.array_join(F.slice(surrogates, a["seen"] + 1, n), "-"))
        return F.struct(F.concat(a["out"], F.array(word)).alias("out"), (a["seen"] + n).alias("seen"))

    return F.aggregate(_name_words(spelling), state, step)["out"]


def _poured(spelling: Column, kind: Column, first: Column, names: Column) -> Column:
    """The surrogate in the spelling of the entity: its separators, its prefix, its case. ``names`` are a person's words."""
    digits, slots = _letters(first), F.length(_digits(spelling))
    # the digits of a telephone number's end take the place of its last digits; what comes before is the country's
    ahead = F.when(kind.isin("phone", "call"), F.greatest(slots - F.length(first), F.lit(0))).otherwise(F.lit(0))
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("seen"))

    def step(a: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        put = F.when(is_digit & (a["seen"] >= ahead), F.get(digits, a["seen"] - ahead)).otherwise(c)
        return F.struct(F.concat(a["text"], put).alias("text"), (a["seen"] + F.when(is_digit, 1).otherwise(0)).alias("seen"))

    numbers = F.aggregate(_letters(spelling), state, step)["text"]
    cased = F.array_join(F.transform(_letters(spelling), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.get(digits, i))).otherwise(F.get(digits, i))), "")
    value = F.regexp_extract(spelling, r"[=:]\s{0,2}[\"']?(.*)$", 1)
    grouped = F.aggregate(_letters(spelling), state, lambda a, c: F.struct(F.concat(a["text"], F.when(c == " ", c).otherwise(F.get(digits, a["seen"]))).alias("text"), (a["seen"] + F.when(c == " ", 0).otherwise(1)).alias("seen")))["text"]
    tokens = F.split(spelling, ":", -1)
    gap = F.array_position(tokens, "")
    six = F.array_join(F.transform(tokens, lambda g, i: F.when(g.rlike("^0*$"), g).otherwise(F.get(F.split(first, ":"), F.when((gap == 0) | (i < gap - 1), i).otherwise(8 - F.size(tokens) + i)))), ":")
    ahead_of = F.left(spelling, F.length(spelling) - F.length(F.array_join(_name_words(spelling), " ")))
    return (
        F.when(kind.isin("phone", "call", "card", "ssn"), numbers)
        .when(kind == "ip6", six)
        .when(kind == "email", cased)
        .when(kind == "iban", grouped)
        .when(kind == "secret", F.concat(F.left(spelling, F.length(spelling) - F.length(value)), first))
        .when(kind.startswith("name_"), F.concat(ahead_of, F.array_join(names, " ")))
        .otherwise(first)
    )


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for all entities: distinct within a kind (words of names: among all), and none a real value."""
    # name words of all kinds are one class; they are compared in lower case
    is_name = F.col("kind").startswith("given_") | F.col("kind").startswith("family")
    entities = entities.withColumn("class", F.when(is_name, "name").otherwise(F.col("kind")))
    real = written(entities.select("class", F.col("value").alias("as_real")).distinct(), "real")
    settled, pending = None, entities
    for attempt in count():
        drawn = pending.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), key, attempt))
        drawn = drawn.withColumn("as_real", F.when(is_name, F.lower("surrogate")).otherwise(F.col("surrogate")))
        # the smallest value that draws a surrogate keeps it: a minimum combines before it moves, however many draw the same
        kept = drawn.groupBy("class", "as_real", "surrogate").agg(F.min(F.struct("kind", "value")).alias("by")).join(real, ["class", "as_real"], "left_anti")
        if settled is not None:
            kept = kept.join(settled, ["class", "as_real"], "left_anti")
        kept = written(kept.select("class", "as_real", "by.kind", "by.value", "surrogate"), "surrogates")
        settled = kept if settled is None else settled.unionAll(kept)
        pending = written(pending.join(kept, ["kind", "value"], "left_anti"), "pending")
        if pending.isEmpty():
            return settled.select("kind", "value", "surrogate")


def replacements(found: DataFrame, key: str = KEY) -> DataFrame:
    """spelling, replacement for every distinct spelling in a table of them; and for names their words, each with its surrogate, family names first."""
    spellings = found.select("spelling").distinct()
    spellings = spellings.withColumn("kind", _kind(F.col("spelling"))).where("kind is not null")
    is_name, words = F.col("kind").startswith("name_"), _name_words(F.col("spelling"))
    # one gender for a person's given names under all titles; n where they have titles of both or of none
    person = F.when(is_name, F.lower(F.array_join(words, " "))).otherwise(F.col("spelling"))
    titled = F.when(F.substring("kind", 6, 1).isin("m", "f"), F.substring("kind", 6, 1))
    same = Window.partitionBy("person")
    spellings = spellings.select("spelling", "kind", person.alias("person"), F.when(is_name, titled).alias("titled"))
    gender = F.when(F.min("titled").over(same) == F.max("titled").over(same), F.min("titled").over(same)).otherwise("n")
    spellings = spellings.withColumn("gender", gender)
    spellings = written(spellings.select("spelling", "kind", _parts(F.col("kind"), F.col("spelling"), F.col("gender")).alias("parts")), "spellings")
    parts = spellings.select("spelling", F.col("kind").alias("of"), F.posexplode("parts").alias("place", "part")).select("spelling", "of", "place", "part.*")
    surrogates = _settled(parts.where("kind <> 'initial'").select("kind", "value").distinct(), key)
    drawn = F.when(F.col("kind") == "initial", _initial(F.col("value"), key)).when(F.col("capitals"), F.upper("surrogate")).otherwise(F.col("surrogate"))
    both = parts.join(surrogates, ["kind", "value"], "left").groupBy("spelling", "of").agg(F.array_sort(F.collect_list(F.struct("place", drawn.alias("surrogate")))).alias("all"))
    of_name = F.col("of").startswith("name_")
    both = both.withColumn("put", F.when(of_name, _put_names(F.col("spelling"), F.col("all")["surrogate"])))
    last = F.size(words) - 1
    named = F.zip_with(F.transform(words, lambda w, i: F.struct(w.alias("word"), (i < last).alias("given"))), F.col("put"), lambda w, x: F.struct(w["given"].alias("given"), w["word"].alias("word"), x.alias("surrogate")))
    named = F.array_sort(F.filter(named, lambda x: ~_is_small(x["word"]) & ~x["word"].endswith(".")))
    replacement = _poured(F.col("spelling"), F.col("of"), F.col("all")[0]["surrogate"], F.col("put"))
    nothing = F.array().cast("array<struct<given:boolean,word:string,surrogate:string>>")
    return written(both.select("spelling", replacement.alias("replacement"), F.when(of_name, named).otherwise(nothing).alias("words")), "replacements")


def _woven(between: Column, put: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def replace_pii(docs: DataFrame, key: str = KEY, count_as: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts; ``count_as`` names a column for the number of entities replaced."""
    digest = F.md5(docs["text"])
    spelling = F.posexplode(F.when(_worth_searching(docs["text"]), found_in(docs["text"]))).alias("place", "spelling")
    found = written(docs.select(docs["doc_id"].alias("_doc"), digest.alias("_digest"), spelling), "entities")
    own = found.join(replacements(found, key), "spelling", "left")
    # repeated rows give the same places: a set has them once
    placed = F.array_sort(F.collect_set(F.struct("place", F.coalesce("replacement", "spelling").alias("put"))))
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set("words"))))
    own = own.groupBy("_doc", "_digest").agg(placed.alias("_placed"), words.alias("_words"))
    # the longest first, so that no word hides one that it begins
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(F.col("_words")["word"]), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word")))), lambda x: x["word"])
    again = F.when(F.size("_words") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}_])")))
    own = own.select("_doc", "_digest", F.col("_placed")["put"].alias("_put"), F.col("_words")["word"].alias("_named"), F.col("_words")["surrogate"].alias("_names"), again.alias("_again"))
    both = docs.join(own, docs["doc_id"].eqNullSafe(own["_doc"]) & (digest == own["_digest"]), "left")
    put, text = own["_put"], docs["text"]
    # what lies between the entities
    between = F.split(text, _FOUND, -1)
    # words without a title that are part of a name in the same text
    again = own["_again"]
    named = lambda w: F.get(own["_names"], F.array_position(own["_named"], w).cast("int") - 1)
    others = F.transform(between, lambda x: _woven(F.split(x, again, -1), F.transform(F.regexp_extract_all(x, again, F.lit(0)), named)))
    new = F.when(again.isNull(), _woven(between, put)).otherwise(_woven(others, put))
    n = F.size(put) + F.when(again.isNull(), 0).otherwise(F.aggregate(between, F.lit(0), lambda a, x: a + F.size(F.regexp_extract_all(x, again, F.lit(0)))))
    columns = [F.when(put.isNull() | text.isNull(), text).otherwise(new).alias("text") if c == "text" else docs[c] for c in docs.columns]
    if count_as:
        columns.append(F.when(put.isNull() | text.isNull(), F.lit(0)).otherwise(n).cast("long").alias(count_as))
    return both.select(*columns)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for the personal data in it."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), count_as="n_entities")
