"""Surrogates for personal data and secrets, in SQL functions only.

One pattern finds e-mail addresses, phone numbers, IP and MAC addresses, payment cards, IBANs, social security numbers,
credentials and names of persons: after a title, after words that introduce a name ("my name is", "Dear", "Author:"), or
a common given name before a family name. A second search of the same text finds the bare words of the names that were
found in it, so every mention of a person is replaced: full name, given name or family name alone.

Each entity is replaced by a surrogate that a secret key and the entity's canonical form (letters and digits, small)
determine: the same entity has the same surrogate wherever it occurs and however it is punctuated. The words of a name
are entities of their own, so mentions agree (coreference), and two persons of one family still share their surname.
Surrogates have the type, length, punctuation, capitals and script of what they stand for. Cards keep their first digit
and stay valid under the check digit rule where they were; IP octets stay octets; phones keep the country code, mail
addresses the top domain; hexadecimal secrets stay hexadecimal; given names are built with endings of the person's gender.

Collision check: over all distinct entities (without title, prefix and punctuation, so one check covers every spelling), a
surrogate that two share or that is itself an entity of the corpus goes to the smallest (unless it is an entity) and the
others draw again, until all differ; what finds none of its length gets longer by a letter or digit every LONGER_AFTER
draws, so no corpus runs out of surrogates. Only IP addresses cannot grow: after IP_ROUNDS draws they keep the last.
Only the entities that drew again are kept as a table; documents with one of them are joined with it by entity, so nothing
grows with the corpus but that table.

Null or empty text stays as it is, with 0 entities. What is masked already (no letter or digit) stays. Null ids stay,
repeated rows each give a row. All columns are returned as they came, but for text; a column that has the count's name is
replaced by the count. Names of other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import written
from kgspark.llm.quality_rules import let

#: Titles by gender, words that introduce a name, what follows them without being one, and what stands between the words of a name.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor"],
    "f": ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora"],
    "x": ["Dr", "Doctor", "Prof", "Professor"],
}
ABBREVIATED = ["Mr", "Mrs", "Ms", "Sr", "Sra", "Mme", "Dr", "Prof"]
CUES = [
    "my name is", "name is", "name:", "i am called", "call me", "signed", "signed by", "sincerely", "regards", "dear", "attn:", "attention:", "author:",
    "mein name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "mi chiamo", "меня зовут",
]
NO_NAMES = ["Sir", "Madam", "All", "Customer", "Customers", "Friend", "Friends", "Team", "Colleague", "Colleagues", "Reader", "Readers", "Editor", "God", "Lord"]
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "al", "bin", "zu"]
#: Common given names by gender, without those that are common words too.
GIVEN = {
    "f": [
        "Alice", "Amanda", "Amy", "Ana", "Andrea", "Anna", "Ashley", "Barbara", "Camille", "Carmen", "Carol", "Caroline", "Claudia", "Deborah", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Hannah",
        "Heather", "Helen", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Kimberly", "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Martina", "Mary", "Melissa",
        "Michelle", "Monika", "Nancy", "Olivia", "Patricia", "Rachel", "Rebecca", "Sandra", "Sarah", "Sofia", "Sophia", "Sophie", "Stephanie", "Susan", "Teresa", "Ursula", "Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна",
    ],
    "m": [
        "Alexander", "Ali", "Andrew", "Anthony", "Antonio", "Benjamin", "Brian", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Eric", "Francisco", "George", "Hans", "Henry", "Jacob", "Jacques",
        "James", "Jason", "Javier", "Jean", "Jeffrey", "John", "Jonathan", "José", "Joseph", "Joshua", "Juan", "Jürgen", "Kenneth", "Kevin", "Klaus", "Larry", "Luis", "Matthew", "Michael", "Michel", "Miguel",
        "Mohammed", "Nicholas", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Ronald", "Ryan", "Stefan", "Stephen", "Steven", "Thomas", "Timothy", "William", "Wolfgang", "Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Сергей",
    ],
}
#: Endings of built given names by gender.
ENDINGS = {"f": ["a", "ia", "ina", "ella", "ine"], "m": ["o", "an", "us", "er", "ik"], "x": ["i", "y", "el", "is", "e"]}
ENDINGS_CYRILLIC = {"f": ["а", "ия", "ина"], "m": ["ан", "ий", "ей"], "x": ["и", "я", "ель"]}

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_CUE = "|".join(CUES)
_WORD = r"\p{Lu}(?:\p{L}+(?:['’-]\p{L}{2,})*|['’]\p{L}{2,})"
_BETWEEN = rf"[ \t]+(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES)})[ \t]+){{0,3}}"
_NAME = rf"{_WORD}(?:{_BETWEEN}{_WORD}){{0,2}}"
_TITLE_LEAD = rf"(?:(?:(?:{'|'.join(ABBREVIATED)})\.|(?:{_TITLE}))[ \t]+){{1,3}}"
_CUE_LEAD = rf"(?i:{_CUE})[:,]?[ \t]*\n?[ \t]*(?:{_TITLE_LEAD})?"
_KNOWN = "|".join(n for g in GIVEN.values() for n in g)
#: Types in the order in which they are tried at a place of the text.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "credential": r"""(?i:\b(?:password|passwd|pwd|passphrase|token|api[_-]?key|access[_-]?key|client[_-]?secret|secret|auth)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?)[^\s"',;]{6,}""",
    "key": r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|(?=[a-f]*[0-9])[0-9a-f]{32,})\b",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "mac": r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|\+\d{8,14}(?!\d)|(?<!\d)\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE_LEAD}{_NAME}|{_CUE_LEAD}(?!(?:{'|'.join(NO_NAMES)})\b){_NAME}|(?=\p{{Lu}})(?:{_KNOWN}){_BETWEEN}{_WORD})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity: it is not searched further.
HINT = rf"[@\d]|-----BEGIN|[:=]|\b(?:{_TITLE})\b|(?i:\b(?:{_CUE}))|\b(?=\p{{Lu}})(?:{_KNOWN})[ \t]"
LEAD = r"""^(?i:(?:password|passwd|pwd|passphrase|token|api[_-]?key|access[_-]?key|client[_-]?secret|secret|auth)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?)"""
NAME_LEAD = rf"^(?:{_TITLE_LEAD}|{_CUE_LEAD})"
KEEPS = {"key": r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)"}
LONGER_AFTER, IP_ROUNDS = 4, 64
#: Letters and what may stand for them.
VOWELS, CONSONANTS, HEX, LETTERS, DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоу", "бвгдзклмнпрст"
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def lead_of(kind: Column, value: Column) -> Column:
    """What stands before the part to replace: a credential's name, a title or introduction, a key's prefix, a phone's country code, a private key's mark."""
    return (
        F.when(kind == "credential", F.regexp_extract(value, LEAD, 0))
        .when(kind == "name", F.regexp_extract(value, NAME_LEAD, 0))
        .when(kind == "key", F.regexp_extract(value, KEEPS["key"], 0))
        .when(kind == "phone", F.regexp_extract(value, r"^\+(?:[17]|\d{2})", 0))
        .when(kind == "iban", F.substring(value, 1, 2))
        .when(kind == "card", F.substring(value, 1, 1))
        .when(kind == "private_key", F.regexp_extract(value, r"^-----BEGIN [A-Z ]*PRIVATE KEY-----", 0))
        .otherwise("")
    )


def tail_of(kind: Column, value: Column) -> Column:
    return F.when(kind == "email", F.regexp_extract(value, r"\.\p{L}{2,}$", 0)).when(kind == "private_key", F.regexp_extract(value, r"-----END [A-Z ]*PRIVATE KEY-----$", 0)).otherwise("")


def canonical(kind: Column, value: Column) -> Column:
    """What makes two spellings one entity: small letters and digits; an IP address as it is."""
    return F.when(kind == "ip", value).otherwise(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", ""))


def drawn(seed: Column, at: Column) -> Column:
    """A number below 65,536 for place `at`, from the seed's digest (a new digest every 15 places)."""
    chunk = F.sha2(F.concat(seed, F.lit("|"), F.floor(at / 15).cast("string")), 256)
    return F.conv(F.substring(chunk, (F.pmod(at, F.lit(15)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def replaced_letter(c: Column, hexadecimal: Column, spoken: Column, number: Column) -> Column:
    """A small letter or digit of c's kind; names and mail addresses keep vowels vowels."""
    block = (F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") / 32).cast("int") * 32  # 32 signs of a script that has no alphabet here
    return (
        F.when(c.rlike("[0-9]"), pick(DIGITS, number))
        .when(c.rlike("[a-f]") & hexadecimal, pick(HEX, number))
        .when(c.rlike("[aeiouà-æè-ïò-öù-ü]") & spoken, pick(VOWELS, number))
        .when(c.rlike("[a-zß-ÿ]") & spoken, pick(CONSONANTS, number))
        .when(c.rlike("[a-zß-ÿ]"), pick(LETTERS, number))
        .when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC, number))
        .when(c.rlike(r"\p{IsGreek}"), pick(GREEK, number))
        .when(F.octet_length(c) == 3, F.decode(F.unhex(F.lpad(F.hex(block + F.pmod(number, F.lit(32))), 4, "0")), "UTF-16BE"))
        .otherwise(pick(LETTERS, number))
    )


def luhn_sum(digits: Column) -> Column:
    """The check digit rule's sum of a string of digits, modulo 10."""
    n = F.length(digits)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(1) + F.pmod(n - i, F.lit(2))), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(F.aggregate(parts, F.lit(0), lambda a, x: a + x), F.lit(10))


def gender_of(lead: Column, word: Column) -> Column:
    """f, m or x: by title, else by the given name."""
    out = F.lit("x")
    for g in ("m", "f"):
        out = F.when(word.rlike(rf"^(?i:{'|'.join(GIVEN[g])})$"), F.lit(g)).otherwise(out)
    for g in ("m", "f"):
        out = F.when(lead.rlike(rf"\b(?:{'|'.join(TITLES[g])})\b"), F.lit(g)).otherwise(out)
    return out


def words_of(name: Column) -> Column:
    """The words of a name that are replaced as one of its parts: not particles, not initials."""
    return F.filter(F.split(name, r"[ \t]+"), lambda w: w.rlike(rf"^{_WORD}$"))


def people(value: Column) -> Column:
    """The words of a name with what each is: kind (family, given_f, given_m, given_x), canon, word.

    The last of several is the family name; a single word is one after a title, or if it is no common given name.
    """

    def of(lead: Column) -> Column:
        words = words_of(F.substring(value, F.length(lead) + 1, F.length(value)))
        titled = lead.rlike(rf"\b(?:{_TITLE})\b")

        def one(all_: Column) -> Column:
            def kind(w: Column, i: Column) -> Column:
                last = i == F.size(all_) - 1
                family = last & ((F.size(all_) > 1) | titled | ~w.rlike(rf"^(?i:{_KNOWN})$"))
                return F.when(family, F.lit("family")).otherwise(F.concat(F.lit("given_"), gender_of(lead, w)))

            return F.transform(all_, lambda w, i: F.struct(kind(w, i).alias("kind"), canonical(F.lit("name"), w).alias("canon"), w.alias("word")))

        return let(words, one)

    return let(F.regexp_extract(value, NAME_LEAD, 0), of)


def parts(value: Column, kind: Column) -> Column:
    """An entity that is no name as kind, lead, body, tail and canon (of body)."""
    return let(
        F.struct(lead_of(kind, value).alias("lead"), tail_of(kind, value).alias("tail")),
        lambda p: let(
            F.substring(value, F.length(p["lead"]) + 1, F.length(value) - F.length(p["lead"]) - F.length(p["tail"])),
            lambda body: F.struct(kind.alias("kind"), p["lead"].alias("lead"), body.alias("body"), p["tail"].alias("tail"), canonical(kind, body).alias("canon")),
        ),
    )


def units(value: Column) -> Column:
    """What of an entity has a surrogate of its own: the words of a name, or the one body."""
    return let(
        kind_of(value),
        lambda kind: F.when(kind == "name", F.transform(people(value), lambda u: F.struct(u["kind"].alias("kind"), u["canon"].alias("canon")))).otherwise(
            F.array(let(parts(value, kind), lambda p: F.struct(p["kind"].alias("kind"), p["canon"].alias("canon"))))
        ),
    )


def drawn_letters(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a unit as small letters and digits; an IP address's octets."""
    seed = F.concat(F.lit(f"{key}|"), kind, F.lit("|"), canon, F.lit("|"), attempt.cast("string"))
    hexadecimal, spoken = canon.rlike("^[0-9a-f]+$") & (kind != "family"), kind.isin("family", "email")
    longer = F.floor(attempt / LONGER_AFTER).cast("int")

    def given(sd: Column) -> Column:
        cyrillic = canon.rlike(r"\p{IsCyrillic}")

        def built(consonants: str, vowels: str, endings: dict[str, list[str]]) -> Column:
            syllables = F.array_join(F.transform(F.sequence(F.lit(0), longer), lambda i: F.concat(pick(consonants, drawn(sd, 3 * i)), pick(vowels, drawn(sd, 3 * i + 1)))), "")
            end = F.lit(endings["x"][0])
            for g, ends in endings.items():
                end = F.when(kind == f"given_{g}", F.get(F.array(*map(F.lit, ends)), F.pmod(drawn(sd, F.lit(2)), F.lit(len(ends))))).otherwise(end)
            return F.concat(syllables, pick(consonants, drawn(sd, F.lit(5))), end)

        return F.when(cyrillic, built(CYRILLIC_CONSONANTS, CYRILLIC_VOWELS, ENDINGS_CYRILLIC)).otherwise(built(CONSONANTS, VOWELS, ENDINGS))

    def made(sd: Column) -> Column:
        chars = F.filter(F.split(canon, ""), lambda c: c != "")
        last = F.substring(canon, F.greatest(F.length(canon), F.lit(1)), F.lit(1))
        letters = F.transform(chars, lambda c, i: let(drawn(sd, i), lambda number: replaced_letter(c, hexadecimal, spoken, number)))
        more = F.when(longer > 0, F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda i: replaced_letter(last, hexadecimal, spoken, drawn(sd, F.length(canon) + i)))).otherwise(F.array().cast("array<string>"))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(drawn(sd, i), F.lit(254)) + 1).cast("string")), ".")
        return F.when(kind == "ip", octets).when(kind.startswith("given_"), given(sd)).otherwise(F.array_join(F.concat(letters, more), ""))

    return F.when(canon == "", F.lit("")).otherwise(let(seed, made))


def judged_as(kind: Column) -> Column:
    """Kinds that no two surrogates share: given names of all genders are one."""
    return F.when(kind.startswith("given_"), F.lit("given")).otherwise(kind)


def told_apart(kind: Column, own: Column) -> Column:
    """What no two surrogates share, whatever the title, prefix and punctuation: all; of a card, without the check digit."""
    return F.when(kind == "card", F.substring(own, F.lit(1), F.length(own) - 1)).otherwise(own)


def reformatted(value: Column, letters: Column) -> Column:
    """Small letters with the value's punctuation and capitals; those that the value has no place for come last."""
    shout = (F.upper(value) == value) & (F.lower(value) != value) & (F.length(value) > 1)

    def place(s: Column) -> Column:
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        done = F.aggregate(
            chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
            lambda a, c: F.when(~c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))).otherwise(
                F.struct(F.concat(a["out"], let(F.substring(s, a["k"], F.lit(1)), lambda x: F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(x)).otherwise(x))).alias("out"), (a["k"] + 1).alias("k"))
            ),
        )
        return let(done, lambda d: let(F.substring(s, d["k"], F.length(s)), lambda rest: F.concat(d["out"], F.when(shout, F.upper(rest)).otherwise(rest))))

    return let(letters, place)


def spelled(key: str, p: Column, attempt: Column) -> Column:
    """The whole surrogate of an entity's parts, in the entity's format."""
    own = drawn_letters(key, p["kind"], p["canon"], attempt)
    body = F.when(p["kind"] == "ip", own).otherwise(reformatted(p["body"], own))
    whole = F.concat(p["lead"], body, p["tail"])
    # the check digit runs over the whole number, first digit included
    return F.when(p["kind"] == "card", let(whole, lambda w: with_check_digit(F.concat(p["lead"], p["body"]), w))).otherwise(whole)


def spelled_word(key: str, u: Column, word: Column, attempt: Column) -> Column:
    """A word of a name; family names keep their places of capitals, given names are built anew."""
    own = drawn_letters(key, u["kind"], u["canon"], attempt)
    return F.when(u["kind"] == "family", reformatted(word, own)).when(F.upper(word) == word, F.upper(own)).otherwise(F.initcap(own))


def with_check_digit(value: Column, drawn_value: Column) -> Column:
    digits = F.regexp_replace(drawn_value, r"\D", "")
    stem = F.substring(drawn_value, F.lit(1), F.length(drawn_value) - 1)
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(F.regexp_replace(value, r"\D", "")) == 0, F.concat(stem, check)).otherwise(drawn_value)


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def drawn_again(found: DataFrame, key: str) -> DataFrame | None:
    """kind, canon and attempt of the units whose first surrogates collide, if any; found: distinct kind, canon."""
    kind, canon = F.col("kind"), F.col("canon")

    def draw(rows: DataFrame, attempt: int) -> DataFrame:
        return written(rows.select("kind", "canon", judged_as(kind).alias("judged"), told_apart(kind, drawn_letters(key, kind, canon, F.lit(attempt))).alias("s")), "pii-draws")

    first = draw(found.where("canon <> ''"), 0)
    taken, rows, again, attempt = [first.select("judged", told_apart(kind, canon).alias("s"))], first, [], 0
    while True:
        held = reduce(DataFrame.unionByName, taken).select("judged", "s", F.lit(None).cast("string").alias("who"), F.lit(1).alias("real"))
        judged = held.unionByName(rows.select("judged", "s", F.concat_ws("|", "canon", "kind").alias("who"), F.lit(0).alias("real"))).groupBy("judged", "s").agg(F.max("real").alias("real"), F.min("who").alias("keeper"), F.count("who").alias("n")).where("n > 0 AND (real = 1 OR n > 1)")
        losers = rows.join(judged, ["judged", "s"]).where(F.expr("real = 1 OR concat_ws('|', canon, kind) <> keeper")).select("kind", "canon")
        attempt += 1
        lost = draw(losers if attempt < IP_ROUNDS else losers.where("kind <> 'ip'"), attempt)
        if lost.isEmpty():
            break
        again.append(lost.select("kind", "canon", F.lit(attempt).alias("attempt")))
        taken.append(rows.select("judged", "s"))
        rows = lost
    return reduce(DataFrame.unionByName, again).groupBy("kind", "canon").agg(F.max("attempt").alias("attempt")) if again else None


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "__pii_entities") -> DataFrame:
    """docs with surrogates in text_col, and count_col, the number of entities replaced."""
    text, kept = F.col(f"`{text_col}`"), [c for c in docs.columns if c != count_col]
    found = docs.select(F.explode(entities(text)).alias("sample")).groupBy("sample").count().select(F.explode(units(F.col("sample"))).alias("u"))
    again = drawn_again(found.groupBy("u.kind", "u.canon").count().select("kind", "canon"), key)
    # the original columns are one, so that names of our own cannot clash with theirs
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]).alias("row"), text.alias("text"), entities(text).alias("found"))
    rows = rows.withColumn("people", F.when(F.size("found") > 0, F.flatten(F.transform(F.filter("found", lambda v: kind_of(v) == "name"), people))).otherwise(F.expr("CAST(array() AS array<struct<kind:string,canon:string,word:string>>)")))
    words = F.array_distinct(F.flatten(F.transform("people", lambda p: F.array(p["word"], F.upper(p["word"])))))
    rows = rows.withColumn("pattern", F.when(F.size("people") > 0, F.concat(F.lit(f"{ENTITY}|(?<![\\p{{L}}\\p{{N}}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))))
    named = F.col("pattern").isNotNull()
    rows = rows.withColumns({"all": F.when(named, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")), "between": F.when(named, F.split("text", F.col("pattern"), -1)).when(F.size("found") > 0, F.split("text", ENTITY, -1))})
    attempts = None
    if again is not None:
        keyed = rows.withColumn("sign", F.xxhash64("text"))
        places = keyed.where(F.size("found") > 0).select("sign", F.explode("found").alias("v")).distinct().select("sign", F.explode(units(F.col("v"))).alias("u")).select("sign", "u.kind", "u.canon")
        by_text = places.join(again, ["kind", "canon"]).distinct().groupBy("sign").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "canon"), "attempt"))).alias("attempts"))
        rows, attempts = keyed.join(by_text, "sign", "left"), F.col("attempts")

    def attempt_of(u: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat(u["kind"], F.lit("|"), u["canon"])), F.lit(0))

    def name(v: Column) -> Column:
        """Lead, particles, initials and spaces stay; a word is what it is where the document first has it."""

        def of(lead: Column) -> Column:
            rest = F.substring(v, F.length(lead) + 1, F.length(v))
            gaps = F.regexp_extract_all(rest, F.lit(r"[ \t]+"), F.lit(0))

            def word(w: Column, i: Column) -> Column:
                new = let(F.get(F.filter("people", lambda p: (p["word"] == w) | (F.upper(p["word"]) == w)), F.lit(0)), lambda u: F.when(u.isNotNull(), spelled_word(key, u, w, attempt_of(u))).otherwise(w))
                return F.concat(new, let(gaps, lambda g: F.coalesce(F.get(g, i), F.lit(""))))

            return F.concat(lead, F.array_join(F.transform(F.split(rest, r"[ \t]+"), word), ""))

        return let(F.regexp_extract(v, NAME_LEAD, 0), of)

    def one(v: Column) -> Column:
        return let(kind_of(v), lambda kind: F.when(kind == "name", name(v)).otherwise(let(parts(v, kind), lambda p: spelled(key, p, attempt_of(p)))))

    filled = F.when(F.size("all") == 0, F.col("text")).otherwise(let(F.transform("all", one), lambda s: F.array_join(F.transform("between", lambda x, i: F.concat(x, F.coalesce(F.get(s, i), F.lit("")))), "")))
    return rows.select(*[(F.when(F.col("text").isNotNull(), filled) if c == text_col else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(kept)], F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).alias(count_col))
