"""PII replaced by surrogates, with DataFrame functions alone.

One regular expression finds the entities of a text; what lies between them is kept. Each entity becomes a surrogate that
a secret key and the entity alone decide, so one entity has one surrogate in the whole corpus (coreference):
- numbers (cards, phones, IPv4 addresses, social security numbers) go through a keyed Feistel permutation of the digits
  of their format, so different numbers of a format stay different; cards keep their brand's digit and get a valid check
  digit again, phones keep a country code that is written with a plus;
- e-mail addresses, access keys and secrets keep their length and the class of each character; up to SHORT characters
  this is a permutation, so different ones stay different. Addresses end in .example, after their own last label;
- each word of a name gets parts of a keyed hash, of 64 bits at least. A grouped check over all entities that are not
  numbers looks for two that share a surrogate; if there are any, the next key of a fixed sequence is taken for all.
Names follow a title or begin with a given name of the lists in names.py; they go on over all capitalised words, initials
and particles. Their surrogates have the gender and script of the name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import names
from foliant.llm.common import stored

#: Keys that are tried before giving up; a second is needed with a chance of about n * n / 2**65 for n entities.
MAX_KEYS = 8

# Given names that surrogates begin with by script and gender, titles by gender, and the sixteen begins and ends of syllables; as every
# syllable begins with a consonant before a vowel, syllables in a row read in one way only.
LATIN_MALE_NAMES = ["Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nico", "Oscar", "Paul"]
LATIN_FEMALE_NAMES = ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"]
CYRILLIC_MALE_NAMES = ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Фёдор"]
CYRILLIC_FEMALE_NAMES = ["Алина", "Белла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
LATIN_SYLLABLES = (list("bdfghjklmnprstvz"), [v + c for v in "aeiou" for c in ("", "n", "l")] + ["ei"])
CYRILLIC_SYLLABLES = (list("бдфгхжклмнпрствз"), [v + c for v in "аеиоу" for c in ("", "н", "л")] + ["ай"])
# The alphabets within which a character is replaced.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
#: Characters up to which a replacement of characters is a permutation.
SHORT = 64
#: Syllables of a surrogate's word, of eight bits each.
SYLLABLES = 8


class GivenNames:
    """The surrogates for given names of a gender and script: a known name drawn out by SYLLABLES syllables. They are
    16 times 2**64, so membership is a pattern's."""

    def __init__(self, begins: list[str], syllables: tuple[list[str], list[str]]):
        self.begins, self.syllables = begins, syllables
        self.pattern = re.compile("(?:%s)(?:(?:%s)(?:%s)){%d}" % (*("|".join(x) for x in (begins, *syllables)), SYLLABLES))

    def __contains__(self, name: str) -> bool:
        return self.pattern.fullmatch(name) is not None


LATIN_MALE, LATIN_FEMALE = GivenNames(LATIN_MALE_NAMES, LATIN_SYLLABLES), GivenNames(LATIN_FEMALE_NAMES, LATIN_SYLLABLES)
CYRILLIC_MALE, CYRILLIC_FEMALE = GivenNames(CYRILLIC_MALE_NAMES, CYRILLIC_SYLLABLES), GivenNames(CYRILLIC_FEMALE_NAMES, CYRILLIC_SYLLABLES)

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A capitalised word of a name; what may stand before it in a name.
NAME = r"\p{Lu}(?:\p{L}|['’-]\p{L})++"
PARTICLES = ["von", "vom", "van", "de", "der", "den", "del", "della", "di", "da", "do", "dos", "du", "la", "le", "ten", "ter", "zu", "zum", "zur", "bin", "ibn", "al", "el"]
BEFORE_NAME = rf"(?:(?:{'|'.join(PARTICLES)}|\p{{Lu}}\.) )*+"
GIVEN = rf"{names.pattern_of(names.MALE.split() + names.FEMALE.split())}(?:['’-]\p{{L}}++)*+(?!\p{{L}})"
#: Labels and local parts have 63 and 64 characters at most, as the standards say, so no start is scanned far in vain.
#: All repeated groups are possessive or of few turns: others take a stack frame a turn, and long texts have many turns.
LABEL = r"[\p{L}\d][\p{L}\d-]{0,62}+(?<!-)"
HOST = rf"{LABEL}(?:\.{LABEL})++"
EMAIL = rf"[\p{{L}}\d][\p{{L}}\d._%+-]{{0,63}}+@{HOST}"
ACCESS_KEY = r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"""(?:[Pp]ass(?:word|wd)|PASSWORD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,3}[=:]\s{0,3}["']?[^\s"',;=:]{6,}"""
IP = rf"(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\d]|\.\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\d])"
SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\d-])"
#: Groups of digits in a row, of 13 digits at least, up to where another entity begins; cards are looked for inside.
RUN = rf"(?=\d(?:[ -]?\d){{12}})\d++(?!\p{{L}})(?:[ -](?!{EMAIL}|{SSN}|{PHONE}|{IP})\d++(?!\p{{L}}))*+"
#: The groupings in which cards are written; numbers of groups, the likelier first.
CARD = r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}"
CARD_GROUPS = (1, 4, 3, 5)
TITLED = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.?(?: {BEFORE_NAME}{NAME})++"
GIVEN_NAME = rf"(?=\p{{Lu}}){GIVEN}(?: {BEFORE_NAME}{NAME})++"
#: The value at the end of a secret.
VALUE = r"""[^\s"',;=:]+$"""
#: Every entity begins after something that is neither letter nor digit.
ENTITY = rf"(?<![\p{{L}}\d])(?:{'|'.join([EMAIL, ACCESS_KEY, SECRET, SSN, PHONE, RUN, IP, TITLED, GIVEN_NAME])})"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, doubling every second from the last but one."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))


def is_card(text: Column) -> Column:
    digits = digits_of(text)
    return F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(False)


def kind_of(entity: Column) -> Column:
    """The kind of a found entity; null for numbers that are no card."""
    whole = lambda pattern: entity.rlike(f"^(?:{pattern})$")
    kinds = [(ACCESS_KEY, "key"), (SSN, "ssn"), (PHONE, "phone"), (IP, "ip"), (TITLED, "name"), (GIVEN_NAME, "name")]
    found = reduce(lambda c, x: c.when(whole(x[0]), F.lit(x[1])), kinds, F.when(whole(EMAIL), F.lit("email")))
    return found.when(whole(r"[\d -]*"), F.when(is_card(entity), F.lit("card"))).otherwise(F.lit("secret"))


def pieces(entity: Column) -> Column:
    """A found entity as an array of parts that join to it: of a run of numbers each card and what lies between, as cards
    stand beside dates, codes and counts; any other entity alone. Without a card in a usual grouping, a run of up to 19
    digits, or the first groups of a longer one up to 19, are one part, in which any grouping may be a card."""
    def split(groups: Column) -> Column:
        joined = lambda some: F.array_join(some, "")

        def card_at(i: Column) -> Column:
            tried = F.transform(F.array(*map(F.lit, CARD_GROUPS)), lambda n: F.struct(n.alias("n"), F.regexp_replace(joined(F.slice(groups, i, n)), "[ -]$", "").alias("text")))
            return F.get(F.filter(tried, lambda x: (i + x["n"] - 1 <= F.size(groups)) & x["text"].rlike(f"^(?:{CARD})$") & is_card(x["text"])), F.lit(0))

        def between(state: Column, i: Column) -> Column:
            """What stands between the last card and group i: the mark after the card, and groups."""
            return F.concat(state["end"], joined(F.slice(groups, state["next"], i - state["next"])))

        def step(state: Column, i: Column) -> Column:
            def taken(card: Column) -> Column:
                end = F.regexp_extract(F.get(groups, i + card["n"] - 2), "[ -]$", 0)
                after = F.struct(F.concat(state["done"], F.array(between(state, i), card["text"])).alias("done"), end.alias("end"), (i + card["n"]).alias("next"))
                return F.when(card.isNull(), state).otherwise(after)

            return F.when(i < state["next"], state).otherwise(F.get(F.transform(F.array(card_at(i)), taken), F.lit(0)))

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("end"), F.lit(1).alias("next"))

        def cut(state: Column) -> Column:
            head = F.regexp_extract(entity, r"^\d(?:[ -]?\d){0,18}(?!\d)", 0)
            rest = F.array(head, F.substring(entity, F.length(head) + 1, F.length(entity)))
            return F.when(F.size(state["done"]) == 0, rest).otherwise(F.concat(state["done"], F.array(between(state, F.size(groups) + 1))))

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, cut)

    runs = F.array(F.regexp_extract_all(entity, F.lit(r"\d+[ -]?"), F.lit(0)))
    return F.when(entity.rlike(f"^(?:{RUN})$"), F.get(F.transform(runs, split), F.lit(0))).otherwise(F.array(entity))


def identity(text: Column, kind: Column) -> Column:
    """What makes two entities the same: the address in lower case, the secret's value alone."""
    return F.when(kind == "email", F.lower(text)).when(kind == "secret", F.regexp_extract(text, VALUE, 0)).otherwise(text)


def keyed(key: Column | str, *parts: Column) -> Column:
    """A keyed hash of parts as 64 hexadecimal digits."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.sha2(F.concat_ws("\x1f", key, F.sha2(F.concat_ws("\x1f", key, *parts), 256)), 256)


def hash_below(key: str, modulus: Column, *parts: Column) -> Column:
    return F.conv(F.substring(keyed(key, *parts), 1, 15), 16, 10).cast("long") % modulus


def masked(text: Column, key: str, *tweak: Column) -> Column:
    """text with every letter and digit replaced by one of its alphabet; other characters stay, and so does the length.

    A character is shifted by a keyed hash of all before it, then by one of all after it, so both steps can be undone from
    one end to the other: different texts stay different. Over SHORT characters, where hashing all before each would be
    quadratic, the shifts come from one hash of the whole."""
    every, ends = "".join(ALPHABETS), [sum(map(len, ALPHABETS[: i + 1])) for i in range(len(ALPHABETS))]

    def shifted(c: Column, h: Column) -> Column:
        """c moved on within its alphabet by what a hash says."""
        def moved(place: Column) -> Column:
            own = lambda i: F.substring(F.lit(every), F.lit(ends[i] - len(ALPHABETS[i]) + 1) + F.pmod(place - 1 - (ends[i] - len(ALPHABETS[i])) + F.pmod(F.xxhash64(h), F.lit(len(ALPHABETS[i]))), F.lit(len(ALPHABETS[i]))).cast("int"), F.lit(1))
            return reduce(lambda w, i: w.when(place <= ends[i], own(i)), range(1, len(ALPHABETS)), F.when(place == 0, c).when(place <= ends[0], own(0)))

        return F.get(F.transform(F.array(F.instr(F.lit(every), c)), moved), F.lit(0))

    def replaced(chars: Column) -> Column:
        hashed = lambda side, *parts: F.sha2(F.concat_ws("\x1f", F.lit(f"{key}/{side}"), *tweak, *parts), 256)
        forth = F.transform(chars, lambda c, i: shifted(c, hashed("forth", F.array_join(F.slice(chars, F.lit(1), i), ""))))
        back = F.transform(F.array(forth), lambda y: F.transform(y, lambda c, i: shifted(c, hashed("back", F.array_join(F.slice(y, i + 2, F.size(y)), "")))))
        long = F.transform(F.array(hashed("whole", text)), lambda w: F.transform(chars, lambda c, i: shifted(c, F.sha2(F.concat_ws("\x1f", w, i.cast("string")), 256))))
        return F.array_join(F.get(F.when(F.size(chars) <= SHORT, back).otherwise(long), F.lit(0)), "")

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), replaced), F.lit(0))


def refit(entity: Column, digits: Column) -> Column:
    """The entity with its digits, in order, replaced by others of the same number."""
    place = lambda i: F.length(digits_of(F.substring(entity, F.lit(1), i)))
    char = lambda i: F.substring(entity, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(char(i).rlike(r"\d"), F.substring(digits, place(i), F.lit(1))).otherwise(char(i))), "")


def new_digits(items: Column, key: str) -> Column:
    """items: entities of kind, text and head (digits kept) and body (digits permuted, in base `base`). Adds the halves
    a, b of the body permuted by four Feistel rounds, each a transform of its own so that no round is worked out twice."""
    half = F.lit(10).cast("long")
    size = lambda x, side: F.when(x["kind"] == "ip", F.lit(65536)).otherwise(F.pow(half, side)).cast("long")
    def split(x: Column) -> Column:
        n = F.length(x["body"])
        low = (n / 2).cast("int")
        ip = F.split(x["text"], r"\.")
        pair = lambda i: F.get(ip, F.lit(i)).cast("long") * 256 + F.get(ip, F.lit(i + 1)).cast("long")
        is_ip = x["kind"] == "ip"
        a = F.when(is_ip, pair(0)).otherwise(F.coalesce(F.try_to_number(F.substring(x["body"], F.lit(1), low), F.lit("9" * 18)).cast("long"), F.lit(0)))
        b = F.when(is_ip, pair(2)).otherwise(F.coalesce(F.try_to_number(F.substring(x["body"], low + 1, n), F.lit("9" * 18)).cast("long"), F.lit(0)))
        return F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["head"].alias("head"), size(x, low).alias("ma"), size(x, n - low).alias("mb"), low.alias("na"), (n - low).alias("nb"), a.alias("a"), b.alias("b"))

    def turn(r: int):
        def left(x: Column) -> Column:
            return x.withField("a", (x["a"] + hash_below(f"{key}/{r}a", x["ma"], x["kind"], x["head"], x["b"].cast("string"), x["nb"].cast("string"))) % x["ma"])

        def right(x: Column) -> Column:
            return x.withField("b", (x["b"] + hash_below(f"{key}/{r}b", x["mb"], x["kind"], x["head"], x["a"].cast("string"), x["na"].cast("string"))) % x["mb"])

        return left, right

    items = F.transform(items, split)
    for r in range(2):
        for step in turn(r):
            items = F.transform(items, step)
    return items


def name_surrogate(text: Column, key: str) -> Column:
    """Title and particles kept; a given name of the same gender and script for each word but the last, and a family name
    for the last. Each word holds 64 bits of a hash in its syllables, so that words stay different, and so do whole names."""
    titles = rf"^(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? "
    nth = lambda some, h, i: F.get(F.array(*map(F.lit, some)), F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))

    def made(syllables: tuple[list[str], list[str]], h: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(SYLLABLES)), lambda i: F.concat(nth(syllables[0], h, 2 * i - 1), nth(syllables[1], h, 2 * i))), "")

    def renamed(x: Column) -> Column:
        words, cyrillic = x["words"], x["cyrillic"]
        female_title = x["title"].rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\b")
        female_name = F.get(words, F.lit(0)).rlike(rf"^(?:{names.pattern_of(names.FEMALE.split())})(?!\p{{L}})")
        last = F.size(words) - 1

        def given(word: Column) -> Column:
            h = keyed(f"{key}/given", word)
            drawn_out = lambda pool: F.concat(nth(pool.begins, h, F.lit(2 * SYLLABLES + 1)), made(pool.syllables, h))
            female = female_title | ((x["title"] == "") & female_name)
            return F.when(word.isin(*PARTICLES), word).when(cyrillic & female, drawn_out(CYRILLIC_FEMALE)).when(cyrillic, drawn_out(CYRILLIC_MALE)).when(female, drawn_out(LATIN_FEMALE)).otherwise(drawn_out(LATIN_MALE))

        def family(word: Column) -> Column:
            h = keyed(f"{key}/family", word)
            return F.initcap(F.when(cyrillic, made(CYRILLIC_SYLLABLES, h)).otherwise(made(LATIN_SYLLABLES, h)))

        return F.concat(x["title"], F.array_join(F.transform(words, lambda word, i: F.when(i < last, given(word)).otherwise(family(word))), " "))

    parts = F.struct(F.regexp_extract(text, titles, 0).alias("title"), F.split(F.regexp_replace(text, titles, ""), " ").alias("words"), text.rlike(r"\p{IsCyrillic}").alias("cyrillic"))
    return F.get(F.transform(F.array(parts), renamed), F.lit(0))


def surrogates(entities: Column, key: str) -> Column:
    """The surrogates of an array of found entities, in order."""
    def sort_out(e: Column) -> Column:
        kind = kind_of(e)
        return F.struct(kind.alias("kind"), e.alias("text"))

    def parts(x: Column) -> Column:
        d = digits_of(x["text"])
        code = F.regexp_extract(x["text"], r"^\+(\d{1,3})", 1)
        kept = F.when(x["kind"] == "card", 1).when(x["kind"] == "phone", F.length(code)).otherwise(0)
        number = x["kind"].isin("card", "phone", "ssn")
        body = F.when(x["kind"] == "card", F.substring(d, kept + 1, F.length(d) - 2)).when(number, F.substring(d, kept + 1, F.length(d))).otherwise(F.lit(""))
        head = F.when(number, F.substring(d, F.lit(1), kept)).otherwise(F.lit(""))
        return F.struct(x["kind"].alias("kind"), x["text"].alias("text"), head.alias("head"), body.alias("body"))

    def write(x: Column) -> Column:
        text, kind = x["text"], x["kind"]
        body = F.concat(x["head"], F.lpad(x["a"].cast("string"), x["na"], F.lit("0")), F.lpad(x["b"].cast("string"), x["nb"], F.lit("0")))
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        ip = F.concat_ws(".", *[(F.shiftright(x[side], 8) if high else x[side] % 256).cast("string") for side in "ab" for high in (True, False)])
        value, low = F.regexp_extract(text, VALUE, 0), F.lower(text)
        domain, last = F.substring_index(low, "@", -1), F.substring_index(low, ".", -1)
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
        email = F.concat(masked(F.substring_index(low, "@", 1), f"{key}/email", domain), F.lit("@"), masked(host, f"{key}/domain", last), F.lit("."), last, F.lit(".example"))
        access = F.concat(F.substring(text, 1, 4), masked(F.substring(text, F.lit(5), F.length(text)), f"{key}/access", F.substring(text, 1, 4)))
        secret = F.concat(F.regexp_replace(text, VALUE, ""), masked(value, f"{key}/secret"))
        number = refit(text, F.when(kind == "card", F.concat(body, check)).otherwise(body))
        return F.when(kind.isNull(), text).when(kind == "email", email).when(kind == "key", access).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "name", name_surrogate(text, key)).otherwise(number)

    return F.transform(new_digits(F.transform(F.transform(entities, sort_out), parts), key), write)


def found_entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def sound_key(docs: DataFrame, text_col: str, key: str) -> str:
    """The first of the keys made from key under which no two different entities of the corpus share a surrogate.

    Distinct entities and surrogates are counted by groups; no entity comes to the driver. Numbers are permuted and need
    no check. Of names and addresses the whole surrogate is compared, of secrets the value.
    """
    entities = docs.select(F.explode(found_entities(F.col(f"`{text_col}`"))).alias("e")).distinct()
    hashed = entities.withColumn("kind", kind_of(F.col("e"))).filter(F.col("kind").isin("email", "key", "secret", "name"))
    hashed = hashed.withColumn("who", identity(F.col("e"), F.col("kind")))
    hashed = stored(hashed.select("e", "who", "kind"), "entities")
    for i in range(MAX_KEYS):
        tried = f"{key}/{i}"
        made = hashed.select("kind", "who", F.get(surrogates(F.array("e"), tried), F.lit(0)).alias("s"))
        made = made.withColumn("s", F.when(F.col("kind") == "name", F.col("s")).otherwise(F.regexp_extract("s", VALUE, 0)))
        if made.groupBy("kind", "s").agg(F.min("who").alias("lo"), F.max("who").alias("hi")).filter("lo <> hi").isEmpty():
            return tried
    raise ValueError(f"all of {MAX_KEYS} keys give two entities one surrogate")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the entities of the text replaced. Null texts stay null, texts without entities
    and empty texts stay as they are; repeated rows stay repeated and equal. One pass finds, for the check, the distinct
    entities; a second replaces; no text is shuffled."""
    key = sound_key(docs, text_col, key)
    text = F.col(f"`{text_col}`")

    def rebuilt(parts: Column) -> Column:
        between = F.split(text, ENTITY, -1)
        before = F.flatten(F.zip_with(F.slice(between, F.lit(1), F.size(parts)), parts, lambda a, p: F.concat(F.array(a), F.array_repeat(F.lit(""), F.size(p) - 1))))
        pairs = F.zip_with(before, surrogates(F.flatten(parts), key), lambda a, b: F.concat(a, b))
        return F.when(F.size(parts) == 0, text).otherwise(F.concat(F.array_join(pairs, ""), F.element_at(between, -1)))

    return docs.withColumn(text_col, F.get(F.transform(F.array(F.transform(found_entities(text), pieces)), rebuilt), F.lit(0)))
