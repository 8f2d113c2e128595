"""Keyed surrogates for personal data, with built-in functions only.

Entities are found by one regular expression.  Each is replaced by a surrogate
of its own kind, which depends on the key and the entity alone: one keyed
permutation per kind maps every character class (digits, lower, upper,
Cyrillic, Greek ...) onto itself, so that format and script stay, equal
entities get equal surrogates in every text and different ones different
surrogates.  The permutation is a derangement, a shift of one character between
a Feistel cipher's inverse and the cipher itself, so no entity that is found stays
as it is.
Addresses are permuted among the valid ones, card and account numbers keep the
distance from their check digits, given names move to names of their gender and
script.  ``clashes`` checks the distinctness over a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+"
AWS = r"\bAKIA[0-9A-Z]{16}\b"
SECRET = r"(?<=[=: \"'])(?<=(?:token|secret|password|passwd|api_key|api-key|apikey) ?[=:] ?[\"']?)(?![\s=:\"'])[^\s\"']{6,}(?<![.,;])"
TOLD = r"(?<=(?:[Tt]oken|[Kk]ey|[Ss]ecret|[Pp]assword) is )(?=\S*\d)[^\s\"']{8,}(?<![.,;])|(?<=Bearer )[A-Za-z0-9._~+/=\-]{16,}(?<![.,;])"
MAC = r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])"
IPV6 = r"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])"
ABROAD = r"(?<![\d+])00\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])|(?<![\d+])\+\d{1,3} \(0\) ?\d{1,5}(?:[ .-]?\d{2,8}){1,4}(?!\d)|(?<![\d+-])0\d{4} \d{6}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"

# Given names by gender and script, those that are looked for first, as many others behind them.
NAMES = {
    "female, Latin": (
        "Aisha Amina Anna Barbara Carla Clara Elena Emma Fatima Hannah Isabel Jane Julia Laura Lucia Maria Martha Mary Nina Olivia Sarah Sofia Sophie Susan".split(),
        "Adela Agatha Beatrix Bettina Celeste Cordelia Daphne Dorothea Edith Felicia Gisela Henrietta Ingrid Josefa Lavinia Leonora Matilda Mirabel Octavia Philippa Rosalind Sabina Tabitha Wilma".split(),
    ),
    "male, Latin": (
        "Adam Ahmed Ali Carlos Daniel David Felix Hans James John Juan Karl Louis Martin Michael Mohammed Omar Paul Peter Robert Stefan Thomas Walter William".split(),
        "Alaric Anselm Barnaby Benno Cosmo Cyril Detlef Egon Fabian Florian Godfrey Gustav Horace Humphrey Ignaz Jasper Konrad Lambert Leopold Mortimer Norbert Quentin Rupert Sylvester".split(),
    ),
    "female, Cyrillic": ("Анна Вера Дарья Елена Ирина Мария Наталья Ольга Татьяна".split(), "Агата Варвара Глафира Зинаида Клавдия Лариса Марфа Серафима Ульяна".split()),
    "male, Cyrillic": ("Алексей Антон Борис Виктор Иван Олег Павел Пётр Сергей".split(), "Аркадий Богдан Герман Захар Игнат Лаврентий Макар Прохор Савелий".split()),
    "female, Greek": ("Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(), "Αγγελική Βασιλική Δέσποινα Ζωή Καλλιόπη Ουρανία Φωτεινή".split()),
    "male, Greek": ("Αλέξανδρος Γιάννης Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(), "Αχιλλέας Θανάσης Ηρακλής Λεωνίδας Μάρκος Ορέστης Στέφανος".split()),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Господин", "Госпожа", "господин", "госпожа", "Κύριος", "Κυρία", "κύριος", "κυρία")
#: Chinese surnames, and characters of given names by gender; titles stand behind the name.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江"
HAN_GIVEN = ("芳娜静丽敏艳霞英玉兰梅红莉婷雪", "明伟强军杰磊勇涛超刚建国志文平")
HAN_TITLES = ("先生", "女士", "小姐")


def _any_of(words: list[str]) -> str:
    """A pattern of alternatives that is tried by their first letters."""
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words}))


_GIVEN = _any_of([x for common, _ in NAMES.values() for x in common])
_TITLE = rf"\b(?:{'|'.join([*TITLES, *dict.fromkeys(t.upper() for t in TITLES)])})"
#: Small words inside a name; they stay.
PARTICLES = ("von", "van", "der", "den", "de", "del", "la", "di", "da", "zu", "bin", "al", "ter")
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
#: A possessive is not part of a word.
_WORD = r"\p{Lu}(?:[\p{L}\p{M}\-]|['’](?!s\b)(?=\p{L}))++"
#: Possessive loops: they take no stack, however long a word or a name.
_WORDS = rf"{_WORD}(?: {_SMALL}{_WORD})*+"
_FAR = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー・]{2,}"
_HAN = rf"[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}"
#: A look at one character, before lists are gone through.
_EAST = r"\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7AF"
NAME = rf"(?<= )(?=[\p{{L}}{_EAST}])(?<={_TITLE}\.? )(?:{_SMALL}{_WORDS}|{_FAR})|\b(?=\p{{Lu}})(?:{_GIVEN}) {_SMALL}{_WORDS}|(?=[{_EAST}]){_HAN}(?={'|'.join(HAN_TITLES)})"

ENTITY = "|".join((EMAIL, AWS, SECRET, TOLD, MAC, IPV6, IBAN, IP, ABROAD, PHONE, SSN, CARD, NAME))
#: Texts without any of these, and without a Chinese title, hold no entity.
HINT = rf"[0-9@]|AKIA|Bearer|token|secret|passw|api_key|{_TITLE}\b|\b(?=\p{{Lu}})(?:{_GIVEN}) "

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    DIGITS, LOWER, UPPER, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "ąćęłńśźżčďěňřšťůžğışőű", "ĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽĞŞŐŰ",
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "άέήίόύώ", "ΆΈΉΊΌΎΏ",
)
#: Sounds like a name: vowels stay vowels; Chinese surnames and given names stay such.
SPOKEN = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *ALPHABETS[3:7], "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", *ALPHABETS[8:], HAN_SURNAMES, *HAN_GIVEN)
HEX = (DIGITS, "abcdef", "ABCDEF")
#: Moved in secrets as well.
SIGNS = "!#$%&()*+-/<>?@[]^_`{|}~"
#: Characters that no alphabet has move within the same kind in their run of so many code points.
RUN = 64
#: Endings of surnames that tell the gender stay.
ENDING = r"(?<=\p{L}\p{L})(?:(?:ов|ев|ёв|ин|ын)а?|ск(?:ий|ая)|[sc]k[ia])$"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def _run(c: Column) -> Column:
    """The characters of c's kind and run of code points that no alphabet has, as one string; null for white space and what is unassigned."""
    kind = F.when(c.rlike(r"^\p{Lu}$"), r"^\p{Lu}$").when(c.rlike(r"^\p{L}$"), r"^[\p{L}&&[^\p{Lu}]]$").when(c.rlike(r"^\p{N}$"), r"^\p{N}$").when(c.rlike(r"^[\p{S}\p{P}]$"), r"^[\p{S}\p{P}]$").when(c.rlike(r"^\p{M}$"), r"^\p{M}$")
    first = F.ascii(c) - F.ascii(c) % RUN
    near = F.transform(F.sequence(first, first + RUN - 1), lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    return F.when(kind.isNotNull(), F.array_join(F.filter(near, lambda x: F.rlike(x, kind) & (F.position(x, F.lit("".join((*ALPHABETS, HAN_SURNAMES, *HAN_GIVEN)))) == 0)), ""))


def _own(c: Column, alphabets: Column, signs: Column) -> Column:
    """The characters that c moves among: the first of the alphabets that has it, else its run's; null if c stays."""
    far = ~c.rlike(r"^[\x00-\x7F]$") & (signs | ~c.rlike(r"^[\p{S}\p{P}]$"))
    own = F.coalesce(F.get(F.filter(alphabets, lambda a: F.position(c, a) > 0), 0), F.when(far, _run(c)))
    return F.when(F.length(own) > 1, own)


def _move(c: Column, own: Column, by: Column) -> Column:
    return F.when(own.isNull(), c).otherwise(F.substr(own, F.pmod(F.position(c, own) - 1 + by, F.length(own)) + 1, F.lit(1)))


def _half(chars: Column, own: Column, other: Column, key: Column, turn: int, sign: int) -> Column:
    """chars, each moved forth (sign 1) or back (-1) by a byte of the keyed hash of the other half."""
    stream = F.sha2(F.concat(key, F.lit(f"|{turn}|"), F.array_join(other, "")), 256)
    by = lambda h, j: F.conv(F.substr(h, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
    return _let(stream, lambda h: F.transform(chars, lambda c, j: _move(c, F.get(own, j), by(h, j))))


def derange(text: Column, key: Column, alphabets: Column, signs: Column) -> Column:
    """A keyed one-to-one map of strings onto strings of equal format; only a string none of whose characters can move stays.

    Two Feistel rounds undone, one character moved on, the rounds done again:
    the conjugate of a map without fixed points has none.
    """
    cut = lambda c: F.size(c) - F.floor(F.size(c) / 2).cast("int")
    both = lambda c: F.struct(c.alias("c"), F.transform(c, lambda x: _own(x, alphabets, signs)).alias("o"))
    part = lambda x: F.struct(F.slice(x["c"], F.lit(1), cut(x["c"])).alias("a"), F.slice(x["c"], cut(x["c"]) + 1, F.size(x["c"])).alias("b"), F.slice(x["o"], F.lit(1), cut(x["c"])).alias("p"), F.slice(x["o"], cut(x["c"]) + 1, F.size(x["c"])).alias("q"))
    left = lambda sign: lambda h: F.struct(_half(h["a"], h["p"], h["b"], key, 1, sign).alias("a"), h["b"].alias("b"), h["p"].alias("p"), h["q"].alias("q"))
    right = lambda sign: lambda h: F.struct(h["a"].alias("a"), _half(h["b"], h["q"], h["a"], key, 0, sign).alias("b"), h["p"].alias("p"), h["q"].alias("q"))

    def on(h: Column) -> Column:
        first = lambda o: F.array_position(F.transform(o, lambda x: x.isNotNull()), True) - 1
        by = lambda o: F.pmod(F.xxhash64(key, o), F.length(o) - 1).cast("int") + 1
        step = lambda c, o, at: F.transform(c, lambda x, j: F.when(j == at, _move(x, F.get(o, j), by(F.get(o, j)))).otherwise(x))
        in_a = first(h["p"]) >= 0
        return F.struct(F.when(in_a, step(h["a"], h["p"], first(h["p"]))).otherwise(h["a"]).alias("a"), F.when(in_a, h["b"]).otherwise(step(h["b"], h["q"], first(h["q"]))).alias("b"), h["p"].alias("p"), h["q"].alias("q"))

    halves = _let(_let(F.split(text, ""), both), part)
    for f in (left(-1), right(-1), on, right(1), left(1)):
        halves = _let(halves, f)
    return _let(halves, lambda h: F.array_join(F.concat(h["a"], h["b"]), ""))


def _luhn(digits: Column) -> Column:
    """The sum of the digits, every second from the right doubled (its digits summed), without a check digit."""
    def add(s: Column, d: Column) -> Column:
        twice = d.cast("int") * 2
        value = F.when(s["odd"], twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d.cast("int"))
        return F.struct((s["sum"] + value).alias("sum"), (~s["odd"]).alias("odd"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), add)["sum"]


def _mod97(account: Column, country: Column) -> Column:
    """The account, the country and 00 as a number modulo 97, letters counting from 10."""
    value = lambda c: F.position(c, F.lit(DIGITS + UPPER)) - 1
    add = lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00")), ""), F.lit(0), add)


def _address(e: Column, key: Column) -> Column:
    """A permutation of the 32-bit addresses without a fixed one; null for what is no address."""
    octets = F.split(e, r"\.")
    part = lambda i: F.get(octets, i).cast("int")
    halves = F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b"))
    mask = lambda x, t: F.conv(F.substr(F.sha2(F.concat(key, F.lit(f"|{t}|"), x.cast("string")), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")
    left = lambda h: F.struct(h["a"].bitwiseXOR(mask(h["b"], 1)).alias("a"), h["b"].alias("b"))
    right = lambda h: F.struct(h["a"].alias("a"), h["b"].bitwiseXOR(mask(h["a"], 0)).alias("b"))
    on = lambda h: F.struct(F.pmod(h["a"] + F.pmod(F.xxhash64(key), F.lit(65535)).cast("int") + 1, F.lit(65536)).alias("a"), h["b"].alias("b"))
    for f in (left, right, on, right, left):
        halves = _let(halves, f)
    dotted = _let(halves, lambda h: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(h["a"], 8), h["a"] % 256, F.shiftright(h["b"], 8), h["b"] % 256)]))
    return F.when(F.forall(octets, lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o)), dotted)


def _lists() -> Column:
    return F.array(*[F.array(*map(F.lit, x)) for both in NAMES.values() for x in (both, both[::-1]) for x in ([*x[0], *x[1]],)])


def _given(w: Column, key: Column) -> Column:
    """A given name's replacement: those looked for and the others of its gender and script change places; null for other words."""
    own = F.get(F.filter(_lists(), lambda x: F.exists(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), lambda y: y == w)), 0)

    def other(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.get(x, half + F.pmod(F.array_position(x, w) - 1 + F.pmod(F.xxhash64(key, F.get(x, 0)), half), half).cast("int"))

    return _let(own, other)


def _word(w: Column, key: Column, alphabets: Column) -> Column:
    """A name's word: given names by list; others keep their ending and go on while they meet a listed name."""
    listed = F.flatten(F.array(*[F.array(*map(F.lit, [*a, *b])) for a, b in NAMES.values()]))
    end = F.coalesce(F.regexp_substr(w, F.lit(ENDING)), F.lit(""))

    def moved(tail: Column) -> Column:
        stem = F.substr(w, F.lit(1), F.length(w) - F.length(tail))
        step = lambda s, i: F.when((i == 0) | F.array_contains(listed, F.concat(s, tail)), derange(s, key, alphabets, F.lit(False))).otherwise(s)
        some = F.aggregate(F.sequence(F.lit(0), F.lit(2)), stem, step)
        # A permutation leaves the lists after no more steps than they have words.
        rest = lambda s: F.when(F.array_contains(listed, F.concat(s, tail)), F.aggregate(F.sequence(F.lit(1), F.size(listed)), s, step)).otherwise(s)
        return F.concat(_let(some, rest), tail)

    return F.when(w.isin(*PARTICLES), w).otherwise(F.coalesce(_given(w, key), _let(end, moved)))


def kind_of(e: Column) -> Column:
    whole = lambda p: e.rlike(rf"^(?:{p})$")
    return (
        F.when(whole(f"{MAC}|{IPV6}"), "hex").when(whole(ABROAD), "phone").when(whole(EMAIL), "email").when(whole(AWS), "access_key").when(whole(IP), "ip").when(whole(SSN), "ssn")
        .when(whole(CARD), "card").when(whole(PHONE), "phone").when(whole(IBAN), "iban")
        .when(whole(rf"{_SMALL}{_WORDS}|{_FAR}"), "name").when(whole("[0-9a-f]+|[0-9A-F]+"), "hex").otherwise("secret")
    )


def surrogate(e: Column, kind: Column, key: Column) -> Column:
    """The replacement of entity e; kind as kind_of gives it.

    A country code, a key's fixed prefix and an e-mail address's last label
    stay; a card's last digit and an account's check digits keep their distance
    from the right ones.  What has nothing to move gets a keyed word.
    """
    keyed = F.concat(key, F.lit("|"), kind)
    fixed = F.when(kind.isin("phone", "access_key", "iban"), r"^(?:(?:\+|00)\d{1,3}(?=[ .(-])|AKIA|[A-Z]{2}\d{2})?").otherwise(F.lit("^"))
    last = F.when(kind == "email", r"\.[^.]*$").when(kind == "card", r"\d$").otherwise(F.lit("$"))
    sets = [F.array(*map(F.lit, x)) for x in (SPOKEN, HEX, ALPHABETS, (*ALPHABETS, SIGNS))]
    alphabets = F.when(kind == "name", sets[0]).when(kind == "hex", sets[1]).when(kind == "secret", sets[3]).otherwise(sets[2])
    pure = lambda x: F.regexp_replace(x, r"\D", "")

    def whole(p: Column) -> Column:
        middle = F.substr(e, F.length(p["head"]) + 1, F.length(e) - F.length(p["head"]) - F.length(p["tail"]))
        name = F.array_join(F.transform(F.split(middle, " "), lambda w: _word(w, keyed, alphabets)), " ")
        new = F.when(kind == "name", name).otherwise(derange(middle, keyed, alphabets, kind == "secret"))
        card = lambda n: F.pmod(p["tail"].cast("int") + _luhn(pure(middle)) - _luhn(pure(n)), F.lit(10)).cast("string")
        country, check = F.substr(p["head"], F.lit(1), F.lit(2)), F.substr(p["head"], F.lit(3), F.lit(2)).cast("int")
        moved = lambda n: F.pmod(check - 2 + _mod97(middle, country) - _mod97(n, country), F.lit(97)) + 2
        head = lambda n: F.when(kind == "iban", F.concat(country, F.lpad(F.when(check.between(2, 98), moved(n)).otherwise(check).cast("string"), 2, "0"))).otherwise(p["head"])
        return _let(new, lambda n: F.concat(head(n), n, F.when(kind == "card", card(n)).otherwise(p["tail"])))

    parts = F.struct(F.coalesce(F.regexp_substr(e, fixed), F.lit("")).alias("head"), F.coalesce(F.regexp_substr(e, last), F.lit("")).alias("tail"))
    word = F.translate(F.substr(F.sha2(F.concat(keyed, F.lit("|none|"), e), 256), F.lit(1), F.lit(16)), DIGITS, "ghijklmnop")
    new = F.coalesce(F.when(kind == "ip", _address(e, keyed)), _let(parts, whole))
    return _let(new, lambda n: F.when(n == e, word).otherwise(n))


#: Stands around entities while a text is cut; a text that has it is cut by two passes.
MARK = "\uE000"


def entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with __e (entities in order), __k (their kinds), __s (their surrogates) and __g (what stands between); null without entities."""
    text = F.col("text").cast("string")
    hint = text.rlike(HINT)
    for title in HAN_TITLES:
        hint = hint | F.contains(text, F.lit(title))
    docs = docs.withColumn("__some", F.coalesce(hint, F.lit(False)))
    some = F.col("__some")
    marked = F.split(F.regexp_replace(text, f"({ENTITY})", f"{MARK}$1{MARK}"), MARK, -1)
    plain = F.col("__c").isNotNull()
    out = docs.withColumn("__c", F.when(some & ~F.contains(text, F.lit(MARK)), marked))
    odd = lambda x, i: i % 2 == 1
    even = lambda x, i: i % 2 == 0
    out = out.withColumn("__e", F.when(plain, F.filter("__c", odd)).when(some, F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(0))))
    out = out.withColumn("__e", F.when(F.size("__e") > 0, F.col("__e")))
    out = out.withColumn("__k", F.transform("__e", kind_of))
    out = out.withColumn("__s", F.zip_with("__e", "__k", lambda e, k: surrogate(e, k, F.lit(key))))
    return out.withColumn("__g", F.when(F.col("__e").isNotNull(), F.when(plain, F.filter("__c", even)).otherwise(F.split(text, ENTITY, -1)))).drop("__c", "__some")


def pseudonymise(docs: DataFrame, key: str = "a secret of the caller") -> DataFrame:
    """docs with text replaced and n_entities (long), kinds (of each entity, in order).

    All rows and columns stay; columns named like the new ones are replaced.
    A null text stays null and has no entities, an empty one is empty; repeated
    rows get equal texts, since surrogates depend on key and entity only.  An
    empty table gives an empty one.
    """
    out = entities(docs.drop("n_entities", "kinds"), key)
    gaps = F.transform("__g", lambda g, i: F.concat(g, F.coalesce(F.get(F.col("__s"), i), F.lit(""))))
    new = F.when(F.col("__e").isNull(), F.col("text").cast("string")).otherwise(F.array_join(gaps, ""))
    size = F.when(F.col("__e").isNotNull(), F.size("__e")).otherwise(0).cast("long")
    out = out.withColumns({"text": new, "n_entities": size, "kinds": F.coalesce(F.col("__k"), F.array().cast("array<string>"))})
    return out.drop("__e", "__k", "__s", "__g")


def clashes(docs: DataFrame, key: str = "a secret of the caller") -> DataFrame:
    """(surrogate, n) of the surrogates that n > 1 different entities of the whole table share, or (surrogate, 1) where one is its own."""
    each = entities(docs.select("text"), key).select(F.explode(F.arrays_zip("__e", "__s")).alias("x")).select("x.__e", "x.__s")
    found = each.groupBy(F.col("__s").alias("surrogate")).agg(F.countDistinct("__e").alias("n"), F.max((F.col("__e") == F.col("__s")).cast("int")).alias("own"))
    return found.where("n > 1 OR own = 1").select("surrogate", "n")
