"""Surrogates for personal data, with DataFrame functions only.

Detected entities are e-mail addresses, telephone numbers, IPv4 and IPv6
addresses, payment card numbers, US social security numbers, IBANs, names after
a form of address, and bare mentions of those names (three letters or more) in the
same text. Each is
replaced by a keyed surrogate of its own type in the writing that it has there.

* The digits of telephone, card and social security numbers, of IBANs and of the
  last three octets of IPv4 addresses go through a keyed permutation of all such
  numbers, so surrogates differ by construction. Separators stay; so do the first
  digits of a telephone or card number, the country and bank letters of an IBAN.
  A check digit is right in the surrogate if it was right in the original. A social
  security number starts with 9, as none in use does, and an IPv4 address with 10, while the
  rest tells apart.
* E-mail addresses, IPv6 addresses and names come from a keyed hash. Entities that
  share a surrogate are ranked by hash, and all but the first get a suffix made
  from the rank, in letters that no surrogate without one has.
* A name is all capitalised words and initials after the form of address: the last
  word is the surname, the others are given names, and each is an entity, so "Mr
  Smith", "Dr John Smith" and a later "John Smith" agree, in one text and across
  texts. An initial stays an initial (a keyed cycle through the capitals of its
  script); words keep the script and the case. A given name has the gender of its form of address, or
  of one in the same text, or of most in the corpus, or of its own ending.

A surrogate may be the original of another entity (a permutation of all numbers
has no others to give), but never its own original.

Texts are matched once: the rows are written with their matches marked by type,
rows with entities are joined with their surrogates, and the others pass through.
Distinct entities are found by a shuffle that combines map-side, so a hot one
costs one row a task.

Words, addresses and mail names are matched in their whole length. What bounds a
match is the format: numbers of 7 to 16 digits (telephone), 13 to 19 (cards), 12
to 34 characters (IBAN); in scripts without spaces a name ends after 12 letters.

Null and empty texts stay as they are; repeated rows and rows with null ids are
each rewritten; very long texts are rewritten whole; an empty table gives no
rows; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import free_name, materialize

#: Forms of address by gender, and surrogate names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος", "Κος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία", "Κα")
OTHER_TITLES = ("Dr", "Prof", "Доктор")
GIVEN = {
    ("m", "latin"): "Adam Alan Albert Anton Bruno Carl Daniel David Emil Erik Felix Frank Georg Hugo Ivan Jan Johan Karl Leo Lucas Mark Martin Max Oscar Otto Paul Peter Robert Simon Victor".split(),
    ("f", "latin"): "Ada Alice Anna Bella Carla Clara Diana Edith Ella Emma Eva Flora Greta Helen Ida Irene Jana Julia Laura Lena Lisa Maria Marta Nina Nora Olga Paula Rosa Sofia Vera".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Борис Глеб Денис Егор Кирилл Лев Марк Олег Роман Антон Артур Вадим Юрий".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Софья Юлия Алла Галина Жанна Раиса".split(),
    ("m", "greek"): "Άρης Βασίλης Γιάννης Δήμος Ηλίας Θωμάς Κώστας Λουκάς Μάρκος Νίκος Πάνος Πέτρος Σπύρος Σταύρος Τάσος Φώτης".split(),
    ("f", "greek"): "Άννα Βέρα Δανάη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λίνα Μαρία Νίκη Ξένια Όλγα Σοφία Χαρά".split(),
}
#: Syllables (or letters) of surrogate surnames.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо да де до га го ка ко ла ле ли ло ма ме ми мо на не но па ра ре ри ро са се си та те ти то ва ве ви".split(),
    "greek": "βα βε βο γα γο δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα".split(),
    "han": "安 白 柏 宝 北 彩 晨 川 春 丹 东 芳 峰 刚 光 国 海 浩 和 红 华 辉 嘉 建 江 金 静 君 康 兰 乐 丽 林 玲 龙 梅 明 宁 平 青 泉 仁 荣 山 诗 书 松 涛 天 文".split(),
    "hangul": "가 강 건 경 고 구 기 나 남 노 다 대 도 동 라 리 마 명 무 미 민 바 보 상 서 선 성 수 승 시 아 영 예 우 원 유 윤 은 인 재".split(),
    "kana": "あ い う え お か き く け こ さ し す せ そ た ち つ て と な に の は ひ ふ ほ ま み む め も や ゆ よ ら り る れ ろ".split(),
    "arabic": "با بو تا تو جا حا دا دو را رو زا سا سو شا صا طا عا فا قا كا لا لو ما مو نا نو ها يا".split(),
    "hebrew": "בא בו גא גו דא דו הא זא חא טא יא כא לא לו מא מו נא נו סא פא צא קא רא רו שא תא".split(),
    "devanagari": "का की गा चा जा टा ता ती दा ना नी पा बा भा मा मी या रा री ला वा शा सा हा".split(),
}
ALPHABETS = ("latin", "cyrillic", "greek")
_SCRIPT_CLASSES = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}"}

_TITLE = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_WORD = rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’-](?!s(?!\p{{L}}))[\p{{L}}\p{{M}}]++)*+|[{_UNSPACED}][{_UNSPACED}\p{{M}}]{{0,11}}|\p{{Lo}}[\p{{Lo}}\p{{M}}]*+)"
_NAME_PART = rf"(?:(?:\p{{Lu}}\.)++|{_WORD})"
_TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAME_PART}(?:(?: |(?<=\.)){_NAME_PART})*+"
#: Cuts a name before each space and between initials that touch.
_BETWEEN = r"(?= )|(?<=\.)(?=\p{L})"
_OPEN, _SHUT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_QUAD = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_PHONE_SIZE = r"(?=[+(]{0,2}(?:[0-9][ .()/-]{0,2}){7,16}(?![0-9]))"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?![\p{L}\p{N}]|\.[0-9])|(?<![\p{L}\p{N}])[0-9]{17,19}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:[0-9A-Fa-f]{{3,4}}|{_HEX4}(?=:{_HEX4}:))(?::{_HEX4}){{0,6}}::(?:{_HEX4}(?::{_HEX4}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+]|[0-9][.-])(?![0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![0-9]))(?!{_QUAD}){_PHONE_SIZE}"
    r"(?:(?:\+|00)[1-9][0-9]{0,3}(?:[ ./-]?\([0-9]{1,5}\))?(?:[ ./-][0-9]{1,10}){1,6}|0[1-9][0-9]{1,5}[ ./-][0-9]{3,9}(?:[ .-][0-9]{1,6}){0,3}"
    r"|(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4})(?![\p{L}\p{N}]|[.-][0-9])|(?<![\p{L}\p{N}])\+[0-9]{8,15}(?![\p{L}\p{N}])",
    "name": _TITLED,
}
#: Each type has one capture group; group 9 is for bare mentions of a text's own names.
ANY = "|".join(f"({p})" for p in PATTERNS.values())
NO_BARE = "|([^\\s\\S])"
KINDS = (*PATTERNS, "bare")
#: Cheap tests that a text can hold an entity at all; the look-ahead has the titles' first letters.
_TITLE_AHEAD = rf"(?=[{''.join(sorted({t[0] for t in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)}))}])(?:{_TITLE})\.? [\p{{Lu}}\p{{Lo}}]"
MAYBE = "[@0-9]"
#: Noncharacters of Unicode that mark matches and types; others stand for them where a text has them.
CUT, FIELD = "\ufdd0", "\ufdd1"
_ESCAPES = (("\ufdd2", "\ufdd2\ufdd5"), ("\ufdd0", "\ufdd2\ufdd3"), ("\ufdd1", "\ufdd2\ufdd4"))
#: Types whose surrogates can coincide and are then told apart by rank.
HASHED = ("email", "surname", "given", "ssn", "ip")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.split(x, "(?!^|$)")


def _given(gender: str) -> dict[str, list[str]]:
    return {script: names for (g, script), names in GIVEN.items() if g == gender}


def _script(word: Column) -> Column:
    out = F.lit("latin")
    for name, pattern in _SCRIPT_CLASSES.items():
        out = F.when(word.rlike(pattern), name).otherwise(out)
    return out


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^((?:{_TITLE})\.?) ", 1)


def _name(match: Column) -> Column:
    """What follows a form of address."""
    return F.regexp_replace(match, rf"^(?:{_TITLE})\.? ", "")


def _surname_at(words: Column) -> Column:
    """The place of a name's last word that is no initial; null if there is none."""
    return F.array_max(F.transform(words, lambda w, i: F.when(~w.endswith("."), i)))


def _next_capital(key: str) -> tuple[str, str]:
    """All capital letters, and for each the next in a keyed cycle through those of its script."""
    scripts: dict[str, list[str]] = {}
    for c in map(chr, range(0xD800)):
        if unicodedata.category(c) == "Lu":
            scripts.setdefault("ASCII" if c.isascii() else unicodedata.name(c).split()[0], []).append(c)
    cycles = [sorted(letters, key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest()) for letters in scripts.values() if len(letters) > 1]
    return "".join("".join(c) for c in cycles), "".join("".join(c[1:] + c[:1]) for c in cycles)


def _gender(match: Column) -> Column:
    title = F.regexp_replace(_title(match), r"\.$", "")
    return F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f")


def _hex6(x: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits."""
    low = F.lower(x)
    left, right = (F.filter(F.split(F.split_part(low, F.lit("::"), F.lit(k)), ":"), lambda g: g != "") for k in (1, 2))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")


def canonical(kind: Column, match: Column) -> Column:
    """What makes two writings of a match the same entity; names are split into their words instead."""
    return F.when(kind.isin("card", "phone", "ssn"), _digits(match)).when(kind == "iban", F.regexp_replace(match, " ", "")).when(kind == "email", F.lower(match)).when(kind == "ip6", _hex6(match)).otherwise(match)


def _hash(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that only the key's holder can make."""
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)), 256)


def _number(digest: Column, at: int, size: int = 8) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("long")


def _list(values) -> Column:
    """A list that Spark folds into one literal."""
    return F.split(F.lit(" ".join(map(str, values))), " ")


def _by_script(script: Column, lists: dict[str, list[str]]) -> Column:
    return reduce(lambda out, k: F.when(script == k, _list(lists[k])).otherwise(out), (k for k in lists if k != "latin"), _list(lists["latin"]))


def _pick(values: Column, number: Column) -> Column:
    return F.element_at(values, (number % F.size(values) + 1).cast("int"))


def permuted(key: str, tweak: Column, left: Column, right: Column, most_left: Column, most_right: Column) -> Column:
    """A keyed permutation of pairs below ``most_left`` and ``most_right`` without fixed points, as a struct.

    Four rounds of a Feistel network, one step to the next pair, and the rounds
    undone: one cycle through all pairs, in an order that the key decides.
    """

    def turn(s: Column, i: Column) -> Column:
        step = F.when(i < 4, i).otherwise(8 - i)
        even, sign = step % 2 == 0, F.when(i < 4, 1).otherwise(-1)
        other = F.when(even, s["r"]).otherwise(s["l"])
        drawn = F.conv(F.substring(_hash(key, tweak, step.cast("string"), other.cast("string")), 1, 15), 16, 10).cast("long")
        next_right = F.pmod(s["r"] + 1, most_right)
        carried = F.struct(F.when(next_right == 0, F.pmod(s["l"] + 1, most_left)).otherwise(s["l"]).alias("l"), next_right.alias("r"))
        mixed = F.struct(
            F.when(even, F.pmod(s["l"] + sign * F.pmod(drawn, most_left), most_left)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(drawn, most_right), most_right)).alias("r"),
        )
        return F.when(i == 4, carried).otherwise(mixed)

    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _power(digits: Column) -> Column:
    """Ten to a number of digits up to 17, exactly."""
    return F.element_at(F.array(*(F.lit(10**k).cast("long") for k in range(18))), (digits + 1).cast("int"))


def _halves(digits: Column) -> tuple[Column, Column, Column, Column]:
    """A digit string as a pair and what its sides are below."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    return F.substring(digits, F.lit(1), half).try_cast("long"), F.substring(digits, half + 1, size).try_cast("long"), _power(half), _power(size - half)


def _rejoined(digits: Column, moved: Column) -> Column:
    """A moved pair as a digit string of the old length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    return F.concat(F.lpad(moved["l"].cast("string"), half, F.lit("0")), F.lpad(moved["r"].cast("string"), F.length(digits) - half, F.lit("0")))


def permuted_digits(key: str, tweak: Column, digits: Column) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 34."""
    return _rejoined(digits, permuted(key, F.concat_ws("|", tweak, F.length(digits).cast("string")), *_halves(digits)))


def _luhn_digit(head: Column) -> Column:
    """The check digit for a run of digits."""
    values = F.transform(F.reverse(_chars(head)), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return (10 - F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10) % 10


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits (ISO 7064, modulo 97) of an IBAN."""
    values = F.transform(_chars(F.concat(account, country, F.lit("00"))), lambda c: F.conv(c, 36, 10).cast("int"))
    return 98 - F.aggregate(values, F.lit(0), lambda s, v: F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97)


def _fill(shape: Column, core: Column, keep: str) -> Column:
    """``shape`` with its characters of class ``keep`` replaced in turn by those of ``core``."""
    filled = F.aggregate(
        _chars(shape),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(keep), F.struct(F.concat(s["out"], F.substring(core, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return filled["out"]


def _cases(kind: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda out, k: F.when(kind == k, cases[k]).otherwise(out), cases, otherwise)


def surrogate_cores(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, core``: the canonical form of each surrogate, before entities that share one are told apart.

    All permuted types go through one permutation, a step of its own, so that it is computed once a row.
    """
    kind, entity, size = F.col("kind"), F.col("entity"), F.length("entity")
    unknown = F.raise_error(F.concat(F.lit("no surrogates for type "), kind)).cast("string")
    kept = F.when(size >= 9, 2).otherwise(1)
    numbers = {"card": F.substring(entity, F.lit(2), size - 2), "phone": F.substring(entity, kept + 1, size), "ssn": F.substring(entity, 2, 8), "iban": _digits(F.substring(entity, 5, 40))}
    shape = F.concat(F.substring(entity, 1, 2), F.regexp_replace(F.substring(entity, 5, 40), "[0-9]", "0"))
    tweaks = {"card": F.substring(entity, 1, 1), "phone": F.substring(entity, F.lit(1), kept), "ssn": F.substring(entity, 1, 1), "iban": shape, "ip": F.split_part(entity, F.lit("."), F.lit(1))}
    none = F.lit(None).cast("string")
    rows = entities.select("kind", "entity", _cases(kind, numbers, none).alias("digits"), _cases(kind, tweaks, none).alias("tweak"), _hash(key, kind, entity, F.lit("a")).alias("a"), _hash(key, kind, entity, F.lit("b")).alias("b"))

    octets = F.transform(F.split("entity", r"\."), lambda o: o.try_cast("int"))
    low = F.when(kind == "ip", F.try_element_at(octets, F.lit(2)) * 65536 + F.try_element_at(octets, F.lit(3)) * 256 + F.try_element_at(octets, F.lit(4)))
    pairs = zip((F.floor(low / 4096), low % 4096, F.lit(4096).cast("long"), F.lit(4096).cast("long")), _halves(F.col("digits")), strict=True)
    left, right, most_left, most_right = (F.when(kind == "ip", x).otherwise(y) for x, y in pairs)
    able = (kind == "ip") | (F.length("digits") > 1)
    moved = F.when(able, permuted(key, F.concat_ws("|", kind, F.length("digits").cast("string"), "tweak"), left, right, most_left, most_right))
    rows = rows.withColumn("moved", moved)
    rows = rows.withColumn("number", F.when(kind != "ip", F.coalesce(_rejoined(F.col("digits"), F.col("moved")), "digits")).otherwise((F.col("moved.l") * 4096 + F.col("moved.r")).cast("string")))

    a, b, number = F.col("a"), F.col("b"), F.col("number")
    head = F.concat(F.substring(entity, 1, 1), number)
    off = F.substring(entity, -1, 1).try_cast("int") - _luhn_digit(F.substring(entity, F.lit(1), size - 1))
    last = F.pmod(_luhn_digit(head) + off, F.lit(10)).cast("string")
    address = number.try_cast("long")
    ip = F.concat_ws(".", F.lit("10"), F.floor(address / 65536).cast("string"), (F.floor(address / 256) % 256).cast("string"), (address % 256).cast("string"))

    local = F.regexp_extract(entity, "^([^@]*)@", 1)
    letters = F.translate(a, "0123456789", "ghijklmnop")
    first = F.substring(letters, F.lit(1), F.greatest(F.lit(8), F.length(F.regexp_extract(local, "^([^0-9._+-]*)", 1))))
    rest = F.concat(F.regexp_extract(local, "^[^0-9._+-]*([._+-]?)", 1), F.when(local.rlike("[0-9]"), F.lpad((_number(b, 9) % 10000).cast("string"), 4, "0")).otherwise(""))
    email = F.concat(first, F.lit("|"), rest, F.lit("@"), _pick(_list(["example.com", "example.org", "example.net"]), _number(b, 1)))

    word, gender = F.split_part(entity, F.lit("|"), F.lit(1)), F.split_part(entity, F.lit("|"), F.lit(2))
    account = F.substring(entity, 5, 40)
    rows = rows.withColumn("fresh", F.when(kind == "iban", _fill(account, number, "[0-9]")).otherwise(_script(word)))
    country, script = F.substring(entity, 1, 2), F.col("fresh")
    check = F.pmod(_iban_check(country, F.col("fresh")) + F.substring(entity, 3, 2).try_cast("int") - _iban_check(country, account), F.lit(100))
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), "fresh")

    rows = rows.withColumn("sounds", _by_script(script, SYLLABLES)).withColumn("names", F.when(gender == "f", _by_script(script, _given("f"))).otherwise(_by_script(script, _given("m"))))
    syllables = F.col("sounds")
    surname = F.initcap(F.concat(*(_pick(syllables, _number(a, at)) for at in (1, 9, 17)), F.when(script.isin(*ALPHABETS), _pick(syllables, _number(a, 25))).otherwise("")))
    given = F.when(script.isin(*ALPHABETS), _pick(F.col("names"), _number(a, 1))).otherwise(F.concat(*(_pick(syllables, _number(b, at)) for at in (1, 9))))
    cores = {
        "card": F.concat(head, last), "phone": F.concat(F.substring(entity, F.lit(1), kept), number), "ssn": F.concat(F.lit("9"), number), "ip": ip, "ip6": F.concat(F.lit("fd"), F.substring(a, 1, 30)),
        "email": email, "iban": iban, "surname": surname, "given": given, "initial": F.translate(entity, *_next_capital(key)),
    }
    return rows.select("kind", "entity", _cases(kind, cores, unknown).alias("core"))


def _suffixed(kind: Column, entity: Column, core: Column, rank: Column) -> Column:
    """Told-apart surrogates: nothing for rank 0, else the rank in letters, syllables or further given names."""
    script = _script(entity)

    def spelt(values: Column, joint: str) -> Column:
        return F.array_join(F.transform(_chars(F.conv(rank.cast("string"), 10, 16)), lambda d: F.element_at(values, F.conv(d, 16, 10).cast("int") + 1)), joint)

    syllables = spelt(_by_script(script, SYLLABLES), "")
    surname = F.concat(core, syllables)
    names = F.when(entity.endswith("|f"), spelt(_by_script(script, _given("f")), "-")).otherwise(spelt(_by_script(script, _given("m")), "-"))
    given = F.when(script.isin(*ALPHABETS), F.concat(core, F.lit("-"), names)).otherwise(surname)
    letters = F.translate(rank.cast("string"), "0123456789", "qrstuvwxyz")
    email = F.replace(core, F.lit("|"), F.when(rank > 0, letters).otherwise(F.lit("")))
    ssn = F.concat(F.substring(F.lit("9012345678"), (rank + 1).cast("int"), F.lit(1)), F.substring(core, 2, 8))  # ten originals at most share eight digits
    octets = [10, *range(240, 256), *range(10), *range(11, 240)]  # 256 originals at most share three octets
    ip = F.concat(F.element_at(_list(octets), (rank + 1).cast("int")), F.substring(core, 3, 12))
    return F.when(kind == "email", email).when(kind == "ssn", ssn).when(kind == "ip", ip).when(rank == 0, core).when(kind == "surname", surname).otherwise(given)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, core`` for distinct ``kind, entity``; all cores of a kind are distinct.

    Of the hashed types, entities with one core are ranked by hash; a surname's
    core that is a surname of the corpus is not given away without a suffix.
    """
    made = materialize(surrogate_cores(entities, key), "surrogates")
    hashed = F.col("kind").isin(*HASHED)
    order = Window.partitionBy("kind", "core").orderBy(F.xxhash64("entity"), "entity")
    faces = made.where("kind = 'surname'").select("kind", F.initcap("entity").alias("core")).distinct().withColumn("taken", F.lit(1))
    ranked = made.where(hashed).withColumn("rank", F.row_number().over(order) - 1).join(faces, ["kind", "core"], "left")
    apart = _suffixed(F.col("kind"), F.col("entity"), F.col("core"), F.col("rank") + F.coalesce("taken", F.lit(0)))
    return made.where(~hashed).unionByName(ranked.select("kind", "entity", apart.alias("core")))


def written(kind: Column, match: Column, core: Column) -> Column:
    """The surrogate of a match that is no name, in its writing."""
    email = F.when(match == F.upper(match), F.upper(core)).otherwise(core)
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda at: F.substring(core, at, F.lit(4))), ":")
    ip6 = F.when(match == F.upper(match), F.upper(groups)).otherwise(groups)
    return F.when(kind.isin("card", "phone", "ssn"), _fill(match, core, "[0-9]")).when(kind == "iban", _fill(match, core, "[A-Z0-9]")).when(kind == "email", email).when(kind == "ip6", ip6).otherwise(core)


def _cased(word: Column, fresh: Column) -> Column:
    return F.when((word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1), F.upper(fresh)).otherwise(fresh)


def marked(docs: DataFrame, text_col: str, pre: str) -> DataFrame:
    """``docs`` with ``{pre}marked``: the text with every match between CUT signs and its type's fields (null if it has none), and ``{pre}surnames``."""
    text, names = F.col(text_col), F.col(f"{pre}names")
    titled = F.when(text.rlike(_TITLE_AHEAD), F.regexp_extract_all(text, F.lit(f"({_TITLED})"), F.lit(1)))
    out = docs.withColumn(f"{pre}names", F.array_distinct(F.transform(titled, _name)))
    words = lambda n: F.transform(F.split(n, _BETWEEN), lambda w: F.ltrim(w))
    each = F.flatten(F.transform(names, lambda n: F.concat(F.array(n), F.filter(words(n), lambda w: ~w.endswith(".")))))
    each = F.filter(F.array_distinct(each), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{Lu}\.$") | w.rlike(r"^\p{Lo}{2}"))
    each = F.array_sort(each, lambda x, y: F.length(y) - F.length(x))
    bare = F.concat(F.lit(f"{ANY}|((?=[\\p{{Lu}}\\p{{Lo}}]){_OPEN}(?:"), F.replace(F.array_join(each, "|"), F.lit("."), F.lit("\\.")), F.lit(f"){_SHUT})"))
    escaped = text
    for sign, stand_in in _ESCAPES:
        escaped = F.replace(escaped, F.lit(sign), F.lit(stand_in))
    escaped = F.when(text.rlike("[\ufdd0-\ufdd2]"), escaped).otherwise(text)
    fields = CUT + FIELD.join(f"${k}" for k in range(1, len(KINDS) + 1)) + CUT
    mark = F.when(F.size(each) > 0, F.regexp_replace(escaped, bare, F.lit(fields))).when(text.rlike(MAYBE) | (F.size(names) > 0), F.regexp_replace(escaped, F.lit(ANY + NO_BARE), F.lit(fields)))
    out = out.withColumn(f"{pre}marked", mark)
    surnames = F.transform(names, lambda n: F.get(words(n), _surname_at(words(n))))
    return out.withColumn(f"{pre}marked", F.when(F.instr(f"{pre}marked", CUT) > 0, F.col(f"{pre}marked"))).withColumn(f"{pre}surnames", surnames).drop(f"{pre}names")


def _pieces(mark: Column) -> Column:
    """Gap, match, gap, ... with the fields of each match."""
    return F.split(mark, CUT, -1)


def _unescaped(gap: Column) -> Column:
    out = gap
    for sign, stand_in in reversed(_ESCAPES):
        out = F.replace(out, F.lit(stand_in), F.lit(sign))
    return F.when(gap.contains("\ufdd2"), out).otherwise(gap)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_found``: the matches of each text in order (empty if none)."""
    pre = free_name([*docs.columns, "_found"], "_pii")
    matches = F.filter(_pieces(F.col(f"{pre}marked")), lambda x, i: i % 2 == 1)
    found = F.transform(matches, lambda m: F.replace(m, F.lit(FIELD)))
    out = marked(docs, text_col, pre).withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    return out.select(*docs.columns, "_found")


def mentions(rows: DataFrame, pre: str) -> DataFrame:
    """``row, pos, kind, match, title, part, joint, word, entity``: a row per match, for a name one per word, with the space before it."""
    fields = F.filter(_pieces(F.col(f"{pre}marked")), lambda x, i: i % 2 == 1)
    each = rows.select(F.col(f"{pre}row").alias("row"), F.col(f"{pre}surnames").alias("surnames"), F.posexplode(fields).alias("pos", "fields"))
    parts = F.split("fields", FIELD, -1)
    each = each.select("row", "surnames", "pos", F.replace("fields", F.lit(FIELD)).alias("match"), F.element_at(F.array(*map(F.lit, KINDS)), F.array_position(F.transform(parts, lambda p: p != ""), True).cast("int")).alias("kind"))
    named = F.col("kind").isin("name", "bare")
    plain = each.where(~named).select("row", "pos", "kind", "match", F.lit("").alias("title"), F.lit(0).alias("part"), F.lit("").alias("joint"), "match", canonical(F.col("kind"), F.col("match")).alias("entity"))
    plain = plain.toDF("row", "pos", "kind", "match", "title", "part", "joint", "word", "entity")

    words = F.split(F.when(F.col("kind") == "name", _name(F.col("match"))).otherwise(F.col("match")), _BETWEEN)
    people = each.where(named).select("row", "pos", "match", "surnames", F.when(F.col("kind") == "name", _title(F.col("match"))).otherwise("").alias("title"), F.when(F.col("kind") == "name", _gender(F.col("match"))).alias("gender"), F.size(words).alias("size"), _surname_at(words).alias("at"), F.posexplode(words).alias("part", "word"))
    people = people.withColumn("joint", F.when(F.col("word").startswith(" "), " ").otherwise("")).withColumn("word", F.ltrim("word"))
    last = F.when(F.col("size") > 1, F.col("part") == F.col("at")).otherwise((F.col("title") != "") | F.array_contains("surnames", F.col("word")))
    people = people.withColumn("kind", F.when(F.col("word").endswith("."), "initial").when(last, "surname").otherwise("given")).withColumn("low", F.lower("word"))
    gender = F.when(F.col("kind") == "given", F.col("gender"))
    votes = people.where("kind = 'given'").groupBy("low").agg(F.count(F.when(gender == "m", 1)).alias("men"), F.count(F.when(gender == "f", 1)).alias("women"))
    usual = F.when(F.col("men") > F.col("women"), "m").when(F.col("women") > F.col("men"), "f")
    listed = {g: F.array(*(F.lit(n.lower()) for (sex, _), names in GIVEN.items() if sex == g for n in names)) for g in "mf"}
    own = F.when(F.array_contains(listed["f"], F.col("low")), "f").when(F.array_contains(listed["m"], F.col("low")), "m").when(F.col("low").rlike("[aаяαη]$"), "f").otherwise("m")
    people = people.withColumn("here", F.max(gender).over(Window.partitionBy("row", "low"))).join(votes, "low", "left")
    entity = F.when(F.col("kind") == "surname", F.col("low")).when(F.col("kind") == "initial", F.col("word")).otherwise(F.concat_ws("|", "low", F.coalesce(gender, "here", usual, own)))
    return plain.unionByName(people.select("row", "pos", "kind", "match", "title", "part", "joint", "word", entity.alias("entity")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every detected entity replaced in ``text_col``.

    ``count_col``, if given, gets the number of replaced matches. Only rows with
    a match are joined; the others pass through untouched and unshuffled.
    """
    pre = free_name([*docs.columns, count_col or ""], "_pii")
    row, mark = f"{pre}row", F.col(f"{pre}marked")
    tagged = marked(docs, text_col, pre).withColumn(row, F.monotonically_increasing_id())
    tagged = materialize(tagged.withColumn(text_col, F.when(mark.isNull(), F.col(text_col))), "marked")
    loud = tagged.where(mark.isNotNull())
    seen = materialize(mentions(loud, pre), "mentions")
    surrogates = materialize(assign(seen.select("kind", "entity").distinct(), key), "assigned")

    fresh = seen.join(surrogates, ["kind", "entity"])
    word = F.when(F.col("kind").isin("surname", "given"), _cased(F.col("word"), F.col("core"))).otherwise(written(F.col("kind"), F.col("match"), F.col("core")))
    texts = fresh.select("row", "pos", "part", F.when((F.col("part") == 0) & (F.col("title") != ""), F.concat_ws(" ", "title", word)).otherwise(F.concat("joint", word)).alias("text"))
    lists = texts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "text"))).alias("all"))
    # The words of a name bring the space before them; matches are joined by a sign that no surrogate has.
    joined = F.split(F.array_join(F.transform("all", lambda x: F.concat(F.when(x["part"] == 0, CUT).otherwise(""), x["text"])), ""), CUT, -1)
    lists = lists.select(F.col("row").alias(row), F.slice(joined, F.lit(2), F.size(joined)).alias(f"{pre}fresh"))

    counted = lambda number: [] if count_col is None else [number.cast("long").alias(count_col)]
    quiet = tagged.where(mark.isNull()).select(*docs.columns, *counted(F.lit(0)))
    gaps = F.transform(F.filter(_pieces(mark), lambda x, i: i % 2 == 0), _unescaped)
    new = F.array_join(F.zip_with(gaps, F.concat(f"{pre}fresh", F.array(F.lit(""))), lambda gap, made: F.concat(gap, made)), "")
    loud = loud.join(lists, row).withColumn(text_col, new)
    return quiet.unionByName(loud.select(*docs.columns, *counted(F.size(f"{pre}fresh"))))
