"""Keyed surrogates for personal data, in DataFrame and SQL functions only.

Entities are found by one pattern, run once over every text: e-mail addresses,
phone, card, social security and bank account numbers, IP and hardware
addresses, credentials, and person names (a title or a known first name with
capitalised words after it, initials and particles between them allowed; Han
names before an honorific or after a label).  Cards must pass the Luhn sum and
accounts their check digits.  A text that names a person is read once more for
later mentions of any word of its names.  A person without a title whose first
name isn't listed isn't found.

An entity has a canonical form (lower-case address, digits of a number, each
word of a name), so that spellings of one entity share a surrogate.  The
surrogate is a function of a secret key, the kind and the canonical form, and
keeps kind, length, character classes, check digits, script and, for names,
gender.  Its format is a row of places with the values each may take.

Collisions are checked over the whole corpus.  Where a format has values to
spare, a candidate that equals another entity's surrogate or any real entity of
its kind is drawn again until none does.  Where entities fill a quarter of it
or more, its free values and the entities are both put in keyed order and
matched one to one.  Where too few values are free, the entities' own values
are turned by one in keyed order (addresses get a number behind their name), so
distinct entities stay distinct always.  First names are moved along a keyed
cycle of the names of their gender and script, which can't collide.

Texts without an entity are passed through and never shuffled.  Of texts with
one, equal texts are handled once, by the hash of the text, and only the
entities travel, one row each; the hot ones meet their surrogate in a join that
is split where it is skewed.  The cost of a text grows with its length.

Defined results: null text stays null, with no entity; empty and long texts,
repeated rows and extra columns are kept as they are but for the replacements;
an empty table gives an empty result.  The output has the input's columns and
``n_entities``; ``added`` renames that column where the input has one.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stage

#: Stands for the secret; pass your own.
KEY = "ondelys"
#: Values of a format to an entity, below which values are matched and not drawn.
SPARE = 4

# First names by script and gender: any list works, these are common ones.
FIRST = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Kenneth George Kevin Brian Edward Peter Timothy Jeffrey Jacob Nicholas Stephen Jonathan Frank Henry Simon Philip Patrick Martin Alexander Benjamin Samuel Eric Klaus Jürgen Wolfgang Heinrich Friedrich Hans Stefan Andreas Jacques Guillaume Laurent Mathieu François Pierre Antoine Javier Miguel Alejandro Fernando Eduardo Carlos José Luis Antonio Juan Pedro Marco Giovanni Ahmed Mohammed",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Michelle Melissa Deborah Stephanie Rebecca Laura Helen Cynthia Kathleen Shirley Angela Anna Pamela Emma Nicole Katherine Samantha Christine Alice Julia Olivia Sophia Claire Charlotte Victoria Hannah Maria Ursula Sabine Brigitte Heike Gudrun Petra Monika Isabelle Chloé Mathilde Amélie Véronique Sophie Camille Lucía Carmen Guadalupe Beatriz Mercedes Elena Ana Isabel Francesca Giulia Fatima Aisha",
    ("cyrillic", "m"): "Александр Сергей Дмитрий Андрей Алексей Максим Иван Михаил Николай Владимир Павел Роман",
    ("cyrillic", "f"): "Елена Ольга Наталья Анна Мария Татьяна Ирина Светлана Екатерина Юлия Людмила Галина",
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señora Señor Sra Sr Signora Signor Господин Госпожа Κύριος Κυρία"
PARTICLES = "von van der den de del della di da du la le zu bin ibn al"
#: Common Han family names, characters of given names, and what follows a person's name.
FAMILIES, GIVEN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗", "明伟华平文军建国志强海宁安宇晨涛林辉永春"
HONORIFICS = "先生 女士 小姐 博士 教授 老师 医生 经理"
#: Syllables of made-up surnames.
SYLLABLES = {
    "latin": [c + v for c in "b d f g h k l m n p r s t v w z".split() for v in "aeiou"],
    "cyrillic": [c + v for c in "б в г д ж з к л м н п р с т".split() for v in "аеиоу"],
    "greek": [c + v for c in "β γ δ ζ κ λ μ ν π ρ σ τ φ χ".split() for v in "αειου"],
}
ENDINGS = {"latin": "n r ck ll nd rt sen ton man ley berg stein".split(), "cyrillic": "н к р ль ч ев ин ский".split(), "greek": "ς ης ος ας ίδης άκης".split()}



def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, the longest first, parted by their first letters."""
    parts = []
    for first, group in groupby(sorted(set(words)), key=lambda w: w[0]):
        rests = sorted((w[1:] for w in group), key=lambda w: (-len(w), w))
        parts.append(f"{first}(?:{'|'.join(rests)})")
    return "|".join(parts)


LETTER = r"[\p{L}\p{M}]"
#: A capitalised word; a possessive ending isn't part of it.
WORD_NAME = rf"(?=\p{{Lu}}(?:{LETTER}|['’]{LETTER}{{2}}))\p{{Lu}}{LETTER}*+(?:(?:['’](?!s(?!{LETTER}))|-){LETTER}++)*+"
GAP = r"[\s\u00A0]{1,3}"
BETWEEN = rf"{GAP}(?:\p{{Lu}}\.[\s\u00A0]{{0,3}}){{0,2}}(?:(?:{_any_of(PARTICLES.split())}){GAP}){{0,2}}"
_ALL_NAMES = [n for names in FIRST.values() for n in names.split()]
_NAMES = _any_of(_ALL_NAMES + [n.upper() for n in _ALL_NAMES])
_TITLES = _any_of(TITLES.split())
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> (characters it begins with, pattern).
KINDS = {
    "key": ("Agsx", r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_\-]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+)(?![A-Za-z0-9])"),
    "secret": ("tTpPsSaA", r"(?i:token|password|passwd|pwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/\-]{8,}+"),
    "email": (r"A-Za-z0-9._%+\-", r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"),
    "ip": ("0-9", rf"(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"),
    "mac": ("0-9A-Fa-f", r"(?<![:\-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    "ip6": ("0-9A-Fa-f", r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    "card": ("2-6", r"(?:(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6011|65\d{2})(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})|3[47]\d{2}(?:\d{11}| \d{6} \d{5}|-\d{6}-\d{5}))(?!\d)"),
    "ssn": ("0-8", r"(?<!-)(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"),
    "phone": ("0-9+(", r"(?<![+(_])(?:\+\d{1,3}[ \-.]?(?:\(\d{1,4}\)[ \-.]?)?\d{1,4}(?:[ \-.]\d{2,8}){1,5}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ \-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\d)"),
    "iban": ("A-Z", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "han": (FAMILIES, rf"[{FAMILIES}][\u4e00-\u9fff]{{1,2}}(?=\s?(?:{_any_of(HONORIFICS.split())}))|(?<=姓名[:：])[{FAMILIES}][\u4e00-\u9fff]{{1,2}}"),
    "name": ("A-ZÀ-ÞΆ-ΫЀ-Я", rf"(?:(?:{_TITLES})\.?|(?:{_NAMES})(?!{LETTER})){BETWEEN}{WORD_NAME}(?:{BETWEEN}{WORD_NAME}){{0,2}}"),
}
BEFORE = r"(?<![0-9A-Za-zÀ-ɏͰ-ӿ])"
#: No entity begins inside a run of letters and digits: one look back decides
#: most places of a text, one look ahead most alternatives at the others.
ALTERNATIVES = "|".join(f"(?=[{first}])(?:{rest})" for first, rest in KINDS.values())
ENTITY = f"{BEFORE}(?:{ALTERNATIVES})"
SECRET_PREFIX = r"^[^=:]*[=:]\s*[\"']?"


def _first_names(key: str) -> dict[str, str]:
    """First name (lower case) to the next on the keyed cycle of its gender and script."""
    out = {}
    for (script, gender), names in FIRST.items():
        cycle = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|{script}{gender}|{n}".encode()).digest())
        out.update({a.lower(): b for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True)})
    return out


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _kind(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k not in ("name", "han")]):
        out = F.when(entity.rlike(f"^(?:{KINDS[kind][1]})$"), kind).otherwise(out)
    return F.when(entity.rlike(r"^[\u4e00-\u9fff]{2,3}$"), "han").otherwise(out)


_DOUBLED = "(CASE WHEN (length({d}) - i) % 2 = 0 THEN int(substring({d}, i, 1)) * 2 - if(int(substring({d}, i, 1)) > 4, 9, 0) ELSE int(substring({d}, i, 1)) END)"


def _luhn(payload: str) -> str:
    """SQL for the check digit of a digit string."""
    return f"cast((10 - aggregate(sequence(1, length({payload})), 0, (s, i) -> s + {_DOUBLED.format(d=payload)}) % 10) % 10 AS string)"


def _mod97(iban: str) -> str:
    """SQL for an account number's remainder, check digits moved behind."""
    turned = f"concat(substring({iban}, 5), left({iban}, 4))"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN (s * 10 + int(c)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END"
    return f"aggregate(regexp_extract_all({turned}, '.', 0), 0, (s, c) -> {value})"


def _canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (
        F.when(kind == "phone", national)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(entity, SECRET_PREFIX, ""))
        .when(kind.isin("key", "name", "han"), entity)
        .otherwise(F.lower(entity))
    )


def _valid(kind: str, canon: str) -> str:
    card = f"{_luhn(f'left({canon}, length({canon}) - 1)')} = right({canon}, 1)"
    return f"CASE {kind} WHEN 'card' THEN {card} WHEN 'iban' THEN {_mod97(canon)} = 1 WHEN 'phone' THEN length({canon}) BETWEEN 7 AND 15 ELSE true END"


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _place(values: str, n: int | str = 0, low: int = 0) -> str:
    """SQL of one place of a format: one of the characters of ``values``, or with none of them ``low`` and ``n - 1`` numbers after it."""
    return f"named_struct('a', '{values}', 'lo', {low}, 'n', {n or len(values)})"


def _formats(atoms: DataFrame, key: str) -> DataFrame:
    """(kind, canon) rows with ``slots``, the places of their format, ``capacity``, and ``format``, which names it."""
    same, digit = "named_struct('a', c, 'lo', 0, 'n', 1)", _place(DIGITS)
    chars = "regexp_extract_all(canon, '(?s).', 0)"

    def each(cases: str, of: str = chars) -> str:
        return f"transform({of}, (c, i) -> CASE {cases} END)"

    classes = f"WHEN c BETWEEN '0' AND '9' THEN {digit} WHEN c BETWEEN 'a' AND 'z' THEN {_place(LOWER)} WHEN c BETWEEN 'A' AND 'Z' THEN {_place(UPPER)} ELSE {same}"
    hexes = f"WHEN c BETWEEN '0' AND '9' THEN {digit} WHEN c BETWEEN 'a' AND 'f' THEN {_place('abcdef')} WHEN c BETWEEN 'A' AND 'F' THEN {_place('ABCDEF')} ELSE {same}"
    base32 = f"WHEN i < 4 THEN {same} WHEN c BETWEEN '2' AND '7' THEN {_place('234567')} WHEN c BETWEEN '0' AND '9' THEN {digit} ELSE {_place(UPPER)}"
    phone = f"WHEN length(canon) = 10 AND i IN (0, 3) THEN {_place('23456789')} WHEN length(canon) > 10 AND i < 2 OR length(canon) < 10 AND i < 1 THEN {same} ELSE {digit}"
    ssn = f"WHEN i = 0 THEN {_place('12345')} WHEN i IN (3, 5) THEN {_place(DIGITS[1:])} ELSE {digit}"
    card = f"WHEN i < if(canon LIKE '6011%', 4, 2) THEN {same} ELSE {digit}"
    iban = f"WHEN i < 2 THEN {same} WHEN i < 4 THEN {_place('0')} {classes}"
    octet, last = _place("", 256), _place("", 254, 1)
    dot = _place(".")
    ip = (
        f"CASE WHEN canon LIKE '192.168.%' THEN array({_place('192.168.', 1)}, {octet}, {dot}, {last})"
        f" WHEN canon LIKE '10.%' OR canon LIKE '127.%' THEN array(named_struct('a', concat(substring_index(canon, '.', 1), '.'), 'lo', 0, 'n', 1), {octet}, {dot}, {octet}, {dot}, {last})"
        f" WHEN canon RLIKE '^172[.](1[6-9]|2[0-9]|3[01])[.]' THEN array({_place('172.', 1)}, {_place('', 16, 16)}, {dot}, {octet}, {dot}, {last})"
        f" ELSE array({_place('', 89, 11)}, {dot}, {octet}, {dot}, {octet}, {dot}, {last}) END"
    )
    han = f"WHEN i = 0 THEN {_place(FAMILIES)} ELSE {_place(GIVEN)}"
    # The domain's first label depends on the domain alone; the rest is a reserved name.
    domain = "substring_index(canon, '@', -1)"
    label = f"substring_index({domain}, '.', 1)"
    draws = f"flatten(transform(sequence(0, length({label}) div 32), b -> regexp_extract_all(sha2(concat(secret, '|d|', {domain}, '|', b), 512), '....', 0)))"
    new_label = f"array_join(zip_with(regexp_extract_all({label}, '(?s).', 0), slice({draws}, 1, length({label})), (c, d) -> CASE WHEN c BETWEEN '0' AND '9' THEN substring('{DIGITS}', int(conv(d, 16, 10)) % 10 + 1, 1) WHEN c BETWEEN 'a' AND 'z' THEN substring('{LOWER}', int(conv(d, 16, 10)) % 26 + 1, 1) ELSE c END), '')"
    top = f"element_at(array('com', 'net', 'org'), int(conv(left(sha2(concat(secret, '|t|', {domain}), 256), 2), 16, 10)) % 3 + 1)"
    slots = (
        "CASE kind"
        f" WHEN 'email' THEN {each(classes, chars.replace('canon', "left(canon, instr(canon, '@') - 1)"))}"
        f" WHEN 'ip' THEN {ip}"
        f" WHEN 'card' THEN {each(card, chars.replace('canon', 'left(canon, length(canon) - 1)'))}"
        f" WHEN 'ssn' THEN {each(ssn)}"
        f" WHEN 'phone' THEN {each(phone)}"
        f" WHEN 'iban' THEN {each(iban)}"
        f" WHEN 'han' THEN {each(han)}"
        f" WHEN 'key' THEN if(canon LIKE 'AKIA%', {each(base32)}, {each('WHEN i < 4 THEN ' + same + ' ' + classes)})"
        " WHEN 'last' THEN cast(array() AS array<struct<a: string, lo: int, n: int>>)"
        f" ELSE if(kind IN ('mac', 'ip6') OR canon RLIKE '^[0-9a-f]+$|^[0-9A-F]+$', {each(hexes)}, {each(classes)}) END"
    )
    table = atoms.withColumn("secret", F.lit(key)).withColumn("slots", F.expr(slots))
    table = table.withColumn("domain", F.expr(f"CASE WHEN kind = 'email' THEN concat({new_label}, '.example.', {top}) ELSE '' END")).drop("secret")
    table = table.withColumn("capacity", F.expr("CASE WHEN kind = 'last' THEN double('infinity') ELSE aggregate(slots, 1D, (s, x) -> s * x.n) END"))
    return table.withColumn("format", F.md5(F.concat_ws("|", "kind", "domain", F.to_json("slots"))))


#: A place's value for a number below its n.
_VALUE = "CASE WHEN x.n = 1 THEN if(x.a = '', string(x.lo), x.a) WHEN x.a = '' THEN string(x.lo + v) ELSE substring(x.a, v + 1, 1) END"


def _finished(table: DataFrame) -> DataFrame:
    """(kind, canon, format, surrogate): check digits and domain added to ``payload``."""
    return table.withColumn(
        "surrogate",
        F.expr(
            f"CASE kind WHEN 'card' THEN concat(payload, {_luhn('payload')})"
            f" WHEN 'iban' THEN concat(left(payload, 2), lpad(string(98 - {_mod97('payload')}), 2, '0'), substring(payload, 5))"
            " WHEN 'email' THEN concat(payload, '@', domain) ELSE payload END"
        ),
    )


def _drawn(table: DataFrame, key: str, attempt: int) -> DataFrame:
    """Surrogate candidates of a round of drawing."""
    table = table.withColumn("secret", F.lit(key)).withColumn("attempt", F.lit(attempt))
    draws = "flatten(transform(sequence(0, size(slots) div 32), b -> regexp_extract_all(sha2(concat(secret, '|s|', kind, '|', canon_hash, '|', attempt, '|', b), 512), '....', 0)))"
    payload = f"array_join(transform(zip_with(slots, slice({draws}, 1, size(slots)), (x, d) -> named_struct('a', x.a, 'lo', x.lo, 'n', x.n, 'v', int(conv(d, 16, 10)) % x.n)), x -> {_VALUE.replace('v)', 'x.v)').replace('v + 1', 'x.v + 1')}), '')"
    table = table.withColumn("canon_hash", F.sha2("canon", 256)).withColumn("payload", F.expr(payload))
    # Made-up surnames: more syllables with every round, so the domain never ends.
    script = F.when(F.col("canon").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("canon").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    table = table.withColumn("script", script)
    last = F.lit(None).cast("string")
    for name, syllables in SYLLABLES.items():
        table = table.withColumn("syllables", F.array(*map(F.lit, syllables))).withColumn("endings", F.array(*map(F.lit, ENDINGS[name])))
        body = f"array_join(transform(sequence(1, 3 + attempt), i -> element_at(syllables, int(conv(substring(sha2(concat(secret, '|n|', canon, '|', attempt, '|', i), 256), 1, 6), 16, 10)) % {len(syllables)} + 1)), '')"
        end = f"element_at(endings, int(conv(substring(sha2(concat(secret, '|e|', canon, '|', attempt), 256), 1, 4), 16, 10)) % {len(ENDINGS[name])} + 1)"
        ending = f"CASE WHEN canon RLIKE '(ова|ева)$' THEN right(canon, 3) WHEN canon RLIKE '(ов|ев)$' THEN right(canon, 2) WHEN canon RLIKE 'ova$' THEN 'ova' ELSE {end} END"
        table = table.withColumn(f"last_{name}", F.expr(f"concat({body}, {ending})")).drop("syllables", "endings")
        last = F.when(F.col("script") == name, F.col(f"last_{name}")).otherwise(last)
    table = table.withColumn("payload", F.when(F.col("kind") == "last", last).otherwise(F.col("payload")))
    return _finished(table).select("kind", "canon", "surrogate")


def _ranked(table: DataFrame, by: Column) -> DataFrame:
    """``table`` with ``nth``, the place of each row in its format by the keyed order of ``by``, from 0.

    Rows are counted by ranges of the hash first, so a format of any size is
    dealt over tasks.
    """
    table = stage(table.withColumn("order", F.sha2(by, 256)).withColumn("range", F.substring("order", 1, 3)), "pii-order")
    counts = table.groupBy(F.col("format").alias("f"), F.col("range").alias("r")).agg(F.count(F.lit(1)).alias("rows"))
    # At most 4,096 ranges to a format.
    earlier = Window.partitionBy("f").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("f", "r", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("format", "range").orderBy("order")) - 1
    joined = table.withColumn("inside", inside).join(counts, (F.col("format") == F.col("f")) & (F.col("range") == F.col("r")))
    return joined.withColumn("nth", F.col("before") + F.col("inside")).drop("order", "range", "f", "r", "before", "inside")


def _matched(table: DataFrame, real: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Surrogates for the entities of crowded formats: free values matched one to one in keyed order."""
    formats = table.groupBy("format").agg(F.first("kind").alias("kind"), F.first("domain").alias("domain"), F.first("slots").alias("slots"), F.first("capacity").alias("capacity"), F.count(F.lit(1)).alias("n"))
    chunk = 1 << 16
    every = formats.withColumn("hi", F.explode(F.expr(f"sequence(0L, (bigint(capacity) - 1) div {chunk})"))).repartition("format", "hi")
    every = every.withColumn("at", F.explode(F.expr(f"sequence(hi * {chunk}, least(bigint(capacity), (hi + 1) * {chunk}) - 1)")))
    # The number's digits in the mixed radix of the places.
    step = "struct(s.left div x.n AS left, concat(s.out, {}) AS out)".format(_VALUE.replace("v)", "int(s.left % x.n))").replace("v + 1", "int(s.left % x.n) + 1"))
    every = every.withColumn("payload", F.expr(f"aggregate(slots, struct(at AS left, '' AS out), (s, x) -> {step}, s -> s.out)"))
    free = _finished(every).select("format", "kind", "surrogate").join(real, ["kind", "surrogate"], "left_anti")
    if done is not None:
        free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
    free = _ranked(free, F.concat(F.lit(f"{key}|v|"), "format", F.lit("|"), "surrogate"))
    asking = _ranked(table, F.concat(F.lit(f"{key}|c|"), "format", F.lit("|"), "canon"))
    asking = stage(asking, "pii-asking")
    got = asking.join(free.select("format", "nth", "surrogate"), ["format", "nth"], "left")
    # Too few values: the entities' own, turned by one; addresses get a number.
    short = stage(got, "pii-matched")
    lacking = short.where("surrogate IS NULL").select("format").distinct()
    whole = short.join(lacking, "format", "left_anti").select("kind", "canon", "surrogate")
    turned = asking.join(lacking, "format").join(formats.select("format", "n"), "format")
    after = asking.select("format", F.col("nth").alias("next"), F.col("canon").alias("other"))
    turned = turned.withColumn("next", (F.col("nth") + 1) % F.col("n")).join(after, ["format", "next"])
    turned = turned.select("kind", "canon", F.when(F.col("kind") == "email", F.expr("concat('x', nth, '@', domain)")).otherwise(F.col("other")).alias("surrogate"))
    return whole.unionByName(turned)


def surrogates(atoms: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) without collisions, for distinct (kind, canon) rows."""
    real = atoms.select(F.col("kind"), F.col("canon").alias("surrogate"))
    table = stage(_formats(atoms, key), "pii-formats")
    counts = table.groupBy(F.col("format").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.first("capacity").alias("room"))
    crowded = stage(counts.where(F.col("room") <= SPARE * F.col("n")).select("f"), "pii-crowded")
    done, pending, attempt = None, table.join(crowded, F.col("format") == F.col("f"), "left_anti"), 0
    # At least half of the values are free, so every round leaves half of the entities at most.
    while not pending.isEmpty():
        drawn = stage(_drawn(pending, key, attempt), "drawn")
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        won = stage(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "surrogates")
        done = won if done is None else stage(done.unionByName(won), "surrogates")
        pending = stage(pending.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pending")
        attempt += 1
    if not crowded.isEmpty():
        matched = stage(_matched(table.join(crowded, F.col("format") == F.col("f"), "left_semi"), real, done, key), "surrogates")
        done = matched if done is None else done.unionByName(matched)
    return real.select("kind", F.lit("").alias("canon"), "surrogate").where("false") if done is None else done


def _fill(entity: str, replacement: str, pattern: str, skip: str) -> str:
    """SQL: the characters of ``entity`` that fit ``pattern``, after ``skip`` of them, replaced in turn."""
    step = f"if(c RLIKE '{pattern}', named_struct('out', concat(s.out, if(s.k < {skip}, c, substring({replacement}, s.k - {skip} + 1, 1))), 'k', s.k + 1), named_struct('out', concat(s.out, c), 'k', s.k))"
    return f"aggregate(split({entity}, ''), named_struct('out', '', 'k', 0), (s, c) -> {step}, s -> s.out)"


def _rewritten(found: DataFrame, surrogate: DataFrame, key: str) -> DataFrame:
    """(of, new): the replacement of every entity of a text, in order; ``found``: (of, pos, part, kind, canon, e, made)."""
    known = surrogate.select(F.col("kind").alias("s_kind"), F.col("canon").alias("s_canon"), "surrogate")
    met = found.join(known, (F.col("kind") == F.col("s_kind")) & (F.col("canon") == F.col("s_canon")), "left")
    skip = "(length(regexp_replace(e, '[^0-9]', '')) - length(canon))"
    new = (
        "CASE WHEN made IS NOT NULL THEN made WHEN surrogate IS NULL THEN e"
        " WHEN kind = 'last' THEN if(e = upper(e), upper(surrogate), initcap(surrogate))"
        f" WHEN kind IN ('card', 'ssn', 'phone') THEN {_fill('e', 'surrogate', '[0-9]', skip)}"
        f" WHEN kind = 'iban' THEN {_fill('e', 'surrogate', '[A-Z0-9]', '0')}"
        " WHEN kind = 'secret' THEN concat(left(e, length(e) - length(canon)), surrogate)"
        " WHEN e = upper(e) AND kind IN ('email', 'mac', 'ip6') THEN upper(surrogate) ELSE surrogate END"
    )
    parts = met.select("of", "pos", F.struct("part", F.expr(new).alias("new")).alias("p")).groupBy("of", "pos").agg(F.sort_array(F.collect_list("p")).alias("p"))
    entities = parts.select("of", F.struct("pos", F.array_join("p.new", "").alias("new")).alias("p"))
    return entities.groupBy("of").agg(F.sort_array(F.collect_list("p")).alias("p")).select("of", F.col("p.new").alias("new"))


def _parts(texts: DataFrame, key: str) -> DataFrame:
    """One row for each entity of each text, of a name one for each word and what stands between: (of, pos, part, kind, canon, e, made)."""
    first = _literal_map(_first_names(key))
    each = texts.select("of", F.posexplode("found").alias("pos", "e")).withColumn("kind", _kind(F.col("e")))
    named = F.col("kind") == "name"
    pieces = F.regexp_extract_all("e", F.lit(r"[\p{L}\p{M}'’\-]+|[^\p{L}\p{M}'’\-]+"), F.lit(0))
    each = each.select("of", "pos", "kind", F.posexplode(F.when(named, pieces).otherwise(F.array("e"))).alias("part", "e"))
    canon = _canonical(F.col("kind"), F.col("e"))
    known = first[F.lower("e")]
    turned = "".join(sorted(UPPER, key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest()))
    made = (
        F.when(~F.col("e").rlike(r"^\p{L}") | F.col("e").rlike(rf"^(?:{_TITLES})$|^(?:{_any_of(PARTICLES.split())})$"), F.col("e"))
        .when(F.length("e") == 1, F.translate("e", UPPER, turned))
        .when(known.isNotNull(), F.when((F.col("e") == F.upper("e")), F.upper(known)).otherwise(known))
    )
    return each.select("of", "pos", "part", F.when(named, "last").otherwise(F.col("kind")).alias("kind"), F.when(named, F.lower("e")).otherwise(canon).alias("canon"), "e", F.when(named, made).alias("made"))


def replace_entities(docs: DataFrame, key: str = KEY, added: str = "n_entities") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and their number in ``added``."""
    columns = docs.columns
    # Working columns get names that no column of the input has.
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    found = F.coalesce(F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0)), F.expr("cast(array() AS array<string>)"))
    every = stage(docs.select(row, found.alias("found")), "pii-texts")
    clean = every.where("size(found) = 0").select(*[F.col("row").getField(c).alias(c) for c in columns], F.lit(0).alias(added))
    touched = every.where("size(found) > 0").select("row", F.sha2("row.text", 256).alias("key_of"), "found")
    # A text with names is read once more, for later mentions of any word of them.
    names = F.filter("found", lambda e: _kind(e) == "name")
    words = F.flatten(F.transform(names, lambda e: F.regexp_extract_all(e, F.lit(WORD_NAME), F.lit(0))))
    words = F.filter(words, lambda w: ~w.rlike(rf"^(?:{_TITLES})$"))
    words = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    longest = F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), lambda x: x["w"])
    pattern = F.concat(F.lit(f"{BEFORE}(?:{ALTERNATIVES}|(?:"), F.array_join(longest, "|"), F.lit(rf")(?![\p{{L}}\p{{M}}\p{{N}}]))"))
    touched = touched.withColumn("pattern", F.when(F.size(names) > 0, pattern))
    again = F.regexp_extract_all(F.col("row.text"), F.col("pattern"), F.lit(0))
    touched = stage(touched.withColumn("found", F.coalesce(again, F.col("found"))), "pii-touched")

    texts = touched.groupBy(F.col("key_of").alias("of")).agg(F.first("found").alias("found"))
    parts = stage(_parts(texts, key), "pii-parts")
    atoms = parts.where("made IS NULL").select("kind", "canon").distinct()
    atoms = stage(atoms.where(F.expr(_valid("kind", "canon"))), "pii-entities")
    new = _rewritten(parts, surrogates(atoms, key), key)
    touched = touched.join(new, F.col("key_of") == F.col("of"), "left")
    between = F.split(F.col("row.text"), F.coalesce("pattern", F.lit(ENTITY)), -1)
    text = F.array_join(F.flatten(F.zip_with(between, F.col("new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    replaced = F.expr("size(filter(zip_with(found, new, (a, b) -> a <> b), x -> x))")
    out = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    return clean.unionByName(touched.select(*out, replaced.alias(added)))
