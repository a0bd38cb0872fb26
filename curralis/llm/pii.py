"""Replaces personal data by surrogates, with DataFrame functions only.

Detected entities get a replacement of their own type: keyed (a stream of HMAC-SHA512 over type and normalised
entity), of the same format (digits stay digits, letters keep their case, separators and lengths stay; addresses stay
addresses, card numbers and IBANs valid, IBANs in their country), persons a name of the same gender and script. Mentions of the same
entity get the same surrogate.

Titles are no part of a person: a surname has one surrogate wherever it stands, alone or behind given names, and a given name
one for each gender and surnames, so that 'Mr John Smith', 'Mister John Smith' and 'Mr Smith' share a surname. Gender is that of the
title, behind Dr and Prof, or without a title, that of the same name elsewhere. A surname that stands behind a title is found in the rest of its text without
one too, with the given names that the text has behind titles. A phone number is its last nine digits, so that it is the same with and
without its country code; digits before them stay. Surrogates are checked against each other and against every detected entity over the
whole table; those that collide are drawn again with the next attempt number, until none collides; from attempt LONGER on
those of formats with few values (phones, secrets, social security numbers) get longer, so that there always is a free one.

Texts are written once with what was found in them; only texts with entities are shuffled. A frequent entity is one row of the surrogate table; its mentions' side of
the join may be split by adaptive execution.

Defined cases: a null text stays null, a text without entities stays as it is; rows that repeat doc_id and text
get equal results; a null doc_id is a value of its own; equal texts under several doc_ids are treated alike, as surrogates hang on
the entity alone; texts of any length are searched whole; numbers that fail the check digit are no cards, and those that fail
the check of an IBAN no IBANs: they stay; columns besides doc_id and text pass through; an empty table
stays empty. Columns named as this operator's own result (n_entities) are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curralis.llm.common import written

MALE = ("Mr", "Mister", "Señor", "Sr", "Don", "Monsieur", "Herr", "Г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Señora", "Sra", "Doña", "Señorita", "Madame", "Mademoiselle", "Frau", "Dra", "Doctora", "Profesora", "Г-жа", "Госпожа", "Κυρία")
#: Titles of either gender; these may follow another title.
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор")
TITLES = MALE + FEMALE + NEUTRAL
#: Written small within a name.
PARTICLES = ("de", "del", "la", "las", "los", "y", "e", "da", "das", "do", "dos", "di", "du", "des", "le", "van", "von", "vom", "zu", "zur", "der", "den", "ter", "ten", "af", "bin", "ibn", "al", "el")
#: Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Helena", "Irma", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Silvia", "Vera"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Λουκάς", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "f"): ("Άννα", "Δήμητρα", "Ειρήνη", "Ελένη", "Ζωή", "Μαρία", "Νίκη", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "han", "kel", "lin", "mar", "nor", "pol", "ren", "sal", "tor", "ver", "wen", "zel"),
    "cyrillic": ("бар", "вел", "гор", "дан", "зор", "кал", "лен", "мир", "нов", "пол", "рад", "сав", "тор", "фед", "хар", "яр"),
    "greek": ("βα", "γα", "δα", "ζα", "κα", "λα", "μα", "να", "πα", "ρα", "σα", "τα", "φα", "χα", "ψα", "θα"),
}
#: From this attempt on, formats whose values may all be taken get longer with each attempt.
LONGER = 30
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = rf"(?:(?:(?:{'|'.join(PARTICLES)}) |\p{{Lu}}\.? ){{0,4}}\p{{Lu}}[\p{{L}}'’-]+)"
#: First letters of the titles: most places fail at this one test.
_FIRST = "".join(sorted({t[0] for t in TITLES}))
#: Type and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "aws_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=[=: \"'])(?=[A-Za-z0-9+/_-]{8})(?<=(?i:password|passwd|secret|token|api_key)(?: ?[=:] ?)[\"']?)[A-Za-z0-9+/_-]{8,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # 16 digits in fours first, so that a number behind them is not taken for a part; other lengths need a right check digit
    "card": r"(?<![0-9])(?!00)(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+|00)[1-9](?:(?: ?\(|\)[ .-]?|[ .-])?[0-9]){6,14}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}"
    r"|0[1-9](?:[ .-]?[0-9]{2}){4}|[6-9][0-9]{1,2}[ .-][0-9]{2,3}(?:[ .-][0-9]{2}){2}|0[0-9]{1,4}[ /-][0-9]{5,8}|0[1-9][0-9]{8,9}|[2-9][0-9]{9})(?![0-9])",
    "person": rf"(?<![\p{{L}}])(?=[{_FIRST}])(?:{'|'.join(TITLES)})\.?(?: (?:{'|'.join(NEUTRAL)})\b\.?)* {_NAME}(?: {_NAME})*",
}
COMBINED = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of this have no entity. Each alternative fails at nearly every place by its first test.
HINT = rf"[0-9@=]|:(?<=(?i:password|passwd|secret|token|api_key) ?:)|(?<!\p{{L}})(?=[{_FIRST}])(?:{'|'.join(TITLES)})\.? (?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) )"


def _type(mention: Column, bare: Column) -> Column:
    """The mention's type; 'none' for numbers that fail their check. bare: the pattern of the document's names without titles, or null."""
    # a secret's pattern needs what stands before it
    out = F.when(F.rlike(mention, F.concat(F.lit("^(?:"), bare, F.lit(")$"))), "bare").otherwise("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    digits, plain = F.regexp_replace(mention, "[^0-9]", ""), F.regexp_replace(mention, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return _let(out, lambda k: F.when((k == "card") & (_luhn(digits) != 0), "none").when((k == "iban") & (_mod97(turned) != 1), "none").otherwise(k))


def _norm(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "ssn"), F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_extract(F.regexp_replace(mention, "[^0-9]", ""), "[0-9]{1,9}$", 0))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a stream of 256 hex digits, around its end again."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: lambdas compute what they enclose again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)


def _scrambled(norm: Column, stream: Column, skip: Column, hex_only: Column) -> Column:
    """norm with each letter and digit drawn anew within its class; the first skip characters stay."""

    def one(c, i):
        b = _byte(stream, i)
        letters = F.when(hex_only, F.lit(6)).otherwise(F.lit(26))
        drawn = F.when(c.between("0", "9"), F.pmod(b, F.lit(10)).cast("string")).when(c.between("a", "z"), F.chr(97 + F.pmod(b, letters))).when(c.between("A", "Z"), F.chr(65 + F.pmod(b, letters))).otherwise(c)
        return F.when(i < skip, c).otherwise(drawn)

    return F.array_join(F.transform(_chars(norm), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and capital letters, which count as 10 to 35."""
    return F.aggregate(_chars(text), F.lit(0), lambda r, c: F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _bare(word: Column) -> Column:
    """A name's word as it is compared: small, without a possessive ending."""
    return F.lower(F.regexp_replace(word, "['’]s$", ""))


def _pieces(kind: Column, norm: Column, mention: Column) -> Column:
    """(at, kind, norm, piece) of what is replaced apart: the words of a person, a whole mention of other kinds.

    The first of several names is a given name ('given', with gender and all other names), the others and single ones are
    surnames. Titles, particles and what is no entity have kind 'none'.
    """
    gender = lambda title: F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")
    plain = lambda w: F.regexp_replace(w, r"\.$", "")

    def words(all_):
        title = lambda w, i: (kind == "person") & ((i == 0) | (plain(w).isin(*NEUTRAL) & (i < 4)))
        marked = F.transform(all_, lambda w, i: F.struct(i.alias("at"), F.when(title(w, i) | w.isin(*PARTICLES), "none").when(w.rlike(r"^\p{Lu}\.?$"), "initial").otherwise("surname").alias("kind"), w.alias("piece")))
        names = F.filter(marked, lambda x: x["kind"] == "surname")

        def named(pair):
            first, bare = F.get(pair["names"], F.lit(0))["at"], F.array_join(F.transform(pair["names"], lambda x: _bare(x["piece"])), " ")
            given = lambda x: (x["at"] == first) & (F.size(pair["names"]) > 1)
            who = F.concat_ws("|", F.when(kind == "person", gender(plain(F.get(all_, F.lit(0))))).otherwise("n"), bare)
            return F.transform(pair["marked"], lambda x: F.struct(x["at"], F.when(given(x), "given").otherwise(x["kind"]).alias("kind"), F.when(given(x), who).when(x["kind"] == "surname", _bare(x["piece"])).otherwise(x["piece"]).alias("norm"), x["piece"]))

        return _let(F.struct(marked.alias("marked"), names.alias("names")), named)

    whole = F.array(F.struct(F.lit(0).alias("at"), kind.alias("kind"), norm.alias("norm"), mention.alias("piece")))
    return F.when(kind.isin("person", "bare"), _let(F.split(mention, " "), words)).otherwise(whole)


def _without_gender(kind: Column, norm: Column) -> Column:
    return F.when(kind == "given", F.substring(norm, F.lit(3), F.length(norm))).otherwise(norm)


def _name(kind: Column, norm: Column, stream: Column, attempt: Column) -> Column:
    """A surname, or a given name and the real surnames, which tell it apart; in the name's script, all small. Later attempts have longer names."""
    out = F.lit(None).cast("string")
    body = _without_gender(kind, norm)
    rest = F.substring(body, F.instr(body, " ") + 1, F.length(body))
    man = (F.substring(norm, F.lit(1), F.lit(1)) == "m") | ((F.substring(norm, F.lit(1), F.lit(1)) == "n") & (_byte(stream, F.lit(0)) % 2 == 0))
    for script, has in (("latin", None), ("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}")):
        parts = [_pick(SYLLABLES[script], _byte(stream, F.lit(10 + k))) for k in range(12)]
        surname = F.array_join(F.slice(F.array(*parts), F.lit(1), F.least(F.lit(12), 3 + attempt)), "")
        many = lambda g: F.array_join(F.slice(F.array(*[_pick(GIVEN[script, g], _byte(stream, F.lit(30 + k))) for k in range(6)]), F.lit(1), F.least(F.lit(6), 1 + attempt)), "-")  # noqa: B023, E731
        given = F.concat_ws(" ", F.lower(F.when(man, many("m")).otherwise(many("f"))), rest)
        name = F.when(kind == "given", given).otherwise(surname)
        out = name if has is None else F.when(body.rlike(has), name).otherwise(out)
    return out


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA512 in hex digits, of two nested hashes."""
    raw = key.encode()
    block = (raw if len(raw) <= 128 else hashlib.sha512(raw).digest()).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def _surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    # the norm stands behind all fields of known form, so that no two messages are alike
    draw = lambda k: _hmac(key, F.concat_ws("|", F.lit(k), kind, attempt.cast("string"), norm))
    return _let(F.concat(draw("0"), draw("1")), lambda stream: _drawn(kind, norm, attempt, stream))


def _drawn(kind: Column, norm: Column, attempt: Column, stream: Column) -> Column:
    ip = F.concat_ws(".", 1 + F.pmod(_byte(stream, F.lit(0)), F.lit(223)), *[_byte(stream, F.lit(k)) for k in (1, 2, 3)])
    at = F.instr(norm, "@")
    top = F.length(F.substring_index(norm, ".", -1))
    body = F.substring(norm, F.lit(1), F.length(norm) - top)
    email = F.concat(_scrambled(body, stream, F.lit(0), F.lit(False)), F.substring_index(norm, ".", -1))
    none = F.lit(False)
    iban = _scrambled(norm, stream, F.lit(4), none)
    land, account = F.substring(norm, 1, 2), F.substring(iban, F.lit(5), F.length(norm))
    iban = F.concat(land, F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0"), account)
    # a format that has no free value left gets longer
    longer = F.concat(norm, F.repeat(F.lit("0"), F.greatest(F.lit(0), attempt - LONGER)))
    card = _scrambled(norm, stream, F.lit(1), none)
    head = _let(card, lambda c: F.substring(c, F.lit(1), F.length(c) - 1))
    card = _let(head, lambda c: F.concat(c, F.pmod(_luhn(norm) - _let(F.concat(c, F.lit("0")), _luhn), F.lit(10)).cast("string")))
    hex_ = norm.rlike("^[0-9a-f]+$")
    return (
        F.when(kind == "email", F.when(at > 0, email))
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", _scrambled(longer, stream, F.lit(0), none))
        .when(kind == "iban", iban)
        .when(kind == "aws_key", _scrambled(norm, stream, F.lit(4), none))
        .when(kind.isin("surname", "given"), _name(kind, norm, stream, attempt))
        .otherwise(_scrambled(longer, stream, F.lit(0), hex_))
    )


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: its separators, its case."""
    chars, drawn = _chars(mention), _chars(surrogate)
    keeps = F.transform(chars, lambda c: F.when(c.rlike("[0-9A-Za-z]"), 1).otherwise(0))
    kept = F.aggregate(keeps, F.lit(0), lambda a, x: a + x)
    own = F.least(F.size(drawn), kept, F.when(kind == "phone", 9).otherwise(kept))  # what the surrogate has beyond is put behind
    skip = kept - own
    before = lambda i: F.aggregate(F.slice(keeps, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(keeps[i] == 1, F.coalesce(F.get(drawn, before(i) - skip), c)).otherwise(c)), "")
    spaced = F.concat(spaced, F.substring(surrogate, own + 1, F.length(surrogate)))
    cased = F.array_join(F.zip_with(chars, drawn, lambda c, d: F.when(c.between("A", "Z"), F.upper(d)).otherwise(d)), "")
    drawn_name = F.when(kind == "given", F.substring_index(surrogate, " ", 1)).otherwise(surrogate)
    large = F.when((mention == F.upper(mention)) & (F.length(mention) > 1), F.upper(drawn_name)).otherwise(F.array_join(F.transform(F.split(drawn_name, "-"), F.initcap), "-"))
    name = F.concat(large, F.regexp_extract(mention, "['’]s$", 0))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when(kind == "email", cased).when(kind.isin("surname", "given"), name).otherwise(surrogate)


def surrogate_table(entities: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities (kind, norm): no two alike, and none that is itself an entity."""
    entities = written(entities, "entities")
    drawn = written(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "surrogates")
    taken = entities.select("kind", _without_gender(F.col("kind"), F.col("norm")).alias("surrogate")).distinct().withColumn("real", F.lit(True))
    for _ in range(most):
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("first"), F.count("*").alias("n"))
        clash = first.join(taken, ["kind", "surrogate"], "left").filter("n > 1 or real").select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("first")).alias("first"))
        clash = written(clash, "clashes")
        if clash.isEmpty():
            return drawn.select("kind", "norm", "surrogate")
        marked = drawn.join(clash.withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left")
        again = F.col("hit").isNotNull() & ~F.col("norm").eqNullSafe(F.col("first"))
        next_ = marked.select("kind", "norm", "surrogate", again.alias("again"), (F.col("attempt") + again.cast("int")).alias("attempt"))
        drawn = written(next_.select("kind", "norm", "attempt", F.when(F.col("again"), _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")
    raise ValueError(f"surrogates still collide after {most} attempts: the format of some type has too few values")


def _bare_names(found: Column) -> Column:
    """From a text's mentions the pattern of its persons' surnames where they stand without a title, or null."""

    def parts(person):
        words = F.transform(F.filter(F.split(person, " "), lambda w, i: (i > 0) & ~w.isin(*PARTICLES) & ~F.regexp_replace(w, r"\.$", "").isin(*NEUTRAL) & ~w.rlike(r"^\p{Lu}\.?$")), lambda w: F.regexp_replace(w, "['’]s$", ""))
        return _let(words, lambda w: F.struct(F.when(F.size(w) > 1, F.slice(w, 1, 1)).otherwise(F.array().cast("array<string>")).alias("given"), F.when(F.size(w) > 1, F.slice(w, F.lit(2), F.size(w))).otherwise(w).alias("sur")))

    every = F.transform(F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['person']})$")), parts)
    alt = lambda names: F.array_join(F.array_sort(F.array_distinct(F.flatten(names))), "|")

    def pattern(people):
        given, sur = alt(F.transform(people, lambda x: x["given"])), alt(F.transform(people, lambda x: x["sur"]))
        before = F.when(given != "", F.concat(F.lit("(?:(?:"), given, F.lit(") )?"))).otherwise("")
        return F.when(sur != "", F.concat(F.lit(r"(?<![\p{L}'’-])"), before, F.lit("(?:"), sur, F.lit(r")(?:['’]s)?(?![\p{L}-])")))

    return _let(every, pattern)


def pseudonymise(docs: DataFrame, key: str, into: str = "n_entities") -> DataFrame:
    """docs with the text's entities replaced, and their number (into)."""
    docs = docs.drop(into)
    matches = F.regexp_extract_all("text", F.lit(COMBINED), F.lit(0))
    found = F.when(F.col("text").rlike(HINT), matches).otherwise(F.array().cast("array<string>"))
    # the row is wrapped, so that no column of its own can clash with the names used here; settled, so that the patterns run over each text once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    rows = written(rows.withColumn("bare", F.when(F.size("found") > 0, _bare_names(F.col("found")))), "texts")
    clean = rows.filter(F.size("found") == 0).select("row.*", F.lit(0).cast("long").alias(into))
    key_ = F.sha2(F.concat_ws("|", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "row.text"), 256)
    whole = F.when(F.col("bare").isNull(), COMBINED).otherwise(F.concat_ws("|", F.lit(COMBINED), "bare"))
    dirty = rows.filter(F.size("found") > 0).select("row", key_.alias("key"), F.col("row.text").alias("old"), "found", "bare", whole.alias("pattern"))
    again = F.when(F.col("bare").isNull(), F.col("found")).otherwise(F.regexp_extract_all("old", "pattern", F.lit(0)))
    mentions = dirty.select("key", "bare", F.posexplode(again).alias("pos", "mention")).distinct()
    kind = _type(F.col("mention"), F.coalesce("bare", F.lit("(?!)")))
    mentions = mentions.withColumn("kind", kind).withColumn("norm", _norm(F.col("kind"), F.col("mention")))
    pieces = written(mentions.select("key", "pos", F.explode(_pieces(F.col("kind"), F.col("norm"), F.col("mention"))).alias("x")).select("key", "pos", "x.*"), "mentions")
    # a given name behind Dr or Prof has the gender that the same name has elsewhere
    of = F.col("norm").substr(F.lit(3), F.length("norm"))
    sexes = pieces.filter("kind = 'given' and norm not like 'n|%'").groupBy(of.alias("who")).agg(F.max(F.substring("norm", 1, 1)).alias("sex"))
    open_ = pieces.filter("kind = 'given' and norm like 'n|%'").select("norm").distinct().join(sexes, of == F.col("who")).select(F.col("norm").alias("open"), F.concat_ws("|", "sex", "who").alias("known"))
    pieces = pieces.join(open_, (F.col("kind") == "given") & (F.col("norm") == F.col("open")), "left").withColumn("norm", F.coalesce("known", "norm")).drop("open", "known")
    table = surrogate_table(pieces.filter("kind not in ('none', 'initial')").select("kind", "norm").distinct(), key)
    letter = F.chr(65 + F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("initial"), "norm"), 256), 1, 4), 16, 10).cast("int"), F.lit(26)))
    initial = F.when((F.col("kind") == "initial") & F.col("piece").rlike("^[A-Z]"), F.concat(letter, F.substring("piece", 2, 1)))
    out = F.coalesce(initial, _rendered(F.col("kind"), F.col("piece"), F.col("surrogate")), "piece")
    placed = pieces.join(table, ["kind", "norm"], "left").select("key", "pos", (F.col("kind") != "none").alias("is"), F.struct("at", out.alias("out")).alias("at"))
    words = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["out"])
    whole = placed.groupBy("key", "pos").agg(F.array_join(words("at"), " ").alias("out"), F.max("is").alias("is")).select("key", "is", F.struct("pos", "out").alias("at"))
    by_doc = whole.groupBy("key").agg(words("at").alias("out"), F.count_if("is").alias("n"))
    parts = F.when(F.col("bare").isNull(), F.split("old", COMBINED, -1)).otherwise(F.split("old", F.col("pattern"), -1))
    text = F.array_join(F.zip_with(parts, F.concat("out", F.array(F.lit(""))), lambda p, o: F.concat(p, o)), "")
    done = dirty.join(by_doc, "key").select("row", text.alias("new"), "n")
    own = [F.col("new").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return clean.unionByName(done.select(*own, F.col("n").alias(into)))
