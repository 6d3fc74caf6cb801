"""Keyed surrogates for personal data, by DataFrame operations only.

Detected entities (e-mail and IP addresses, phone, account and identity numbers, IBANs and
names behind a title) are reduced to a canonical form, so that spellings of one entity meet.
Each canonical entity gets one replacement from a keyed hash: of the same length, digit for
digit and letter for letter of the same script; check digits, octet ranges, first account
digits and country codes stay valid; given names come from lists of the same gender and
script.  The replacement is then written in the format and case of each occurrence.

A name is a surname and perhaps a given name, each an entity of its own: "Mr John Smith",
"Mr Smith" and, in a text that has either, a bare "John Smith" or "Smith" keep one surname.

Distinct entities keep distinct replacements, and no replacement is an entity of the corpus:
a replacement that collides is drawn again with the next attempt, the smallest entity
keeping its draw.  From attempt ``WIDEN`` on each draw is longer than the one before, so a
form that is full never ends the search.  Only entities are shuffled, texts with entities
are joined once.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinfold.llm.spans import matches, rebuild
from pinfold.runtime import broadcast_checked, discard, materialise

#: Draws of an entity's own form before the form is widened.
WIDEN = 3
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
IPV6 = r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ACCOUNT = r"(?<![\d])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"
PHONE = r"(?<![\p{L}\d])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\d])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
#: Titles by gender and script; given names and syllables of surnames to match. Fixed values.
TITLES = {
    ("m", "latin"): ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Lord"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Lady"],
    ("m", "cyrillic"): ["Господин", "господин"],
    ("f", "cyrillic"): ["Госпожа", "госпожа"],
    ("n", "latin"): ["Dr", "Prof", "Doctor", "Professor"],
}
GIVEN = {
    ("m", "latin"): ["Alan", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("n", "latin"): ["Alex", "Ariel", "Chris", "Dana", "Jamie", "Jordan", "Kai", "Kim", "Luca", "Morgan", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yuri"],
    ("n", "cyrillic"): ["Валя", "Женя", "Паша", "Саша"],
}
SYLLABLES = {
    "latin": ["ba", "der", "fel", "gan", "hol", "ker", "lin", "mar", "nor", "pel", "ros", "san", "tor", "vel", "win", "zan"],
    "cyrillic": ["ба", "вен", "гор", "дан", "жел", "зар", "кол", "лин", "мар", "нов", "пет", "рос", "сан", "тов", "фил", "шар"],
}
TITLE = r"(?:(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\.? ){1,3}"
WORD = r"\p{Lu}[\p{L}'-]+"
NAME = rf"(?<!\p{{L}}){TITLE}{WORD}(?: {WORD})?"
KINDS = (("email", EMAIL), ("iban", IBAN), ("ip", IPV4), ("ipv6", IPV6), ("ssn", SSN), ("account", ACCOUNT), ("phone", PHONE), ("name", NAME))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What every match holds: a digit, an at sign, colons or a title.  Most texts hold none of them.
HINT = r"[0-9@]|\p{Nd}|::"
#: First letter and number of letters of the scripts that letters are drawn from, beside Latin.
SCRIPTS = (
    ("Cyrillic", 0x430, 32), ("Greek", 0x3B1, 17), ("Hebrew", 0x5D0, 10), ("Arabic", 0x62A, 17), ("Devanagari", 0x915, 37), ("Thai", 0xE01, 46), ("Hangul", 0xAC00, 256), ("Hiragana", 0x304B, 60),
    ("Katakana", 0x30AB, 60), ("Han", 0x4E00, 256), ("Armenian", 0x561, 38), ("Georgian", 0x10D0, 33),
)
_LATIN = "abcdefghijklmnopqrstuvwxyz"


def _kind(match: Column) -> Column:
    """Kind of a match: the first pattern that covers all of it."""
    out = F.when(match.rlike(f"^(?:{KINDS[0][1]})$"), KINDS[0][0])
    for name, pattern in KINDS[1:-1]:
        out = out.when(match.rlike(f"^(?:{pattern})$"), name)
    return out.otherwise("name")


def _canonical(kind: Column, match: Column) -> Column:
    """The same for all spellings of one entity; of a name, its surname."""
    bare = F.lower(F.regexp_replace(match, r"[^\p{L}\p{N}]", ""))
    surname = F.lower(F.regexp_replace(F.regexp_extract(match, r"(\S+)$", 1), r"'s$", ""))
    return F.when(kind == "ip", match).when(kind.isin("email", "ipv6"), F.lower(match)).when(kind == "name", surname).otherwise(bare)


def _given(kind: Column, match: Column) -> Column:
    """The given name of a name that has one, in lower case, else null."""
    rest = F.regexp_replace(match, f"^{TITLE}", "")
    return F.when((kind == "name") & rest.contains(" "), F.lower(F.regexp_extract(rest, r"^(\S+) ", 1)))


def _gender(match: Column) -> Column:
    """What the titles of a name tell: m, f, or n."""
    out, first = None, F.regexp_extract(match, r"^(\p{L}+)", 1)
    for (gender, _), titles in TITLES.items():
        out = F.when(first.isin(titles), gender) if out is None else out.when(first.isin(titles), gender)
    return out.otherwise("n")


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _draws(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """64 keyed numbers of 16 bits."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string"))
    digest = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n % len(values) + 1)


def _letter(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _draw_chars(canonical: Column, draws: Column, keep: Column | None = None) -> Column:
    """Digit for digit and letter for letter, script kept; ``keep`` tells fixed places."""

    def one(c: Column, i: Column) -> Column:
        n = F.element_at(draws, i % 64 + 1)
        drawn = F.when(c.rlike(r"\p{Nd}"), (n % 10).cast("string")).when(c.rlike(r"\p{IsLatin}"), _letter(_LATIN, n))
        for script, first, size in SCRIPTS:
            drawn = drawn.when(c.rlike(rf"\p{{Is{script}}}"), _letter("".join(chr(first + k) for k in range(size)), n))
        drawn = drawn.when(c.rlike(r"\p{L}"), _letter(_LATIN, n)).otherwise(c)
        return drawn if keep is None else F.when(keep(i, c), c).otherwise(drawn)

    return F.array_join(F.transform(_chars(canonical), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits; the last one is not doubled."""
    n = F.length(digits)
    terms = F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _account(canonical: Column, draws: Column) -> Column:
    """Keeps the first digit, and the check digit valid where it was."""
    drawn = _draw_chars(canonical, draws, lambda i, c: i == 0)
    head = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
    return F.when(_luhn_sum(canonical) % 10 == 0, F.concat(head, check.cast("string"))).otherwise(drawn)


def _iban(canonical: Column, draws: Column) -> Column:
    """Keeps the country; the check digits are those of the drawn rest."""
    drawn = _draw_chars(canonical, draws, lambda i, c: i < 2)
    country, rest = F.substring(drawn, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    value = lambda c: F.ascii(F.upper(c)) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    left = F.aggregate(_chars(F.concat(rest, country, F.lit("00"))), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _ip(canonical: Column, draws: Column, attempt: int) -> Column:
    """Each part keeps its number of digits and stays below 256; later draws are free, and
    in the end beyond what addresses are, as are entities then."""

    def part(p: Column, i: Column) -> Column:
        n = F.element_at(draws, i + 1)
        if attempt >= WIDEN:
            return (n % (256 if attempt < 4 * WIDEN else 1000)).cast("string")
        return F.when(F.length(p) == 1, n % 10).when(F.length(p) == 2, 10 + n % 90).otherwise(100 + n % 156).cast("string")

    return F.array_join(F.transform(F.split(canonical, r"\."), part), ".")


def _syllables(script: str, draws: Column, first: int, n: int) -> Column:
    return F.concat(*[_pick(SYLLABLES[script], F.element_at(draws, k)) for k in range(first, first + n)])


def _surname(canonical: Column, draws: Column, extra: int) -> Column:
    """Syllables of the same script; letters of it where there are no syllables."""
    n = min(3 + extra, 40)
    out = F.when(canonical.rlike(r"^[\p{IsLatin}'-]+$"), _syllables("latin", draws, 2, n)).when(canonical.rlike(r"^[\p{IsCyrillic}'-]+$"), _syllables("cyrillic", draws, 2, n))
    return out.otherwise(_draw_chars(F.concat(canonical, F.repeat(F.substring(canonical, 1, 1), F.lit(extra))), draws))


def _given_name(canonical: Column, gender: Column, draws: Column, attempt: int) -> Column:
    """A name of the list for the gender and script, then a double one, then a longer one."""
    out = None
    for (which, script), names in GIVEN.items():
        low = [g.lower() for g in names]
        name = _pick(low, F.element_at(draws, 1))
        if attempt >= WIDEN:
            name = F.concat(name, F.lit("-"), _pick(low, F.element_at(draws, 2)), *([_syllables(script, draws, 3, min(attempt - WIDEN, 40))] if attempt > WIDEN else []))
        holds = (gender == which) & (canonical.rlike(r"\p{IsCyrillic}") == (script == "cyrillic"))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def draw(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """``entities(kind, canonical, gender)`` with their canonical replacement at one attempt."""
    # the numbers are a column of their own: every use of the expression would hash again
    drawn = entities.withColumn("draws", _draws(F.col("kind"), F.col("canonical"), F.lit(attempt), key))
    return drawn.withColumn("surrogate", _drawn(F.col("kind"), F.col("canonical"), F.col("gender"), F.col("draws"), attempt)).drop("draws")


def _drawn(kind: Column, canonical: Column, gender: Column, draws: Column, attempt: int) -> Column:
    extra = max(0, attempt - WIDEN + 1)
    longer = F.concat(canonical, F.lit("0" * extra))
    # the last label of the domain stays
    email = F.concat(
        _draw_chars(F.concat(F.lit("a" * extra), F.regexp_extract(canonical, r"^(.*\.)\p{L}+$", 1)), draws), F.regexp_extract(canonical, r"\.(\p{L}+)$", 1)
    )
    hexed = F.array_join(F.transform(_chars(F.concat(canonical, F.lit((":" + "0" * 4) * extra))), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(F.element_at(draws, i % 64 + 1) % 16)))), "")
    phone = _draw_chars(longer, draws, lambda i, c: i == 0)
    return (
        F.when(kind == "email", email).when(kind == "ip", _ip(canonical, draws, attempt)).when(kind == "ipv6", hexed).when(kind == "account", _account(longer, draws))
        .when(kind == "iban", _iban(canonical, draws)).when(kind == "phone", phone).when(kind == "name", _surname(canonical, draws, extra))
        .when(kind == "given", _given_name(canonical, gender, draws, attempt)).otherwise(_draw_chars(longer, draws))
    )


def _cased(like: Column, new: Column) -> Column:
    """``new`` in capitals if ``like`` is, else with capital beginnings."""
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(new)).otherwise(F.initcap(F.replace(new, F.lit("-"), F.lit("- "))))


def render(kind: Column, match: Column, surrogate: Column, plain: Column, given: Column) -> Column:
    """Write a canonical replacement in the format and case of one occurrence; ``plain`` is
    the replacement's letters and digits, ``given`` the replacement of a given name."""

    def one(acc: Column, c: Column) -> Column:
        new = F.substring(plain, acc["k"], F.lit(1))
        spelled = F.when(~c.rlike(r"[\p{L}\p{N}]"), c).when(F.lower(c) != c, F.upper(new)).otherwise(new)
        return F.struct(F.concat(acc["out"], spelled).alias("out"), (acc["k"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("k"))

    spelled = F.aggregate(
        _chars(match), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), one, lambda acc: F.concat(acc["out"], F.substring(plain, acc["k"], F.length(plain)))
    )
    rest = F.regexp_replace(match, f"^{TITLE}", "")
    title, surname = F.regexp_extract(match, f"^({TITLE})", 1), F.regexp_extract(rest, r"(\S+)$", 1)
    word = lambda like, new: F.replace(_cased(like, new), F.lit("- "), F.lit("-"))
    first = F.when(given.isNotNull(), F.concat(word(F.regexp_extract(rest, r"^(\S+) ", 1), given), F.lit(" "))).otherwise("")
    own = F.regexp_extract(surname, r"('s)$", 1)
    named = F.concat(title, first, word(F.regexp_replace(surname, r"'s$", ""), surrogate), own)
    # an address that had to be widened has places of its own
    whole = kind.isin("ip", "ipv6") | (kind == "email") & (F.length(surrogate) != F.length(match))
    return F.when(kind == "name", named).when(whole, surrogate).otherwise(spelled)


def surrogate_table(entities: DataFrame, key: str | None = None) -> DataFrame:
    """``kind, canonical, surrogate`` for the distinct ``entities(kind, canonical)``, which
    may have a ``gender``.

    Replacements are distinct within a kind and are no entity of that kind (given names: not
    their own).  Without a ``key`` a new one is made, and forgotten.
    """
    key = secrets.token_hex(16) if key is None else key
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit("n"))
    taken, open_, attempt = None, materialise(entities, "pii-open"), 0
    real = open_.where("kind <> 'given'").select("kind", F.col("canonical").alias("surrogate"))
    first = open_
    while not open_.isEmpty():
        drawn = materialise(draw(open_, attempt, key), "pii-drawn")
        best = drawn.where("surrogate <> canonical").groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).join(real, ["kind", "surrogate"], "left_anti")
        best = best if taken is None else best.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        new = materialise(best.select("kind", "canonical", "surrogate"), "pii-taken")
        taken = new if taken is None else taken.unionByName(new)
        left = materialise(open_.join(new, ["kind", "canonical"], "left_anti"), "pii-open")
        discard(drawn)
        if open_ is not first:
            discard(open_)
        open_, attempt = left, attempt + 1
    return entities.select("kind", "canonical", F.lit("").alias("surrogate")).limit(0) if taken is None else taken


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with every detected entity of ``text_col`` replaced, plus ``n_entities``.

    ``key`` decides the replacements: equal keys give equal replacements to equal corpora.
    Keep it secret, or pass none to have one made and forgotten.  Texts without entities,
    empty and null texts stay as they are (``n_entities`` 0).  Repeated rows are replaced
    alike and stay repeated; an empty table gives an empty result; every other column is
    kept, whatever its name (one that is called ``n_entities`` gives way).
    """
    kept = [c for c in docs.columns if c != "n_entities"]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    text = F.col(f"`{text_col}`").cast("string")
    hinted = text.rlike(HINT) | text.rlike(NAME)
    found = docs.select(whole, F.when(hinted, matches(text, ANY)).otherwise(F.array().cast("array<string>")).alias("found"))
    body = F.col("row").getField(text_col).cast("string")
    # the names of a text are looked for without their titles as well
    rests = F.transform(F.filter("found", lambda m: m.rlike(f"^{TITLE}")), lambda m: F.regexp_replace(F.regexp_replace(m, f"^{TITLE}", ""), r"'s$", ""))
    bare = F.array_sort(F.array_distinct(F.concat(rests, F.transform(rests, lambda r: F.regexp_extract(r, r"(\S+)$", 1)))), lambda a, b: F.length(b) - F.length(a))
    hit = found.where(F.size("found") > 0).select("row", F.monotonically_increasing_id().alias("rid"), "found", body.alias("body"), bare.alias("bare"))
    pattern = F.concat(F.lit(f"{ANY}|(?<!\\p{{L}})(?:"), F.array_join("bare", "|"), F.lit(")(?!\\p{L})"))
    hit = hit.withColumn("pattern", F.when(F.size("bare") > 0, pattern).otherwise(F.lit(ANY)))
    again = F.when(F.size("bare") > 0, F.regexp_extract_all("body", F.col("pattern"), F.lit(0))).otherwise(F.col("found"))
    hit = materialise(hit.select("row", "rid", again.alias("found"), F.split("body", F.col("pattern"), -1).alias("parts")), "pii-texts")
    spots = hit.select("rid", F.posexplode("found").alias("no", "match")).withColumn("kind", _kind(F.col("match")))
    spots = spots.withColumn("canonical", _canonical(F.col("kind"), F.col("match"))).withColumn("given", _given(F.col("kind"), F.col("match")))
    spots = materialise(spots.withColumn("gender", F.when(F.col("given").isNotNull(), _gender(F.col("match")))), "pii-spots")
    # the gender that most titles of a given name tell
    says = lambda g: F.count_if(F.col("gender") == g)
    given = spots.where("given is not null").groupBy(F.col("given").alias("canonical")).agg(F.when(says("m") + says("f") == 0, "n").when(says("f") > says("m"), "f").otherwise("m").alias("gender"))
    entities = spots.select("kind", "canonical").distinct().withColumn("gender", F.lit("n")).unionByName(given.select(F.lit("given").alias("kind"), "canonical", "gender"))
    table = surrogate_table(entities, key)
    plain = table.withColumn("plain", F.regexp_replace("surrogate", r"[^\p{L}\p{N}]", ""))
    firsts = materialise(table.where("kind = 'given'").select(F.col("canonical").alias("given"), F.col("surrogate").alias("new_given")), "pii-given")
    joined = spots.join(plain.where("kind <> 'given'"), ["kind", "canonical"]).join(broadcast_checked(firsts, "given", "new_given"), "given", "left")
    written = joined.select("rid", "no", render(F.col("kind"), F.col("match"), F.col("surrogate"), F.col("plain"), F.col("new_given")).alias("new"))
    inserts = written.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "new"))), lambda s: s["new"]).alias("inserts"))
    changed = hit.join(inserts, "rid").select("row", rebuild(F.col("parts"), F.col("inserts")).alias("t"), F.size("inserts").alias("n"))
    same = found.where(F.size("found") == 0).select("row", body.alias("t"), F.lit(0).alias("n"))
    out = changed.unionByName(same)
    others = [F.col("t").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept]
    return out.select(*others, F.col("n").alias("n_entities"))
