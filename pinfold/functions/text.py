"""Names: casing, token sets, similarity, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from pinfold.functions.matching import ratio

#: Words that stay lower inside a title, and words that token sets leave out: fixed values.
SMALL_WORDS = "of the and or de la el da du van st".split()
STOP_A = "THE OF AND A AN CHURCH INC PARISH".split()
STOP_B = [*STOP_A, "CHAPEL", "INCORPORATED", "CORP"]
STOP_C = "the and of for inc incorporated corp church chapel temple synagogue congregation cong".split()
SAME_A = (("SAINT", "ST"), ("MARYS", "MARY"))
SAME_B = (("SAINT", "ST"), ("MOUNT", "MT"), ("FIRST", "1ST"), ("ASSEMBLIES", "ASSEMBLY"), ("MARYS", "MARY"))
GENERIC = (
    "THE INC INCORPORATED OF AND CHURCH CHAPEL CATHEDRAL BASILICA PARISH SAINT ST BAPTIST METHODIST CATHOLIC EPISCOPAL LUTHERAN PRESBYTERIAN PENTECOSTAL ORTHODOX FELLOWSHIP COMMUNITY"
    " CENTER CENTRE MOSQUE MASJID SYNAGOGUE TEMPLE MANDIR GURDWARA"
).split()
COMPANY = ("inc", "llc", "corp", "corporation", "ltd", "co")
EXPAND = {"st": "saint", "mt": "mount", "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth"}
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def title_case(name: Column | str) -> Column:
    """First letters upper, the rest lower; small words stay lower unless they come first."""

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when((i > 0) & low.isin(SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, F.lit(2), F.length(low))))

    return F.array_join(F.transform(words(F.coalesce(_col(name), F.lit(""))), one), " ")


def _token_set(name: Column | str, same: tuple, stop: list[str]) -> Column:
    n = F.regexp_replace(F.upper(F.coalesce(_col(name), F.lit(""))), "[^A-Z0-9 ]", " ")
    for a, b in same:
        n = F.regexp_replace(n, rf"\b{a}\b", b)
    return F.array_sort(F.array_distinct(F.array_except(words(n), F.array(*[F.lit(s) for s in stop]))))


def tokens_a(name: Column | str) -> Column:
    """Sorted token set without stop words; two spellings of saints are one."""
    return _token_set(name, SAME_A, STOP_A)


def tokens_b(name: Column | str) -> Column:
    """Token set with more spellings and stop words."""
    return _token_set(name, SAME_B, STOP_B)


def tokens_c(name: Column | str) -> Column:
    """Lower-case tokens of three characters and more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(name), F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_C))))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared tokens of all tokens; zero if either set is empty."""
    x, y = _col(a), _col(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def name_match(a: Column | str, b: Column | str, least: float = 0.8) -> Column:
    """Both sets have two tokens, and they are similar or one holds the other."""
    x, y = _col(a), _col(b)
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) >= 2) & (F.size(y) >= 2) & ((jaccard(x, y) >= least) | within)


def generic_stripped(name: Column | str) -> Column:
    """Upper-case name without generic words."""
    n = F.regexp_replace(F.upper(F.coalesce(_col(name), F.lit(""))), "[^A-Z0-9 ]", " ")
    n = F.regexp_replace(n, rf"\b(?:{'|'.join(GENERIC)})\b", " ")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def county_name(name: Column | str) -> Column:
    """Display name of a county without accents, suffixes and split prefixes."""
    s = F.translate(F.regexp_replace(F.upper(F.coalesce(_col(name), F.lit(""))), r"[.'’]", ""), "-", " ")
    s = F.trim(F.regexp_replace(F.translate(s, ACCENTED, PLAIN), r"\s+", " "))
    for suffix in (r"\s*\(CITY\)\s*$", r"\s+CITY\s*$", r"\s+COUNTY\s*$", r"\s+PARISH\s*$"):
        s = F.regexp_replace(s, suffix, "")
    for prefix in ("DE", "DU", "LA", "LE", "ST"):
        s = F.regexp_replace(s, rf"\b{prefix}\s+", prefix)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def county_key(fips: Column | str, state: Column | str, county: Column | str) -> Column:
    """The county code where there is one, else state and county name."""
    f = F.coalesce(_col(fips), F.lit(""))
    return F.when(f.rlike(r"^\d{5}$"), f).otherwise(F.concat_ws("|", F.coalesce(_col(state), F.lit("")), county_name(county)))


def base_class(cls: Column | str) -> Column:
    """The part of a class before its first underscore."""
    return F.substring_index(_col(cls), "_", 1)


def normal_name(name: str | None) -> str:
    """Directory form of a name: compatible letters, no punctuation, no company suffix."""
    n = "".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in unicodedata.normalize("NFKC", name or "").lower())
    parts = n.split()
    if len(parts) > 1 and parts[0] == "the":
        parts = parts[1:]
    while parts and parts[-1] in COMPANY:
        parts = parts[:-1]
    return " ".join(EXPAND.get(p, p) for p in parts)


def names_similar(a: str | None, b: str | None) -> bool:
    """Equal normal forms, nearly the same tokens, or a high matching ratio: one pair, in
    Python; ``name_pairs.with_similar`` does it for tables."""
    x, y = normal_name(a), normal_name(b)
    if not x or not y:
        return False
    s, t = set(x.split()), set(y.split())
    return x == y or len(s & t) / len(s | t) >= 0.85 or ratio(x, y) >= 0.92


@F.pandas_udf(BooleanType())
def similar_names(a: pd.Series, b: pd.Series) -> pd.Series:
    """``names_similar`` as a column, in Arrow batches."""
    return pd.Series([names_similar(x, y) for x, y in zip(a, b)], dtype="boolean")


@F.pandas_udf(StringType())
def normal_names(a: pd.Series) -> pd.Series:
    return a.map(normal_name)
