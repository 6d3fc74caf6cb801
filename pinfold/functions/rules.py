"""Ordered rules on names and codes: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pinfold.functions.geo import in_country, rounded
from pinfold.functions.text import title_case

RELIGIONS = ("christian", "jewish", "muslim", "hindu", "buddhist", "sikh")
#: Vocabularies by what they tell, in lower case, words or phrases: fixed values.
SKIPPED = "elementary school|high school|middle school|kindergarten|daycare|day care|bible society|ymca|ywca|council of churches|cemetery|graveyard|mausoleum"
SCHOOLS = "school|academy|seminary|college|university"
WORSHIP = "church|chapel|cathedral|parish|mosque|masjid|synagogue|temple|mandir|gurdwara|kingdom hall|baptist|methodist"
BY_NAME = (
    ("muslim", "mosque|masjid|masjed|musalla|musallah|islamic|muslim|jamia|jamaat|islam"),
    ("sikh", "gurdwara|gurudwara|sikh"),
    (
        "jewish",
        "synagogue|synagog|shul|chabad|jewish|hebrew congregation|temple beth|congregation beth|kehilla|kehilat|young israel|chavurah|b'nai|bnai|hadassah|sephardic|ashkenazi|temple sinai"
        "|temple israel|temple emanu|temple shalom|temple adath|ahavath|anshe|shaarey|shaare|tphiloh|tefilah|torah|mikvah|mikveh",
    ),
    ("hindu", "hindu|mandir|swaminarayan|iskcon|venkateswara|balaji|sanatan|jain temple|hare krishna"),
    ("buddhist", "buddhist|buddha|zen center|zen temple|soka gakkai|wat thai|wat buddha|dharma center|dharma hall|wat |watt samaki"),
)
BY_CODE = {"X20": "christian", "X21": "christian", "X22": "christian", "X24": "christian", "X30": "jewish", "X40": "muslim", "X50": "buddhist", "X70": "hindu"}
CHRISTIAN = (
    "church|chapel|cathedral|parish|baptist|methodist|lutheran|presbyterian|episcopal|catholic|pentecostal|adventist|orthodox|nazarene|wesleyan|mennonite|quaker|jehovah|latter.?day"
    "|assembly of god|assemblies of god|church of christ|church of god|ministries|ministry|tabernacle|fellowship|covenant|evangelical|anglican|reformed|holiness|apostolic"
    "|disciples of christ|unitarian|friends meeting|kingdom hall|lds|christian|gospel|diocese|archdiocese|sda|seventh.?day|advent|calvary|messiah|congregational|full gospel"
    "|house of prayer|house of god|bible church|bible chapel|faith center|faith community"
)
MAP_BY_NAME = (
    ("muslim", "mosque|masjid|islamic|muslim"),
    ("sikh", "gurdwara|sikh"),
    ("jewish", "synagogue|shul|chabad|jewish|temple beth"),
    ("hindu", "hindu|mandir|swaminarayan|iskcon"),
    ("buddhist", "buddhist|buddha|zen center|soka gakkai"),
    ("christian", "church|chapel|cathedral|parish|baptist|methodist|lutheran|presbyterian|episcopal|catholic|pentecostal|christian|ministr(?:y|ies)|tabernacle|kingdom hall"),
)
DROPPED = "elementary school|high school|middle school|kindergarten|daycare|day care|bible society|ymca|ywca|council of churches|committee on publication|bible camp|youth camp|campmeeting|wayside cross|wayside shrine"
CAMPUS = "school|academy|seminary"
CONGREGATION = (
    "church|chapel|cathedral|parish|mosque|masjid|synagogue|shul|mandir|gurdwara|temple|kingdom hall|baptist|methodist|lutheran|presbyterian|episcopal|catholic|pentecostal|orthodox|adventist"
    "|christian science society"
)
BUILDING = "church|chapel|cathedral|parish|synagogue|mosque|masjid|mandir|gurdwara|temple|kingdom hall"
BURIAL = "cemetery|graveyard|mausoleum"
SHELL = r"cemetery|graveyard|mausoleum|foundation|endowment(?:\s+fund)?|llc|l\.l\.c|hermitage|retreat (?:center|centre)|camp and retreat|charitable trust|realty"
SHELL_FIRST = "foundation|endowment|llc|hermitage|retreat|trust|realty"
STACK_AGAINST = (
    r"corp sole|corporation sole|pastor of|stake|gemach|yeshiva corp|kollel corp|ministr(?:y|ies)\s+inc|ministr(?:y|ies)\s+incorporated|foundation|endowment|llc|l\.l\.c|realty|charitable trust"
    "|housing|association|council of"
)
STACK_FOR = "church|chapel|cathedral|parish|mosque|masjid|synagogue|shul|mandir|gurdwara|temple|kingdom hall|congregation"
NEAR_AGAINST = "endowment|insurance|foundation|committee|association|council|housing|llc|trust|fund"
JEWISH_ADMIN = "ministr(?:y|ies)|association|alliance|federation|foundation|endowment|publishers"
JEWISH_KEEP = (
    "synagogue|shul|chabad|lubavitch|temple|congregation|cong|beit|beth|havurah|chavurah|center|conservative|reform|orthodox|reconstructionist|young israel|chapel|tabernacle|kehilat|kehilla"
    "|yeshiva|kollel"
)
CHRISTIAN_ADMIN = "foundation|federation|endowment|publishers"
CHRISTIAN_KEEP = "church(?:es)?|chapel|cathedral|parish|synagogue|tabernacle|fellowship|assembly|congregation|mosque|mandir|gurdwara|temple|kingdom hall"
BUDDHIST_DROP = (
    "peace fellowship|charitable relief|relief fund|relief mission|humanitarian|publishers|publishing|research center|federation of .{0,40}temples|study group|sitting group|meditation group"
)
BUDDHIST_KEEP = "temple|wat|monastery|zen center|vihara|pagoda"
MESSIANIC = "messianic|jews for jesus|chosen people|yeshua|yahshua|moshiach|mashiach|messiah|mesianica|mesianic"
MESSIANIC_WORSHIP = "congregation|synagogue|synagog|fellowship|beit|beth|kehilat|kehillat|kehillah|temple|assembly|community|center|church|shul|cong|tabernacle|chapel"
MESSIANIC_ORG = "council|publishers|publishing|movement international|perspectives|journey to healing|jews for jesus|communities"
KIND_WORSHIP = "church|chapel|cathedral|parish|synagogue|shul|chabad|mosque|masjid|mandir|gurdwara|temple|kingdom hall|baptist|methodist|lutheran|presbyterian|episcopal|catholic|pentecostal|adventist"
KIND_ADMIN = "ministr(?:y|ies)|association|alliance|federation|council|committee|foundation|endowment|fund|trust|publishers|housing|gemach|eruv"
LANDMARKS = "cathedral|basilica|abbey|minster|shrine"
ADMIN_PINS = "conference|synod|diocese|district council|general council"
#: Patterns whose first and last term alone keep to word borders: fixed values.
CENSUS = (
    ("sikh", r"\bSIKH|GURDWARA\b"),
    ("muslim", r"\bISLAM|MUSLIM|MOSQUE\b"),
    ("hindu", r"\bHINDU|HINDUISM|VEDANTA|SWAMINARAYAN\b"),
    ("buddhist", r"\bBUDDH|THERAVADA|MAHAYANA|VAJARAYANA|VAJRAYANA\b"),
    ("jewish", r"\bJEWISH|JUDAISM|CHABAD|RECONSTRUCTIONIST JUDAISM|REFORM JUDAISM|CONSERVATIVE JUDAISM|ORTHODOX JUDAISM|INDEPENDENT JUDAISM\b"),
    (None, r"\bBAHA.?I|JAIN\b|SHINTO|TAOISM|\bTAO\b|ZOROASTR|ETHICAL UNION|SPIRITUALIST\b"),
)
OTHER_FAITHS = "muslim jewish buddhist hindu sikh bahai unitarian_universalist shinto jain taoist pagan".split()
OTHER_WORDS = "mosque|masjid|islamic|muslim|synagogue|shul|chabad|temple beth"
CHRISTIAN_WORDS = (
    "church|chapel|cathedral|parish|baptist|methodist|lutheran|episcopal|catholic|pentecostal|adventist|orthodox|ministry|ministries|tabernacle|fellowship|congregation"
)
WEAK_ADDRESSES = ("POSTAL", "STREETNAME", "LOCALITY", "STREETINT")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def says(name: Column | str, vocabulary: str) -> Column:
    """Whether a name holds one of the words, between word borders."""
    return _text(name).rlike(rf"(?i)\b(?:{vocabulary})\b")


def first_of(rules: list[tuple[Column, str | None]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for holds, value in rules:
        out = F.when(holds, F.lit(value)) if out is None else out.when(holds, F.lit(value))
    return out.otherwise(F.lit(otherwise)).cast("string")


def directory_class(name: Column | str, code: Column | str) -> Column:
    """Religion of a directory row: skipped, then by name, then by code, then christian."""
    short = F.substring(F.trim(F.upper(_text(code))), 1, 3)
    rules = [(says(name, SKIPPED), None), (says(name, SCHOOLS) & ~says(name, WORSHIP), None)]
    rules += [(says(name, words), cls) for cls, words in BY_NAME]
    rules += [(short == c, cls) for c, cls in BY_CODE.items()]
    return first_of([*rules, (says(name, CHRISTIAN), "christian")])


def baked(rows: DataFrame) -> DataFrame:
    """Directory rows (``row_id, name, code, lat, lon, state, city``) as places: names and
    cities in title case, five decimals, and ``class``, which is skipped outside the country
    and unclassified where no rule names one."""
    cls = F.when(~in_country("lat", "lon", "state"), "skipped").otherwise(F.coalesce(directory_class("name", "code"), F.lit("unclassified")))
    return rows.select("row_id", title_case("name").alias("name"), cls.alias("class"), rounded("lat", 5).alias("lat"), rounded("lon", 5).alias("lon"), "state", title_case("city").alias("city"))


def bake_counters(places: DataFrame) -> DataFrame:
    """How many rows each class has, skipped and unclassified ones among them."""
    return places.groupBy("class").agg(F.count("*").alias("n"))


def observed(places: DataFrame) -> tuple[DataFrame, Observation]:
    """``places`` as they are, and their counters, which fill while the rows are written.

    After the write, ``counters.get`` holds ``n`` and the rows of each class that
    ``bake_counters`` would count, without a pass of its own; classes without rows are 0.
    """
    counters = Observation()
    each = [F.count_if(F.col("class") == c).alias(c) for c in (*RELIGIONS, "skipped", "unclassified")]
    return places.observe(counters, F.count(F.lit(1)).alias("n"), *each), counters


def map_class(cls: Column | str, name: Column | str) -> Column:
    """Religion of a map row: by its class, else by its name."""
    c = F.lower(F.trim(_text(cls)))
    rules = [(c == r, r) for r in RELIGIONS] + [(c.startswith("christian"), "christian")]
    return first_of(rules + [(says(name, words), r) for r, words in MAP_BY_NAME])


def census_class(group: Column | str) -> Column:
    """Religion of a census group; other faiths are null, unknown groups christian."""
    g = F.upper(_text(group))
    return first_of([(g.isin("", "TOTALS"), None), *[(g.rlike(p), cls) for cls, p in CENSUS]], "christian")


def drop_reason(name: Column | str) -> Column:
    """Why a name is no congregation, null to keep it."""
    n = F.trim(_text(name))
    rules = [
        (n == "", "unnamed_weak"),
        (says(n, DROPPED), "osm_drop_re"),
        (says(n, CAMPUS) & ~says(n, CONGREGATION), "school_entity"),
        (says(n, CAMPUS) & says(n, "chapel") & ~says(n, "church|parish|cathedral"), "school_campus_chapel"),
        (says(n, BURIAL) & says(n, CONGREGATION) & says(n, BUILDING), None),
        (says(n, BURIAL), "cemetery_entity"),
        (says(n, SHELL) & says(n, BUILDING) & ~says(n, SHELL_FIRST), None),
        (says(n, SHELL), "entity_admin"),
    ]
    return first_of(rules)


def landmark(name: Column | str) -> Column:
    """Whether a name is that of a place people know from far."""
    return says(name, LANDMARKS)


def provenance(city: Column | str, religion: Column | str) -> Column:
    """gap for rows without a city, directory for those with one; null for muslim rows, whose
    directory names none."""
    r = F.col(religion) if isinstance(religion, str) else religion
    return first_of([(F.coalesce(r, F.lit("")) == "muslim", None), (F.trim(_text(city)) == "", "gap")], "directory")


def shell_reason(name: Column | str, religion: Column | str) -> Column:
    """Why a row is an organisation's shell, null to keep it."""
    r = F.col(religion) if isinstance(religion, str) else religion
    rules = [
        (says(name, "catholic daughters"), "catholic_daughters"),
        ((r == "jewish") & says(name, "mikvah|mikveh|eruv"), "jewish_mikvah_eruv"),
        ((r == "jewish") & says(name, JEWISH_ADMIN) & ~says(name, JEWISH_KEEP), "jewish_org"),
        ((r == "christian") & says(name, CHRISTIAN_ADMIN) & ~says(name, CHRISTIAN_KEEP), "christian_foundation"),
    ]
    return first_of(rules)


def buddhist_reason(name: Column | str) -> Column:
    """Why a buddhist row is no temple, from the first word that tells."""
    token = F.lower(F.regexp_extract(_text(name), rf"(?i)\b(?:{BUDDHIST_DROP})\b", 0))
    held = [("fellowship", "peace_fellowship"), ("relief", "relief"), ("humanitarian", "relief"), ("publish", "publishers"), ("research", "research_center"), ("federation", "temple_federation")]
    return first_of([(says(name, BUDDHIST_KEEP) | (token == ""), None), *[(token.contains(k), v) for k, v in held]], "home_group")


def messianic_action(name: Column | str) -> Column:
    """drop, christian, or null where a name is not messianic."""
    return first_of([(~says(name, MESSIANIC), None), (says(name, MESSIANIC_ORG) & ~says(name, MESSIANIC_WORSHIP), "drop")], "christian")


def christian_candidate(name: Column | str, religion: Column | str) -> Column:
    """A row tagged christian, or untagged with a church word, and nothing else."""
    r, n = F.lower(_text(religion)), F.lower(_text(name))
    return ~r.isin(OTHER_FAITHS) & ~n.rlike(OTHER_WORDS) & ((r == "christian") | ((r == "") & n.rlike(CHRISTIAN_WORDS)))


def name_kind(name: Column | str) -> Column:
    return first_of([(says(name, KIND_WORSHIP), "worship"), (says(name, KIND_ADMIN), "admin")], "other")


def weak_bucket(address_type: Column | str, kind: Column) -> Column:
    a = F.coalesce(F.nullif(_text(address_type), F.lit("")), F.lit("?"))
    return F.when(a == "POSTAL", F.concat(F.lit("postal_"), kind)).when(a == "STREETNAME", F.lit("streetname")).otherwise(F.lit("locality_or_int"))


def stack_score(name: Column | str, county_ok: Column, city: Column | str) -> Column:
    """Struct that orders the rows of a stack, the best highest."""
    n = _text(name)
    points = F.when(says(n, STACK_FOR), 3).otherwise(0) - F.when(says(n, STACK_AGAINST), 5).otherwise(0) - F.when(F.length(n) > 70, 2).otherwise(0)
    return F.struct(points.alias("points"), F.when(county_ok, 2).otherwise(0).alias("county"), F.when(F.trim(_text(city)) != "", 1).otherwise(0).alias("city"), F.length(n).alias("length"))


def near_score(name: Column | str, county_ok: Column, city: Column | str) -> Column:
    n = _text(name)
    return F.struct(F.when(says(n, NEAR_AGAINST), -3).otherwise(0).alias("points"), F.when(county_ok, 2).otherwise(0).alias("county"), F.when(F.trim(_text(city)) != "", 1).otherwise(0).alias("city"), F.length(n).alias("length"))


def verdict(bucket: Column, evidence: dict[str, Column]) -> Column:
    """Review verdict from evidence: ``name_hit, search_hit, search_m, worship, water``."""
    near = evidence["name_hit"] | evidence["worship"] | evidence["search_hit"]
    hit = lambda m: evidence["search_hit"] & (evidence["search_m"] <= m)
    rules = [
        ((bucket == "hifld_dupe") & near, "duplicate"), (bucket == "hifld_dupe", "unsure"),
        ((bucket == "impossible") & near, "waterfront"), ((bucket == "impossible") & evidence["water"], "wrong_place"), (bucket == "impossible", "unsure"),
        ((bucket == "local_snap") & hit(250), "real"), (bucket == "local_snap", "unsure"),
        ((bucket == "far_unique_review") & hit(400), "real"), (bucket == "far_unique_review", "unsure"),
        (near, "real"), (evidence["water"], "wrong_place"),
    ]
    return first_of(rules, "unsure")
