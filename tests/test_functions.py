import math

from pyspark.sql import functions as F

from pinfold.functions import geo as G
from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.functions.hashing import hash01, jitter


def values(spark, cases, make):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string")
    return [r.v for r in df.select("i", make(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]


def test_names_to_reasons(spark):
    cases = {
        "Memorial Park Cemetery Baptist Church": None, "Oak Hill Cemetery": "cemetery_entity", "Lincoln School": "school_entity", "": "unnamed_weak", "Academy Chapel": "school_campus_chapel",
        "Smith High School": "osm_drop_re", "Grace Foundation": "entity_admin", "UMC Church Foundation": "entity_admin", "Grace Church": None, "Grace Church L.L.C": None,
    }
    assert values(spark, [(n, "") for n in cases], lambda a, b: R.drop_reason(a)) == list(cases.values())
    assert values(spark, [(None, None)], lambda a, b: R.drop_reason(a)) == ["unnamed_weak"]


def test_directory_map_and_census_classes(spark):
    cases = [
        ("Islamic Center", "X20"), ("St Mary School", ""), ("St Mary School Church", ""), ("Hope", "x30 "), ("Hope", ""), ("Sikh Temple Israel", ""), ("Grace Chapel", ""), ("Oak Cemetery Church", ""),
        (None, None), ("Wat Phra", ""),
    ]
    assert values(spark, cases, R.directory_class) == ["muslim", None, "christian", "jewish", None, "sikh", "christian", None, None, "buddhist"]
    cases = [("muslim", "x"), ("christian_other", "x"), ("", "Zen Center"), (None, "Hillel"), ("JEWISH ", "")]
    assert values(spark, cases, R.map_class) == ["muslim", "christian", "buddhist", None, "jewish"]
    cases = [("Sikhs", ""), ("XGURDWARA", ""), ("Non-Muslims", ""), ("Baha'i", ""), ("Totals", ""), ("Tao", ""), ("Taos Church", ""), ("Unknown", "")]
    # only the outer ends of a pattern keep to word borders
    assert values(spark, cases, lambda a, b: R.census_class(a)) == ["sikh", "sikh", "muslim", None, None, None, "christian", "christian"]


def test_conditional_rules(spark):
    assert values(spark, [("Catholic Daughters of X", "hindu"), ("Mikvah Chaya", "jewish"), ("Jewish Federation", "jewish"), ("Beth Federation", "jewish"), ("Hope Foundation", "christian"), ("Hope Foundation", "jewish")], R.shell_reason) == [
        "catholic_daughters", "jewish_mikvah_eruv", "jewish_org", None, "christian_foundation", "jewish_org"
    ]
    names = ["Buddhist Peace Fellowship", "Tzu Chi Relief Fund", "Zen Center Publishing", "Federation of Lao Temples", "Federation of Lao Viharas temples", "Insight Study Group", "Dharma Publishing", None]
    assert values(spark, [(n, "") for n in names], lambda a, b: R.buddhist_reason(a)) == ["peace_fellowship", "relief", None, "temple_federation", "temple_federation", "home_group", "publishers", None]
    names = ["Jews for Jesus", "Beth Yeshua Congregation Council", "Messianic Hope", "First Church"]
    assert values(spark, [(n, "") for n in names], lambda a, b: R.messianic_action(a)) == ["drop", "christian", "christian", None]
    cases = [("Xchurchy", ""), ("Xchurchy", "jain"), ("hope", "Christian"), ("hope", ""), ("mosque church", ""), (None, None)]
    assert values(spark, cases, R.christian_candidate) == [True, False, True, False, False, False]
    assert values(spark, [("POSTAL", "Grace Church"), ("STREETNAME", "x"), (None, "Housing Trust"), ("POSTAL", "Housing")], lambda a, b: R.weak_bucket(a, R.name_kind(b))) == ["postal_worship", "streetname", "locality_or_int", "postal_admin"]


def test_review_verdicts(spark):
    flags = lambda s: {k: F.lit(c == "1") for k, c in zip(("name_hit", "search_hit", "worship", "water"), s)}
    want = [("hifld_dupe", "1000", None, "duplicate"), ("hifld_dupe", "0000", None, "unsure"), ("impossible", "0010", None, "waterfront"), ("impossible", "0001", None, "wrong_place"),
            ("local_snap", "0100", 200, "real"), ("local_snap", "0100", 300, "unsure"), ("far_unique_review", "0100", 400, "real"), ("on_building", "0001", None, "wrong_place"), ("rural", "0010", None, "real")]
    got = spark.range(1).select(*[R.verdict(F.lit(b), flags(f) | {"search_m": F.lit(m).cast("int")}).alias(f"v{i}") for i, (b, f, m, _) in enumerate(want)]).first()
    assert list(got) == [w[-1] for w in want]


def test_titles_tokens_and_similarity(spark):
    assert values(spark, [("THE church  OF st JOHN", ""), ("", ""), (None, ""), ("o'neil-smith", "")], lambda a, b: T.title_case(a)) == ["The Church of st John", "", "", "O'neil-smith"]
    assert values(spark, [("St. Mary's Church of Saint Paul", "")], lambda a, b: F.array_join(T.tokens_a(a), " ")) == ["MARY PAUL S ST"]
    assert values(spark, [("First Assemblies, Mount Zion Inc", "")], lambda a, b: F.array_join(T.tokens_b(a), " ")) == ["1ST ASSEMBLY MT ZION"]
    assert values(spark, [("The O'Neil St of Temple zion", "")], lambda a, b: F.array_join(T.tokens_c(a), " ")) == ["o'neil zion"]
    pairs = [("Grace Hill", "Grace Hill Bible"), ("Grace", "Grace"), ("A", "B C"), ("X Y Z W V", "X Y Z W U"), ("X Y Z W V", "X Y Z W V Q")]
    assert values(spark, pairs, lambda a, b: T.name_match(T.tokens_a(a), T.tokens_a(b))) == [True, False, False, False, True]
    assert values(spark, [("First Baptist Church of Zion, Inc", "")], lambda a, b: T.generic_stripped(a)) == ["FIRST ZION"]
    names = {"St. Louis City": "STLOUIS", "De Kalb County": "DEKALB", "Doña Ana": "DONA ANA", "Orleans Parish": "ORLEANS", "Baltimore (City)": "BALTIMORE", "O’Brien-West": "OBRIEN WEST", "La  Salle": "LASALLE"}
    assert values(spark, [(n, "") for n in names], lambda a, b: T.county_name(a)) == list(names.values())
    similar = [("The First Baptist, Inc.", "1st baptist"), ("St Paul", "Saint Paul LLC"), ("Grace", "Hope"), ("", "x"), ("Mount Zion Church", "Mt Zion Churche"), (None, None)]
    assert values(spark, similar, T.similar_names) == [True, True, False, False, True, False]
    assert T.normal_name("ﬁrst  The Co") == "first the"


def test_distances_cells_and_codes(spark):
    row = spark.range(1).select(
        G.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"), G.haversine_m(F.lit(10.0), F.lit(0.0), F.lit(-10.0), F.lit(180.0)).alias("anti"),
        G.cell(F.lit(-74.999), 100.0).alias("f"), G.cell_toward_zero(F.lit(-74.999), 100.0).alias("t"), G.coord_key(F.lit(37.123456)).alias("k"),
        *[G.in_country(F.lit(a), F.lit(o), F.lit(s)).alias(n) for n, a, o, s in (("ky", 37.0, -84.0, "KY"), ("hi", 20.0, -157.0, "HI"), ("hi2", 37.0, -84.0, "HI"), ("xx", 37.0, -84.0, "XX"))],
        *[G.clean_fips(F.lit(c)).alias(n) for n, c in (("f1", " 1001.0"), ("f2", "x"), ("f3", "21151"))], G.zoom_size(F.lit(1.0)).alias("z1"), G.zoom_size(F.lit(3.0)).alias("z3"), G.zoom_size(F.lit(9.0)).alias("z9"),
    ).first()
    assert math.isclose(row.m, 111194.926, rel_tol=1e-6) and math.isclose(row.anti, math.pi * 6371000, rel_tol=1e-7)
    assert (row.f, row.t, row.k) == (-7500, -7499, 3712346) and (row.ky, row.hi, row.hi2, row.xx) == (True, True, False, False)
    assert (row.f1, row.f2, row.f3) == ("01001", "", "21151") and (row.z1, row.z9) == (0.1, 3.8) and math.isclose(row.z3, 0.55)


def emulate(text, i):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    h ^= (i + 0x9E3779B9) % 2**32
    h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
    h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
    return (h ^ h >> 16) / 2**32


def test_portable_hash_and_jitter(spark):
    cases = [("21151:0:x", 0), ("", 5), ("a|B:3", 7919), ("Zz" * 40, 2**31)]
    df = spark.createDataFrame([(k, t, i) for k, (t, i) in enumerate(cases)], "k int, t string, i long")
    got = [r.h for r in df.select("k", hash01(F.col("t"), F.col("i")).alias("h")).orderBy("k").collect()]
    assert got == [emulate(t, i) for t, i in cases]
    a, o = jitter(F.lit(40.0), F.lit(-75.0), F.lit(0.25), F.lit(0.5))
    lat, lon = spark.range(1).select(a, o).first()
    assert math.isclose(lat, 40.0325) and math.isclose(lon, -75.0, abs_tol=1e-9)
