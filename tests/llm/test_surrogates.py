import re

from pyspark.sql import functions as F

from pinfold.llm import surrogates as S

SCHEMA = "doc_id long, text string, rid int, n int"


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], SCHEMA)
    return [r for r in S.pseudonymise(df).orderBy("doc_id").collect()]


def test_formats_and_coreference(spark):
    texts = [
        "Mail ana.07@mail5.example.com or ANA.07@MAIL5.EXAMPLE.COM!! now",
        "call +1 (743) 555-3824, again +1 743 555 3824 from 13.149.130.89.",
        "card 4111111111111111 and 4111 1111 1111 1111, id 123-45-6789",
        "Frau Müller met Mrs. Anna Smith and Mr Smith; frau müller waits",
        "nothing here 12 or 2024-01-02",
        "",
        None,
        "ana.07@mail5.example.com",
    ]
    got = run(spark, texts)
    assert [r.n_entities for r in got] == [2, 3, 3, 3, 0, 0, 0, 1]
    mails = re.findall(r"\S+@[\w.]+\w", got[0].text)
    assert mails[0].upper() == mails[1] and mails[0].endswith(".com") and mails[0] != "ana.07@mail5.example.com"
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mails[0]) and got[7].text == mails[0]
    phones = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), again (\+1 \d{3} \d{3} \d{4}) from (\d{2,3}\.\d{3}\.\d{3}\.\d{2})\.", got[1].text).groups()
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "17435553824"
    cards = re.fullmatch(r"card (4\d{15}) and (4\d{3} \d{4} \d{4} \d{4}), id (\d{3}-\d\d-\d{4})", got[2].text).groups()
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111"
    digits = [int(c) for c in cards[0]]
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    name = re.fullmatch(r"Frau (\w+) met Mrs\. (\w+) (\w+) and Mr (\w+); frau müller waits", got[3].text)
    assert name and name[2] in S.GIVEN["f", "latin"] and "Müller" not in got[3].text.split(";")[0]
    assert got[4].text == texts[4] and got[5].text == "" and got[6].text is None


def test_collisions_are_drawn_again(spark):
    everyone = [f"{i // 10}.{i % 10}.1.1" for i in range(100)]
    ents = spark.createDataFrame([("ip", x) for x in everyone], "kind string, canonical string")
    out = S.surrogate_table(ents).collect()
    assert len(out) == 100 == len({r.surrogate for r in out}) and not {r.surrogate for r in out} & set(everyone)
    two = spark.createDataFrame([("ssn", str(i)) for i in range(4)], "kind string, canonical string")
    made = {r.canonical: r.surrogate for r in S.surrogate_table(two).collect()}
    assert len(set(made.values())) == 4 and not set(made) & set(made.values())


def test_repeated_rows_empty_table_and_a_very_long_text(spark):
    long = "word " * 150_000 + "x.1@a.org " * 50
    got = run(spark, [long])
    assert got[0].n_entities == 50 and got[0].text.startswith("word word") and len(set(got[0].text.split()[-50:])) == 1
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "x.1@a.org", 1, 2)] * 2, SCHEMA)
    rows = S.pseudonymise(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].rid == 1
    plain = spark.createDataFrame([(1, "b c", 0, 0)], SCHEMA)
    assert S.pseudonymise(plain).where(F.col("text") == "b c").count() == 1


def test_a_full_form_is_widened(spark):
    ips = spark.range(10_000).selectExpr("'ip' as kind", "concat_ws('.', substring(lpad(id, 4, '0'), 1, 1), substring(lpad(id, 4, '0'), 2, 1), substring(lpad(id, 4, '0'), 3, 1), substring(lpad(id, 4, '0'), 4, 1)) as canonical")
    given = spark.range(500).selectExpr("'given' as kind", "concat('given', id) as canonical")
    digits = spark.range(100).selectExpr("'ssn' as kind", "lpad(id, 2, '0') as canonical")
    mails = spark.range(26).selectExpr("'email' as kind", "concat(chr(97 + id), '@b.com') as canonical")
    ents = ips.unionAll(given).unionAll(digits).unionAll(mails)
    out = S.surrogate_table(ents, "k").collect()
    assert len(out) == ents.count()
    for kind in ("ip", "given", "ssn", "email"):
        real, made = {r.canonical for r in out if r.kind == kind}, [r.surrogate for r in out if r.kind == kind]
        assert len(set(made)) == len(real) == len(made) and not real & set(made)
    assert all(int(part) < 256 for r in out if r.kind == "ip" for part in r.surrogate.split("."))


def test_names_keep_their_surname_case_and_script(spark):
    (r,) = run(spark, ["Mr John Smith came. Mr Smith left, John Smith's hat and Smith stayed. Mr. SMITH! Dr Anna Smith-Jones, Mrs Anna Lee; Mr Ψαράς; Mr MacDonald"])
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+) left, (\w+) (\w+)'s hat and (\w+) stayed\. Mr\. (\w+)! Dr ([\w-]+) (\w+), Mrs ([\w-]+) (\w+); Mr (\w+); Mr (\w+)", r.text)
    assert m, r.text
    assert m[1] == m[4] and m[1] in S.GIVEN["m", "latin"] and len({m[2], m[3], m[5], m[6], m[7].title()}) == 1 and m[7].isupper()
    assert m[8] == m[10] in S.GIVEN["f", "latin"]
    assert all("α" <= c.lower() <= "ω" for c in m[12]) and m[12] != "Ψαράς" and r.n_entities == 9


def test_valid_ibans_addresses_and_phones(spark):
    def iban(country, rest):
        value = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
        return f"{country}{98 - value % 97:02d}{rest}"

    texts = [f"pay {iban('DE', f'{k:018d}')} now" for k in range(40)] + ["host 2001:db8:0:1:2:3:4:ff and fe80::1:22", "ring 555-123-4567 or 555.123.4567", "write λόγος@πύλη.gr"]
    got = run(spark, texts)
    for r in got[:40]:
        code = r.text.split()[1]
        assert code != texts[r.doc_id].split()[1] and code[:2] == "DE" and len(code) == 22
        assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    assert re.fullmatch(r"host (?:[0-9a-f]{1,4}:){7}[0-9a-f]{2} and [0-9a-f]{4}::[0-9a-f]:[0-9a-f]{2}", got[40].text) and "db8" not in got[40].text
    phones = re.fullmatch(r"ring (\d{3})-(\d{3})-(\d{4}) or (\d{3})\.(\d{3})\.(\d{4})", got[41].text).groups()
    assert phones[:3] == phones[3:] and phones[:3] != ("555", "123", "4567")
    assert re.fullmatch(r"write [α-ωό]{5}@[α-ωύ]{4}\.gr", got[42].text) and "λόγος" not in got[42].text


def test_keys_decide(spark):
    df = spark.createDataFrame([(1, "Mr Smith at x.1@a.org", 0, 0)], SCHEMA)
    one, same, other, fresh = (S.pseudonymise(df, key=k).first().text for k in ("a", "a", "b", None))
    assert one == same != other and fresh not in (one, other)
