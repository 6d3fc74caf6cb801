"""Secret scanning with a random forest against false positives, in DataFrame operations.

Candidates are long runs of token characters with a digit, values that are assigned to a
name like password, passwords in addresses, and the bodies of private key blocks.  A forest
trained on labelled findings judges each by its length, character transitions, dictionary
coverage, the path it lies under and the words around it.  The forest is fitted by Spark ML on the bounded table
of labelled findings and then written out as one column expression, so scanning a corpus is
a projection: no shuffle, no Python, no model to ship.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.llm.spans import matches, pieces, rebuild

#: What leads to a value that is a candidate whatever it looks like, and that value.
NAMED = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[A-Za-z_]{0,12}[\"'`]?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"'`]?"
VALUE = r"[^\s\"'`<>&;]{4,}[^\s\"'`<>&.,;:!?)\]}]!?"
ADDRESS = r"\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s:/@\"'`<>]{1,64}:"
IN_ADDRESS = r"[^\s/@\"'`<>]{3,}(?=@)"
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s{0,4}"
BODY = r"[A-Za-z0-9+/=\s]{15,}[A-Za-z0-9+/=]"
RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*\d)[A-Za-z0-9_+/-]{16,}={0,2}"
CANDIDATE = f"{NAMED}{VALUE}|{ADDRESS}{IN_ADDRESS}|{BLOCK}{BODY}|{RUN}"
LEAD = f"^(?:{NAMED}(?={VALUE})|{ADDRESS}|{BLOCK})"
REDACTED = "[SECRET]"
#: Characters before a candidate that are its neighbourhood.
NEAR = 40
#: Rows of labelled findings the forest is fitted on at most; its size.
MOST_LABELLED, TREES, DEPTH = 20_000, 15, 6
#: Words of the dictionary and neighbouring words that speak for or against. Fixed values.
DICTIONARY = (
    "the and for with that this from have not are was but all can will one out use get set max min time name user data file path line list item page size count type test"
    " value index order number string table model class token client server config default message version request response session upload download example placeholder required optional missing invalid expired none null true false string password secret settings environ getenv process"
).split()
CUES = "token secret passwd password pwd api_key apikey access_key private_key credential auth bearer key".split()
AGAINST = "commit sha sha1 sha256 md5 checksum digest integrity revision uuid guid id order card account invoice isbn tracking phone version build etag".split()
QUIET_PATHS = "test example sample fixture mock lock docs vendor".split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
FEATURES = ("length", "transitions", "digits", "uppers", "symbols", "hex", "distinct", "bigrams", "dictionary", "cue", "against", "assigned", "quoted", "quiet_path", "marks", "in_address")


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]", "")) / F.length(text)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def features(candidate: Column, before: Column, after: Column, path: Column) -> Column:
    """Struct of ``FEATURES`` as doubles; ``before`` and ``after`` are the text around."""
    n = F.length(candidate)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]", "a"), "[A-Z]", "B"), r"\d", "0"), "[^aB0]", "-")
    runs = F.length(F.regexp_replace(shape, r"(.)\1*", "$1"))
    lower = F.lower(candidate)
    near, behind = F.right(before, F.lit(NEAR)), F.left(after, F.lit(2))
    word = lambda words: rf"(?i)(?:^|[^A-Za-z0-9])(?:{'|'.join(words)})[^A-Za-z0-9]{{0,12}}$"
    values = (
        n, runs / n, _share(candidate, r"0-9"), _share(candidate, "A-Z"), _share(candidate, "_+/=-"), _flag(candidate.rlike("^[0-9a-fA-F]+$")),
        F.size(F.array_distinct(F.split(lower, ""))) / n, F.regexp_count(lower, F.lit(f"(?={'|'.join(BIGRAMS)})")) / n,
        1 - F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        _flag(near.rlike(word([rf"[a-z_]*{c}" for c in CUES]))), _flag(near.rlike(word(AGAINST))), _flag(near.rlike(r"[=:][^A-Za-z0-9]{0,6}$")),
        _flag(near.rlike(r"[\"'`]$") & behind.rlike(r"^[\"'`]")), _flag(F.lower(path).rlike("|".join(QUIET_PATHS))), _share(candidate, r"A-Za-z0-9_+/=\s-"), _flag(near.rlike(r"://[^\s:/@]+:$")),
    )
    return F.struct(*[v.cast("double").alias(name) for name, v in zip(FEATURES, values)])


def labelled_findings(spark: SparkSession, rows: int = MOST_LABELLED) -> DataFrame:
    """Labelled findings ``candidate, before, after, path, label`` made from fixed templates:
    keys as providers issue them and passwords as people choose them against digests,
    identifiers, numbers, placeholders, words and code."""
    h = F.sha2(F.concat(F.lit("labelled"), F.col("id").cast("string")), 512)
    r = lambda k: F.conv(F.substring(h, 100 + 2 * k, 2), 16, 10).cast("int")
    some = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), r(k) % len(values) + 1)
    b64 = F.regexp_replace(F.base64(F.unhex(F.substring(h, 1, 60))), "[=]", "")
    digits = F.translate(F.substring(h, 1, 19), "abcdef", "012345")
    words = F.concat(some(DICTIONARY, 0), F.lit("_"), some(DICTIONARY, 1), F.lit("_"), some(DICTIONARY, 2), F.lit("_"), some(DICTIONARY, 3), r(4).cast("string"))
    hex_ = F.substring(h, F.lit(1), some([16, 18, 20, 24, 32, 40, 40, 64], 1))
    hex_ = F.when(r(7) % 4 == 0, F.upper(hex_)).otherwise(hex_)
    cue, junk = some(CUES, 2), some(["", "", "", "!!", "###", " |"], 3)
    assign = F.concat(some(["the ", "", "of\n", "set "], 0), F.when(r(6) % 4 == 0, F.upper(cue)).otherwise(cue), junk, some([" = ", ": ", "=", " := "], 4), junk, some(['"', '"', "'", ""], 5))
    closing, prose = some(['"', '"', "'", " "], 5), some(["and the ", "in ", "where it was ", "of them, ", "on "], 2)
    against = F.concat(some(AGAINST, 3), some([" ", ": ", "=", " = "], 4))
    unit = F.when(r(0) % 2 == 0, some(["x", "0", "X", "1", "xyz"], 0)).otherwise(F.translate(F.substring(h, F.lit(1), r(1) % 4 + 1), "0123456", "ghijklm"))
    letters = F.translate(F.substring(h, F.lit(20), r(2) % 6 + 5), "0123456789", "ghijklmnop")
    chosen = F.concat(F.when(r(5) % 3 == 0, F.initcap(letters)).otherwise(letters), F.substring(digits, F.lit(1), r(3) % 4 + 1), some(["!", "#", "", "$", "!!", "@1", "*", ""], 4))
    named = F.concat(some(["the ", "", "my_", "DB_"], 0), some("password passwd pwd secret token api_key Password PASSWORD".split(), 1), some([" = ", ": ", "=", ":", '": '], 2), some(['"', "'", "", '"'], 5))
    ended, login = some(['"', "'", "\n", '"'], 5), F.concat(some(["postgres://", "https://", "mysql://", "amqp://", "ftp://"], 0), some(["admin", "root", "app", "svc-7"], 1), F.lit(":"))
    plain_word = F.concat(some(DICTIONARY, 3), F.when(r(6) % 2 == 0, F.lit("")).otherwise(some(["d", "s", "_here", ".get", "s."], 4)))
    code = F.concat(some(["os.", "self.", "config.", "get", "${", "$", "{{", "process.env."], 6), F.when(r(7) % 2 == 0, F.upper(some(DICTIONARY, 2))).otherwise(some(DICTIONARY, 2)), some(["(", "[", "}", ".value", "()", ""], 8))
    body = F.concat(F.substring(b64, 1, 38), F.lit("\n"), F.regexp_replace(F.base64(F.unhex(F.substring(h, 11, 80))), "[=]", ""), F.lit("="))
    common = F.concat(some(BIGRAMS, 0), some(BIGRAMS, 1), some(BIGRAMS, 2), F.when(r(3) % 2 == 0, some(BIGRAMS, 4)).otherwise(""))
    loose = F.concat(some(["the ", "", "all ", "New "], 0), some("password secret token tokens credentials Password".split(), 1), some([": ", " = ", ":", ": "], 2))
    image = F.concat(some(["data:image/png;base64,", "data:font/woff;base64,", "src=data:image/gif;base64,"], 0))
    kinds = [
        (common, loose, some([" ", ".", ", ", "\n"], 5), 0), (F.repeat(b64, r(1) % 40 + 5), image, some(['"', " ", ")"], 5), 0),
        (chosen, named, ended, 1), (F.concat(F.substring(b64, 1, 6), letters, F.lit("7")), named, ended, 1), (F.when(r(7) % 2 == 0, chosen).otherwise(F.substring(b64, 1, 12)), login, F.lit("@db"), 1),
        (body, F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.lit("\n-----END"), 1),
        (plain_word, named, ended, 0), (code, named, ended, 0), (F.rpad(F.lit(""), 5 + r(4) % 9, some(["x", "*", ".", "x", "-", "?"], 6)), named, ended, 0), (F.concat(some(DICTIONARY, 2), some(DICTIONARY, 3)), named, ended, 0),
        (hex_, assign, closing, 1), (b64, assign, closing, 1), (F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(F.substring(h, 1, 64))), "[^A-Za-z0-9]", "")), 1, 15), F.lit("7")), prose, F.lit(" "), 1),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "7"), 1, 36)), prose, F.lit("\n"), 1), (F.concat(F.substring(b64, 1, 20), F.lit("_9")), assign, closing, 1), (hex_, assign, closing, 1),
        (hex_, F.concat(prose, F.lit('"')), F.lit('"'), 1),
        (digits, prose, F.lit(" "), 0), (F.substring(digits, 1, 16), against, F.lit("."), 0), (hex_, against, F.lit(" "), 0), (words, assign, closing, 0), (words, prose, F.lit(" "), 0),
        (F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), against, F.lit(","), 0),
        (F.concat(F.rpad(F.lit(""), 16 + r(4) % 24, unit), F.lit("1")), assign, closing, 0), (F.substring(digits, 1, 16), prose, some(["", "!!", "***"], 3), 0),
    ]
    pick = lambda k: F.element_at(F.array(*[x[k] if isinstance(x[k], Column) else F.lit(x[k]) for x in kinds]), (F.col("id") % len(kinds)).cast("int") + 1)
    path = F.when((pick(3) == 0) & (r(8) % 3 == 0), some(["tests/data.txt", "package-lock.json", "docs/readme.md"], 5)).otherwise(some(["src0", "src7", "app/settings.py", "deploy.yml", "src12"], 5))
    return spark.range(0, rows, 1, 4).select(pick(0).alias("candidate"), pick(1).alias("before"), pick(2).alias("after"), path.alias("path"), pick(3).alias("label"))


def fit_forest(findings: DataFrame) -> str:
    """The fitted forest in Spark's text form, of at most ``MOST_LABELLED`` findings."""
    made = findings.select(F.col("label").cast("double").alias("label"), features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")).alias("f"))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(made.select("label", "f.*").limit(MOST_LABELLED))
    return RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(table).toDebugString


def forest_votes(text: str, f: Column) -> Column:
    """Share of the trees that call a finding a secret, from the forest's text form."""
    lines = [line.strip() for line in text.splitlines()]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # the line Else
        no = node()
        return F.when(f.getField(FEATURES[int(feature)]) <= float(bound), yes).otherwise(no)

    trees = []
    while at < len(lines):
        if lines[at].startswith("Tree "):
            at += 1
            trees.append(node())
        else:
            at += 1
    total = trees[0]
    for t in trees[1:]:
        total = total + t
    return total / len(trees)


def scan_secrets(docs: DataFrame, text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``secret_findings`` (array of ``candidate, votes, is_secret`` in text
    order) and ``redacted``, the text with every secret replaced by ``REDACTED``.

    A candidate called a secret once in a text is replaced wherever it is a candidate there.
    Texts without candidates, empty and null texts stay as they are; a null path counts as
    no evidence; repeated rows are judged alike; an empty table gives an empty result.  All
    other columns are kept, whatever their names; columns that are called like the two
    results give way to them.
    """
    forest = fit_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    kept = [c for c in docs.columns if c not in ("secret_findings", "redacted")]
    plain = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path")
    )
    # most texts hold none of the signs that all but plain runs need
    signs = F.col("text").contains(":") | F.col("text").contains("=") | F.col("text").contains("-----BEGIN")
    cut = plain.withColumn("found", F.coalesce(F.when(signs, matches(F.col("text"), CANDIDATE)).otherwise(matches(F.col("text"), RUN)), F.array().cast("array<string>")))
    cut = cut.withColumn("parts", F.when(F.size("found") > 0, F.when(signs, pieces(F.col("text"), CANDIDATE)).otherwise(pieces(F.col("text"), RUN))))
    # what leads to a named value is no part of it
    cut = cut.withColumn("split", F.transform("found", lambda m: F.struct(F.regexp_extract(m, LEAD, 0).alias("lead"), m.alias("whole"))))
    spots = F.transform(
        "split",
        lambda m, i: F.struct(
            m["lead"].alias("lead"), F.substring(m["whole"], F.length(m["lead"]) + 1, F.length(m["whole"])).alias("candidate"),
            F.concat(F.right(F.element_at("parts", i + 1), F.lit(NEAR)), m["lead"]).alias("before"), F.left(F.element_at("parts", i + 2), F.lit(2)).alias("after"),
        ),
    )
    cut = cut.withColumn("spots", spots).withColumn("f", F.transform("spots", lambda x: features(x["candidate"], x["before"], x["after"], F.col("path"))))
    judged = cut.withColumn("votes", F.transform("f", lambda f: forest_votes(forest, f)))
    judged = judged.withColumn("listed", F.zip_with("spots", "votes", lambda x, v: F.struct(x["lead"].alias("lead"), x["candidate"].alias("candidate"), v.alias("votes"))))
    judged = judged.withColumn("bad", F.array_distinct(F.transform(F.filter("listed", lambda x: x["votes"] >= threshold), lambda x: x["candidate"])))
    hit = lambda x: (x["votes"] >= threshold) | F.array_contains("bad", x["candidate"])
    flagged = F.transform("listed", lambda x: F.struct(x["candidate"].alias("candidate"), x["votes"].alias("votes"), hit(x).alias("is_secret")))
    inserts = F.transform("listed", lambda x: F.concat(x["lead"], F.when(hit(x), F.lit(REDACTED)).otherwise(x["candidate"])))
    redacted = F.when(F.size("bad") > 0, rebuild(F.col("parts"), inserts)).otherwise(F.col("text"))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], flagged.alias("secret_findings"), redacted.alias("redacted"))


def secret_findings(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per candidate: ``doc_id, finding, candidate, votes, is_secret``.

    ``finding`` counts the candidates of a text from 1.  Texts without candidates, empty and
    null ones have no row, repeated rows have the same rows again, and a null id stays null.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text"), F.col("source"))
    found = scan_secrets(plain, **options).select("doc_id", F.posexplode("secret_findings").alias("finding", "x"))
    return found.select("doc_id", (F.col("finding") + 1).alias("finding"), "x.candidate", "x.votes", "x.is_secret")
