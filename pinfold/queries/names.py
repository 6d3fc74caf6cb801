"""Queries on names, rules, documents and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.operators.dedupe import first_by, last_by
from pinfold.operators.rollup import upper_median
from pinfold.operators.token_sets import similar_sets
from pinfold.operators.sampling import spread_sample
from pinfold.queries.pins import pins, pins_sql, suffix
from pinfold.runtime import table


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_id", f"trim(concat(p_name, ' ', {suffix('p_partkey', 'spark')})) AS name", "p_brand AS brand", "p_type AS kind",
        "element_at(array('X20', 'X30', 'X40', 'X99', ''), cast(p_partkey % 5 as int) + 1) AS code",
    )


PARTS = (
    f"(SELECT p_partkey AS row_id, trim(concat(p_name, ' ', {suffix('p_partkey', 'duckdb')})) AS name, p_brand AS brand, p_type AS kind,"
    " list_extract(['X20', 'X30', 'X40', 'X99', ''], (p_partkey % 5)::INT + 1) AS code FROM part)"
)


def sql_says(name: str, vocabulary: str) -> str:
    return f"regexp_matches(coalesce({name}, ''), '(?i)\\b(?:{vocabulary.replace(chr(39), chr(39) * 2)})\\b')"


def sql_first(rules: list[tuple[str, str | None]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for c, v in rules) + f" ELSE {otherwise} END"


def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = named_parts(spark, sf_dir)
    return p.select("row_id", R.directory_class("name", "code").alias("directory_class"), R.map_class(F.lower("kind"), "name").alias("map_class"))


RULE_CASCADE = (
    "SELECT row_id, "
    + sql_first(
        [(sql_says("name", R.SKIPPED), None), (f"{sql_says('name', R.SCHOOLS)} AND NOT {sql_says('name', R.WORSHIP)}", None)]
        + [(sql_says("name", w), c) for c, w in R.BY_NAME] + [(f"left(trim(upper(code)), 3) = '{k}'", v) for k, v in R.BY_CODE.items()] + [(sql_says("name", R.CHRISTIAN), "christian")]
    )
    + " AS directory_class, " + sql_first([(sql_says("name", w), c) for c, w in R.MAP_BY_NAME]) + f" AS map_class FROM {PARTS}"
)


def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = named_parts(spark, sf_dir).withColumn("reason", F.coalesce(R.drop_reason("name"), F.lit("keep")))
    out = p.groupingSets([["reason"], ["kind"]], "reason", "kind").agg(F.count("*").alias("n"), F.sum((F.col("reason") != "keep").cast("long")).alias("dropped"))
    return out


_REASON = sql_first(
    [
        ("trim(name) = ''", "unnamed_weak"), (sql_says("name", R.DROPPED), "osm_drop_re"), (f"{sql_says('name', R.CAMPUS)} AND NOT {sql_says('name', R.CONGREGATION)}", "school_entity"),
        (f"{sql_says('name', R.CAMPUS)} AND {sql_says('name', 'chapel')} AND NOT {sql_says('name', 'church|parish|cathedral')}", "school_campus_chapel"),
        (f"{sql_says('name', R.BURIAL)} AND {sql_says('name', R.CONGREGATION)} AND {sql_says('name', R.BUILDING)}", None), (sql_says("name", R.BURIAL), "cemetery_entity"),
        (f"{sql_says('name', R.SHELL)} AND {sql_says('name', R.BUILDING)} AND NOT {sql_says('name', R.SHELL_FIRST)}", None), (sql_says("name", R.SHELL), "entity_admin"),
    ]
)
DROP_REASONS = f"""
WITH p AS (SELECT *, coalesce({_REASON}, 'keep') AS reason FROM {PARTS})
SELECT reason, kind, count(*) AS n, sum((reason <> 'keep')::BIGINT)::BIGINT AS dropped FROM p GROUP BY GROUPING SETS ((reason), (kind))"""


def conditional_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pins(spark, sf_dir).withColumn("religion", F.element_at(F.array(*[F.lit(r) for r in R.RELIGIONS]), (F.col("rel") + 1).cast("int")))
    return p.select(
        "row_id", R.shell_reason("name", "religion").alias("shell"), F.when(F.col("religion") == "buddhist", R.buddhist_reason("name")).alias("buddhist"),
        F.when(F.col("religion") == "jewish", R.messianic_action("name")).alias("messianic"), R.christian_candidate("name", F.when(F.col("rel") < 2, F.col("religion"))).alias("candidate"),
    )


_RELIGION = "list_extract([" + ", ".join(f"'{r}'" for r in R.RELIGIONS) + "], (rel + 1)::INT)"
_TOKEN = f"lower(regexp_extract(name, '(?i)\\b(?:{R.BUDDHIST_DROP})\\b', 0))"
CONDITIONAL_DROP = f"""
WITH p AS (SELECT *, {_RELIGION} AS religion FROM {pins_sql()}), q AS (SELECT *, {_TOKEN} AS token FROM p)
SELECT row_id,
  {sql_first([(sql_says('name', 'catholic daughters'), 'catholic_daughters'), (f"religion = 'jewish' AND {sql_says('name', 'mikvah|mikveh|eruv')}", 'jewish_mikvah_eruv'),
              (f"religion = 'jewish' AND {sql_says('name', R.JEWISH_ADMIN)} AND NOT {sql_says('name', R.JEWISH_KEEP)}", 'jewish_org'),
              (f"religion = 'christian' AND {sql_says('name', R.CHRISTIAN_ADMIN)} AND NOT {sql_says('name', R.CHRISTIAN_KEEP)}", 'christian_foundation')])} AS shell,
  CASE WHEN religion = 'buddhist' THEN {sql_first([(f"{sql_says('name', R.BUDDHIST_KEEP)} OR token = ''", None), ("contains(token, 'fellowship')", 'peace_fellowship'),
              ("contains(token, 'relief') OR contains(token, 'humanitarian')", 'relief'), ("contains(token, 'publish')", 'publishers'), ("contains(token, 'research')", 'research_center'),
              ("contains(token, 'federation')", 'temple_federation')], "'home_group'")} END AS buddhist,
  CASE WHEN religion = 'jewish' THEN {sql_first([(f"NOT {sql_says('name', R.MESSIANIC)}", None), (f"{sql_says('name', R.MESSIANIC_ORG)} AND NOT {sql_says('name', R.MESSIANIC_WORSHIP)}", 'drop')],
              "'christian'")} END AS messianic,
  NOT coalesce(CASE WHEN rel < 2 THEN religion END, '') IN ({", ".join(f"'{x}'" for x in R.OTHER_FAITHS)}) AND NOT regexp_matches(lower(name), '{R.OTHER_WORDS}')
    AND (coalesce(CASE WHEN rel < 2 THEN religion END, '') = 'christian' OR (rel >= 2 AND regexp_matches(lower(name), '{R.CHRISTIAN_WORDS}'))) AS candidate
FROM q"""


def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.upper("name"), F.lit("  OF the "), F.col("kind"))
    return named_parts(spark, sf_dir).select("row_id", T.title_case(raw).alias("title"))


TITLE_CASE = f"""
SELECT row_id, list_aggregate(list_transform(list_filter(string_split_regex(upper(name) || '  OF the ' || kind, '\\s+'), lambda x: x <> ''),
  lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({", ".join(f"'{w}'" for w in T.SMALL_WORDS)}) THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), 'string_agg', ' ') AS title FROM {PARTS}"""


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = named_parts(spark, sf_dir)
    return p.select("row_id", *[F.array_join(f("name"), " ").alias(n) for f, n in ((T.tokens_a, "a"), (T.tokens_b, "b"), (T.tokens_c, "c"))], F.round(T.jaccard(T.tokens_a("name"), T.tokens_b("name")) * 1000).cast("long").alias("overlap"))


def sql_tokens(name: str, same: tuple, stop: list[str]) -> str:
    n = f"regexp_replace(upper({name}), '[^A-Z0-9 ]', ' ', 'g')"
    for a, b in same:
        n = f"regexp_replace({n}, '\\b{a}\\b', '{b}', 'g')"
    stops = ", ".join(f"'{s}'" for s in stop)
    return f"list_sort(list_distinct(list_filter(string_split_regex({n}, '\\s+'), lambda x: x <> '' AND x NOT IN ({stops}))))"


_C = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9'']+'), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{s}'" for s in T.STOP_C) + "))))"
TOKEN_SETS = f"""
WITH t AS (SELECT row_id, {sql_tokens('name', T.SAME_A, T.STOP_A)} AS a, {sql_tokens('name', T.SAME_B, T.STOP_B)} AS b, {_C} AS c FROM {PARTS})
SELECT row_id, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b, array_to_string(c, ' ') AS c,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(1000e0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) END::BIGINT AS overlap FROM t"""


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part names that share their first token and are similar."""
    names = named_parts(spark, sf_dir).select("name").distinct().withColumn("t", T.tokens_a("name")).where(F.size("t") > 0).withColumn("block", F.element_at("t", 1))
    pairs = similar_sets(names, "name", "t", 0.5, ["block"]).withColumn("j", T.jaccard("t", "r_t"))
    return pairs.select("name", F.col("r_name").alias("o_name"), F.floor(F.col("j") * 1000 + 0.5).cast("long").alias("j1000"), T.name_match("t", "r_t").alias("is_match"))


TOKEN_JACCARD_PAIRS = f"""
WITH n AS (SELECT DISTINCT name, {sql_tokens('name', T.SAME_A, T.STOP_A)} AS t FROM {PARTS}),
p AS (SELECT a.name, b.name AS o_name, a.t, b.t AS o, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS j
      FROM n a JOIN n b ON a.t[1] = b.t[1] AND a.name < b.name WHERE len(a.t) > 0),
q AS (SELECT *, len(t) >= 2 AND len(o) >= 2 AND (j >= 0.8e0 OR len(list_intersect(t, o)) = len(t) OR len(list_intersect(t, o)) = len(o)) AS is_match FROM p)
SELECT name, o_name, floor(j * 1000 + 0.5)::BIGINT AS j1000, is_match FROM q WHERE j >= 0.5e0 OR is_match"""


def county_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS row_id", "n_name AS state", "if(n_nationkey % 2 = 0, lpad(cast(n_nationkey as string), 5, '0'), '') AS fips",
        "element_at(array('St. Clair County', 'De Kalb Parish', 'Carson  City', 'Doña Ana', 'La Porte-West (City)', 'O''Brien'), cast(n_nationkey % 6 as int) + 1) AS county",
    )
    return c.select("row_id", T.county_key("fips", "state", "county").alias("county_key"), T.county_name("county").alias("county"))


COUNTY_KEY_NORM = r"""
WITH c AS (SELECT n_nationkey AS row_id, n_name AS state, CASE WHEN n_nationkey % 2 = 0 THEN lpad(n_nationkey::VARCHAR, 5, '0') ELSE '' END AS fips,
  upper(list_extract(['St. Clair County', 'De Kalb Parish', 'Carson  City', 'Doña Ana', 'La Porte-West (City)', 'O''Brien'], (n_nationkey % 6)::INT + 1)) AS u FROM nation),
s AS (SELECT *, trim(regexp_replace(strip_accents(replace(regexp_replace(u, '[.''’]', '', 'g'), '-', ' ')), '\s+', ' ', 'g')) AS a FROM c),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\s*\(CITY\)\s*$', ''), '\s+CITY\s*$', ''), '\s+COUNTY\s*$', ''), '\s+PARISH\s*$', '') AS b FROM s),
v AS (SELECT *, trim(regexp_replace(b, '\b(DE|DU|LA|LE|ST)\s+', '\1', 'g')) AS county FROM t)
SELECT row_id, CASE WHEN fips <> '' THEN fips ELSE state || '|' || county END AS county_key, county FROM v"""


def first_last_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first, last = first_by(e, ["user_id"], "event_id"), last_by(e, ["user_id"], "event_id")
    return first.select("user_id", F.col("event_id").alias("first_id"), F.col("event_type").alias("first_type")).join(last.select("user_id", F.col("event_id").alias("last_id"), F.col("event_type").alias("last_type")), "user_id")


FIRST_LAST = """SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"""


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    top = li.groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("most"))
    return upper_median(li, ["l_returnflag"], "l_extendedprice").join(top, "l_returnflag").select("l_returnflag", "upper_median", "most", F.col("n").cast("long").alias("n"))


UPPER_MEDIAN = "SELECT l_returnflag, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median, max(l_extendedprice) AS most, count(*) AS n FROM lineitem GROUP BY 1"


def topk_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(8)


TOPK = "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 8"


def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


NESTED = "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2"


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak address types by bucket, with how many rows lie within two distances."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "element_at(array('POSTAL', 'STREETNAME', 'LOCALITY', 'STREETINT', 'ROOFTOP'), cast(substring(o_orderpriority, 1, 1) as int)) AS addr",
        f"concat('n ', {suffix('o_orderkey', 'spark')}) AS name", "o_totalprice / 100 AS m",
    )
    weak = o.where(F.col("addr").isin(*R.WEAK_ADDRESSES)).withColumn("bucket", R.weak_bucket("addr", R.name_kind("name")))
    return weak.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("m") <= 500).alias("within_500"), F.count_if(F.col("m") <= 2000).alias("within_2000"))


QUALITY_SUMMARY = f"""
WITH o AS (SELECT list_extract(['POSTAL', 'STREETNAME', 'LOCALITY', 'STREETINT', 'ROOFTOP'], left(o_orderpriority, 1)::INT) AS addr, 'n ' || {suffix('o_orderkey', 'duckdb')} AS name, o_totalprice / 100 AS m FROM orders),
w AS (SELECT *, CASE WHEN addr = 'POSTAL' THEN 'postal_' || {sql_first([(sql_says('name', R.KIND_WORSHIP), 'worship'), (sql_says('name', R.KIND_ADMIN), 'admin')], "'other'")}
  WHEN addr = 'STREETNAME' THEN 'streetname' ELSE 'locality_or_int' END AS bucket FROM o WHERE addr <> 'ROOFTOP')
SELECT bucket, count(*) AS n, count(*) FILTER (m <= 500) AS within_500, count(*) FILTER (m <= 2000) AS within_2000 FROM w GROUP BY bucket"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return spread_sample(d, "lang", 30, 7).select("row_id", "lang", "turn")


STRATIFIED_SAMPLE = """
WITH r AS (SELECT doc_id AS row_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ((doc_id + 7) % 2147483648) * 2654435761 % 4294967296, doc_id) AS turn FROM documents)
SELECT row_id, lang, turn FROM r ORDER BY turn, lang LIMIT 30"""


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pinfold.sources.web import parse_place_page

    p = parse_place_page(table(spark, sf_dir, "pages"), "url", "html")
    return p.select("page_id", "name", "address", "zip", "lat", "lon")


HTML_EXTRACT = r"""
WITH t AS (SELECT page_id, html, coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?i)<title>([^|<]+)', 1)) AS raw FROM pages),
n AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS name FROM t)
SELECT page_id, name, '' AS address, '' AS zip, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon FROM n WHERE name <> '' AND lower(name) NOT IN ('churches', 'find a church')"""


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.countDistinct("k").alias("kinds"), F.count("k").alias("n"))


JSON_ROWS = "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(DISTINCT (props->>'$.k')::BIGINT) AS kinds, count(props->>'$.k') AS n FROM events GROUP BY 1"


def remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "lang").join(lab.select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


REMAINDER = "SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents ANTI JOIN labels USING (doc_id) GROUP BY lang"

QUERIES = {
    "rule_cascade": rule_cascade, "drop_reasons": drop_reasons, "conditional_drop": conditional_drop, "title_case": title_case, "token_sets": token_sets, "token_jaccard_pairs": token_jaccard_pairs,
    "county_key_norm": county_key_norm, "first_last_distinct": first_last_distinct, "upper_median": upper_medians, "topk_common": topk_common, "nested_counts": nested_counts,
    "quality_summary": quality_summary, "stratified_sample": stratified_sample, "html_extract": html_extract, "json_rows": json_rows, "remainder": remainder,
}
SQL = {
    "rule_cascade": RULE_CASCADE, "drop_reasons": DROP_REASONS, "conditional_drop": CONDITIONAL_DROP, "title_case": TITLE_CASE, "token_sets": TOKEN_SETS, "token_jaccard_pairs": TOKEN_JACCARD_PAIRS,
    "county_key_norm": COUNTY_KEY_NORM, "first_last_distinct": FIRST_LAST, "upper_median": UPPER_MEDIAN, "topk_common": TOPK, "nested_counts": NESTED, "quality_summary": QUALITY_SUMMARY,
    "stratified_sample": STRATIFIED_SAMPLE, "html_extract": HTML_EXTRACT, "json_rows": JSON_ROWS, "remainder": REMAINDER,
}
