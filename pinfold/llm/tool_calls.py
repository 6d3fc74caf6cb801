"""Linking tool calls with their results in chat tables, by DataFrame operations only.

A call sits in a message whose text is a JSON object with ``tool_calls``: a list of
``{"id", "name", "arguments"}`` (or ``{"id", "function": {"name", "arguments"}}``), where
the arguments are an object or a string that holds one.  A result is a JSON object with
``tool_call_id`` and ``content``.  An argument that holds ``"$ref:<id>"`` cites the result
of an earlier call.

Calls and results meet in a hash join on (conversation, identifier).  Messages are then
ordered topologically: a result follows its call and a call follows the results it cites,
whatever their turns say; all else keeps the order of turns.  Arguments are validated
against schemas, and messages are written as canonical JSON: sorted keys, no white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.operators.ranking import spread_rank
from pinfold.runtime import discard, materialise

#: Default schemas: tool, parameter, JSON type (any: not checked), whether it is required.
SCHEMAS = (
    ("search", "query", "string", True),
    ("search", "limit", "number", False),
    ("fetch", "url", "string", True),
    ("run", "code", "string", True),
    ("run", "timeout", "number", False),
)
#: Turns that are ranked together, and parts that rows of one turn are dealt to.
TURNS, PARTS = 256, 64
KEY = ["conv_id", "mid"]


def schema_table(spark: SparkSession, schemas: tuple = SCHEMAS) -> DataFrame:
    """``tool, param, kind, needed`` of the given schemas."""
    rows = [F.struct(F.lit(t).alias("tool"), F.lit(p).alias("param"), F.lit(k).alias("kind"), F.lit(r).alias("needed")) for t, p, k, r in schemas]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _parsed(messages: DataFrame) -> DataFrame:
    """Messages with an identity, their calls, and the id of the call they answer."""

    def call(c, no):
        args = F.coalesce(F.try_variant_get(c, "$.arguments", "variant"), F.try_variant_get(c, "$.function.arguments", "variant"))
        opened = F.when(F.schema_of_variant(args) == "STRING", F.try_parse_json(F.try_variant_get(args, "$", "string"))).otherwise(args)
        name = F.coalesce(F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.function.name", "string"))
        return F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), name.alias("name"), F.to_json(opened).alias("arguments"), no.alias("no"))

    body = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    listed = F.try_variant_get("body", "$.tool_calls", "array<variant>")
    answers = F.when(F.col("calls").isNull(), F.try_variant_get("body", "$.tool_call_id", "string"))
    return (
        messages.withColumn("mid", F.xxhash64("turn", "role", "text"))
        .withColumn("body", body)
        .withColumn("calls", F.transform(listed, call))
        .withColumn("answers", answers)
        .withColumn("content", F.when(F.col("answers").isNotNull(), F.try_variant_get("body", "$.content", "variant")).when(F.col("calls").isNull(), F.col("text").cast("variant")))
        .drop("body")
    )


def _problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, mid, no, problems`` of the calls whose arguments break their schema."""
    at = [*KEY, "no"]
    is_object = F.coalesce(F.col("arguments").startswith("{"), F.lit(False))
    formed = calls.where(is_object).select(*at, "name", "arguments")
    opened = formed.withColumn("v", F.parse_json("arguments"))
    given = opened.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*at, "name", F.col("key").alias("param"), F.schema_of_variant("value").alias("type"))
    has = (
        F.when(F.col("type") == "STRING", "string").when(F.col("type") == "BOOLEAN", "boolean").when(F.col("type") == "VOID", "null")
        .when(F.col("type").startswith("ARRAY"), "array").when(F.col("type").startswith("OBJECT"), "object").otherwise("number")
    )
    needs = schemas.withColumnRenamed("tool", "name")
    tools = needs.select("name").distinct()
    missing = formed.join(needs.where("needed"), "name").join(given.select(*at, "param"), [*at, "param"], "left_anti").select(*at, F.concat(F.lit("missing "), "param").alias("problem"))
    wrong = F.when(F.col("kind").isNull(), F.concat(F.lit("unknown "), "param")).when((F.col("kind") != "any") & (F.col("kind") != has), F.concat(F.lit("type of "), "param"))
    typed = given.join(tools, "name").join(needs, ["name", "param"], "left").select(*at, wrong.alias("problem")).where("problem is not null")
    odd = calls.where(~is_object).select(*at, F.lit("arguments are not an object").alias("problem"))
    stray = calls.join(tools, "name", "left_anti").select(*at, F.lit("unknown tool").alias("problem"))
    every = missing.unionByName(typed).unionByName(odd).unionByName(stray)
    return every.groupBy(*at).agg(F.array_sort(F.collect_set("problem")).alias("problems"))


def _mark_first(df: DataFrame, order: list[str]) -> DataFrame:
    """Flag ``first`` on the least row by ``order`` of each identifier, without sorting."""
    by = ["conv_id", "id"]
    least = df.groupBy(*by).agg(F.min(F.struct(*order)).alias("least"))
    return df.join(least, by).withColumn("first", F.struct(*order) == F.col("least")).drop("least")


def topological(links: DataFrame) -> DataFrame:
    """Place the messages of ``links(conv_id, a, a_turn, b, b_turn)``, a before b.

    Gives ``conv_id, mid, at, depth, cyclic``: the turn that a message moves to and its rank
    there, so that every message comes behind all that lead to it.  Where no link of a
    conversation goes against the turns, they are the order already.  Elsewhere pointers
    along chains double in every round: a chain of n messages takes log n rounds, messages
    with several predecessors one round more for each level of them.  What no round places
    is on or behind a cycle.
    """
    links = materialise(links.distinct(), "calls-links")
    against = materialise(links.where(F.coalesce(F.col("a_turn") >= F.col("b_turn"), F.lit(True))).select("conv_id").distinct(), "calls-against")
    of_links = lambda df: df.select("conv_id", F.col("a").alias("mid"), F.col("a_turn").alias("turn")).unionAll(df.select("conv_id", F.col("b").alias("mid"), F.col("b_turn").alias("turn"))).distinct()
    start = F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth"))
    placed = of_links(links.join(against, "conv_id", "left_anti")).select(*KEY, start.alias("best"))
    if against.isEmpty():
        return placed.select(*KEY, "best.*", F.lit(False).alias("cyclic"))
    some = links.join(against, "conv_id", "left_semi")
    nodes = materialise(of_links(some), "calls-nodes")
    # an edge leads to p, a predecessor ``len`` steps back; ``best`` is the place that the
    # messages between tell; p is null when all before is known
    edges = materialise(
        some.select("conv_id", F.col("b").alias("mid"), F.col("a").alias("p"), F.lit(1).alias("len"), F.struct(F.col("b_turn").alias("at"), F.lit(0).alias("depth")).alias("best")), "calls-edges"
    )
    known = materialise(nodes.join(edges.select(*KEY), KEY, "left_anti").select(*KEY, start.alias("best")), "calls-known")
    further = lambda x, n: F.struct(x["at"].alias("at"), (x["depth"] + n).alias("depth"))
    while not edges.isEmpty():
        ends = known.select("conv_id", F.col("mid").alias("p"), F.col("best").alias("k_best"))
        only = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("p").alias("s_p"), F.first("len").alias("s_len"), F.first("best").alias("s_best")).where("n = 1")
        steps = only.select("conv_id", F.col("mid").alias("p"), "s_p", "s_len", "s_best")
        met = edges.join(ends, ["conv_id", "p"], "left").join(steps, ["conv_id", "p"], "left")
        arrives, jumps = F.col("k_best").isNotNull(), F.col("s_p").isNotNull()
        moved = materialise(
            met.select(
                *KEY, F.when(arrives, F.lit(None)).otherwise(F.coalesce("s_p", "p")).alias("p"), F.when(jumps, F.col("len") + F.col("s_len")).otherwise(F.col("len")).alias("len"),
                F.when(arrives, F.greatest("best", further(F.col("k_best"), F.col("len")))).when(jumps, F.greatest("best", further(F.col("s_best"), F.col("len")))).otherwise(F.col("best")).alias("best"),
            ),
            "calls-moved",
        )
        new = materialise(moved.groupBy(*KEY).agg(F.max("best").alias("best"), F.count("p").alias("open")).where("open = 0").drop("open"), "calls-known")
        discard(edges)
        if new.isEmpty():
            edges = moved
            break
        known = known.unionByName(new)
        edges = materialise(moved.join(new.select(*KEY), KEY, "left_anti"), "calls-edges")
        discard(moved)
    cycles = edges.select(*KEY).distinct().select(*KEY, F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("depth"), F.lit(True).alias("cyclic"))
    return placed.unionByName(known).select(*KEY, "best.*", F.lit(False).alias("cyclic")).unionByName(cycles)


def link_tool_calls(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``.

    Returns ``conv_id, turn, position, role, kind, n_calls, n_answered, n_invalid,
    problems, status, message``.  ``kind`` is message, call or result; ``position`` ranks
    the rows of a conversation from 1 in topological order.  ``status`` is linked, orphan
    or duplicate for a result; duplicate for a call that repeats an identifier of an
    earlier one; cyclic on or behind a cycle of citations, where turns decide; else ok.
    ``message`` is canonical JSON.

    A null text is a message without content, null turns come first, rows of a null
    conversation rank together but link with nothing, repeated rows stay side by side, an
    empty table gives an empty result, and other columns are ignored.
    """
    schemas = schema_table(messages.sparkSession) if schemas is None else schemas
    plain = messages.select(*[F.col(c).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    parsed = _parsed(plain)
    tool = materialise(parsed.where("conv_id is not null and (calls is not null or answers is not null)").select(*KEY, "turn", "calls", "answers").distinct(), "calls-tool")
    calls = _mark_first(tool.select(*KEY, "turn", F.inline("calls")).where("id is not null"), ["turn", "mid", "no"])
    results = _mark_first(tool.where("answers is not null").select(*KEY, "turn", F.col("answers").alias("id")), ["turn", "mid"])
    firsts = calls.where("first").select("conv_id", "id", F.col("mid").alias("a"), F.col("turn").alias("a_turn"), F.col("no").alias("a_no"))
    verdict = F.when(F.col("a").isNull(), "orphan").when(F.col("first"), "linked").otherwise("duplicate")
    answered = materialise(results.join(firsts, ["conv_id", "id"], "left").withColumn("verdict", verdict), "calls-answers")
    linked = answered.where("verdict = 'linked'")
    of_result = linked.select("conv_id", "a", "a_turn", F.col("mid").alias("b"), F.col("turn").alias("b_turn"))
    cites = calls.select("conv_id", F.col("mid").alias("b"), F.col("turn").alias("b_turn"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref:([^"]+)"'), F.lit(1)))).alias("id"))
    cited = cites.join(linked.select("conv_id", "id", F.col("mid").alias("a"), F.col("turn").alias("a_turn")), ["conv_id", "id"]).select(*of_result.columns)
    order = topological(of_result.unionByName(cited))

    bad = _problems(tool.select(*KEY, F.inline("calls")), schemas)
    facts = (
        tool.select(*KEY)
        .join(bad.groupBy(*KEY).agg(F.count("*").alias("bad"), F.array_sort(F.flatten(F.collect_list("problems"))).alias("problems")), KEY, "left")
        .join(linked.groupBy("conv_id", F.col("a").alias("mid")).agg(F.countDistinct("a_no").alias("got")), KEY, "left")
        .join(calls.where("not first").select(*KEY).distinct().withColumn("again", F.lit(True)), KEY, "left")
        .join(answered.select(*KEY, "verdict"), KEY, "left")
        .join(order, KEY, "left")
    )
    kind = F.when(F.col("calls").isNotNull(), "call").when(F.col("answers").isNotNull(), "result").otherwise("message")
    status = (
        F.when(F.col("cyclic"), "cyclic").when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(F.col("answers").isNotNull(), "orphan").when(F.col("again"), "duplicate").otherwise("ok")
    )
    listed = F.transform("calls", lambda c: F.struct(F.try_parse_json(c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    message = F.to_json(F.struct("content", "role", F.col("answers").alias("tool_call_id"), listed.alias("tool_calls")))
    none = F.lit(0).cast("long")
    full = parsed.join(facts, KEY, "left").select(
        "conv_id", "turn", "role", kind.alias("kind"), F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("got", none).alias("n_answered"), F.coalesce("bad", none).alias("n_invalid"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"),
        status.alias("status"), message.alias("message"), "mid",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.coalesce("at", "turn", F.lit(-(1 << 40))).alias("at"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    full = full.withColumn("l1", F.floor(F.col("at") / TURNS)).withColumn("l2", F.struct("at", "depth", F.coalesce("turn", F.lit(-(1 << 40))).alias("t"), F.pmod("mid", F.lit(PARTS)).alias("part")))
    ranked = spread_rank(full, ["conv"], ["l1", "l2"], ["mid"], "position")
    return ranked.select("conv_id", "turn", "position", "role", "kind", "n_calls", "n_answered", "n_invalid", "problems", "status", "message")
