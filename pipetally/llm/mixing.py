"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of levels (domain, language, source).  Among siblings it is
shared by integer weights; a child that cannot use its share keeps what it can use, and its
shortage goes to its siblings first.  What a whole family cannot use, its ancestors' other
children get, because a family's capacity is the sum of its leaves'.  Each leaf then reads its
documents in seeded order, epoch after epoch, and stops at its allocation: whole epochs, then
the longest run of documents whose tokens fit.  A remainder of fewer tokens than siblings,
left by whole division, is not spent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.llm.shared import few, written

LEVELS = ("domain", "lang", "source")
#: Which sources make up a domain (any other, or null: ``other``).
DOMAINS = {
    "web": [f"src{i}" for i in range(5)],
    "news": [f"src{i}" for i in range(5, 10)],
    "books": [f"src{i}" for i in range(10, 15)],
}
#: Weights among siblings, by level and value; 1 for a value that is not named.
WEIGHTS = {"domain": {"web": 4, "news": 3, "books": 3, "other": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}}
#: The budget as a percentage of all tokens, the most epochs of a document, and the seed of the order.
BUDGET_PERCENT, MAX_EPOCHS, SEED = 90, 2, "mix-1"
#: The table of leaves is broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def with_levels(docs: DataFrame, domains: dict = DOMAINS) -> DataFrame:
    """(doc, domain, lang, source, tokens, name): each row as a struct, its levels (null: ``none``), the words of the
    whole text, and what the order of a leaf is drawn from: id and text, so that repeated or missing ids spread out."""
    src = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    domain = reduce(lambda c, kv: c.when(F.col("source").isin(kv[1]), kv[0]), domains.items(), F.when(F.lit(False), "")).otherwise("other")
    held = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.regexp_replace(held, r"^[ \t-\r]+|[ \t-\r]+$", "")
    tokens = F.when(text == "", 0).otherwise(F.size(F.split(text, r"[ \t-\r]+")))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5(held.cast("binary")))
    return docs.select(
        F.struct("*").alias("doc"), domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"), src.alias("source"),
        tokens.cast("long").alias("tokens"), name.alias("name"))


def _weight(level: str, weights: dict) -> Column:
    named = weights.get(level, {})
    out = F.when(F.lit(False), 0)
    for value, w in named.items():
        out = out.when(F.col(level) == value, w)
    return out.otherwise(1).cast("long")


def _shared_out(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """``got`` for each child of every ``parent`` (whose allocation is ``given``): weights, bounded by ``cap``.

    In order of cap / weight the children that a weighted share would overfill come first; each
    takes its cap, and the rest is shared by weight.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = nodes.withColumn("w", _weight(level, weights)).withColumns({
        "left": F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(W.partitionBy(*parent)) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    full = big("cap") * big("w_left") <= big("left") * big("w")
    first = W.partitionBy(*parent)
    rows = rows.withColumn("full", full).withColumns({
        "pot": F.max(F.when(~F.col("full"), F.struct(F.col("w_left"), F.col("left")))).over(first),
    })
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(pot.left as decimal(19,0)) * cast(w as decimal(19,0)) div cast(pot.w_left as decimal(19,0))"))
    return rows.withColumn("got", got.cast("long")).drop("w", "left", "w_left", "full", "pot")


def leaf_budgets(leaves: DataFrame, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, docs, got): each leaf's allocation, from its tokens and the tree."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.sum("tokens").alias("t")).select(F.floor(F.col("t") * percent / 100).cast("long").alias("given"))
    above, at = None, []
    for level in LEVELS:
        nodes = leaves.groupBy(*at, level).agg(F.sum("cap").alias("cap"))
        if above is None:  # the root's one row
            nodes = nodes.join(F.broadcast(total), F.lit(True)).withColumn("given", F.least("given", F.sum("cap").over(W.partitionBy(F.lit(0)))))
            parent = [F.lit(0)]
        else:
            nodes = nodes.join(above, at)
            parent = at
        at = [*at, level]
        above = _shared_out(nodes, parent, level, weights).select(*at, F.col("got").alias("given"))
    return leaves.join(above, at).select(*at, "tokens", "docs", F.col("given").alias("got"))


def _order_key(seed: str) -> Column:
    """A document's place in its leaf's last, partial epoch; only rows that repeat id and text share a place."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("full").cast("string"), F.col("name")).cast("binary"))


def mixing_plan(rows: DataFrame, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row a leaf of ``rows`` (levels, tokens, name): its whole epochs ``full`` and the last order key ``cut`` of the epoch after (null: none of it).

    A leaf may hold any share of the rows, so no window runs over one: documents are summed into
    buckets of their order key, about as many as a bucket then has documents, bucket sums are
    accumulated, and only the bucket in which the allocation ends is looked into, one sum a key.
    """
    at = list(LEVELS)
    leaves = written(rows.groupBy(*at).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    plan = leaf_budgets(leaves, weights, percent, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("got div tokens")).otherwise(F.lit(0))
    plan = plan.withColumn("full", whole.cast("int")).withColumn("rest", F.col("got") - F.col("full") * F.col("tokens"))
    plan = written(plan, "mix-plan")
    most = leaves.agg(F.max("docs").alias("m")).first()["m"] or 0
    digits = 1
    while 16 ** (2 * digits) < most:
        digits += 1
    partial = plan.filter("rest > 0").select(*at, "full", "rest")
    keyed = rows.join(few(partial, BROADCAST_ROWS), at).withColumn("k", _order_key(seed)).withColumn("b", F.substring("k", 1, digits))
    sums = keyed.groupBy(*at, "rest", "b").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*at).orderBy("b"))
    sums = written(sums.withColumn("upto", upto), "mix-buckets")
    within = sums.filter("upto <= rest").groupBy(*at).agg(F.max("b").alias("last"))
    edge = sums.filter("upto > rest").groupBy(*at).agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("base")), "b").alias("e"))
    edge = written(edge.select(*at, "e.b", "e.base"), "mix-edges")
    inside = keyed.join(few(edge, BROADCAST_ROWS), [*at, "b"]).groupBy(*at, "b", "base", "rest", "k").agg(F.sum("tokens").alias("n"))
    run = F.col("base") + F.sum("n").over(W.partitionBy(*at, "b").orderBy("k"))
    cut_in = inside.withColumn("run", run).filter("run <= rest").groupBy(*at).agg(F.max("k").alias("cut_in"))
    # a bucket that fits whole ends below the next prefix: 'g' sorts after every hex digit
    out = plan.join(within, at, "left").join(cut_in, at, "left")
    return out.select(*at, "tokens", "got", "full", F.greatest(F.col("cut_in"), F.concat("last", F.lit("g"))).alias("cut"))


def mixed(docs: DataFrame, domains: dict = DOMAINS, seed: str = SEED, **how) -> DataFrame:
    """(doc, domain, lang, source, tokens, epoch): the rows of ``docs``, each a struct, once for each epoch (from 0) in which the plan reads them.

    Null ids, texts (no tokens), languages and sources (``none``) are values like any other;
    documents without tokens come with every epoch of their leaf; rows that repeat id and text are read
    together; other columns, whatever their names, are in ``doc``; an empty table gives an empty result.
    """
    at = list(LEVELS)
    rows = with_levels(docs, domains)
    plan = mixing_plan(written(rows.drop("doc"), "mix-rows"), seed=seed, **how)
    plan = few(written(plan.select(*at, "full", "cut"), "mix-cuts"), BROADCAST_ROWS)
    last = F.col("full") + F.when(_order_key(seed) <= F.col("cut"), 1).otherwise(0)
    return rows.join(plan, at).withColumn("last", last).filter("last > 0").select("doc", *at, "tokens", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("epoch"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc.doc_id", *LEVELS, "epoch", F.col("tokens").alias("n_tokens"))


QUERIES = {"op3_mixing_sources": op3_mixing_sources}


def _case(column: str, pairs: list[tuple[str, object]], other: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {' '.join(f'when {c} then {lit(v)}' for c, v in pairs)} else {lit(other)} end"


def mixing_sql(select: str, table: str = "documents") -> str:
    """DuckDB SQL of ``mixed`` with the production parameters, ending in ``select`` over ``picked``."""
    domain = _case("source", [(f"source in ({', '.join(repr(s) for s in v)})", k) for k, v in DOMAINS.items()], "other")
    weight = {lv: _case(lv, [(f"{lv} = '{v}'", w) for v, w in WEIGHTS.get(lv, {}).items()] or [("false", 1)], 1) for lv in LEVELS}
    sql = f"""
with src as (select d.*, {domain} __domain, coalesce(lang, 'none') __lang, coalesce(source, 'none') __source,
    trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) __t from {table} d),
tok as (select *, cast(case when __t = '' then 0 else len(regexp_split_to_array(__t, '[ \\t-\\r]+')) end as bigint) __tokens from src),
leaf as (select __domain domain, __lang lang, __source source, sum(__tokens)::hugeint tokens, sum(__tokens)::hugeint * {MAX_EPOCHS} cap from tok group by all),
g0 as (select least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(cap)) given from leaf)"""
    prev, at = "g0", []
    for i, lv in enumerate(LEVELS, 1):
        cols = "".join(f"{c}, " for c in [*at, lv])
        part = f"partition by {', '.join(at)}" if at else ""
        on = f"join {prev} using ({', '.join(at)})" if at else f"cross join {prev}"
        sql += f""",
n{i} as (select {cols}sum(cap) cap, any_value({weight[lv]})::hugeint w from leaf group by all),
r{i} as (select n{i}.*, given, given - coalesce(sum(cap) over o, 0) lft, sum(w) over ({part}) - coalesce(sum(w) over o, 0) wl from n{i} {on}
  window o as ({part} order by cap / w, {lv} rows between unbounded preceding and 1 preceding)),
f{i} as (select *, cap * wl <= lft * w ok from r{i}),
p{i} as (select *, max(case when not ok then wl end) over ({part}) wp from f{i}),
q{i} as (select *, max(case when not ok and wl = wp then lft end) over ({part}) lp from p{i}),
g{i} as (select {cols}case when ok then cap else lp * w // wp end given from q{i})"""
        prev, at = f"g{i}", [*at, lv]
    return sql + f""",
plan as (select domain, lang, source, case when tokens > 0 then given // tokens else 0 end fulls, given, tokens from leaf join {prev} using (domain, lang, source)),
j as (select t.*, fulls, given - fulls * tokens rest, md5(concat_ws('|', '{SEED}', cast(fulls as varchar), coalesce(cast(doc_id as varchar), 'none'), md5(coalesce(text, '')))) k
  from tok t join plan p on t.__domain = p.domain and t.__lang = p.lang and t.__source = p.source),
run as (select *, sum(__tokens) over (partition by __domain, __lang, __source order by k) upto from j),
lst as (select *, fulls + case when rest > 0 and upto <= rest then 1 else 0 end last from run),
picked as (select l.*, e __epoch from lst l, unnest(range(0, cast(last as bigint))) u(e))
{select}"""


ORACLES = {"op3_mixing_sources": mixing_sql("select doc_id, __domain domain, __lang lang, __source source, cast(__epoch as int) epoch, __tokens n_tokens from picked")}
