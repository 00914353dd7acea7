"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens is propagated down a tree (here domain, language, source) by the weights of
siblings. What a child cannot take, its tokens times ``epochs`` being fewer than its share, goes
to its siblings first; a node's capacity is the sum of its children's, so only what a whole
subtree lacks reaches the siblings of an ancestor. Shares are whole tokens: what rounding leaves
goes token by token to the unsatisfied siblings in order.

A leaf takes its documents in a seeded order, a new one each epoch: whole epochs first, then the
longest prefix of the next epoch's order whose tokens fit in the rest of the leaf's budget.

Tokens are the words between white space of the whole text; null texts have none, and documents
without tokens stay in every epoch that a prefix reaches. Null levels form a node of their own
(empty name). Repeated rows count and are taken each for itself; ties in the seeded order (equal
ids) are broken by tokens. An empty table gives an empty result.

A leaf may hold a third of all rows: its order is cut by ranges of the seeded hash into buckets of
about ``BUCKET`` rows, and only the one bucket where the prefix ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import SPACE, Work

BUCKET = 4096
#: Leaf and bucket tables of at most so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 200_000
LEVELS = ("domain", "lang", "source")
_HEX = 1 << 60


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 pseudo-random bits of seed, epoch and document."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def budgets(leaves: DataFrame, budget: Column, levels=LEVELS, weights: dict | None = None, epochs: int = 1) -> DataFrame:
    """Leaves (the levels, tokens) with ``leaf_budget``, by filling capacities in proportion to weights.

    ``weights`` maps (level, name) to a positive integer; unnamed nodes weigh 1. ``budget`` is an
    expression over ``total``, the capacity of the whole tree.
    """
    nodes = [leaves.withColumn("cap", F.col("tokens") * epochs)]
    for k in range(len(levels) - 1, 0, -1):
        nodes.append(nodes[-1].groupBy(*levels[:k]).agg(F.sum("cap").alias("cap")))
    nodes.reverse()
    got = nodes[0].agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("total")).select(F.least("total", budget.cast("long")).alias("given"))
    for k, level in enumerate(levels):
        weight = F.lit(1).cast("long")
        for (at, name), w in sorted((weights or {}).items()):
            if at == level:
                weight = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(weight)
        node = nodes[k].withColumn("w", weight)
        node = node.crossJoin(F.broadcast(got)) if k == 0 else node.join(got, list(levels[:k]))
        got = _filled(node, list(levels[:k]), level).select(*levels[: k + 1], F.col("share").alias("given"))
    return leaves.join(got, list(levels)).withColumnRenamed("given", "leaf_budget")


def _filled(node: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``share``: of siblings by cap / w, those under the final level are filled, the others get the level times w."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    node = node.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long"))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0).cast("long")))
    node = node.withColumn("w_all", F.sum("w").over(by)).withColumn("level", (F.col("given") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    node = node.withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    # The level of the first sibling that stays below its capacity holds for all after it.
    node = node.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(name), F.col("level").alias("at")))).over(by)["at"])
    node = node.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("level") * F.col("w"))))
    rest = F.col("given") - F.sum("share").over(by)
    nth = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(name)) if parent else F.row_number().over(Window.partitionBy("full").orderBy(name))
    return node.withColumn("rest", rest).withColumn("nth", nth).withColumn("share", F.col("share") + F.when(~F.col("full") & (F.col("nth") <= F.col("rest")), 1).otherwise(0))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def select(docs: DataFrame, levels: dict[str, Column], budget: Column, weights: dict | None = None, epochs: int = 1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The taken documents: (row struct, epoch, the levels, n_tokens, leaf_budget), a row per epoch in which one is taken."""
    work, names = Work(docs.sparkSession, "mixing"), list(levels)
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()], token_count(F.col(text_col)).alias("n_tokens"),
    )
    slim = work.table(row.select("id", *names, "n_tokens"), "slim")
    leaves = work.table(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "tree")
    if leaves.count() <= BROADCAST_ROWS:  # a small tree is planned in one task, without an exchange a level
        leaves = leaves.coalesce(1)
    plan = budgets(leaves, budget, names, weights, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("leaf_budget") / F.col("tokens")), F.lit(epochs))).otherwise(epochs).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("leaf_budget") - F.col("whole") * F.col("tokens"))
    plan = work.table(plan.withColumn("buckets", F.ceil(F.col("rows") / BUCKET).cast("long")), "leaves")

    def placed(df: DataFrame) -> DataFrame:
        """With the place of each row in the order of its leaf's last epoch."""
        at = seeded(seed, F.col("whole"), F.col("id"))
        return df.join(_small(plan), names).withColumn("at", at).withColumn("bucket", F.floor(F.col("at") / F.lit(float(_HEX)) * F.col("buckets")).cast("long"))

    by = Window.partitionBy(*names).orderBy("bucket")
    sums = placed(slim).where(F.col("whole") < epochs).groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    through = sums.withColumn("through", F.sum("in_bucket").over(by))
    # The bucket in which the prefix ends, and the tokens before it.
    ends = through.where(F.col("through") > F.col("rest")).groupBy(*names).agg(F.min(F.struct("bucket", (F.col("through") - F.col("in_bucket")).alias("before"))).alias("end"))
    ends = work.table(ends.select(*names, F.col("end.bucket").alias("end"), F.col("end.before").alias("before")), "ends")
    # The rows of those buckets alone are sorted; the last place taken bounds the rest.
    inside = placed(slim).join(_small(ends), names).where(F.col("bucket") == F.col("end"))
    run = Window.partitionBy(*names).orderBy("at", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.col("before") + F.sum("n_tokens").over(run)).withColumn("nth", F.row_number().over(Window.partitionBy(*names, "at", "id", "n_tokens").orderBy("run")))
    taken = inside.where(F.col("run") <= F.col("rest")).groupBy(*names, "at", "id", "n_tokens").agg(F.max("nth").alias("copies"))
    taken = taken.select(*[F.col(n).alias(f"{n}_t") for n in names], F.col("at").alias("at_t"), F.col("id").alias("id_t"), F.col("n_tokens").alias("n_t"), "copies")

    full = placed(row).join(_small(ends), names, "left")
    before_end = (F.col("whole") < epochs) & (F.col("end").isNull() | (F.col("bucket") < F.col("end")))
    at_end = (F.col("whole") < epochs) & (F.col("bucket") == F.col("end"))
    out = [*[F.col(n) for n in names], "n_tokens", "leaf_budget"]
    most = F.when(before_end, F.col("whole")).otherwise(F.col("whole") - 1)
    sure = full.where(most >= 0).select("row", F.explode(F.sequence(F.lit(0), most.cast("int"))).alias("epoch"), *out)
    edge = full.where(F.coalesce(at_end, F.lit(False))).withColumn("nth", F.row_number().over(Window.partitionBy(*names, "at", "id", "n_tokens").orderBy(F.lit(0))))
    same = [F.col(n) == F.col(f"{n}_t") for n in names] + [F.col("at") == F.col("at_t"), F.col("id").eqNullSafe(F.col("id_t")), F.col("n_tokens") == F.col("n_t")]
    edge = edge.join(taken, same).where(F.col("nth") <= F.col("copies"))
    return sure.unionByName(edge.select("row", F.col("whole").cast("int").alias("epoch"), *out))


def domain() -> Column:
    """The query's top level: the parity of the source's last digit, ``other`` without one."""
    return F.when(F.col("source").rlike("[02468]$"), "even").when(F.col("source").rlike("[13579]$"), "odd").otherwise("other")


WEIGHTS = {("domain", "odd"): 2, ("lang", "en"): 3, ("lang", "de"): 2}
EPOCHS, SHARE = 3, 0.5


def _filled_sql(k: int, level: str) -> str:
    """One level of ``budgets`` in SQL: table f{k} from n{k} and the level above."""
    up = LEVELS[:k]
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    named = [(n, w) for (at, n), w in sorted(WEIGHTS.items()) if at == level]
    weight = f"CASE {' '.join(f'''WHEN {level} = '{n}' THEN {w}''' for n, w in named)} ELSE 1 END" if named else "1"
    given = f"JOIN (SELECT {', '.join(up)}, share AS given FROM f{k - 1}) USING ({', '.join(up)})" if k else "CROSS JOIN top"
    full = ", ".join([*up, "filled"])
    return f"""
a{k} AS (SELECT n{k}.*, given, ({weight})::BIGINT AS w FROM n{k} {given}),
b{k} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
  coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w_before, (sum(w) OVER ({part}))::BIGINT AS w_all
  FROM a{k} WINDOW o AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level})),
c{k} AS (SELECT *, (given - cap_before)::DOUBLE / (w_all - w_before)::DOUBLE AS lev FROM b{k}),
e{k} AS (SELECT *, cap::DOUBLE / w::DOUBLE <= lev AS filled FROM c{k}),
g{k} AS (SELECT *, first_value(CASE WHEN NOT filled THEN lev END) OVER ({part} ORDER BY filled, cap::DOUBLE / w::DOUBLE, {level}) AS flat FROM e{k}),
h{k} AS (SELECT *, CASE WHEN filled THEN cap ELSE floor(flat * w)::BIGINT END AS share0 FROM g{k}),
f{k} AS (SELECT * EXCLUDE (share0), share0 + CASE WHEN NOT filled AND row_number() OVER (PARTITION BY {full} ORDER BY {level}) <= given - sum(share0) OVER ({part}) THEN 1 ELSE 0 END AS share FROM h{k})"""


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '[02468]$') THEN 'even' WHEN regexp_matches(source, '[13579]$') THEN 'odd' ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
n2 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {EPOCHS})::BIGINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM n2 GROUP BY ALL),
n0 AS (SELECT domain, sum(cap)::BIGINT AS cap FROM n1 GROUP BY ALL),
top AS (SELECT least(sum(cap), floor(sum(cap) * {SHARE}))::BIGINT AS given FROM n0),
{",".join(_filled_sql(k, level) for k, level in enumerate(LEVELS))},
leaf AS (SELECT domain, lang, source, tokens, share::BIGINT AS leaf_budget, CASE WHEN tokens > 0 THEN least(share::BIGINT // tokens, {EPOCHS}) ELSE {EPOCHS} END AS whole FROM f2),
x AS (SELECT d.*, leaf_budget, whole, leaf_budget - whole * tokens AS rest,
  ('0x' || substr(md5('17:' || whole::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM d JOIN leaf USING (domain, lang, source)),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM x),
z AS (SELECT *, CASE WHEN whole < {EPOCHS} AND run <= rest THEN whole ELSE whole - 1 END AS most FROM y)
SELECT doc_id, e.epoch::INTEGER AS epoch, domain, lang, source, n_tokens, leaf_budget FROM z, range(0, {EPOCHS}) AS e(epoch) WHERE e.epoch <= most
"""
