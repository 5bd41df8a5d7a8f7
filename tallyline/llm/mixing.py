"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

Token shares p are raised to an exponent a in [0, 1] and normalised. a is the largest one (of 4096 steps) whose weights
reach the target entropy, a share of that of equal weights; where a source would then be repeated more than ``repeats``
times, a grows to the smallest one within the limit (a = 1 repeats every source equally). The weights become token
budgets. A budget is spent in whole passes over the source and one partial pass; a pass runs through the blocks of the
source in order, and every block is permuted anew for every pass. A source is cut into blocks by a hash, so the only
rows that need a running total are those of the one block in which its partial pass ends.

Defined results: a null source counts as '' and null text as no tokens; rows without tokens come with every pass that
reaches their place. Sources without tokens and empty tables give no rows. Repeated rows are separate rows. Only the
named columns are read. A partial pass overshoots its budget by less than one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.session import pin

TOKENS = r"[^\x20\x09-\x0D]+"
STEPS = 4096
WAYS = 16  # the interval is cut into so many parts at a time
ENTROPY = 0.97
REPEATS = 4.0
BLOCK_ROWS = 10_000


def draw(seed: str, *parts: str) -> str:
    """A 48-bit number from a row's values, the same in any engine with md5."""
    text = ", ':', ".join([f"'{seed}'", *parts])
    return f"bigint(conv(substr(md5(concat({text})), 1, 12), 16, 10))"


def find_step(shares: DataFrame, good: str, largest: bool) -> int:
    """The largest (smallest) step k for which the aggregate ``good`` holds at exponent k / STEPS; it must be monotone.

    One job of WAYS + 1 rows each time the interval is cut. Without any such step: 0 (STEPS).
    """
    low, high = 0, STEPS
    while True:
        wide = max(1, (high - low) // WAYS)
        grid = ", ".join(f"{k}D" for k in range(low, high + 1, wide))
        rows = (
            shares.selectExpr("p", "tokens", f"explode(array({grid})) AS k").selectExpr("k", "p", "tokens", f"pow(p, k / {STEPS}) AS u")
            .groupBy("k").agg(F.sum("u").alias("z"), F.sum(F.expr("u * ln(u)")).alias("e"), F.max(F.expr("u / p")).alias("r"))
            .selectExpr("int(k) AS k", f"{good} AS ok").collect()
        )
        ok = {r.k for r in rows if r.ok}
        if largest:
            at = max(ok, default=0)
            low, high = at, min(high, at + wide)
        else:
            at = min(ok, default=STEPS)
            low, high = max(low, at - wide), at
        if wide == 1:
            return at


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: float = 1.0,
                entropy: float = ENTROPY, repeats: float = REPEATS, block_rows: int = BLOCK_ROWS, seed: str = "mix") -> DataFrame:
    """(key, source, tokens, epoch, block, place): one row per document and pass that takes it.

    ``budget`` is a share of all tokens. Within a source, the order of reading is (epoch, block, place).
    """
    rows = pin(docs.select(
        F.col(key).alias("__key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENS)).cast("long").alias("__tokens"),
    ), "mix-rows")
    sources = pin(rows.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("n")), "mix-sources").where("tokens > 0")
    total, count = sources.agg(F.sum("tokens"), F.count("*")).first()
    total, aim = total or 0, float(entropy)
    shares = sources.selectExpr("*", f"tokens / {total or 1}D AS p")
    step = STEPS
    if total:
        # entropy of w = u / z is ln(z) - sum(u ln u) / z; a source is repeated w * budget / tokens times
        step = find_step(shares, f"round(ln(z) - e / z, 9) >= round({aim}D * ln({count}D), 9)", True)
        within = f"round({float(budget)}D * r / z, 9) <= {float(repeats)}D"
        step = max(step, find_step(shares, within, False))
    z = shares.agg(F.sum(F.expr(f"pow(p, {step}D / {STEPS})"))).first()[0] or 1.0
    planned = shares.selectExpr(
        "__source", "tokens", f"bigint(ceil(n / {block_rows}D)) AS blocks",
        f"bigint(floor(round(pow(p, {step}D / {STEPS}) / {z!r}D * {float(budget) * total!r}D, 3))) AS budget",
    ).selectExpr("__source", "blocks", "budget div tokens AS passes", "budget % tokens AS rest")

    key_text = "coalesce(string(__key), 'null')"
    placed = rows.join(planned, "__source").withColumn("__block", F.expr(f"pmod({draw(seed, key_text, '__tokens')}, blocks)"))
    blocks = placed.groupBy("__source", "__block").agg(F.sum("__tokens").alias("in_block"), F.first("rest").alias("rest"))
    # one row per block_rows documents: the running total over a source's blocks is short
    ended = blocks.selectExpr(
        "__source", "__block", "in_block",
        "rest - (sum(in_block) OVER (PARTITION BY __source ORDER BY __block) - in_block) AS left_over",
    ).selectExpr("__source", "__block", "left_over", "left_over >= in_block AS whole")
    # stored, so that the join does not inherit the window's partitioning by source alone
    ended = pin(ended, "mix-blocks")
    in_blocks = placed.join(ended, ["__source", "__block"])

    full = in_blocks.where("passes > 0").selectExpr("*", "explode(sequence(0L, passes - 1)) AS epoch")
    last = in_blocks.where("whole AND rest > 0").selectExpr("*", "passes AS epoch")
    cut = in_blocks.where("NOT whole AND left_over > 0").selectExpr("*", "passes AS epoch")
    place = draw(seed, "epoch", key_text, "__tokens")
    cut = cut.withColumn("__place", F.expr(place)).selectExpr(
        "*", "sum(__tokens) OVER (PARTITION BY __source, __block ORDER BY __place, __key, __tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - __tokens AS before",
    ).where("before < left_over")
    names = ["__source", "__key", "__tokens", "epoch", "__block"]
    return full.select(names).union(last.select(names)).union(cut.select(names)).selectExpr(
        f"__key AS `{key}`", f"__source AS `{source}`", "__tokens AS tokens", "epoch", "__block AS block", f"{place} AS place"
    )


def oracle(entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0, block_rows: int = BLOCK_ROWS, seed: str = "mix") -> str:
    """DuckDB text of the same rows: every step of the exponent is tried."""
    def number(parts: str) -> str:
        return f"CAST('0x' || substr(md5({parts}), 1, 12) AS BIGINT)"

    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKENS}')) AS BIGINT) AS tokens FROM documents
), sources AS (SELECT source, sum(tokens)::BIGINT AS t, count(*) AS n FROM rows GROUP BY source HAVING sum(tokens) > 0),
whole AS (SELECT sum(t)::DOUBLE AS total, count(*)::DOUBLE AS n FROM sources),
grid AS (
  SELECT k, sum(u) AS z, sum(u * ln(u)) AS e, max(u / p) AS r FROM (
    SELECT k, t / total AS p, pow(t / total, k / {STEPS}.0) AS u FROM sources, whole, range({STEPS + 1}) AS g(k)) GROUP BY k
), steps AS (
  SELECT greatest(coalesce(max(k) FILTER (WHERE round(ln(z) - e / z, 9) >= round({entropy} * ln((SELECT n FROM whole)), 9)), 0),
                  coalesce(min(k) FILTER (WHERE round({budget} * r / z, 9) <= {repeats}), {STEPS})) AS k FROM grid
), planned AS (
  SELECT source, b // t AS passes, b % t AS rest, blocks FROM (
    SELECT source, t, CAST(ceil(sources.n / {block_rows}.0) AS BIGINT) AS blocks,
      CAST(floor(round(pow(t / total, (SELECT k FROM steps) / {STEPS}.0) / (SELECT z FROM grid WHERE k = (SELECT k FROM steps)) * ({budget} * total), 3)) AS BIGINT) AS b
    FROM sources, whole)
), placed AS (
  SELECT rows.*, passes, rest, {number(f"'{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || tokens")} % blocks AS block FROM rows JOIN planned USING (source)
), ended AS (
  SELECT *, rest - (sum(in_block) OVER (PARTITION BY source ORDER BY block) - in_block) AS left_over
  FROM (SELECT source, block, sum(tokens) AS in_block, min(rest) AS rest FROM placed GROUP BY source, block)
), joined AS (SELECT placed.*, in_block, left_over FROM placed JOIN ended USING (source, block)),
passes AS (
  SELECT doc_id, source, tokens, unnest(range(passes)) AS epoch, block, NULL::BIGINT AS before, left_over FROM joined
  UNION ALL SELECT doc_id, source, tokens, passes, block, NULL, left_over FROM joined WHERE left_over >= in_block AND rest > 0
  UNION ALL SELECT doc_id, source, tokens, passes, block,
    sum(tokens) OVER (PARTITION BY source, block ORDER BY {number(f"'{seed}:' || passes || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || tokens")}, doc_id, tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens, left_over FROM joined WHERE left_over < in_block AND left_over > 0
)
SELECT doc_id, source, tokens, CAST(epoch AS BIGINT) AS epoch, block,
  {number(f"'{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || tokens")} AS place
FROM passes WHERE before IS NULL OR before < left_over"""
