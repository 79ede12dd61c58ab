"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's rows form blocks. Weights are whole parts q of a period of slots. The j-th block of a
source in the period is released at floor((j-1) * period / q) and due at ceil(j * period / q); one block is placed
in each slot, the earliest deadline first among the released. All deadlines are met (Baruah et al., 1996), which
means that in every prefix of the mix each source has less than one block more or less than its share.

All sources return to their exact shares at a period's end, so the schedule repeats: the placement of a period is
made once, from the weights alone (``period`` numbers, whatever the data's size), and a block's slot follows from
its number by arithmetic: a broadcast of one row for each source, and no sort of the blocks.

Shares are rounded to parts of the period, by less than one part each; one below a part counts as one part, which the
largest shares give. The period is four times the
mix's slots where that is between PERIOD and MOST_PERIOD, so that rounding shifts no source by more than a quarter of a
block over the whole mix. In a mix of T slots, T above MOST_PERIOD / 4, it shifts a source by T / MOST_PERIOD blocks at
the most, 4 in a million of the mix.

No row is dropped: the mix is as long as the source that needs most slots for all its rows, and sources that have
fewer rows than their share start again (epochs 1, 2, ...).
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, row_numbers, table

PERIOD, MOST_PERIOD, BLOCK, ALPHA, MOST_SOURCES = 1000, 1 << 18, 8, 0.7, 50_000
POSITION = "mix_pos"


def parts(weights: list[float], period: int) -> list[int]:
    """Whole parts of the period, one at least, by largest remainders (ties: first in the list)."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    q = [max(1, int(x)) for x in exact]
    order = sorted(range(len(q)), key=lambda i: (-(exact[i] - int(exact[i])), i))
    for i in order[: max(0, period - sum(q))]:
        q[i] += 1
    while sum(q) > period:  # only where shares below one part were raised to one
        q[max(range(len(q)), key=lambda i: (q[i], -i))] -= 1
    return q


def period_for(rows: list[int], weights: list[float], block: int, period: int = PERIOD) -> int:
    """Four times the slots that the mix needs by the exact weights, from ``period`` to MOST_PERIOD; four slots a source at least."""
    slots = max((-(-n // block) * sum(weights) / w for n, w in zip(rows, weights)), default=0)
    return max(period, 4 * len(rows), min(MOST_PERIOD, 4 * math.ceil(slots - 1e-6)))


def pfair(q: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period of sum(q) slots."""
    period = sum(q)
    slots: list[list[int]] = [[] for _ in q]
    waiting = [(0, s) for s in range(len(q))]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // q[s]), s))
        due, s = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if len(slots[s]) < q[s]:
            heapq.heappush(waiting, (len(slots[s]) * period // q[s], s))
    return slots


def _scheduled(rows: DataFrame, weights: dict[str | None, float] | None, block: int, period: int, alpha: float) -> DataFrame:
    """Columns id, source and any others of ``rows``, with those of ``mix``."""
    spark = rows.sparkSession
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = row_numbers(rows, ["id"], "mix-rows", within="source")
    counts = sorted(counts, key=lambda r: (r["source"] is not None, r["source"] or ""))
    if weights is not None and (lost := [r["source"] for r in counts if r["source"] not in weights]):
        raise ValueError(f"no weight for the sources {lost[:5]}")
    given = [weights[r["source"]] if weights is not None else r["n"] ** alpha for r in counts]
    if any(not 0 < w < math.inf for w in given):
        raise ValueError("weights must be positive and finite")
    q = parts(given, period_for([r["n"] for r in counts], given, block, period)) if counts else []
    slots = pfair(q)
    total = 0  # slots of the mix
    for r, qs, at in zip(counts, q, slots):
        last = -(-r["n"] // block) - 1
        total = max(total, last // qs * sum(q) + at[last % qs] + 1)
    plan = []
    for r, qs, at in zip(counts, q, slots):
        cycles, rest = divmod(total, sum(q))
        plan.append((r["source"], r["n"], qs, (cycles * qs + sum(x < rest for x in at)) * block, at))
    schedule = spark.createDataFrame(plan, f"_s {dict(rows.dtypes)['source']}, _n long, _q long, _wanted long, _at array<long>")
    joined = rows.join(F.broadcast(schedule), F.col("source").eqNullSafe(F.col("_s")))
    again = joined.withColumn("epoch", F.explode(F.expr("sequence(0L, (_wanted - 1L - row) div _n)")))
    k = "(row + epoch * _n)"
    again = again.withColumn("block", F.expr(f"{k} div {block}"))
    slot = f"block div _q * {sum(q)} + element_at(_at, cast(block % _q as int) + 1)"
    again = again.withColumn("slot", F.expr(slot)).withColumn("pos", F.expr(f"slot * {block} + {k} % {block}"))
    return again.drop("_s", "_n", "_q", "_wanted", "_at")


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA,
) -> DataFrame:
    """Rows of the mix: id, source, row (the row's number in its source), epoch, block, slot, pos.

    ``pos`` orders the mix (slot * block + place in the block). Weights default to rows^alpha for each source;
    a given dict must have a positive weight for each source that occurs (else ValueError), None standing for null
    sources, which are a source of their own. Rows are ordered by id within their source (nulls first); repeated rows
    count singly, and which of them comes first is open. Texts are not read. Beyond MOST_SOURCES sources a ValueError is
    raised, as the schedule is sent to all executors. An empty table gives an empty result.
    """
    return _scheduled(pick(docs, id=id_col, source=source_col), weights, block, period, alpha)


def mixed_rows(
    docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA,
) -> DataFrame:
    """The mix as rows of the input: each with all its columns and ``mix_pos``, as often as the mix has it, once at least.

    mix_pos numbers the rows of the mix from 0 without gaps; a column of that name in the input is replaced. Nulls,
    repeated rows and empty tables as in ``mix``; texts of any length are carried along once for each row of the mix.
    """
    names = {f"x{i}": c for i, c in enumerate(docs.columns)}
    id_, source = (F.col(f"x{docs.columns.index(c)}") for c in (id_col, source_col))
    kept = [x for x, c in names.items() if c != POSITION]
    plain = docs.toDF(*names).select(id_.alias("id"), source.alias("source"), *kept)
    return _scheduled(plain, weights, block, period, alpha).select(*kept, "pos").toDF(*[names[x] for x in kept], POSITION)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP1_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents
), counts AS (
  SELECT source, count(*) AS n, power(count(*), {ALPHA}) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i
  FROM documents GROUP BY source
), period AS (
  SELECT greatest({PERIOD}, 4 * count(*), least({MOST_PERIOD}, 4 * ceil(max(((n + {BLOCK - 1}) // {BLOCK}) * (SELECT sum(w) FROM counts) / w) - 1e-6)))::BIGINT AS p FROM counts
), shares AS (
  SELECT *, w / sum(w) OVER () * p AS exact FROM counts, period
), ranked AS (
  SELECT *, floor(exact)::BIGINT AS whole, row_number() OVER (ORDER BY exact - floor(exact) DESC, i) AS r FROM shares
), quota AS (
  SELECT source, n, i, whole + CASE WHEN r <= p - (SELECT sum(whole) FROM ranked) THEN 1 ELSE 0 END AS q, p FROM ranked
), state AS (
  SELECT list(q::BIGINT ORDER BY i) AS qs, list(0::BIGINT ORDER BY i) AS done, 0::BIGINT AS t, 0::BIGINT AS s, any_value(p) AS p FROM quota
), pick AS (
  SELECT t, done, qs, s, p FROM state
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = c THEN d + 1 ELSE d END), qs, c, p
  FROM (
    SELECT *, list_position(due, list_min(due)) AS c FROM (
      SELECT *, list_transform(qs, lambda q, i: CASE WHEN done[i] < q AND done[i] * p // q <= t
        THEN ((done[i] + 1) * p + q - 1) // q ELSE 999999999 END) AS due
      FROM pick WHERE t < p
    )
  )
), placed AS (
  SELECT s AS i, t - 1 AS spot, row_number() OVER (PARTITION BY s ORDER BY t) - 1 AS j FROM pick WHERE t > 0
), total AS (
  SELECT max(((n + {BLOCK - 1}) // {BLOCK} - 1) // q * p + spot + 1) AS slots
  FROM quota JOIN placed ON placed.i = quota.i AND placed.j = ((n + {BLOCK - 1}) // {BLOCK} - 1) % q
), wanted AS (
  SELECT quota.i, any_value(source) AS source, any_value(n) AS n, any_value(q) AS q, any_value(p) AS p,
    ({BLOCK} * ((SELECT slots FROM total) // any_value(p) * any_value(q) + count(*) FILTER (WHERE spot < (SELECT slots FROM total) % p)))::BIGINT AS wanted
  FROM quota JOIN placed USING (i) GROUP BY quota.i
), spread AS (
  SELECT rows_.doc_id, rows_.source, row, n, q, p, wanted.i, unnest(range(0, (wanted - 1 - row) // n + 1)) AS epoch
  FROM rows_ JOIN wanted ON rows_.source IS NOT DISTINCT FROM wanted.source
), numbered AS (
  SELECT *, row + epoch * n AS k FROM spread
)
SELECT doc_id, source, row::BIGINT AS row, epoch::BIGINT AS epoch, (k // {BLOCK})::BIGINT AS block,
  ((k // {BLOCK}) // q * p + spot)::BIGINT AS slot, (((k // {BLOCK}) // q * p + spot) * {BLOCK} + k % {BLOCK})::BIGINT AS pos
FROM numbered JOIN placed ON placed.i = numbered.i AND placed.j = (k // {BLOCK}) % q
"""
