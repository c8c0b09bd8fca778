"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Each source's rows, in the order of a hash of doc_id, form blocks of `block` rows. With w a source's share of the
weights, its k-th block (from 0) may not come before slot floor(k / w) and not after ceil((k + 1) / w) - 1. One pass
over the slots of the whole schedule gives each to the released block with the earliest deadline, which meets all
deadlines, as the shares add up to one: after any t slots each source with rows left has had w * t blocks, give or
take less than one. Shares are ratios of whole numbers and held exactly, so nothing drifts. Every row is placed,
once. When a source has run out its slots stay empty, and the others go on in their order.

The schedule has SLOTS slots at most: with very many rows blocks have more than `block` of them. The pass takes
slots x sources steps in one task, so that some thousand sources are its limit; more ought to be grouped.
A source of weight 0, or not among the weights given, gets nothing as long as others have rows: it comes last.
A null source is a source of its own. A source's rows are numbered within buckets of the hash, so that no task
has to hold a source. Rows that share a doc_id are placed next to each other.
Input columns named `slot` or `position` give way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block at least; slots of a schedule at most, and what slots times sources may come to; rows of a bucket, about.
BLOCK, SLOTS, STEPS, BUCKET = 64, 1 << 18, 1 << 22, 20_000
#: Slots of a chunk of the pass, whose picks are added to one list.
CHUNK = 512


def shares(sources: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """source, n and w, a whole number. sources: source, n. Without weights a source's is the root of its rows, to a thousandth."""
    if weights is None:
        return sources.withColumn("w", F.greatest(F.lit(1), F.round(F.sqrt(F.col("n").cast("double")) * 1000)).cast("long"))
    total = sum(weights.values())
    weight = F.lit(0).cast("long")
    for source, w in weights.items():
        if not w >= 0:
            raise ValueError(f"the weight of {source!r} is below 0")
        # nine digits: over all slots less than a thousandth of a block
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(max(1, round(w / total * 10**9)) if w else 0).cast("long")).otherwise(weight)
    return sources.withColumn("w", weight)


def timetable(shared: DataFrame, total: int, slots: int) -> DataFrame:
    """source, j and slot for each slot of the schedule: that of the source's j-th block. shared: source and w above 0, which add up to total."""
    # in the order of names, null first
    one = shared.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "w"))).alias("all"))
    one = one.select("all", F.transform("all", lambda x: x["w"]).alias("ws"))
    start = "named_struct('k', transform(ws, w -> cast(0 as bigint)), 'picks', cast(array() as array<{}>))"
    pick = f"""array_min(filter(
        transform(ws, (w, i) -> named_struct('deadline', ((state.k[i] + 1) * {total} + w - 1) div w, 'i', i, 'release', (state.k[i] * {total}) div w)),
        b -> b.release <= t)).i"""
    after = "named_struct('k', transform(state.k, (k, i) -> k + if(i = pick, 1L, 0L)), 'picks', array_append(state.picks, pick))"
    # lists are copied when they grow: so chunk by chunk
    chunk = f"""aggregate(sequence(c * {CHUNK}L, least((c + 1) * {CHUNK}L, {slots}L) - 1), named_struct('k', done.k, 'picks', cast(array() as array<int>)),
        (state, t) -> transform(array({pick}), pick -> {after})[0])"""
    step = f"""flatten(aggregate(sequence(0L, {-(-slots // CHUNK)}L - 1), {start.format("array<int>")},
        (done, c) -> transform(array({chunk}), own -> named_struct('k', own.k, 'picks', array_append(done.picks, own.picks)))[0], done -> done.picks))"""
    picked = one.where("size(all) > 0").select("all", F.posexplode(F.expr(step)).alias("slot", "pick"))
    rows = picked.select(F.expr("all[pick].source").alias("source"), "pick", F.col("slot").cast("long").alias("slot"))
    return rows.withColumn("j", F.row_number().over(Window.partitionBy("pick").orderBy("slot")).cast("long") - 1).drop("pick")


def _place(rows: DataFrame, weights: dict[str | None, float] | None, block: int, slots: int, bucket: int) -> DataFrame:
    """rows (doc_id, source and, where rows are to be carried along, `row`) with slot and position."""
    sources = written(shares(rows.groupBy("source").agg(F.count("*").alias("n")), weights), "mixing-sources")
    weighed = sources.where("w > 0")
    whole = weighed.agg(F.sum("w").alias("w"), F.count("*").alias("m"), F.max(F.col("n") / F.col("w")).alias("most")).first()
    count, total, m = sources.agg(F.sum("n")).first()[0] or 0, whole["w"] or 0, whole["m"]
    if m:
        block = max(block, math.ceil(whole["most"] * total / min(slots, max(STEPS // m, 4 * m))))
    blocks = F.ceil(F.col("n") / block).cast("long")
    end = weighed.agg(F.max(F.expr(f"(ceil(n / {block}) * {total} + w - 1) div w"))).first()[0] or 0
    digits = 1
    while 16**digits * bucket < count:
        digits += 1
    # as a key that is never null, so that the joins need no other partitioning than the windows
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    h = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = rows.withColumns({"key": key, "h": h, "bucket": F.substring(h, 1, digits)})
    sizes = rows.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("key", "bucket").orderBy("h", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(own).cast("long") - 1).drop("h").join(starts, ["key", "bucket"])
    at = ranked.withColumn("at", F.col("before") + F.col("rank")).withColumns({"j": F.expr(f"at div {block}"), "rest": F.expr(f"at % {block}")})
    if end:
        # a row for each slot
        at = at.join(F.broadcast(timetable(weighed.select("source", "w"), total, end).select(key.alias("key"), "j", "slot")), ["key", "j"], "left")
    else:
        at = at.withColumn("slot", F.lit(None).cast("long"))
    last = Window.partitionBy().orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # over sources
    tails = sources.where("w = 0").select(key.alias("key"), (F.lit(end) + F.coalesce(F.sum(blocks).over(last), F.lit(0))).alias("tail"))
    slot = F.coalesce(F.col("slot"), F.col("tail") + F.col("j"))
    out = at.join(tails, "key", "left") if weights is not None else at.withColumn("tail", F.lit(None).cast("long"))
    return out.select("doc_id", "source", slot.alias("slot"), (slot * block + F.col("rest")).alias("position"), *(c for c in out.columns if c == "row"))


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, slot and position for each row of docs."""
    return _place(docs.select("doc_id", "source"), weights, block, slots, bucket)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS, bucket: int = BUCKET) -> DataFrame:
    """docs with slot and position, in the order of position. The rows move twice: to be numbered, and into the order."""
    names = [c for c in docs.columns if c not in ("slot", "position")]
    rows = docs.select("doc_id", "source", F.struct(*(docs[f"`{c}`"] for c in names if c not in ("doc_id", "source"))).alias("row"))
    out = _place(rows, weights, block, slots, bucket)
    out = out.select(*(c if c in ("doc_id", "source") else F.col("row").getField(c).alias(c) for c in names), "slot", "position")
    return out.repartitionByRange("position").sortWithinPartitions("position")


ORACLE = f"""
with recursive shared as (select source, count(*) as n, cast(greatest(1, round(sqrt(count(*)) * 1000)) as bigint) as w from documents group by source),
whole as (select cast(sum(w) as bigint) as total, count(*) as m, max(n / w) as most from shared),
sized as (select total, m, cast(greatest({BLOCK}, ceil(most * total / least({SLOTS}, greatest({STEPS} // m, 4 * m)))) as bigint) as size from whole),
fixed as (
  select list(w order by source nulls first) as ws, list(source order by source nulls first) as names, any_value(total) as total, any_value(m) as m, any_value(size) as size,
    max((cast(ceil(n / size) as bigint) * total + w - 1) // w) as slots
  from shared, sized
),
sched(t, k, pick) as (
  select cast(-1 as bigint), list_transform(ws, lambda w: cast(0 as bigint)), cast(0 as bigint) from fixed
  union all
  select t + 1, list_transform(range(1, m + 1), lambda i: k[i] + case when i = chosen then 1 else 0 end), chosen
  from (select t, k, m, list_min(list_filter(list_transform(range(1, m + 1),
            lambda i: case when (k[i] * total) // ws[i] <= t + 1 then (((k[i] + 1) * total + ws[i] - 1) // ws[i]) * 1000000 + i end),
          lambda x: x is not null)) % 1000000 as chosen
        from sched, fixed where t + 1 < slots)
),
times as (select names[pick] as source, t as slot, row_number() over (partition by pick order by t) - 1 as j from sched, fixed where t >= 0),
ranked as (select doc_id, source, row_number() over (partition by source order by coalesce(md5(cast(doc_id as varchar)), ''), doc_id) - 1 as at from documents)
select r.doc_id, r.source, cast(t.slot as bigint) as slot, cast(t.slot * size + r.at % size as bigint) as position
from ranked r join fixed on true join times t on r.source is not distinct from t.source and r.at // size = t.j
"""
