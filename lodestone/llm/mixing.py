"""Mixing sources to target weights by Pfair scheduling (operator 4), DataFrame functions only.

Rows of a source form blocks. The k-th block of a lane that has q of the D
slots of a cycle is released at slot floor(k * D / q) and due by
ceil((k + 1) * D / q); each slot goes to the released block that is due
first. As the shares sum to one, every block meets its window, so that at any
slot a lane is less than one block away from its target.

A source with a share of 1 / 256 or more is a lane of its own. Smaller ones
share a lane with those of the same binary order of magnitude, in which their
blocks come by deadline. So the schedule has at most 256 lanes and one for each
order of magnitude, however many sources there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import table
from lodestone.session import materialise

BLOCK_ROWS = 64
#: Slots of a cycle: shares are rounded to these by largest remainders.
CYCLE = 4096
#: A lane of its own from one in so many.
OWN_LANE = 256
#: Default weights are counts to this power.
EXPONENT = 0.5
#: Rows, or blocks, that one window task ranks, about.
RANK_ROWS = 4_096
#: Sources whose table of counts is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Lane of the sources without a weight.
_NO_WEIGHT = -1000


def source_shares(docs: DataFrame, source: str = "source", targets: dict[str | None, float] | None = None, exponent: float = EXPONENT) -> DataFrame:
    """``(source, n, w, i, lane)``: rows, whole-number weight, index and lane of each source.

    Without ``targets`` a weight is the count to the power ``exponent``. A
    source that ``targets`` leaves out, or gives no positive weight, shares
    one slot of a cycle with all such sources, as no row is dropped.
    """
    n = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.greatest(F.lit(1), F.round((F.sqrt("n") if exponent == 0.5 else F.pow(F.col("n"), F.lit(exponent))) * 1024))
    else:
        named = {k: float(w) for k, w in targets.items() if w > 0}
        unit = 2.0**40 / max(sum(named.values()), 1e-300)
        named = {k: max(1, round(w * unit)) for k, w in named.items()}
        given = F.from_json(F.lit(json.dumps({str(k): w for k, w in named.items() if k is not None})), "map<string,bigint>")
        weight = F.when(F.col("source").isNull(), F.lit(named.get(None, 0))).otherwise(F.coalesce(F.try_element_at(given, F.col("source").cast("string")), F.lit(0)))
    n = n.withColumn("w", weight.cast("long")).withColumn("key", F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")))
    # The index is the place among the digests of the names: ranked in parts, so that any number of sources will do.
    n = n.withColumn("part", F.substring(F.md5(F.col("key").cast("binary")), 1, 3))
    ahead = n.groupBy("part").agg(F.count("*").alias("c")).select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("ahead"))
    n = n.join(F.broadcast(ahead), "part").withColumn("i", F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(F.md5(F.col("key").cast("binary")), "key")) - 1)
    n = n.join(F.broadcast(n.agg(F.sum("w").alias("total"))))
    lane = F.when(F.col("w") == 0, F.lit(_NO_WEIGHT)).when(F.col("w") * OWN_LANE >= F.col("total"), F.col("i")).otherwise(-F.length(F.bin(F.expr("total div w"))))
    return n.select("source", "n", "w", "i", lane.cast("long").alias("lane"))


def lane_shares(shares: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """``(lane, w, q, j)``: weight, slots in a cycle and index of each lane; at most ``OWN_LANE`` and 64 rows."""
    lanes = shares.groupBy("lane").agg(F.sum("w").alias("w"))
    lanes = lanes.join(F.broadcast(lanes.agg(F.sum("w").alias("total"))))
    share = F.lit(cycle).cast("long") * F.col("w")
    lanes = lanes.withColumn("least", F.when(F.col("total") > 0, F.floor(F.expr(f"({cycle}L * w) div total"))).otherwise(0)).withColumn("over", F.when(F.col("total") > 0, share % F.col("total")).otherwise(0))
    all_ = Window.partitionBy()
    lanes = lanes.withColumn("spare", F.greatest(F.lit(0), F.lit(cycle) - F.sum(F.greatest(F.lit(1), "least")).over(all_)))
    rank = F.row_number().over(Window.orderBy((F.col("least") == 0).cast("int"), F.desc("over"), "lane"))
    extra = F.when((rank <= F.col("spare")) & (F.col("least") > 0), 1).otherwise(0)
    lanes = lanes.withColumn("q", (F.greatest(F.lit(1), "least") + extra).cast("long"))
    return lanes.select("lane", "w", "q", (F.row_number().over(Window.orderBy("lane")) - 1).alias("j"))


def cycle_schedule(lanes: DataFrame) -> DataFrame:
    """``(j, k, slot)`` of the blocks of one cycle: one row for each of its slots, ``CYCLE`` and one for each lane at most."""
    one = lanes.agg(F.sum("q").alias("d"), F.transform(F.sort_array(F.collect_list(F.struct("j", "q"))), lambda x: x["q"]).alias("q")).filter("d > 0")
    # Earliest deadline first among the released blocks; of equal ones the lower index.
    pick = """array_min(filter(transform(acc.k, (k, j) ->
        if(k < q[j] and (k * d) div q[j] <= t, named_struct('due', ((k + 1) * d + q[j] - 1) div q[j], 'j', j), null)), x -> x is not null)).j"""
    step = f"""transform(array({pick}), p -> named_struct(
        'k', transform(acc.k, (k, j) -> k + if(j = p, 1L, 0L)), 'out', concat(acc.out, array(p))))[0]"""
    start = "named_struct('k', transform(q, x -> 0L), 'out', cast(array() as array<int>))"
    folded = one.select(F.expr(f"aggregate(sequence(0L, d - 1), {start}, (acc, t) -> {step}).out").alias("out"))
    slots = folded.select(F.posexplode("out").alias("slot", "j"))
    return slots.select("j", (F.row_number().over(Window.partitionBy("j").orderBy("slot")) - 1).cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def _running(df: DataFrame, by: list[str], part: str, order: list[Column | str], size: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` ahead of a row among those of its ``by``, with no window over more than a ``part``."""
    sums = df.groupBy(*by, part).agg(F.sum(size).alias("_sum"))
    sums = sums.select(*by, part, (F.sum("_sum").over(Window.partitionBy(*by).orderBy(part)) - F.col("_sum")).alias("_ahead"))
    df = df.withColumn("_in", F.sum(size).over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    return df.join(sums, [*by, part]).withColumn("before", F.col("_ahead") + F.col("_in")).drop("_ahead", "_in")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", targets: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, exponent: float = EXPONENT, cycle: int = CYCLE, shares: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with ``block, slot, position``, every row once.

    ``position`` is dense from 0. Rows of a source come in the order of the MD5
    digest of ``key`` and the other columns, cut into blocks of ``block_rows``.
    A null source is a source of its own; null and repeated keys keep their
    places, rows equal in all columns in any order. Columns may have any names.
    Where a source has run out, its slots stay idle, and the others keep their
    proportions. There may be any number of sources; a lane's share is rounded
    to slots of a cycle, so that it is off by less than one slot in ``cycle``,
    and lanes smaller than a slot get one. An empty table gives an empty one.

    A source is ranked in parts of about ``RANK_ROWS`` rows, so a hot one is
    spread over many tasks, and so are blocks; positions follow from the sums
    over parts, with no global window.
    """
    shares = materialise(source_shares(docs, source, targets, exponent), "mix-shares") if shares is None else shares
    lanes = materialise(lane_shares(shares, cycle), "mix-lanes")
    schedule = F.broadcast(materialise(cycle_schedule(lanes), "mix-cycle"))
    few = shares.count() <= BROADCAST_SOURCES
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    names = [key, *(c for c in docs.columns if c != key)]
    rows = rows.withColumn("digest", F.md5(F.concat_ws("|", *(F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit("")) for c in names)).cast("binary")))
    sizes = shares.select("source", "i", F.ceil(F.col("n") / RANK_ROWS).alias("parts"))
    rows = rows.join(F.broadcast(sizes) if few else sizes, F.col(f"row.`{source}`").eqNullSafe(F.col("source")))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("parts")).cast("int"))
    parts = rows.groupBy("i", "part").agg(F.count("*").alias("size"))
    parts = parts.withColumn("start", F.sum("size").over(Window.partitionBy("i").orderBy("part")) - F.col("size"))

    # Blocks: each is made by the part in which it begins, ranked in its lane by deadline, and given a slot and a first position.
    known = shares.select("i", "n", "w", "lane")
    begun = parts.join(F.broadcast(known) if few else known, "i").withColumn("first", F.ceil(F.col("start") / block_rows)).withColumn("last", F.ceil((F.col("start") + F.col("size")) / block_rows) - 1)
    blocks = begun.filter("first <= last").select("i", "n", F.greatest("w", F.lit(1)).alias("w"), "lane", F.explode(F.sequence("first", "last")).alias("block"))
    blocks = blocks.join(F.broadcast(lanes.select("lane", "j", "q", F.greatest(F.col("w"), F.lit(1)).alias("lane_w"))), "lane").withColumn("due", (F.col("block") + 1) / F.col("w"))
    blocks = blocks.withColumn("bin", F.floor(F.col("due") * F.col("lane_w") / RANK_ROWS))
    blocks = _running(blocks.select("i", "n", "block", "j", "q", "due", "bin"), ["j"], "bin", ["due", "i"], F.lit(1)).withColumn("k", F.col("before") % F.col("q"))
    turn = F.expr("before div q")
    d = F.broadcast(lanes.agg(F.sum("q").alias("d")))
    blocks = blocks.join(schedule, ["j", "k"]).join(d).select("i", "block", (turn * F.col("d") + F.col("slot")).alias("slot"), F.least(F.lit(block_rows), F.col("n") - F.col("block") * block_rows).alias("rows"))
    placed = blocks.withColumn("bin", F.expr(f"slot div {RANK_ROWS}"))
    ahead = placed.groupBy("bin").agg(F.sum("rows").alias("_sum"), (F.min("bin") % 1024).alias("low"), F.floor(F.min("bin") / 1024).alias("high"))
    ahead = _running(ahead, [], "high", ["bin"], F.col("_sum")).select("bin", F.col("before").alias("_ahead"))
    inside = F.sum("rows").over(Window.partitionBy("bin").orderBy("slot")) - F.col("rows")
    placed = placed.withColumn("_in", inside).join(ahead, "bin").select("i", "block", "slot", (F.col("_ahead") + F.col("_in")).alias("begin"))

    # Each part of rows gets the blocks that it touches, as an array from its first one on.
    touched = parts.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_rows}"), F.expr(f"(start + size - 1) div {block_rows}"))))
    touched = touched.join(placed, ["i", "block"]).groupBy("i", "part").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("block", "slot", "begin"))).alias("blocks"))
    inside = F.row_number().over(Window.partitionBy("i", "part").orderBy("digest")) - 1
    rows = rows.select("row", "digest", "i", "part").withColumn("inside", inside).join(touched, ["i", "part"]).withColumn("rank", F.col("start") + F.col("inside"))
    at = F.element_at("blocks", (F.expr(f"rank div {block_rows}") - F.expr(f"start div {block_rows}") + 1).cast("int"))
    rows = rows.select("row", "rank", at.alias("b"))
    return rows.select("row", "b.block", "b.slot", (F.col("b.begin") + F.col("rank") % block_rows).alias("position"))


def in_order(mixed: DataFrame, total: int) -> DataFrame:
    """The mixed rows with their own columns: ``position`` ascends within each of the partitions and from one to the next."""
    parts = max(1, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    to = F.least(F.floor(F.col("position") * parts / max(1, total)), F.lit(parts - 1)).cast("int")
    return mixed.repartitionById(parts, to).sortWithinPartitions("position").select("row.*")


def laid_out(docs: DataFrame, source: str = "source", targets: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` in the order of their mix, columns as they were."""
    shares = materialise(source_shares(docs, source, targets), "mix-shares")
    total = shares.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return in_order(mix(docs, source=source, shares=shares), total)


def as_laid(docs: DataFrame) -> DataFrame:
    """Rows of a table read from files, in the order in which ``in_order`` laid them out.

    A scan deals out files by size. Here a row's place is the count of rows in
    the files before its own, by number of part, and its index in its file;
    partitions take equal ranges of places.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("index"))
    name = F.substring_index("path", "/", -1)
    number = F.regexp_extract(name, r"^part-(\d+)", 1)
    before = Window.orderBy(F.length(number), name, "path").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("path").agg(F.count("*").alias("size"))
    files = files.select("path", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("total"))
    rows = rows.join(F.broadcast(files), "path").withColumn("place", F.col("start") + F.col("index"))
    to = F.floor(F.col("place") * parts / F.col("total")).cast("int")
    return rows.repartitionById(parts, to).sortWithinPartitions("place").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of its sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("row.doc_id", "row.source", "block", "slot", "position")


SQL = f"""
with recursive n as (select source, count(*) as n from documents group by 1),
named as (select source, n, greatest(1, cast(round(sqrt(n) * 1024) as bigint)) as w, coalesce('1' || source, '0') as key from n),
s as (
  select source, n, w, row_number() over (order by md5(key), key) - 1 as i, (select cast(sum(w) as bigint) from named) as total from named
), lane_of as (
  select *, case when w * {OWN_LANE} >= total then i else -length(bin(total // w)) end as lane from s
), l as (
  select lane, cast(sum(w) as bigint) as w, (select cast(sum(w) as bigint) from s) as total from lane_of group by 1
), floors as (
  select lane, w, ({CYCLE} * w) // total as least, ({CYCLE} * w) % total as over from l
), ranked as (
  select *, row_number() over (order by least = 0, over desc, lane) as rnk, (select greatest(0, {CYCLE} - sum(greatest(1, least))) from floors) as spare from floors
), lanes as (
  select lane, cast(greatest(1, least) + case when rnk <= spare and least > 0 then 1 else 0 end as bigint) as q, row_number() over (order by lane) as j from ranked
), f as (select cast(sum(q) as bigint) as d, list(q order by j) as qs from lanes),
c(t, ks, pick) as (
  select cast(0 as bigint), list_transform(qs, lambda x: cast(0 as bigint)), cast(0 as bigint) from f
  union all
  select t + 1, list_transform(ks, lambda k, j: case when j = p then k + 1 else k end), p
  from (
    select t, ks, list_min(list_transform(ks, lambda k, j:
      case when k < qs[j] and (k * d) // qs[j] <= t then (((k + 1) * d + qs[j] - 1) // qs[j]) * 1000000 + j end)) % 1000000 as p
    from c, f where t < d)
), slots as (
  select b.t as slot, a.pick as j, b.ks[a.pick] as k from c b join c a on a.t = b.t + 1
), r as (
  select doc_id, source, row_number() over (partition by source order by md5(concat_ws('|', coalesce(cast(doc_id as varchar), ''), coalesce(source, '')))) - 1 as rnk from documents
), x as (
  select doc_id, r.source, rnk, rnk // {BLOCK_ROWS} as block, i, lane from r join lane_of o on r.source is not distinct from o.source
), b as (
  select o.i, o.lane, u.block, (u.block + 1) / o.w as due, least({BLOCK_ROWS}, o.n - {BLOCK_ROWS} * u.block) as size
  from lane_of o, unnest(range((o.n - 1) // {BLOCK_ROWS} + 1)) as u(block)
), in_lane as (
  select b.*, lanes.q, lanes.j, row_number() over (partition by b.lane order by due, i) - 1 as rnk from b join lanes on b.lane = lanes.lane
), placed as (
  select i, block, size, (rnk // q) * d + slot as slot from in_lane join slots on in_lane.j = slots.j and in_lane.rnk % q = slots.k, f
), began as (select i, block, slot, sum(size) over (order by slot) - size as begin from placed)
select doc_id, source, x.block, cast(slot as bigint) as slot, cast(begin + rnk % {BLOCK_ROWS} as bigint) as position
from x join began on x.i = began.i and x.block = began.block
"""
