"""Mixing sources to target weights with a low-discrepancy schedule (operator 7), SQL functions only.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1 in turn and share all
   words; a target stops at three times its source's size and the excess is shared again by
   weight until none is above (closed form: ``sources``).
2. Schedule: the mix has N slots of one block each, a block being the words of the mix over SLOTS,
   rounded up. Slot t draws the t-th van der Corput point (t's bits reversed, as a
   fraction), and the point falls into one source's interval of the cumulative targets.
   The first N points give a source its share but for a few slots, and so does every
   stretch of the schedule. Slots are ranked within their source.
3. Blocks: a source's documents, shuffled by a hash, form a stream that may be read up to
   three times and is cut into blocks of equal words; the slot of rank k reads block k.
4. A document's taken words are its words in drawn blocks. What a source gives is what its
   slots drew, not its target; the two differ by some blocks, each at most a millionth of the mix (or
   one word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pursewise.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Slots of a mix at most (a mix of fewer words has a slot a word): the schedule has one size for
#: all corpora, and a block grows with them.
SLOTS = 1 << 20
SEED = "mix-1"
#: Running sums are taken per (source, hash bucket), then over the buckets of a source.
BUCKETS = 4096
#: Slots are ranked within runs of this many schedule positions.
RUN = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and the shuffle key of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _key().alias("key"))


def _key():
    """Place in the shuffle: by id and text, so rows that share an id do not share a place."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                             F.coalesce(F.md5("text"), F.lit("null"))))


def sources(rows: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target, cap, block (words), slots (of the mix), its
    interval of the grid of ``2 ** bits`` points as first_slot and n_slots, and bits.

    The windows run over one row per source (the table of sources, after aggregation).
    With caps of three times the size, the capped sources are a prefix in the order of
    cap / weight; the rest shares what the caps leave.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(x) for x in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))))
    per = per.withColumn("weight", w.cast("long")).withColumn("cap", MAX_PASSES * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # shared so far by the sources capped before this one, and the weight that is left
    per = (per.withColumn("total", F.sum("source_size").over(whole))
           .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("capped", F.col("weight") * F.col("left") > F.col("cap") * F.col("weights")))
    # the first source that is not capped fixes the level of all after it
    per = per.withColumn("place", F.row_number().over(by_ratio))
    level = F.min(F.when(~F.col("capped"), F.struct("place", "left", "weights"))).over(whole)
    per = per.withColumn("level", level)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weights"))
    per = per.withColumn("target", target)
    per = per.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("cap")))
    # the mix: words, words of a block, slots, and the grid that its points lie on
    per = per.withColumn("words", F.sum("quota").over(whole))
    per = per.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("words") / SLOTS)).cast("long"))
    per = per.withColumn("slots", F.ceil(F.col("words") / F.col("block")).cast("long"))
    per = per.withColumn("bits", F.when(F.col("slots") > 1, F.length(F.bin(F.col("slots") - 1))).otherwise(F.lit(0)))
    per = per.withColumn("upto", F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def border(words):  # the first point of the grid at or above this share of the mix
        at = words.cast("double") * F.pow(F.lit(2.0), "bits") / F.col("words").cast("double")
        return F.when(F.col("words") > 0, F.ceil(at)).otherwise(F.lit(0)).cast("long")

    first = border(F.col("upto") - F.col("quota"))
    return per.select("source", "source_size", "target", "cap", "block", "slots", first.alias("first_slot"),
                      (border(F.col("upto")) - first).alias("n_slots"), "bits")


def schedule(per: DataFrame) -> DataFrame:
    """slot (place in the mix), source, rank (0 up within the source): the low-discrepancy order.

    The points of a source's interval are generated from its own row: point g of the grid is
    drawn by slot bitreverse(g), if the mix has so many slots.
    """
    # runs keep the arrays small
    spans = per.where("n_slots > 0").select(
        "source", "first_slot", "n_slots", "bits", "slots",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / RUN))).alias("run"))
    at = F.explode(F.sequence(F.col("first_slot") + F.col("run") * RUN,
                              F.col("first_slot") + F.least((F.col("run") + 1) * RUN, F.col("n_slots")) - 1))
    points = spans.repartition("source", "run").select("source", "bits", "slots", at.alias("grid_at"))
    slot = F.when(F.col("bits") > 0, F.conv(F.reverse(F.lpad(F.bin("grid_at"), F.col("bits"), "0")), 2, 10)).otherwise("0")
    points = points.withColumn("slot", slot.cast("long")).where("slot < slots").select("source", "slot")
    # rank within the source: count of the earlier runs, then within the run
    points = points.withColumn("run", F.floor(F.col("slot") / RUN))
    runs = points.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"),
                       (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    return (points.withColumn("inside", inside)
            .join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
            .select("slot", "source", (F.col("earlier") + F.col("inside")).alias("rank")))


def streams(rows: DataFrame) -> DataFrame:
    """Rows with ``start``: the words of the shuffled source before the document.

    Two steps, so that no task holds a source: sums per (source, hash bucket), running sums
    over at most BUCKETS of them, then within a bucket.
    """
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    per = per.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                     (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
            .join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .withColumn("start", F.col("earlier") + F.col("inside")).drop("s", "b", "earlier", "inside", "bucket"))


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents in their streams, sources, schedule); the texts are read once."""
    rows = stored(sizes(docs), "mix-sizes")
    per = stored(sources(rows), "mix-sources")
    return streams(rows), per, stored(schedule(per), "mix-schedule")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: slot, source, doc_id, key, pass_no, words, one row per document part.

    ``words`` of the document are read at ``slot``; the parts of a slot are one block.
    """
    return _parts(*_planned(docs))


def _parts(placed: DataFrame, per: DataFrame, plan: DataFrame) -> DataFrame:
    drawn = plan.groupBy("source").agg(F.count(F.lit(1)).alias("drawn")).withColumnRenamed("source", "ds")
    q = per.join(drawn, F.col("source").eqNullSafe(F.col("ds"))).select(
        F.col("source").alias("qs"), "source_size", F.col("block").alias("width"),
        F.least(F.col("drawn") * F.col("block"), F.col("cap")).alias("ends"))
    rows = placed.join(q, F.col("source").eqNullSafe(F.col("qs"))).where("size > 0")
    # passes that reach this document before the source's drawn blocks end
    rows = rows.withColumn("pass_no", F.explode(F.filter(
        F.array(*[F.lit(p) for p in range(MAX_PASSES)]),
        lambda p: p * F.col("source_size") + F.col("start") < F.col("ends"))))
    rows = rows.withColumn("lo", F.col("pass_no") * F.col("source_size") + F.col("start"))
    rows = rows.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("ends")))
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr("lo div width"), F.expr("(hi - 1) div width"))))
    words = F.least(F.col("hi"), (F.col("block") + 1) * F.col("width")) - F.greatest(F.col("lo"), F.col("block") * F.col("width"))
    parts = rows.select("doc_id", "key", "size", "source", "start", "pass_no", "block", words.alias("words"))
    slots = plan.select("slot", F.col("source").alias("ss"), F.col("rank"))
    return parts.join(slots, F.col("source").eqNullSafe(F.col("ss")) & (F.col("block") == F.col("rank"))).drop("ss", "rank")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    ``taken`` sums the words the drawn blocks read from the document (0 to three times
    its size). A null text has size 0 and is never taken; a null source is the last source;
    repeated rows (one id, one text) stand next to each other in the shuffle and stay separate rows; a very long text
    spans many blocks and counts whole; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    placed, per, plan = _planned(docs)
    # a row's place in its stream tells repeated rows apart
    taken = (_parts(placed, per, plan).groupBy("source", "start", "size", "key").agg(F.sum("words").alias("taken"))
             .select(F.col("source").alias("ts"), F.col("start").alias("t0"), F.col("size").alias("tn"),
                     F.col("key").alias("tk"), "taken"))
    q = per.select(F.col("source").alias("qs"), "source_size", "target")
    out = (placed.join(taken, F.col("source").eqNullSafe(F.col("ts")) & (F.col("start") == F.col("t0"))
                       & (F.col("size") == F.col("tn")) & (F.col("key") == F.col("tk")), "left")
           .join(q, F.col("source").eqNullSafe(F.col("qs"))))
    return out.select("doc_id", "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, each as often as a pass reads it, in the
    order of the schedule: a copy stands at the slot that reads the pass's first words of it.

    A pass that reads a part of a document (the last of a source) takes the whole document;
    repeated rows of one id and text share their passes evenly. Written out, the files hold the
    slots in order. The documents travel as one value, so their columns may have any names.
    """
    placed, per, plan = _planned(docs)
    parts = _parts(placed, per, plan)
    slots = [F.min(F.when(F.col("pass_no") == p, F.col("slot"))) for p in range(MAX_PASSES)]
    read = parts.groupBy("source", "key").agg(F.sum("words").alias("words"), F.array(*slots).alias("slots"))
    like = placed.where("size > 0").groupBy(F.col("source").alias("ls"), F.col("key").alias("lk")).agg(F.sum("size").alias("n"))
    times = (read.join(like, F.col("source").eqNullSafe(F.col("ls")) & (F.col("key") == F.col("lk")))
             .select(F.col("source").alias("ts"), F.col("key").alias("tk"), "slots",
                     F.ceil(F.col("words") / F.col("n")).cast("int").alias("times")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key().alias("key"))
    out = rows.join(times, F.col("doc.source").eqNullSafe(F.col("ts")) & (F.col("key") == F.col("tk")))
    out = out.select("doc", "key", F.posexplode(F.slice("slots", F.lit(1), F.col("times"))).alias("copy", "slot"))
    return out.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key", "copy").select("doc.*")


#: The same rows in DuckDB SQL: the points of all slots counted by interval, then a document's part
#: of the full passes and of the last one.
_REVERSED = " + ".join(f"(((t >> {i}) & 1) << {19 - i})" for i in range(20))
ORACLE = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
             md5('{SEED}:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(md5(text), 'null')) as k from documents),
s as (select source, sum(size)::bigint as n from d group by source),
o as (select source, n, 3 * n as cap,
        (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as w from s),
c as (select *, sum(n) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as ws
      from (select source, n, cap, w from o)),
e as (select *, w * rest > cap * ws as capped from c),
v as (select rest, ws from e where not capped order by cap / w, source nulls last limit 1),
t as (select e.source, e.n, e.cap, case when capped then cap::double else (w * v.rest)::double / v.ws::double end as target
      from e left join v on true),
q as (select *, least(floor(target + 0.5)::bigint, cap) as quota from t),
m as (select *, (sum(quota) over ())::bigint as words,
        (sum(quota) over (order by source nulls last rows between unbounded preceding and current row))::bigint as upto from q),
w as (select max(words) as words, greatest(1, (max(words) + {SLOTS - 1}) // {SLOTS}) as block from m),
points as (select {_REVERSED} as g from range({SLOTS}) r(t), w where t < (w.words + w.block - 1) // w.block),
drawn as (select m.source, count(*) as slots from points join m on
        g >= ceil((upto - quota)::double * {SLOTS} / words::double) and g < ceil(upto::double * {SLOTS} / words::double) group by m.source),
l as (select m.source, m.n, m.target, least(coalesce(drawn.slots, 0) * (select block from w), m.cap) as ends
      from m left join drawn on m.source is not distinct from drawn.source),
p as (select d.*, coalesce(sum(size) over (partition by source order by k, size rows between unbounded preceding and 1 preceding), 0) as start from d)
select p.doc_id, p.size, l.n as source_size, l.target,
  (case when l.n = 0 then 0 else p.size * (l.ends // l.n)
     + greatest(0, least(p.start + p.size, l.ends % l.n) - p.start) end)::bigint as taken
from p join l on p.source is not distinct from l.source
"""
