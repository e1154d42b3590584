"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due floor(target / source size) certain whole copies. The words that these leave are drawn by
inclusion probabilities p that, times sizes, sum to them: equal ones inside a source, or in proportion to ``weight``, where documents that would
pass 1 are certain, too, and taken off first. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a uniform number from a
hash of the document's id, and the lowest ranked are taken until the words are used up: a sample of fixed size. Where all p of a source are equal, as in the query
that has no weight, this is the order of u.

The cut is found without ranking a source in one task: ranks fall into fixed buckets, words are summed by (source,
bucket) before the shuffle, a running sum over at most ``BUCKETS`` rows finds the bucket that holds the cut, and only that bucket's
documents are ordered exactly.

Defined results: a null text has size 0; size-0 documents are taken 0 words; a null source is a source of its own, last;
an empty table gives an empty result; documents of one id rank by their texts' hashes; repeated rows and all else that ties in rank, id and hash are taken or left together; a very
long text counts as one size, and the cut may miss the target by half of it; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, count_words, field, materialize

BUCKETS = 1 << 14
#: Up to this many sources the table of cuts, a few numbers each, is broadcast; beyond it the join shuffles ids and numbers.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, source: str, size: str, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """A row for each source: source, source_size, target.

    Targets share ``share`` of all words by weight; the weights repeat in code-point order of the sources, null last.
    A target stops at ``most`` times its source's size; what it leaves is shared again by weight. In the order of
    size / weight the stopped sources come first, so running sums over the sources' summary rows give the result at once.
    """
    by = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("_size"))
    order = Window.orderBy(F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    by = by.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    by = by.withColumn("_cap", F.col("_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy(F.lit(0))
    before = Window.orderBy("_ratio", F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_size").over(whole) * F.lit(float(share))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    by = by.withColumn("_left", left).withColumn("_weight", weight)
    by = by.withColumn("_stopped", F.col("_left") * F.col("_w") > F.col("_cap") * F.col("_weight"))
    # the first source that isn't stopped has what is left for all from there on
    first = F.min_by(F.struct("_left", "_weight"), F.when(~F.col("_stopped"), F.col("_ratio"))).over(whole)
    by = by.withColumn("_rest", first)
    target = F.when(F.col("_stopped"), F.col("_cap")).otherwise(F.least(F.col("_rest._left") * F.col("_w") / F.col("_rest._weight"), F.col("_cap")))
    return by.select("_source", F.col("_size").alias("_source_size"), F.coalesce(target, F.lit(0.0)).alias("_target"))


def _numbers(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None) -> DataFrame:
    """id, size, source, bits, tie and odds of each row: all that selection needs. Texts are read for this once, and shuffled never."""
    return docs.select(
        F.col(id_col).alias("id"), count_words(F.col(text_col)).alias("size"), F.col(source_col).alias("source"),
        _bits(F.col(id_col), seed).alias("bits"), F.xxhash64(F.col(text_col)).alias("tie"), _odds(weight).alias("odds"),
    )


def _bits(id_col: Column, seed: int) -> Column:
    """52 random bits, a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def _odds(weight: Column | None) -> Column:
    """Relative inclusion odds: 1 for all without a weight; what is null, not a number or not positive counts as a billionth."""
    if weight is None:
        return F.lit(1.0)
    w = weight.cast("double")
    return F.when((w > 1e-9) & (w < float("inf")), w).otherwise(F.lit(1e-9))


def inclusion(numbers: DataFrame, targets: DataFrame, broadcast: bool) -> DataFrame:
    """targets with scale: a row's inclusion probability is the least of 1 and scale * odds, so that these probabilities times sizes sum to the words that whole copies leave.

    Rows whose product passes 1 are certain and taken off, which raises the scale for the others; this is repeated until no further row is certain. Each
    round is one sum by source over numbers; there are as many as there are steps in which rows become certain.
    """
    rest = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    sources = targets.withColumn("due", F.when(F.col("source_size") > 0, rest).otherwise(F.lit(0.0))).withColumn("scale", F.lit(0.0)).withColumn("certain", F.lit(-1).cast("long"))
    while True:
        t = sources.withColumnRenamed("source", "source_t")
        rows = numbers.join(F.broadcast(t) if broadcast else t, F.col("source").eqNullSafe(F.col("source_t")))
        sure = F.col("scale") * F.col("odds") >= 1
        own = rows.groupBy("source").agg(
            F.sum(F.when(sure, F.col("size")).otherwise(F.lit(0))).alias("taken"), F.count_if(sure & (F.col("size") > 0)).alias("now"),
            F.sum(F.when(sure, F.lit(0.0)).otherwise(F.col("odds") * F.col("size"))).alias("left"),
        ).withColumnRenamed("source", "source_o")
        more = sources.join(own, F.col("source").eqNullSafe(F.col("source_o")), "left")
        scale = F.when(F.col("left") > 0, F.greatest(F.col("due") - F.col("taken"), F.lit(0.0)) / F.col("left")).otherwise(F.col("scale"))
        more = materialize(more.select("source", "source_size", "target", "due", F.greatest(scale, F.col("scale")).alias("scale"), F.coalesce("now", F.lit(0)).alias("certain"), (F.coalesce("now", F.lit(0)) != F.col("certain")).alias("moved")))
        sources, going = more.drop("moved"), more.where("moved").isEmpty()
        if going:
            return sources.select("source", "source_size", "target", "scale")


def _ranked(numbers: DataFrame, targets: DataFrame, broadcast: bool) -> DataFrame:
    """Rows with what their source is due (sure copies), their rank and its bucket; numbers: source, bits and odds."""
    t = targets.withColumnRenamed("source", "source_t")
    t = F.broadcast(t) if broadcast else t
    out = numbers.join(t, F.col("source").eqNullSafe(F.col("source_t")), "left").drop("source_t")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate).withColumn("sure", F.floor("rate"))
    # without unequal odds (scale is null) every row of a source has the same probability
    p = F.when(F.col("scale").isNull(), F.col("rate") - F.col("sure")).otherwise(F.least(F.lit(1.0), F.col("scale") * F.col("odds")))
    u = (F.col("bits").cast("double") + 0.5) / F.lit(float(1 << 52))
    # random odds over inclusion odds; a probability of 0 ranks last, one of 1 first
    rank = F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    # q / (1 + q) keeps the order and lies in 0..1
    return out.withColumn("rank", F.coalesce(rank / (1 + rank), F.lit(1.0))).withColumn("bucket", F.least((F.col("rank") * BUCKETS).cast("int"), F.lit(BUCKETS - 1)))


def _cuts(numbers: DataFrame, share: float, most: float, weights: tuple[int, ...], unequal: bool) -> tuple[DataFrame, bool]:
    """A row for each source: source, source_size, target, scale and where its sample ends (cut_bucket; cut_rank, cut_id, cut_tie in it), and whether it is small enough to broadcast."""
    targets = materialize(source_targets(numbers, "source", "size", share, most, weights).select(F.col("_source").alias("source"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target")))
    small = targets.count() <= BROADCAST_SOURCES
    targets = inclusion(numbers, targets, small) if unequal else targets.withColumn("scale", F.lit(None).cast("double"))
    ranked = _ranked(numbers, targets, small)
    sums = ranked.where("rank < 1").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("sure").alias("sure"))
    running = Window.partitionBy("source").orderBy("bucket")
    due = F.col("target") - F.col("sure") * F.col("source_size")
    sums = sums.withColumn("upto", F.sum("words").over(running)).withColumn("due", due)
    edge = sums.where("upto >= due").groupBy("source").agg(F.min(F.struct("bucket", (F.col("due") - F.col("upto") + F.col("words")).alias("due"))).alias("e"))
    edge = materialize(edge.select(F.col("source").alias("edge_source"), F.col("e.bucket").alias("cut_bucket"), F.col("e.due").alias("cut_due")))
    joined = F.broadcast(edge) if small else edge
    inside = ranked.join(joined, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("cut_bucket")))
    exact = Window.partitionBy("source").orderBy("rank", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("size").over(exact))
    # a document stays if more than half of it lies before the cut
    cut = inside.where("upto - size / 2 <= cut_due").groupBy(F.col("source").alias("cut_source")).agg(F.max(F.struct("rank", "id", "tie")).alias("c"))
    cuts = edge.join(cut, F.col("edge_source").eqNullSafe(F.col("cut_source")), "left").select("edge_source", "cut_bucket", F.col("c.rank").alias("cut_rank"), F.col("c.id").alias("cut_id"), F.col("c.tie").alias("cut_tie"))
    return materialize(targets.join(cuts, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")), small


def _copies(numbers: DataFrame, cuts: DataFrame, small: bool, empty: Column) -> DataFrame:
    """Rows with copies, source_size and target; numbers: id, source, bits, tie, odds and whatever ``empty`` looks at."""
    out = _ranked(numbers, cuts, small)
    names = ("a", "b", "c")
    key, last = (F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names))) for columns in (("rank", "id", "tie"), ("cut_rank", "cut_id", "cut_tie")))
    more = (F.col("rank") < 1) & (F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.col("cut_rank").isNotNull() & (key <= last)))
    return out.withColumn("copies", F.when(empty, F.lit(0)).otherwise(F.col("sure") + more.cast("long")).cast("long"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, share: float, most: float, weights: tuple[int, ...], weight: Column | None) -> DataFrame:
    """row (a struct of all columns of docs), source_size, target and copies."""
    numbers = materialize(_numbers(docs, id_col, text_col, source_col, seed, weight))
    cuts, small = _cuts(numbers, share, most, weights, weight is not None)
    rows = docs.select(F.struct("*").alias("row"), _odds(weight).alias("odds"))
    text = field(text_col)
    rows = rows.select("row", "odds", field(id_col).alias("id"), field(source_col).alias("source"), _bits(field(id_col), seed).alias("bits"), F.xxhash64(text).alias("tie"))
    wordless = ~F.coalesce(F.rlike(text, F.lit(WORD_PATTERN)), F.lit(False))  # stops at the first word
    return _copies(rows, cuts, small, wordless)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), weight: Column | None = None) -> DataFrame:
    """The columns of docs, then _source_size, _target and __copies, the number of times that the mix takes the document.

    ``weight``: a column of docs' that tells relative inclusion odds inside a source, positive and finite (null: all equal).
    Texts are never shuffled: the numbers decide, and the table of cuts joins by source.
    """
    m = _mixed(docs, id_col, text_col, source_col, seed, share, most, weights, weight)
    return m.select("row.*", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies").alias("__copies"))


def mixed_report(docs: DataFrame, seed: int = 7, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), weight: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, copies; from the numbers alone, so texts are read once."""
    numbers = materialize(_numbers(docs, "doc_id", "text", "source", seed, weight))
    cuts, small = _cuts(numbers, share, most, weights, weight is not None)
    m = _copies(numbers, cuts, small, F.col("size") == 0)
    return m.select(F.col("id").alias("doc_id"), "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it; those taken no time go."""
    m = _mixed(docs, "doc_id", "text", "source", 7, 1.5, 2.0, (3, 1, 2), None).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")).select("row.*")


def mixing_sql(seed: int = 7) -> str:
    """The report in DuckDB's SQL, each source ranked as a whole."""
    return rf"""
        with d as (
            select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                (cast(('0x' || substr(md5('{seed}:' || doc_id), 1, 13)) as bigint) + 0.5::double) / {1 << 52}::double as u
            from documents
        ), w as (
            select source, cast(sum(size) as bigint) as source_size, [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as w
            from d group by source
        ), c as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / w as ratio from w),
        r as (
            select *, sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0) as rest, sum(w) over () - coalesce(sum(w) over before, 0) as weight
            from c window before as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)
        ), o as (select *, rest * w > cap * weight as stopped from r),
        f as (select rest, weight from o where not stopped order by ratio, source is null, source limit 1),
        t as (
            select source, source_size, coalesce(case when stopped then cap else least((select rest from f) * w / (select weight from f), cap) end, 0) as target from o
        ), x as (
            select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate
            from d join t on d.source is not distinct from t.source
        ), y as (select *, floor(rate) as sure, rate - floor(rate) as p from x),
        q as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as odds from y),
        z as (select *, coalesce(odds / (1 + odds), 1) as rank, target - sure * source_size as due from q),
        s as (select *, sum(size) over (partition by source order by rank, doc_id rows unbounded preceding) as upto from z),
        m as (select *, case when size = 0 then 0 else cast(sure as bigint) + case when rank < 1 and upto - size / 2 <= due then 1 else 0 end end as copies from s)
        select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, cast(copies as bigint) as copies from m"""
