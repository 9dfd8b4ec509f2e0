"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, numbered, staged

BINS = 2048
#: Utility of a document by its words: scraps weigh less than full documents.
UTILITY = ((16, 0.5), (128, 0.8), (None, 1.0))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(digest: Column) -> Column:
    """Strictly between 0 and 1, from the first 48 bits of an md5."""
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def _class(size: Column) -> Column:
    return F.when(size < UTILITY[0][0], 0).when(size < UTILITY[1][0], 1).otherwise(2)


def _drawn(rows: DataFrame) -> DataFrame:
    """Adds rate, whole, part and q to rows with size, klass, rate_c and u."""
    utility = F.when(F.col("klass") == 0, UTILITY[0][1]).when(F.col("klass") == 1, UTILITY[1][1]).otherwise(UTILITY[2][1])
    rate = F.least(F.col("cap"), F.col("rate_c") * utility)
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    return rows.withColumn("q", F.when((F.col("part") > 1e-9) & (F.col("size") > 0), odds))


def targets(slim: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """For each source its size, target and rate, over rows with source, size and klass.

    Sources take the weights in the order of their code points, null last. One row a source: the two windows run
    over the list of sources, never over documents.
    """
    by = [F.sum(F.when(F.col("klass") == k, F.col("size")).otherwise(0)).cast("double").alias(f"s{k}") for k in range(3)]
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), *by)
    listed = ", ".join(str(float(w)) + "D" for w in weights)
    spark = slim.sparkSession
    # the level c solves sum(least(cap * size, c * weight)) = share * all: sources fill up in the order of cap * size / weight,
    # and of the levels that do not fill the source they start from, the largest counts the fewest as filled
    found = spark.sql(f"""
      with w as (select *, array({listed})[cast((row_number() over (order by source nulls last) - 1) % {len(weights)} as int)] as weight from {{sums}}),
      r as (select *, {cap} * source_size / weight as fill, {share} * sum(source_size) over () as want from w),
      k as (select *, want - coalesce(sum({cap} * source_size) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_want,
              sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as left_weight from r),
      c as (select *, max(case when left_want / left_weight <= fill then left_want / left_weight end) over () as level from k)
      select source, source_size, least({cap} * source_size, coalesce(level, {cap} * source_size) * weight) as target, s0, s1, s2 from c""", sums=sums)
    # the rate of copies of a document is least(cap, rate_c * utility), so that expected words meet the target
    return staged(found.selectExpr("source", "source_size", "cast(target as double) as target", f"cast({cap} as double) as cap", f"""case
        when source_size = 0 then 0D
        when target >= {cap} * source_size * (1 - 1e-12) then {2 * cap}D
        when target / (0.5D * s0 + 0.8D * s1 + s2) <= {cap} then target / (0.5D * s0 + 0.8D * s1 + s2)
        when s0 + s1 > 0 and (target - {cap} * s2) / (0.5D * s0 + 0.8D * s1) <= {cap} / 0.8D then (target - {cap} * s2) / (0.5D * s0 + 0.8D * s1)
        when s0 > 0 then (target - {cap} * s2 - {cap} * s1) / (0.5D * s0) else {cap / 0.8}D end as rate_c"""))


def cuts(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with the last rank that is taken (q_cut, g_cut) and the document that fits best into what is then left (g_fit).

    Ranks are first summed in bins; only the bin in which a source reaches its rest is put in order.
    """
    rows = _drawn(slim.join(sources, slim["source"].eqNullSafe(sources["source"])).drop(slim["source"]))
    rest = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    ranked = rows.filter("q is not null").withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    reach = staged(slim.sparkSession.sql("""
      with s as (select source, bin, words, sum(words) over (partition by source order by bin) as upto from {bins})
      select s.source, min(bin) filter (where upto > rest) as bin, coalesce(sum(words) filter (where upto <= rest), 0) as before, first(rest) as rest
      from s join {rest} r on s.source <=> r.source group by s.source""", bins=bins, rest=staged(rest)))
    near = ranked.drop("rest").join(reach, ranked["source"].eqNullSafe(reach["source"]) & (ranked["bin"] == reach["bin"])).select(reach["source"], "q", "g", "size", "before", "rest")
    cut = staged(slim.sparkSession.sql("""
      with t as (select *, before + sum(size) over (partition by source order by q, g) as upto from {near})
      select source as c_source, max(struct(q, g, upto)) filter (where upto <= rest) as cut from t group by source""", near=near))
    joined = sources.join(reach.select(F.col("source").alias("r_source"), "bin", "before", "rest", F.lit(True).alias("ranked")), F.expr("source <=> r_source"), "left").join(cut, F.expr("source <=> c_source"), "left")
    edge = F.col("bin").cast("double") / BINS
    found = staged(joined.select(
        *sources.columns,
        # without a cut inside the bin, what lies in earlier bins is taken
        F.when(F.col("ranked") & F.col("bin").isNull(), F.lit(float("inf"))).when(F.col("cut").isNotNull(), F.col("cut.q")).otherwise(edge / (1 - edge)).alias("q_cut"),
        F.when(F.col("cut").isNotNull(), F.col("cut.g")).otherwise("").alias("g_cut"),
        (F.col("rest") - F.coalesce("cut.upto", "before")).alias("left"),
    ))
    later = ranked.select("source", "q", "g", "size").join(found.select(F.col("source").alias("f_source"), "q_cut", "g_cut", "left"), F.expr("source <=> f_source")).filter("struct(q, g) > struct(q_cut, g_cut) and abs(size - left) < left")
    fit = later.groupBy("f_source").agg(F.min_by("g", F.struct(F.abs(F.col("size") - F.col("left")), "q", "g")).alias("g_fit"))
    return staged(found.join(fit, F.expr("source <=> f_source"), "left").select(*found.columns, "g_fit").drop("left"))


def mixed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Every row of rows (source, size, klass, u, g, ...) with its source's figures and ``copies``."""
    cut = cut.withColumnRenamed("source", "_source")
    out = _drawn(rows.join(cut, F.col("source").eqNullSafe(F.col("_source"))))
    extra = (F.col("q") < F.col("q_cut")) | ((F.col("q") == F.col("q_cut")) & (F.col("g") <= F.col("g_cut"))) | (F.col("q").isNotNull() & F.col("g").eqNullSafe(F.col("g_fit")))
    return out.withColumn("copies", F.col("whole") + F.coalesce(extra.cast("long"), F.lit(0)))


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size, klass and _k, which rows of one id, source and text share."""
    size = word_count(text)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = lambda c: F.col(c).isNull().cast("int").cast("string")
    same = F.md5(F.concat_ws(":", said("doc_id"), none("doc_id"), F.md5(said("source")), none("source"), F.md5(said(text)), none(text)))
    return docs.withColumn("size", size).withColumn("klass", _class(F.col("size"))).withColumn("_k", same)


def drawn(rows: DataFrame, repeated: DataFrame, seed: int) -> DataFrame:
    """Adds u and g, a random number and a rank for ties, from _k and the row's number among the rows that share it.

    ``repeated`` has the _k that more than one row has; only those rows are numbered, over as many tasks as it takes.
    """
    alone = rows.join(repeated, "_k", "left_anti").withColumn("_i", F.lit(0).cast("long"))
    many = staged(rows.join(repeated, "_k", "left_semi").withColumn("_tie", F.monotonically_increasing_id()))
    many = staged(numbered(many, "_k", "_tie").drop("_total", "_tie"))
    first = many.groupBy("_k").agg(F.min("_row").alias("_first"))
    many = many.join(first, "_k").withColumn("_i", F.col("_row") - F.col("_first")).drop("_row", "_first")
    out = alone.unionByName(many).withColumn("g", F.md5(F.concat_ws(":", "_k", F.col("_i").cast("string"), F.lit(str(seed)))))
    return out.withColumn("u", uniform(F.col("g"))).drop("_k", "_i")


def _plan(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The slim rows, the keys of repeated rows, and the cut of each source."""
    slim = staged(prepared(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "klass", "_k"))
    repeated = staged(slim.groupBy("_k").count().filter("count > 1").select("_k"))
    slim = staged(drawn(slim, repeated, seed))
    return slim, repeated, cuts(slim, targets(slim, weights, share, cap))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Each document first gets its certain whole copies; the fraction left over is its inclusion probability. Within
    a source the documents are ranked by random odds over inclusion odds, and the smallest ranks are taken as long as
    their words fit into what the certain copies left of the target. The last place goes to the document, of those that follow, whose
    words come nearest to what is then left, if that is nearer than none.
    Null texts have size 0 and are never taken; a null source is a source of its own. Rows of one id (a null one too), source
    and text are drawn each by itself, so any number of them meets the target; as they are alike, reruns agree on how many
    are taken. An empty table gives an empty result; other columns are not read.
    """
    slim, _, cut = _plan(docs, weights, share, cap, seed)
    return mixed(slim, cut).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 5) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of ``docs``."""
    columns = docs.columns
    _, repeated, cut = _plan(docs, weights, share, cap, seed)
    kept = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(columns)], F.col("source"), F.col("doc_id"), F.col("text"))
    out = mixed(drawn(prepared(kept).drop("text", "doc_id"), repeated, seed), cut).filter("copies > 0")
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(columns)], F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")


def oracle(weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 5) -> str:
    """DuckDB SQL for ``mix``."""
    low, middle = UTILITY[0], UTILITY[1]
    listed = ", ".join(str(float(w)) for w in weights)
    sums = ", ".join(f"sum(case when klass = {k} then size else 0 end)::double as s{k}" for k in range(3))
    return f"""
    with a as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
        md5(concat_ws(':', coalesce(doc_id::varchar, ''), (doc_id is null)::int, md5(coalesce(source, '')), (source is null)::int, md5(coalesce(text, '')), (text is null)::int)) as k from documents),
    b as (select *, md5(concat_ws(':', k, row_number() over (partition by k) - 1, '{seed}')) as g, case when size < {low[0]} then 0 when size < {middle[0]} then 1 else 2 end as klass from a),
    s as (select source, sum(size)::bigint as source_size, {sums} from b group by source),
    w as (select *, (list_value({listed}))[((row_number() over (order by source nulls last) - 1) % {len(weights)}) + 1]::double as weight from s),
    r as (select *, {cap} * source_size::double / weight as fill, {share} * (sum(source_size) over ())::double as want from w),
    l as (select *, want - coalesce(sum({cap} * source_size::double) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_want,
        sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as left_weight from r),
    c as (select *, max(case when left_want / left_weight <= fill then left_want / left_weight end) over () as level from l),
    t as (select *, least({cap} * source_size::double, coalesce(level, {cap} * source_size::double) * weight) as target from c),
    x as (select *, case when source_size = 0 then 0 when target >= {cap} * source_size::double * (1 - 1e-12) then {2 * cap}
        when target / (0.5::double * s0 + 0.8::double * s1 + s2) <= {cap} then target / (0.5::double * s0 + 0.8::double * s1 + s2)
        when s0 + s1 > 0 and (target - {cap}::double * s2) / (0.5::double * s0 + 0.8::double * s1) <= {cap}::double / 0.8::double then (target - {cap}::double * s2) / (0.5::double * s0 + 0.8::double * s1)
        when s0 > 0 then (target - {cap}::double * s2 - {cap}::double * s1) / (0.5::double * s0) else {cap / 0.8} end::double as rate_c from t),
    d as (select b.*, source_size, target, least({cap}::double, rate_c * case klass when 0 then {low[1]}::double when 1 then {middle[1]}::double else 1 end) as rate, (('0x' || substr(g, 1, 12))::bigint + 0.5::double) / {2**48}::double as u from b join x on b.source is not distinct from x.source),
    e as (select *, floor(rate + 1e-9)::bigint as whole, rate - floor(rate + 1e-9) as part from d),
    f as (select *, case when part > 1e-9 and size > 0 then (u / (1 - u)) / (part / (1 - part)) end as q, target - sum(whole * size) over (partition by source) as rest from e),
    h as (select *, sum(case when q is null then 0 else size end) over (partition by source order by q nulls last, g rows unbounded preceding) as upto from f),
    i as (select *, rest - coalesce(max(case when q is not null and upto <= rest then upto end) over (partition by source), 0) as left_over from h),
    j as (select *, row_number() over (partition by source order by case when q is not null and upto > rest and abs(size - left_over) < left_over then 0 else 1 end, abs(size - left_over), q, g) as place from i)
    select doc_id, size, source_size, target, ((whole + case when q is not null and (upto <= rest or place = 1 and abs(size - left_over) < left_over) then 1 else 0 end) * size)::bigint as taken from j"""
