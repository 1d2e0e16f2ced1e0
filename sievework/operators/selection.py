"""Deduplication, quotas, samples and decontamination joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.hash_rank import hash_rank
from sievework.operators.key_filter import rows_in
from sievework.operators.word_rarity import enough, set_prefixes, word_rarity
from sievework.session import stage


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in order. An aggregate of minima, so a hot key is reduced before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    front = order + [c for c in rest if c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*front)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def drop_conflicts(df: DataFrame, key: Column, label: str, order: list[str]) -> DataFrame:
    """One row a key (`key`), none for keys whose rows differ in label; null keys are left out."""
    rows = df.withColumn("key", key).where("key IS NOT NULL")
    same = rows.groupBy("key").agg(F.min(label).alias("_a"), F.max(label).alias("_b"), F.min(F.struct(*order)).alias("_r")).where("_a <=> _b")
    return same.select("key", F.col("_a").alias(label), *[f"_r.{c}" for c in order])


def cap_per(df: DataFrame, keys: list[str], n: int, id_col: str, seed: int = 0) -> DataFrame:
    """At most n rows of each key, the first in the order of a seeded hash. A hash range of the key that surely holds n rows
    is found from counts by the hash's leading bits, so whatever lies beyond falls away before anything is sorted: about n
    rows of a key reach its window, however many it has."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    # the hash in its order, cut into 64 ranges an octave: ranges near the start are fine, as a hot key needs few of its rows
    rows = df.withColumn("_h", F.shiftrightunsigned(h, 1))
    rows = rows.withColumn("_range", F.floor(F.log2(F.col("_h") + 1.0) * 64))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).where(F.col("_b") < n).groupBy(*keys).agg(F.max("_range").alias("_last"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    kept = rows.alias("a").join(last.alias("b"), on & (F.col("a._range") <= F.col("b._last"))).select("a.*")
    whole = Window.partitionBy(*keys).orderBy("_h", id_col)
    return kept.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= n).drop("_h", "_range", "_n")


def round_robin(df: DataFrame, source: str, order: list[str], quota: int, source_cap: int) -> DataFrame:
    """Rows taken one from each source in turn (sources in sorted order) until quota; a source gives at most source_cap.
    A quota and a cap bound what the final ordering sees."""
    w = Window.partitionBy(source).orderBy(*order)
    rows = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= source_cap)
    return rows.orderBy("turn", source).limit(quota)


def exact_overlap(evals: DataFrame, train: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    """(id, source): evaluation rows whose normalised text stands in training, with the least source that has it."""
    known = train.select(T.overlap_key(F.col(text)).alias("key"), F.col(source).alias("source")).where("key IS NOT NULL").groupBy("key").agg(F.min("source").alias("source"))
    return evals.select(F.col(id_col).alias("id"), T.overlap_key(F.col(text)).alias("key")).where("key IS NOT NULL").join(known, "key").select("id", "source")


def segments(df: DataFrame, id_col: str, text: str, least: int = 8, prefix: int = 200) -> DataFrame:
    """(id, key): digests of a text's lines of at least `least` characters, and of the first `prefix` characters of long texts."""
    n = T.norm_gold(F.col(text))
    parts = F.transform(F.split(F.col(text), "[\\r\\n]+"), lambda s: T.norm_gold(s))
    long = F.when(F.length(n) >= prefix, F.array(F.concat(F.lit("p:"), F.substring(n, 1, prefix)))).otherwise(F.array().cast("array<string>"))
    lines = F.transform(F.filter(F.array_append(parts, n), lambda s: F.length(s) >= least), lambda s: F.concat(F.lit("s:"), s))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.concat(lines, long))).alias("seg")).select("id", F.md5("seg").alias("key"))


def near_duplicates(left: DataFrame, right: DataFrame, id_col: str, sets: str | Column, threshold: float = 0.8, least: int = 5) -> DataFrame:
    """(id_a, id_b, jaccard): pairs of a left and a right row whose string sets are at least `threshold` similar, both of at
    least `least` members; ids are unique on each side. Members are ordered by how common they are; a pair must share one of
    each side's rarest n - ceil(threshold n) + 1, so only the hashes of these are shuffled and joined, with a bound on
    positions. The rows of candidates alone are fetched, and their sets compared exactly; give sets as an expression, so that
    they are made after the filter there."""
    own = F.col(sets) if isinstance(sets, str) else sets
    both, other = (x.select(F.lit(i).alias("side"), F.col(id_col).alias("id"), own.alias("s")) for i, x in enumerate((left, right)))
    both = both.unionByName(other)
    kind = both.schema["id"].dataType.simpleString()
    rarity = word_rarity(both.select(F.col("s").alias("text")))
    signed = both.mapInArrow(set_prefixes(rarity, threshold), f"side int, id {kind}, n int, prefix array<bigint>").where(F.col("n") >= least)
    keys = signed.select("side", "id", "n", F.posexplode("prefix").alias("at", "key"))
    a = keys.where("side = 0").select("key", F.col("id").alias("id_a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    b = keys.where("side = 1").select("key", F.col("id").alias("id_b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    common = enough(F.col("na"), F.col("nb"), threshold)
    near = a.join(b, "key").where((F.col("na") - F.col("ia") >= common) & (F.col("nb") - F.col("ib") >= common)).select("id_a", "id_b").distinct()
    near = stage(near, "near-sets")
    wanted = (stage(near.select(F.col(c).alias(id_col)).distinct(), "near-ids") for c in ("id_a", "id_b"))
    of_a, of_b = (rows_in(x, id_col, w).select(F.col(id_col).alias(c), own.alias(v)) for x, w, c, v in zip((left, right), wanted, ("id_a", "id_b"), ("sa", "sb"), strict=True))
    pairs = near.join(of_a, "id_a").join(of_b, "id_b")
    return pairs.withColumn("jaccard", T.jaccard(F.col("sa"), F.col("sb"))).where(F.col("jaccard") >= threshold).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with a reason) of records with state, question, choices, gold, probs, kind."""
    p, n = F.col("probs"), F.size("choices")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    reason = (
        F.when(F.col("state").isNull() | (F.trim("state") == ""), "blank state").when(F.trim("question") == "", "blank question")
        .when(F.exists("choices", lambda c: c.isNull() | (F.trim(c) == "")), "blank option").when(p.isNull(), "no probabilities").when(F.size(p) != n, "lengths differ")
        .when(~F.col("gold").between(0, n - 1), "gold out of range").when(F.exists(p, lambda x: (x < 0) | (x > 1)), "probability out of range")
        .when((F.col("kind") != "rank") & (F.abs(total - 1) > 1e-3), "sum is not 1").when((F.col("kind") == "verify") & (n != 2), "verify needs 2 options")
        .when(F.col("none_idx").isNotNull() & ~F.col("none_idx").between(0, n - 1), "none option out of range")
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def contained(evals: DataFrame, train: DataFrame, longer_than: int = 18, gram: int = 9) -> DataFrame:
    """(id_e, id_t): evaluation texts of more than longer_than characters that stand inside a training text; both tables are
    (id, text) with single blanks. A word inside the evaluation text, its longest but for the first and last, is a whole word
    of whatever holds it, so the join is on that word; texts of one or two words are joined on the first characters of
    their longer word, against the character grams of long words. Candidates are compared exactly, none is dropped."""
    e = evals.where(F.length("text") > longer_than).select(F.col("id").alias("id_e"), F.col("text").alias("e"), F.split("text", " ").alias("w"))
    longest = lambda a: F.element_at(F.array_sort(a, lambda x, y: F.length(y) - F.length(x)), 1)
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    e = e.withColumn("anchor", F.when(F.size("w") >= 3, F.concat(F.lit("w:"), longest(inner))).otherwise(F.concat(F.lit("g:"), F.substring(longest(F.col("w")), 1, gram))))
    t = train.select(F.col("id").alias("id_t"), F.col("text").alias("t"), F.array_distinct(F.split("text", " ")).alias("w"))
    grams = F.flatten(F.transform(F.filter("w", lambda x: F.length(x) >= gram), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - gram + 1), lambda i: F.concat(F.lit("g:"), F.substring(x, i, F.lit(gram))))))
    keys = F.array_distinct(F.concat(F.transform("w", lambda x: F.concat(F.lit("w:"), x)), grams))
    near = t.select("id_t", F.explode(keys).alias("anchor")).join(e.select("id_e", "anchor"), "anchor").select("id_e", "id_t").distinct()
    pairs = near.join(e.select("id_e", "e"), "id_e").join(t.select("id_t", "t"), "id_t")
    return pairs.where(F.contains("t", F.col("e"))).select("id_e", "id_t")


def command_overlap(evals: DataFrame, train: DataFrame, id_col: str, text: str, least: int = 10) -> DataFrame:
    """(id_e, id_t): training texts that equal an evaluation text after normalisation, hold one of more than 18 characters, or
    whose sets of at least 4 tokens are 0.8 similar. Texts of at most `least` characters and nulls are left out."""
    e, t = (x.select(F.col(id_col).alias("id"), T.norm_agent(F.col(text)).alias("text")).where(F.length("text") > least) for x in (evals, train))
    equal = e.withColumnRenamed("id", "id_e").join(t.withColumnRenamed("id", "id_t"), "text").select("id_e", "id_t")
    near = near_duplicates(e, t, "id", F.array_distinct(T.tokens(F.col("text"))), 0.8, 4).select(F.col("id_a").alias("id_e"), F.col("id_b").alias("id_t"))
    return equal.unionByName(contained(e, t)).unionByName(near).distinct()


def owners(sets: list[tuple[str, DataFrame]], id_col: str) -> DataFrame:
    """(id_col, owner, n_sets): each id of some sets once, with the first set that has it and how many do."""
    rows = [s.select(id_col, F.lit(k).alias("_k"), F.lit(name).alias("_name")) for k, (name, s) in enumerate(sets)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy(id_col).agg(F.min(F.struct("_k", "_name")).alias("_o"), F.countDistinct("_k").alias("n_sets")).select(id_col, F.col("_o._name").alias("owner"), "n_sets")


def first_by(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in order. The rank limit is pushed below the shuffle, so a hot key sends at most n rows a
    task on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """df with the place of each row in the order of a unique column, from 0: rows are range-partitioned, and counts of the
    parts before are added to ranks within one."""
    parts = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parts = stage(parts, "numbered")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def sized_places(df: DataFrame, size: str, id_col: str) -> DataFrame:
    """df with `upto`: the sizes of all rows up to it in the order of size and id. What smaller sizes sum up to comes from counts
    by size, of which there are few; ranks within one size from hash_rank, so neither is a window over all rows."""
    counts = df.groupBy(size).agg((F.count(F.lit(1)) * F.first(size)).alias("_sum"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    ranked = hash_rank(df, size, id_col)
    return ranked.join(before, size).withColumn("upto", F.col("_before") + F.col(size) * F.col("rank")).drop("_before", "rank")


def weighted_choice(df: DataFrame, id_col: str, weights: DataFrame, name: str, weight: str, salt: str, most: int = 10_000) -> DataFrame:
    """df with one of the names of weights for each row, drawn by a salted hash of its id with the weights given; at most `most`
    names, more are an error, so the cumulated weights travel as one broadcast row."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(weight).cast("double").alias("w"))))
    bound = F.assert_true(F.count(F.lit(1)) <= most, F.lit(f"more than {most} names"))
    table = weights.limit(most + 1).agg(listed.alias("_t"), F.sum(weight).alias("_n"), bound.alias("_ok")).where("_ok IS NULL").drop("_ok")
    u = F.conv(F.substring(F.sha1(F.concat(F.lit(salt + ":"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("pick"))
    step = lambda a, x: F.struct((a["upto"] + x["w"]).alias("upto"), F.coalesce(a["pick"], F.when(F.col("_u") < a["upto"] + x["w"], x["name"])).alias("pick"))
    rows = df.crossJoin(F.broadcast(table)).withColumn("_u", u * F.col("_n"))
    return rows.withColumn(name, F.aggregate("_t", start, step, lambda a: a["pick"])).drop("_t", "_n", "_u")


def read_replies(reply: Column, n: Column, kind: Column) -> Column:
    """struct(ids, values, reason) of a teacher's reply, which should be JSON, perhaps with other text around it, with a list `top` of
    pairs of an option's number and its probability. reason is null for a good one, else the first thing wrong with it."""
    made = F.from_json(T.lenient_json(reply), "top array<array<double>>")

    def judged(r: Column) -> Column:
        top = r["top"]
        ids, values = F.transform(top, lambda x: F.get(x, F.lit(0))), F.transform(top, lambda x: F.get(x, F.lit(1)))
        mass = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        reason = (
            F.when(r.isNull(), "not JSON").when(top.isNull() | (F.size(top) == 0), "no list").when(F.exists(top, lambda x: x.isNull() | (F.size(x) != 2)), "bad pair")
            .when(F.exists(ids, lambda i: i.isNull() | (i != F.floor(i)) | (i < 0) | (i >= n)) | (F.size(F.array_distinct(ids)) < F.size(ids)), "bad option")
            .when(F.exists(values, lambda v: v.isNull() | (v < 0) | (v > 1)), "bad probability").when((kind != "rank") & ~mass.between(0.5, 1.02), "bad mass")
        )
        return F.struct(F.transform(ids, lambda i: i.cast("int")).alias("ids"), values.alias("values"), reason.alias("reason"))

    return F.element_at(F.transform(F.array(made), judged), 1)
