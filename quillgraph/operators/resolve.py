"""Resolution of records across sources: blocked candidate pairs, the same-work predicate, and clusters by first leader.

A record joins the earliest leader that it matches; a record that matches none is a leader. That order dependence is kept
without collecting anything: rounds of joins decide every record whose earlier matches are all decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import identity as I
from quillgraph.functions import text as T
from quillgraph.operators.graph import checkpointed

FIELDS = ("aliases", "key", "tokens", "surnames", "year")
SOURCE_RANK = ("openalex", "arxiv", "semanticscholar")


def described(records: DataFrame, *carried: str) -> DataFrame:
    """pos, what is carried and what the predicate needs, of records with pos, id, title, authors, year and the alias fields url, doi."""
    # Long words first: they are rare ones as a rule, which keeps blocks small. Any order would do.
    words = F.transform(F.array_distinct(T.tokens(F.coalesce("title", F.lit("")))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    tokens = F.transform(F.array_sort(words), lambda x: x["w"])
    return records.select(
        "pos", *carried, I.aliases(F.col("id").cast("string"), F.col("url"), F.col("doi")).alias("aliases"), I.key(F.col("title"), F.col("id").cast("string")).alias("key"), tokens.alias("tokens"),
        F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.lower(I.surname(a))).alias("surnames"), "year",
    )


def blocks(d: DataFrame, few: bool) -> DataFrame:
    """pos, block: aliases, keys, and surname with title word, with `few` only of the words of which one is shared.

    Of the smaller title at most 12 % of the words may miss in the other, so one of its first words beyond that number is shared.
    """
    by = lambda column, tag: d.select("pos", F.explode(column).alias("x")).select("pos", F.concat(F.lit(tag), "x").alias("block"))
    words = F.slice("tokens", 1, (F.floor(F.size("tokens") * 0.12) + 1).cast("int")) if few else F.col("tokens")
    named = d.where(F.size("tokens") >= 6).select("pos", F.explode(F.array_distinct("surnames")).alias("name"), "tokens").select("pos", "name", F.explode(words).alias("word"))
    return by("aliases", "a").unionByName(by(F.array("key"), "k")).unionByName(named.select("pos", F.concat_ws("\x01", F.lit("n"), "name", "word").alias("block")))


def candidate_pairs(d: DataFrame) -> DataFrame:
    """a < b, positions of all pairs that some branch of the predicate could accept."""
    pairs = blocks(d, True).join(blocks(d, False).withColumnRenamed("pos", "other"), "block").where("pos <> other")
    return pairs.select(F.least("pos", "other").alias("a"), F.greatest("pos", "other").alias("b")).distinct()


def agrees() -> Column:
    """The predicate on the structs ra and rb."""
    return I.same_work({n: F.col(f"ra.{n}") for n in FIELDS}, {n: F.col(f"rb.{n}") for n in FIELDS})


def matches(records: DataFrame) -> DataFrame:
    """a < b of the pairs that are one work."""
    d = checkpointed(described(records))
    side = lambda tag: d.select(F.col("pos").alias(tag), F.struct(*FIELDS).alias(f"r{tag}"))
    pairs = candidate_pairs(d).join(side("a"), "a").join(side("b"), "b")
    return pairs.where(agrees()).select("a", "b")


def leaders(positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pos, leader: each position's earliest matching leader, itself if there is none."""
    pairs = checkpointed(pairs)
    free = positions.join(pairs.select(F.col("b").alias("pos")).distinct(), "pos", "left_anti").withColumn("leader", F.col("pos"))
    done = checkpointed(free)
    left = checkpointed(pairs.select(F.col("b").alias("pos")).distinct())
    while not left.isEmpty():
        seen = pairs.join(left, F.col("b") == F.col("pos"), "left_semi").join(done.select(F.col("pos").alias("a"), F.col("leader").alias("of")), "a", "left")
        # An earlier match that leads itself is a leader; an undecided one before it holds the decision up.
        first = seen.groupBy(F.col("b").alias("pos")).agg(F.min(F.when(F.col("of") == F.col("a"), F.col("a"))).alias("lead"), F.min(F.when(F.col("of").isNull(), F.col("a"))).alias("open"))
        decided = first.where(F.col("open").isNull() | (F.col("lead") < F.col("open"))).select("pos", F.coalesce("lead", "pos").alias("leader"))
        decided = checkpointed(decided)
        done = checkpointed(done.unionByName(decided))
        left = checkpointed(left.join(decided, "pos", "left_anti"))
    return done


def dedup(records: DataFrame) -> DataFrame:
    """One row a work: the record of the best source (then the first), and all its versions.

    Records that the predicate cannot tell apart go by their first: a group of copies makes no pairs.
    """
    same = checkpointed(described(records))
    first = same.groupBy(*FIELDS).agg(F.min("pos").alias("rep"))
    alike = F.lit(True)
    for f in FIELDS:
        alike = alike & same[f].eqNullSafe(first[f])
    named = checkpointed(same.join(first, alike).select("pos", "rep"))
    reps = named.where("pos = rep").select("pos")
    of_rep = leaders(reps, matches(records.join(reps, "pos", "left_semi")))
    led = named.join(of_rep.withColumnsRenamed({"pos": "rep"}), "rep").select("pos", "leader")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCE_RANK)), F.col("source")), F.lit(0)), F.lit(len(SOURCE_RANK) + 1))
    joined = records.join(led, "pos")
    versions = F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id"), "source")))
    return joined.groupBy("leader").agg(F.min_by(F.struct("id", "source", "title"), F.struct(rank, "pos")).alias("best"), versions.alias("versions")).select("best.id", "best.source", "best.title", F.size("versions").alias("n_versions"), "versions")


def incoming(held: DataFrame, returned: DataFrame, seen: DataFrame, most: int = 100_000) -> DataFrame:
    """src, dst: links from held works to the targets that records citing them were returned for.

    `held` has the fields of `described` with pos as the work; `returned` those with pos as the record, and target. A record links only if it is one
    work with exactly one held work other than its target; `seen` (src, dst) are left out.

    Works are counted by alias, by key and by profile (all fields but the aliases, of which the namespaces are kept); records meet these counts, never the
    works. Of a count the first and the last work are enough: a record that matches three is never unique. What an alias, the key and a close
    profile match differs, as namespaces and keys do, but several aliases may be one work's. Counts by key go to all tasks if they are `most` at most.
    """
    counts = [F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")]
    # No condition on computed columns: Spark would compute them again for it, and explode_outer infers none.
    h, r = (described(x, *more).withColumn("spaces", I.spaces_mask(F.col("aliases"))) for x, more in ((held, ()), (returned, ("target",))))
    of_key = h.groupBy("key", "spaces").agg(*counts).select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("apart")).where(F.col("spaces").bitwiseAND(F.col("apart")) == 0)
    by_key = checkpointed(of_key.groupBy("key", F.col("apart").alias("spaces")).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")))
    if by_key.count() <= most:
        by_key = F.broadcast(by_key)
    rows = r.select("pos", "target", "aliases", "key", "spaces").join(by_key, ["key", "spaces"], "left").where("n IS NULL OR n <= 2")
    by_alias = h.select("pos", F.explode_outer("aliases").alias("alias")).groupBy("alias").agg(*(c.alias(f"alias_{x}") for c, x in zip(counts, ("n", "first", "last"), strict=True)))
    # A record without aliases goes by its number, so that these don't meet in one task.
    named = rows.select("pos", "target", "n", "first", "last", F.explode_outer("aliases").alias("alias")).where("alias IS NOT NULL OR n IS NOT NULL").withColumn("alias", F.coalesce("alias", F.concat(F.lit("#"), F.col("pos").cast("string"))))
    known = named.join(by_alias, "alias", "left").where("n IS NOT NULL OR alias_n IS NOT NULL").select("pos", "target", F.greatest("n", "alias_n").alias("n"), F.array("first", "last", "alias_first", "alias_last").alias("works"))
    near = rows.select("pos", "target").join(_close_counts(h.where(F.size("surnames") > 0), r.where(F.size("surnames") > 0), counts), "pos").select("pos", "target", "n", F.array("first", "last").alias("works"))
    found = known.unionByName(near).groupBy("pos", "target").agg(F.max("n").alias("n"), F.array_compact(F.array_distinct(F.flatten(F.collect_list("works")))).alias("works"))
    others = found.where((F.col("n") <= 2) & (F.size("works") <= 2)).select("target", F.filter("works", lambda w: w != F.col("target")).alias("works")).where(F.size("works") == 1)
    return others.select(F.get("works", F.lit(0)).alias("src"), F.col("target").alias("dst")).distinct().join(seen.select("src", "dst"), ["src", "dst"], "left_anti")


def _close_counts(h: DataFrame, r: DataFrame, counts: list[Column]) -> DataFrame:
    """pos of records, n, first and last of the works that match by close titles. Works and records of one profile are one class."""
    profile = ("key", "tokens", "surnames", "year", "spaces")
    long = F.size("tokens") >= 6
    works = checkpointed(h.where(long).groupBy(*profile).agg(*counts).withColumn("pos", F.col("first")))
    asked = checkpointed(r.where(long).groupBy(*profile).agg(F.min("pos").alias("pos")))
    of_names = lambda d, few: blocks(d.withColumn("aliases", F.array().cast("array<string>")), few).where(F.col("block").startswith("n"))
    pairs = lambda few: of_names(asked, few).withColumnRenamed("pos", "a").join(of_names(works, not few).withColumnRenamed("pos", "b"), "block").select("a", "b")
    side = lambda d, tag, *more: d.select(F.col("pos").alias(tag), F.struct(*profile).alias(f"r{tag}"), *more)
    both = pairs(True).unionByName(pairs(False)).distinct().join(side(asked, "a"), "a").join(side(works, "b", "n", "first", "last"), "b")
    ra, rb = ({n: F.col(f"{x}.{n}") for n in profile} for x in ("ra", "rb"))
    fits = (ra["spaces"].bitwiseAND(rb["spaces"]) == 0) & ~F.coalesce(ra["key"] == rb["key"], F.lit(False)) & I.close(ra, rb)
    found = both.where(fits).groupBy("a").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    alike = F.lit(True)
    for f in profile:
        alike = alike & r[f].eqNullSafe(asked[f])
    return r.join(asked.join(found, asked["pos"] == found["a"], "left_semi").select(F.col("pos").alias("a"), *profile), alike).select(r["pos"], "a").join(found, "a").select("pos", "n", "first", "last")
