"""Matching of records to works: gold matches, twins, nearest neighbours, repairs, as-of joins, greedy assignment, approvals."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from quillgraph.functions import citations as C
from quillgraph.functions import identity as I
from quillgraph.operators import retrieval as RT
from quillgraph.operators.graph import checkpointed

# Thresholds of matches, words that write, ways to name a work's page.
GOLD_TITLE, TWIN_TITLE, TWIN_WORDS, CONTAINED = 0.82, 0.85, 4, 0.7
#: Nearest neighbours are looked for down to these similarities, in turn.
NEAR = (0.7, 0.5, 0.3, 0.0)
WRITES = r"(?i)\b(CREATE|MERGE|DELETE|SET|REMOVE|DROP|DETACH|LOAD|CALL|FOREACH|USING|GRANT|REVOKE|DENY|START|ALTER|RENAME)\b"


def _of_longer(both, na, nb):
    return both / (F.greatest(na, nb) if isinstance(na, Column) else max(na, nb))


def _of_shorter(both, na, nb):
    return both / (F.least(na, nb) if isinstance(na, Column) else min(na, nb))


def gold_matches(gold: DataFrame, works: DataFrame, least: float = GOLD_TITLE) -> DataFrame:
    """a_id, b_id, score: the best work for each gold record (id, doi, arxiv, words): 1 by DOI or arXiv id, else the titles' Jaccard from `least` on; ties go to the smaller id.

    Null identifiers match nothing; records without words match by identifiers only.
    """
    exact = [gold.select(F.col("id").alias("a_id"), name).join(works.select(F.col("id").alias("b_id"), name), name).select("a_id", "b_id", F.lit(1.0).alias("score")) for name in ("doi", "arxiv")]
    found = exact[0].unionByName(exact[1]).unionByName(RT.closest(gold, works, RT.by_jaccard, lambda s: s >= least))
    best = found.groupBy("a_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "b_id")).alias("best"))
    return best.select("a_id", "best.b_id", (-F.col("best.s")).alias("score"))


def title_twins(asked: DataFrame, works: DataFrame, least: float = TWIN_TITLE, words: int = TWIN_WORDS) -> DataFrame:
    """a_id, b_id: the smallest work id whose title shares more than `least` of the longer title's words with one of `words` words at least."""
    return RT.closest(asked.where(F.size("words") >= words), works, _of_longer, lambda s: s > least, ranked=False).select("a_id", "b_id")


def contained_titles(asked: DataFrame, works: DataFrame, least: float = CONTAINED) -> DataFrame:
    """a_id, b_id: the work by DOI, else that whose title holds most of the smaller title's words, more than `least` of them."""
    by_doi = asked.join(works.select(F.col("id").alias("b_id"), "doi"), "doi").groupBy(F.col("id").alias("a_id")).agg(F.min("b_id").alias("b_id"))
    rest = asked.join(by_doi, F.col("id") == F.col("a_id"), "left_anti")
    return by_doi.unionByName(RT.closest(rest, works, _of_shorter, lambda s: s > least).select("a_id", "b_id"))


def nearest(asked: DataFrame, others: DataFrame) -> DataFrame:
    """a_id, b_id, jaccard: the most similar other row by Jaccard of words; ties go to the smaller id. Rows that share no word with any have none."""
    left, found = asked, None
    # Most rows have a near neighbour; only those without one look further.
    for least in NEAR:
        part = RT.closest(left, others, RT.by_jaccard, lambda s, least=least: s >= least if least else s > 0, apart=True)  # noqa: B023
        part = checkpointed(part.withColumnRenamed("score", "jaccard"))
        found = part if found is None else found.unionByName(part)
        left = left.join(part, F.col("id") == F.col("a_id"), "left_anti")
        if left.isEmpty():
            break
    return found


def stated_works(references: DataFrame, held: DataFrame) -> DataFrame:
    """id, dst of references (id, raw) that state the arXiv id or DOI of a held work (dst, title, stated).

    Of several works with one id those count whose title the reference holds; where it holds none of them, all do.
    """
    works = held.select("stated", "dst", I.title_key(F.col("title")).alias("title")).distinct()
    shared = works.groupBy("stated").agg(F.count_distinct("dst").alias("works"))
    found = references.select("id", "raw", C.stated_id(F.col("raw")).alias("stated"))
    single = found.join(works.join(shared.where("works = 1"), "stated"), "stated").select("id", "dst")
    several = found.join(works.join(shared.where("works > 1"), "stated"), "stated")
    several = several.withColumn("named", F.coalesce((F.col("title") != "") & I.title_key(F.col("raw")).contains(F.col("title")), F.lit(False)))
    by_raw = several.groupBy("id", "raw").agg(F.collect_set(F.struct("dst", "named")).alias("works")).select("id", "works", F.exists("works", lambda w: w["named"]).alias("any"))
    chosen = by_raw.select("id", "any", F.explode("works").alias("w")).where("w.named OR NOT any").select("id", "w.dst")
    return single.unionByName(chosen)


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """left with `value`: that of the last row of right with the same `by` not later than left's time; of equal times the larger value. Null where there is none.

    One shuffle by key and time order; rows of right come before those of left at the same time.
    """
    l = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(by, time, F.lit(0).alias("__side"), F.col(value).alias("__value"))
    order = W.partitionBy(by).orderBy(time, "__side", F.asc_nulls_first("__value")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("__value", ignorenulls=True).over(order))
    return both.where("__side = 1").drop("__side", "__value")


def greedy_assignment(scores: DataFrame) -> DataFrame:
    """ci, li of scores (ci, li, score: a small table, communities by labels): the best pair is taken, then the best of what is left; ties go to larger ci, then li."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, used_c, used_l = [], set(), set()
        for r in rows.sort_values(["score", "ci", "li"], ascending=False).itertuples():
            if r.ci not in used_c and r.li not in used_l:
                out.append((r.ci, r.li))
                used_c.add(r.ci)
                used_l.add(r.li)
        return pd.DataFrame(out, columns=["ci", "li"])

    return scores.select(F.lit(0).alias("all"), "ci", "li", "score").groupBy("all").applyInPandas(run, "ci long, li long")


def first_owner(pairs: DataFrame) -> DataFrame:
    """owner, other of pairs (owner, other, rank): each unordered pair once, with its first owner, then its first rank; none with itself."""
    low, high = F.least("owner", "other").alias("low"), F.greatest("owner", "other").alias("high")
    return pairs.where("owner <> other").groupBy(low, high).agg(F.min(F.struct("owner", "rank", "other")).alias("first")).select("first.owner", "first.other")


def first_of(channels: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of all channels, one for each key: the first channel's, with its place among the channels."""
    whole = None
    for place, rows in enumerate(channels):
        rows = rows.select(key).distinct().withColumn("channel", F.lit(place))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy(key).agg(F.min("channel").alias("channel"))


def identity_keys(ident: Column, aliases: Column, key: Column) -> Column:
    """The names by which a waiting record is known: its id, and its aliases or, without any, its key."""
    return F.array_distinct(F.concat(F.array(ident), F.when(F.size(aliases) > 0, aliases).otherwise(F.array(key))))


def work_url(ident: Column, url: Column, doi: Column) -> Column:
    """A work's page: its stored url, else its DOI's, else what its id says, else empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(
        some(url), F.when(some(doi).startswith("http"), doi).otherwise(F.concat(F.lit("https://doi.org/"), some(doi))), F.when(ident.startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), F.substring(ident, 7, 1000))),
        F.when(ident.startswith("openalex:"), F.concat(F.lit("https://openalex.org/"), F.substring(ident, 10, 1000))), F.lit(""),
    )


def is_read_only(text: Column) -> Column:
    """Whether a query holds no word that writes, quoted text aside; empty and null ones are refused."""
    return F.coalesce(F.trim(text) != "", F.lit(False)) & ~F.coalesce(F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"", "").rlike(WRITES), F.lit(False))


def scrubbed(df: DataFrame, name: str = "embedding") -> DataFrame:
    """df without the columns and nested fields of that name, in structs and arrays of structs too."""

    def clean(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            fields = [clean(value[f.name], f.dataType).alias(f.name) for f in kind if f.name != name]
            return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        return value

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name != name])


def approve(pending: DataFrame, skip: Sequence[int], version: str, day: str) -> tuple[DataFrame, DataFrame]:
    """The waiting rows (pos, ...) that are not skipped, stamped with version and day; and the log: version, day, approved, skipped."""
    chosen = ~F.col("pos").isin(*skip) if skip else F.lit(True)
    stamped = pending.where(chosen).withColumns({"version": F.lit(version), "approved_on": F.lit(day)})
    log = pending.agg(F.lit(version).alias("version"), F.lit(day).alias("day"), F.count_if(chosen).alias("approved"), F.count_if(~chosen).alias("skipped"))
    return stamped, log


def hashed_embedding(rows: DataFrame, ident: str, words: str, size: int) -> DataFrame:
    """ident, place, weight: a text's words counted by hash into `size` places, of length one; only places that are not zero."""
    place = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % size
    counted = rows.select(ident, F.explode(words).alias("word")).groupBy(ident, place.alias("place")).agg(F.count("*").alias("n"))
    return counted.select(ident, "place", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(ident)))).alias("weight"))


def summary(statement: Column, method: Column, result: Column, problem: Column) -> Column:
    """What to show of a contribution: its statement, else its method, result and problem."""
    rest = F.concat(F.coalesce(method, F.lit("")), F.lit(" → "), F.coalesce(result, F.lit("")), F.lit(" (for: "), F.coalesce(problem, F.lit("")), F.lit(")"))
    return F.coalesce(F.nullif(statement, F.lit("")), rest)


def claim_label(verdict: Column, supporting: Column, contradicting: Column) -> Column:
    """SUPPORT, CONTRADICT or NOINFO: by the more numerous evidence, a tie by the verdict."""
    return (
        F.when((verdict == "not_found") | (supporting + contradicting == 0), "NOINFO")
        .when(contradicting > supporting, "CONTRADICT")
        .when((supporting > contradicting) | (verdict == "established"), "SUPPORT")
        .otherwise("NOINFO")
    )


def gold_anchors(gold: DataFrame, works: DataFrame, least: float = 0.6) -> DataFrame:
    """gold_id, work_id, by of gold records (id, arxiv, doi, words) found among works of the same columns.

    A record with an arXiv id goes by that alone; another by its DOI, or else by the most similar title, `least` or more, ties to the smaller id.
    """
    w = works.select(F.col("id").alias("work_id"), "arxiv", "doi")

    def exact(rows: DataFrame, name: str) -> DataFrame:
        named = w.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("work_id").alias("work_id"))
        return rows.select(F.col("id").alias("gold_id"), name).join(named, name).select("gold_id", "work_id", F.lit(name).alias("by"))

    by_doi = exact(gold.where("arxiv IS NULL AND doi IS NOT NULL"), "doi")
    rest = gold.where("arxiv IS NULL").join(by_doi.select(F.col("gold_id").alias("id")), "id", "left_anti")
    titles = RT.closest(rest, works, RT.by_jaccard, lambda s: s >= least).select(F.col("a_id").alias("gold_id"), F.col("b_id").alias("work_id"))
    return exact(gold.where("arxiv IS NOT NULL"), "arxiv").unionByName(by_doi).unionByName(titles.withColumn("by", F.lit("title")))
