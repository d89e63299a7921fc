"""What a reader returns, made into rows; claims added later; the ledger of resolved references; works by their own framing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import alignment as A
from quillgraph.functions import bibliography as B
from quillgraph.functions import citations as C
from quillgraph.functions import identity as I
from quillgraph.operators import retrieval as RT
from quillgraph.operators.graph import checkpointed
from quillgraph.operators.labeller import Labeller, label

CONTRIBUTIONS = "contributions array<struct<statement: string, kind: string, quote: string, confidence: double>>"
CLAIMS = "claims array<struct<text: string, claim_type: string, evidence: string, confidence: double, contribution: int>>"
LOCAL_EDGES = "local_edges array<struct<src: int, dst: int, relation: string, evidence: string>>"
#: How perspectives, positions, surveys and reviews name themselves.
NON_PRIMARY_TITLE = r"(?i)\b(perspective|position paper|a survey|survey of|systematic review|a review of|roadmap|viewpoint|the case for|primer)\b"
NON_PRIMARY_TEXT = r"(?i)(this perspective|this position|position paper|we argue|we advocate|we call for|we contend|we posit|this survey|we survey|a survey of|this review|we review the)"


def clean(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def contribution_id(paper: Column, place: Column) -> Column:
    return F.concat(paper.cast("string"), F.lit("::contrib"), place.cast("string"))


def claim_id(paper: Column, place: Column) -> Column:
    """Places below 100 have two digits."""
    digits = place.cast("string")
    return F.concat(paper.cast("string"), F.lit("::c"), F.when(place < 10, F.concat(F.lit("0"), digits)).otherwise(digits))


def contributions(readings: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """id, paper_id, statement, kind, quote, confidence, claim_ids of readings (paper_id, contributions, claims). Unknown kinds are other, a missing confidence is a half."""
    given = F.filter(F.transform(F.coalesce("claims", F.array().cast(CLAIMS.split(" ", 1)[1])), lambda c, i: F.named_struct(F.lit("of"), c["contribution"], F.lit("id"), claim_id(F.col("paper_id"), i))), lambda c: c["of"].isNotNull())
    rows = readings.select("paper_id", given.alias("given"), F.posexplode("contributions").alias("place", "c"))
    mine = F.transform(F.filter("given", lambda g: g["of"] == F.col("place")), lambda g: g["id"])
    kind = clean(F.col("c.kind"))
    return rows.select(
        contribution_id(F.col("paper_id"), F.col("place")).alias("id"), "paper_id", clean(F.col("c.statement")).alias("statement"), F.when(kind.isin(*kinds), kind).otherwise("other").alias("kind"),
        clean(F.col("c.quote")).alias("quote"), F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"), mine.alias("claim_ids"),
    )


def claims(readings: DataFrame, known: Column) -> DataFrame:
    """id, paper_id, text, claim_type, evidence, location, confidence, contribution_id of readings (paper_id, location, claims).

    `known` lists the ids that a claim's contribution points into, by place; a place outside it, or none, gives null.
    """
    rows = readings.select("paper_id", "location", known.alias("known"), F.posexplode("claims").alias("place", "c"))
    of = F.col("c.contribution")
    return rows.select(
        claim_id(F.col("paper_id"), F.col("place")).alias("id"), "paper_id", clean(F.col("c.text")).alias("text"), F.coalesce("c.claim_type", F.lit("empirical")).alias("claim_type"), clean(F.col("c.evidence")).alias("evidence"),
        "location", F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"), F.when((of >= 0) & (of < F.size("known")), F.get("known", of)).alias("contribution_id"),
    )


def made_here() -> Column:
    """The ids of the contributions of the same reading, by place."""
    return F.transform(F.coalesce("contributions", F.array().cast(CONTRIBUTIONS.split(" ", 1)[1])), lambda _, i: contribution_id(F.col("paper_id"), i))


def local_edges(readings: DataFrame) -> DataFrame:
    """src, dst, relation, evidence, source, level: relations between claims of one paper; places outside the claims and loops are dropped."""
    rows = readings.select("paper_id", F.coalesce(F.size("claims"), F.lit(0)).alias("n"), F.explode("local_edges").alias("e"))
    src, dst = F.col("e.src"), F.col("e.dst")
    fits = src.between(0, F.col("n") - 1) & dst.between(0, F.col("n") - 1) & (src != dst)
    return rows.where(fits).select(
        claim_id(F.col("paper_id"), src).alias("src"), claim_id(F.col("paper_id"), dst).alias("dst"), F.coalesce("e.relation", F.lit("supports")).alias("relation"), clean(F.col("e.evidence")).alias("evidence"),
        F.lit("text").alias("source"), F.lit("local").alias("level"),
    )


def backfill(papers: DataFrame, held: DataFrame, reader: Labeller, batch: int = 12) -> tuple[DataFrame, DataFrame]:
    """Claims and local edges for papers (paper_id, location, ...) that have contributions (id, paper_id, statement, kind) but no claims yet.

    The reader sees a paper's columns and its contributions by id, and returns paper_id, claims and local_edges. Papers without contributions are left out.
    Its answers are kept in a checkpoint: both tables come from one call.
    """
    listed = held.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("id", "statement", "kind"))).alias("contributions"))
    asked = papers.join(listed, "paper_id")
    kind = papers.schema["paper_id"].dataType.simpleString()
    answers = label(asked, reader, f"paper_id {kind}, {CLAIMS}, {LOCAL_EDGES}", batch)
    read = checkpointed(answers.join(asked.select("paper_id", "location", F.transform("contributions", lambda c: c["id"]).alias("known")), "paper_id"))
    return claims(read, F.col("known")), local_edges(read)


def non_primary(title: Column, text: Column) -> Column:
    """Signals that a work reports no research of its own, from its title and from its framing, joined by "; "; null for none. For people to confirm."""

    def signal(name: str, value: Column, pattern: str) -> Column:
        found = F.regexp_extract(F.coalesce(value, F.lit("")), pattern, 0)
        return F.when(found != "", F.concat(F.lit(f"{name}:'"), found, F.lit("'")))

    return F.nullif(F.concat_ws("; ", signal("title", title, NON_PRIMARY_TITLE), signal("framing", text, NON_PRIMARY_TEXT)), F.lit(""))


def _by_alias(ids: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stated, by_id, several of each id: the work that counts where no title decides, and whether there are several; of those with several works stated, text, paper_id by title."""
    fit = named.where(F.length("text") >= I.LEAST_TITLE)
    held = checkpointed(ids.select(F.lower("alias").alias("stated"), "paper_id").distinct()).join(fit, "paper_id", "left")
    # A work without a title goes before those whose titles the reference lacks.
    known = held.groupBy("stated").agg(F.coalesce(F.min(F.when(F.col("text").isNull(), F.col("paper_id"))), F.min("paper_id")).alias("by_id"), (F.min("paper_id") != F.max("paper_id")).alias("several"))
    by_text = held.where("text IS NOT NULL").groupBy("stated", "text").agg(F.min("paper_id").alias("paper_id"))
    return known, by_text.join(known.where("several").select("stated"), "stated")


def _by_title(said: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, stated, chosen of references (raw, doc_id, stated) whose id several works have: that whose title the reference holds.

    Of several such titles the longest counts, then the smallest paper_id. Where it holds none, the smallest work without a title is taken, else the smallest of all.
    """
    texts = said.select("doc_id", I.title_key(F.col("raw")).alias("text"))
    hits = RT.containing(texts, shared.select(F.col("text").alias("item_id"), "text").distinct(), I.LEAST_TITLE).withColumnRenamed("item_id", "text")
    found = said.select("doc_id", "stated").join(hits, "doc_id").join(shared, ["stated", "text"])
    return found.groupBy("doc_id", "stated").agg(F.min_by("paper_id", F.struct(-F.length("text"), "paper_id")).alias("chosen"))


def ledger(works: DataFrame, entries: DataFrame, titles: DataFrame, ids: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """reference_id, citing, state, method, target, candidates of each reference.

    `works` has citing; `entries` citing, pos (from 1), raw; `titles` paper_id, title; `ids` alias, paper_id. An id that the reference states decides
    (of several works that have it, see `_by_title`); else one work whose whole title it holds; several are ambiguous, and so are several merely similar titles, which never make a link.
    A work's reference to itself is no reference. Works without entries have one row. Rows of `done` stay as they are, so a ledger can be resumed.
    """
    reference = F.concat(F.col("citing").cast("string"), F.lit("::ref"), F.when(F.col("pos") < 10_000, F.lpad(F.col("pos").cast("string"), 4, "0")).otherwise(F.col("pos").cast("string")))
    titles = checkpointed(titles.select("paper_id", "title").where("title IS NOT NULL").distinct())
    named = titles.select("paper_id", I.title_key(F.col("title")).alias("text")).distinct()
    known, shared = _by_alias(ids, named)
    unfit = F.when(F.col("raw").rlike(f"(?i){B.NAVIGATION.pattern}"), "non_bibliographic").when(F.length("raw") > B.MOST_LENGTH, "malformed")
    # What a reference says is read once for each text; the rows carry its hashes only.
    raw = F.coalesce("raw", F.lit(""))
    hashes = (F.xxhash64("raw").alias("doc_id"), F.hash("raw").alias("check"))
    rows = entries.select(reference.alias("reference_id"), "citing", raw.alias("raw"))
    fresh = (lambda df: df) if done is None else lambda df: df.join(done.select("reference_id"), "reference_id", "left_anti")
    said = fresh(rows.select("reference_id", "raw")).select("raw").distinct().withColumn("unfit", unfit).withColumn("stated", F.lower(C.stated_id(F.col("raw"))))
    said = checkpointed(said.join(known, "stated", "left").select("*", *hashes))
    chosen = _by_title(said.where("unfit IS NULL AND several"), shared)
    texts = said.where("unfit IS NULL AND stated IS NULL").select("raw", "doc_id", I.title_key(F.col("raw")).alias("text"))
    # Titles are told by their text: works of one title are one passage.
    passages = named.select(F.xxhash64("text").alias("item_id"), "text").distinct()
    hits = RT.containing(texts, passages).join(named.withColumn("item_id", F.xxhash64("text")), "item_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("paper_id")).alias("exact"))
    by_title = checkpointed(texts.join(hits, "doc_id", "left").select("raw", "exact"))
    alike = A.similar_titles(by_title.where("exact IS NULL"), titles).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))).alias("similar"))
    said = said.join(chosen, ["doc_id", "stated"], "left").withColumn("by_id", F.coalesce("chosen", "by_id"))
    verdicts = said.join(by_title, "raw", "left").join(alike, "raw", "left").drop("raw")
    found = fresh(rows.select("reference_id", "citing", *hashes)).join(verdicts, ["doc_id", "check"])
    of_kind = titles.schema["paper_id"].dataType.simpleString()
    target = F.coalesce("by_id", F.when(F.size("exact") == 1, F.get("exact", F.lit(0))))
    state = (
        F.when(F.col("unfit").isNotNull(), F.col("unfit"))
        .when(target == F.col("citing"), "non_bibliographic")
        .when(target.isNotNull(), "resolved_in_corpus")
        .when(F.col("stated").isNotNull(), "resolved_external")
        .when((F.size("exact") > 1) | (F.size("similar") > 1), "ambiguous")
        .otherwise("unresolved")
    )
    fit = F.col("unfit").isNull()
    method = F.when(fit & F.col("stated").isNotNull(), "stated_id").when(fit & F.col("exact").isNotNull(), "exact_normalized_title")
    shown = F.when(F.size("exact") > 1, F.col("exact")).when(F.col("similar").isNotNull(), F.transform("similar", lambda s: s["paper_id"]))
    resolved = found.select("reference_id", "citing", state.alias("state"), method.alias("method"), F.when(fit, target).alias("target"), F.when(fit, shown).alias("candidates"))
    none = F.lit(None)
    missing = works.join(entries, "citing", "left_anti").select(
        F.concat(F.col("citing").cast("string"), F.lit("::retrieval")).alias("reference_id"), "citing", F.lit("retrieval_unavailable").alias("state"), none.cast("string").alias("method"), none.cast(of_kind).alias("target"), none.cast(f"array<{of_kind}>").alias("candidates"),
    )
    if done is None:
        return resolved.unionByName(missing)
    return resolved.unionByName(missing.join(done.select("reference_id"), "reference_id", "left_anti")).unionByName(done)
