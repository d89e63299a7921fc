"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Documents with equal sets of n-grams are one class, a row of the incidence. Links between classes are found in
three steps, each of which keeps every link:

1. Size bound. A class can only have a partner if at least 3/4 of its n-grams occur in another class too. The
   incidence is cut into row blocks (runs of documents) and column blocks (ranges of n-gram hashes); each
   row block sends to each column block its n-grams once, those that two of its classes share without a
   row, as their fate is known. A column block counts, and returns to each row block how many of each
   class's n-grams it found elsewhere. The summed counts discard all classes below the bound.
2. Prefixes. Among the rest, n-grams are ordered by how many classes have them. A pair that overlaps enough for
   the threshold shares one of the rarest n - ceil(3n/4) + 1 n-grams of each, so only these are posted, each with
   its class's size n and the number `a` of the class's shared n-grams from this one on. Lists of the same classes are one.
3. Products. A pair's first common n-gram is in the lists, and there its overlap is at most the lesser `a` of the two. So a
   pair whose sizes differ too much, or with 7 * least(a, b) < 3 * (n + m), is discarded where it would be formed, and no link is
   lost, as 7 * overlap >= 3 * (n + m) is the threshold itself. Of the others the overlaps are counted from their whole sets. First
   each list pairs its classes with one leader, the class with the largest share of shared n-grams: in a group of near copies
   the one that the others vary. Components are joined; then all pairs across components that the bounds leave are counted, in lists
   that still span several. Of such a pair the smaller class must be dense, 7a >= 6n, so classes that merely share
   a passage, and hold much else, don't meet each other, and lists without a dense class small enough for them let go of them.
   A group of thousands of near copies costs a few products each.

What the result holds are components, so links within one component need not all be known.

N-grams are 64-bit hashes of words, classes 64-bit hashes of sets; the first step compares 32 bits in each column block, where a
collision can only keep a class too many.

Nulls and odd rows: a document without words, or null, has an empty set, links with nothing and is its own
component. Fewer than n words make one n-gram. Rows that repeat an id are nodes each, and have the id as their
name. Null ids are never the name of a component unless all its ids are null. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, mix, release, table, text_chunks, tidy, words
from quillgraph.llm.components import connected

N = 5
#: The threshold as a fraction of integers.
OVERLAP, UNION = 3, 4
#: N-grams of a row block, and of a column block, about.
ROW_BLOCK, COLUMN_BLOCK = 1_200_000, 1_000_000
#: Postings of a task: what is left of the lists is not spread thinner.
POSTINGS_A_TASK = 100_000
#: Ids that are sent to every task, at most.
BROADCAST_ROWS = 200_000
#: Classes that a task remembers to have posted.
REMEMBERED = 200_000

_SHIFTS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: Stands for "no single class" in a row block, and is the most classes of one: their places are 16 bits.
_NONE = 0xFFFF


def factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _SHIFTS[0] + _SHIFTS[1]) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct n-gram of the texts at `offsets`, by row and hash."""
    row, word, _, _ = words(data, offsets)
    if not len(row):
        return row, word
    factor = factors(n)
    count = np.bincount(row, minlength=len(offsets) - 1)
    rows, hashes = [], []
    if len(row) >= n:
        whole = row[: len(row) - n + 1] == row[n - 1 :]
        total = word[: len(whole)] * factor[0]
        for k in range(1, n):
            total += word[k : k + len(whole)] * factor[k]
        rows.append(row[: len(whole)][whole])
        hashes.append(mix(total[whole]))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        total = count[short].astype(np.uint64) * _SHIFTS[2]
        for k in range(n - 1):
            has = count[short] > k
            total[has] += word[first[has] + k] * factor[k]
        rows.append(short)
        hashes.append(mix(total ^ _SHIFTS[3]))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def set_names(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and name (a hash of the whole set) of each row's set."""
    size = np.bincount(row, minlength=rows)
    total = np.zeros(rows, dtype=np.uint64)
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        total[row[starts]] = np.add.reduceat(mix(h ^ _SHIFTS[4]), starts)
    return size, mix(total + size.astype(np.uint64) * _SHIFTS[2])


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By runs of rows: first row, sizes, names, and the n-grams with the offsets of each row's."""
    for first, data, offsets in text_chunks(texts):
        row, h = shingle_sets(data, offsets, n)
        size, name = set_names(row, h, len(offsets) - 1)
        yield first, size, name, h, np.append(0, np.cumsum(size))


def name_sets(docs: DataFrame, n: int) -> DataFrame:
    """id, text and any other columns -> id, cls, n (size; 0 where the set is empty) and the other columns."""
    others = docs.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            size, name = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.uint64)
            for first, s, c, _, _ in sets_of(rows.column(1), n):
                size[first : first + len(s)], name[first : first + len(s)] = s, c
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(name.view(np.int64)), pa.array(size), *rows.columns[2:]], names=["id", "cls", "n", *(f.name for f in others)])

    return docs.mapInArrow(tidy(run), ", ".join(["id long, cls long, n long", *(f"{f.name} {f.dataType.simpleString()}" for f in others)]))


def candidates(docs: DataFrame, n: int, columns: int) -> DataFrame:
    """cls of the classes of which enough n-grams occur in another class: step 1. Repeats a class at most once a row block."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sizes: list[np.ndarray] = []
        names: list[np.ndarray] = []
        grams: list[np.ndarray] = []
        held = classes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            size, name, h = np.concatenate(sizes), np.concatenate(names), np.concatenate(grams)
            row = np.repeat(np.arange(len(size)), size)
            column = (h >> np.uint64(32)) % np.uint64(columns)
            key = column << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            start = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)))
            times = np.diff(np.append(start, len(key)))
            shared = np.bincount(row[np.repeat(times > 1, times)], minlength=len(size))
            key, who = key[start], np.where(times > 1, _NONE, row[start]).astype(np.uint16)
            # A row block is named by what it holds, so that a repeated task gives the same name.
            block = int(mix(np.array([np.bitwise_xor.reduce(mix(name + np.arange(len(name), dtype=np.uint64)))], dtype=np.uint64)).view(np.int64)[0])
            cut = np.searchsorted(key >> np.uint64(32), np.arange(columns + 1, dtype=np.uint64))
            filled = [c for c in range(columns) if cut[c + 1] > cut[c]]
            low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            head = np.concatenate([name.view("<i8"), size.astype("<i8"), shared.astype("<i8")]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*filled, -1 - block % columns], pa.int32()),
                    pa.array([block] * (len(filled) + 1), pa.int64()),
                    pa.array([*(low[cut[c] : cut[c + 1]].tobytes() for c in filled), head], pa.binary()),
                    pa.array([*(who[cut[c] : cut[c + 1]].astype("<u2").tobytes() for c in filled), None], pa.binary()),
                ],
                names=["column", "block", "keys", "who"],
            )
            for x in (sizes, names, grams):
                x.clear()

        for rows in batches:
            for _, size, name, h, at in sets_of(rows.column(0), n):
                fresh = []
                for i in np.flatnonzero(size):
                    c = int(name[i])
                    if c not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                        fresh.append(i)
                for k in range(0, len(fresh), _NONE):
                    part = fresh[k : k + _NONE]
                    if classes + len(part) > _NONE:
                        yield from flush()
                        held = classes = 0
                    sizes.append(size[part])
                    names.append(name[part])
                    grams.append(np.concatenate([h[at[i] : at[i + 1]] for i in part]))
                    held += len(grams[-1])
                    classes += len(part)
                if held >= ROW_BLOCK:
                    yield from flush()
                    held = classes = 0
        if sizes:
            yield from flush()

    def find(rows: pa.Table) -> pa.Table:
        """A column block: for each row block, which of its classes have n-grams here that occur elsewhere, and how many."""
        if rows.column("column")[0].as_py() < 0:
            return rows.select(["block", "keys"]).rename_columns(["block", "body"]).append_column("head", pa.array([True] * rows.num_rows))
        blocks = rows.column("block").to_pylist()
        keys = [np.frombuffer(k.as_py(), "<u4") for k in rows.column("keys")]
        who = [np.frombuffer(w.as_py(), "<u2") for w in rows.column("who")]
        key = np.concatenate(keys)
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[where] > 1
        at, out = 0, []
        for w in who:
            found = w[again[at : at + len(w)] & (w != _NONE)]
            at += len(w)
            count = np.bincount(found)
            has = np.flatnonzero(count)
            out.append(np.concatenate([has, count[has]]).astype("<u4").tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "body": pa.array(out, pa.binary()), "head": pa.array([False] * len(out))})

    def decide(rows: pa.Table) -> pa.Table:
        """A row block: the classes within the bound."""
        heads = rows.filter(rows.column("head")).column("body").to_pylist()
        if not heads:
            return pa.table({"cls": pa.array([], pa.int64())})
        name, size, shared = np.frombuffer(heads[0], "<i8").reshape(3, -1).copy()
        for body in rows.filter(pa.compute.invert(rows.column("head"))).column("body"):
            has, count = np.frombuffer(body.as_py(), "<u4").astype(np.int64).reshape(2, -1)
            shared[has] += count
        return pa.table({"cls": pa.array(name[UNION * shared >= OVERLAP * size])})

    posted = docs.select("text").mapInArrow(tidy(post), "column int, block long, keys binary, who binary")
    found = posted.groupBy("column").applyInArrow(find, "block long, body binary, head boolean")
    return found.groupBy("block").applyInArrow(decide, "cls long")


def gather(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, n, grams (little-endian 64-bit hashes, ascending) of the wanted id, mark, cls; rows may repeat."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            asked = rows.column(1).to_numpy()
            for first, size, name, h, at in sets_of(rows.column(0), n):
                keep = np.flatnonzero(name.view(np.int64) == asked[first : first + len(size)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[keep].view(np.int64)), pa.array(size[keep]), pa.array([h[at[i] : at[i + 1]].astype("<u8").tobytes() for i in keep], pa.binary())], names=["cls", "n", "grams"]
                )

    asked = wanted.select(F.col("id").alias("wanted_id"), F.col("mark").alias("wanted_mark"), "cls")
    return docs.join(asked, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark"))).select("text", "cls").mapInArrow(tidy(run), "cls long, n long, grams binary")


def prefixes(sets: DataFrame) -> DataFrame:
    """h, df, cls, n, shared, a: the rarest n-grams of each class, of those that another class has, with the number of the class's shared n-grams, and of those from this one on: step 2."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            size = rows.column("n").to_numpy()
            for at in range(0, rows.num_rows, 1024):
                part = slice(at, at + 1024)
                grams = rows.column("grams").slice(at, 1024).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(grams), "<i8")), pa.array(np.repeat(rows.column("cls").to_numpy()[part], size[part])), pa.array(np.repeat(size[part], size[part]))], names=["h", "cls", "n"]
                )

    posted = sets.mapInArrow(tidy(spread), "h long, cls long, n long")
    often = posted.groupBy(F.col("h").alias("gram")).agg(F.count("*").alias("df")).where(F.col("df") > 1)
    shared = posted.join(often, F.col("h") == F.col("gram")).select("h", "cls", "n", "df")
    ranked = shared.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("grams")).withColumn("shared", F.size("grams").cast("long"))
    # Of the prefix of n - ceil(3n/4) + 1 n-grams, those that no other class has come first.
    length = F.col("n") - F.ceil(F.lit(OVERLAP) * F.col("n") / F.lit(UNION)) + 1 - (F.col("n") - F.col("shared"))
    listed = ranked.withColumn("length", length.cast("int")).where(F.col("length") > 0).select(F.posexplode(F.slice("grams", 1, F.col("length"))).alias("pos", "g"), "cls", "n", "shared")
    return listed.select("g.h", "g.df", "cls", "n", "shared", (F.col("shared") - F.col("pos")).alias("a"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs u, v those whose sets overlap enough: step 3."""
    a, b = sets.select(F.col("cls").alias("u"), F.col("grams").alias("gu")), sets.select(F.col("cls").alias("v"), F.col("grams").alias("gv"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for i in range(rows.num_rows):
                x, y = np.frombuffer(rows.column("gu")[i].as_py(), "<u8"), np.frombuffer(rows.column("gv")[i].as_py(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(UNION * both >= OVERLAP * (len(x) + len(y) - both))
            yield rows.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # Sets may repeat where rows do, so pairs may: components do not mind.
    return pairs.join(a, "u").join(b, "v").select("u", "v", "gu", "gv").mapInArrow(tidy(product), "u long, v long")


def one_of_equals(postings: DataFrame) -> DataFrame:
    """The posting lists without those that hold the same classes as another: they would only find the same pairs again, and later in the order of n-grams."""
    names = postings.groupBy("h").agg(F.first("df").alias("df"), F.count("*").alias("k"), F.sum(F.shiftright(F.xxhash64("cls"), 8)).alias("a"), F.sum(F.shiftright(F.xxhash64(F.lit("b"), "cls"), 8)).alias("b"))
    kept = names.where("k > 1").groupBy("k", "a", "b").agg(F.min(F.struct("df", "h"))["h"].alias("kept")).select("kept")
    return postings.join(kept, F.col("h") == F.col("kept"), "left_semi")


def within(n: Column, a: Column, m: Column, b: Column) -> Column:
    """Whether sets of n and m n-grams can overlap enough if they have nothing in common before the n-gram from which on a and b of theirs are shared."""
    fits = F.lit(OVERLAP) * F.greatest(n, m) <= F.lit(UNION) * F.least(n, m)
    return fits & (F.lit(OVERLAP + UNION) * F.least(a, b) >= F.lit(OVERLAP) * (n + m))


def with_leaders(postings: DataFrame) -> DataFrame:
    """u, v: of each posting list all pairs with its leader that the bounds leave."""
    lead = postings.groupBy(F.col("h").alias("gram")).agg(F.max_by(F.struct("cls", "n", "a"), F.struct(F.col("shared") / F.col("n"), "cls")).alias("lead"))
    both = postings.join(lead, (F.col("h") == F.col("gram")) & (F.col("cls") != F.col("lead.cls")) & within(F.col("n"), F.col("a"), F.col("lead.n"), F.col("lead.a")))
    return both.select(F.least("cls", "lead.cls").alias("u"), F.greatest("cls", "lead.cls").alias("v")).distinct()


def across(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """u, v: all pairs of different components that the bounds leave in a posting list."""
    named = postings.join(labels, F.col("cls") == F.col("node"), "left").select("h", "cls", "n", "a", F.coalesce("root", "cls").alias("comp")).withColumn("dense", F.lit(OVERLAP + UNION) * F.col("a") >= F.lit(2 * OVERLAP) * F.col("n"))
    # Lists within one component are done with, and a class leaves those without a dense class small enough for it.
    lists = named.groupBy(F.col("h").alias("gram")).agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.min(F.when(F.col("dense"), F.col("n"))).alias("least")).where(F.col("first") < F.col("last"))
    open_ = (F.col("h") == F.col("gram")) & (F.lit(OVERLAP) * (F.col("n") + F.col("least")) <= F.lit(OVERLAP + UNION) * F.col("a"))
    live = checkpointed(named.join(lists, open_).select("h", "cls", "n", "a", "comp", "dense"))
    large = live.select("h", F.col("cls").alias("u"), "n", "a", F.col("comp").alias("cu"))
    small = live.where("dense").select(F.col("h").alias("g"), F.col("cls").alias("v"), F.col("n").alias("m"), F.col("a").alias("b"), F.col("comp").alias("cv"))
    # Of equal sizes both are dense where the bounds hold.
    first = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("v") < F.col("u"))
    met = large.join(small, (F.col("h") == F.col("g")) & (F.col("cu") != F.col("cv")) & first & within(F.col("n"), F.col("a"), F.col("m"), F.col("b")))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def link_classes(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """node, root of the classes that have links and are not their component's root."""
    spark = docs.sparkSession
    grams = classes.agg(F.sum("n")).first()[0] or 0
    if not grams:
        return spark.createDataFrame([], "node long, root long")
    kept = candidates(docs, n, max(1, -(-grams // COLUMN_BLOCK))).distinct()
    wanted = checkpointed(classes.join(kept, "cls").select("id", "mark", "cls"))
    sets = checkpointed(gather(docs, wanted, n))
    postings = checkpointed(prefixes(sets.dropDuplicates(["cls"])))
    tasks = 1 + postings.count() // POSTINGS_A_TASK
    postings = checkpointed(one_of_equals(postings).coalesce(tasks))
    release(spark)
    edges = checkpointed(linked(with_leaders(postings), sets))
    labels = connected(edges)
    rest = checkpointed(linked(across(postings, labels), sets))
    release(spark)
    if not rest.head(1):
        return labels
    return connected(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest))


def judged(df: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """id, cls, n, mark (a hash of the text) of each row; and cls, id (its smallest, null if it has none), mark, comp of each class."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    named = checkpointed(name_sets(docs, n))
    classes = checkpointed(named.where(F.col("n") > 0).groupBy("cls").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("one"), F.max("n").alias("n")).select("cls", "n", "one.id", "one.mark"))
    labels = checkpointed(link_classes(docs, classes, n))
    return named, classes.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "id", "mark", F.coalesce("root", "cls").alias("comp"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links) of each row."""
    named, rooted = judged(df, id_col, text_col, n)
    least = rooted.groupBy(F.col("comp").alias("c")).agg(F.min("id").alias("component_id"))
    # Only components of several classes change their name.
    moved = rooted.join(least, F.col("comp") == F.col("c")).select(F.col("cls").alias("of"), "component_id")
    return named.join(moved, (F.col("cls") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id")).alias("component_id")
    )


def keep_one(df: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """Of each component one row of df: that with the smallest id, a null id only if there is no other, and of several texts under that
    id one. Rows without words are components of their own and all stay. Rows whose texts aren't linked stay though they share an id."""
    named, rooted = judged(df, id_col, text_col, n)
    rooted = checkpointed(rooted)
    # Copies are one class here, so only classes meet by component; a class of very many copies is a skewed key of the last join, which Spark splits.
    first = rooted.groupBy(F.col("comp").alias("c")).agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("first"))
    firsts = rooted.join(first, F.col("comp") == F.col("c")).select(F.col("cls").alias("of"), F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"))
    rows = checkpointed(named.where(F.col("n") > 0).join(firsts, F.col("cls") == F.col("of")).select("id", "mark", "first_id", "first_mark"))
    others = rows.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))))
    kept = without(df, id_col, text_col, others.select("id", "mark").distinct())
    again = checkpointed(rows.groupBy("id", "mark").count().where("count > 1").select("id", "mark"))
    if not again.head(1):
        return kept
    once = without(kept, id_col, text_col, again)
    repeated = without(kept, id_col, text_col, again, how="left_semi").withColumn("mark of text", F.xxhash64(F.col(text_col)))
    return once.unionByName(repeated.dropDuplicates([id_col, "mark of text"]).drop("mark of text"))


def without(df: DataFrame, id_col: str, text_col: str, listed: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of df that are not listed by id and hash of the text; with how="left_semi" those that are."""
    listed = checkpointed(listed.select(F.col("id").alias("listed id"), F.col("mark").alias("listed mark")))
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return df.join(listed, df[id_col].cast("long").eqNullSafe(listed["listed id"]) & (F.xxhash64(df[text_col]) == listed["listed mark"]), how)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id FROM w LEFT JOIN z USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = w.doc_id
"""

QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLE = {"op4_ngram_jaccard": ORACLE_SQL}
