"""LM scoring by a hierarchical Pitman-Yor model of words in the context of the word before.

Each context is a restaurant of a Chinese-restaurant process with discount, and all contexts share one
parent restaurant over words, whose base is even over the vocabulary and one unknown word. Contexts are the
words before, each by its whole 64-bit hash, and one for the beginning of a text: restaurants grow with the vocabulary.

Seating is sampled by Gibbs: a sweep takes all customers of one dish in one restaurant from their tables
and seats them anew one by one, given the parent's probability of the dish and the restaurant's other
tables; as seating one by one ignores what follows, a new arrangement is accepted by the Metropolis
ratio of the normalisers. Customers of a dish beyond EXACT are seated in steps of a 256th, at the
probability that held when the step began. While contexts are seated, the parent's probabilities are those of
one table a dish and context; then a table is a customer of the parent, whose seating is sampled alike. After BURN sweeps the
tables of SAMPLES sweeps are averaged; they score the texts.

The predictive probabilities sum to one: a context's totals are the sums of its own dishes, and so are the parent's.

Everything follows the corpus and moves as packed messages between blocks, each a task's work whatever the corpus:

1. Row blocks (runs of training texts) send the counts of their pairs of word and context to the word's column block.
2. Column blocks of words merge them, know each word's count and in how many contexts it is, and send the pairs on to
   the context's block. A block of contexts holds whole restaurants, seats them, and sends dishes and tables to the word's block.
3. Column blocks of words sum the tables that came as customers, and seat the parent.
4. Row blocks (of all texts) ask the words' blocks for their distinct pairs once, with the rows they are in, and get back sums
   a document. Of a pair that the model does not know, the context's weight is asked of the context's block.

Words that are frequent, at most CODES, are written as codes of two bytes; their restaurants' totals are a table
of as many rows that every task has. It is a way of writing: other words travel as hashes, with the totals of their context.

No block is skewed: words and contexts that make HOT_SHARE of the training tokens are dealt by word and context, and their
totals are summed apart, 2 / HOT_SHARE at most. Pairs that make HOT_PAIR of the tokens are 1 / HOT_PAIR at most: they are sent to
every task and scored on the spot. Counts are summed within each row block before they are sent.

What is learned comes from the training rows only; discounts are estimated from their counts of counts.

Nulls and odd rows: a null or empty text is one end token; repeated rows or ids are scored alike (and counted each, if
they are training rows). Without training rows every token is unknown: the base is 1 / (V + 1) = 1 and the score 0. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, mix, release, table, text_chunks, tidy, words

STRENGTH, ROOT_STRENGTH = 1.0, 1.0
BURN, SAMPLES, EXACT = 2, 3, 4096
HOT_SHARE, HOT_PAIR = 1 / 1024, 1 / 65536
#: Words with a code, at most, and the share of the tokens that one of them makes, about.
CODES, CODE_SHARE = 65_533, 1 / 262_144
#: Tokens of a row block, and of a column block, about; rows of a row block at most.
ROW_BLOCK, COLUMN_BLOCK, ROWS = 3_000_000, 4_000_000, 65_535
END = mix(np.array([0xE4D], dtype=np.uint64))[0]
SEED = 20240607
#: Stands for a null id within the row blocks.
NO_ID = -(2**63)

#: A message goes to a column block; x, y and block are numbers of its kind, the rest are arrays.
ARRAYS = "abcdefgh"
SCHEMA = pa.schema([("column", pa.int32()), ("kind", pa.int32()), *((n, pa.int64()) for n in ("block", "x", "y")), *((n, pa.binary()) for n in ARRAYS)])
SQL_SCHEMA = "column int, kind int, block long, x long, y long, " + ", ".join(f"{n} binary" for n in ARRAYS)
PAIRS, WORDS, EXTRA, CONTEXTS, QUERY, HEAD, ANSWER, LATE, OF_CONTEXT, OF_WORD, OF_ALL, HOT = range(12)


def message(column: int, kind: int, *arrays: bytes, block: int = 0, x: int = 0, y: int = 0) -> tuple:
    return (column, kind, block, x, y, *arrays, *[None] * (len(ARRAYS) - len(arrays)))


def numbers(kind: int, key: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> list[tuple]:
    """Rows that are summed by key."""
    y = np.zeros(len(key), np.int64) if y is None else y
    return [message(0, kind, block=k, x=i, y=j) for k, i, j in zip(key.tolist(), x.tolist(), y.tolist(), strict=True)]


def rows_of(messages: list[tuple]) -> pa.RecordBatch:
    columns = zip(*messages, strict=True) if messages else [[]] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def table_of(messages: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows_of(messages)], schema=SCHEMA)


def put(x: np.ndarray, kind: str) -> bytes:
    """The numbers as bytes, all first bytes before all second ones and so on, compressed."""
    x = np.ascontiguousarray(x, kind)
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def got(body: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(body[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(body[8:], size, asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def find_in(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked value its place among the sorted names, and whether it is there."""
    at = np.searchsorted(names, asked)
    at[at == len(names)] = 0
    return at, names[at] == asked if len(names) else np.zeros(len(asked), bool)


class Codes:
    """names: sorted hashes of frequent words, a code each; hot: those words and contexts among them that are dealt apart, sorted.

    Names are found by a table of SLOTS places. Of names with the same place but one has it, the others have no code: a hot one has.
    """

    SLOTS = 20

    def __init__(self, names: np.ndarray, hot: np.ndarray):
        """names: the hot ones, and others from the most frequent down."""
        self.hot = np.unique(hot)
        names = np.concatenate([self.hot, names])
        self.factor = next(f for f in mix(np.arange(1, 1000, dtype=np.uint64)) | np.uint64(1) if len(np.unique(self.slot(self.hot, f))) == len(self.hot))
        _, first = np.unique(self.slot(names, self.factor), return_index=True)
        self.names = np.sort(names[first])
        self.place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def slot(self, x: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (x * factor) >> np.uint64(64 - self.SLOTS)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each value, and whether it has one."""
        if self.place is None:
            self.place = np.zeros(1 << self.SLOTS, np.uint16)
            self.place[self.slot(self.names, self.factor)] = np.arange(len(self.names))
            self.heat = find_in(self.hot, self.names)[1]
        at = self.place[self.slot(x, self.factor)]
        return at, self.names[at] == x

    def is_hot(self, x: np.ndarray) -> np.ndarray:
        at, has = self.find(x)
        return has & self.heat[at]

    def put(self, x: np.ndarray) -> tuple[bytes, bytes]:
        at, has = self.find(x)
        return put(np.where(has, at, 0xFFFF), "<u2"), put(x[~has], "<u8")

    def got(self, short: bytes, rare: bytes) -> np.ndarray:
        code = got(short, "<u2")
        out = self.names[np.minimum(code, len(self.names) - 1)]
        out[code == 0xFFFF] = got(rare, "<u8")
        return out

    def column(self, of: np.ndarray, other: np.ndarray, columns: int) -> np.ndarray:
        """The column block of each `of`; of a hot one that of both."""
        key = mix(of ^ np.uint64(0xC01))
        hot = np.flatnonzero(self.is_hot(of))
        key[hot] = mix(of[hot] ^ mix(other[hot] + np.uint64(1)))
        return ((key >> np.uint64(40)) % np.uint64(columns)).astype(np.int64)

    def put_pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[bytes, ...]:
        """Five arrays; the firsts are sorted."""
        start = starts_of(first)
        return (*self.put(first[start]), put(np.diff(np.append(start, len(first))), "<u4"), *self.put(second))

    def got_pairs(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(self.got(row["a"], row["b"]), got(row["c"], "<u4")), self.got(row["d"], row["e"])


def by_column(column: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A stable order by column in which equal firsts, and in them equal pairs, stand together but for rare exceptions (in messages, whose receivers merge)."""
    return np.argsort(column.astype(np.uint64) << np.uint64(48) | first >> np.uint64(40) << np.uint64(24) | second >> np.uint64(40), kind="stable")


def grouped(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order in which equal firsts, and in them equal pairs, stand together."""
    names, at = np.unique(first, return_inverse=True)
    bits = 64 - max(1, len(names).bit_length())
    key = at.astype(np.uint64) << np.uint64(bits) | second >> np.uint64(64 - bits)
    order = np.argsort(key)
    tied = (np.diff(key[order]) == 0) & (np.diff(second[order]) != 0)
    return np.lexsort((second, first)) if tied.any() else order


def starts_of(*sorted_: np.ndarray) -> np.ndarray:
    """Where another value, or pair of values, begins."""
    new = np.ones(len(sorted_[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return np.flatnonzero(new)


def parts(column: np.ndarray, columns: int) -> Iterator[tuple[int, slice]]:
    """The filled columns of sorted ones, and where they are."""
    cut = np.searchsorted(column, np.arange(columns + 1))
    return ((c, slice(cut[c], cut[c + 1])) for c in range(columns) if cut[c + 1] > cut[c])


def joined(found: list[np.ndarray], kind: str = "<u8") -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *found])


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return word ^ mix(context + np.uint64(1))


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By runs of rows: first row, rows, and of each token its row (from 0), word and context; an end closes each text."""
    for first, data, offsets in text_chunks(texts):
        n = len(offsets) - 1
        row, word, _, _ = words(data, offsets)
        count = np.bincount(row, minlength=n)
        at = np.arange(len(word)) + row  # one place more for each end before
        full = np.full(len(word) + n, END, dtype=np.uint64)
        full[at] = word
        rows = np.repeat(np.arange(n), count + 1)
        context = np.zeros(len(full), dtype=np.uint64)
        context[1:] = full[:-1]
        context[np.append(0, np.cumsum(count + 1)[:-1])] = 0
        yield first, n, rows, full, context


def seat(customers: np.ndarray, fresh: np.ndarray, grows: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seats each dish's customers one by one: tables, and the log of the product of the normalisers.

    Weight of a new table is fresh + grows * tables, of the present ones the seated customers less discount * tables.
    """
    tables, norm = np.ones(len(customers), dtype=np.int64), np.zeros(len(customers))
    active, seated = np.flatnonzero(customers > 1), 1
    while len(active):
        step = 1 if seated < EXACT else seated // 256
        t = tables[active]
        new = fresh[active] + grows[active] * t
        both = new + np.maximum(seated - discount * t, 0)
        here = np.minimum(step, customers[active] - seated)
        chance = new / both
        opened = (rng.random(len(active)) < chance).astype(np.int64) if step == 1 else rng.binomial(here, np.minimum(chance, 1.0))
        tables[active] = t + opened
        norm[active] += here * np.log(both)
        seated += step
        active = active[customers[active] > seated]
    return tables, norm


def frequent(docs: DataFrame) -> Codes:
    """The frequent words of the training texts, the beginning of a text and its end; hot are all that make HOT_SHARE of the tokens, and at most 2 / HOT_SHARE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # What stays below in each run is less than half of the share together.
            often = n >= CODE_SHARE / 2 * size
            return pa.RecordBatch.from_arrays([pa.array([*word[often].view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n[often], size))], names=["word", "n"])

        for rows in batches:
            for _, _, _, word, _ in tokens(rows.column(0)):
                held.append(word)
                size += len(word)
                if size >= ROW_BLOCK:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    found = docs.where(~F.col("held_out")).select("text").mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = checkpointed(found)
    size = (found.where("word IS NULL").first() or (None, 0))[1]
    rows = found.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(CODES).collect()
    name = lambda wanted: np.array([r.word for r in rows if r.n >= wanted], dtype=np.int64).view(np.uint64)
    hot = name(HOT_SHARE / 2 * size)
    # There are as many beginnings as ends.
    ends = [np.array([0, END], dtype=np.uint64)]
    return Codes(np.concatenate(ends + [name(0)]), np.concatenate([hot, *(ends if END in hot else [])]))


def count_pairs(docs: DataFrame, columns: int, codes: Codes) -> DataFrame:
    """Messages of pairs to blocks of contexts, with the number of contexts of words whose pair comes again; words; sums: steps 1 and 2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, context = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            column = codes.column(word, context, columns)
            order = by_column(column, word, context)
            word, context, column = word[order], context[order], column[order]
            new = starts_of(word, context)
            times = np.diff(np.append(new, len(word)))
            word, context, column = word[new], context[new], column[new]
            return rows_of([message(c, PAIRS, *codes.put_pairs(word[s], context[s]), put(times[s], "<u4")) for c, s in parts(column, columns)])

        for rows in batches:
            for _, _, _, word, context in tokens(rows.column(0)):
                held.append((word, context))
                size += len(word)
                if size >= ROW_BLOCK:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        here = int(rows.column("column")[0].as_py())
        found = [(*codes.got_pairs(r), got(r["f"], "<u4")) for r in rows.to_pylist()]
        word, context, times = joined([f[0] for f in found]), joined([f[1] for f in found]), joined([f[2] for f in found], "<u4")
        order = grouped(word, context)
        word, context, times = word[order], context[order], times[order].astype(np.int64)
        new = starts_of(word, context)
        word, context, times = word[new], context[new], np.add.reduceat(times, new)
        start = starts_of(word)
        kinds = np.diff(np.append(start, len(word)))
        total = np.add.reduceat(times, start)
        place, is_hot = find_in(codes.hot, word[start])
        out = [message(here, WORDS, put(word[start][~is_hot], "<u8"), put(total[~is_hot], "<u8"), put(kinds[~is_hot], "<u4"))]
        out += numbers(OF_WORD, place[is_hot], total[is_hot], kinds[is_hot])
        few = kinds[~is_hot]
        out += numbers(OF_ALL, np.arange(4), np.array([times.sum(), len(few), (times == 1).sum(), (few == 1).sum()]), np.array([len(word), 0, (times == 2).sum(), (few == 2).sum()]))
        code, has = codes.find(context)
        customers, dishes = np.bincount(code[has], times[has], len(codes.names)).astype(np.int64), np.bincount(code[has], minlength=len(codes.names))
        seen = np.flatnonzero(dishes)
        out += numbers(OF_CONTEXT, seen, customers[seen], dishes[seen])
        kinds = np.repeat(kinds, kinds)
        column = codes.column(context, word, columns)
        order = by_column(column, context, word)
        word, context, times, kinds, column = word[order], context[order], times[order], kinds[order], column[order]
        for c, s in parts(column, columns):
            out.append(message(c, PAIRS, *codes.put_pairs(context[s], word[s]), put(times[s], "<u4"), put(kinds[s][times[s] > 1], "<u4")))
        return table_of(out)

    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(tidy(count), SQL_SCHEMA)
    return checkpointed(counted.groupBy("column").applyInArrow(merge, SQL_SCHEMA))


def summed(messages: DataFrame, codes: Codes) -> dict[int, np.ndarray]:
    """x and y of the kinds that are summed, by key: some numbers of each hot word and of each code."""
    out = {OF_CONTEXT: np.zeros((len(codes.names), 2), np.int64), OF_WORD: np.zeros((len(codes.hot), 2), np.int64), OF_ALL: np.zeros((4, 2), np.int64)}
    for r in messages.where(F.col("kind").isin(*out)).groupBy("kind", "block").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect():
        out[r.kind][r.block] = r.x, r.y
    return out


def seat_contexts(counted: DataFrame, columns: int, codes: Codes, told: dict) -> DataFrame:
    """Messages of pairs with their tables to blocks of words; tables beyond one a pair, by word; contexts; sums; hot pairs: the rest of step 2."""
    d, d0, base = told["discount"], told["root_discount"], 1.0 / (told["words"] + 1)
    least = max(2, int(np.ceil(HOT_PAIR * told["tokens"])))

    def run(rows: pa.Table) -> pa.Table:
        here = int(rows.column("column")[0].as_py())
        rng = np.random.default_rng([SEED, here])
        found = []
        for r in rows.to_pylist():
            context, word = codes.got_pairs(r)
            times = got(r["f"], "<u4").astype(np.int64)
            kinds = np.zeros(len(times), np.int64)
            kinds[times > 1] = got(r["g"], "<u4")
            found.append((context, word, times, kinds))
        context, word, times, kinds = (joined([f[i] for f in found], k) for i, k in enumerate(("<u8", "<u8", "<i8", "<i8")))
        order = grouped(context, word)
        context, word, times, kinds = context[order], word[order], times[order], kinds[order]
        start = starts_of(context)
        names = context[start]
        of = np.repeat(np.arange(len(names)), np.diff(np.append(start, len(context))))
        code, has_code = codes.find(names)
        # A hot context is in several blocks: its other tables are those of one a dish.
        elsewhere = np.where(codes.is_hot(names), told["dishes"][code] - np.bincount(of), 0)
        several = np.flatnonzero(times > 1)
        place, is_hot = find_in(codes.hot, word[several])
        parents_kinds = np.where(is_hot, told["hot_kinds"][place] if len(codes.hot) else 0, kinds[several])
        parent = (parents_kinds - d0 + (ROOT_STRENGTH + d0 * told["words"]) * base) / (ROOT_STRENGTH + told["pairs"])
        seats, norm = np.ones(len(times), np.int64), np.full(len(several), -np.inf)
        sums = np.full(len(times), SAMPLES, np.int64)
        sums[several] = 0
        for sweep in range(BURN + SAMPLES if len(several) else 0):
            tables = np.bincount(of, seats).astype(np.int64) + elsewhere
            others = tables[of[several]] - seats[several]
            new, z = seat(times[several], (STRENGTH + d * others) * parent, d * parent, d, rng)
            taken = np.log(rng.random(len(several))) < z - norm
            seats[several[taken]], norm[taken] = new[taken], z[taken]
            if sweep >= BURN:
                sums[several] += seats[several]
        customers, tables = np.bincount(of, times).astype(np.int64), np.bincount(of, sums).astype(np.int64)
        out = [message(here, CONTEXTS, put(names[~has_code], "<u8"), put(customers[~has_code], "<u4"), put(tables[~has_code], "<u4"))]
        out += numbers(OF_CONTEXT, code[has_code], customers[has_code], tables[has_code])
        often = np.flatnonzero(times >= least)
        for i in often.tolist():
            out.append(message(0, HOT, put(np.array([word[i], context[i]]), "<u8"), put(np.array([times[i], sums[i], customers[of[i]], tables[of[i]]]), "<i8")))
        more = np.flatnonzero(sums > SAMPLES)
        by_word, inverse = np.unique(word[more], return_inverse=True)
        extra = np.bincount(inverse, sums[more] - SAMPLES, len(by_word)).astype(np.int64)
        place, is_hot = find_in(codes.hot, by_word)
        out += numbers(OF_WORD, place[is_hot], extra[is_hot])
        by_word, extra = by_word[~is_hot], extra[~is_hot]
        column = codes.column(by_word, by_word, columns)
        order = np.argsort(column, kind="stable")
        by_word, extra, column = by_word[order], extra[order], column[order]
        out += [message(c, EXTRA, put(by_word[s], "<u8"), put(extra[s], "<u4")) for c, s in parts(column, columns)]
        column = codes.column(word, context, columns)
        order = by_column(column, word, context)
        column, rare = column[order], ~has_code[of[order]]
        for c, s in parts(column, columns):
            i, r = order[s], order[s][rare[s]]
            totals = put(np.concatenate([customers[of[r]], tables[of[r]]]), "<u4")
            out.append(message(c, PAIRS, *codes.put_pairs(word[i], context[i]), put(times[i], "<u4"), put(sums[i][times[i] > 1], "<u4"), totals))
        return table_of(out)

    return checkpointed(counted.where(F.col("kind") == PAIRS).groupBy("column").applyInArrow(run, SQL_SCHEMA))


def root_seats(guests: np.ndarray, told: dict, seed: int) -> np.ndarray:
    """Tables of each word in the parent, of which it is guests customers."""
    d0, base = told["root_discount"], 1.0 / (told["words"] + 1)
    fresh = np.full(len(guests), (ROOT_STRENGTH + d0 * told["words"]) * base)
    rng = np.random.default_rng([SEED, seed])
    seats, norm = np.ones(len(guests), np.int64), np.full(len(guests), -np.inf)
    for _ in range(BURN + 1):
        new, z = seat(guests, fresh, np.full(len(guests), d0 * base), d0, rng)
        taken = np.log(rng.random(len(guests))) < z - norm
        seats[taken], norm[taken] = new[taken], z[taken]
    return seats


def seat_words(counted: DataFrame, seated: DataFrame, told: dict) -> DataFrame:
    """Words with their counts, customers (times SAMPLES) and tables in the parent; x and y are the sums of the latter two: step 3."""

    def run(rows: pa.Table) -> pa.Table:
        here = int(rows.column("column")[0].as_py())
        rows = rows.to_pylist()
        own = next((r for r in rows if r["kind"] == WORDS), None)
        if own is None:
            return table_of([])
        word, total, kinds = got(own["a"], "<u8"), got(own["b"], "<u8"), got(own["c"], "<u4")
        customers = kinds.astype(np.int64) * SAMPLES
        for r in rows:
            if r["kind"] == EXTRA:
                customers[find_in(word, got(r["a"], "<u8"))[0]] += got(r["b"], "<u4")
        seats = root_seats(customers // SAMPLES, told, here)
        return table_of([message(here, WORDS, put(word, "<u8"), put(total, "<u8"), put(customers, "<u8"), put(seats, "<u4"), x=int(customers.sum()), y=int(seats.sum()))])

    both = counted.where(F.col("kind") == WORDS).unionByName(seated.where(F.col("kind") == EXTRA))
    return checkpointed(both.groupBy("column").applyInArrow(run, SQL_SCHEMA))


@dataclass
class Model:
    """pairs and contexts are messages of seat_contexts, words those of seat_words; told holds numbers, some for each code and each hot word."""

    codes: Codes
    columns: int
    told: dict
    pairs: DataFrame
    words: DataFrame
    contexts: DataFrame
    hot_pairs: np.ndarray  # word, context, log10 of the probability, log10 of the word's count + 1

    def parent(self, customers: np.ndarray, seats: np.ndarray) -> np.ndarray:
        """The parent's probability of words of so many customers (times SAMPLES) and tables."""
        return parent_of(self.told, customers, seats)


def parent_of(told: dict, customers: np.ndarray, seats: np.ndarray) -> np.ndarray:
    d0 = told["root_discount"]
    return (customers / SAMPLES - d0 * seats + (ROOT_STRENGTH + d0 * told["root_tables"]) / (told["words"] + 1)) / (ROOT_STRENGTH + told["root_customers"])


def context_weight(told: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The share of a context that goes to the parent; tables are times SAMPLES."""
    return (STRENGTH + told["discount"] * tables / SAMPLES) / (STRENGTH + customers)


def in_context(told: dict, times: np.ndarray, seats: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """A known pair's probability; seats and tables are times SAMPLES."""
    return (times - told["discount"] * seats / SAMPLES) / (STRENGTH + customers) + context_weight(told, customers, tables) * parent


def learn(docs: DataFrame, columns: int) -> Model:
    """docs: text, held_out."""
    codes = frequent(docs)
    counted = count_pairs(docs, columns, codes)
    release(docs.sparkSession)
    sums = summed(counted, codes)
    (tokens_, pairs), (vocabulary, _), once_twice, root_once_twice = sums[OF_ALL].tolist()
    total, kinds = sums[OF_WORD].T
    discount = lambda once, twice: float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
    told = {
        "tokens": tokens_, "pairs": pairs, "words": vocabulary + int((kinds > 0).sum()), "discount": discount(*once_twice), "root_discount": discount(root_once_twice[0] + int((kinds == 1).sum()), root_once_twice[1] + int((kinds == 2).sum())),
        "hot_count": total, "hot_kinds": kinds, "dishes": sums[OF_CONTEXT][:, 1],
    }
    seated = seat_contexts(counted, columns, codes, told)
    sums = summed(seated, codes)
    told |= {"customers": sums[OF_CONTEXT][:, 0], "tables": sums[OF_CONTEXT][:, 1], "hot_customers": kinds * SAMPLES + sums[OF_WORD][:, 0]}
    told["hot_seats"] = np.where(kinds > 0, root_seats(told["hot_customers"] // SAMPLES, told, columns), 0)
    worded = seat_words(counted, seated, told)
    del counted
    release(docs.sparkSession)
    of_rest = worded.agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    told |= {"root_customers": (of_rest[0] + int(told["hot_customers"].sum())) / SAMPLES, "root_tables": of_rest[1] + int(told["hot_seats"].sum())}
    kind = lambda k: seated.where(F.col("kind") == k)
    model = Model(codes, columns, told, kind(PAIRS), worded, kind(CONTEXTS), np.zeros((0, 4)))
    model.hot_pairs = hot_pairs(model, kind(HOT))
    return model


def hot_pairs(model: Model, found: DataFrame) -> np.ndarray:
    """Of the pairs that make HOT_PAIR of the tokens, 1 / HOT_PAIR at most, what scores them."""
    told, codes = model.told, model.codes
    rows = found.select("a", "b").collect()
    if not rows:
        return np.zeros((0, 4))
    word, context = np.array([got(r.a, "<u8") for r in rows]).T
    times, seats, customers, tables = np.array([got(r.b, "<i8") for r in rows]).T
    code, has = codes.find(context)
    customers, tables = np.where(has, told["customers"][code], customers), np.where(has, told["tables"][code], tables)
    asked = np.unique(word)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                at, has = find_in(asked, got(r["a"], "<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(at[has]), *(pa.array(got(r[n], k).astype(np.int64)[has]) for n, k in (("b", "<u8"), ("c", "<u8"), ("d", "<u4")))], names=["place", "n", "customers", "seats"])

    n, guests, root = np.zeros((3, len(asked)), np.int64)
    for r in model.words.select("a", "b", "c", "d").mapInArrow(pick, "place long, n long, customers long, seats long").collect():
        n[r.place], guests[r.place], root[r.place] = r.n, r.customers, r.seats
    place, is_hot = find_in(codes.hot, asked)
    n[is_hot], guests[is_hot], root[is_hot] = (told[k][place[is_hot]] for k in ("hot_count", "hot_customers", "hot_seats"))
    of = np.searchsorted(asked, word)
    p = in_context(told, times, seats, customers, tables, model.parent(guests, root)[of])
    key = np.argsort(pair_key(word, context))
    return np.stack([word.view(np.float64), context.view(np.float64), np.log10(p), np.log10(n[of] + 1.0)], axis=1)[key]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """id, held_out, n_tokens, n_known, base_score, score: step 4."""
    told, codes, columns = model.told, model.codes, model.columns
    n, v = told["tokens"], told["words"]
    log_unknown = float(np.log10(model.parent(np.zeros(1), np.zeros(1))[0]))
    code_weight = np.log10(context_weight(told, told["customers"], told["tables"]))
    hot_parent, hot_base = model.parent(told["hot_customers"], told["hot_seats"]), np.log10(told["hot_count"] + 1.0)
    sent = docs.sparkSession.sparkContext.broadcast(model.hot_pairs)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_word, hot_context = (sent.value[:, i].copy().view(np.uint64) for i in (0, 1))
        hot_key = pair_key(hot_word, hot_context)
        logp, pair_base = sent.value[:, 2].copy(), sent.value[:, 3].copy()
        held: list[tuple] = []
        docs_held = tokens_held = flushes = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal flushes
            ids, held_out, count, known, base, score, word, context, row = (np.concatenate([h[i] for h in held]) for i in range(9))
            held.clear()
            column = codes.column(word, context, columns)
            order = by_column(column, word, context)
            word, context, row, column = word[order], context[order], row[order], column[order]
            start = starts_of(word, context)
            ends = np.append(start, len(word))
            name = task << 24 | flushes
            flushes += 1
            out = [message(-1 - name % columns, HEAD, put(ids, "<i8"), put(held_out, "u1"), put(count, "<u4"), put(known, "<u4"), put(base, "<f8"), put(score, "<f8"), block=name)]
            for c, s in parts(column[start], columns):
                at = start[s]
                out.append(message(c, QUERY, *codes.put_pairs(word[at], context[at]), put(np.diff(ends[s.start : s.stop + 1]), "<u4"), put(row[ends[s.start] : ends[s.stop]], "<u2"), block=name))
            return rows_of(out)

        for rows in batches:
            ids, out = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
            for first, k, row, word, context in tokens(rows.column(2)):
                if docs_held + k > ROWS:
                    yield flush()
                    docs_held = tokens_held = 0
                at, _ = find_in(hot_key, pair_key(word, context))
                is_hot = (hot_word[at] == word) & (hot_context[at] == context) if len(hot_key) else np.zeros(len(word), bool)
                r, h = row[is_hot], at[is_hot]
                cold = ~is_hot
                held.append((ids[first : first + k], out[first : first + k], np.bincount(row, minlength=k), np.bincount(r, minlength=k), np.bincount(r, pair_base[h], k), np.bincount(r, logp[h], k), word[cold], context[cold], row[cold] + docs_held))
                docs_held += k
                tokens_held += len(word)
                if tokens_held >= ROW_BLOCK:
                    yield flush()
                    docs_held = tokens_held = 0
        if docs_held:
            yield flush()

    def look_up(rows: pa.Table) -> pa.Table:
        """A column block of words: for each row block the sums of its documents' tokens here, and the contexts whose weight is to be asked for."""
        if rows.column("column")[0].as_py() < 0:
            return rows
        by_kind: dict[int, list[dict]] = {}
        for r in rows.to_pylist():
            by_kind.setdefault(r["kind"], []).append(r)
        own = by_kind.get(WORDS, [])
        names, total, customers, seats = (got(own[0][a], k) if own else np.zeros(0, k) for a, k in zip("abcd", ("<u8", "<u8", "<u8", "<u4"), strict=True))
        parent = parent_of(told, customers, seats)

        def of_words(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Whether the training rows have it, log10 of its count + 1, and the parent's probability."""
            at, known = find_in(names, word)
            base, p0 = np.zeros(len(word)), np.full(len(word), 10**log_unknown)
            base[known], p0[known] = np.log10(total[at[known]] + 1.0), parent[at[known]]
            place, is_hot = find_in(codes.hot, word)
            is_hot &= told["hot_count"][place] > 0 if len(codes.hot) else False
            base[is_hot], p0[is_hot] = hot_base[place[is_hot]], hot_parent[place[is_hot]]
            return known | is_hot, base, p0

        keys, logs = [], []
        for r in by_kind.get(PAIRS, []):
            word, context = codes.got_pairs(r)
            times = got(r["f"], "<u4").astype(np.int64)
            tables_of = np.full(len(times), SAMPLES, np.int64)
            tables_of[times > 1] = got(r["g"], "<u4")
            code, has = codes.find(context)
            customers_in, tables_in = told["customers"][code], told["tables"][code]
            customers_in[~has], tables_in[~has] = got(r["h"], "<u4").reshape(2, -1)
            start = starts_of(word)
            p0 = np.repeat(of_words(word[start])[2], np.diff(np.append(start, len(word))))
            keys.append(pair_key(word, context))
            logs.append(np.log10(in_context(told, times, tables_of, customers_in, tables_in, p0)))
        key, log = joined(keys), joined(logs, "<f8")
        order = np.argsort(key)
        key, log = key[order], log[order]
        del keys, logs, order
        out = []
        for r in by_kind.get(QUERY, []):
            firsts, per_word = codes.got(r["a"], r["b"]), got(r["c"], "<u4")
            known, base, p0 = (np.repeat(x, per_word) for x in of_words(firsts))
            word, context = np.repeat(firsts, per_word), codes.got(r["d"], r["e"])
            at, seen = find_in(key, pair_key(word, context))
            score = np.log10(p0)
            score[seen] = log[at[seen]]
            code, has = codes.find(context)
            score += np.where(has & ~seen, code_weight[code], 0.0)
            times, row = got(r["f"], "<u4"), got(r["g"], "<u2")
            asks = np.repeat(~has & ~seen, times)
            if asks.any():
                late, late_row = np.repeat(context, times)[asks], row[asks]
                column = codes.column(late, late, columns)
                order = np.argsort(column, kind="stable")
                late, late_row = late[order], late_row[order]
                out += [message(c, LATE, put(late[s], "<u8"), put(late_row[s], "<u2"), block=r["block"]) for c, s in parts(column[order], columns)]
            present = np.flatnonzero(np.bincount(row))
            known, base, score = (np.bincount(row, np.repeat(x, times))[present] for x in (known, base, score))
            out.append(message(-1, ANSWER, put(np.diff(present, prepend=0), "<u2"), put(known, "<u4"), put(base, "<f8"), put(score, "<f4"), block=r["block"]))
        return table_of(out)

    def weigh(rows: pa.Table) -> pa.Table:
        """A block of contexts: the sums of the weights asked for. A context that the training rows do not have gives all to the parent."""
        rows = rows.to_pylist()
        own = next((r for r in rows if r["kind"] == CONTEXTS), None)
        names, customers, tables = (got(own[a], k) if own else np.zeros(0, k) for a, k in zip("abc", ("<u8", "<u4", "<u4"), strict=True))
        weight = np.log10(context_weight(told, customers, tables))
        out = []
        for r in rows:
            if r["kind"] == LATE:
                at, has = find_in(names, got(r["a"], "<u8"))
                row = got(r["b"], "<u2")
                present = np.flatnonzero(np.bincount(row))
                log = np.zeros(len(at))
                log[has] = weight[at[has]]
                none = np.zeros(len(present))
                out.append(message(-1, ANSWER, put(np.diff(present, prepend=0), "<u2"), put(none, "<u4"), put(none, "<f8"), put(np.bincount(row, log)[present], "<f4"), block=r["block"]))
        return table_of(out)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        head = next(r for r in rows if r["kind"] == HEAD)
        ids, held_out, count, known, base, score = (got(head[a], k).copy() for a, k in zip("abcdef", ("<i8", "u1", "<u4", "<u4", "<f8", "<f8"), strict=True))
        # In a fixed order: sums of floating-point numbers then agree between runs.
        for r in sorted((r for r in rows if r["kind"] == ANSWER), key=lambda r: (r["a"], r["b"], r["c"], r["d"])):
            at = np.cumsum(got(r["a"], "<u2").astype(np.int64))
            known[at] += got(r["b"], "<u4")
            base[at] += got(r["c"], "<f8")
            score[at] += got(r["d"], "<f4")
        return pa.table(
            {
                "id": pa.array(ids), "held_out": pa.array(held_out > 0), "n_tokens": pa.array(count.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                "base_score": pa.array(base - count * np.log10(n + v + 1.0)), "score": pa.array(score),
            }
        )

    posted = docs.select("id", "held_out", "text").mapInArrow(tidy(post), SQL_SCHEMA)
    found = checkpointed(posted.unionByName(model.words).unionByName(model.pairs).groupBy("column").applyInArrow(look_up, SQL_SCHEMA))
    release(docs.sparkSession)
    late = found.where(F.col("kind") == LATE).unionByName(model.contexts).groupBy("column").applyInArrow(weigh, SQL_SCHEMA)
    done = found.where(F.col("kind").isin(HEAD, ANSWER))
    return done.unionByName(late).groupBy("block").applyInArrow(add, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(df: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; held_out is over df. Ids are integers; a null id stays null."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = learn(docs, max(1, -(-(size // 6) // COLUMN_BLOCK)))
    scored = score_documents(docs, model)
    return scored.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.told["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7
    return score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", remainder == 2)


QUERIES = {"op10_pitman_yor": op10_pitman_yor}
ORACLE: dict[str, str] = {}
