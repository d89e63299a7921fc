"""Byte-level BPE encoding and decoding with the merge ranks of a public vocabulary.

A text is split into chunks of white space and what follows up to the next white space; no match of the
splitting pattern crosses a chunk's end, so the ids of a chunk depend on the chunk alone and are
memoised per worker (up to PARTS and PIECES, then the memo starts anew: it bounds memory and changes no result). A pre-token is encoded by backtracking: an Aho-Corasick automaton over the vocabulary, its
bytes mapped to Latin-1 characters, gives every token that lies in the pre-token; from the left the longest
match is tried first, and accepted if it is compatible with the token before it, that is, if merging by rank
would not have joined the two otherwise. Compatibility of two tokens is decided once and memoised. Each
place is left for a shorter match at most once, so time is linear in the length, also for a pre-token of
a million letters, and the ids are those of merging by rank.

Nulls and odd rows: a null text is empty: no ids, the hash of the empty string. Repeated rows and ids get equal
values; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import batch, table, tidy

#: Parts, and pre-tokens (and pairs of tokens), that a worker remembers.
PARTS, PIECES = 80_000, 150_000

#: Unicode's White_Space, which is what `\s` means to the pattern's library.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: A text without this can be cut at each space (U+0020): every part ends a chunk.
SPACE_BEFORE_SPACE = rf"[{SPACE}](?: |\Z)"

#: Neither letters, digits, white space nor the apostrophe that begins a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Memo(dict):
    """ids of a string, made where they are missing; long strings are not kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.make(text)
        if len(text) < 64:
            self[text] = ids
        return ids


class Bpe:
    """Encoder and decoder for one file of ranks (lines of a base64 token and its rank)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.bytes = [self.token.get(i, "").encode("latin-1") for i in range(max(self.token) + 1)]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.chunks = regex.compile(CHUNK)
        self.size = [len(b) for b in self.bytes]
        self.single = {t: i for t, i in self.rank.items() if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            if len(t) > 1:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.uncut = re.compile(SPACE_BEFORE_SPACE)
        self.of_piece = Memo(self.encode_piece)
        self.of_part = Memo(self.encode_part)

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None for a single byte."""
        if i not in self.split:
            text = self.token[i]
            parts = list(text)
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], 1 << 60))
                if parts[best] + parts[best + 1] not in self.rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.split[i] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.split[i]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in a merged sequence.

        Undoing both tokens' merges from the latest on, no pair across their border may be one that would have merged earlier.
        """
        key = left << 32 | right
        if (known := self.compatible.get(key)) is not None:
            return known
        rank, token, limit, a, b = self.rank, self.token, 1 << 60, left, right
        good = True
        while True:
            joined = rank.get(token[a] + token[b])
            if joined is not None and joined < limit:
                good = False
                break
            # The later of the two merges is undone; of equals, the right one, as merging goes from the left.
            if a > b:
                limit, split = a, self.halves(a)
                if split is None:
                    limit, split = b + 1, self.halves(b)
                    if split is None:
                        break
                    b = split[0]
                else:
                    a = split[1]
                    # A pair across the border merged before token a's own last merge, never at the same rank on its right.
            else:
                split = self.halves(b)
                limit = b + 1
                if split is None:
                    limit, split = a, self.halves(a)
                    if split is None:
                        break
                    a = split[1]
                else:
                    b = split[0]
        if len(self.compatible) > PIECES:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def shorter(self, i: int) -> int | None:
        """The longest token that is a proper prefix of token i."""
        if i not in self.prefix:
            text = self.token[i]
            self.prefix[i] = next((self.rank[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.rank), None)
        return self.prefix[i]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        if (whole := self.rank.get(text)) is not None:
            return (whole,)
        n, size, compatible = len(text), self.size, self.compatible
        longest = [self.single[c] for c in text]
        for end, i in self.automaton.iter(text):
            longest[end + 1 - size[i]] = i  # ends ascend, so the last one is the longest
        ids: list[int] = []
        dead: set[int] = set()  # places from which no compatible way leads on
        place, i = 0, longest[0]
        while True:
            end = place + size[i]
            if end not in dead:
                good = True
                if ids:
                    good = compatible.get(ids[-1] << 32 | i)
                    if good is None:
                        good = self.fits(ids[-1], i)
                if good:
                    ids.append(i)
                    if end == n:
                        return tuple(ids)
                    place, i = end, longest[end]
                    continue
            while (i := self.shorter(i)) is None:
                dead.add(place)
                i = ids.pop()
                place -= size[i]

    def encode_part(self, part: str) -> tuple[int, ...]:
        """The ids of a space and a part without spaces. Letters, then marks other than an apostrophe, are two pre-tokens without asking the pattern."""
        word = part.rstrip(MARKS)
        if word.isalpha():
            ids = self.of_piece[" " + word]
            return ids if len(word) == len(part) else ids + self.of_piece[part[len(word) :]]
        return self.encode_chunks(" " + part)

    def encode_chunks(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable([self.of_piece[piece] for chunk in self.chunks.findall(text) for piece in self.pieces.findall(chunk)]))

    def encode(self, text: str) -> list[int]:
        for memo, most in ((self.of_part, PARTS), (self.of_piece, PIECES)):
            if len(memo) > most:
                memo.clear()
        if self.uncut.search(text):
            # Parts join until one ends a chunk; what ends the text is a chunk anyway.
            parts, open_part = [], None
            for part in text.split(" "):
                open_part = part if open_part is None else f"{open_part} {part}"
                if part and not part[-1].isspace():
                    parts.append(open_part)
                    open_part = None
            if open_part is not None:
                parts.append(open_part)
        else:
            parts = text.split(" ")
        return [*self.encode_chunks(parts[0]), *chain.from_iterable(map(self.of_part.__getitem__, parts[1:]))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(ranks_path: str, pattern: str) -> Bpe:
    """One per worker process."""
    return Bpe(ranks_path, pattern)


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """id_col and ids (array of int) of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([coder.encode(t or "") for t in part.column(1).to_pylist()], type=pa.list_(pa.int32()))], names=["id", "ids"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """id_col and the decoded bytes of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([coder.decode(i or []) for i in rows.column(1).to_pylist()], type=pa.binary())], names=["id", "decoded"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(tidy(run), f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, a text's ids held only while it is read."""
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)
        decimal = [str(i) for i in range(len(coder.bytes))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for rows in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in rows.column(1):
                ids = coder.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()))
                decoded_sha.append(sha(coder.decode(ids)))
            yield batch(out, id=rows.column(0), n_tokens=n, ids_sha256=ids_sha, decoded_sha256=decoded_sha)

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the splitting pattern of the installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "doc_id", "text", *vocabulary())


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
