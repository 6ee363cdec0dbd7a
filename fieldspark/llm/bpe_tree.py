"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Method. A text is halved recursively down to leaves of about a thousand
characters, wherever a halving falls. Each half becomes a run of matches of the
split pattern. Two neighbours are joined by matching again only a window around their
boundary, and the window grows until the matches outside it provably stay as they
are:

* A match of the pattern depends on no more than two characters after its end (a
  contraction looks at three characters, white space looks one past its run). So a
  match of the left half stands if it ends two characters before the half does.
* Matching has no memory: once the window has a match boundary that is also one of
  the right half, everything after it is as the right half has it.

Long matches (a run of letters without a break) are encoded by the same reduction one
level down, over their bytes: the tokens of two halves are joined by merging a window
again around the boundary, and the window grows until both of its edges are
compatible pairs (merging the bytes of the two tokens at an edge gives back those two
tokens). A sequence of tokens is the encoding of its bytes exactly if all
neighbours in it are compatible, so tokens outside the window can't change.

Decoding concatenates the bytes of tokens up the same tree.

Edge cases. A null or empty text has no tokens, and decodes to no bytes. Texts of any
length are taken whole: work grows in proportion to their length. Ids, ties and
repeated rows have no influence; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, PIECE, CACHE = 4096, 48, 400_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id, from a rank file: a token in base64 and its id on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


#: Characters for which the classes \\p{L}, \\p{N} and \\s are short lists: ASCII and the letters of Latin-1.
NARROW = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
LISTS = ((r"\p{L}", "A-Za-zÀ-ÖØ-öø-ÿ"), (r"\p{N}", "0-9"))


def narrow(pattern: str) -> re.Pattern | None:
    """The same pattern for narrow texts, with its classes as lists, which match faster; None where it has other classes."""
    plain = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", lambda m: m[0] if m[0][0] == "[" else f"[{m[0]}]", pattern)
    for name, chars in LISTS:
        plain = plain.replace(name, chars)
    try:
        return None if r"\p" in plain or r"\X" in plain else re.compile(plain, re.ASCII)
    except re.error:
        return None


class ByteBpe:
    """Encoder and decoder for one set of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE):
        self.ranks, self.leaf, self.piece = ranks, leaf, piece
        self.wide, self.narrow = regex.compile(pattern), narrow(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        #: Id of the token that two neighbouring tokens make, for every way to cut a token in two.
        self.makes = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.known: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    # Tokens of one match.

    def merged(self, piece: bytes) -> list[int]:
        """Merges neighbours of the lowest rank, leftmost first, until none has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        makes, none = self.makes.get, 1 << 62
        ids = [self.byte[c] for c in piece]
        pairs = [makes(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            at = pairs.index(least)
            ids[at] = least
            del ids[at + 1], pairs[at]
            if at:
                pairs[at - 1] = makes(ids[at - 1] << 32 | least, none)
            if at < len(pairs):
                pairs[at] = makes(least << 32 | ids[at + 1], none)
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together."""
        key = a << 32 | b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= 2 * CACHE:
                self.fits.clear()
            got = self.fits[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return got

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring byte strings, from the tokens of each."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(self.token[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.compatible(left[i - 1], window[0])) and (j == len(right) or self.compatible(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def reduced(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.reduced(piece[:half]), self.reduced(piece[half:]))

    # Matches of a text.

    def find(self, text: str) -> list[str]:
        return (self.narrow if self.narrow and NARROW.fullmatch(text) else self.wide).findall(text)

    def matches(self, text: str) -> list[str]:
        """All matches of the pattern in text, by halving it and joining the halves."""
        if len(text) <= self.leaf:
            return self.find(text)
        half = len(text) // 2
        return self.matched(self.matches(text[:half]), self.matches(text[half:]), half)

    def matched(self, left: list[str], right: list[str], half: int) -> list[str]:
        """Joins the matches of two halves; half is the length of the left one."""
        keep, end = len(left), half
        while keep and end + 2 > half:  # the match that ends there still depends on what follows
            keep -= 1
            end -= len(left[keep])
        head = "".join(left[keep:])
        width = 1
        while True:
            window = head + "".join(right[:width])
            whole = width >= len(right)
            edges = {}
            at = len(head)
            for k, match in enumerate(right[:width]):
                edges[at] = k
                at += len(match)
            got, at = [], 0
            for match in self.find(window):
                if at in edges and (whole or at + 2 <= len(window)):
                    return left[:keep] + got + right[edges[at] :]
                if not whole and at + len(match) + 2 > len(window):
                    break  # this match may change with what follows
                got.append(match)
                at += len(match)
            if whole:
                return left[:keep] + got
            width *= 2

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; special tokens are ordinary text."""
        found = self.matches(text)
        known = self.known
        long = {}
        for match in set(found).difference(known):
            row = self.reduced(match.encode())
            (known if len(match) <= 64 else long)[match] = struct.pack(f"<{len(row)}I", *row)
        out = b"".join(map((ChainMap(known, long) if long else known).__getitem__, found))
        if len(known) > CACHE:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(raw: bytes, pattern: str) -> ByteBpe:
    """One coder for a worker process, whose bounded caches later tasks use again."""
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(read_ranks(raw), pattern)
    return _coders[key]


def encode(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row; with keep_ids also ids, an array of int.

    tokenizer_path is read once, on the driver, and its bytes (under a megabyte for
    50,000 tokens, whatever the data) are broadcast.
    """
    with open(tokenizer_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(raw.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, ids_sha, text_sha, every = [], [], [], []
                for text in part.column(1).to_pylist():
                    packed = bpe.encode(text or "")
                    ids = np.frombuffer(packed, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if keep_ids:
                        every.append(ids)
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids): the reverse of encode(keep_ids=True). Null ids give an empty text."""
    with open(tokenizer_path, "rb") as file:
        raw = tokens.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(raw.value, r"\X")
        for batch in batches:
            text = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    out = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
