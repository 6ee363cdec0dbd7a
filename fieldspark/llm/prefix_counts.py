"""Exact token counts of every prefix of a text, by prefix dynamic programming.

Method. One pass over a text stores, for each of its prefixes (by code points), how many tokens
the tokenizer makes of that prefix alone. How often a text is cut, and where, then costs a look into
the stored row: no text is encoded again.

* Within one match of the split pattern: a sequence of byte-level BPE tokens is the encoding of
  its bytes exactly if every two neighbours in it are compatible (merging their bytes gives back the two). So
  each prefix has one last token, the one vocabulary entry that ends there and is compatible with
  the last token of the prefix before it, and ``count[i] = count[i - length] + 1``. Candidates are found by walking a
  tree of reversed tokens. Rows of matches are kept, within a bound, since words come again.
* Across matches: a match depends on what follows it in two cases only. A run of white space leaves its last character to the
  next match unless the text ends there, so the prefix that ends with the run counts the run as a whole; and
  the middle of a contraction of three characters (``'re``) is a mark and a letter.
* Strings of special tokens cut a text in segments, as the library does by default: complete they are one
  token, and their prefixes are ordinary text.

What is a letter, a digit or white space is asked of the library, as its tables of Unicode are older than
those of the pattern module: a character on which the two disagree is matched through a stand-in of the library's class.

Edge cases. A null or empty text has no prefixes and no tokens. Texts of any length are taken
whole. Ids, ties and repeated rows have no influence; extra columns are ignored. An empty table gives
an empty table. A limit that is null gives null; one below the count of the first code point cuts everything.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..numbering import running_sum
from .bpe_tree import NARROW, narrow
from .shared import unused

#: Code points of one output batch, about; entries of the rows of matches that a worker keeps; compatible pairs it keeps; bytes of a match whose prefixes are shared.
BATCH, ROWS, PAIRS, SHARED = 1 << 20, 1 << 22, 1 << 20, 48
#: Contractions of three characters; one character of each class that all versions of Unicode agree on.
CONTRACTIONS = {"'re", "'ve", "'ll"}
STAND_IN = {"letter": "a", "digit": "1", "mark": "!", "space": " "}


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts for one vocabulary file of byte-level BPE and its split pattern."""

    def __init__(self, raw: bytes, pattern: str):
        from tokenizers import Tokenizer

        file = json.loads(raw)
        split, model = file["pre_tokenizer"] or {}, file["model"]
        odd = file["normalizer"] or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        if odd or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("prefix counts are for byte-level BPE without a normalizer, a prefix space or word marks")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("special tokens that take white space or whole words are not supported")
        self.library = Tokenizer.from_str(raw.decode()).pre_tokenizer
        letters, vocab = byte_letters(), model["vocab"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        id_of = {t: i for i, t in self.token.items()}
        self.byte = [id_of[bytes([b])] for b in range(256)]
        #: For each pair that is merged: its rank, and in the lower half the token it makes.
        self.makes: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.makes.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        specials = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.wide, self.narrow = regex.compile(pattern), narrow(pattern)
        self.space = regex.compile(r"\s+")
        self.classes = [(regex.compile(p), name) for p, name in ((r"\p{L}", "letter"), (r"\p{N}", "digit"), (r"\s", "space"))]
        self.seen = np.zeros(0x110000, bool)
        self.seen[:0x100] = True
        self.odd: dict[int, str] = {}
        self.fits: dict[int, bool] = {}
        # Tree of the reversed tokens that merges really make: node and byte -> node, and the token that ends in a node.
        self.branch: dict[int, int] = {}
        self.ends, self.size = [-1], {i: len(t) for i, t in self.token.items()}
        for i, t in self.token.items():
            if self.merged(t) == [i]:
                at = 0
                for b in reversed(t):
                    to = self.branch.get(at << 8 | b)
                    if to is None:
                        to = self.branch[at << 8 | b] = len(self.ends)
                        self.ends.append(-1)
                    at = to
                self.ends[at] = i
        self.forget()

    def forget(self) -> None:
        """Drops the kept rows of matches."""
        self.number: dict[str, int] = {}
        self.known: dict[int, tuple[int, int, int]] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        #: Of each kept match: where its row begins, how long it is, its tokens, whether it is white space, whether it begins with white space.
        self.rows = np.zeros((5, 1 << 12), np.int64)
        self.runs: dict[str, int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short byte string: neighbours of the lowest rank are merged, leftmost first, until none is left."""
        makes, none = self.makes.get, 1 << 62
        ids = [self.byte[b] for b in piece]
        pairs = [makes(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            k = pairs.index(least)
            ids[k : k + 2] = [least & 0xFFFFFFFF]
            del pairs[k]
            if k:
                pairs[k - 1] = makes(ids[k - 1] << 32 | ids[k], none)
            if k < len(pairs):
                pairs[k] = makes(ids[k] << 32 | ids[k + 1], none)
        return ids

    def compatible(self, a: int, b: int) -> bool:
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        got = self.fits[a << 32 | b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return got

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of the first 1, 2, .. bytes of a match; the first SHARED bytes are looked up among those of earlier matches."""
        last, count, s = [-1], [0], 0
        branch, ends, size, fits, known = self.branch.get, self.ends, self.size, self.fits.get, self.known.get
        for i, b in enumerate(piece, 1):
            if s >= 0 and (got := known(s << 8 | b)) is not None:
                s, t, n = got
                last.append(t)
                count.append(n)
                continue
            at, found = 0, []
            for j in range(i - 1, -1, -1):
                at = branch(at << 8 | piece[j])
                if at is None:
                    break
                if ends[at] >= 0:
                    found.append(ends[at])
            for t in reversed(found):
                a = last[i - size[t]]
                if a < 0 or (fit := fits(a << 32 | t)) or (fit is None and self.compatible(a, t)):
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {i} of {piece[:40]!r}")
            last.append(t)
            count.append(count[i - size[t]] + 1)
            if s >= 0 and i <= SHARED:
                new = len(self.known) + 1
                self.known[s << 8 | b] = (new, t, count[-1])
                s = new
            else:
                s = -1
        return count[1:]

    def row(self, match: str) -> int:
        """The number of a match, whose row of counts (one a code point) is then stored."""
        raw = match.encode()
        count = self.prefixes(raw)
        row = [count[k] for k in range(len(raw)) if k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80] if len(raw) > len(match) else count
        if match in CONTRACTIONS:
            row[1] = row[0] + 1  # the mark and a letter, as matches of their own
        need = self.used + len(row)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.int32)])
        self.flat[self.used : need] = row
        k = self.number[match] = len(self.number)
        if k == self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], 1)
        self.rows[:, k] = self.used, len(row), row[-1], self.space.fullmatch(match) is not None, self.space.match(match) is not None
        self.used = need
        return k

    def learn(self, text: str) -> None:
        """Asks the library for the class of characters that were not met before."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for p in np.unique(points[~self.seen[points]]).tolist():
            c = chr(p)
            mine = next((name for pattern, name in self.classes if pattern.match(c)), "mark")
            alone = [name for name in ("letter", "digit", "mark") if len(self.library.pre_tokenize_str(STAND_IN[name] + c + STAND_IN[name])) == 1]
            its = alone[0] if alone else "space"
            if its != mine:
                self.odd[p] = STAND_IN[its]
            self.seen[p] = True

    def matches(self, text: str) -> list[str]:
        if self.narrow and NARROW.fullmatch(text):
            return self.narrow.findall(text)
        self.learn(text)
        if self.odd and (shown := text.translate(self.odd)) != text:
            out, at = [], 0
            for m in self.wide.findall(shown):
                out.append(text[at : at + len(m)])
                at += len(m)
            return out
        return self.wide.findall(text)

    def segment(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without complete special strings."""
        found, number = self.matches(text), self.number
        ids = np.fromiter((number[m] if m in number else self.row(m) for m in found), np.int64, len(found))
        at, length, total, blank, opens = self.rows[:, ids]
        begin, base = np.cumsum(length) - length, np.cumsum(total) - total
        out = self.flat[np.repeat(at - begin, length) + np.arange(begin[-1] + length[-1])] + np.repeat(base, length)
        # White space before white space: the run ends one character later, and counts as a whole if the text ends there.
        for k in np.flatnonzero(blank[:-1] & opens[1:]).tolist():
            run = found[k] + found[k + 1][0]
            if run not in self.runs:
                self.runs[run] = self.prefixes(run.encode())[-1]
            out[begin[k + 1]] = base[k] + self.runs[run]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text, one for each code point."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            part = self.segment(text[at : m.end() - 1]) + base if m.end() - 1 > at else np.zeros(0, np.int64)
            base = (int(part[m.start() - at - 1]) if m.start() > at else base) + 1
            out += [part, np.array([base])]
            at = m.end()
        if at < len(text):
            out.append(self.segment(text[at:]) + base)
        if max(self.used, 4 * len(self.known), 16 * len(self.runs)) > ROWS:
            self.forget()
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_counters: dict[tuple[str, str], PrefixCounter] = {}


def counter(raw: bytes, pattern: str) -> PrefixCounter:
    """One counter for a worker process, whose bounded tables later tasks use again."""
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(raw, pattern)
    return _counters[key]


def prefix_counts(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, counts) for each row: counts[k] is the number of tokens of the text's first k + 1 code points.

    The vocabulary file is read once, on the driver, and its bytes (1.6 MB for 50,000 tokens, whatever the data) are broadcast.
    """
    with open(tokenizer_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(raw.value, pattern).counts
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH, "right")))
                part = batch.slice(lo, hi - lo)
                rows = [count(text) if text else np.zeros(0, np.int64) for text in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                every = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), every], names=["id", "n_bytes", "counts"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, counts array<int>").withColumnRenamed("id", id_col)


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.when(F.size(counts) > 0, F.element_at(counts, -1)).otherwise(0).cast("long")


def longest_prefix(counts: Column, limit: Column | int) -> Column:
    """Code points of the longest prefix with no more than limit tokens.

    Counts may fall as a text goes on (a longer piece can be one token), so all prefixes are looked at, not the first that exceeds.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    last = F.array_max(F.transform(counts, lambda c, k: F.when(c <= limit, k + 1).otherwise(0)))
    return F.when(limit.isNotNull(), F.coalesce(last, F.lit(0)))


def truncated(docs: DataFrame, table: DataFrame, limit: Column | int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts cut to limit tokens at most, from the stored counts; ids must be unique and not null."""
    key, cut = unused(docs, "prefix_id"), unused(docs, "prefix_cut")
    ends = table.select(F.col(id_col).alias(key), longest_prefix(F.col("counts"), limit).alias(cut))
    rows = docs.join(ends, docs[id_col] == ends[key])
    return rows.select(*[F.substring(docs[c], F.lit(1), F.col(cut)).alias(c) if c == text_col else docs[c] for c in docs.columns])


def spend(table: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, spent, n_chars) in order of id: what a budget of tokens buys, the last text cut where the budget ends.

    spent is the number of tokens before a row; n_chars the code points of its text that are still bought. Rows that repeat an id stand in order of
    their size. Sums are taken in two levels, so no task holds more than its range of ids.
    """
    rows = table.select(F.col(id_col), F.col("counts"), total(F.col("counts")).alias("n_tokens"))
    before = running_sum(rows, [id_col, "n_tokens"], "n_tokens", "spent")
    left = F.greatest(F.lit(budget) - F.col("spent"), F.lit(0)).cast("int")
    return before.select(id_col, "n_tokens", "spent", longest_prefix(F.col("counts"), left).alias("n_chars"))


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, from the stored prefix counts."""
    table = prefix_counts(docs, tokenizer_path, pattern, id_col, text_col)
    return table.select(id_col, "n_bytes", total(F.col("counts")).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
