"""Token counts of byte-level BPE by a heap and a linked list; no token identifiers are made.

A text is cut at the vocabulary's added tokens (each counts as one token), what lies between into pre-tokens.
The bytes of a pre-token are a doubly linked list of symbols, and its adjacent pairs lie in a heap by rank,
then place. The lowest is popped again and again: unless one of its symbols has been merged meanwhile, the
two become one symbol and its new pairs enter the heap. The count is the number of bytes less the number of
merges, so a pre-token of n bytes takes O(n log n) steps, whatever it holds.

Pre-tokens are found by one regular expression. Code points that this Python's Unicode does not know may be
classed differently by newer expressions, so texts with such letters, digits or blanks are cut by the
vocabulary's own splitter. Counts of short pre-tokens are remembered within a task, in a table of bounded
size; what does not fit is counted again.

The merges are read on the driver from `vocabulary` (a local path) and broadcast: their number is fixed by
that file, whatever the input. Rows need no exchange: each text is counted where it is read.

Cases: a NULL or empty text has 0 bytes and 0 tokens; bytes that are not UTF-8 are read as U+FFFD (n_bytes is
that of the stored text); equal and repeated rows, NULL ids too, each give their own row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import pieces, tidy

# The byte-level pattern of public BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

REMEMBERED, SHORT = 200_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """Symbols as small numbers (0 to 255: the bytes), and for each pair that merges its rank; `made` has the symbol by rank."""

    ranks: dict[int, int]
    made: list[int]

    @classmethod
    def of(cls, pairs: list[tuple[str, str]], letters: list[str]) -> Merges:
        numbers = {letter: b for b, letter in enumerate(letters)}
        ranks, made = {}, []
        for rank, (left, right) in enumerate(pairs):
            ranks[numbers[left] << 32 | numbers[right]] = rank
            made.append(numbers.setdefault(left + right, len(numbers)))
        return cls(ranks, made)


def load_vocabulary(path: str) -> tuple[Merges, list[str]]:
    """The merges and the contents of the added tokens."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    model, split, added = stored["model"], stored["pre_tokenizer"], stored["added_tokens"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    bare = not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
    if not (plain and bare and model["type"] == "BPE" and stored["normalizer"] is None and split["type"] == "ByteLevel"
            and split["use_regex"] and not split["add_prefix_space"] and set(byte_letters()) <= set(model["vocab"])):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return Merges.of(pairs, byte_letters()), [a["content"] for a in added]


def count_symbols(symbols: list[int], merges: Merges) -> int:
    """How many symbols are left when no adjacent pair has a rank. `symbols` is used up."""
    n = left = len(symbols)
    rank_of, made = merges.ranks.get, merges.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # An entry is rank, then place, in one number.
    heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        rank, i = entry >> 32, entry & 0xFFFFFFFF
        j = after[i]
        # A rank names its pair, so an outdated entry is one whose place holds another pair by now, or none.
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue
        symbols[i] = merged = made[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank_of(merged << 32 | symbols[k])) is not None:
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 32 | merged)) is not None:
            heappush(heap, r << 32 | h)
    return left


class _Memory(dict):
    """Tokens of a pre-token; counted when first asked for."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, token: str) -> int:
        found = count_symbols(list(token.encode()), self.merges)
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found


def unknown_ranges() -> list[tuple[str, str]]:
    """First and last of each range of letters, digits and blanks that this Python's Unicode does not know."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd = [c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn"]
    firsts = [c for c, before in zip(odd, ["", *odd]) if not before or ord(before) != ord(c) - 1]
    lasts = [c for c, then in zip(odd, [*odd[1:], ""]) if not then or ord(then) != ord(c) + 1]
    return list(zip(firsts, lasts))


def own_splitter(part: str) -> list[str]:
    """The pre-tokens of a text, by the splitter of the vocabulary's library."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return [part[a:b] for _, (a, b) in split.pre_tokenize_str(part)]


def token_counter(merges: Merges, added: list[str]) -> Callable[[bytes], int]:
    """A function from a text in UTF-8 to its number of tokens."""
    memory, find, unknown = _Memory(merges), regex.compile(PATTERN).findall, unknown_ranges()
    odd = regex.compile("[" + "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in unknown) + "]" if unknown else r"(?!)").search
    # Most texts hold no unknown letter for sure: their bytes are all below the first byte of any.
    below = bytes(range(min([a.encode()[0] for a, _ in unknown], default=256)))
    longest_first = sorted(filter(None, added), key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)").split

    def count(text: bytes) -> int:
        parts = cut(text.decode("utf-8", "replace"))
        total = len(parts) - 1
        check = bool(text.translate(None, below))
        for part in parts:
            tokens = own_splitter(part) if check and odd(part) else find(part)
            total += sum(map(memory.__getitem__, tokens))
        return total

    return count


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(*shared.value)
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    d = tidy(docs, {"doc_id": "bigint", "text": "string"})
    stored = d.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return stored.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
