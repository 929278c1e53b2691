"""Exact token counts at every prefix of a text, for SentencePiece BPE models with byte fallback.

For BPE, the encoding of a prefix is the encoding of a shorter prefix plus one last token, and the
last token t may follow the token p exactly if `p + t` encodes to p, t. So one pass over the text
stores, for every prefix, its count: count(prefix) = count(prefix without last token) + cost(last
token). Cutting to a budget, the count of any prefix and the total are then lookups, without
encoding again.

No token holds a line break, or a space mark after another character, so a text falls into chunks
that never merge with each other; chunks repeat, and their counts are kept in a bounded table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, slices, without

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Chunks that one process remembers before it starts afresh, and the longest one that it remembers.
MOST_CHUNKS, LONGEST_KEPT = 600_000, 64
#: Token pairs, and beginnings of chunks (of so many characters) with their counts, that one process remembers.
MOST_PAIRS, MOST_STEMS, STEM = 300_000, 60_000, 7


class PrefixCounter:
    """Counts of all prefixes under one model (identity normalizer, space mark before the text)."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("only models with the identity normalizer, a space mark before the text and byte fallback are supported")
        #: When a token is made: the lower, the earlier its merge.
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == 1}
        runs = {p for p in self.rank if len(p) > 1 and not p.strip(MARK)}
        if any(MARK in p[1:] for p in self.rank.keys() - runs):
            raise ValueError("a token holds a space mark after another character")
        if runs and min(self.rank[p] for p in runs) < max(v for p, v in self.rank.items() if len(p) > 1 and p not in runs):
            raise ValueError("runs of space marks must merge last")
        self.run = max(map(len, runs), default=1)
        self.rest = [len(self.merged(MARK * k)[0]) if k else 0 for k in range(self.run)]
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        if "\n" in joined:
            raise ValueError("a token holds a line break")
        self.heads: dict[str, list[tuple[str, float]]] = {}
        self.tails: dict[str, list[tuple[str, float]]] = {}
        self.endings: set[str] = set()
        for token in self.rank.keys() - runs:
            parts, halves = self.merged(token)
            if len(parts) == 1:
                self.heads[token], self.tails[token] = self.grown(token, halves, 0), self.grown(token, halves, 1)
                self.endings.update(token[i:] for i in range(len(token)))
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stems: dict[str, tuple[list[int], list[str], list[bool]]] = {}

    def merged(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """The tokens of a short string, the best neighbours merged first, the leftmost of equals; and the halves of what was merged."""
        parts, halves = list(text), {}
        while True:
            at = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], float("inf")), default=-1)
            if at < 0 or (both := parts[at] + parts[at + 1]) not in self.rank:
                return parts, halves
            halves[both] = parts[at], parts[at + 1]
            parts[at : at + 2] = [both]

    def grown(self, token: str, halves: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float]]:
        """What stands at one end of a token while it is made, from its outermost character on, with the rank that ends each."""
        steps, until = [], float("inf")
        while True:
            steps.append((token, until))
            if token not in halves:
                return steps[::-1]
            if not all(x not in halves or self.rank[x] < self.rank[token] for x in halves[token]):
                raise ValueError("a token is made before its halves")
            token, until = halves[token][side], self.rank[token]

    def follows(self, before: str, token: str) -> bool:
        """Whether `before` and `token` stay two tokens side by side: nothing merges across while either grows."""
        lefts = self.tails.get(before) or [(before, float("inf"))]
        rights = self.heads.get(token) or [(token, float("inf"))]
        i = j = 0
        while True:
            left, left_until = lefts[i]
            right, right_until = rights[j]
            across = self.rank.get(left + right)
            if across is not None and across < left_until and across <= right_until:
                return False
            if left_until == right_until == float("inf"):
                return True
            if left_until <= right_until:
                i += 1
            else:
                j += 1

    def marks(self, n: int) -> int:
        """The count of a run of n space marks: they merge from the left to the longest run, then the rest."""
        return n // self.run + self.rest[n % self.run]

    def prefixes(self, chunk: str) -> tuple[list[int], list[bool]]:
        """The count of each prefix, and whether its first token is its first character alone."""
        known = self.stems.get(chunk[:STEM])
        counts, lasts, lone = (x.copy() for x in known) if known else ([0], [""], [False])
        heads, endings, pairs = self.heads, self.endings, self.pairs
        for i in range(len(counts), len(chunk) + 1):
            j = i - 1
            while j and chunk[j - 1 : i] in endings:
                j -= 1
            while True:
                token = chunk[j:i]
                if token in heads or j == i - 1:
                    if j == 0:
                        break
                    ok = pairs.get((lasts[j], token))
                    if ok is None:
                        if len(pairs) >= MOST_PAIRS:
                            pairs.clear()
                        ok = pairs[lasts[j], token] = self.follows(lasts[j], token)
                    if ok:
                        break
                j += 1
            counts.append(counts[j] + (1 if token in self.rank else len(token.encode())))
            lasts.append(token)
            lone.append(lone[j] if j else i == 1)
            if i == STEM:
                if len(self.stems) >= MOST_STEMS:
                    self.stems.clear()
                self.stems[chunk[:STEM]] = counts.copy(), lasts.copy(), lone.copy()
        return counts, lone

    def steps(self, chunk: str) -> bytes:
        """By how much each character of a chunk changes the count (int8)."""
        marks = len(chunk) - len(chunk.lstrip(MARK))
        if marks > 1:
            counts = [self.marks(k) for k in range(marks + 1)]
            if marks < len(chunk):
                tail, lone = self.prefixes(chunk[marks - 1 :])
                free, full = self.marks(marks - 1), self.marks(marks)
                counts += [full + c - 1 if one else free + c for c, one in zip(tail[2:], lone[2:], strict=True)]
        else:
            counts, _ = self.prefixes(chunk)
        steps = [b - a for a, b in itertools.pairwise(counts)]
        if steps and not -128 <= min(steps) <= max(steps) <= 127:
            raise ValueError("a count changes by more than an int8 step holds")
        return bytes([s & 255 for s in steps])

    def line(self, line: str, first: bool) -> list[bytes]:
        """The steps of a line's chunks: each run of space marks with what follows it; the first line has a mark before it."""
        if MARK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
            return [self.steps(c) for c in _CHUNK.findall((MARK if first else "") + line.replace(" ", MARK))]
        words = line.split(" ")
        marked, bare = self.marked, self.bare
        head = words if first else words[1:]
        out = []
        if not first and words[0]:
            word = words[0]
            out.append(bare.get(word) or self.kept(bare, word, word))
        for word in head:
            out.append(marked.get(word) or self.kept(marked, word, MARK + word))
        return out

    def kept(self, known: dict[str, bytes], word: str, chunk: str) -> bytes:
        steps = self.steps(chunk)
        if len(word) <= LONGEST_KEPT:
            if len(known) >= MOST_CHUNKS:
                known.clear()
            known[word] = steps
        return steps

    def table(self, text: str) -> tuple[int, bytes]:
        """The text's count, and the steps of the count: one int8 for each character.

        The mark before the text is a token only together with the first character, so its step is
        added to that of the first character.
        """
        if not text:
            return 0, b""
        lines = text.split("\n")
        parts = self.line(lines[0], True)
        for line in lines[1:]:
            parts.append(b"\x01")  # a line break is always a token of its own, from its one byte
            parts += self.line(line, False)
        steps = b"".join(parts)
        steps = bytes([(steps[0] + steps[1]) & 255]) + steps[2:]  # each at most the few tokens of one character
        return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64)), steps


@lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def count_at(steps: bytes, chars: int) -> int:
    """The exact token count of the text's first `chars` characters, from its stored steps."""
    return int(np.frombuffer(steps, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """How many characters the longest prefix of at most `budget` tokens has."""
    counts = np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def prefix_counts(df: DataFrame, model_path: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and token_steps (binary, one int8 step of the count for each character).

    `count_at` and `longest_within` answer questions on token_steps. Null texts count as empty: 0,
    0 and no steps. Repeated rows stay, an empty table stays empty, input columns with the
    names of the outputs (in any case) are replaced. Texts may have any length; only short chunks are
    remembered.
    """
    outputs = ["n_bytes", "n_tokens", "token_steps"]
    base = without(df, outputs)
    rest = [c for c in base.columns if keep_text or c != text_col]
    work = base.select(*[quoted(c) for c in rest], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*[base.schema[c] for c in rest], T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("token_steps", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            texts = batch.column(len(rest))
            sizes = pa.compute.binary_length(texts).to_pylist()
            for a, b in slices(sizes, 1 << 21):
                found = [model.table(t) for t in texts.slice(a, b - a).to_pylist()]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[a:b], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=[*rest, *outputs])

    return work.mapInArrow(run, schema)
