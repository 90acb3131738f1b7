"""Encoding of texts with a public byte-level BPE vocabulary, without its merge loop.

A piece of text is encoded by dynamic programming over its prefixes. The tokens that end at a position come from an
automaton over all tokens' bytes. For each prefix exactly one token can be the last of its correct encoding: the one
that leaves a prefix whose own last token is compatible with it, i.e. the pair would not have been merged otherwise.
That token is stored, and following the stored tokens back from the end gives the ids. The result equals that of the
merge loop (tests compare it with two public encoders).

Nulls and empty texts give the empty list. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function that reads them.
VOCABULARIES = os.environ.get("INKFATHOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the vocabulary's makers cut text into pieces before encoding.
PIECE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different pieces whose ids a task remembers before it starts over.
REMEMBERED = 200_000


class PrefixEncoder:
    """Encodes byte strings with the tokens of a rank file (base64 token, rank)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.piece = regex.compile(PIECE)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            # Bytes as the characters of the same number: the automaton works on strings.
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.bytes = {rank: token for token, rank in self.ids.items()}
        self.halves = {rank: self._split(token) for token, rank in self.ids.items()}
        self.fit: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def _split(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that no merge reaches."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        own = self.ids[token]
        while len(parts) > 2:
            ranks = [self.ids.get(a + b, own) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low >= own:
                return None
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's bytes is just a, b."""
        key = a << 32 | b
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) > 4 * REMEMBERED:
                self.fit.clear()
            known = self.fit[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' merges, step by step; no step may show a merge across the border that
        would have come before the one undone."""
        limit = 1 << 60
        left, right, ids, text = a, b, self.ids, self.bytes
        while True:
            across = ids.get(text[left] + text[right])
            if across is not None and across < limit:
                return False
            hl, hr = self.halves[left], self.halves[right]
            # The merge of the higher rank came last and is undone first; of equal ranks the right one did.
            if left > right and hl or (not hr and hl):
                limit, left = left, hl[1]
                limit = min(limit + 0, limit)
            elif hr:
                # A merge at the border with the right token's rank would have come first, being further left.
                limit, right = right + 1, hr[0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        last = [-1] * (n + 1)
        size = self.bytes
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            ends[end].append(rank)
        for end in range(n):
            for rank in ends[end]:
                start = end + 1 - len(size[rank])
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], rank)):
                    if start == 0 and self.halves[rank] is None and len(size[rank]) > 1:
                        continue
                    last[end + 1] = rank
                    break
        out = []
        at = n
        while at:
            out.append(last[at])
            at -= len(size[last[at]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for piece in self.piece.findall(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) > REMEMBERED:
                    known.clear()
                ids = self.encode_piece(piece.encode())
                if len(piece) < 64:
                    known[piece] = ids
            out += ids
        return out


@functools.cache
def encoder(name: str, folder: str = VOCABULARIES) -> PrefixEncoder:
    """One encoder per worker process; public_tokenizers' folder is used where ``folder`` is not there."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(f"{name}.tiktoken")
    return PrefixEncoder(path)


def encode_texts(df: DataFrame, key: str = "doc_id", column: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of every row; ids of null and empty texts are the empty list. No shuffle: a scan and a projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            ids = pa.array([enc.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch({key: batch.column(key), "ids": ids})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(column).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
