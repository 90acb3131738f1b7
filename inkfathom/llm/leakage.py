"""Evaluation texts leaking into training text: a BM25 index of the items, searched with block-max WAND.

The terms of the index are the pairs of neighbouring words of the items (words as in :mod:`shingles`). Items are put into
blocks of ``BLOCK``; a term's posting list holds the blocks that have it, with the BM25 weights in the block's items and
their maximum. Every passage of ``SPAN`` consecutive words of the corpus, one each ``STRIDE`` words, is a query.

A leak is a run of L >= 24 words of an item with at most L // 8 words changed, added or left out. A run of 48 words or
more always holds a shorter one, and one with e changes holds one of 8 e words, so runs of 24, 32 and 40 words with 3, 4
and 5 changes are all that has to be found (``RUNS``). Such a run is at least 21, 28 or 35 words long in the text, so it
holds one whole passage, one, or two that share 6 words. A change touches at most two of a passage's pairs; in the worst
case (4 changes in the only passage of a run of 32) ``LEAST`` = 13 - 8 = 5 pairs are left, and with 5 changes one of the
two passages keeps as many. So the item's score is at least the sum of the ``LEAST`` smallest weights that the passage's
terms have anywhere: the threshold of the search. All passages of a batch advance their cursors together; each finds its
pivot, the first block at which the largest weights of the lists up to it reach the threshold, moves the cursors before it
there, and scores the block only if the maxima of the block itself reach the threshold. Nothing above it is dropped.

Retrieved pairs are verified by alignment, after a count of the item's pairs around the passage (a run keeps at least
its pairs less two for each change).

The items are a small set against the corpus: an index holds at most ``MOST_ITEM_BYTES`` of their text (about ten times
that in memory), which bounds what is broadcast; more items take one pass over the corpus for each such part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.textform import fold_python
from inkfathom.session import cut_lineage

LENGTH, RATE = 24, 8
#: (words, changes) of the runs that every leak holds one of.
RUNS = tuple((n, n // RATE) for n in (24, 32, 40))
SPAN, STRIDE = 14, 8
TERMS, LEAST = SPAN - 1, SPAN - 1 - 2 * 4
#: A run has this many words of the text at most before or behind a passage inside it.
REACH = 40 + 5 - SPAN
BLOCK = 8
K1, B = 1.2, 0.75
MOST_ITEM_BYTES = 8 << 20
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
# The same for texts without letters beyond the Latin blocks.
_LATIN = re.compile(r"[0-9a-zªµºß-öø-ɏ]+")
_BEYOND = re.compile(r"[ɐ-῿Ⰰ-\U0010ffff]")


def words(text: str) -> list[str]:
    t = fold_python(text).lower()
    return (_WORD if _BEYOND.search(t) else _LATIN).findall(t)


@dataclass
class ItemIndex:
    """Inverted index of the items; list 0 is that of terms that no item has and is empty."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    terms: np.ndarray  # sorted codes of the terms: first word << 32 | second word
    first: np.ndarray  # (terms + 2) where a term's postings begin
    block: np.ndarray  # block of each posting, ascending within a list
    place: np.ndarray  # term << 32 | block of each posting, ascending
    weights: np.ndarray  # (postings, BLOCK) BM25 weights, 0 where the item lacks the term
    blockmax: np.ndarray  # largest weight of each posting
    most: np.ndarray  # largest and least weight of each term; 0 and infinite for term 0
    least: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple]) -> ItemIndex:
        texts = [(i, words(t)) for i, t in rows if t is not None]
        texts = sorted(((i, w) for i, w in texts if len(w) >= LENGTH), key=lambda r: str(r[1]))
        vocabulary = {w: n + 1 for n, w in enumerate(sorted({x for _, w in texts for x in w}))}
        items = [np.array([vocabulary[x] for x in w], np.int64) for _, w in texts]
        codes = [x[:-1] << 32 | x[1:] for x in items]
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes]) if codes else np.empty(0, np.int64)
        terms, number = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_inverse=True)
        # One entry for each term of each item, with its count there.
        entry, tf = np.unique((number + 1) << 32 | owner, return_counts=True)
        t, item = entry >> 32, entry & 0xFFFFFFFF
        frequency = np.bincount(t, minlength=len(terms) + 1)
        n, sizes = len(items), np.array([len(c) for c in codes]) if codes else np.empty(0)
        idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        w = (idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(sizes.mean(), 1)))).astype(np.float32) if n else np.empty(0, np.float32)
        place, at = np.unique(t << 32 | item // BLOCK, return_inverse=True)
        weights = np.zeros((len(place), BLOCK), np.float32)
        weights[at, item % BLOCK] = w
        most, least = np.zeros(len(terms) + 1, np.float32), np.full(len(terms) + 1, np.inf, np.float32)
        np.maximum.at(most, t, w)
        np.minimum.at(least, t, w)
        first = np.searchsorted(place >> 32, np.arange(len(terms) + 2))
        return cls([i for i, _ in texts], items, vocabulary, terms, first, place & 0xFFFFFFFF, place, weights, weights.max(axis=1, initial=0), most, least)

    def numbers(self, doc: np.ndarray) -> np.ndarray:
        """Term numbers of the neighbouring words of a text (word numbers); 0 for terms that no item has."""
        code = doc[:-1] << 32 | doc[1:]
        at = np.searchsorted(self.terms, code)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == code, at + 1, 0) if len(self.terms) else np.zeros(len(code), np.int64)

    def has(self, terms: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether item k has term t, element by element."""
        want = terms << 32 | items // BLOCK
        at = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
        return (self.place[at] == want) & (self.weights[at, items % BLOCK] > 0)

    def pivots(self, terms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of all blocks whose own maxima reach the query's threshold: block-max WAND on all queries at once."""
        none = np.int64(1) << 40
        block = np.append(self.block, none)
        bound = np.append(self.blockmax, np.float32(0))
        query = np.arange(len(terms))
        cursor, end = self.first[terms], self.first[terms + 1]
        out = []
        while len(query):
            at = np.where(cursor < end, cursor, len(self.block))
            here = block[at]
            order = np.argsort(here, axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(self.most[terms], order, 1), axis=1) >= least[query][:, None]
            pivot = np.take_along_axis(np.take_along_axis(here, order, 1), reached.argmax(axis=1)[:, None], 1)[:, 0]
            pivot[~reached.any(axis=1)] = none
            alive = pivot < none
            query, terms, cursor, end, here, at, pivot = query[alive], terms[alive], cursor[alive], end[alive], here[alive], at[alive], pivot[alive]
            if not len(query):
                break
            there = here == pivot[:, None]
            settled = here.min(axis=1) == pivot  # no cursor stands before the pivot
            good = settled & (np.where(there, bound[at], 0).sum(axis=1) >= least[query])
            out.append(np.stack([query[good], pivot[good]], 1))
            cursor = cursor + (there & settled[:, None])
            behind = here < pivot[:, None]
            if behind.any():
                cursor[behind] = np.searchsorted(self.place, terms[behind] << 32 | np.broadcast_to(pivot[:, None], behind.shape)[behind])
        got = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return got[:, 0], got[:, 1]

    def retrieve(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) pairs at or above the threshold; ``terms`` is (passages, TERMS) of term numbers."""
        live = np.flatnonzero((terms > 0).sum(axis=1) >= LEAST)
        out = []
        for part in np.array_split(live, len(live) // 8192 + 1):
            if not len(part):
                continue
            t = terms[part]
            least = np.partition(self.least[t], LEAST - 1, axis=1)[:, :LEAST].sum(axis=1) - 1e-3
            p, k = self.pivots(t, least)
            if not len(p):
                continue
            want = t[p] << 32 | k[:, None]
            at = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
            w = np.where((self.place[at] == want)[:, :, None], self.weights[at], np.float32(0))
            a, j = np.nonzero(((w > 0).sum(axis=1) >= LEAST) & (w.sum(axis=1) >= least[p][:, None]))
            out.append(np.stack([part[p[a]], k[a] * BLOCK + j], 1))
        pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def aligned(items: list[np.ndarray], regions: np.ndarray, length: int = LENGTH, edits: int = LENGTH // RATE) -> np.ndarray:
    """Whether some ``length`` consecutive words of each item lie in its region (rows of word numbers, padded with -1)
    with at most ``edits`` changes; all windows of all pairs advance together, one word of the window at a time."""
    found = np.zeros(len(items), bool)
    sizes = np.array([max(0, len(x) - length + 1) for x in items], np.int64)
    if not sizes.any():
        return found
    owner = np.repeat(np.arange(len(items)), sizes)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, length) for x in items if len(x) >= length])
    text, windows = regions.astype(np.int32)[owner], windows.astype(np.int32)
    n = text.shape[1]
    # cost[:, j]: least changes so far of a match that ends before word j of the region; a match may begin anywhere.
    kind = np.int8 if n + length < 120 else np.int32
    cost = np.zeros((len(windows), n + 1), kind)
    step = np.arange(n + 1, dtype=kind)
    for i in range(length):
        diagonal = cost[:, :-1] + (text != windows[:, i : i + 1])
        new = cost + kind(1)
        np.minimum(new[:, 1:], diagonal, out=new[:, 1:])
        # Words of the region left over: a running minimum of cost - position.
        cost = np.minimum.accumulate(new - step, axis=1) + step
        alive = cost.min(axis=1) <= edits
        if not alive.all():
            cost, text, windows, owner = cost[alive], text[alive], windows[alive], owner[alive]
            if not len(owner):
                break
    found[owner] = True
    return found


def leaks_of(texts: list[str], index: ItemIndex) -> list[tuple[int, int]]:
    """(text number, item number) of all leaks in a list of texts."""
    if not index.items:
        return []
    get = index.vocabulary.get
    docs = [np.fromiter((get(w, 0) for w in words(t)), np.int64) for t in texts]
    sizes = np.array([max(0, (len(d) - SPAN) // STRIDE + 1) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cut = [np.lib.stride_tricks.sliding_window_view(index.numbers(d), TERMS)[::STRIDE] for d in docs if len(d) >= SPAN]
    if not cut:
        return []
    p, j = index.retrieve(np.concatenate(cut))
    doc = np.searchsorted(starts, p, side="right") - 1
    width = SPAN + 2 * REACH
    found: set[tuple[int, int]] = set()
    order = np.lexsort([p, j, doc])
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (j[order][1:] != j[order][:-1])
    flat = np.concatenate([np.append(index.numbers(d), 0) if len(d) > 1 else np.zeros(len(d), np.int64) for d in docs])
    word = np.concatenate(docs)
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    # One passage of each pair first; the others only for pairs that it does not settle.
    for turn in (order[first], order[~first]):
        for part in np.array_split(turn, len(turn) // 256 + 1):
            part = part[[(int(doc[x]), int(j[x])) not in found for x in part]] if found and len(part) else part
            if not len(part):
                continue
            lo = begin[doc[part]] + (p[part] - starts[doc[part]]) * STRIDE - REACH
            cells = lo[:, None] + np.arange(width)
            inside = (cells >= begin[doc[part]][:, None]) & (cells < begin[doc[part] + 1][:, None])
            cells = np.clip(cells, 0, len(flat) - 1)
            shared = np.zeros((len(part), width + 1), np.int16)
            np.cumsum(index.has(np.where(inside, flat[cells], 0), np.broadcast_to(j[part][:, None], cells.shape)), axis=1, out=shared[:, 1:])
            text = np.where(inside, word[cells], -1)
            left = np.arange(len(part))
            for length, edits in RUNS:
                # A run around the passage lies in these columns, in at most length + edits words, and keeps all its pairs
                # but two for each change.
                reach = length + edits - SPAN
                c = slice(REACH - reach, REACH + SPAN + reach)
                n = shared[left][:, REACH - reach : REACH + SPAN + reach + 1]
                span = length + edits - 1
                left_here = left[(n[:, span:] - n[:, :-span]).max(axis=1) >= length - 1 - 2 * edits]
                if not len(left_here):
                    continue
                ok = aligned([index.items[k] for k in j[part[left_here]]], text[left_here, c], length, edits)
                found.update(zip(doc[part[left_here[ok]]].tolist(), j[part[left_here[ok]]].tolist(), strict=True))
                left = np.setdiff1d(left, left_here[ok])
    return sorted(found)


def _parts(items: DataFrame, key: str, column: str) -> Iterator[list[tuple]]:
    """The items in lists of at most MOST_ITEM_BYTES of text."""
    size, part = 0, []
    for r in items.select(key, column).where(F.col(column).isNotNull() & F.col(key).isNotNull()).dropDuplicates([key]).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1].encode())
        if size > MOST_ITEM_BYTES:
            yield part
            size, part = 0, []
    if part:
        yield part


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, item_id): each document that holds at least 24 consecutive words of an item's text, each pair once.

    Words are compared without case, punctuation, line breaks and differences of look; at most one word in eight of the
    run may be changed, added or left out. Null texts and items with fewer than 24 words are in no pair. Nothing of the
    corpus is shuffled. If the items take more than one pass, each pass is written before the next one starts.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}"
    texts = documents.where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), "text")
    out = None
    for part in _parts(items, item_key, "text"):
        shared = spark.sparkContext.broadcast(ItemIndex.build(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keys, rows = batch.column("key").to_pylist(), batch.column("text").to_pylist()
                for lo in range(0, len(rows), 1000):
                    hits = leaks_of(rows[lo : lo + 1000], index)
                    if hits:
                        yield from pa.Table.from_pandas(pd.DataFrame([(keys[lo + d], index.ids[k]) for d, k in hits], columns=[key, item_key]), preserve_index=False).to_batches()

        found = texts.mapInArrow(run, schema)
        out = found if out is None else cut_lineage(out).unionByName(found)
    return out.distinct() if out is not None else spark.createDataFrame([], schema)


def leaks_by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item_set, documents): how many documents hold each item; items without a leak have 0."""
    n = leaked_items(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "item_set").join(n, "item_id", "left").select("item_id", "item_set", F.coalesce("documents", F.lit(0)).alias("documents"))
