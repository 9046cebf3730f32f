"""Benchmark decontamination with a generalised suffix automaton over words.

The test items' words form one automaton whose states stand for classes of item passages. A
document's words stream through it; at each word the state and the matched length give the longest
item passage ending there. Windows of ``window`` words, or whole shorter items, that end there mark
their words as hit.

Items are a bounded query set: they are cut into blocks of at most ``block_words`` words (a longer
item is a block of its own), one automaton is broadcast per block, and each block is one pass over
the documents, so memory does not grow with the benchmark.

Cases: null and empty texts have no words and no hits; null item ids count as items but are not
listed; repeated items and rows are kept as they are; an empty benchmark hits nothing; documents keep
all their columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from floodgrid.llm.texts import alnum_words, clear_others
from floodgrid.runtime import write_and_read as materialize

WINDOW = 13
BLOCK_WORDS = 50_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class PassageAutomaton:
    """Generalised suffix automaton of word sequences, with the windows' items at their states."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark_windows(items)

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state for the passages of ``q`` no longer than ``p``'s plus one word."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, self.next[p][w], w)
        return cur

    def step(self, state: int, matched: int, w: bytes) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def _mark_windows(self, items: list[list[bytes]]) -> None:
        """Items by window: at the state whose passages contain the window's ``window`` words, or
        by (state, length) for items that are shorter than a window."""
        self.window_items: dict[int, list[int]] = {}
        self.short_items: dict[int, dict[int, list[int]]] = {}
        for i, words in enumerate(items):
            state = matched = 0
            for w in words:
                state, matched = self.step(state, matched, w)
                if matched >= self.window:
                    self.window_items.setdefault(self._suffix(state, self.window), []).append(i)
            if 0 < len(words) < self.window:
                at = self._suffix(state, len(words))
                self.short_items.setdefault(at, {}).setdefault(len(words), []).append(i)
        for k, v in self.window_items.items():
            self.window_items[k] = sorted(set(v))
        # Nearest state up the links, itself included, that ends short items.
        self.short_up = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.short_up[s] = s if s in self.short_items else self.short_up[self.link[s]] if self.link[s] > 0 else -1

    def _suffix(self, state: int, k: int) -> int:
        """The state of the last ``k`` words of a passage of ``state``."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (start, end), disjoint and in order, and the items whose windows occur."""
        nxt, link, length, window, short_up = self.next, self.link, self.length, self.window, self.short_up
        root = nxt[0]
        state = matched = 0
        ends: list[tuple[int, int]] = []
        items: set[int] = set()
        for at, w in enumerate(words):
            if not state:
                state = root.get(w, 0)
                if not state:
                    continue
                matched = 1
            else:
                to = nxt[state].get(w)
                if to is None:
                    while state and to is None:
                        state = link[state]
                        to = nxt[state].get(w)
                    if to is None:
                        state = matched = 0
                        continue
                    matched = length[state] + 1 if state else 1
                else:
                    matched += 1
                state = to
            longest = 0
            if matched >= window:
                longest = window
                items.update(self.window_items[self._suffix(state, window)])
            s = short_up[state]
            while s > 0:
                for k, found in self.short_items[s].items():
                    if k <= matched:
                        longest = max(longest, k)
                        items.update(found)
                s = short_up[link[s]] if link[s] > 0 else -1
            if longest:
                ends.append((at + 1 - longest, at + 1))
        return merge_spans(ends), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as disjoint spans in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Blocks of items, read one at a time; the driver holds one block."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        words = alnum_words((row[1] or "").encode())
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield block


_STATE = "_words bigint, _hit bigint, _spans array<int>, _items array<string>, _unnamed int"


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """Documents with ``hits``: (n_words, n_hit, spans of hit words, item ids, number of items).

    The documents' columns are kept as they are in a struct ``row``, so their names cannot clash.
    """
    spark = documents.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in documents.columns if keep_text or c != text]).alias("row")
    state = documents.select(kept, F.col(f"`{text}`").alias("t"))
    first = True
    for block in _blocks(benchmark, item_id, item_text, block_words):
        if not first:
            # Later blocks read the table that the earlier ones wrote: one automaton in memory at a time.
            state = materialize(state)
        state = _pass(spark, state, block, window, first)
        first = False
    ids = F.array_sort(F.array_distinct("_items"))
    return state.select(
        "row",
        *(["t"] if keep_text else []),
        F.struct(
            F.col("_words").alias("n_words"),
            F.col("_hit").alias("n_hit"),
            F.col("_spans").alias("spans"),
            ids.alias("items"),
            (F.size(ids) + F.col("_unnamed")).cast("long").alias("n_items"),
        ).alias("hits"),
    )


def _pass(spark, state: DataFrame, block: list[tuple[str | None, list[bytes]]], window: int, first: bool) -> DataFrame:
    automaton = spark.sparkContext.broadcast(PassageAutomaton([w for _, w in block], window))
    names = [n for n, _ in block]
    schema = StructType(state.schema.fields[:2] + StructType.fromDDL(_STATE).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_others()
        out = to_arrow_schema(schema)
        for batch in batches:
            n_words, n_hit, spans, items, unnamed = [], [], [], [], []
            for k, t in enumerate(batch.column(1).cast(pa.binary())):
                words = alnum_words(t.as_py() or b"")
                found, which = automaton.value.scan(words)
                listed = {names[i] for i in which} - {None}
                null_items = sum(names[i] is None for i in which)
                if not first:
                    old = batch.column(4)[k].as_py()
                    found = merge_spans(found + list(zip(old[::2], old[1::2])))
                    listed |= set(batch.column(5)[k].as_py())
                    null_items += batch.column(6)[k].as_py()
                n_words.append(len(words))
                n_hit.append(sum(end - start for start, end in found))
                spans.append([x for s in found for x in s])
                items.append(sorted(listed))
                unnamed.append(null_items)
            made = [pa.array(x, type=out.field(2 + j).type) for j, x in enumerate((n_words, n_hit, spans, items, unnamed))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), batch.column(1).cast(out.field(1).type), *made], schema=out)

    return state.mapInArrow(run, schema)


def contaminated(hits: str | Column = "hits", share: int = 20) -> Column:
    """True when one word in ``share`` or more is hit."""
    h = F.col(hits) if isinstance(hits, str) else hits
    return (h["n_hit"] > 0) & (share * h["n_hit"] >= h["n_words"])


def remove_spans(texts: DataFrame, max_words: int = 2 * WINDOW, share: int = 20) -> DataFrame:
    """``row`` and the cleaned text ``t`` of ``benchmark_hits`` rows.

    Spans longer than ``max_words``, and all spans of a contaminated document, are cut out from
    their first word's start to their last word's end; other texts stay as they are.
    """
    schema = StructType(texts.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_others()
        out = to_arrow_schema(schema)
        for batch in batches:
            cleaned = []
            for t, h in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                raw, info = t.as_py(), h.as_py()
                flat = info["spans"]
                spans = list(zip(flat[::2], flat[1::2]))
                if not (info["n_hit"] and share * info["n_hit"] >= info["n_words"]):
                    spans = [s for s in spans if s[1] - s[0] > max_words]
                cleaned.append(_cut(raw, spans) if spans else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out.field(0).type), pa.array(cleaned, pa.binary()).cast(out.field(1).type)], schema=out
            )

    return texts.select("row", "t", "hits").mapInArrow(run, schema)


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    bounds = [m.span() for m in _WORD.finditer(raw)]
    out, end = [], 0
    for first, stop in spans:
        out.append(raw[end : bounds[first][0]])
        end = bounds[stop - 1][1]
    return b"".join([*out, raw[end:]])


def items_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def item_digest_of(ids: list[str]) -> str:
    """What ``items_digest`` gives, for checks."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
