"""Benchmark decontamination by spaced seeds.

Fixed masks leave out some token positions, so a window still hashes to the
benchmark's hash after substitutions at those positions; each length of items
has masks of which one misses no pattern of substitutions that is accepted. Training windows are
joined with the benchmark's hashes inside the scan; each hit is verified by
aligning the texts around it and counting equal tokens.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sparkkit import blocks_for
from gridloom.llm.textkit import IS_PUNCT_OR_SPACE, chunks, mix64, word_hashes, words

#: Shorter items can't be told from chance.
MIN_TOKENS = 5
#: An overlap counts over WINDOW tokens (or the whole item if shorter) with at least this share of them equal.
WINDOW, MIN_SHARE = 20, 0.8
#: Bytes of benchmark text that one pass over the documents carries; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
#: Pairs of places of one seed that are listed one by one.
HEAVY_PAIRS = 4096


def _masks(n: int) -> list[tuple[int, ...]]:
    """Kept token positions of the seeds for items of n tokens. Of e + 2 equal parts of an overlap with at most e substitutions two stay whole, so one of the seeds of two parts, at any distance, hits every overlap that counts."""
    if n == 5:  # parts of 2, 2 and 1 tokens
        return [(0, 1, 2, 3), (0, 1, 4), (0, 1, 2)]
    size = min(WINDOW, n)
    parts = int(size * (1 - MIN_SHARE) + 1e-9) + 2
    part = min(3, size // parts)
    return [(*range(part), *range(d * part, d * part + part)) for d in range(1, parts)]


SCHEMA = "doc_id long, item_ids array<long>, matched long"


def _window_hashes(h: np.ndarray, mask, span: int) -> np.ndarray:
    n = len(h) - span + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k, p in enumerate(mask):
        if n > 0:
            out += h[p : p + n] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    return mix64(out)


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct x[i] - y[j]: by pairs if few, else by correlation of the two sets' indicators."""
    if len(x) * len(y) <= HEAVY_PAIRS:
        return np.unique(x[:, None] - y)
    low, high = int(x.min()), int(y.max())
    a, b = np.zeros(int(x.max()) - low + 1), np.zeros(high - int(y.min()) + 1)
    a[x - low], b[high - y] = 1, 1
    size = 1 << (len(a) + len(b) - 1).bit_length()
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size) > 0.5) + low - high


class SeedIndex:
    """The benchmark's tokens and its sorted seed hashes, by mask."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        _, buf, offs = next(chunks(pa.array(self.ids, pa.int64()), pa.array([t for _, t in items], pa.string()), 1 << 62), (None, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        low, starts, ends, first = words(buf, offs, IS_PUNCT_OR_SPACE)
        h = word_hashes(low, starts, ends)
        self.tokens = [h[first[k] : first[k + 1]] for k in range(len(items))]
        shapes: dict[tuple, list] = {}
        for k, t in enumerate(self.tokens):
            for m in _masks(len(t)) if len(t) >= MIN_TOKENS else ():
                w = _window_hashes(t, m, m[-1] + 1)
                shapes.setdefault((m[-1] + 1, m), []).append((w, np.full(len(w), k), np.arange(len(w))))
        self.seeds = []
        for (span, mask), parts in shapes.items():
            if parts:
                w, k, p = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(w, kind="stable")
                w = w[order]
                small = np.zeros(1 << 20, bool)
                small[(w >> np.uint64(44)).astype(np.int64)] = True
                self.seeds.append((span, mask, w, k[order], p[order], small))

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, shift) for which a seed of the text meets one of the item; item token j lies at the text's token j + shift.

        A seed that a text repeats gives its shifts as differences of two sets
        of places, so a text of equal words costs its length, not its length
        times the item's.
        """
        out: list[np.ndarray] = []
        held = 0

        def add(rows: np.ndarray) -> None:
            nonlocal out, held
            out.append(rows)
            held += len(rows)
            if held > 1 << 20:
                out = [np.unique(np.concatenate(out), axis=0)]
                held = 0

        for span, mask, w, k, p, small in self.seeds:
            x = _window_hashes(h, mask, span)
            at = np.flatnonzero(small[(x >> np.uint64(44)).astype(np.int64)]) if len(x) else np.zeros(0, np.int64)
            text = np.searchsorted(first, at, side="right") - 1
            lo, hi = np.searchsorted(w, x[at], "left"), np.searchsorted(w, x[at], "right")
            ok = (hi > lo) & (at + span <= first[text + 1])
            at, text, lo, hi = at[ok], text[ok], lo[ok], hi[ok]
            if not len(at):
                continue
            order = np.lexsort((at, lo, text))
            at, text, lo, hi = at[order], text[order], lo[order], hi[order]
            begin = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (lo[1:] != lo[:-1]))))
            count = np.diff(np.append(begin, len(at)))
            heavy = count * (hi - lo)[begin] > HEAVY_PAIRS
            light = np.flatnonzero(~np.repeat(heavy, count))
            for part in np.split(light, np.flatnonzero(np.diff(np.cumsum((hi - lo)[light]) >> 20)) + 1):
                n = (hi - lo)[part]
                seed = np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                add(np.column_stack([np.repeat(text[part], n), k[seed], np.repeat(at[part] - first[text[part]], n) - p[seed]]))
            for g in np.flatnonzero(heavy):
                a, b = begin[g], begin[g] + count[g]
                places = at[a:b] - first[text[a]]
                items, start = np.unique(k[lo[a] : hi[a]], return_index=True)
                for item, own in zip(items, np.split(p[lo[a] : hi[a]], start[1:])):
                    shifts = _differences(places, own)
                    add(np.column_stack([np.full(len(shifts), text[a]), np.full(len(shifts), item), shifts]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def overlap(self, h: np.ndarray, item: int, shift: int) -> int:
        """Most equal tokens in a window of the alignment that is similar enough, or 0."""
        t = self.tokens[item]
        a, b = max(0, -shift), min(len(t), len(h) - shift)
        size = min(WINDOW, len(t))
        if b - a < size:
            return 0
        same = np.concatenate(([0], np.cumsum(t[a:b] == h[a + shift : b + shift])))
        best = int((same[size:] - same[:-size]).max())
        return best if best >= MIN_SHARE * size else 0


_INDEX: dict[str, SeedIndex] = {}


def _index(key: str, shared) -> SeedIndex:
    """One index at a time for each worker process."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = SeedIndex(shared.value)
    return _INDEX[key]


def _slices(benchmark: DataFrame, pass_bytes: int):
    """A key and a broadcast for each part of the benchmark, of about ``pass_bytes`` at most each."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    n = blocks_for(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, pass_bytes)
    for s in range(n):
        rows = items.where(f"pmod(xxhash64(item_id, text), {n}) = {s}").collect()
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(sorted({(r[0], r[1]) for r in rows}))


def _judged(batches, index: SeedIndex):
    """(rows, matched items, most equal tokens) of bounded slices of the batches; the rows as they came."""
    for b in batches:
        for at, buf, offs in chunks(pa.array(np.arange(b.num_rows)), b.column("text")):
            low, starts, ends, first = words(buf, offs, IS_PUNCT_OR_SPACE)
            h = word_hashes(low, starts, ends)
            found: list[set] = [set() for _ in range(len(at))]
            most = [0] * len(at)
            for d, item, shift in index.hits(h, first).tolist():
                if m := index.overlap(h[first[d] : first[d + 1]], item, shift):
                    found[d].add(index.ids[item])
                    most[d] = max(most[d], m)
            yield b.slice(at[0].as_py(), len(at)), found, most


def contaminated(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for each input row: doc_id, contaminated, item_ids (sorted) and matched (most equal tokens of one overlap).

    Null texts and texts or items of fewer than five tokens match nothing. A
    benchmark over ``pass_bytes`` takes several passes; then rows that share an
    id are one document.
    """
    out = None
    for key, shared in _slices(benchmark, pass_bytes):

        def run(batches, key=key, shared=shared):
            for rows, found, most in _judged(batches, _index(key, shared)):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array(most, pa.int64())], names=["doc_id", "item_ids", "matched"])

        part = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out, passes = (part, 1) if out is None else (out.unionByName(part), passes + 1)
    if passes > 1:
        out = out.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("matched").alias("matched"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "matched")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, all columns, that overlap with no item; each pass filters what the last one left, without a shuffle."""
    for key, shared in _slices(benchmark, pass_bytes):

        def run(batches, key=key, shared=shared):
            for rows, found, _ in _judged(batches, _index(key, shared)):
                yield rows.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
