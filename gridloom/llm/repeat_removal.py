"""Removal of repeated byte strings by suffix order and longest previous factors.

A byte goes if a string of ``length`` bytes over it also starts in a document
with a smaller id. Equal strings have equal minimizers (least hash of their
k-byte substrings), so all strings that could be equal meet in the bucket of
their minimizer: consecutive positions with one minimizer travel as one run of
some 14 packed bytes. Runs equal to one of an earlier document are decided by
their hash (over 100 bits), where possible in the task that finds them, so that
a passage of many documents reaches its bucket about once a task. What stays
open (runs that share a minimizer with an earlier document but differ) is
fetched from the texts; there the suffixes are sorted, and the previous and next
smaller documents in suffix order give each suffix its longest previous factor.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sparkkit import Table, blocks_for, release, shuffle_partitions
from gridloom.llm.textkit import chunks, mix64, prefix_hash, range_hash

LENGTH, SEED = 50, 20
#: Runs for one bucket and bytes of text for one group of documents, about.
RUNS_PER_BUCKET, BYTES_PER_GROUP = 400_000, 8 << 20
_FLUSH = 1 << 19
PACKED = "bucket int, data binary"


def _group_sql(n: int) -> str:
    return f"cast(pmod(pmod(doc_id, 2147483647L) * 48271L, 2147483647L) % {n} as int)"


def _group_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (np.mod(doc, 2147483647) * 48271 % 2147483647) % n


class Runs:
    """Columns: doc, crc (of the text, tells apart rows that share an id), start, n (string starts), h (minimizer), g (content hash)."""

    KINDS = {"doc": np.int64, "crc": np.uint32, "start": np.uint32, "n": np.uint32, "h": np.uint32, "g": np.uint64, "flag": np.uint8}

    @staticmethod
    def pack(cols: dict[str, np.ndarray], pick) -> bytes:
        """Bytes of the picked rows; byte planes and differences make small numbers small for the shuffle's codec."""
        out = [np.uint32(len(pick)).tobytes(), bytes(sum(1 << k for k, name in enumerate(Runs.KINDS) if name in cols).to_bytes(1, "little"))]
        for name in Runs.KINDS:
            if name in cols:
                x = np.ascontiguousarray(cols[name][pick])
                if name in ("doc", "crc"):
                    x = np.concatenate((x[:1], x[1:] ^ x[:-1]))
                planes = x.view(np.uint8).reshape(len(x), x.itemsize)
                out.append(planes.tobytes() if name in ("h", "g") else np.ascontiguousarray(planes.T).tobytes())
        return b"".join(out)

    @staticmethod
    def unpack(parts: list[bytes]) -> dict[str, np.ndarray]:
        cols: dict[str, list] = {}
        for data in parts:
            n, has, at = int(np.frombuffer(data, np.uint32, 1)[0]), data[4], 5
            for k, (name, kind) in enumerate(Runs.KINDS.items()):
                if has >> k & 1:
                    size = np.dtype(kind).itemsize
                    raw = np.frombuffer(data, np.uint8, n * size, at)
                    at += n * size
                    x = np.ascontiguousarray(raw if name in ("h", "g") else raw.reshape(size, n).T).reshape(-1).view(kind)
                    cols.setdefault(name, []).append(np.bitwise_xor.accumulate(x) if name in ("doc", "crc") and n else x)
        return {k: np.concatenate(v) for k, v in cols.items()}


def _emit(cols: dict[str, np.ndarray], key: np.ndarray, extra=None):
    """Packed rows by key, in order of the key."""
    order = np.argsort(key, kind="stable")
    keys, at = np.unique(key[order], return_index=True)
    picks = np.split(order, at[1:]) if len(keys) else []
    arrays = [pa.array(keys.astype(np.int32)), pa.array([Runs.pack(cols, p) for p in picks], pa.binary())]
    names = ["bucket", "data"]
    if extra is not None:
        arrays, names = [*arrays, pa.array([extra(p) for p in picks], pa.binary())], [*names, "content"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def find_runs(buf: np.ndarray, offs: np.ndarray, length: int, seed: int):
    """Text number, start within the text, n, minimizer and content hash of each run."""
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    if len(buf) < length:
        return none
    prefix = prefix_hash(buf)
    at = np.arange(len(buf) - seed + 1)
    least = _window_min(range_hash(prefix, at, at + seed), length - seed + 1)
    step = np.zeros(len(buf) + 1, np.int32)
    long = np.diff(offs) >= length
    np.add.at(step, offs[:-1][long], 1)
    np.add.at(step, offs[1:][long] - (length - 1), -1)
    valid = np.cumsum(step[: len(least)]) > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    s, e = np.flatnonzero(begin), np.flatnonzero(stop)
    n = e - s + 1
    text = np.searchsorted(offs, s, side="right") - 1
    return text, s - offs[text], n, mix64(least[s] ^ np.uint64(0x51ED27)), range_hash(prefix, s, s + n + length - 1)


def led_by_smaller(c: dict[str, np.ndarray]) -> np.ndarray:
    """Which runs equal one of a smaller document among the given ones."""
    order = np.lexsort((c["doc"], c["g"], c["h"]))
    h, g, doc = c["h"][order], c["g"][order], c["doc"][order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))[: len(h)]
    out = np.zeros(len(h), bool)
    out[order] = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def judge_bucket(c: dict[str, np.ndarray]) -> np.ndarray:
    """For each run 1: equal to one of a smaller document; 2: open, either side of a possible match; 0: unmatched."""
    out = np.zeros(len(c["doc"]), np.uint8)
    order = np.lexsort((c["doc"], c["g"], c["h"]))
    h, g, doc = c["h"][order], c["g"][order], c["doc"][order]
    if not len(h):
        return out
    new_h = np.concatenate(([True], h[1:] != h[:-1]))
    new_g = new_h | np.concatenate(([True], g[1:] != g[:-1]))
    at_g, at_h = np.flatnonzero(new_g), np.flatnonzero(new_h)
    first = doc[at_g][np.cumsum(new_g) - 1]
    same = doc > first
    low, high = np.minimum.reduceat(first, at_h), np.maximum.reduceat(first, at_h)
    kind = np.cumsum(new_h) - 1
    several = np.add.reduceat(new_g.astype(np.int64), at_h) > 1
    out[order] = np.where(same, 1, np.where((several & (low < high))[kind], 2, 0))
    return out


def _windows(x: np.ndarray) -> list[np.ndarray]:
    """Least value of the 2**k entries that end at each place (of all before it at the front), for each k."""
    out, size = [x], 1
    while size < len(x):
        y = out[-1].copy()
        y[size:] = np.minimum(out[-1][size:], out[-1][:-size])
        out.append(y)
        size *= 2
    return out


def _factor_before(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place the least of lcp from the previous smaller document on (lcp[i]: of places i-1 and i), 0 without one."""
    n = len(doc)
    docs, common = _windows(doc), _windows(lcp)
    at, best = np.arange(n) - 1, np.full(n, lcp.max(initial=0), lcp.dtype)
    best = np.minimum(best, lcp)
    for k in range(len(docs) - 1, -1, -1):  # skip 2**k places that hold no smaller document
        place = np.maximum(at, 0)
        skip = (at >= 0) & (docs[k][place] >= doc)
        best = np.where(skip, np.minimum(best, common[k][place]), best)
        at = np.where(skip, at - (1 << k), at)
    return np.where(at >= 0, best, 0)


def longest_previous_factors(content: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each start the length, up to ``length``, of the longest string there that also starts in a smaller document.

    The suffixes are sorted by their first ``length`` bytes; the longest match
    lies at the previous or the next smaller document in suffix order, as long
    as the least common prefix on the way there.
    """
    if not len(starts):
        return np.zeros(0, np.uint8)
    padded = np.concatenate((content, np.zeros(8, np.uint8)))
    width = min(8, length)
    at = [*range(0, length - width, width), length - width]
    keys = []
    for k in at:
        word = np.zeros(len(starts), np.uint64)
        for b in range(width):
            word = (word << np.uint64(8)) | padded[starts + k + b]
        keys.append(word)
    order = np.lexsort(keys[::-1])
    lcp = np.full(len(order), length, np.uint8)
    for k, word in zip(at[::-1], keys[::-1]):
        x = word[order]
        diff = x[1:] ^ x[:-1]
        same = np.zeros(len(diff), np.uint8)
        for b in range(1, width + 1):
            same += diff >> np.uint64(8 * (width - b)) == 0
        lcp[1:] = np.where(diff != 0, k + same, lcp[1:])
    lcp[0] = 0
    d = np.unique(doc, return_inverse=True)[1].astype(np.int32)[order]
    before = _factor_before(d, lcp)
    after = _factor_before(d[::-1], np.concatenate((lcp[1:], np.zeros(1, np.uint8)))[::-1])[::-1]
    out = np.zeros(len(order), np.uint8)
    out[order] = np.maximum(before, after)
    return out


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())


def _by_bucket(batches, columns):
    """Rows of one bucket after another from batches sorted by bucket."""
    now, rows = None, []
    for b in batches:
        data = [b.column(c).to_pylist() for c in columns]
        for i, k in enumerate(b.column("bucket").to_pylist()):
            if k != now and rows:
                yield now, list(zip(*rows))
                rows = []
            now = k
            rows.append([x[i] for x in data])
    if rows:
        yield now, list(zip(*rows))


def _texts(table: pa.Table):
    """doc ids, crcs, bytes and offsets of a group's documents."""
    got = list(chunks(table.column("doc_id").combine_chunks(), table.column("text"), 1 << 62))
    if not got:
        return None
    ids, buf, offs = got[0]
    ids = ids.to_numpy()
    raw = buf.tobytes()
    return ids, np.array([zlib.crc32(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])], np.uint32), buf, offs


def _rows_of(ids: np.ndarray, crcs: np.ndarray, doc: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The (first) text row of each run's document, -1 if none."""
    order = np.lexsort((crcs, ids))
    key = np.rec.fromarrays([ids[order], crcs[order]])
    want = np.rec.fromarrays([doc, crc])
    at = np.minimum(np.searchsorted(key, want), max(len(order) - 1, 0))
    return np.where(key[at] == want, order[at], -1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    Null text counts as empty; texts shorter than ``length`` bytes keep all.
    Rows with a null id keep all and count for none. Repeated rows share an id
    and so can't remove each other's bytes; they lose the same bytes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    seed = max(1, min(SEED, length - 8))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(shuffle_partitions(spark), blocks_for(total * 2 // max(2, length - seed), RUNS_PER_BUCKET))
    n_groups = max(shuffle_partitions(spark), blocks_for(total, BYTES_PER_GROUP))

    def scan(batches):
        held, size = [], 0

        def flush():
            cols = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            bucket = ((cols.pop("h64") >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
            early = led_by_smaller(cols)
            at, rest = np.flatnonzero(early), np.flatnonzero(~early)
            if len(at):  # decided here; they travel on their own documents' ways, without hashes
                part = {k: cols[k][at] for k in ("doc", "crc", "start", "n")} | {"flag": np.ones(len(at), np.uint8)}
                yield _emit(part, _group_of(part["doc"], n_buckets))
            if len(rest):
                yield _emit({k: v[rest] for k, v in cols.items()}, bucket[rest])

        for b in batches:
            for ids, buf, offs in chunks(b.column("doc_id"), b.column("text")):
                ids = ids.to_numpy()
                text, start, n, h, g = find_runs(buf, offs, length, seed)
                raw = buf.tobytes()
                crcs = np.array([zlib.crc32(raw[x:y]) for x, y in zip(offs[:-1], offs[1:])], np.uint32)
                held.append({"doc": ids[text], "crc": crcs[text], "start": start.astype(np.uint32), "n": n.astype(np.uint32), "h": h.astype(np.uint32), "g": g, "h64": h})
                size += len(text)
                if size > _FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def judge(batches):
        for bucket, (data,) in _by_bucket(batches, ["data"]):
            decided = [Runs.unpack([d]) for d in data if d[4] & 1 << list(Runs.KINDS).index("flag")]
            for c in decided:
                batch = _emit(c, _group_of(c["doc"], n_groups))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([-1] * batch.num_rows, pa.int32())], names=["bucket", "data", "home"])
            if len(decided) == len(data):
                continue
            c = Runs.unpack([d for d in data if not d[4] & 1 << list(Runs.KINDS).index("flag")])
            flag = judge_bucket(c)
            pick = np.flatnonzero(flag)
            if len(pick):
                cols = {k: c[k][pick] for k in ("doc", "crc", "start", "n")} | {"flag": flag[pick]}
                for f in (1, 2):
                    at = np.flatnonzero(cols["flag"] == f)
                    if len(at):
                        part = {k: v[at] for k, v in cols.items()}
                        if f == 2:
                            part["h"] = c["h"][pick][at]
                        batch = _emit(part, _group_of(part["doc"], n_groups))
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bucket if f == 2 else -1] * batch.num_rows, pa.int32())], names=["bucket", "data", "home"])

    packed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, PACKED)
    found = Table(spark, packed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, f"{PACKED}, home int"), "runs")
    release(spark)
    grouped = docs.where("doc_id IS NOT NULL").withColumn("bucket", F.expr(_group_sql(n_groups)))

    def fetch(texts: pa.Table, runs: pa.Table) -> pa.Table:
        t = _texts(texts) if runs.num_rows else None
        none = pa.table({"bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "content": pa.array([], pa.binary())})
        if t is None:
            return none
        ids, crcs, buf, offs = t
        datas = runs.column("data").to_pylist()
        parts = [Runs.unpack([d]) for d in datas]
        home = np.repeat(runs.column("home").to_numpy(), [len(p["doc"]) for p in parts])
        cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        rows = _rows_of(ids, crcs, cols["doc"], cols["crc"])
        begin, lens = offs[rows] + cols["start"].astype(np.int64), cols["n"].astype(np.int64) + length - 1
        batch = _emit(cols, home, lambda p: buf[_ragged(begin[p], lens[p])].tobytes())
        return pa.Table.from_batches([batch])

    opened = grouped.groupBy("bucket").cogroup(found.df.where("home >= 0").groupBy("bucket")).applyInArrow(fetch, f"{PACKED}, content binary")

    def compare(batches):
        for _, (data, content) in _by_bucket(batches, ["data", "content"]):
            c = Runs.unpack(data)
            x = np.frombuffer(b"".join(content), np.uint8)
            n = c["n"].astype(np.int64)
            lens = n + length - 1
            base = np.concatenate(([0], np.cumsum(lens)[:-1]))
            # Slices of whole minimizer groups bound the sort's memory.
            order = np.argsort(c["h"], kind="stable")
            ends = np.cumsum(n[order])
            i, marks = 0, []
            while i < len(order):
                j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 18), side="right"))
                j = max(i + 1, j)
                j = int(np.searchsorted(c["h"][order], c["h"][order][j - 1], side="right"))
                own = order[i:j]
                starts = _ragged(base[own], n[own])
                run = np.repeat(own, n[own])
                hit = longest_previous_factors(x, starts, c["doc"][run], length) >= length
                edge = np.concatenate(([True], run[1:] != run[:-1]))
                up = hit & (edge | np.concatenate(([True], ~hit[:-1])))
                down = hit & np.concatenate((edge[1:] | ~hit[1:], [True]))
                s, e = np.flatnonzero(up), np.flatnonzero(down)
                first = starts[s] - base[run[s]]
                marks.append({"doc": c["doc"][run[s]], "crc": c["crc"][run[s]], "start": (c["start"][run[s]] + first).astype(np.uint32), "n": (e - s + 1).astype(np.uint32)})
                i = j
            cols = {k: np.concatenate([m[k] for m in marks]) for k in marks[0]}
            if len(cols["doc"]):
                yield _emit(cols, _group_of(cols["doc"], n_groups))

    more = Table(spark, opened.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, PACKED), "marks")
    release(spark)
    marks = found.df.where("home < 0").select("bucket", "data").unionByName(more.df)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(texts: pa.Table, runs: pa.Table) -> pa.Table:
        t = _texts(texts)
        out = []
        if t is not None:
            ids, crcs, buf, offs = t
            step = np.zeros(len(buf) + 1, np.int32)
            for data in runs.column("data").to_pylist():
                c = Runs.unpack([data])
                for row in [_rows_of(ids, crcs, c["doc"], c["crc"])]:
                    a = offs[row] + c["start"].astype(np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, a + c["n"].astype(np.int64) + length - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            # Repeated rows: the marks went to the first of them.
            order = np.lexsort((np.arange(len(ids)), crcs, ids))
            lead = order.copy()
            for k in range(1, len(order)):
                if ids[order[k]] == ids[order[k - 1]] and crcs[order[k]] == crcs[order[k - 1]]:
                    lead[k] = lead[k - 1]
            source = np.empty(len(order), np.int64)
            source[order] = lead
            for r in range(len(ids)):
                m = gone[offs[source[r]] : offs[source[r] + 1]]
                body = buf[offs[r] : offs[r + 1]]
                kept = body[~m].tobytes() if m.any() else body.tobytes()
                spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
                out.append((int(ids[r]), len(body), int(m.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), cols, kinds)})

    done = grouped.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(cut, schema)
    plain = docs.where("doc_id IS NULL").selectExpr("doc_id", "coalesce(cast(octet_length(text) as bigint), 0L) AS n_bytes", "0L AS n_removed", "0L AS n_spans", "sha2(coalesce(text, ''), 256) AS kept_sha256", "cast(coalesce(text, '') as binary) AS kept")
    both = done.unionByName(plain)
    result = Table(spark, both if with_kept else both.drop("kept"), "kept")
    found.drop()
    more.drop()
    return result.df
