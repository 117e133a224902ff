"""Byte-level BPE as a monoid: encode halves, join neighbours, decode by concatenation.

An element is a text with its ids. Joining two elements re-encodes a window
around the border that grows until its edges are provable cuts, so ids outside
cannot change. A cut is provable where a non-space is followed by white space:
every alternative of the split pattern takes white space at its start only, so
some match must begin there whatever surrounds it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from gridloom.llm.textkit import slices

LEAF_CHARS = 1 << 13
WINDOW_CHARS = 64


@functools.lru_cache(maxsize=4)
def load_encoding(rank_file: str) -> tuple[tiktoken.Encoding, np.ndarray, list[bytes]]:
    """The encoding, each id's byte length and its bytes."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return enc, np.array([len(t) for t in table], np.int64), table


@dataclass
class Element:
    """A text and its ids in pieces; the empty element is the identity."""

    text: str
    ids: list[int]


def _is_cut(text: str, p: int) -> bool:
    return text[p] in " \n\t\r" and not text[p - 1].isspace()


def _ids_in(ids: list[int], n_bytes: int, lengths: np.ndarray, from_end: bool) -> int:
    """How many ids at one end make up exactly n_bytes."""
    take = 64
    while n_bytes:
        part = ids[-take:][::-1] if from_end else ids[:take]
        k = int(np.searchsorted(np.cumsum(lengths[part]), n_bytes))
        if k < len(part):
            return k + 1
        take *= 4
    return 0


def join(a: Element, b: Element, enc: tiktoken.Encoding, lengths: np.ndarray) -> Element:
    if not a.text or not b.text:
        return b if not a.text else a
    border = len(a.text)
    near, tail, head = WINDOW_CHARS, a.text, b.text
    while True:  # grow the window until both of its edges are provable or the element's own
        lo = max(0, border - near)
        hi = min(len(head), near)
        window = tail[lo:] + head[:hi]
        left = next((p for p in range(border - lo - 1, 0, -1) if _is_cut(window, p)), None)
        left = 0 if left is None and lo == 0 else left
        right = next((p for p in range(border - lo + 1, len(window)) if _is_cut(window, p)), None)
        right = len(window) if right is None and hi == len(head) else right
        if left is not None and right is not None:
            break
        near *= 4
    cut_a, cut_b = lo + left, right - (border - lo)
    keep_a = len(a.ids) - _ids_in(a.ids, len(tail[cut_a:].encode()), lengths, True)
    drop_b = _ids_in(b.ids, len(head[:cut_b].encode()), lengths, False)
    middle = enc.encode_ordinary(window[left:right])
    return Element(a.text + b.text, a.ids[:keep_a] + middle + b.ids[drop_b:])


def encode(text: str, enc: tiktoken.Encoding, lengths: np.ndarray, leaf: int = LEAF_CHARS) -> Element:
    if len(text) <= leaf:
        return Element(text, enc.encode_ordinary(text))
    half = len(text) // 2
    return join(encode(text[:half], enc, lengths, leaf), encode(text[half:], enc, lengths, leaf), enc, lengths)


def decode(ids: list[int], table: list[bytes], leaf: int = 1 << 12) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(table.__getitem__, ids))
    half = len(ids) // 2
    return decode(ids[:half], table, leaf) + decode(ids[half:], table, leaf)


def encode_documents(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as little-endian uint32 bytes); ``keep`` names input columns to pass on.

    Null text counts as empty (no ids). Memory: one Arrow batch and one document.
    """
    keep = [id_col] if keep is None else keep
    out = docs.select(*keep).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *((("ids", "binary"),) if with_ids else ())):
        out = out.add(name, kind)
    needed = list(dict.fromkeys([*keep, text_col]))

    def run(batches):
        enc, lengths, table = load_encoding(rank_file)
        for b in slices(batches):
            n, sha, back, raws = [], [], [], []
            for text in b.column(text_col).to_pylist():
                ids = encode(text or "", enc, lengths).ids
                raw = np.array(ids, "<u4").tobytes()
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decode(ids, table)).hexdigest())
                raws.append(raw)
            cols = [*(b.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(raws, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*needed).mapInArrow(run, out)
