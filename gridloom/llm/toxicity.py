"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digit and symbol
substitutions, zero-width characters), then one Aho-Corasick pass finds
lexicon entries at word starts; where a text has letters beyond ASCII, a second
pass finds entries that keep their accents. Weights are log odds learned from
labelled rows; a match inside an exception phrase doesn't count. The score is a
logistic function of the heaviest entry and of the summed weights normalised
by the text's length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sparkkit import Table
from gridloom.llm.textkit import slices

#: Bounds of fitting: toxic and other labelled rows used. More of the others, so that rare words rarely are toxic by chance.
MAX_TOXIC, MAX_OTHER = 4_000, 20_000
PREFIX_CHARS = (3, 4, 5, 6, 7, 8)
MIN_TOXIC_DOCS = 4
#: Entries need log odds of so much at the lower end of their error.
MIN_LOW_ODDS = 1.5
#: Rows of one part are measured with entries of the others, to fit the logistic function.
PARTS = 4
#: Entries that one task holds before it hands on their counts.
_FLUSH = 500_000
THRESHOLD = 0.7
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "scum line")


def _fold_table() -> dict[int, str | None]:
    t: dict[int, str | None] = {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
        t[c] = plain
    t |= {c: None for c in range(0x300, 0x370)}
    # Look-alikes of Cyrillic and Greek letters, then digits and symbols; i, l and 1 are one class.
    for a, b in zip("аеорсухкмтвнієѕјӏαεορτυνικβγ", "aeopcyxkmtbhiesjiaeoptuvikby"):
        t[ord(a)] = b
        t[ord(a.upper())] = b
    for c in range(65, 91):
        t[c] = chr(c + 32)
    for a, b in zip("0134578@$€", "oieastbase"):
        t[ord(a)] = b
    t[ord("l")] = t[ord("L")] = "i"
    for c, v in list(t.items()):
        if v:
            t[c] = v.replace("l", "i")
    return t


_FOLD = _fold_table()
_WORD = re.compile(r"[^\W_]+")


#: The same but for accents, which stay.
_LIGHT = {c: v for c, v in _FOLD.items() if not (0xC0 <= c < 0x250 or 0x300 <= c < 0x370 or 0x1E00 <= c < 0x1F00)}
#: Marks entries that keep their accents.
ACCENTED = "~"


def fold(text: str) -> str:
    return text.translate(_FOLD)


def fold_light(text: str) -> str:
    return text.lower().translate(_LIGHT)


def features(text: str) -> set[str]:
    """Whole words as ``word$`` and word beginnings as ``begin``, folded; and again with accents where they have letters beyond ASCII."""
    out = set()
    for mark, folded in (("", fold(text)), *(() if text.isascii() else ((ACCENTED, fold_light(text)),))):
        for w in set(_WORD.findall(folded)):
            if mark and w.isascii():
                continue
            out.add(f"{mark}{w}$")
            for n in PREFIX_CHARS:
                if len(w) > n:
                    out.add(mark + w[:n])
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    coef: list[float] = field(default_factory=lambda: [-4.0, 1.0, 0.0, 0.0, 0.0])
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: The score of texts without a match: the share of toxic ones among such labelled rows.
    none: float = 0.0

    def automata(self) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
        """For folded texts, and for those that keep accents."""
        return self._automaton(False), self._automaton(True)

    def _automaton(self, accented: bool) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for entry, weight in self.weights.items():
            if entry.startswith(ACCENTED) == accented:
                entries.setdefault(entry.strip(ACCENTED + "$"), []).append((weight, entry.endswith("$")))
        spared = {} if accented else {fold(phrase): True for phrase in self.exceptions}
        for text in entries.keys() | spared.keys():
            a.add_word(text, (len(text), entries.get(text, []), text in spared))
        a.make_automaton()
        return a


def _found(folded: str, automaton: ahocorasick.Automaton, accented: bool) -> list[float]:
    """The heaviest entry of each word that has any, outside exception phrases."""
    if automaton.kind != ahocorasick.AHOCORASICK:  # no entries
        return []
    n, hits, spared = len(folded), [], []
    for last, (size, what, exception) in automaton.iter(folded):
        a, b = last - size + 1, last + 1
        if a > 0 and folded[a - 1].isalnum():
            continue
        if exception:
            spared.append((a, b))
        ends = b == n or not folded[b].isalnum()
        hits += [(a, b, weight) for weight, whole in what if ends or not whole]
    found: dict[int, float] = {}
    for a, b, weight in hits:
        if not any(x <= a and b <= y for x, y in spared):
            found[a] = max(found.get(a, 0.0), weight)
    if accented:  # words without accents are the other pass's
        found = {a: w for a, w in found.items() if not _WORD.match(folded, a)[0].isascii()}
    return list(found.values())


def measure(text: str, automata) -> tuple[float, float, float, float]:
    """What the score is made of: the heaviest entry, the logarithm of the summed weights, that sum over the text's length, and the length's logarithm. Each word counts once a pass, by its heaviest entry."""
    folded = fold(text)
    found = _found(folded, automata[0], False)
    if not text.isascii():
        found += _found(fold_light(text), automata[1], True)
    total, hundreds = sum(found), folded.count(" ") / 100
    return max(found, default=0.0), math.log1p(total), total / (1 + hundreds), math.log1p(hundreds)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    """Ridge-penalised maximum likelihood (not of the intercept, column 0) by Newton's method with halved steps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    z, penalty = x / scale, ridge * np.array([1e-6, *[1.0] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, (1 - 2 * y) * (z @ v)).sum() + (penalty * v * v).sum() / 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w / scale


def score_of(measures, lexicon: Lexicon) -> float:
    if not measures[0]:
        return lexicon.none
    coef = lexicon.coef
    z = coef[0] + sum(c * m for c, m in zip(coef[1:], measures))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of fitting; a null id is not."""
    return F.expr(f"coalesce(crc32(cast(cast(`{id_col}` as string) as binary)) % 3 = 1, false)")


def _odds(t: str, c: str, n_toxic: int, n_other: int) -> str:
    """SQL for an entry's weight from its toxic and other documents, null where it is no entry. A high lower bound of the odds is asked for, not only high odds: rare words that toxic texts hold by chance stay out."""
    odds = f"(ln(({t} + 0.5D) / {n_toxic + 1}D) - ln(({c} + 0.5D) / {n_other + 1}D))"
    return f"if({t} >= {MIN_TOXIC_DOCS} AND {odds} - 1.3D * sqrt(1D / ({t} + 0.5D) + 1D / ({c} + 0.5D)) > {MIN_LOW_ODDS}, {odds}, null)"


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Lexicon:
    """Learn entries, weights and the logistic function from at most ``max_toxic`` + ``max_other`` labelled rows, chosen by hash of the id.

    All of them give the lexicon. For the logistic function of texts with a
    match each part of them is measured with the lexicon of the other parts. Rows of the held-out
    third take no part. Without usable labels the lexicon is empty and nothing
    is toxic.
    """
    spark = docs.sparkSession
    seen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [seen.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((0, max_other), (1, max_toxic))]
    chosen = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id")  # at most max_toxic + max_other rows
    sample = Table(spark, docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).selectExpr(f"cast(pmod(xxhash64(doc_id, 5), {PARTS}) as int) AS part", "text", "cast(toxic as int) AS toxic"), "toxic-sample")
    rate = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = {(r["toxic"], r["part"]): r["n"] for r in sample.df.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    of = lambda y, but=None: sum(v for (z, part), v in n.items() if z == y and part != but)
    if not of(0) or not of(1):
        sample.drop()
        return Lexicon({})

    def count(batches):
        def out():
            names = sorted({k for c in counts.values() for k in c})
            cols = [pa.array([counts[y, p][k] for k in names], pa.int64()) for y in (1, 0) for p in range(PARTS)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *cols], names=["entry", *_COUNTS])

        counts = {(y, p): Counter() for y in (0, 1) for p in range(PARTS)}
        for b in slices(batches):
            for text, y, p in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("part").to_pylist()):
                counts[y, p].update(features(text or ""))
            if sum(map(len, counts.values())) > _FLUSH:
                yield out()
                counts = {k: Counter() for k in counts}
        yield out()

    counted = sample.df.mapInArrow(count, "entry string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("entry").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    sums = [("t", "c", of(1), of(0)), *((f"(t - t{p})", f"(c - c{p})", of(1, p), of(0, p)) for p in range(PARTS))]
    whole = counted.selectExpr("*", " + ".join(_COUNTS[:PARTS]) + " AS t", " + ".join(_COUNTS[PARTS:]) + " AS c")
    weighed = whole.selectExpr("entry", *(f"{_odds(*x)} AS w{k}" for k, x in enumerate(sums))).where("coalesce(" + ", ".join(f"w{k}" for k in range(len(sums))) + ") IS NOT NULL")
    rows = weighed.orderBy("entry").collect()  # entries of at least MIN_TOXIC_DOCS of the bounded sample's toxic rows
    every, *others = ({r["entry"]: r[f"w{k}"] for r in rows if r[f"w{k}"] is not None} for k in range(len(sums)))

    def measured(batches):
        automata = [Lexicon(w).automata() for w in others]
        for b in slices(batches):
            m = [measure(t or "", automata[p]) for t, p in zip(b.column("text").to_pylist(), b.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.list_(pa.float64())), b.column("toxic")], names=["m", "y"])

    m = sample.df.mapInArrow(measured, "m array<double>, y int").toPandas()  # at most max_toxic + max_other rows
    x, y = np.array(m.m.tolist()), m.y.to_numpy(float)
    sample.drop()
    # The sample's share of toxic rows is not the table's: put the prior back.
    prior = math.log(rate[1] / rate[0]) - math.log(y.sum() / (1 - y).sum())
    hit = x[:, 0] > 0
    rest = [max((y[~hit] == v).sum() * rate[v] / (y == v).sum(), 1e-9) for v in (0, 1)]
    none = float(rest[1] / (rest[0] + rest[1] + 1))
    if len(set(y[hit])) < 2:  # matches that say all, or none
        return Lexicon(every, none=none)
    w = _logistic(np.column_stack([np.ones(hit.sum()), x[hit]]), y[hit])
    return Lexicon(every, [float(w[0] + prior), *map(float, w[1:])], none=none)


_COUNTS = [f"t{p}" for p in range(PARTS)] + [f"c{p}" for p in range(PARTS)]


def score_documents(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The ``keep`` columns (doc_id) of every row plus score (0 to 1) and predicted (score >= 0.7), called as ``out`` says; they replace kept columns of these names. Null and empty texts score what no match scores."""
    keep = [k for k in (["doc_id"] if keep is None else keep) if k not in out]
    schema = docs.select(*keep).schema.add(out[0], "double").add(out[1], "integer")

    def run(batches):
        automata = lexicon.automata()
        for b in slices(batches):
            s = [score_of(measure(t or "", automata), lexicon) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=[*keep, *out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
