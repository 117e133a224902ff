"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets form one class first. Each class has a
sketch of minwise tokens; random trees branch it by selected coordinates: a
node picks one coordinate, every fourth a second one (1.25 = 1 / 0.8 children on
average), and a document goes to the child named by its minwise token there.
Small nodes compare all members; large ones branch on, inside the task that
holds their members' sketches. Pairs of one component need no comparison, so
each class first meets one leader, and nodes that this leaves in one component
are not compared at all. Twenty independent trees bring the chance to miss a
pair at the threshold under 1e-4. Every link counts only after both full sets
are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.sparkkit import Table
from gridloom.llm.textkit import batch_chunks, mix64, shingle_sets, slices

COORDS = 128
TREES, DEPTH, MORE_DEPTH = 20, 3, 4
#: Nodes of so many classes give all pairs in SQL; children of so many are compared in numpy.
SMALL_NODE, LEAF = 8, 64
#: Keys by which a class finds leaders; one large node in SAMPLE_NODES is compared before all the others.
KEYS, SAMPLE_NODES = 12, 8
#: Shingles of members of a large node that one task compares with as many others.
BLOCK = 1 << 22
#: Minwise tokens of a fine sketch, and how many of them a first comparison takes.
FINE, FIRST = 512, 128
#: Pairs whose sketches agree by so much less than the threshold reach it with a chance of about 1e-6.
SKETCH_SLACK, FINE_SLACK = 0.18, 0.09
_rng = np.random.default_rng(77)
_MUL = (_rng.integers(1, 1 << 31, FINE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, FINE, dtype=np.uint32)
_SLICE = 1 << 15
SALTS = (0x1234567, 0xABCDEF01)


def sketch(sets: np.ndarray, offs: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """(texts, coords) uint16 minwise tokens of non-empty sets; rows of empty sets are 0."""
    n = len(offs) - 1
    out = np.zeros((n, coords), np.uint16)
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return out
    i = 0
    while i < len(full):  # slices stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(offs[full + 1], offs[full[i]] + _SLICE, side="right")))
        rows = full[i:j]
        x = (sets[offs[rows[0]] : offs[rows[-1] + 1]] >> np.uint64(32)).astype(np.uint32)
        at = (offs[rows] - offs[rows[0]]).astype(np.int64)
        for c in range(coords):
            low = np.minimum.reduceat((x ^ _XOR[c]) * _MUL[c], at)
            low ^= low >> np.uint32(16)
            low *= np.uint32(0x7FEB352D)
            out[rows, c] = low >> np.uint32(16)
        i = j
    return out


def branch(paths: np.ndarray, rows: np.ndarray, sketches: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow ``depth`` levels from (path, row) pairs; one coordinate a node, a second for every fourth."""
    for _ in range(depth):
        one = mix64(paths + np.uint64(0x5851F42D4C957F2D))
        c1, c2 = (one % np.uint64(COORDS)).astype(np.int64), ((one >> np.uint64(20)) % np.uint64(COORDS)).astype(np.int64)
        two = ((one >> np.uint64(60)) < np.uint64(4)) & (c1 != c2)
        kids = [mix64(paths * np.uint64(0x2545F4914F6CDD1D) + (c.astype(np.uint64) << np.uint64(16)) + sketches[r, c] + np.uint64(1)) for c, r, paths in ((c1, rows, paths), (c2[two], rows[two], paths[two]))]
        paths, rows = np.concatenate(kids), np.concatenate([rows, rows[two]])
    return paths, rows


def _roots(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(mix64(np.arange(1, TREES + 1, dtype=np.uint64)), n), np.tile(np.arange(n), TREES)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (hash of the whole set), sketch."""

    def run(batches):
        for ids, buf, offs in batch_chunks(batches, "doc_id", "text"):
            sets, at = shingle_sets(buf, offs, words)
            k1, k2 = (_set_keys(sets, at, salt) for salt in SALTS)
            sk = sketch(sets, at)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(at)), pa.array(k1), pa.array(k2), pa.array([r.tobytes() for r in sk], pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDS)


def _frontier(classes: DataFrame) -> DataFrame:
    """id, c, n, path: the nodes at DEPTH of every class; classes: id, c (null where the class is its own component), n (its shingles), sketch."""

    def run(batches):
        for b in batches:
            sk = _sketches(b.column("sketch"))
            for at in range(0, len(sk), 2048):
                n = len(sk[at : at + 2048])
                paths, rows = branch(*_roots(n), sk[at : at + n], DEPTH)
                own = b.select(["id", "c", "n"]).take(pa.array(rows + at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(paths.view(np.int64))], names=["id", "c", "n", "path"])

    return classes.select("id", "c", "n", "sketch").mapInArrow(run, "id long, c long, n long, path long")


def _leaders(classes: DataFrame, share: int) -> DataFrame:
    """a > b: each class with the one leader that agrees most with its sketch, of the leaders of its KEYS keys; a key is three coordinates, its leader the least class that has it.

    One pair a class, however large its group: a pass that unites most of a
    group of copies before any tree branches it.
    """

    def run(batches):
        pick = [np.random.default_rng(k).choice(COORDS, 3, replace=False) for k in range(KEYS)]
        for b in batches:
            ids, sk = b.column("id").to_numpy(), _sketches(b.column("sketch")).astype(np.uint64)
            keys = [mix64(sk[:, x] << np.uint64(32) | sk[:, y] << np.uint64(16) | sk[:, z]) ^ np.uint64(k) for k, (x, y, z) in enumerate(pick)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, KEYS)), pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64())], names=["id", "key"])

    keyed = classes.select("id", "sketch").mapInArrow(run, "id long, key long")
    least = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(least, "key").where("id > leader").selectExpr("id AS a", "leader AS b").distinct()
    return _similar(pairs, classes, share).groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))


def _mixed(frontier: DataFrame) -> DataFrame:
    """path, id, c, n, members: members of nodes that hold classes of more than one component; n is the class's shingles, members the node's classes."""
    c = F.coalesce("c", "id")
    nodes = frontier.groupBy("path").agg(F.count("*").alias("members"), F.min(c).alias("x"), F.max(c).alias("y")).where("x != y").select("path", "members")
    return frontier.join(nodes, "path").select("path", "id", c.alias("c"), "n", "members")


def _small_pairs(mixed: DataFrame) -> DataFrame:
    """a > b: all pairs of small nodes, of different components."""
    small = mixed.where(f"members <= {SMALL_NODE}").groupBy("path").agg(F.sort_array(F.collect_set(F.struct("id", "c"))).alias("m"))
    return small.selectExpr("explode(filter(flatten(transform(m, (x, i) -> transform(slice(m, 1, i), y -> struct(x.id AS a, y.id AS b, x.c != y.c AS apart)))), p -> p.apart)) AS p").selectExpr("p.a", "p.b")


def _bodies(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """id, fine, full: FINE minwise tokens of 8 bits and the whole set of the classes in members (id, doc)."""

    def run(batches):
        for _, buf, offs in batch_chunks(batches, "doc_id", "text"):
            sets, at = shingle_sets(buf, offs, words)
            fine = (sketch(sets, at, FINE) >> np.uint16(8)).astype(np.uint8)
            full = [sets[at[k] : at[k + 1]].tobytes() for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(_set_keys(sets, at, SALTS[0])), pa.array([r.tobytes() for r in fine], pa.binary()), pa.array(full, pa.binary())], names=["id", "fine", "full"])

    found = docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(run, "id long, fine binary, full binary")
    return found.join(members.select("id"), "id", "left_semi").dropDuplicates(["id"])


def node_pairs(path: int, fine: np.ndarray, c: np.ndarray, n: np.ndarray, allowed, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of one node that lie in different components and whose sizes and sketches allow the threshold, the most similar ones first.

    The node branches on by coordinates of the fine sketch, MORE_DEPTH levels
    at most, until a child is small; children of one component end there. All
    members outside a child's largest component meet all its members.
    ``allowed`` (rows, rows -> bool) restricts pairs.
    """
    stack, found = [(np.uint64(path & (1 << 64) - 1), np.arange(len(c)), 0)], []
    floor = share / 100 - FINE_SLACK
    while stack:
        p, rows, depth = stack.pop()
        kinds, counts = np.unique(c[rows], return_counts=True)
        if len(kinds) < 2:
            continue
        if len(rows) > LEAF and depth < MORE_DEPTH:
            one = int(mix64(np.array([int(p) + 0x5851F42D4C957F2D & (1 << 64) - 1], np.uint64))[0])
            coords = [one % FINE, (one >> 20) % FINE]
            for k in dict.fromkeys(coords if one >> 60 < 4 else coords[:1]):
                order = rows[np.argsort(fine[rows, k], kind="stable")]
                value = fine[order, k]
                for part in np.split(order, np.flatnonzero(value[1:] != value[:-1]) + 1):
                    if len(part) > 1:
                        child = mix64(np.array([int(p) * 0x2545F4914F6CDD1D + (k << 16) + int(fine[part[0], k]) + 1 & (1 << 64) - 1], np.uint64))[0]
                        stack.append((child, part, depth + 1))
            continue
        left = rows[c[rows] != kinds[counts.argmax()]]
        for at in range(0, len(left), 256):
            l = left[at : at + 256]
            same = np.zeros((len(l), len(rows)), np.uint8)
            for k in range(FIRST):
                same += fine[l, k][:, None] == fine[rows, k]
            lo, hi = np.minimum(n[l][:, None], n[rows]), np.maximum(n[l][:, None], n[rows])
            i, j = np.nonzero((same >= (share / 100 - SKETCH_SLACK) * FIRST) & (c[l][:, None] != c[rows]) & (100 * lo >= share * hi) & allowed(l[:, None], rows))
            i, j = l[i], rows[j]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                est = (fine[x] == fine[y]).mean(axis=1)
                found.append(np.stack((np.maximum(x, y), np.minimum(x, y), (est * FINE).astype(np.int64)))[:, est >= floor])
    p = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    p = p[:, np.argsort(-p[2], kind="stable")]
    return p[0], p[1]


def node_links(i: np.ndarray, j: np.ndarray, c: np.ndarray, full: list[bytes], share: int) -> list[int]:
    """Which of the pairs (i, j) are links, by full sets; pairs that earlier links or components (c) join already are not compared."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(int(c[x])), find(int(c[y]))
        if a != b and _linked_sets(full[x], full[y], share):
            parent[a] = b
            out.append(k)
    return out


def _large_links(members: DataFrame, bodies: DataFrame, share: int) -> DataFrame:
    """a > b: links of large nodes that join different components; members: path, id, c, n (its shingles).

    Members outside a node's largest component are dealt into blocks, which
    meet each other and the blocks of the largest component; a task holds two
    blocks of bounded size at once, with their full sets. What it returns is a
    forest, so links are no more than members, whatever the pairs compared.
    """
    size = f"CAST(ceil({{}} / {BLOCK}) AS int)"
    nodes = members.groupBy("path", "c").agg(F.sum("n").alias("m")).groupBy("path").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("n")).where("n > top.m")
    nodes = nodes.selectExpr("path", "top.c AS top", f"{size.format('(n - top.m)')} AS rest", f"{size.format('top.m')} AS tops", f"n <= {BLOCK} AS whole")
    dealt = members.join(nodes, "path").withColumn("at", F.expr("if(whole, 0, if(c = top, rest + pmod(xxhash64(id, path), tops), pmod(xxhash64(id, path), rest)))"))
    cells = dealt.selectExpr("path", "id", "c", "n", "at", "explode(if(whole, array(0), sequence(0, if(c = top, rest, rest + tops) - 1))) AS other").selectExpr("path", "id", "c", "n", "at", "least(at, other) AS x", "greatest(at, other) AS y")

    def run(cell: pa.Table) -> pa.Table:
        ids, c, n, at, x, y = (cell.column(k).to_numpy() for k in ("id", "c", "n", "at", "x", "y"))
        fine = np.frombuffer(b"".join(cell.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        allowed = (lambda l, r: at[l] != at[r]) if len(x) and x[0] != y[0] else (lambda l, r: True)
        i, j = node_pairs(int(cell.column("path")[0].as_py()) if len(x) else 0, fine, c, n, allowed, share)
        ok = node_links(i, j, c, cell.column("full").to_pylist(), share) if len(i) else []
        i, j = ids[i[ok]], ids[j[ok]]
        return pa.table({"a": np.maximum(i, j), "b": np.minimum(i, j)})

    return cells.join(bodies, "id").groupBy("path", "x", "y").applyInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """a, b, same: pairs whose sizes allow the threshold and whose sketches agree enough, and the share of agreement."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                same = (_sketches(b.column("sa")) == _sketches(b.column("sb"))).mean(axis=1)
                out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(same)], names=["a", "b", "same"])
                yield out.filter(pa.array(same >= share / 100 - SKETCH_SLACK))

    a = classes.selectExpr("id AS a", "n AS na", "sketch AS sa")
    b = classes.selectExpr("id AS b", "n AS nb", "sketch AS sb")
    both = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {share} * greatest(na, nb)")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, same double")


def _linked_sets(p: bytes, q: bytes, share: int) -> bool:
    u = np.sort(np.concatenate((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))), kind="stable")
    both = int((u[1:] == u[:-1]).sum())
    return 100 * both >= share * (len(u) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) with 100 * |both| >= share * |either|, counted on full sets."""

    def run(batches):
        for b in slices(batches):
            x, y = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            ok = [_linked_sets(p, q, share) for p, q in zip(x, y)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    j = pairs.join(sets.selectExpr("id AS a", "full AS sa"), "a").join(sets.selectExpr("id AS b", "full AS sb"), "b")
    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _set_keys(sets: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each whole set, as int64."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(salt)))))
    return mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _full_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """id, full: the sets of the classes in members (doc: one document of each)."""

    def run(batches):
        for _, buf, offs in batch_chunks(batches, "doc_id", "text"):
            sets, at = shingle_sets(buf, offs, words)
            yield pa.RecordBatch.from_arrays([pa.array(_set_keys(sets, at, SALTS[0])), pa.array([sets[at[k] : at[k + 1]].tobytes() for k in range(len(at) - 1)], pa.binary())], names=["id", "full"])

    found = docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(run, "id long, full binary")
    return found.join(members.select("id"), "id", "left_semi").dropDuplicates(["id"])


def _linked(spark: SparkSession, todo: Table, links: Table | None, docs: DataFrame, classes: DataFrame, words: int, share: int) -> Table:
    """(a, b): components over the given links and the pairs of todo that full sets confirm; both tables are dropped."""
    pairs, n_classes = todo.df.count(), classes.count()
    if not pairs and links is not None:
        todo.drop()
        return links
    involved = classes.select("id", "doc").join(todo.df.selectExpr("explode(array(a, b)) AS id").distinct(), "id", "left_semi")
    sets = Table(spark, _full_sets(docs, involved, words), "sets")
    width = 1
    while True:  # many pairs: each round confirms a few of every class; pairs that are in one component by now need no comparison
        few = pairs <= n_classes
        some = todo.df if few else todo.df.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(f"r <= {width}").select("a", "b")
        good = _confirm(some, sets.df, share)
        merged = components(spark, good if links is None else good.unionByName(links.df))
        if links is not None:
            links.drop()
        links = merged
        if not few:
            home = links.df.selectExpr("a AS v", "b AS c")
            rest = todo.df.join(some, ["a", "b"], "left_anti")
            rest = rest.join(home.selectExpr("v AS a", "c AS ca"), "a", "left").join(home.selectExpr("v AS b", "c AS cb"), "b", "left")
            left = Table(spark, rest.where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "pairs")
            todo.drop()
            todo, width, pairs = left, width * 4, left.df.count()
        if few or not pairs:
            todo.drop()
            sets.drop()
            return links


def link_classes(docs: DataFrame, classes: DataFrame, words: int, share: int) -> Table:
    """(a, b): each class that is linked to others, but the least of its component, and that least class.

    First every class meets one leader; what that unites counts as one
    component, and only nodes of several components are compared further:
    small ones, a part of the large ones, and, with the components joined
    again, all the others.
    """
    spark = docs.sparkSession
    links = _linked(spark, Table(spark, _leaders(classes, share), "pairs"), None, docs, classes, words, share)

    def at_home(df: DataFrame) -> DataFrame:
        return df.join(links.df.selectExpr("a AS id", "b AS c"), "id", "left")

    mixed = Table(spark, _mixed(_frontier(at_home(classes.select("id", "n", "sketch")))), "nodes")
    large = mixed.df.where(f"members > {SMALL_NODE}").select("path", "id", "n")
    pairs = Table(spark, _similar(_small_pairs(mixed.df).distinct(), classes, share).select("a", "b"), "pairs")
    links = _linked(spark, pairs, links, docs, classes, words, share)
    if not large.isEmpty():
        bodies = Table(spark, _bodies(docs, classes.select("id", "doc").join(large.select("id").distinct(), "id", "left_semi"), words), "bodies")
        for nodes in (f"pmod(path, {SAMPLE_NODES}) = 0", f"pmod(path, {SAMPLE_NODES}) != 0"):
            now = at_home(large.where(nodes)).select("path", "id", F.coalesce("c", "id").alias("c"), "n")
            merged = components(spark, _large_links(now, bodies.df, share).unionByName(links.df))
            links.drop()
            links = merged
        bodies.drop()
    mixed.drop()
    return links


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Shingles are ``words`` lower-cased words; a shorter text is one shingle of
    all its words; null texts and texts without words have no shingles and are
    linked with nothing, each its own component. component_id is the least
    doc_id reachable over links. Repeated rows are equal documents; rows that
    share an id but not the text are judged each by its text. Rows with a null
    id are linked with nothing and not kept (component null).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sig = Table(spark, signatures(docs, words), "signatures")
    real = sig.df.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = Table(spark, real.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch")).selectExpr("k1 AS id", "k2", "n_shingles AS n", "doc", "sketch"), "classes")
    links = link_classes(docs, classes.df.select("id", "n", "doc", "sketch"), words, share)
    rooted = classes.df.select("id", "k2", "n", "doc").join(links.df.selectExpr("a AS id", "b AS root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").selectExpr("id AS k1", "k2", "n AS n_shingles", "component_id")
    out = sig.df.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    home = "if(n_shingles > 0 AND doc_id IS NOT NULL, component_id, doc_id)"
    done = Table(spark, out.selectExpr("doc_id", "n_shingles", f"{home} AS component_id", f"coalesce(doc_id = {home}, false) AS kept"), "components")
    for t in (sig, classes, links):
        t.drop()
    return done.df
