"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to several blocks of eight dimensions, and each block is
decoded to its nearest point of the E8 lattice; the points together are the vector's cell in a
table. Every vector is filed in its own cell and also looks into neighbouring cells, in several
tables. Vectors that meet are compared by cosine in double precision, as matrix blocks. Which
pairs meet in which cells follows from the vectors alone, so a task knows whether it is the first
to see a pair, and counts of links add up without a list of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.components import Roots, connected_components, cut
from forecourt.llm.e8 import nearest_points


@dataclass(frozen=True)
class LatticeRules:
    cosine: float = 0.93
    tables: int = 8
    blocks: int = 2  # of eight dimensions each
    scale: float = 0.35  # of the projection, in which the lattice's points are sqrt(2) apart
    probes: int = 2  # neighbouring cells looked into, in each table
    block_rows: int = 2048  # rows of a cell that one comparison holds
    bin_rows: int = 20_000  # rows of small cells that one task group holds
    seed: int = 5


def _projections(rules: LatticeRules, size: int) -> np.ndarray:
    random = np.random.default_rng([rules.seed, size])
    return random.normal(0, rules.scale, (rules.tables, size, 8 * rules.blocks))


def _hash_rows(cells: np.ndarray, salt: np.ndarray) -> np.ndarray:
    out = salt.astype(np.uint64)
    for k in range(cells.shape[1]):
        out = (out ^ cells[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def cells_of(units: np.ndarray, labels: np.ndarray, rules: LatticeRules) -> np.ndarray:
    """(vectors, tables, 1 + probes): the hash of each vector's own cell and of those it looks into."""
    out = np.empty((len(units), rules.tables, 1 + rules.probes), np.int64)
    everyone = np.arange(len(units))
    for t, matrix in enumerate(_projections(rules, units.shape[1])):
        salt = labels * 1_000_003 + t
        points = units @ matrix
        found = [nearest_points(points[:, 8 * b : 8 * b + 8]) for b in range(rules.blocks)]
        home = np.concatenate([f[:, 0] for f, _ in found], axis=1)
        out[:, t, 0] = _hash_rows(home, salt)
        others, cost = [], []
        for b, (near, far) in enumerate(found):
            for j in range(1, near.shape[1]):
                cell = home.copy()
                cell[:, 8 * b : 8 * b + 8] = near[:, j]
                others.append(cell)
                cost.append(far[:, j] - far[:, 0])
        order = np.argsort(np.stack(cost, axis=1), axis=1, kind="stable")
        others = np.stack(others, axis=1)
        for p in range(rules.probes):
            out[:, t, 1 + p] = _hash_rows(others[everyone, order[:, p]], salt)
    return out


def _meet_before(one: np.ndarray, two: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs, given by their cells, already meet in a table before this one."""
    seen = np.zeros(len(one), bool)
    for t in range(table):
        seen |= (one[:, t, :] == two[:, t, :1]).any(axis=1) | (two[:, t, 1:] == one[:, t, :1]).any(axis=1)
    return seen


def _first_meeting(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least cell of those in which pairs meet in one table, each in the home of one of them."""
    most = np.iinfo(np.int64).max
    at_two = np.where(one == two[:, :1], one, most).min(axis=1)
    at_one = np.where(two == one[:, :1], two, most).min(axis=1)
    return np.minimum(at_one, at_two)


def _units(table: pa.Table) -> np.ndarray:
    raw = table.column("unit").to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


FILED = "table int, code long, role int, chunk int, node long, label long, n long, unit binary"
FOUND = "kind int, a long, b long"


def _file_vectors(rules: LatticeRules):
    def run(batches):
        A.lean()
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            values = np.array(lists, np.float64)
            labels, nodes, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "node", "n"))
            for low in range(0, len(values), 500):
                part = slice(low, low + 500)
                units = values[part] / np.abs(values[part]).max(axis=1, keepdims=True)
                units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
                cells = cells_of(units, labels[part].astype(np.int64), rules)
                raw = [u.astype("<f8").tobytes() for u in units]
                n, t, p = cells.shape
                chunk = (nodes[part].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int32)
                who = np.repeat(np.arange(n), t * p)
                yield pa.record_batch(
                    [
                        pa.array(np.tile(np.repeat(np.arange(t), p), n), pa.int32()),
                        pa.array(cells.ravel(), pa.int64()),
                        pa.array(np.tile(np.arange(p), n * t), pa.int32()),
                        pa.array(chunk[who], pa.int32()),
                        pa.array(nodes[part].astype(np.int64)[who], pa.int64()),
                        pa.array(labels[part].astype(np.int64)[who], pa.int64()),
                        pa.array(sizes[part].astype(np.int64)[who], pa.int64()),
                        pa.array([raw[i] for i in who.tolist()], pa.binary()),
                    ],
                    ["table", "code", "role", "chunk", "node", "label", "n", "unit"],
                )

    return run


def _compare(rules: LatticeRules):
    def blocks(found: pa.Table):
        """Pairs of rows that meet in a cell: (table, rows of the left, rows of the right)."""
        low, high, code = (found.column(c).to_numpy() for c in ("low", "high", "code"))
        order = np.lexsort((high, low, code))
        change = np.flatnonzero(np.diff(code[order]) | np.diff(low[order]) | np.diff(high[order])) + 1
        role, mine, table = (found.column(c).to_numpy() for c in ("role", "part", "table"))
        for rows in np.split(order, change):
            if len(rows) < 2:
                continue
            i, j = low[rows[0]], high[rows[0]]
            home = role[rows] == 0
            if i == j:
                here = rows[home]
                if len(here):
                    yield table[rows[0]], here, here, True
                    if (~home).any():
                        yield table[rows[0]], rows[~home], here, False
            else:
                first, second = mine[rows] == i, mine[rows] == j
                if (home & second).any() and first.any():
                    yield table[rows[0]], rows[first], rows[home & second], False
                if (~home & second).any() and (home & first).any():
                    yield table[rows[0]], rows[~home & second], rows[home & first], False

    def run(found):
        A.lean()
        units = _units(found)
        node, n, label, code = (found.column(c).to_numpy() for c in ("node", "n", "label", "code"))
        links: dict[int, int] = {}
        roots = Roots()
        for table, left, right, same in blocks(found):
            for start in range(0, len(left), rules.block_rows):
                some = left[start : start + rules.block_rows]
                near = units[some] @ units[right].T >= rules.cosine
                if same:
                    near &= (start + np.arange(len(some)))[:, None] < np.arange(len(right))[None, :]
                a, b = np.nonzero(near)
                a, b = some[a], right[b]
                ok = (node[a] != node[b]) & (label[a] == label[b])
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                some_rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                cells = cells_of(units[some_rows], label[some_rows], rules)
                for part in range(0, len(a), 100_000):
                    x, y = place[: len(a)][part : part + 100_000], place[len(a) :][part : part + 100_000]
                    one, two = cells[x], cells[y]
                    new = ~_meet_before(one, two, int(table))
                    new &= _first_meeting(one[:, table], two[:, table]) == code[a[part : part + 100_000]]
                    p, q = a[part : part + 100_000][new], b[part : part + 100_000][new]
                    for who, other in ((p, q), (q, p)):
                        total = np.bincount(np.searchsorted(some_rows, who), weights=n[other], minlength=len(some_rows))
                        for row in np.flatnonzero(total).tolist():
                            key = int(node[some_rows[row]])
                            links[key] = links.get(key, 0) + int(total[row])
                    for u, v in set(zip(node[p].tolist(), node[q].tolist(), strict=True)):
                        roots.join(u, v)
        pairs = [(x, roots.root(x)) for x in list(roots.parent)]
        rows = [(0, k, v) for k, v in links.items()] + [(1, x, r) for x, r in pairs]
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())))})

    return run


def near_vectors(vectors: DataFrame, rules: LatticeRules = LatticeRules()) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label).

    Vectors of one label that is not null link where their cosine reaches the threshold. Vectors
    that are null, empty or zero, hold null or non-finite components, or have a null label or id
    link with nothing: n_links 0, their own component. Equal vectors of a label are one class from
    the start, so copies cost nothing more; they link with each other. Vectors of different sizes
    don't link. Repeated rows of one id and vector are one vector, and each of them gets its result.
    A cell with very many vectors is compared in square blocks by many tasks.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(F.col("embedding"), lambda x: x.cast("double")).alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = given.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    )
    classes = (
        able.distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    )
    classes = cut(classes, "vectors")
    sizes = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]
    found = None
    for size in sizes:  # the lengths of vectors: one, as a rule
        filed = classes.filter(F.size("embedding") == size).mapInArrow(_file_vectors(rules), FILED)
        counts = filed.groupBy("code").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rules.block_rows)
        parts = F.coalesce(F.ceil(F.col("_rows") / rules.block_rows), F.lit(1)).cast("int")
        mine = F.pmod(F.col("chunk"), F.col("parts"))
        dealt = (
            filed.join(counts, "code", "left")
            .withColumn("parts", parts)
            .withColumn("part", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("low", F.least("part", "other"))
            .withColumn("high", F.greatest("part", "other"))
        )
        rows = classes.count() * rules.tables * (1 + rules.probes)
        bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // rules.bin_rows)
        dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("code", "low", "high"), F.lit(bins)))
        here = dealt.select("bin", "table", "code", "role", "part", "low", "high", "node", "label", "n", "unit").groupBy("bin").applyInArrow(_compare(rules), FOUND)
        found = here if found is None else found.union(here)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    found = cut(found, "found")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("_links"))
    groups = connected_components(found.filter("kind = 1").select("a", "b"))
    known = classes.join(links, "node", "left").join(groups, "node", "left")
    known = known.select(
        "label", "embedding", F.col("n").alias("_n"),
        F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("component", "node").alias("_component"),
    )
    same = (F.col("g.label") == F.col("k.label")) & (F.col("g.embedding") == F.col("k.embedding")) & F.col("g.vec_id").isNotNull()
    out = given.alias("g").join(known.alias("k"), same, "left")
    component = F.coalesce("k._component", "g.vec_id")
    return out.select(
        F.col("g.vec_id").alias("vec_id"),
        F.coalesce(F.col("k._links") + F.col("k._n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("g.vec_id") == component).alias("kept"),
    )
