"""Preparation of model tables: fitted parameters are small DataFrames or dicts, applied by expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.checkpoints import cut, stored
from strataspark.contract import OTHER, RARE_MIN_ROWS, UNKNOWN
from strataspark.functions.columns import circular, key_hash, pearson, uniform
from strataspark.operators.ordered import running_sum

#: Pivots that divide vectors (they go to every task), rows for each, and rows compared at once.
MAX_PIVOTS, PIVOT_ROWS, BLOCK = 4096, 256, 8192
#: Distances to pivots, and rows on their way to packs of cells, that a task has at once.
SPREADS, VISITS = 1 << 20, 1 << 14
#: Products, and differences of components, that a task has at once; tasks for each slot of the cluster.
PRODUCTS, DIFFERENCES, TASKS = 1 << 20, 1 << 20, 8
#: Levels of a category that may become columns.
MAX_LEVELS = 1000
#: A median is looked for between two quantiles this far from 0.5; their ranks are wrong by less than one in ACCURACY.
AROUND, ACCURACY = 0.001, 10_000


def impute_numbers(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls become the exact median of the known values (of fit_on). A column without any is an error."""
    m = (df if fit_on is None else fit_on).agg(*[F.median(c).alias(c) for c in columns]).first()
    empty = [c for c in columns if m[c] is None]
    if empty:
        raise ValueError(f"no known value in {', '.join(empty)}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m[c])) for c in columns})


def impute_categories(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls become the commonest value, ties to the alphabetically first; Unknown if there is none."""
    from strataspark.operators.tables import mode_by

    src = df if fit_on is None else fit_on
    fill = {c: (r.mode if (r := mode_by(src.withColumn("_g", F.lit(1)), ["_g"], c).first()) else UNKNOWN) for c in columns}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def merge_rare(df: DataFrame, column: str, least: int = RARE_MIN_ROWS, fit_on: DataFrame | None = None) -> DataFrame:
    """Values with fewer than least rows, and values not seen at all, become Other."""
    kept = (df if fit_on is None else fit_on).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    out = df.join(kept, column, "left")
    return out.withColumn(column, F.when(F.col("_n").isNotNull() | F.col(column).isNull(), F.col(column)).otherwise(OTHER)).drop("_n")


def reference_level(df: DataFrame, column: str) -> DataFrame:
    """The commonest level, ties to the alphabetically first."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), column).limit(1).select(F.lit(column).alias("column"), F.col(column).alias("reference"), "n")


def levels(df: DataFrame, column: str) -> list[str]:
    """Sorted levels but for the reference; more than MAX_LEVELS are an error."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    return sorted(r[column] for r in rows[1:])


def one_hot(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A 0/1 column for each level but the reference; a level not among them is all zero."""
    return df.select("*", *[F.coalesce(F.col(column) == n, F.lit(False)).cast("double").alias(f"{column}={n}") for n in names])


def circular_columns(df: DataFrame, angle: str) -> DataFrame:
    s, c = circular(angle)
    return df.select("*", s.alias(f"{angle}_sin"), c.alias(f"{angle}_cos")).drop(angle)


def scaling(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, from one pass."""
    r = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return {c: (r[c].m, r[c].s or 1.0) for c in columns}


def scale(df: DataFrame, params: dict[str, tuple[float, float]], inverse: bool = False) -> DataFrame:
    return df.withColumns({c: F.col(c) * s + m if inverse else (F.col(c) - m) / s for c, (m, s) in params.items()})


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of all pairs in one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    r = df.agg(*[pearson(columns[i], columns[j]).alias(f"{i}_{j}") for i, j in pairs]).first() if pairs else None
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = r[f"{i}_{j}"] if r[f"{i}_{j}"] is not None else np.nan
    return m


def vif(matrix: np.ndarray) -> np.ndarray:
    """1 / (1 - R**2) of each column on the others. Infinite for columns that others give exactly, and for constant ones."""
    known = np.isfinite(matrix).sum(1) > 1 if len(matrix) > 1 else np.ones(len(matrix), bool)
    out = np.full(len(matrix), np.inf)
    m = matrix[np.ix_(known, known)]
    if not np.isfinite(m).all():
        return out
    if len(m) and np.linalg.cond(m) <= 1e12:
        out[known] = np.diag(np.linalg.inv(m))
        return out
    for i, k in enumerate(np.flatnonzero(known)):
        rest = np.arange(len(m)) != i
        gap = 1 - m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ m[i, rest]
        out[k] = 1 / gap if gap > 1e-9 else np.inf
    return out


def prune_matrix(m: np.ndarray, columns: list[str], limit: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Columns left, and those dropped with their factor: the worst goes, the first of equal ones, until all are within the limit."""
    left, gone = list(range(len(columns))), []
    while len(left) > 1:
        v = vif(m[np.ix_(left, left)])
        k = int(np.argmax(v))
        if v[k] <= limit:
            break
        gone.append((columns[left[k]], float(v[k])))
        del left[k]
    return [columns[i] for i in left], gone


def prune_vif(df: DataFrame, columns: list[str], limit: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """prune_matrix on the table's correlations. One pass over the data serves all rounds."""
    return prune_matrix(correlation_matrix(df, columns), columns, limit)


def varying(df: DataFrame, columns: list[str], least: float = 1e-12) -> list[str]:
    r = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if r[c] is not None and r[c] > least]


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """df with part: test for exactly round(n * share) rows of each class, train for the rest, by the order of a hash of a unique key."""
    x = df.withColumn("_h", key_hash(key, seed)).withColumn("_one", F.lit(1))
    x = running_sum(x, "_h", {"_one": "_rank"}, by=[label], tie=key)
    n = df.groupBy(label).agg(F.round(F.count("*") * share).cast("long").alias("_cut"))
    return x.join(n, label).withColumn("part", F.when(F.col("_rank") <= F.col("_cut"), "test").otherwise("train")).drop("_h", "_one", "_rank", "_cut")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(key_hash(key, seed), key)


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows with the classes' shares: round(n * share) of each, the first by a hash of the key."""
    total = df.count()
    x = running_sum(df.withColumns({"_h": key_hash(key, seed), "_one": F.lit(1)}), "_h", {"_one": "_rank"}, by=[label], tie=key)
    size = df.groupBy(label).agg(F.round(F.count("*") * (n / max(1, total))).cast("long").alias("_n"))
    return x.join(size, label).where(F.col("_rank") <= F.col("_n")).drop("_h", "_one", "_rank", "_n")


def typical_row(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """One row: exact medians and commonest classes."""
    from strataspark.operators.tables import mode_by

    out = df.agg(*[F.median(c).alias(c) for c in numbers])
    for c in categories:
        out = out.join(F.broadcast(mode_by(df.withColumn("_g", F.lit(1)), ["_g"], c).select(F.col("mode").alias(c))))
    return out


def row_of_class(df: DataFrame, key: str, label: str, value: int, seed: int = 42) -> DataFrame:
    """A row of a class, chosen by a hash."""
    return df.where(F.col(label) == value).orderBy(key_hash(key, seed), key).limit(1)


def class_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, known): the sorted classes that training has seen."""
    one = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "known")


def seeded_places(df: DataFrame, key: str, name: str, seed: int = 42) -> DataFrame:
    """df with each row's place, from 1, in that order."""
    return running_sum(df.withColumns({"_h": key_hash(key, seed), "_one": F.lit(1)}), "_h", {"_one": name}, tie=key).drop("_h", "_one")


def _pivots(df: DataFrame, n: int) -> np.ndarray:
    """Vectors to divide the others by: those of the smallest hashes, each once, at most MAX_PIVOTS."""
    want = max(1, min(MAX_PIVOTS, -(-n // PIVOT_ROWS)))
    rows = df.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(2 * want).collect()
    return np.unique(np.array([r.v for r in rows], float), axis=0)[:want]


def _spread(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _packs(pivots: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of pivots in packs of so few rows, or one pivot alone: halved along the widest component."""
    left, out = [np.arange(len(pivots))], []
    while left:
        at = left.pop()
        if len(at) == 1 or rows[at].sum() <= most:
            out.append(at)
            continue
        at = at[np.argsort(pivots[at][:, np.argmax(np.ptp(pivots[at], axis=0))], kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(rows[at]), rows[at].sum() / 2) + 1, 1, len(at) - 1))
        left += [at[:half], at[half:]]
    return out


class _Nearest:
    """Each row's k nearest so far, as rows of (place, other's id, distance), and how far the k-th is."""

    def __init__(self, x: np.ndarray, me: np.ndarray, bound: np.ndarray, k: int):
        self.x, self.me, self.bound, self.k, self.done = x, me, bound.copy(), k, 0
        self.row, self.nid, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, at: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        """The rows at some places against other rows. One product of matrices tells which pairs may be within the bounds; their distances are then computed as such."""
        step = max(1, PRODUCTS // len(ids))
        middle = y.mean(0)
        y0 = y - middle
        yy = (y0 * y0).sum(1)
        for n in range(0, len(at), step):
            i = at[n : n + step]
            x0 = self.x[i] - middle
            xx = (x0 * x0).sum(1)
            apart = xx[:, None] + yy[None] - 2 * x0 @ y0.T
            apart[self.me[i][:, None] == ids[None]] = np.inf
            slack = 4e-15 * (y.shape[1] + 8) * (xx + yy.max())
            limit = self.bound[i] * (1 + 1e-9)
            limit = limit * limit
            if len(ids) > self.k:
                loose = np.flatnonzero(np.isinf(limit))
                limit[loose] = np.partition(apart[loose], self.k - 1, axis=1)[:, self.k - 1] + slack[loose]
            r, c = np.nonzero((apart <= (limit + slack)[:, None]) & (apart < np.inf))
            self.done += apart.size
            piece = max(1, DIFFERENCES // y.shape[1])
            dist = np.concatenate([np.sqrt(((y[c[m : m + piece]] - self.x[i[r[m : m + piece]]]) ** 2).sum(1)) for m in range(0, len(r), piece)] or [np.zeros(0)])
            near = dist <= self.bound[i[r]] * (1 + 1e-9)
            self._keep(i[r[near]], ids[c[near]], dist[near])

    def _keep(self, row: np.ndarray, nid: np.ndarray, dist: np.ndarray) -> None:
        if not len(row):
            return
        old = np.isin(self.row, row)
        r, n, d = (np.concatenate(x) for x in ((self.row[old], row), (self.nid[old], nid), (self.dist[old], dist)))
        o = np.lexsort((n, d, r))
        place = np.arange(len(o)) - np.searchsorted(r[o], r[o])
        full = o[place == self.k - 1]
        self.bound[r[full]] = np.minimum(self.bound[r[full]], d[full])
        o = o[place < self.k]
        self.row, self.nid, self.dist = (np.concatenate(x) for x in ((self.row[~old], r[o]), (self.nid[~old], n[o]), (self.dist[~old], d[o])))


def vector_neighbours(df: DataFrame, k: int, count=None) -> DataFrame:
    """(id, rank, nid, dist): k nearest other rows of (id, v array<double>), ties to the smaller nid. Exact.

    Each row belongs to the cell of the nearest of some pivots, and cells that lie side by side make packs of about BLOCK rows. Its k nearest in its own pack bound how far the others can be; after that it goes only to packs,
    and in them to cells, that the triangle inequality leaves open: those whose farthest member, seen from their pivot, could be near enough, and whose half of the space is. A row and a cell that are left meet in a product of matrices.
    A cell of more than BLOCK rows is cut into blocks, and the rows that visit a block into parts of as many, so it is many tasks. Where vectors have no structure, all rows meet all others: the work grows with the square,
    what travels with the square over BLOCK, a task's memory not at all. count, an accumulator, gets the pairs computed."""
    import pandas as pd

    spark, df = df.sparkSession, cut(df.select("id", "v"))
    pivots = _pivots(df, df.count())
    if not len(pivots):
        return spark.createDataFrame([], "id long, rank int, nid long, dist double")

    def slices(batches, most: int):
        """The batches in pieces of at most so many rows."""
        for pdf in batches:
            for n in range(0, len(pdf), max(1, most)):
                yield pdf.iloc[n : n + max(1, most)]

    def assign(batches):
        for pdf in slices(batches, SPREADS // len(pivots)):
            d = _spread(np.stack(pdf["v"]).astype(float), pivots)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype("int32"), far=d[np.arange(len(d)), cell])

    rows = df.mapInPandas(assign, "id long, v array<double>, cell int, far double")
    sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius")))
    told = {r.cell: r for r in sizes.collect()}  # one row a pivot
    cells = np.array(sorted(told))
    held = np.array([told[c].rows for c in cells])
    packs = _packs(pivots[cells], held, BLOCK)
    cells = np.concatenate([cells[p] for p in packs])  # by pack from now on
    radii, pack = np.array([told[c].radius for c in cells]), np.repeat(np.arange(len(packs)), [len(p) for p in packs])
    starts, number = np.searchsorted(pack, np.arange(len(packs))), dict(zip(cells.tolist(), pack.tolist(), strict=True))
    blocks = spark.createDataFrame([(int(c), int(number[c]), -(-told[c].rows // BLOCK)) for c in cells], "cell int, pack int, blocks long")
    # in packs of several cells there is one block
    rows = cut(rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks"))
    slots = TASKS * spark.sparkContext.defaultParallelism

    def reach(x, far, mine, bound, at) -> np.ndarray:
        """Which of some cells may hold rows within the bounds; far is the distance to the own pivot."""
        d, apart = _spread(x, pivots[cells[at]]), _spread(pivots[mine], pivots[cells[at]])
        slack = 1e-6 * (np.maximum(d.max(1, initial=0), far) + 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            half = (d**2 - far[:, None] ** 2) / (2 * apart)
        return (d - radii[at][None] <= (bound + slack)[:, None]) & (~(half > (bound + slack)[:, None]) | (mine[:, None] == cells[at][None]))

    def search(n: int, x, me, far, mine, bound, y, ids, of) -> _Nearest:
        """Rows against a block of pack n, whose rows belong to cells of."""
        near, at = _Nearest(x, me, bound, k), np.flatnonzero(pack == n)
        for own in (True, False):
            for c in at:
                some = np.flatnonzero(of == cells[c])
                i = np.flatnonzero((mine == cells[c]) == own)
                if not own and len(i):
                    i = i[reach(x[i], far[i], mine[i], near.bound[i], np.array([c]))[:, 0]]
                if len(i) and len(some):
                    near.meet(i, y[some], ids[some])
        if count is not None:
            count.add(int(near.done))
        return near

    parted = lambda p: (np.stack(p["v"]).astype(float), p["id"].to_numpy(), p["far"].to_numpy(), p["cell"].to_numpy())

    def own(key, pdf):
        x, ids, far, cell = parted(pdf)
        near = search(key[0], x, ids, far, cell, np.full(len(ids), np.inf), x, ids, cell)
        return pdf[["id", "v", "cell", "far"]].assign(bound=near.bound)

    first = cut(rows.repartition(min(slots, len(packs) + int((held // BLOCK).sum())), "pack", "block").groupBy("pack", "block").applyInPandas(own, "id long, v array<double>, cell int, far double, bound double"))

    def visits(batches):
        """Each row with the packs that may hold nearer ones, its own too."""
        for pdf in slices(batches, min(SPREADS // len(cells), VISITS // len(packs))):
            x, _, far, mine = parted(pdf)
            i, j = np.nonzero(np.logical_or.reduceat(reach(x, far, mine, pdf["bound"].to_numpy(), np.arange(len(cells))), starts, axis=1))
            yield pdf.iloc[i].assign(pack=j.astype("int32"))

    asked = first.mapInPandas(visits, "id long, v array<double>, cell int, far double, bound double, pack int")
    table = blocks.groupBy("pack").agg(F.max("blocks").alias("blocks")).join(asked.groupBy("pack").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "pack").collect()  # one row a pack
    meetings = sum(t.blocks * t.parts for t in table)
    table = F.broadcast(spark.createDataFrame([tuple(t) for t in table], "pack int, blocks long, parts long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    keys = ["pack", "block", "part"]
    asked = asked.join(table, "pack").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts")).select("id", "v", "cell", "far", "bound", "pack", "part", every("blocks").alias("block"))
    others = rows.join(table, "pack").select("id", "v", "cell", "far", "pack", "block", every("parts").alias("part"))

    def meet(key, a, c):
        if a.empty or c.empty:
            return pd.DataFrame([], columns=["id", "nid", "dist"], dtype=object)
        (x, me, far, mine), (y, ids, _, of) = parted(a), parted(c)
        near = search(key[0], x, me, far, mine, a["bound"].to_numpy(), y, ids, of)
        return pd.DataFrame({"id": me[near.row], "nid": near.nid, "dist": near.dist})

    left, right = (x.repartition(max(1, min(slots, meetings)), *keys).groupBy(*keys) for x in (asked, others))
    found = left.cogroup(right).applyInPandas(meet, "id long, nid long, dist double")
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "nid"))), 1, k).alias("b"))
    return best.select("id", F.posexplode("b").alias("p", "x")).select("id", (F.col("p") + 1).alias("rank"), F.col("x.nid").alias("nid"), F.col("x.dist").alias("dist"))


def smote(df: DataFrame, label: str, minority: int, k: int = 5, seed: int = 42) -> DataFrame:
    """df (id, v, label) with synthetic minority rows up to the other classes' number: each lies between a row and one of its k nearest of the class.

    Rows take turns by hash order; neighbour and place come from hashes. Synthetic rows are numbered down from the smallest id, or from 0 if that is
    positive, so no two rows share an id."""
    mine = df.where(F.col(label) == minority)
    n, m = df.where(F.col(label) != minority).count(), mine.count()
    need = max(0, n - m)
    if not need or m < 2:
        return df
    least = min(0, df.agg(F.min("id")).first()[0])
    near = vector_neighbours(mine.select("id", "v"), min(k, m - 1)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nid"))).alias("_near"))
    ranked = running_sum(mine.select("id", "v", key_hash("id", seed).alias("_h"), F.lit(1).alias("_one")), "_h", {"_one": "_rank"}, tie="id")
    copies = F.floor(F.lit(need / m)).cast("int") + (F.col("_rank") <= need % m).cast("int")
    each = ranked.join(near, "id").where(copies > 0).select("id", "v", "_near", "_rank", F.explode(F.sequence(F.lit(1), copies)).alias("_c"))
    place = F.pmod("id", F.lit(2147483647))
    pick = F.element_at("_near", (F.pmod(key_hash(place * 131 + F.col("_c"), seed), F.size("_near")) + 1).cast("int"))["nid"]
    other = mine.select(F.col("id").alias("_nid"), F.col("v").alias("_nv"))
    made = each.withColumn("_nid", pick).join(other, "_nid").withColumn("_t", uniform(place * 977 + F.col("_c"), seed + 1, 811297697))
    number = F.lit(least) - ((F.col("_c") - 1).cast("long") * m + F.col("_rank"))
    out = made.select(number.alias("id"), F.transform(F.arrays_zip("v", "_nv"), lambda x: x["v"] + F.col("_t") * (x["_nv"] - x["v"])).alias("v"), F.lit(minority).alias(label))
    return df.select("id", "v", label).unionByName(out)


def aligned_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named columns as doubles, in order; those that df lacks are 0."""
    return df.select(*[(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)).alias(n) for n in names])


def fold_transform(df: DataFrame, folds: DataFrame, key: str, numbers: list[str], category: str, least: int) -> DataFrame:
    """Every row once for every fold, prepared with what the fold's train rows teach: medians, rare classes, means and deviations.

    folds is (fold, key, role). All folds are fitted in the same jobs; parameters are one row per fold."""
    x = folds.join(df, key)
    train = x.where("role = 'train'")
    med = train.groupBy("fold").agg(*[F.median(c).alias(f"_m_{c}") for c in numbers])
    filled = x.join(F.broadcast(med), "fold").withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in numbers})
    stats = filled.where("role = 'train'").groupBy("fold").agg(*[f for c in numbers for f in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    kept = train.groupBy("fold", category).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    out = filled.join(F.broadcast(stats), "fold").join(kept, ["fold", category], "left")
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")) for c in numbers}
    return out.withColumns(scaled).withColumn(category, F.when(F.col("_n").isNotNull(), F.col(category)).otherwise(OTHER)).select("fold", key, "role", *numbers, category)


def fold_vocabulary(train: DataFrame, category: str, least: int) -> dict[int, tuple[str, list[str], list[str]]]:
    """For each fold the category's mode, its frequent levels (nulls count for the mode), and the levels that become columns, all but the commonest.

    Levels with fewer than least rows are one level, Other. Ties go to the alphabetically first."""
    g = train.groupBy("fold", F.col(category).alias("c")).agg(F.count("*").alias("n")).persist()
    known = F.col("c").isNotNull()
    told = g.groupBy("fold").agg(F.sum("n").alias("rows"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"), F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "c"))).alias("top")).collect()
    rows = g.where(known & (F.col("n") >= least)).orderBy("fold", "c").limit(len(told) * MAX_LEVELS + 1).collect()
    g.unpersist()
    if len(rows) > len(told) * MAX_LEVELS:
        raise ValueError(f"{category} has more than {MAX_LEVELS} levels")
    out = {}
    for t in told:
        mode = t.top.c if t.top else UNKNOWN
        counts = {r.c: r.n for r in rows if r.fold == t.fold}
        counts[mode] = (-t.top.n if t.top else 0) + t.nulls
        frequent = sorted(c for c, n in counts.items() if n >= least)
        merged = {c: counts[c] for c in frequent}
        if other := t.rows - sum(merged.values()):
            merged[OTHER] = merged.get(OTHER, 0) + other
        out[t.fold] = mode, frequent, sorted(sorted(merged, key=lambda c: (-merged[c], c))[1:])
    return out


def fold_medians(train: DataFrame, columns: list[str]) -> dict[int, list[float | None]]:
    """Each fold's exact medians of columns of finite doubles or nulls; None without a value.

    Two approximate quantiles enclose a median. Rows below them and up to them are counted; where they differ, values between are counted each and ordered: about one in 500 and
    the ends' ties, not a fold's whole column. A column whose quantiles don't enclose it is done by Spark's own median."""
    spark = train.sparkSession
    if not columns:
        return {r.fold: [] for r in train.select("fold").distinct().collect()}
    ends = F.array(F.lit(0.5 - AROUND), F.lit(0.5 + AROUND))
    near = train.groupBy("fold").agg(*[f for i, c in enumerate(columns) for f in (F.approx_percentile(c, ends, ACCURACY).alias(f"_q{i}"), F.count(c).alias(f"_n{i}"))]).collect()
    bounds = spark.createDataFrame([(r.fold, *[v for i in range(len(columns)) for v in (r[f"_q{i}"] or [None, None])]) for r in near], ", ".join(["fold int"] + [f"_lo{i} double, _hi{i} double" for i in range(len(columns))]))
    x = train.select("fold", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]).join(F.broadcast(bounds), "fold")
    counts = x.groupBy("fold").agg(*[f for i in range(len(columns)) for f in (F.count_if(F.col(f"_c{i}") < F.col(f"_lo{i}")).alias(f"_b{i}"), F.count_if(F.col(f"_c{i}") <= F.col(f"_hi{i}")).alias(f"_u{i}"))])
    counted = {r.fold: r for r in counts.collect()}
    found, wanted = {}, []
    for r in near:
        for i in range(len(columns)):
            n, below, upto = r[f"_n{i}"], counted[r.fold][f"_b{i}"], counted[r.fold][f"_u{i}"]
            if n and below <= (n - 1) // 2 and n // 2 < upto:
                lo, hi = r[f"_q{i}"]
                if lo == hi:
                    found[r.fold, i] = lo, lo
                else:
                    wanted.append((r.fold, i, (n - 1) // 2 - below, n // 2 - below))
    if wanted:
        asked = sorted({i for _, i, _, _ in wanted})
        within = {i: F.col(f"_c{i}").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) & (F.col(f"_lo{i}") < F.col(f"_hi{i}")) for i in asked}
        some = F.lit(False)
        for w in within.values():
            some = some | F.coalesce(w, F.lit(False))
        values = F.array(*[F.when(w, F.struct(F.lit(i).alias("i"), F.col(f"_c{i}").alias("v"))) for i, w in within.items()])
        each = x.where(some).select("fold", F.explode(F.array_compact(values)).alias("_s")).groupBy("fold", F.col("_s.i").alias("i"), F.col("_s.v").alias("v")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("fold", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = each.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(wanted, "fold int, i int, a long, b long")), ["fold", "i"])
        holds = lambda k: F.max(F.when((F.col(k) >= F.col("upto") - F.col("n")) & (F.col(k) < F.col("upto")), F.col("v")))
        found |= {(r.fold, r.i): (r.a, r.b) for r in ranked.groupBy("fold", "i").agg(holds("a").alias("a"), holds("b").alias("b")).collect()}
    out = {}
    for r in near:
        out[r.fold] = []
        for i, c in enumerate(columns):
            if r[f"_n{i}"] and (r.fold, i) not in found:
                found[r.fold, i] = (train.where(F.col("fold") == r.fold).agg(F.median(c)).first()[0],) * 2
            a, b = found.get((r.fold, i), (None, None))
            out[r.fold].append(a if a == b else a * 0.5 + b * 0.5)
    return out


def fold_moments(rows: DataFrame, shifts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each fold the means and the covariance matrix of rows (fold, _v array<double>), from sums of products less a shift near the means.

    Every task adds up one matrix for each fold it has; matrices are then summed line by line. The driver gets one a fold."""
    import pandas as pd
    import pyarrow as pa

    def sums(batches):
        held: dict[int, list] = {}
        for batch in batches:
            folds, v = batch.column("fold").to_numpy(), batch.column("_v").flatten().to_numpy(zero_copy_only=False)  # nulls come as nan
            for fold in np.unique(folds).tolist():
                x = v.reshape(len(folds), -1)[folds == fold] - shifts[fold]
                n, s, xx = held.get(fold, (0, 0.0, 0.0))
                held[fold] = [n + len(x), s + x.sum(0), xx + x.T @ x]
        for fold, (n, s, xx) in held.items():
            lines = {"fold": pa.array([fold] * len(s), pa.int32()), "line": pa.array(range(len(s)), pa.int32()), "n": pa.array([n] * len(s), pa.int64()), "s": pa.array(s), "xx": pa.array(list(xx), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(lines)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(n=pdf["n"].sum(), s=pdf["s"].sum(skipna=False), xx=[sum(np.asarray(m, float) for m in pdf["xx"])])

    kind = "fold int, line int, n long, s double, xx array<double>"
    lines = rows.select("fold", "_v").mapInArrow(sums, kind).groupBy("fold", "line").applyInPandas(add, kind)
    out, got = {}, {}
    for r in lines.collect():
        got.setdefault(r.fold, []).append(r)
    for fold, rs in got.items():
        rs.sort(key=lambda r: r.line)
        n, s = rs[0].n, np.array([r.s for r in rs], float)  # nan may come as null
        cov = np.array([r.xx for r in rs], float) / n - np.outer(s / n, s / n)
        out[fold] = shifts[fold] + s / n, (cov + cov.T) / 2
    return out


def fold_prepare(df: DataFrame, folds: DataFrame, key: str, numbers: list[str], angles: list[str], categories: list[str], least: int = RARE_MIN_ROWS, limit: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped), with all that is learned coming from each fold's train rows alone.

    rows is (fold, key, role, features): every row once for every fold, features a map from a feature's name to its standardised value. Numbers get the median
    where they are null, NaN or infinite, angles become sine and cosine (negative ones are flat: 0, 0), categories get the mode, rare levels merge, and each level but the commonest is a 0/1
    feature. Then constant features go, and the worst by variance inflation until all are within the limit. dropped is (fold, feature, why, vif).

    The folds are joined with df once and stored; all share the jobs that follow: medians, one per category, and one pass that sums products for means and covariances. What reaches
    the driver are the folds' medians and levels and one matrix per fold."""
    spark, plain = df.sparkSession, [*numbers, *angles]
    finite = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double")).alias(c) for c in plain]
    x = stored(folds.select("fold", key, "role").join(df.select(key, *finite, *categories), key).withColumn("fold", F.col("fold").cast("int")), "folds")
    train = x.where("role = 'train'")
    medians = fold_medians(train, plain)
    vocabulary = {c: fold_vocabulary(train, c, least) for c in categories}
    known = sorted(medians)
    kinds = [f"`_m_{c}` double" for c in plain] + [f"`_mode_{c}` string, `_freq_{c}` array<string>" for c in categories]
    words = spark.createDataFrame([(f, *medians[f], *[v for c in categories for v in vocabulary[c][f][:2]]) for f in known], ", ".join(["fold int", *kinds]))
    x = x.join(F.broadcast(words), "fold")  # one row per fold
    merged = {f"_l_{c}": F.when(F.array_contains(f"_freq_{c}", F.coalesce(c, f"_mode_{c}")), F.coalesce(c, f"_mode_{c}")).otherwise(OTHER) for c in categories}
    x = x.withColumns(merged) if merged else x
    features: dict[str, Column] = {}
    for c in numbers:
        features[c] = F.coalesce(c, f"_m_{c}")
    for c in angles:
        features[f"{c}_sin"], features[f"{c}_cos"] = circular(F.coalesce(c, f"_m_{c}"))
    for c in categories:
        for level in sorted({w for f in known for w in vocabulary[c][f][2]}):
            features[f"{c}={level}"] = (F.col(f"_l_{c}") == level).cast("double")
    names = list(features)
    raw = x.select("fold", key, "role", F.array(*[features[n].cast("double") for n in names]).alias("_v"))
    shifts = {f: np.array([m or 0.0 for m in medians[f][: len(numbers)]] + [0.0] * (len(names) - len(numbers))) for f in known}
    learned, dropped = [], []
    for fold, (mean, cov) in sorted(fold_moments(raw.where("role = 'train'"), shifts).items()):
        if empty := [n for n, m in zip(names, mean, strict=True) if np.isnan(m)]:
            raise ValueError(f"no known value in {', '.join(empty)} of fold {fold}")
        columns = {f"{c}={w}" for c in categories for w in vocabulary[c][fold][2]}
        mine = [i for i, n in enumerate(names) if i < len(numbers) + 2 * len(angles) or n in columns]
        varies = [i for i in mine if cov[i, i] > 1e-12]
        dropped += [(fold, names[i], "constant", None) for i in mine if i not in varies]
        sd = np.sqrt(np.diag(cov))
        left, gone = prune_matrix(cov[np.ix_(varies, varies)] / np.outer(sd[varies], sd[varies]), [names[i] for i in varies], limit)
        dropped += [(fold, n, "inflated", f) for n, f in gone]
        at = sorted(names.index(n) for n in left)
        learned.append((fold, [names[i] for i in at], [(i, float(mean[i]), float(sd[i]) or 1.0) for i in at]))
    fitted = spark.createDataFrame(learned, "fold int, _kept array<string>, _scale array<struct<i: int, m: double, s: double>>")
    told = F.map_from_arrays("_kept", F.transform("_scale", lambda p: (F.get("_v", p["i"]) - p["m"]) / p["s"]))
    rows = raw.join(F.broadcast(fitted), "fold").select("fold", key, "role", told.alias("features"))
    return rows, spark.createDataFrame(dropped, "fold int, feature string, why string, vif double")


def fold_smote(rows: DataFrame, key: str, labels: DataFrame, label: str, minority: int, fold: int, k: int = 5) -> DataFrame:
    """(id, v, label): a fold's prepared train rows, balanced by synthetic minority rows. Test rows never enter. v goes by the features' names."""
    train = rows.where((F.col("fold") == fold) & (F.col("role") == "train"))
    v = F.transform(F.array_sort(F.map_keys("features")), lambda n: F.element_at("features", n))
    return smote(cut(train.join(labels.select(key, label), key).select(F.col(key).cast("long").alias("id"), v.alias("v"), label)), label, minority, k)


def bisect_intercept(df: DataFrame, logit: Column, share: float, steps: int = 6, grid: int = 32) -> float:
    """The number to add to a logit for a wanted mean probability. Each job tries a grid of them."""
    lo, hi = -50.0, 50.0
    for _ in range(steps):
        at = [lo + (hi - lo) * k / grid for k in range(grid + 1)]
        r = df.agg(*[F.avg(1.0 / (1.0 + F.exp(-(logit + F.lit(a))))).alias(f"a{k}") for k, a in enumerate(at)]).first()
        k = max((i for i in range(grid + 1) if r[f"a{i}"] <= share), default=0)
        lo, hi = at[k], at[min(k + 1, grid)]
    return (lo + hi) / 2
