"""Cluster tables: neighbours, sizes, parameter search, density clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Centroids that are sent to every row as one array; of more, each row meets blocks of about so many.
MOST_CENTROIDS = 10_000


def nearest(frame: DataFrame, centroids: DataFrame, own: Column, x: Column, y: Column, k: int, most: int = MOST_CENTROIDS) -> DataFrame:
    """frame with nearest_id, distance, rk: the k nearest centroids (id, x, y) other than ``own``, by distance, then id.

    Every block of centroids gives a row its k nearest ones, and the blocks' results, k each, are merged.
    """
    blocks = max(1, -(-centroids.count() // most))
    packed = centroids.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("_centroids"))
    far = lambda c: F.struct(F.hypot(c["x"] - x, c["y"] - y).alias("distance"), c["id"].alias("nearest_id"))
    ranked = F.slice(F.array_sort(F.transform(F.filter("_centroids", lambda c: c["id"] != own), far)), 1, k)
    if blocks == 1:
        rows = frame.crossJoin(F.broadcast(packed)).select(*frame.columns, ranked.alias("_ranked"))
    else:
        numbered = frame.withColumn("_row", F.monotonically_increasing_id())
        met = numbered.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(packed, "_block")
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k)
        rows = met.select("_row", F.struct(*frame.columns).alias("_frame"), ranked.alias("_near")).groupBy("_row").agg(F.any_value("_frame").alias("_frame"), merged.alias("_ranked")).select("_frame.*", "_ranked")
    rows = rows.select(*frame.columns, F.posexplode("_ranked").alias("_p", "_n"))
    return rows.select(*frame.columns, "_n.nearest_id", "_n.distance", (F.col("_p") + 1).cast("long").alias("rk"))


def containing(frame: DataFrame, ellipses: DataFrame, x: str, y: str) -> DataFrame:
    """frame with cluster_id of the smallest ellipse (cluster_id, cx, cy, rx, ry, angle) around each point; others have no row.

    An ellipse lies in a grid whose cells are as wide as its diameter, rounded up to a power of two, so points meet only
    ellipses of their own cells, one cell for each width there is. Repeated points keep a row each.
    """
    from tidewell.functions.geometry import in_ellipse

    sized = ellipses.withColumn("_level", F.ceil(F.log2(F.greatest(2 * F.col("rx"), 2 * F.col("ry"), F.lit(1e-6)))).cast("int"))
    levels = [row[0] for row in sized.where("_level IS NOT NULL").select("_level").distinct().collect()]
    cell = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level)).cast("long")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = sized.withColumn("_gx", F.explode(F.transform(steps, lambda i: cell(F.col("cx"), F.col("_level")) + i)))
    spread = spread.withColumn("_gy", F.explode(F.transform(steps, lambda i: cell(F.col("cy"), F.col("_level")) + i)))
    rows = frame.withColumn("_row", F.monotonically_increasing_id()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    rows = rows.withColumns({"_gx": cell(F.col(x), F.col("_level")), "_gy": cell(F.col(y), F.col("_level"))})
    hit = rows.join(spread, ["_level", "_gx", "_gy"]).where(in_ellipse(F.col(x), F.col(y), F.col("cx"), F.col("cy"), F.col("rx"), F.col("ry"), F.col("angle")))
    best = F.min(F.struct((F.col("rx") * F.col("ry")).alias("area"), "cluster_id")).alias("_best")
    found = hit.groupBy("_row").agg(F.any_value(F.struct(*frame.columns)).alias("_frame"), best)
    return found.select("_frame.*", "_best.cluster_id")


def nearest_within(probes: DataFrame, dots: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """key, nearest_id: the nearest other dot within a radius; of equally near ones, to nine places, the later. Dots meet by grid cells."""
    cell = lambda c: F.floor(c / radius).cast("long")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = probes.select(F.col(key).alias("pk"), F.col(x).alias("px"), F.col(y).alias("py"))
    p = p.withColumn("gx", F.explode(F.transform(steps, lambda i: cell(F.col("px")) + i))).withColumn("gy", F.explode(F.transform(steps, lambda i: cell(F.col("py")) + i)))
    d = dots.select(F.col(key).alias("dk"), F.col(x).alias("dx"), F.col(y).alias("dy"), cell(F.col(x)).alias("gx"), cell(F.col(y)).alias("gy"))
    square = F.pow(F.col("px") - F.col("dx"), F.lit(2)) + F.pow(F.col("py") - F.col("dy"), F.lit(2))
    near = p.join(d, ["gx", "gy"]).where(F.col("pk") != F.col("dk")).withColumn("d2", square).where(F.col("d2") <= radius * radius + 1e-9)
    return near.groupBy("pk").agg(F.min(F.struct(F.round("d2", 9).alias("d2"), (-F.col("dk")).alias("dk"))).alias("b")).select(F.col("pk").alias(key), (-F.col("b.dk")).alias("nearest_id"))


def cluster_metrics(members: DataFrame, high: float = 0.8) -> DataFrame:
    """cluster_id, n_users, mean_centrality, high_conf_fraction of clusters; noise is left out."""
    c = F.coalesce("centrality", F.lit(0.0))
    return members.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n_users"), F.avg(c).alias("mean_centrality"), F.avg((c > high).cast("double")).alias("high_conf_fraction"))


def size_stats(members: DataFrame) -> DataFrame:
    """One row: n_clusters, noise_ratio, min_size, median_size (rounded down), max_size."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    own = F.when(F.col("cluster_id") >= 0, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster_id") < 0, F.col("n"))), F.lit(0))
    return sizes.agg(F.count(own).alias("n_clusters"), (noise / F.sum("n")).alias("noise_ratio"), F.min(own).alias("min_size"), F.floor(F.median(own)).cast("long").alias("median_size"), F.max(own).alias("max_size"))


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """run_id and a column for each axis: every combination, numbered in the axes' order."""
    total = 1
    for values in axes.values():
        total *= len(values)
    rows = spark.range(total).withColumnRenamed("id", "run_id")
    step = total
    for name, values in axes.items():
        step //= len(values)
        place = F.floor(F.col("run_id") / step) % len(values)
        rows = rows.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int")))
    return rows


def plateau(runs: DataFrame, numeric: list[str], other: list[str], score: str = "dbcv") -> DataFrame:
    """run_id, plateau: the mean score of runs that differ in one parameter only, numeric ones by one step; own score without any.

    For each parameter, runs that agree on all others meet by equality; neighbours are one step away in rank order.
    """
    ranked = runs.withColumns({f"_r_{c}": F.dense_rank().over(Window.orderBy(c)) for c in numeric})
    names = numeric + other
    found = None
    for c in names:
        rest = [n for n in names if n != c]
        w = ranked.select("run_id", score, *rest, (F.col(f"_r_{c}") if c in numeric else F.col(c)).alias("_at"))
        a, b = w.alias("a"), w.alias("b")
        same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in rest]
        apart = (F.abs(F.col("a._at") - F.col("b._at")) == 1) if c in numeric else ~F.col("a._at").eqNullSafe(F.col("b._at"))
        on = apart
        for s in same:
            on = on & s
        part = a.join(b, on).select(F.col("a.run_id").alias("run_id"), F.col(f"b.{score}").alias("s"))
        found = part if found is None else found.unionAll(part)
    means = found.groupBy("run_id").agg(F.avg("s").alias("_m"))
    return runs.join(means, "run_id", "left").select("run_id", F.coalesce("_m", score).alias("plateau"))


def champion(runs: DataFrame, tolerance: float) -> DataFrame:
    """The run of the highest dbcv among those not far above their plateau, or among all if none is left."""
    steady = (F.col("dbcv") - F.col("plateau") <= tolerance).cast("int")
    return runs.where("dbcv IS NOT NULL").orderBy(F.desc(F.coalesce(steady, F.lit(0))), F.desc("dbcv"), F.asc("run_id")).limit(1)


def run_summary(runs: DataFrame) -> DataFrame:
    """n_runs, n_filtered, and mean, sample deviation and median of finite scores."""
    finite = F.when(~F.isnan("dbcv") & (F.abs("dbcv") != float("inf")), F.col("dbcv"))
    return runs.agg(F.count("*").alias("n_runs"), F.count_if(F.col("passes")).alias("n_filtered"), F.avg(finite).alias("dbcv_mean"), F.stddev_samp(finite).alias("dbcv_std"), F.median("n_clusters").alias("k_median"))


def reduce_dimensions(frame: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, reduced: principal components; stands in where no manifold method is installed."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = frame.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_r").fit(rows).transform(rows).select(key, vector_to_array("_r").alias("reduced"))


#: Distances that are held at once.
BLOCK = 1 << 22


def distances(x, rows, others=None):
    """Euclidean distances from the points x[rows] to x[others], or to all."""
    import numpy as np

    left, right = x[rows], x if others is None else x[others]
    return np.sqrt(np.maximum((left**2).sum(1)[:, None] + (right**2).sum(1)[None] - 2 * left @ right.T, 0))


def blocks(ids, width: int):
    """ids in parts whose distances to ``width`` points are few enough to hold."""
    size = max(1, BLOCK // max(1, width))
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def squares(x, rows, others):
    """Squared Euclidean distances from x[rows] to x[others]."""
    import numpy as np

    left, right = x[rows], x[others]
    d = left @ right.T
    d *= -2
    d += (left**2).sum(1)[:, None]
    d += (right**2).sum(1)
    return np.maximum(d, 0, out=d)


def nearest_squares(x, rows, ranks: list[int]):
    """Squared distances from each of x[rows] to its neighbours of these ranks; itself has rank 0."""
    import numpy as np

    every = np.arange(len(x))
    parts = [np.partition(squares(x, part, every), ranks, axis=1)[:, ranks].copy() for part in blocks(rows, len(x))]
    return np.concatenate([np.zeros((0, len(ranks))), *parts])


def spanned(x, core, rows):
    """(squared weight, end, end): a minimum spanning tree of x[rows] by mutual reachability; core: squared core distances of x."""
    import numpy as np

    n = len(rows)
    own, mine, every = x[rows], core[rows], np.arange(len(rows))
    held = None
    if n * n <= 4 * BLOCK:  # else one row at a time
        held = squares(own, every, every)
        np.maximum(held, mine[:, None], out=held)
        np.maximum(held, mine, out=held)
    alive, best, link, at = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, np.int64), 0
    weights, ends, starts = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1), np.int64), np.zeros(max(0, n - 1), np.int64)
    for k in range(n - 1):
        alive[at], best[at] = False, np.inf
        reach = held[at] if held is not None else np.maximum(squares(own, [at], every)[0], np.maximum(mine[at], mine))
        nearer = (reach < best) & alive
        np.copyto(best, reach, where=nearer)
        link[nearer] = at
        at = int(best.argmin())
        if not alive[at]:  # all that are left are infinitely far
            at = int(alive.argmax())
        weights[k], starts[k], ends[k] = best[at], link[at], at
    return weights, rows[np.minimum(starts, ends)], rows[np.maximum(starts, ends)]


def thinned(weights, a, b):
    """Those of the edges that are in their minimum spanning forest, in order."""
    import numpy as np

    order = np.lexsort((b, a, weights))
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist()
    parent, kept = list(range(len(names))), []
    for k, (i, j) in enumerate(zip(one, two, strict=True)):
        i, j = find_root(parent, i), find_root(parent, j)
        if i != j:
            parent[j] = i
            kept.append(k)
            if len(kept) == len(names) - 1:
                break
    kept = order[np.array(kept, np.int64)]
    return weights[kept], a[kept], b[kept]


def density_labels(points, min_cluster_size: int, min_samples: int | None = None, leaf: bool = False, max_share: float = 0.0, tree=None):
    """(labels, probabilities) of a matrix by hierarchical density clustering on Euclidean distance; -1 is noise.

    Mutual reachability gives a minimum spanning tree, its edges in order a hierarchy, from which splits into parts of
    ``min_cluster_size`` at least are kept, and of those the most stable ones, or the leaves. ``tree``: spanned() of the
    points, if it is known.
    """
    import numpy as np

    x = np.asarray(points, float)
    n = len(x)
    if n < max(2, min_cluster_size):
        raise ValueError("fewer points than a cluster needs")
    if tree is None:
        nth = min(n - 1, min_samples or min_cluster_size)
        tree = spanned(x, nearest_squares(x, np.arange(n), [nth])[:, 0], np.arange(n))
    edges = list(zip(np.sqrt(tree[0]).tolist(), tree[1].tolist(), tree[2].tolist(), strict=True))
    edges.sort()
    parent, node, size, children = list(range(n)), list(range(n)), [1] * n, {}
    find = lambda a: a if parent[a] == a else find_root(parent, a)
    for k, (w, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        children[n + k] = (node[a], node[b], w)
        size.append(size[node[a]] + size[node[b]])
        parent[b] = a
        node[a] = n + k
    top = n + len(edges) - 1

    def leaves(c: int) -> list[int]:
        out, todo = [], [c]
        while todo:
            c = todo.pop()
            if c < n:
                out.append(c)
            else:
                todo += children[c][:2]
        return out

    # condensed clusters: (birth, stability, kids, points with the level at which they leave)
    clusters: list[dict] = []
    todo = [(top, 0.0, -1)]
    while todo:
        c, birth, mother = todo.pop()
        one = {"birth": birth, "mother": mother, "kids": [], "left": {}, "n": size[c]}
        clusters.append(one)
        me = len(clusters) - 1
        if mother >= 0:
            clusters[mother]["kids"].append(me)
        while c >= n:
            a, b, w = children[c]
            level = 1 / w if w > 0 else 1e12
            big = [s for s in (a, b) if size[s] >= min_cluster_size]
            if len(big) == 2:
                for s in (a, b):
                    one["left"].update(dict.fromkeys(leaves(s), level))
                    todo.append((s, level, me))
                break
            small = [s for s in (a, b) if size[s] < min_cluster_size]
            for s in small:
                one["left"].update(dict.fromkeys(leaves(s), level))
            if not big:
                break
            c = big[0]
    worth = [sum(level - c["birth"] for level in c["left"].values()) for c in clusters]
    chosen = [False] * len(clusters)
    most = round(max_share * n) if max_share else n + 1
    for k in range(len(clusters) - 1, 0, -1):
        below = sum(worth[j] for j in clusters[k]["kids"])
        if leaf:
            chosen[k] = not clusters[k]["kids"]
        elif not clusters[k]["kids"] or (worth[k] >= below and clusters[k]["n"] <= most):
            chosen[k] = True
        else:
            worth[k] = below
    labels, strength = np.full(n, -1), np.zeros(n)
    number = 0
    todo_k = list(clusters[0]["kids"])
    while todo_k:
        k = todo_k.pop(0)
        if not chosen[k]:
            todo_k += clusters[k]["kids"]
            continue
        levels, inner = {}, [k]
        while inner:
            j = inner.pop()
            for p, level in clusters[j]["left"].items():
                levels[p] = max(levels.get(p, 0.0), level)
            inner += clusters[j]["kids"]
        peak = max(levels.values())
        for p, level in levels.items():
            labels[p], strength[p] = number, min(1.0, level / peak)
        number += 1
    return labels, strength


def find_root(parent: list[int], a: int) -> int:
    """The representative of a, with the path to it shortened."""
    root = a
    while parent[root] != root:
        root = parent[root]
    while parent[a] != root:
        parent[a], a = root, parent[a]
    return root


#: Points of a block whose spanning trees with each other block are found, and blocks of which a task takes the pairs.
SPAN, SIDE = 2048, 4


def gathered(matrix: DataFrame, key: str, vector: str):
    """(keys, points) of one case in the keys' order."""
    import numpy as np

    rows = matrix.select(key, vector).toArrow().combine_chunks()
    keys = rows[key].to_numpy()
    points = rows[vector].combine_chunks().flatten().to_numpy().astype(float).reshape(len(keys), -1)
    order = np.argsort(keys, kind="stable")
    return keys[order], points[order]


def in_tasks(spark: SparkSession, works: list, function, schema: str):
    """The Arrow table of function(work)'s pandas frames, each in a task of its own."""

    def run(frames):
        for frame in frames:
            for i in frame["id"]:
                yield function(works[i])

    return spark.range(0, len(works), 1, max(1, len(works))).mapInPandas(run, schema).toArrow()


def trees(spark: SparkSession, shared, n: int, ranks: list[int]) -> dict:
    """By rank: a minimum spanning tree of ``shared`` points (a broadcast) by mutual reachability, core distances to that neighbour.

    An edge of the whole tree is in the tree of any part that holds its ends. So tasks find trees of pairs of blocks,
    and the tree of their edges is the whole one.
    """
    import numpy as np
    import pandas as pd

    def cores(ids) -> pd.DataFrame:
        found = nearest_squares(shared.value, np.arange(*ids), ranks)
        return pd.DataFrame({"id": np.arange(*ids), **{f"c{k}": found[:, k] for k in range(len(ranks))}})

    cuts = np.linspace(0, n, max(1, min(n, n // 1024, 96)) + 1).astype(int)
    rows = in_tasks(spark, list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)), cores, "id long, " + ", ".join(f"c{k} double" for k in range(len(ranks))))
    order = np.argsort(rows["id"].to_numpy())
    core = spark.sparkContext.broadcast({r: rows[f"c{k}"].to_numpy()[order] for k, r in enumerate(ranks)})
    parts = np.array_split(np.arange(n), -(-n // SPAN))
    sides = [parts[i : i + SIDE] for i in range(0, len(parts), SIDE)]
    works = [(r, i, j) for r in ranks for i in range(len(sides)) for j in range(i, len(sides))]

    def edges(work) -> pd.DataFrame:
        r, i, j = work
        if i == j:
            pairs = [(a, b) for k, a in enumerate(sides[i]) for b in sides[i][k + 1 :]] or [(sides[i][0], sides[i][0][:0])]
        else:
            pairs = [(a, b) for a in sides[i] for b in sides[j]]
        found = [spanned(shared.value, core.value[r], np.concatenate(pair)) for pair in pairs]
        weights, a, b = thinned(*map(np.concatenate, zip(*found, strict=True)))
        return pd.DataFrame({"rank": r, "w": weights, "a": a, "b": b})

    table = in_tasks(spark, works, edges, "rank long, w double, a long, b long")
    of = table["rank"].to_numpy()
    return {r: thinned(*[table[c].to_numpy()[of == r] for c in ("w", "a", "b")]) for r in ranks}


def fitted(matrix: DataFrame, key: str, vector: str, runs: list[tuple[int, bool]], max_share: float = 0.0):
    """(keys, points, broadcast points, for each run (min_cluster_size, leaf) its labels and probabilities, or None if it fails)."""
    import numpy as np
    import pandas as pd

    spark = matrix.sparkSession
    keys, points = gathered(matrix, key, vector)
    n = len(keys)
    shared = spark.sparkContext.broadcast(points)
    ranks = sorted({min(n - 1, size) for size, _ in runs if n >= max(2, size)})
    tree = spark.sparkContext.broadcast(trees(spark, shared, n, ranks) if ranks else {})
    works = [(k, size, leaf) for k, (size, leaf) in enumerate(runs) if n >= max(2, size)]

    def labels(work) -> pd.DataFrame:
        k, size, leaf = work
        found, strength = density_labels(shared.value, size, leaf=leaf, max_share=max_share, tree=tree.value[min(n - 1, size)])
        return pd.DataFrame({"run": k, "id": np.arange(n), "label": found, "strength": strength})

    table = in_tasks(spark, works, labels, "run int, id int, label int, strength double") if works else None
    out: list = [None] * len(runs)
    for k, _, _ in works:
        rows = table.filter(np.equal(table["run"].to_numpy(), k))
        order = np.argsort(rows["id"].to_numpy())
        out[k] = rows["label"].to_numpy()[order], rows["strength"].to_numpy()[order]
    return keys, points, shared, out


def search(matrix: DataFrame, key: str, vector: str, runs: DataFrame) -> DataFrame:
    """Sizes, noise and validity for each run (run_id, min_cluster_size, leaf): combinations are fitted in parallel.

    The matrix of one case goes to every task; a fit that fails is skipped, as its run has no row.
    """
    import numpy as np

    spark = matrix.sparkSession
    wanted = runs.select("run_id", "min_cluster_size", "leaf").collect()
    _, _, shared, found = fitted(matrix, key, vector, [(int(r["min_cluster_size"]), bool(r["leaf"])) for r in wanted])
    out = []
    for r, one in zip(wanted, found, strict=True):
        if one is not None:
            labels = one[0]
            sizes = sorted(np.bincount(labels[labels >= 0]).tolist()) or [0]
            out.append((r["run_id"], int(labels.max()) + 1, float((labels < 0).mean()), sizes[0], int(np.median(sizes)), sizes[-1], validity_in_tasks(spark, shared, labels)))
    return spark.createDataFrame(out, "run_id long, n_clusters long, noise_ratio double, min_size long, median_size long, max_size long, dbcv double")


def validity_in_tasks(spark: SparkSession, shared, labels) -> float:
    """validity() of ``shared`` points (a broadcast), in tasks that hold some rows' distances each."""
    import numpy as np
    import pandas as pd

    ids, sizes = np.unique(labels[labels >= 0], return_counts=True)
    ids = ids[sizes > 1]
    if len(ids) < 2:
        return 0.0
    order = np.flatnonzero(np.isin(labels, ids))
    order = order[np.argsort(labels[order], kind="stable")]
    starts = np.searchsorted(labels[order], ids)
    stops = np.append(starts[1:], len(order))
    of = spark.sparkContext.broadcast(order)
    cuts = np.linspace(0, len(order), max(1, min(len(order) // 512, 96)) + 1).astype(int).tolist()
    chunks = list(zip(cuts, cuts[1:], strict=False))

    def segments(lo: int, hi: int):
        """(first, last, cluster's first, cluster's last) of each cluster's rows within [lo, hi)."""
        for k in range(int(np.searchsorted(stops, lo, "right")), len(ids)):
            if starts[k] >= hi:
                break
            yield max(lo, int(starts[k])), min(hi, int(stops[k])), int(starts[k]), int(stops[k])

    def cores(work) -> pd.DataFrame:
        x, values = shared.value[of.value], []
        power = x.shape[1]
        for a, b, first, last in segments(*work):
            own = np.arange(first, last)
            for rows in blocks(np.arange(a, b), len(own)):
                near = squares(x, rows, own)
                near[np.arange(len(rows)), rows - first] = np.inf
                values.append((np.power(np.maximum(near, 1e-24), -power / 2).sum(1) / (len(own) - 1)) ** (-2.0 / power))
        return pd.DataFrame({"id": np.arange(*work), "core": np.concatenate(values)})

    table = in_tasks(spark, chunks, cores, "id long, core double")
    core = spark.sparkContext.broadcast(table["core"].to_numpy()[np.argsort(table["id"].to_numpy())])

    def apart(work) -> pd.DataFrame:
        x, least = shared.value[of.value], np.full(work[1] - work[0], np.inf)
        for rows in blocks(np.arange(*work), len(x)):
            reach = squares(x, rows, np.arange(len(x)))
            np.maximum(reach, core.value[rows][:, None], out=reach)
            np.maximum(reach, core.value, out=reach)
            for a, b, first, last in segments(int(rows[0]), int(rows[-1]) + 1):
                reach[a - rows[0] : b - rows[0], first:last] = np.inf
            least[rows - work[0]] = reach.min(1)
        return pd.DataFrame({"id": np.arange(*work), "least": least})

    table = in_tasks(spark, chunks, apart, "id long, least double")
    separation = np.sqrt(np.minimum.reduceat(table["least"].to_numpy()[np.argsort(table["id"].to_numpy())], starts))
    works, many, load = [], [], 0
    for k in range(len(ids)):
        parts = np.array_split(np.arange(starts[k], stops[k]), -(-(stops[k] - starts[k]) // SPAN))
        if len(parts) > 1:
            works += [[(k, np.concatenate((parts[i], parts[j])))] for i in range(len(parts)) for j in range(i)]
            continue
        many.append((k, parts[0]))
        load += len(parts[0])
        if load >= SPAN:
            works.append(many)
            many, load = [], 0
    works += [many] if many else []

    def widest(work) -> pd.DataFrame:
        x = shared.value[of.value]
        found = [(k, *spanned(x, core.value, rows)) for k, rows in work]
        return pd.concat([pd.DataFrame({"k": k, "w": w, "a": a, "b": b}) for k, w, a, b in found])

    table = in_tasks(spark, works, widest, "k long, w double, a long, b long")
    weights, a, b = thinned(*[table[c].to_numpy() for c in ("w", "a", "b")])
    sparse = np.zeros(len(ids))
    np.maximum.at(sparse, np.searchsorted(stops, a, "right"), np.sqrt(weights))
    return float((((stops - starts) / len(labels)) * (separation - sparse) / np.maximum(np.maximum(separation, sparse), 1e-12)).sum())


def validity(points, labels) -> float:
    """Density-based validity: sparseness inside clusters against separation between them, weighted by size."""
    import numpy as np

    x, n = np.asarray(points, float), len(points)
    ids = [c for c in np.unique(labels) if c >= 0 and (labels == c).sum() > 1]
    if len(ids) < 2:
        return 0.0
    core = np.zeros(n)
    for c in ids:
        own = np.flatnonzero(labels == c)
        for rows in blocks(own, len(own)):
            near = distances(x, rows, own)
            near[rows[:, None] == own[None]] = np.inf
            core[rows] = (np.power(np.maximum(near, 1e-12), -float(x.shape[1])).sum(1) / (len(own) - 1)) ** (-1.0 / x.shape[1])
    total = 0.0
    for c in ids:
        own = np.flatnonzero(labels == c)
        best, done, at, sparse = np.full(len(own), np.inf), np.zeros(len(own), bool), 0, 0.0
        for _ in range(len(own) - 1):
            done[at] = True
            reach = np.maximum(distances(x, own[[at]], own)[0], np.maximum(core[own[at]], core[own]))
            best = np.where(done, np.inf, np.minimum(best, reach))
            at = int(best.argmin())
            sparse = max(sparse, best[at])
        rest = np.flatnonzero(np.isin(labels, ids) & (labels != c))
        apart = min(np.maximum(distances(x, rows, rest), np.maximum(core[rows][:, None], core[rest][None])).min() for rows in blocks(own, len(rest)))
        total += len(own) / n * (apart - sparse) / max(apart, sparse, 1e-12)
    return float(total)
