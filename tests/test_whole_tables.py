"""Clustering queries cover whole tables, in memory that does not grow with the square of the rows."""

import tracemalloc

import numpy as np

from tests.conftest import SF
from tidewell.operators import clusters, vectors
from tidewell.plans import catalogue


def test_cluster_queries_use_every_vector(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i) + 5000, [float(v) for v in rng.normal(0, 0.1, 64) + 5 * (np.arange(64) == 40 + i % 2)]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r["vec_id"]: r["cluster_id"] for r in catalogue.cluster_assignment(spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(5000, 5120))
    assert {len({found[i] for i in found if i % 2 == side and found[i] >= 0}) for side in (0, 1)} == {1}
    assert {r["n_clusters"] for r in catalogue.hdbscan_search(spark, str(tmp_path)).collect()} >= {2}
    every = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert catalogue.cluster_assignment(spark, SF).count() == every


def test_density_clustering_holds_no_matrix(monkeypatch):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.2, (700, 4)) for c in (0, 3, 6)])
    whole = clusters.density_labels(points, 15)[0]
    value = clusters.validity(points, whole)
    monkeypatch.setattr(clusters, "BLOCK", 10_000)
    tracemalloc.start()
    assert (clusters.density_labels(points, 15)[0] == whole).all()
    assert abs(clusters.validity(points, whole) - value) < 1e-9
    assert tracemalloc.get_traced_memory()[1] < len(points) ** 2 * 8 / 2


def test_trees_and_validity_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(c, 0.2 + c / 20, (n, 4)) for c, n in ((0, 130), (3, 90), (6, 60))] + [rng.uniform(-2, 8, (40, 4))])
    monkeypatch.setattr(clusters, "SPAN", 32)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    keys, _, shared, ((labels, strength),) = clusters.fitted(frame, "id", "v", [(10, False)])
    whole, expected = clusters.density_labels(points, 10)
    assert keys.tolist() == list(range(len(points))) and len(set(whole)) > 2
    assert (labels == whole).all() and np.allclose(strength, expected)
    assert abs(clusters.validity_in_tasks(spark, shared, labels) - clusters.validity(points, whole)) < 1e-9
    assert clusters.fitted(frame.limit(5), "id", "v", [(10, False)])[3] == [None]


def test_silhouette_sums_hold_a_few_rows_of_distances(monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (1500, 8)), rng.normal(0, 1, (1500, 8))
    keys, labels = np.arange(1500), rng.integers(0, 3, 1500)
    monkeypatch.setattr(vectors, "HELD", 30_000)
    tracemalloc.start()
    names, sizes, totals = vectors.sums_by_label(x, y, keys, keys, labels)
    assert tracemalloc.get_traced_memory()[1] < 1500**2 * 8 / 4
    tracemalloc.stop()
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(d, 0)
    assert names.tolist() == [0, 1, 2] and sizes.tolist() == np.bincount(labels).tolist()
    assert np.allclose(totals, np.stack([d[:, labels == k].sum(1) for k in range(3)], 1))
