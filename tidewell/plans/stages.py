"""Stages: registry, wrapper, embedding and clustering runs, label generation rounds."""

from __future__ import annotations

import contextlib
import logging
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import predicates as P
from tidewell.operators import clusters, relational
from tidewell.plans.ledger import DEPENDENCIES, topological

log = logging.getLogger("tidewell")


@dataclass
class Stages:
    """Stages by name; run() goes through them with what they read from first."""

    steps: dict[str, Callable[[], object]] = field(default_factory=dict)

    def add(self, name: str, step: Callable[[], object]) -> None:
        self.steps[name] = step

    def order(self) -> list[str]:
        return [n for n in topological(DEPENDENCIES | {n: DEPENDENCIES.get(n, ()) for n in self.steps}) if n in self.steps]

    def run(self) -> dict[str, object]:
        out = {}
        for name in self.order():
            with stage(name):
                out[name] = self.steps[name]()
        return out


@contextlib.contextmanager
def stage(name: str) -> Iterator[None]:
    """Logs begin, end and failure; a failure ends the run."""
    began = time.monotonic()
    log.info("%s begins", name)
    try:
        yield
    except Exception:
        log.exception("%s failed after %.1f s", name, time.monotonic() - began)
        raise
    log.info("%s took %.1f s", name, time.monotonic() - began)


@contextlib.contextmanager
def item(name: str, failures: list[tuple[str, str]]) -> Iterator[None]:
    """One item of a stage: its failure is recorded, and the stage goes on."""
    try:
        yield
    except Exception as error:
        failures.append((name, str(error)))
        log.warning("%s failed: %s", name, error)


def retried(call: Callable[[], object], attempts: int = 3, delay: float = 1.0, jitter: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after a fixed delay with jitter; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(delay + random.uniform(0, jitter))
    raise ValueError("attempts must be positive")


def exposed(cases: dict[str, bool], known: list[str]) -> list[str]:
    """Known cases that are shown."""
    return [c for c in known if cases.get(c)]


def embedding_candidates(clips: DataFrame, users: DataFrame) -> DataFrame:
    """Analysed clips of eligible accounts."""
    return clips.where(P.used_in_analysis()).join(users.where(P.is_true("is_eligible")).select(F.col("id").alias("user_id")), "user_id", "left_semi")


def dependency_evidence(wanted: DataFrame, labels: DataFrame, case: str) -> DataFrame:
    """wanted (clip_id) with the other case's payload where it succeeded, and evidence: ready, terminal or pending."""
    other = labels.where(F.col("label_case") == case).select("clip_id", "status", "payload")
    state = F.when(F.col("status") == "success", "ready").when(F.col("status") == "failed", "terminal").otherwise("pending")
    return wanted.join(other, "clip_id", "left").withColumn("evidence", state).withColumn("payload", F.when(F.col("evidence") == "ready", F.col("payload"))).drop("status")


def generation_rounds(state: DataFrame, key: str, generate: Callable[[DataFrame, int], DataFrame], max_attempts: int, base_seed: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state (key, status, attempts, error) after rounds until each row has succeeded or failed for good.

    generate(rows, seed column included, round) gives key and outcome. cut writes a round's state and reads it again.
    """
    state = cut(state)
    for number in range(max_attempts):
        todo = state.where(P.label_selected(max_attempts) & (F.coalesce("status", F.lit("pending")) != "failed"))
        if not todo.limit(1).count():
            break
        made = generate(todo.withColumn("seed", F.lit(base_seed) + F.coalesce("attempts", F.lit(0))), number)
        state = cut(relational.retried(state.join(made.select(key, "outcome"), key, "left"), "outcome", max_attempts).select(state.columns))
    return state


def assign(matrix: DataFrame, key: str, vector: str, min_cluster_size: int, leaf: bool = False, max_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(key, cluster_id, centrality) of a champion's parameters fitted again, and its cluster metrics.

    The matrix of one case goes to every task; blocks of it are compared in parallel.
    """
    import pandas as pd

    keys, _, _, ((found, strength),) = clusters.fitted(matrix, key, vector, [(min_cluster_size, leaf)], max_share)
    rows = pd.DataFrame({key: keys, "cluster_id": found.astype("int64"), "centrality": strength})
    members = matrix.sparkSession.createDataFrame(rows, f"{key} long, cluster_id long, centrality double")
    return members, clusters.cluster_metrics(members)


def validated(runs: DataFrame, numeric: list[str], other: list[str], limits: tuple[float, int, int, float]) -> DataFrame:
    """Runs that pass the filter, with their plateau among those that pass."""
    passing = runs.where(P.passes_filter(*limits))
    return passing.join(clusters.plateau(passing, numeric, other), "run_id")


def layout_case(members: DataFrame, case: str, folder: str) -> None:
    """Writes a case's accounts and clusters; other cases in the folder stay."""
    from tidewell.operators import profiles

    users, shapes = profiles.layout(members)
    for name, rows in (("users", users), ("clusters", shapes)):
        relational.overwrite_scope(rows.withColumn("embedding_case", F.lit(case)), f"{folder}/{name}", ["embedding_case"])
