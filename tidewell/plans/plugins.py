"""Plug points for models: providers run in Arrow batches, once loaded for each worker, and fall back to single rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


class HashProvider:
    """A stand-in without a model: a unit vector from a text's digest."""

    def __init__(self, dimensions: int = 16):
        self.dimensions = dimensions

    def embed(self, payload: str) -> list[float]:
        raw = hashlib.sha256(payload.encode()).digest() * (1 + self.dimensions // 32)
        vector = [b / 127.5 - 1 for b in raw[: self.dimensions]]
        norm = sum(v * v for v in vector) ** 0.5 or 1.0
        return [v / norm for v in vector]

    def embed_batch(self, payloads: list[str]) -> list[list[float]]:
        return [self.embed(p) for p in payloads]


@dataclass(frozen=True)
class EmbeddingCase:
    """What a case embeds: the text's Column, the provider's factory, and the columns whose change makes a row stale."""

    name: str
    text: Callable[[], Column]
    provider: Callable[[], object]
    depends_on: tuple[str, ...]
    recipe: str = "1"

    def recipe_digest(self) -> str:
        return hashlib.sha256("|".join((f"name={self.name}", f"recipe={self.recipe}", f"columns={','.join(self.depends_on)}")).encode()).hexdigest()


def enabled_cases(cases: dict[str, tuple[EmbeddingCase, tuple[str, ...]]], settings: dict[str, bool]) -> list[str]:
    """Names of the cases all of whose required settings are on."""
    return [name for name, (_, requires) in cases.items() if all(settings.get(r) for r in requires)]


def embedded(rows: DataFrame, key: str, text: str, factory: Callable[[], object], batch: int = 64) -> DataFrame:
    """key, embedding, error. A batch that fails is tried row by row; a row that fails carries its error."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        provider = factory()
        for frame in frames:
            out = []
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    out += [(k, v, None) for k, v in zip(part[key], provider.embed_batch(part[text].tolist()), strict=True)]
                except Exception:
                    for k, payload in zip(part[key], part[text], strict=True):
                        try:
                            out.append((k, provider.embed(payload), None))
                        except Exception as error:
                            out.append((k, None, str(error)[:500]))
            yield pd.DataFrame(out, columns=[key, "embedding", "error"])

    return rows.select(key, text).mapInPandas(run, f"{key} long, embedding array<float>, error string")


def translated(rows: DataFrame, key: str, source: str, lang: str, factory: Callable[[], object], max_chars: int = 1000, batch: int = 16) -> DataFrame:
    """key, translation: of trimmed, cut texts in another language; an empty result is null.

    factory() gives an object with translate(texts, langs). Texts of a batch are of similar length.
    """
    from pyspark.sql import functions as F

    from tidewell.functions.predicates import blank, english

    wanted = rows.where(~blank(source) & ~blank(lang) & ~english(lang))
    wanted = wanted.select(key, F.substring(F.trim(source), 1, max_chars).alias("_t"), F.replace(F.col(lang), F.lit("_"), F.lit("-")).alias("_l")).sortWithinPartitions(F.length("_t"))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        model = factory()
        for frame in frames:
            out = []
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    got = model.translate(part["_t"].tolist(), part["_l"].tolist())
                except Exception:
                    got = []
                    for t, code in zip(part["_t"], part["_l"], strict=True):
                        try:
                            got += model.translate([t], [code])
                        except Exception:
                            got.append(None)
                out += [(k, g.strip() or None if g else None) for k, g in zip(part[key], got, strict=True)]
            yield pd.DataFrame(out, columns=[key, "translation"])

    return wanted.mapInPandas(run, f"{key} long, translation string")


def speech_seconds(segments: Column) -> Column:
    """Total length of array<struct<start, end>>, in seconds."""
    from pyspark.sql import functions as F

    return F.aggregate(segments, F.lit(0.0), lambda total, s: total + (s["end"] - s["start"]))
