"""Label proposals from exchangeable providers: digest, cache, tiles, inference per tile, votes, checks, publication."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.shipping import ship
from pointloom.operators import grid as G
from pointloom.operators import proposals as P
from pointloom.sources.generations import Generations


class ProviderUnavailable(RuntimeError):
    """The provider cannot run here; a fallback may."""


class Provider(ABC):
    """What a labelling method must offer. ``infer`` sees one tile with its halo at a time, inside a task."""

    name = "provider"
    version = "1"
    labels = 0

    def settings(self) -> dict:
        return {}

    def prepare(self, cloud: DataFrame) -> None:
        """Check that the provider can run; raise ``ProviderUnavailable`` otherwise."""

    @abstractmethod
    def infer(self, tile: pd.DataFrame) -> pd.DataFrame:
        """label (-1: unknown) and score in [0, 1] for each row of the tile (rid, scan, x, y, z, core)."""


class FaceProvider(Provider):
    """Label of the lowest face (label, x0, y0, ux, uy, length, z0, z1) within ``reach`` of a point."""

    name = "faces"

    def __init__(self, faces: list[tuple], reach: float = 0.035):
        self.faces, self.reach = sorted(faces), reach
        self.labels = 1 + max((f[0] for f in faces), default=-1)

    def settings(self) -> dict:
        return {"reach": self.reach, "faces": [list(map(float, f)) for f in self.faces]}

    def infer(self, tile: pd.DataFrame) -> pd.DataFrame:
        label, score = np.full(len(tile), -1), np.zeros(len(tile))
        x, y, z = (tile[c].to_numpy() for c in "xyz")
        for name, x0, y0, ux, uy, length, z0, z1 in self.faces:
            along, off = (x - x0) * ux + (y - y0) * uy, np.abs((y - y0) * ux - (x - x0) * uy)
            hit = (label < 0) & (off <= self.reach) & (along >= 0) & (along <= length) & (z >= z0) & (z <= z1)
            label[hit], score[hit] = name, 1 - off[hit] / (2 * self.reach)
        return pd.DataFrame({"label": label.astype("int64"), "score": score})


def votes(cloud: DataFrame, provider: Provider, tile: float, halo: float) -> DataFrame:
    """One vote for each point in each tile whose halo holds it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["scan", "rid"]).reset_index(drop=True)
        out = provider.infer(pdf)
        return pd.DataFrame({"row": pdf["rid"], "label": out["label"].to_numpy(), "score": out["score"].to_numpy()})

    return G.tiles_with_halo(cloud, tile, halo).groupBy("tx", "ty").applyInPandas(run, "row long, label long, score double")


def propose(cloud: DataFrame, provider: Provider, store: Generations, code: str = "1", tile: float = 2.0, halo: float = 0.4, fallback: Provider | None = None) -> tuple[str, DataFrame, list[str]]:
    """(key, labels, warnings). Equal inputs, provider and settings give the same key, and a published result is never computed again."""
    if cloud.groupBy("scan", "rid").count().where("count > 1").limit(1).count():
        raise ValueError("a record occurs twice")
    warnings: list[str] = []
    try:
        provider.prepare(cloud)
    except ProviderUnavailable as error:
        if fallback is None:
            raise
        warnings.append(f"{provider.name}: {error}; {fallback.name} was used")
        provider = fallback
        provider.prepare(cloud)
    digest = P.column_digest(cloud, "scan", "rid", "x", "y", "z").first().asDict()
    key = P.cache_key({"tile": tile, "halo": halo}, digest, f"{provider.name}/{provider.version}", provider.settings(), code)
    found = store.get(key)
    if found is None:
        rows = cloud.select(F.col("rid").alias("row"))
        labels = P.with_unknown(rows, P.majority(votes(cloud, provider, tile, halo)))
        bad = P.label_violations(labels, provider.labels - 1).limit(1).collect()
        if bad:
            raise ValueError(f"the provider broke its contract: {bad[0].rule}")
        found = store.publish(key, labels)
    return key, found, warnings


ship(__name__)
