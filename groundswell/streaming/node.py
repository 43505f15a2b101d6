"""A running map: views published at their rates beside the stream, and services on a snapshot of a committed version."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stencil
from ..operators.raster import CELL, snapshot
from ..plans.config import Node
from ..plans.mapper import postprocessed
from .mapper import StreamingMapper

SNAPSHOT = ["elevation", "lower_bound", "upper_bound"]


class MappingNode:
    """publish(name, DataFrame) gets local_map, global_map and post_processed, each of one committed version."""

    def __init__(self, mapper: StreamingMapper, node: Node, publish: Callable[[str, DataFrame], None]) -> None:
        self.mapper, self.node, self.publish = mapper, node, publish
        self.rates = {"local_map": node.local_rate, "global_map": node.global_rate, "post_processed": node.post_rate}
        self.next: dict[str, float] = {}

    # --- timers ---

    def due(self, now: float) -> list[str]:
        """The views whose time has come; each is then due again a period after it was, or after now where that is past."""
        out = []
        for name, rate in self.rates.items():
            at = self.next.get(name, now)
            if now >= at:
                out.append(name)
                self.next[name] = max(at + 1 / rate, now)
        return out

    def tick(self, now: float) -> list[str]:
        """Publishes what is due; nothing before the first version."""
        names = self.due(now) if self.mapper.version.number >= 0 else []
        for name in names:
            self.publish(name, {"local_map": self.local_map, "global_map": self.global_map, "post_processed": self.run_postprocess}[name]())
        return names

    def run(self, query: StreamingQuery, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        """Ticks until the query ends, and once more for what came last."""
        while query.isActive:
            self.tick(clock())
            sleep(max(0.0, min(self.next.values(), default=0.0) - clock()) or 0.01)
        if (fault := query.exception()) is not None:
            raise fault
        self.next = {}
        self.tick(clock())

    # --- views ---

    def global_map(self) -> DataFrame:
        return self.mapper.layers()

    def local_map(self) -> DataFrame:
        """What lies in the last window of a local map; all of a global one."""
        layers, deltas = self.mapper.layers(), self.mapper.version.deltas
        box = deltas[-1][1] if deltas else None
        return layers.where(F.col("row").between(box[0], box[1]) & F.col("col").between(box[2], box[3])) if box else layers

    # --- services ---

    def snapshot(self) -> DataFrame:
        layers = self.mapper.layers()
        return snapshot(layers.where(F.col("elevation").isNotNull()), SNAPSHOT)

    def reset(self) -> None:
        self.mapper.reset()

    def run_uncertainty_fusion(self) -> DataFrame:
        p = self.node.post
        return stencil.fused_uncertainty(self.snapshot(), self.mapper.mapper.grid.resolution, p.fusion_radius, p.fusion_sigma, p.quantile_low, p.quantile_high, p.fusion_min_valid)

    def run_inpainting(self) -> DataFrame:
        return stencil.inpainted(self.snapshot(), self.mapper.mapper.grid, self.node.post.passes, self.node.post.min_valid)

    def run_feature_extraction(self) -> DataFrame:
        p = self.node.post
        return stencil.terrain_features(self.snapshot(), self.mapper.mapper.grid.resolution, p.feature_radius, p.feature_min_valid, p.step_low, p.step_high)

    def run_postprocess(self) -> DataFrame:
        """Fusion, then inpainting, then features, as the node's configuration asks for; and the range of uncertainty."""
        out = postprocessed(self.snapshot(), self.mapper.mapper.grid, self.node.post)
        return out.join(stencil.uncertainty_range(out.where(F.col("lower_bound").isNotNull())), list(CELL), "left")
