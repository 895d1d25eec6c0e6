"""Settings of the engine, from defaults, a mapping and the environment."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Config:
    """flush_commands and flush_ms bound what a log's Batcher holds, segment_rows a segment's files, tier_* the compaction, which a
    sink runs every compaction_batches micro-batches; snapshot_* say when snapshots are taken and how many stay; bloom_fpp
    is the filters' false-positive rate, scan_limit the default of scan()."""

    node_id: str = "local"
    data_dir: str = "data"
    flush_commands: int = 256
    flush_ms: int = 2
    segment_rows: int = 1_000_000
    compaction_batches: int = 4
    tier_segments: int = 4
    tier_ratio: int = 10
    snapshot_threshold: int = 10_000
    snapshot_retain: int = 3
    bloom_fpp: float = 0.01
    scan_limit: int = 100


def load(values: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None, prefix: str = "KEYTIDE_") -> Config:
    """Defaults, then values (unknown names are an error), then variables such as KEYTIDE_NODE_ID."""
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Config)}
    given = dict(values or {})
    if unknown := given.keys() - kinds.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    env = os.environ if environ is None else environ
    given |= {k: env[name] for k in kinds if (name := prefix + k.upper()) in env}
    return Config(**{k: kinds[k](v) for k, v in given.items()})
