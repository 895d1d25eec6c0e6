"""Temporary views of a change log, for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import state


def register(cmds: DataFrame, prefix: str = "kv") -> None:
    """kv_commands, kv_state and kv_live; filters on the key pass through the views to the log's scan."""
    cmds.createOrReplaceTempView(f"{prefix}_commands")
    state.state(cmds).createOrReplaceTempView(f"{prefix}_state")
    state.live(cmds).createOrReplaceTempView(f"{prefix}_live")
