"""A second model of the log: a dictionary and a replay."""

import random

SCHEMA = "version long, op string, key string, value binary, ttl_seconds long"


def sequence(seed: int, n: int = 200, keys: int = 15) -> list[tuple]:
    """Puts, overwrites, deletes, deletes of absent keys, puts after deletes, empty values, gaps between versions."""
    r, version, out = random.Random(seed), 0, []
    names = ["a", "a/", "a/b", "ab", "b", "é", "z", "user:1", "user:10", "user:2"] + [f"k{i}" for i in range(keys)]
    for _ in range(n):
        version += r.choice((1, 1, 1, 2, 7))
        key = r.choice(names)
        if r.random() < 0.3:
            out.append((version, "delete", key, None, None))
        else:
            out.append((version, "put", key, bytes(r.randrange(256) for _ in range(r.choice((0, 1, 5, 40)))), None))
    return out


def replay(log: list[tuple], upto: int | None = None) -> dict[str, tuple]:
    """key -> (value, version, deleted)"""
    out: dict[str, tuple] = {}
    for version, op, key, value, _ in sorted(log, key=lambda x: x[0]):
        if upto is None or version <= upto:
            out[key] = (None if op == "delete" else value, version, op == "delete")
    return out


def live(log: list[tuple], upto: int | None = None) -> list[tuple]:
    return sorted((k, v, n) for k, (v, n, dead) in replay(log, upto).items() if not dead)


def rows(df) -> list[tuple]:
    return sorted((r.key, None if r.value is None else bytes(r.value), r.version) for r in df.collect())
