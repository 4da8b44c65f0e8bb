"""Attack-window files. They are small; they are read by Spark as one text and normalised on the driver."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def _int(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _bare(value):
    """The value that a one-key object wraps, as unions do in these files; else the value."""
    return next(iter(value.values())) if isinstance(value, dict) and len(value) == 1 else value


def _dicts(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _by_host(data) -> list[tuple[str, int, dict]]:
    hosts = data.get("attacks_by_host") if isinstance(data, dict) else None
    if not isinstance(hosts, dict):
        return []
    return [(host, k, x) for host, own in hosts.items() if isinstance(own, list) for k, x in enumerate(own) if isinstance(x, dict)]


def _window(entry: dict) -> dict:
    inner = entry.get("window")
    return inner if isinstance(inner, dict) else {}


def half_open(data) -> list[tuple[int, int]]:
    """Pairs with start < end of any of the five layouts; later layouts of an object count only if earlier ones gave none."""
    if isinstance(data, list):
        raw = [
            (x.get("start_ns"), x.get("end_ns")) if "start_ns" in x or "end_ns" in x else (_window(x).get("start_unix_ns"), _window(x).get("end_unix_ns"))
            for x in _dicts(data)
        ]
        layouts = [raw]
    elif isinstance(data, dict):
        pairs = data.get("intervals") if isinstance(data.get("intervals"), list) else []
        layouts = [
            [(x.get("start_ns"), x.get("end_ns")) for _, _, x in _by_host(data)],
            [(_window(x).get("start_unix_ns"), _window(x).get("end_unix_ns")) for x in _dicts(data.get("attacks"))],
            [tuple(p) for p in pairs if isinstance(p, (list, tuple)) and len(p) == 2],
        ]
    else:
        layouts = []
    for raw in layouts:
        found = [(s, e) for s, e in ((_int(a), _int(b)) for a, b in raw) if s is not None and e is not None and e > s]
        if found:
            return found
    return []


def closed(data) -> list[tuple[int, int]]:
    """Pairs of the layout by host; reversed bounds are swapped and empty windows kept. Refuses a file without any."""
    found = [(_int(x.get("start_ns")), _int(x.get("end_ns"))) for _, _, x in _by_host(data)]
    found = [(min(p), max(p)) for p in found if None not in p]
    if not found:
        raise ValueError("no windows by host")
    return found


def nanoseconds(value) -> int | None:
    """Nanoseconds from a whole number of them, a float (seconds up to 1e12), digits or ISO text in UTC."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value if value > 1e12 else value * 1e9)
    text = str(value).strip()
    if text.isdigit():
        return int(text)
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    gap = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gap.days * 86_400 + gap.seconds) * 1_000_000_000 + gap.microseconds * 1_000


def with_ids(data) -> list[tuple[str, str, int, int]]:
    """(id, host, start, end), closed, by start; several names for the bounds; ids from host and position where missing."""
    starts, ends = ("start_ns", "start", "start_iso", "startTimestampNanos"), ("end_ns", "end", "end_iso", "endTimestampNanos")
    out = []
    for host, k, x in _by_host(data):
        s, e = (nanoseconds(next((x[n] for n in names if x.get(n)), None)) for names in (starts, ends))
        if s is not None and e is not None:
            out.append((str(x.get("id", f"{host}_attack_{k}")), host, min(s, e), max(s, e)))
    if not out:
        raise ValueError("no windows by host")
    return sorted(out, key=lambda w: w[2])


def _iso(ns: int | None) -> str | None:
    return None if ns is None else datetime.fromtimestamp(ns // 1_000_000_000, timezone.utc).isoformat()


def listing(data) -> list[dict]:
    """Rows for display: name, start_ns, end_ns, start_iso, end_iso, malicious, host, idx; any layout."""
    if isinstance(data, dict) and isinstance(data.get("attacks_by_host"), dict):
        entries = [(x, x.get("name") or x.get("label") or host, host, k) for host, k, x in _by_host(data)]
    elif isinstance(data, dict) and isinstance(data.get("attacks"), list):
        entries = [({"window": _window(x), "malicious": x.get("malicious")}, x.get("name") or x.get("label") or f"attack_{k}", None, k) for k, x in enumerate(data["attacks"]) if isinstance(x, dict)]
    elif isinstance(data, dict) and isinstance(data.get("intervals"), list):
        entries = [({"start_ns": p[0], "end_ns": p[1]}, f"attack_{k}", None, k) for k, p in enumerate(data["intervals"]) if isinstance(p, (list, tuple)) and len(p) == 2]
    elif isinstance(data, list):
        entries = [(x, x.get("name") or x.get("label") or f"attack_{k}", None, k) for k, x in enumerate(data) if isinstance(x, dict)]
    else:
        raise ValueError("no known layout of attack windows")
    rows = []
    for x, name, host, k in entries:
        inner = _window(x)
        s, e = (_int(_bare(x.get(f"{side}_ns")) or _bare(inner.get(f"{side}_unix_ns"))) for side in ("start", "end"))
        malicious = x.get("malicious")
        rows.append({
            "name": name, "start_ns": s, "end_ns": e, "start_iso": x.get("start_iso") or inner.get("start_iso") or _iso(s),
            "end_iso": x.get("end_iso") or inner.get("end_iso") or _iso(e), "malicious": 1 if malicious is None else int(bool(malicious)), "host": host, "idx": k,
        })
    return rows


def interval_table(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pairs, "start_ns bigint, end_ns bigint")


def id_table(spark: SparkSession, windows: list[tuple[str, str, int, int]]) -> DataFrame:
    return spark.createDataFrame(windows, "window_id string, host string, start_ns bigint, end_ns bigint")


def listing_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """By start, rows without one last."""
    names = ("name", "start_ns", "end_ns", "start_iso", "end_iso", "malicious", "host", "idx")
    schema = "name string, start_ns bigint, end_ns bigint, start_iso string, end_iso string, malicious int, host string, idx int"
    ordered = sorted(rows, key=lambda r: (r["start_ns"] is None, r["start_ns"] or 0))
    return spark.createDataFrame([tuple(r[n] for n in names) for r in ordered], schema)
