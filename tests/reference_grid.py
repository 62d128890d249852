"""Brute-force grid of a handful of points: recursion and plain loops, nothing shared with the library."""

from __future__ import annotations

import math
from collections import Counter

HAZARDS = {40, 41, 42, 43, 44}


def interleave(ix: int, iy: int) -> int:
    out = 0
    for bit in range(16):
        out |= (iy >> bit & 1) << 2 * bit
        out |= (ix >> bit & 1) << 2 * bit + 1
    return out


def asked(x, y, cls, conf, risk=True, threshold=0.6, hazard_factor=4.0):
    r = math.sqrt(x * x + y * y)
    base = 0.05 if r <= 10 else 0.05 + (r - 10) / 90 * 0.45
    target, why = base, 0
    if risk and conf < threshold:
        target, why = min(target, base / 2), 2
    if risk and cls in HAZARDS:
        target, why = min(target, base / hazard_factor), 3
    level = math.ceil(math.log2(204.8 / max(target, 0.05)) - 1e-9)
    return min(max(level, 0), 12), why


def build(points, risk=True, **settings):
    """points: dicts with point_idx, x, y, z, cls, conf. Returns cells as dicts, sorted by code."""
    rows = []
    for p in points:
        if abs(p["x"]) >= 102.4 or abs(p["y"]) >= 102.4:
            continue
        ix, iy = (min(max(int((p[v] + 102.4) / 0.05), 0), 4095) for v in ("x", "y"))
        level, why = asked(p["x"], p["y"], p["cls"], p["conf"], risk, **settings)
        rows.append(dict(p, code=interleave(ix, iy), level=level, why=why))
    rows.sort(key=lambda p: (p["code"], p["point_idx"]))
    for i, p in enumerate(rows):
        beside = rows[max(i - 1, 0) : i + 2]
        p["edge"] = any(q["cls"] != p["cls"] for q in beside)
    for p in rows:
        if risk and p["edge"] and p["level"] < 11:
            p["level"], p["why"] = p["level"] + 1, p["why"] or 1
    leaves = []

    def descend(group, level):
        top = max((p["level"], p["why"]) for p in group)
        if top[0] <= level:
            leaves.append((level, {0: 0, 1: 3, 2: 2, 3: 1}[top[1]], group))
            return
        children = {}
        for p in group:
            children.setdefault(p["code"] >> 2 * (11 - level), []).append(p)
        for child in children.values():
            descend(child, level + 1)

    if rows:
        descend(rows, 0)
    cells = []
    for level, driver, group in leaves:
        votes = Counter(p["cls"] for p in group)
        z = [p["z"] for p in group]
        cells.append(
            {
                "code": group[0]["code"],
                "level": level,
                "driver": driver,
                "cls": min(votes, key=lambda c: (-votes[c], c)),
                "n_points": len(group),
                "z": sum(z) / len(z),
                "z_min": min(z),
                "z_max": max(z),
                "conf": sum(p["conf"] for p in group) / len(group),
            }
        )
    return sorted(cells, key=lambda c: c["code"])
