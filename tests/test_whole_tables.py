"""Queries over pairs of whole tables against brute force in numpy: no row of either side is left out."""

from __future__ import annotations

import numpy as np
import pandas as pd

from orrery.operators import components
from orrery.plans import registry


def boxes(x, y, w, h):
    return np.stack([x, y, x + w, y + h]).astype(float)


def tables(sf_dir):
    """(ids, boxes) of objects and covers, drawn from the tables without Spark."""
    part, customer = pd.read_parquet(f"{sf_dir}/part.parquet"), pd.read_parquet(f"{sf_dir}/customer.parquet")
    k, c = part["p_partkey"].to_numpy(np.int64), customer["c_custkey"].to_numpy(np.int64)
    size = part["p_size"].to_numpy(np.int64)
    return (k, boxes(k * 37 % 1000 * 10, k * 91 % 1000 * 10, size + 10, k % 40 + 10)), (c, boxes(c * 131 % 500 * 20, c * 53 % 500 * 20, 60, 40))


def linked(sf_dir):
    """All pairs that fusion may match: (object, cover, iou, distance)."""
    (k, a), (c, b) = tables(sf_dir)
    a, b = a[:, :, None], b[:, None, :]
    over = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
    iou = over / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - over)
    gap = np.sqrt(((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2)
    i, j = np.nonzero((iou >= 0.1) | (gap <= 50))
    return k, c, list(zip(k[i].tolist(), c[j].tolist(), iou[i, j].tolist(), gap[i, j].tolist(), strict=True))


def test_fusion_pairs_of_whole_tables(spark, sf_dir):
    _, _, pairs = linked(sf_dir)
    got = {(r["object_id"], r["c_custkey"]): (r["iou"], r["distance"]) for r in registry.QUERIES["fusion_pairs"](spark, sf_dir).collect()}
    want = {(s, d): (iou, gap) for s, d, iou, gap in pairs}
    assert got.keys() == want.keys()
    assert any(s % 4 for s, _ in got) and any(d % 2 for _, d in got)
    assert all(np.allclose(got[p], want[p], rtol=0, atol=1.1e-6) for p in want)


def test_fusion_of_whole_tables(spark, sf_dir):
    k, c, pairs = linked(sf_dir)
    options: dict[int, list] = {}
    for s, d, iou, gap in pairs:
        options.setdefault(s, []).append((-iou, gap, str(d), d))
    used: dict[int, int] = {}
    for s in sorted(options, key=str):
        free = [o for o in sorted(options[s]) if o[3] not in used]
        if free:
            used[free[0][3]] = s
    taken, risk = set(used.values()), lambda s: "" if s % 8 else "built_up_risk"
    want = [(f"fused-{s}-{d}", "static_dynamic", risk(s)) for d, s in used.items()]
    want += [(f"static-{s}", "static_only", risk(s)) for s in k.tolist() if s not in taken]
    want += [(f"dynamic-{d}", "dynamic_only", "") for d in c.tolist() if d not in used]
    got = [(r["candidate_id"], r["evidence_class"], r["flags"]) for r in registry.QUERIES["fusion"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def repeated(sf_dir, folder, times, **keys):
    """Copies of tables with shifted keys, as larger tables have them: many rows of equal shapes."""
    for name, key in keys.items():
        rows = pd.read_parquet(f"{sf_dir}/{name}.parquet")
        step = rows[key].max() - rows[key].min() + 1
        pd.concat([rows.assign(**{key: rows[key] + i * step}) for i in range(times)]).to_parquet(f"{folder}/{name}.parquet", index=False)
    return str(folder)


def counted(monkeypatch):
    """(tag, rows) of each table that connected components write."""
    sizes, write = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, tag: (out := write(df, tag), sizes.append((tag, out.count())))[0])
    return sizes


def test_fusion_of_repeated_tables(spark, sf_dir, tmp_path, monkeypatch):
    folder = repeated(sf_dir, tmp_path, 20, part="p_partkey", customer="c_custkey")
    sizes, pairs = counted(monkeypatch), linked(folder)[2]
    test_fusion_of_whole_tables(spark, folder)
    assert len(pairs) > 400 and max(n for _, n in sizes) < len(pairs) / 10


def test_risk_filters_of_whole_contexts(spark, sf_dir):
    (k, a), (_, roads) = tables(sf_dir)
    f = pd.read_parquet(f"{sf_dir}/supplier.parquet")["s_suppkey"].to_numpy(np.int64)
    water = boxes(f * 211 % 100 * 100, f * 57 % 100 * 100, f % 7 * 50 + 300, 250)

    def nearest(b):
        x, y = a[:, :, None], b[:, None, :]
        dx, dy = (np.maximum(np.maximum(x[i] - y[i + 2], y[i] - x[i + 2]), 0) for i in (0, 1))
        return np.sqrt(dx**2 + dy**2).min(axis=1)

    rows = {r["object_id"]: r for r in registry.QUERIES["risk_filters"](spark, sf_dir).collect()}
    assert sorted(rows) == sorted(k.tolist())
    w, h = a[2] - a[0], a[3] - a[1]
    linear = np.maximum(w, h) / np.minimum(w, h) > 4
    for s, road, wet, lin in zip(k.tolist(), nearest(roads), nearest(water), linear, strict=True):
        r = rows[s]
        assert abs(r["road_distance_m"] - road) < 1.1e-6 and abs(r["water_distance_m"] - wet) < 1.1e-6
        flags = [n for n, c in (("linear_object_risk", lin), ("road_risk", road <= 20), ("small_object_risk", s % 15 <= 12), ("water_risk", wet <= 20)) if c]
        assert r["flags"] == "|".join(flags)
        assert abs(r["false_positive_penalty"] - (0.3 * (road <= 20) + 0.3 * (wet <= 20) + 0.25 * lin)) < 1e-9


def test_recall_of_all_sites(spark, sf_dir):
    (k, a), _ = tables(sf_dir)
    f = pd.read_parquet(f"{sf_dir}/supplier.parquet")["s_suppkey"].to_numpy(np.int64)
    b = boxes(f * 211 % 100 * 100, f * 57 % 100 * 100, f % 7 * 50 + 300, 250)
    ranked = a[:, np.lexsort((k, -(k % 97)))]
    x, y = b[:, :, None], ranked[:, None, :]
    meets = (x[0] <= y[2]) & (y[0] <= x[2]) & (x[1] <= y[3]) & (y[1] <= x[3])
    best = np.where(meets.any(axis=1), meets.argmax(axis=1) + 1, len(k) + 1)
    got = {r["n"]: r["recall"] for r in registry.QUERIES["recall_at_n"](spark, sf_dir).collect()}
    assert got.keys() == {10, 100, 500}
    assert all(abs(got[n] - np.mean((best <= n) & meets.any(axis=1))) < 1e-6 for n in got)
