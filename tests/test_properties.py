"""Random panels against loops written from the definitions."""

import math

import numpy as np
import pytest
from engine_helpers import rows
from test_micro import panel_of

from kinloom.operators import extend, seeds, smooth
from kinloom.params import Detection, Smoothing
from kinloom.plans import detect

P = Detection(min_seed=1.0, max_gap=200, min_extend=0.5, min_markers=10, min_output=1.0, min_mac=2)


def mosaic(seed, haps=12, sites=160, founders=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (founders, sites))
    h = np.stack([np.concatenate([base[rng.integers(founders), a:a + 40] for a in range(0, sites, 40)]) for _ in range(haps)])
    return np.where(rng.random(h.shape) < 0.02, 1 - h, h), rng


def brute_smooth(h, p):
    m, n = h.shape
    now, flips = h.copy(), []
    for eff in range(p.length, n - p.gap - p.length + 1):
        groups = {}
        for i in range(m):
            groups.setdefault((tuple(h[i, eff - p.length:eff]), tuple(h[i, eff + p.gap:eff + p.gap + p.length])), []).append(i)
        for g in groups.values():
            if len(g) < p.width:
                continue
            for k in range(p.gap):
                ones = int(h[g, eff + k].sum())
                if min(ones, len(g) - ones) <= len(g) * p.rho:
                    v = int(len(g) - ones < ones)
                    for i in g:
                        if now[i, eff + k] != v:
                            flips.append((eff + k, i, eff, int(now[i, eff + k]), v))
                            now[i, eff + k] = v
    return now, sorted(flips)


@pytest.mark.parametrize("gap,seed", [(1, 1), (3, 2)])
def test_smoothing(spark, gap, seed):
    h, _ = mosaic(seed)
    p = Smoothing(5, 3, gap, 0.34)
    now, flips = brute_smooth(h, p)
    df = panel_of(spark, h.tolist())
    assert rows(smooth.correction_events(df, p), "site_id", "hap_id", "eff", "old", "new") == flips
    out = smooth.apply_corrections(df, smooth.corrections(df, p))
    assert {(r.hap_id, r.site_id): r.allele for r in out.collect()} == {(i, j): int(now[i, j]) for i in range(len(h)) for j in range(h.shape[1])}


def brute_segments(h, bp, cm, p):
    """Seeds and their growth, step by step over the mismatches of a pair."""
    n, last, found, all_seeds = h.shape[1], h.shape[1] - 1, set(), []
    mm1 = math.floor(p.extend_cm / p.min_seed * p.min_markers) - 1
    for a in range(len(h)):
        for b in range(a + 1, len(h)):
            q = [i for i in range(n) if h[a, i] != h[b, i]]
            edges = [-1, *q, n]
            for x, y in zip(edges, edges[1:]):
                s, e = x + 1, y - 1
                if e < s or cm[e] - cm[s] < p.min_seed or e - s + 1 < p.min_markers + (e == last and p.closeout_strict):
                    continue
                all_seeds.append((a, b, s, e))
                dropped = False
                while s >= 2:
                    c = [m for m in q if m <= s - 1 and bp[s - 1] - bp[m] <= p.max_gap]
                    low = c[0]
                    if low > 0:
                        fm, before = low - 1, [m for m in q if m < low]
                        to = before[-1] + 1 if before else 0
                    else:
                        fm, to = c[1] - 1, 0
                    size = cm[fm] - cm[to]
                    if size >= p.min_seed and fm - to >= p.min_markers - 1:
                        dropped = True
                        break
                    if size < p.extend_cm or fm - to < mm1:
                        break
                    s = to
                while not dropped and e <= last - 2:
                    c = [m for m in q if m >= e + 1 and bp[m] - bp[e + 1] <= p.max_gap]
                    high = c[-1]
                    if high < last:
                        fm, after = high + 1, [m for m in q if m > high]
                        to = after[0] - 1 if after else last
                    else:
                        fm, to = c[-2] + 1, last
                    if cm[to] - cm[fm] < p.extend_cm or to - fm < mm1:
                        break
                    e = to
                if not dropped and cm[e] - cm[s] >= p.min_output and a // 2 != b // 2:
                    found.add((a, b, s, e))
    return sorted(all_seeds), sorted(found)


@pytest.mark.parametrize("seed", [3, 4])
def test_seeds_and_segments(spark, seed):
    h, rng = mosaic(seed)
    n = h.shape[1]
    bp = (np.arange(n) * 100 + rng.integers(0, 60, n)).tolist()
    cm = np.cumsum(rng.random(n) * 0.1).tolist()
    want_seeds, want = brute_segments(h, bp, cm, P)
    df = panel_of(spark, h.tolist())
    at = spark.createDataFrame([("1", i, bp[i], cm[i]) for i in range(n)], "chrom string, site_id bigint, bp bigint, cm double")
    for pairs in (seeds.all_pairs(df), seeds.candidate_pairs(df, P.min_markers)):
        mm = seeds.mismatches(df, pairs)
        got = seeds.seeds(seeds.runs(mm, pairs, at), at, P)
        assert rows(got, "h1", "h2", "s", "e") == want_seeds
        segs = extend.segments(got, mm, at, P)
        assert rows(segs, "h1", "h2", "start_idx", "end_idx") == want
    assert want


def test_whole_program_either_way(spark):
    h, _ = mosaic(5)
    df = panel_of(spark, h.tolist())
    at = spark.createDataFrame([("1", i, 100 * i) for i in range(h.shape[1])], "chrom string, site_id bigint, bp bigint")
    k = spark.createDataFrame([("1", 0, 0.0), ("1", 8000, 6.0), ("1", 16000, 12.0)], "chrom string, bp bigint, cm double")
    s = Smoothing(5, 3, 1, 0.34)
    one = detect.detect(df, at, k, P, s)
    two = detect.detect(df, at, k, P, s, by_candidates=False)
    assert rows(one.segments) == rows(two.segments) and one.segments.count() > 0
    from kinloom.queries import network

    kept = detect.filtered(one, network())
    assert kept.count() <= one.segments.count()
    assert detect.summary(one.segments, kept).first().processed == one.segments.count()


def test_empty_panel(spark):
    df = panel_of(spark, [[0]]).limit(0)
    at = spark.createDataFrame([], "chrom string, site_id bigint, bp bigint")
    k = spark.createDataFrame([("1", 0, 0.0), ("1", 9, 1.0)], "chrom string, bp bigint, cm double")
    assert detect.detect(df, at, k, P).segments.count() == 0
