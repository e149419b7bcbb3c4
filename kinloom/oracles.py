"""The same queries in DuckDB's SQL, written on their own: plain joins, recursion and lists."""

from __future__ import annotations

from .operators.features import NAMES, feature_names

_BASE = """
samples AS (SELECT n_nationkey::BIGINT AS sample_idx, n_name AS sample_id FROM nation),
haps AS (SELECT 2 * sample_idx + i AS hap_id FROM samples, (VALUES (0), (1)) t(i)),
sites AS (SELECT '20' AS chrom, p_partkey AS site_id, 1000 + 100 * p_partkey + p_size AS bp, p_size FROM part),
founder AS (SELECT chrom, site_id, hap_id, (hap_id * 7 + (site_id // 50) * (1 + hap_id % 3)) % 5 AS f FROM sites, haps),
clean AS (SELECT chrom, site_id, hap_id,
  (((f * f * 31 + f * site_id * 17 + site_id * site_id * 13 + (site_id // 7) * f) % 11) % 2)::INT AS allele FROM founder),
panel AS (SELECT chrom, site_id, hap_id, CASE WHEN (hap_id * 31 + site_id * 17) % 97 = 0 THEN 1 - allele ELSE allele END AS allele FROM clean)"""

_COUNTS = """
counts AS (SELECT chrom, site_id, sum(allele)::BIGINT AS n_alt, count(*)::BIGINT AS n_haps,
  least(sum(allele), count(*) - sum(allele))::BIGINT AS mac FROM {panel} GROUP BY ALL)"""

_MAP = """
knots AS (SELECT chrom, bp, (coalesce(sum(w) OVER (PARTITION BY chrom ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000)::DOUBLE AS cm
  FROM (SELECT chrom, site_id // 25 AS k, min(bp) AS bp, sum(p_size)::BIGINT AS w FROM sites GROUP BY ALL)),
tips AS (SELECT min(bp) AS b0, arg_min(cm, bp) AS c0, max(bp) AS b1, arg_max(cm, bp) AS c1 FROM knots),
front AS (SELECT bp, cm FROM knots, tips WHERE cm - c0 >= 5 OR bp = b1 ORDER BY bp LIMIT 1),
back AS (SELECT bp, cm FROM knots, tips WHERE c1 - cm >= 5 OR bp = b0 ORDER BY bp DESC LIMIT 1)"""


def _at(places: str, clamp: bool = False) -> str:
    """Genetic positions of the places of a table with a column bp."""
    before = "c0" if clamp else "c0 + (x.bp - b0)::DOUBLE / ((SELECT bp FROM front) - b0) * ((SELECT cm FROM front) - c0)"
    after = "c1" if clamp else "(SELECT cm FROM back) + (x.bp - (SELECT bp FROM back))::DOUBLE / (b1 - (SELECT bp FROM back)) * (c1 - (SELECT cm FROM back))"
    return f"""SELECT x.*, CASE WHEN hi.bp = x.bp THEN hi.cm WHEN lo.bp IS NULL THEN {before} WHEN hi.bp IS NULL THEN {after}
      ELSE lo.cm + (x.bp - lo.bp)::DOUBLE / (hi.bp - lo.bp) * (hi.cm - lo.cm) END AS cm
    FROM {places} x ASOF LEFT JOIN knots lo ON x.chrom = lo.chrom AND x.bp >= lo.bp
      ASOF LEFT JOIN knots hi ON x.chrom = hi.chrom AND x.bp <= hi.bp CROSS JOIN tips"""


def _mm(panel: str) -> str:
    return f"""
mm AS (SELECT a.chrom, a.hap_id AS h1, b.hap_id AS h2, a.site_id FROM {panel} a JOIN {panel} b
  ON a.chrom = b.chrom AND a.site_id = b.site_id AND a.hap_id < b.hap_id AND a.allele <> b.allele)"""


_RUNS = """
pairs AS (SELECT DISTINCT c.chrom, a.hap_id AS h1, b.hap_id AS h2 FROM haps a JOIN haps b ON a.hap_id < b.hap_id, (SELECT DISTINCT chrom FROM pos) c),
size AS (SELECT count(*) AS n FROM pos),
runs AS (SELECT * FROM (SELECT chrom, h1, h2, lag(site_id, 1, -1) OVER w + 1 AS s, site_id - 1 AS e
  FROM (SELECT * FROM mm UNION ALL SELECT chrom, h1, h2, n FROM pairs, size) WINDOW w AS (PARTITION BY chrom, h1, h2 ORDER BY site_id)) WHERE e >= s)"""


def _seeds(strict: int = 1) -> str:
    return f"""
seeds AS (SELECT r.chrom, h1, h2, s, e FROM runs r JOIN pos a ON a.site_id = s JOIN pos b ON b.site_id = e, size
  WHERE b.cm - a.cm >= 1.0 AND e - s + 1 >= 20 + CASE WHEN e = n - 1 THEN {strict} ELSE 0 END)"""


# A step looks at the cluster that begins (or ends) at a mismatch and at the run beyond it.
_STEPS = """
loc AS (SELECT mm.*, bp FROM mm JOIN pos USING (chrom, site_id)),
clu AS (SELECT chrom, h1, h2, site_id,
    last_value(site_id) OVER (w RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING) AS cf,
    first_value(site_id) OVER (w RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS cb
  FROM loc WINDOW w AS (PARTITION BY chrom, h1, h2 ORDER BY bp)),
nb AS (SELECT chrom, h1, h2, site_id, lag(site_id) OVER w AS p, lead(site_id) OVER w AS q FROM mm WINDOW w AS (PARTITION BY chrom, h1, h2 ORDER BY site_id)),
fwd0 AS (SELECT c.chrom, c.h1, c.h2, c.site_id - 1 AS from_idx,
    CASE WHEN cf < n - 1 THEN coalesce(q - 1, n - 1) ELSE n - 1 END AS to_idx, CASE WHEN cf < n - 1 THEN cf + 1 ELSE p + 1 END AS fm
  FROM clu c JOIN nb ON nb.chrom = c.chrom AND nb.h1 = c.h1 AND nb.h2 = c.h2 AND nb.site_id = cf, size WHERE c.site_id - 1 <= n - 3),
fwd AS (SELECT f.chrom, h1, h2, f.from_idx, f.to_idx FROM fwd0 f JOIN pos x ON x.site_id = f.to_idx JOIN pos y ON y.site_id = fm
  WHERE x.cm - y.cm >= 0.5 AND f.to_idx - fm >= 9),
bwd0 AS (SELECT c.chrom, c.h1, c.h2, c.site_id + 1 AS from_idx,
    CASE WHEN cb > 0 THEN coalesce(p + 1, 0) ELSE 0 END AS to_idx, CASE WHEN cb > 0 THEN cb - 1 ELSE q - 1 END AS fm
  FROM clu c JOIN nb ON nb.chrom = c.chrom AND nb.h1 = c.h1 AND nb.h2 = c.h2 AND nb.site_id = cb WHERE c.site_id + 1 >= 2),
bwd AS (SELECT * FROM (SELECT b.chrom, h1, h2, b.from_idx,
    CASE WHEN y.cm - x.cm >= 1.0 AND fm - b.to_idx >= 19 THEN -1 WHEN y.cm - x.cm >= 0.5 AND fm - b.to_idx >= 9 THEN b.to_idx END AS to_idx
  FROM bwd0 b JOIN pos x ON x.site_id = b.to_idx JOIN pos y ON y.site_id = fm) WHERE to_idx IS NOT NULL)"""

_CHAIN = """
ch AS (
  SELECT chrom, h1, h2, s AS s0, e AS e0, s, e FROM seeds
  UNION
  SELECT ch.chrom, ch.h1, ch.h2, s0, e0, coalesce(b.to_idx, ch.s), coalesce(f.to_idx, ch.e)
  FROM ch LEFT JOIN bwd b ON b.chrom = ch.chrom AND b.h1 = ch.h1 AND b.h2 = ch.h2 AND b.from_idx = ch.s
    LEFT JOIN fwd f ON f.chrom = ch.chrom AND f.h1 = ch.h1 AND f.h2 = ch.h2 AND f.from_idx = ch.e
  WHERE b.to_idx IS NOT NULL OR f.to_idx IS NOT NULL),
fin AS (SELECT DISTINCT chrom, h1, h2, s, e FROM (SELECT chrom, h1, h2, min(s) AS s, max(e) AS e FROM ch GROUP BY chrom, h1, h2, s0, e0) WHERE s >= 0),
segs AS (SELECT f.chrom, h1, h2, s AS start_idx, e AS end_idx, a.bp AS start_bp, b.bp AS end_bp, b.cm - a.cm AS length_cm
  FROM fin f JOIN pos a ON a.site_id = s JOIN pos b ON b.site_id = e WHERE b.cm - a.cm >= 1.5 AND h1 // 2 <> h2 // 2)"""


def _smooth(panel: str, gap: int, name: str = "dec") -> str:
    """Decisions of the blocks around ``gap`` sites, by strings of flanking alleles."""
    return f"""
seq AS (SELECT chrom, hap_id, string_agg(allele::VARCHAR, '' ORDER BY site_id) AS q, count(*) AS n FROM {panel} GROUP BY ALL),
flank AS (SELECT chrom, hap_id, eff, substring(q, eff - 9, 10) AS l, substring(q, eff + {gap} + 1, 10) AS r, q
  FROM (SELECT *, unnest(range(10, n - {gap} - 10 + 1)) AS eff FROM seq)),
blk AS (SELECT *, count(*) OVER b AS size FROM flank WINDOW b AS (PARTITION BY chrom, eff, l, r)),
gaps AS (SELECT chrom, eff, k, hap_id, eff + k AS site_id, l, r, size, substring(q, (eff + k + 1)::BIGINT, 1)::INT AS allele FROM blk, range({gap}) t(k) WHERE size >= 4),
ones AS (SELECT *, sum(allele) OVER (PARTITION BY chrom, eff, k, l, r)::BIGINT AS ones FROM gaps),
{name} AS (SELECT chrom, site_id, hap_id, eff, allele, CASE WHEN size - ones < ones THEN 1 ELSE 0 END AS value FROM ones WHERE least(ones, size - ones) <= size * 0.25),
edits AS (SELECT chrom, site_id, hap_id, any_value(allele) AS old, arg_max(value, eff) AS new FROM {name} GROUP BY chrom, site_id, hap_id HAVING any_value(allele) <> arg_max(value, eff)),
rate AS (SELECT (SELECT count(*) FROM edits) AS n, (SELECT count(*) FROM {panel}) AS m),
smoothed AS (SELECT p.chrom, p.site_id, p.hap_id, CASE WHEN n > 0 AND n < 0.001 * m THEN p.allele ELSE coalesce(new, p.allele) END AS allele
  FROM {panel} p LEFT JOIN edits USING (chrom, site_id, hap_id), rate)"""


_TRUTH = """
tree0 AS (SELECT chrom, site_id // 50 AS block, min(bp) AS tree_left FROM sites GROUP BY ALL),
used AS (
  SELECT min(tree_left) AS tree_left, 0::BIGINT AS place FROM tree0
  UNION ALL
  SELECT t, t FROM (SELECT (SELECT min(t.tree_left) FROM tree0 t WHERE t.tree_left > (SELECT min(tree_left) FROM tree0) AND t.tree_left - u.place >= 5000 AND t.tree_left > u.tree_left) AS t FROM used u) WHERE t IS NOT NULL),
fb AS (SELECT DISTINCT chrom, site_id // 50 AS block, hap_id, f FROM founder),
mrca AS (SELECT a.chrom, a.hap_id AS h1, b.hap_id AS h2, tree_left, CASE WHEN a.f = b.f THEN a.f ELSE 1000 + a.block END AS m
  FROM fb a JOIN fb b ON a.chrom = b.chrom AND a.block = b.block AND a.hap_id < b.hap_id JOIN tree0 t ON t.block = a.block SEMI JOIN used USING (tree_left)),
chg AS (SELECT * FROM (SELECT *, lag(m) OVER (PARTITION BY chrom, h1, h2 ORDER BY tree_left) AS pm FROM mrca) WHERE pm IS NULL OR pm <> m),
span AS (SELECT chrom, h1, h2, tree_left AS start_bp, coalesce(lead(tree_left) OVER (PARTITION BY chrom, h1, h2 ORDER BY tree_left), (SELECT max(bp) FROM sites)) AS end_bp FROM chg),
spot AS (SELECT DISTINCT chrom, bp FROM (SELECT chrom, start_bp AS bp FROM span UNION ALL SELECT chrom, end_bp FROM span)),
spotcm AS ({spotcm}),
truth AS (SELECT s.chrom, h1, h2, start_bp, end_bp, a.cm AS cm_start, b.cm AS cm_end FROM span s
  JOIN spotcm a ON a.bp = start_bp JOIN spotcm b ON b.bp = end_bp WHERE b.cm - a.cm >= 1.0 AND h1 // 2 <> h2 // 2),
rep AS (SELECT h1 AS id1, h2 AS id2, start_bp::DOUBLE AS start, end_bp::DOUBLE AS "end" FROM segs),
tru AS (SELECT h1 AS id1, h2 AS id2, start_bp::DOUBLE AS start, end_bp::DOUBLE AS "end" FROM truth)""".replace("{spotcm}", _at("spot"))


def _cov(q: str, o: str, how: str) -> str:
    return f"""(SELECT q.id1, q.id2, q.start, q."end", coalesce({how}(CASE WHEN o.id1 IS NOT NULL THEN greatest(0.0, least(q."end", o."end") - greatest(q.start, o.start)) / (q."end" - q.start) END), 0.0) AS cov
  FROM {q} q LEFT JOIN {o} o ON q.id1 = o.id1 AND q.id2 = o.id2 GROUP BY q.id1, q.id2, q.start, q."end")"""


_FEATURES = f"""
chunk AS (SELECT s.*, c, start_idx + (c * (end_idx - start_idx + 1)) // 10 AS lo, start_idx + ((c + 1) * (end_idx - start_idx + 1)) // 10 AS hi FROM segs s, range(10) t(c)),
wrong AS (SELECT g.h1, g.h2, start_idx, end_idx, c, count(*) AS n FROM chunk g JOIN mm ON mm.h1 = g.h1 AND mm.h2 = g.h2
  AND site_id >= lo AND site_id < hi AND site_id < end_idx GROUP BY ALL),
mended AS (SELECT g.h1, g.h2, start_idx, end_idx, c, count(*) AS n FROM chunk g JOIN edits d ON (d.hap_id = g.h1 OR d.hap_id = g.h2)
  AND site_id >= lo AND site_id < hi AND site_id < end_idx GROUP BY ALL),
long AS (SELECT g.chrom, g.h1, g.h2, g.start_idx, g.end_idx, g.c, coalesce(b.bp - a.bp, 0)::DOUBLE AS phys_len, coalesce(b.cm - a.cm, 0.0) AS gen_len,
    coalesce(w.n, 0)::DOUBLE AS n_mismatches, coalesce(m.n, 0)::DOUBLE AS n_corrections
  FROM chunk g LEFT JOIN pos a ON a.site_id = lo AND hi > lo LEFT JOIN pos b ON b.site_id = hi - 1 AND hi > lo
    LEFT JOIN wrong w USING (h1, h2, start_idx, end_idx, c) LEFT JOIN mended m USING (h1, h2, start_idx, end_idx, c)),
wide AS (SELECT chrom, h1, h2, start_idx, end_idx, {", ".join(f"max({n}) FILTER (c = {c}) AS {n}_{c}" for c in range(10) for n in NAMES)} FROM long GROUP BY ALL)"""

_REMAINDER = """
chunk AS (SELECT s.*, c, start_idx + c * ((end_idx - start_idx + 1) // 9) AS lo,
  CASE WHEN c = 9 THEN end_idx + 1 ELSE start_idx + (c + 1) * ((end_idx - start_idx + 1) // 9) END AS hi FROM segs s, range(10) t(c)),
wrong AS (SELECT g.h1, g.h2, start_idx, end_idx, c, count(*) AS n FROM chunk g JOIN mm ON mm.h1 = g.h1 AND mm.h2 = g.h2 AND site_id >= lo AND site_id < hi GROUP BY ALL),
mended AS (SELECT g.h1, g.h2, start_idx, end_idx, c, count(*) AS n FROM chunk g JOIN edits d ON (d.hap_id = g.h1 OR d.hap_id = g.h2) AND site_id >= lo AND site_id < hi GROUP BY ALL)
SELECT g.chrom, g.h1, g.h2, g.start_idx, g.end_idx, g.c::INT AS chunk, round(coalesce(e.bp - a.bp, 0)::DOUBLE, 6) AS phys_len, round(coalesce(b.cm - a.cm, 0.0), 6) AS gen_len,
  coalesce(w.n, 0)::DOUBLE AS n_mismatches, coalesce(m.n, 0)::DOUBLE AS n_corrections
FROM chunk g LEFT JOIN pos a ON a.site_id = lo AND hi > lo LEFT JOIN pos b ON b.site_id = hi - 1 AND hi > lo
  LEFT JOIN pos e ON e.site_id = least(hi, (SELECT max(site_id) FROM pos)) AND hi > lo
  LEFT JOIN wrong w USING (h1, h2, start_idx, end_idx, c) LEFT JOIN mended m USING (h1, h2, start_idx, end_idx, c)"""

_F = feature_names()
_STATS = "stats AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) < 1e-8 THEN 1.0 ELSE stddev_pop({n}) END AS s_{n}" for n in _F) + " FROM wide)"


def _network(single: bool = False) -> str:
    """The network's layers as joins of long tables, with the rule of the weights spelled out (in single precision, as files have them)."""
    kind = "DOUBLE::FLOAT::DOUBLE" if single else "DOUBLE"
    dims, parts = (40, 36, 18, 9, 3, 1), []
    x = " UNION ALL ".join(f"SELECT h1, h2, start_idx, end_idx, {i} AS i, ({n} - m_{n}) / s_{n} AS v FROM wide, stats" for i, n in enumerate(_F))
    parts.append(f"x0 AS ({x})")
    for k, n in enumerate(dims[1:]):
        y = f"sum(v * (((i * 7 + o * 13 + {k} * 5) % 11 - 5) / 50.0::DOUBLE)::{kind}) + ((((any_value(o) * 3 + {k}) % 5) - 2) / 10.0::DOUBLE)::{kind}"
        out = f"CASE WHEN {y} > 0 THEN {y} ELSE 0.01 * ({y}) END" if k < 4 else f"1 / (1 + exp(-({y})))"
        parts.append(f"x{k + 1} AS (SELECT h1, h2, start_idx, end_idx, o AS i, {out} AS v FROM x{k}, range({n}) t(o) GROUP BY h1, h2, start_idx, end_idx, o)")
    return ",\n".join(parts)


_TREES = """1 / (1 + exp(-(
  CASE WHEN n_mismatches_0 < 0.5 THEN -0.6 WHEN n_mismatches_1 < 1.5 THEN -0.5 ELSE 0.75 END
  + CASE WHEN n_mismatches_2 < 0.5 THEN -0.25 ELSE 0.5 END)))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip("\n, ") + "\n" for p in parts)


def oracle_sql() -> dict[str, str]:
    return _sql()[0]


def file_sql() -> dict[str, str]:
    """Of the queries that go through files, and of those over the grown panel."""
    return _sql()[1]


def _sql() -> tuple[dict[str, str], dict[str, str]]:
    counts = _COUNTS.format(panel="panel")
    at = f"pos AS ({_at('sites')})"
    located = (_BASE, _MAP, at)
    run = (*located, _mm("panel"), _RUNS)
    seg = (*run, _seeds(), _STEPS, _CHAIN)
    smooth1, smooth3 = _smooth("panel", 1), _smooth("panel", 3)
    feat = (*seg, smooth1, _FEATURES)
    truth = (*seg, _TRUTH)
    r = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
    kept = """kept AS (SELECT c.chrom, (row_number() OVER (PARTITION BY c.chrom ORDER BY bp, site_id) - 1) AS site_id, site_id AS orig_site_id, bp, mac, n_alt, n_haps
      FROM counts c JOIN sites USING (chrom, site_id) WHERE mac >= 2)"""
    kind = """CASE WHEN n_alt = 0 THEN 'MONO_REF' WHEN n_alt = n_haps THEN 'MONO_ALT' WHEN n_alt <= (n_haps // 2) // 32 THEN 'SPARSE' ELSE 'DENSE' END"""
    named = """SELECT a.sample_id AS id1, (h1 % 2 + 1)::BIGINT AS hap1, b.sample_id AS id2, (h2 % 2 + 1)::BIGINT AS hap2, chrom, start_bp, end_bp, printf('%.6f', length_cm) AS cm
      FROM segs JOIN samples a ON a.sample_idx = h1 // 2 JOIN samples b ON b.sample_idx = h2 // 2"""
    draw = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    loci = lambda rates: f"""err AS (SELECT * FROM (SELECT sample_idx, site_id, rate, n,
        row_number() OVER (PARTITION BY sample_idx ORDER BY {draw.format("'error:site:' || sample_idx || ':' || site_id")}, site_id) AS nth
        FROM (SELECT sample_idx, list_extract({rates}, {draw.format("'error:rate:' || sample_idx")} % len({rates}) + 1) AS rate FROM samples), sites, (SELECT count(*) AS n FROM sites))
        WHERE nth <= floor(n * rate)),
      loci AS (SELECT site_id, 2 * sample_idx + {draw.format("'error:hap:' || sample_idx || ':' || site_id")} % 2 AS hap_id FROM err)"""  # noqa: E731
    pipe = (_BASE, _smooth("panel", 1), _COUNTS.format(panel="smoothed"), kept, _MAP,
            f"pos AS ({_at('(SELECT chrom, site_id, bp FROM kept)')})",
            "dense AS (SELECT k.chrom, k.site_id, hap_id, allele FROM smoothed s JOIN kept k ON k.chrom = s.chrom AND k.orig_site_id = s.site_id)",
            _mm("dense"), _RUNS, _seeds(), _STEPS, _CHAIN)
    rows = {
        "panel_allele_counts": _with(_BASE, counts) + "SELECT * FROM counts",
        "panel_mac_filter": _with(_BASE, counts, kept) + f"SELECT chrom, site_id, orig_site_id, bp, mac, {kind} AS site_type FROM kept",
        "panel_site_types": _with(_BASE, _COUNTS.format(panel="clean")) + f"SELECT chrom, site_id, {kind} AS site_type FROM counts",
        "panel_pack_sites": _with(_BASE) + "SELECT chrom, site_id, hap_id // 32 AS word, sum(allele::BIGINT << (hap_id % 32)::INT)::BIGINT AS bits FROM panel GROUP BY ALL",
        "panel_pack_haplotypes": _with(_BASE) + "SELECT chrom, hap_id, site_id // 32 AS word, sum(allele::BIGINT << (site_id % 32)::INT)::BIGINT AS bits FROM panel GROUP BY ALL",
        "panel_transpose": _with(_BASE) + "SELECT chrom, hap_id, site_id // 32 AS word, sum(allele::BIGINT << (site_id % 32)::INT)::BIGINT AS bits FROM panel GROUP BY ALL",
        "panel_slices": _with(_BASE) + "SELECT site_id, hap_id, allele FROM panel WHERE site_id = 17 UNION ALL SELECT site_id, hap_id, allele FROM panel WHERE hap_id = 7",
        "panel_common_snps": _with(_BASE, counts) + "SELECT chrom, site_id, 'A' AS ref, 'C' AS alt FROM counts WHERE site_id % 5 <> 0 AND mac::DOUBLE / n_haps >= 0.3",
        "gmap_interpolate": _with(*located) + f"SELECT chrom, site_id, bp, {r('cm')} FROM pos",
        "gmap_clamp": _with(_BASE, _MAP, f"pos AS ({_at('sites', True)})") + f"SELECT chrom, site_id, bp, {r('cm')} FROM pos",
        "gmap_site_index": _with(_BASE, _MAP) + """SELECT k.chrom, k.bp + 37 AS bp,
            coalesce((SELECT min(site_id) FROM sites s WHERE s.bp >= k.bp + 37), (SELECT max(site_id) FROM sites)) AS first_site,
            coalesce((SELECT max(site_id) FROM sites s WHERE s.bp <= k.bp + 37), (SELECT min(site_id) FROM sites)) AS last_site FROM knots k""",
        "map_convert": _with(_BASE, _MAP) + "SELECT chrom, bp, printf('%.3f', cm)::DOUBLE AS cm FROM knots",
        "smooth_blocks": _with(_BASE, smooth1) + "SELECT chrom, eff, hap_id, size, ones FROM ones",
        "smooth_block_counts": _with(_BASE, smooth1) + "SELECT chrom, eff, count(DISTINCT (l, r)) AS n_blocks, count(*) AS n_haps FROM ones GROUP BY ALL",
        "smooth_corrections": _with(_BASE, smooth1) + "SELECT * FROM edits",
        "smooth_wide_gap": _with(_BASE, smooth3) + """SELECT chrom, site_id, hap_id, eff, old, value AS new FROM (
            SELECT *, coalesce(lag(value) OVER (PARTITION BY chrom, site_id, hap_id ORDER BY eff), allele) AS old FROM dec) WHERE old <> value""",
        "smooth_panel": _with(_BASE, smooth1, _COUNTS.format(panel="smoothed")) + "SELECT * FROM counts",
        "inject_errors": _with(_BASE, loci("[0.01::DOUBLE]")) + """SELECT hap_id, sum(CASE WHEN l.site_id IS NULL THEN allele ELSE 1 - allele END)::BIGINT AS n_alt
            FROM clean LEFT JOIN loci l USING (site_id, hap_id) GROUP BY hap_id""",
        "inject_varied_errors": _with(_BASE, loci("[0.0::DOUBLE, 0.005, 0.01, 0.02]")) + "SELECT hap_id, count(*) AS n_flipped, sum(site_id)::BIGINT AS sum_sites FROM loci GROUP BY hap_id",
        "pair_mismatches": _with(_BASE, _mm("panel")) + "SELECT chrom, h1, h2, count(*) AS n_mismatches, min(site_id) AS first_site, max(site_id) AS last_site FROM mm GROUP BY ALL",
        "pair_mismatch_bits": _with(_BASE) + """SELECT a.chrom, a.hap_id AS h1, b.hap_id AS h2, sum((a.allele <> b.allele)::INT)::BIGINT AS n_mismatches
            FROM panel a JOIN panel b ON a.chrom = b.chrom AND a.site_id = b.site_id AND a.hap_id < b.hap_id GROUP BY ALL""",
        "exact_runs": _with(*run) + "SELECT * FROM runs WHERE e - s + 1 >= 20",
        "block_candidates": _with(_BASE, """words AS (SELECT chrom, hap_id, site_id // 10 AS b, string_agg(allele::VARCHAR, '' ORDER BY site_id) AS w
            FROM panel GROUP BY ALL HAVING count(*) = 10)""") + "SELECT DISTINCT x.chrom, x.hap_id AS h1, y.hap_id AS h2 FROM words x JOIN words y ON x.chrom = y.chrom AND x.b = y.b AND x.w = y.w AND x.hap_id < y.hap_id",
        "ibd_seeds": _with(*run, _seeds()) + "SELECT * FROM seeds",
        "ibd_seeds_relaxed": _with(*run, _seeds(0)) + "SELECT * FROM seeds",
        "seed_merge": _with(*run) + """SELECT chrom, h1, h2, min(s) AS s, max(e) AS e FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY chrom, h1, h2 ORDER BY s, e) AS island FROM (
              SELECT chrom, h1, h2, s, e + 1 AS e, CASE WHEN s > max(e + 1) OVER (PARTITION BY chrom, h1, h2 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh
              FROM runs WHERE e - s + 1 >= 5)) GROUP BY chrom, h1, h2, island""",
        "ibd_extend_forward": _with(*run, _STEPS) + "SELECT * FROM fwd",
        "ibd_extend_backward": _with(*run, _STEPS) + "SELECT * FROM bwd",
        "ibd_segments": _with(*seg) + f"SELECT chrom, h1, h2, start_idx, end_idx, start_bp, end_bp, {r('length_cm')} FROM segs",
        "ibd_pipeline": _with(*pipe) + f"SELECT chrom, h1, h2, start_bp, end_bp, {r('length_cm')} FROM segs",
        "segments_filter": _with(*seg) + f"SELECT chrom, h1, h2, start_bp, end_bp, {r('length_cm')} FROM segs WHERE length_cm >= 2.0",
        "segments_sort": _with(*seg) + "SELECT h1, h2, start_idx, end_idx FROM segs ORDER BY 1, 2, 3, 4",
        "segments_dedup": _with(*seg) + "SELECT DISTINCT h1, h2, start_bp, end_bp FROM segs",
        "segments_per_sample": _with(*seg) + "SELECT count(*) AS n_segments, count(*)::DOUBLE / (SELECT count(*) FROM samples) AS per_sample FROM segs",
        "segments_tsv": _with(*seg) + "SELECT h1 // 2 AS sample1, h1 % 2 AS hap1, h2 // 2 AS sample2, h2 % 2 AS hap2, start_bp, end_bp, printf('%.6f', length_cm) AS cm FROM segs",
        "segments_named": _with(*seg) + named,
        "segments_normalized": _with(*seg) + "SELECT h1 AS id1, h2 AS id2, start_bp::DOUBLE AS start, end_bp::DOUBLE AS end, round(length_cm, 6) AS cm FROM segs WHERE round(length_cm, 6) >= 2.0",
        "vcf_lines": _with(_BASE) + """SELECT site_id, md5(concat_ws(chr(9), chrom, bp::VARCHAR, '.', 'A', 'C', '.', 'PASS', '.', 'GT', gt)) AS line_md5 FROM (
            SELECT chrom, site_id, string_agg(a || '|' || b, chr(9) ORDER BY k) AS gt FROM (
              SELECT chrom, site_id, hap_id // 2 AS k, max(allele) FILTER (hap_id % 2 = 0) AS a, max(allele) FILTER (hap_id % 2 = 1) AS b FROM panel GROUP BY ALL) GROUP BY ALL) JOIN sites USING (chrom, site_id)""",
        "features_chunked": _with(*feat) + f"SELECT chrom, h1, h2, start_idx, end_idx, {r(*_F)} FROM wide",
        "features_chunked_py": _with(*seg, smooth1, _REMAINDER.split("\nSELECT g.chrom")[0]) + "SELECT g.chrom" + _REMAINDER.split("\nSELECT g.chrom")[1],
        "feature_stats": _with(*feat, _STATS) + " UNION ALL ".join(f"SELECT '{n}' AS name, round(m_{n}, 6) AS mean, round(s_{n}, 6) AS std FROM stats" for n in _F),
        "features_scaled": _with(*feat, _STATS) + "SELECT chrom, h1, h2, start_idx, end_idx, " + ", ".join(
            f"round(({n} - m_{n}) / s_{n}, 6) AS {n}" for n in ("phys_len_0", "gen_len_3", "n_mismatches_5", "n_corrections_9")) + " FROM wide, stats",
        "mlp_score": _with(*feat, _STATS, _network()) + "SELECT '20' AS chrom, h1, h2, start_idx, end_idx, round(v, 6) AS score FROM x5",
        "tree_score": _with(*feat) + f"SELECT chrom, h1, h2, start_idx, end_idx, round({_TREES}, 6) AS score FROM wide",
        "score_filter": _with(*feat) + f"SELECT chrom, h1, h2, start_idx, end_idx FROM wide WHERE {_TREES} < 0.5",
        "score_summary": _with(*feat) + f"""SELECT count(*) AS processed, count(*) FILTER ({_TREES} < 0.5) AS kept, count(*) FILTER (NOT {_TREES} < 0.5) AS filtered,
            round(100.0::DOUBLE * count(*) FILTER ({_TREES} < 0.5) / count(*), 6) AS kept_percent FROM wide""",
        "dataset_relabel": _with(*truth) + f"SELECT id1, id2, start, \"end\", CASE WHEN cov <= 0.5 THEN 1 ELSE 0 END AS classification FROM {_cov('rep', 'tru', 'max')}",
        "mrca_segments": _with(_BASE, _MAP, _TRUTH.split(",\nrep AS")[0]) + f"SELECT chrom, h1, h2, start_bp, end_bp, {r('cm_start', 'cm_end')} FROM truth",
        "eval_coverage": _with(*truth) + f"SELECT id1, id2, start, \"end\", {r('cov')} FROM {_cov('rep', 'tru', 'max')}",
        "eval_accuracy": _with(*truth) + f"SELECT round(avg((cov >= 0.5)::INT::DOUBLE), 6) AS accuracy FROM {_cov('rep', 'tru', 'max')}",
        "eval_length_accuracy": _with(*truth) + f"SELECT round(avg(cov), 6) AS length_accuracy FROM {_cov('rep', 'tru', 'max')}",
        "eval_power": _with(*truth) + f"SELECT round(avg(cov), 6) AS power FROM {_cov('tru', 'rep', 'sum')}",
        "eval_accum_power": _with(*truth, _merged("rep")) + f"SELECT round(avg(cov), 6) AS accumulative_power FROM {_cov('tru', 'whole', 'sum')}",
        "eval_false_split": _with(*truth) + f"SELECT cov <= 0.5 AS is_false, count(*) AS n FROM {_cov('rep', 'tru', 'max')} GROUP BY ALL",
        "merge_intervals": _with(*seg, 'rep AS (SELECT h1 AS id1, h2 AS id2, start_bp::DOUBLE AS start, end_bp::DOUBLE AS "end" FROM segs)', _merged("rep")) + "SELECT * FROM whole",
        "correction_confusion": _with(_BASE, smooth1) + """SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM (
            SELECT count(*) FILTER (o.allele <> w.allele) AS errors, count(*) FILTER (s.allele <> w.allele) AS corrections, count(*) FILTER (s.allele = w.allele) AS non_corrections,
              count(*) FILTER (s.allele <> w.allele AND o.allele = s.allele) AS tp, count(*) FILTER (s.allele <> w.allele AND o.allele <> s.allele) AS fp,
              count(*) FILTER (s.allele = w.allele AND o.allele <> s.allele) AS fn, count(*) FILTER (s.allele = w.allele AND o.allele = s.allele) AS tn
            FROM clean o JOIN panel w USING (chrom, site_id, hap_id) JOIN smoothed s USING (chrom, site_id, hap_id))""",
        "correction_count": _with(_BASE, smooth1) + "SELECT count(*) AS n_changed FROM edits",
    }
    return rows, _file_sql(rows, located, run, seg, feat, truth, smooth1, pipe, kept, loci, named)


# A panel with two haplotypes for each supplier, and founders an eighth of the haplotypes.
_GROWN = """
haps AS (SELECT 2 * s_suppkey::BIGINT + i AS hap_id FROM supplier, (VALUES (0), (1)) t(i)),
nf AS (SELECT greatest(5, count(*) // 8)::BIGINT AS nf FROM haps),
sites AS (SELECT '20' AS chrom, site_id, 1000 + 100 * site_id + w % 50 AS bp FROM (SELECT p_partkey % 2000 AS site_id, sum(p_size)::BIGINT AS w FROM part GROUP BY ALL)),
founder AS (SELECT chrom, site_id, hap_id, (hap_id * 7 + (site_id // 50) * (1 + hap_id % 13)) % nf AS f FROM sites, haps, nf),
clean AS (SELECT chrom, site_id, hap_id,
  (((f * f * 31 + f * site_id * 17 + site_id * site_id * 13 + (site_id // 7) * f * f) % 1009) % 2)::INT AS allele FROM founder),
panel AS (SELECT chrom, site_id, hap_id, CASE WHEN (hap_id * 31 + site_id * 17) % 397 = 0 THEN 1 - allele ELSE allele END AS allele FROM clean),
knots AS (SELECT chrom, bp, bp * 0.0003::DOUBLE AS cm FROM sites WHERE site_id % 40 = 0)"""


def _file_sql(rows, located, run, seg, feat, truth, smooth1, pipe, kept, loci, named) -> dict[str, str]:
    """What the files hold that the queries write and read again."""
    counts = _COUNTS.format(panel="panel")
    both = "kept AS (SELECT c.chrom, (row_number() OVER (PARTITION BY c.chrom ORDER BY bp, site_id) - 1) AS site_id, site_id AS orig_site_id, bp FROM counts c JOIN sites USING (chrom, site_id) WHERE mac >= 2 AND site_id % 5 <> 0)"
    key = "chrom, h1, h2, start_idx, end_idx"
    keyed = "h1 // 2 AS id1, h1 % 2 AS hap1, h2 // 2 AS id2, h2 % 2 AS hap2, start_bp AS start, end_bp AS \"end\""
    placed = "JOIN (SELECT h1, h2, start_idx, end_idx, start_bp, end_bp FROM segs) USING (h1, h2, start_idx, end_idx)"
    total = " + ".join(f"gen_len_{c}" for c in range(10))
    net = (_STATS, _network())
    moved = "moved AS (SELECT k.site_id, hap_id FROM edits e JOIN kept k ON k.orig_site_id = e.site_id)"
    scaled = "scaled AS (SELECT h1, h2, start_idx, end_idx, " + ", ".join(f"({n} - m_{n}) / s_{n} AS {n}" for n in _F) + " FROM wide, stats)"
    again = [_BASE, _smooth("panel", 1)]
    # the grown panel: candidates agree on four blocks of four sites in a row
    grown = (_GROWN, _MAP[_MAP.index("tips AS"):], f"pos AS ({_at('sites')})")
    grown_run = (*grown, _mm("panel"), _RUNS)
    words = """words AS (SELECT chrom, hap_id, site_id // 4 AS b, string_agg(allele::VARCHAR, '' ORDER BY site_id) AS w FROM panel GROUP BY ALL HAVING count(*) = 4),
      wide4 AS (SELECT chrom, hap_id, b, lead(b, 3) OVER o AS z, w || lead(w) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o AS w FROM words WINDOW o AS (PARTITION BY chrom, hap_id ORDER BY b))"""
    return {
        "vcf_scan": _with(_BASE) + "SELECT chrom, site_id, bp, hap_id, allele FROM panel JOIN sites USING (chrom, site_id)",
        "vcf_blocks": _with(_BASE) + "SELECT chrom, site_id, bp, hap_id, allele FROM panel JOIN sites USING (chrom, site_id)",
        "vcf_packed_counts": _with(_BASE, counts) + "SELECT chrom, site_id, n_alt, n_haps, mac FROM counts",
        "vcf_turned": _with(_BASE) + "SELECT chrom, hap_id, site_id // 60 AS block, sum(allele::BIGINT << (site_id % 60)::INT)::BIGINT AS bits FROM panel GROUP BY ALL",
        "vcf_scan_mac": _with(_BASE, counts, both) + "SELECT k.chrom, k.site_id, bp, hap_id, allele FROM panel p JOIN kept k ON k.orig_site_id = p.site_id",
        "vcf_smoothed": rows["smooth_panel"],
        "map_plink": rows["map_convert"],
        "segments_binary": _with(*seg) + "SELECT h1, h2, start_idx, end_idx, start_bp, end_bp, round(length_cm::FLOAT::DOUBLE, 6) AS length_cm FROM segs",
        "segments_indexed": rows["ibd_segments"],
        "segments_text": f"SELECT id1, hap1::INT AS hap1, id2, hap2::INT AS hap2, chrom, start_bp, end_bp, cm::DOUBLE AS cm FROM ({_with(*seg) + named})",
        "segments_union": f"SELECT sample1::INT AS sample1, hap1::INT AS hap1, sample2::INT AS sample2, hap2::INT AS hap2, start_bp, end_bp, cm::DOUBLE AS cm FROM ({rows['segments_tsv']})",
        "segments_bucketed": "SELECT * FROM " + ", ".join(f"({rows[n]})" for n in ("eval_accuracy", "eval_length_accuracy", "eval_power", "eval_accum_power")),
        "dataset_file": _with(*feat) + f"SELECT {keyed}, CASE WHEN {_TREES} > 0.5 THEN 3 ELSE 2 END::BIGINT AS classification, {', '.join(f'round({n}, 6) AS {n}' for n in _F)} FROM wide {placed}",
        "dataset_segments": _with(*feat) + f"""SELECT h1 // 2 AS id1, h1 % 2 + 1 AS hap1, h2 // 2 AS id2, h2 % 2 + 1 AS hap2, '20' AS chrom, start_bp AS start, end_bp AS "end", round({total}, 3) AS cm
            FROM wide {placed} WHERE NOT {_TREES} > 0.5""",
        "error_log": _with(_BASE, loci("[0.0::DOUBLE, 0.005, 0.01, 0.02]")) + """SELECT sample_id || coalesce(string_agg(chr(9) || l.site_id, '' ORDER BY l.site_id), '') AS value
            FROM samples LEFT JOIN loci l ON l.hap_id // 2 = sample_idx GROUP BY sample_idx, sample_id""",
        "truth_cutoff": _with(_BASE, _MAP, _TRUTH.split(",\nrep AS")[0]) + """SELECT h1 AS id1, h2 AS id2, start_bp::DOUBLE AS start, end_bp::DOUBLE AS "end", round(cm_end - cm_start, 6) AS cm
            FROM truth WHERE cm_end - cm_start >= 1.5""",
        "network_file": _with(*feat, _STATS, _network(single=True)) + "SELECT '20' AS chrom, h1, h2, start_idx, end_idx, round(v, 6) AS score FROM x5",
        "trees_file": rows["tree_score"],
        "both_predictions": _with(*feat, *net) + f"""SELECT w.chrom, w.h1, w.h2, w.start_idx, w.end_idx, (p > 0.5)::INT AS xgb_pred, (v > 0.5)::INT AS nn_pred
            FROM (SELECT {key}, {_TREES} AS p FROM wide) w JOIN x5 USING (h1, h2, start_idx, end_idx)""",
        "features_scaled_all": _with(*feat, _STATS) + f"SELECT {key}, " + ", ".join(f"round(({n} - m_{n}) / s_{n}, 6) AS {n}" for n in _F) + " FROM wide, stats",
        "program_filtered": f"""SELECT id1, hap1::INT AS hap1, id2, hap2::INT AS hap2, chrom, start_bp, end_bp, cm::DOUBLE AS cm
            FROM ({_with(*pipe, moved, _FEATURES.replace('JOIN edits d', 'JOIN moved d'), _STATS, scaled)
                  + named.replace('FROM segs', f'FROM segs JOIN (SELECT h1, h2, start_idx, end_idx FROM scaled WHERE {_TREES} < 0.5) USING (h1, h2, start_idx, end_idx)')})""",
        "run_statistics": _with(*pipe) + """SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM pos) AS markers, count(*) AS segments,
            round(count(*)::DOUBLE / (SELECT count(*) FROM samples), 6) AS segments_per_sample FROM segs""",
        "corrections_by_site": _with(*again) + "SELECT site_id, hap_id, old, new FROM edits ORDER BY 1, 2",
        "corrections_by_haplotype": _with(*again) + "SELECT hap_id, site_id, old, new FROM edits ORDER BY 1, 2",
        "smooth_again": "SELECT 0::BIGINT AS n_changed, 0::BIGINT AS n_corrections, true AS smooth_already",
        "seeds_closeout": _with(*run) + """SELECT r.chrom, h1, h2, s, e FROM runs r JOIN pos a ON a.site_id = s JOIN pos b ON b.site_id = e, size
            WHERE b.cm - a.cm >= 0.3 AND e = n - 1 AND e - s + 1 = 30""",
        "grown_candidates": _with(_GROWN, words) + """SELECT DISTINCT x.chrom, x.hap_id AS h1, y.hap_id AS h2 FROM wide4 x JOIN wide4 y
            ON x.chrom = y.chrom AND x.b = y.b AND x.w = y.w AND x.hap_id < y.hap_id WHERE x.z = x.b + 3""",
        "grown_pairs": _with(*grown_run, _seeds()) + "SELECT chrom, h1, h2, count(*) AS n_seeds FROM seeds GROUP BY ALL",
        "grown_runs": _with(*grown_run) + "SELECT * FROM runs WHERE e - s + 1 >= 20",
        "grown_segments": _with(*grown_run, _seeds(), _STEPS, _CHAIN) + f"SELECT {key}, start_bp, end_bp, round(length_cm, 6) AS length_cm FROM segs",
    }


def _merged(name: str) -> str:
    return f"""whole AS (SELECT id1, id2, min(start) AS start, max("end") AS "end" FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY id1, id2 ORDER BY start, "end") AS island FROM (
        SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY id1, id2 ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM {name}))
      GROUP BY id1, id2, island)"""
