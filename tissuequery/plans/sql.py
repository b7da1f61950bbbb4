"""The same queries in SQL, over the same tables: a text for each, put together from shared parts."""

from __future__ import annotations

CELLS = """cells AS (SELECT vec_id AS cell_idx, 'c' || vec_id AS cell_id, 1000 * embedding[1]::DOUBLE AS x, 1000 * embedding[2]::DOUBLE AS y,
  10 * embedding[3]::DOUBLE AS umap_x, 10 * embedding[4]::DOUBLE AS umap_y, label::INT AS cluster, 'type_' || (label % 5) AS cell_type, 'cond ' || (vec_id % 3) AS condition FROM embeddings)"""
GENES = "genes AS (SELECT i AS gene_idx, 'G' || lpad(i::VARCHAR, 2, '0') AS gene FROM range(64) r(i))"
EXPRESSION = "expression AS (SELECT vec_id AS cell_idx, gene, embedding[gene_idx + 1]::DOUBLE AS value FROM embeddings, genes WHERE embedding[gene_idx + 1] > 0)"
DENSE = "dense AS (SELECT vec_id AS cell_idx, gene, greatest(embedding[gene_idx + 1]::DOUBLE, 0) AS value FROM embeddings, genes)"
NETWORK = """network AS (SELECT a.gene AS source, b.gene AS target, CASE WHEN h < 10 THEN 'grn' WHEN h < 16 THEN 'lr' ELSE 'nichenet' END AS edge_type, h / 97.0::DOUBLE AS weight, edge_order
  FROM (SELECT i * 64 + j AS edge_order, i, j, (7 * i + 13 * j) % 97 AS h FROM range(64) r(i), range(64) s(j)) p JOIN genes a ON a.gene_idx = i JOIN genes b ON b.gene_idx = j WHERE h < 40)"""
TERMS = """ids AS (SELECT i, j, (7 * i + 13 * j) % 97 AS h FROM range(64) r(i), range(64) s(j)),
idterms AS (SELECT j AS t, 'tf' AS term_type, i AS ia, NULL::BIGINT AS ib FROM ids WHERE h < 10 AND j % 8 = 0 AND i <> j
  UNION ALL SELECT t, 'lr', i, j FROM ids, range(0, 64, 8) q(t) WHERE h >= 10 AND h < 16 AND i < 8 AND (t + i + j) % 4 = 0 AND t <> i AND t <> j
  UNION ALL SELECT t, 'tfl', i, j FROM ids, range(0, 64, 8) q(t) WHERE h >= 16 AND h < 40 AND i < 8 AND (t + i + j) % 8 = 1 AND t <> i AND t <> j),
terms AS (SELECT g.gene AS target, term_type, a.gene AS a, b.gene AS b, t, ia, ib FROM idterms JOIN genes g ON g.gene_idx = t JOIN genes a ON a.gene_idx = ia LEFT JOIN genes b ON b.gene_idx = ib)"""
BETAS = "betas AS (SELECT cluster, target, term_type, a, b, ((7 * ia + 13 * coalesce(ib, 0) + 3 * cluster + 5 * t) % 97) / 97.0::DOUBLE - 0.5 AS beta FROM terms, range(10) c(cluster))"


def kernel(name: str, values: str, radius: str = "100.0::DOUBLE", threshold: float | None = None) -> str:
    v = "s.value" if threshold is None else f"CASE WHEN s.value > {threshold!r} THEN s.value ELSE 0 END"
    return f"""{name} AS (SELECT c.cell_idx, l.gene, coalesce(sum(exp(-((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) / (2 * {radius} * {radius})) * {v}), 0) / (SELECT count(*) FROM cells) AS value
  FROM cells c, (SELECT * FROM genes WHERE gene_idx < 8) l LEFT JOIN {values} s ON s.gene = l.gene LEFT JOIN cells p ON p.cell_idx = s.cell_idx GROUP BY ALL)"""


RECEIVED = kernel("received", "expression")


def splash(name: str, values: str, lr: str, tfl: str) -> str:
    return f"""{name}_own AS (SELECT c.cell_idx, b.* FROM cells c JOIN betas b ON b.cluster = c.cluster),
{name}_parts AS (SELECT cell_idx, target, a AS gene, beta AS v FROM {name}_own WHERE term_type = 'tf'
  UNION ALL SELECT o.cell_idx, target, b, CASE WHEN e.value > 0 THEN beta * r.value ELSE 0 END FROM {name}_own o JOIN {values} e ON e.cell_idx = o.cell_idx AND e.gene = b JOIN {lr} r ON r.cell_idx = o.cell_idx AND r.gene = a WHERE term_type = 'lr'
  UNION ALL SELECT o.cell_idx, target, b, beta * r.value FROM {name}_own o JOIN {tfl} r ON r.cell_idx = o.cell_idx AND r.gene = a WHERE term_type = 'tfl'
  UNION ALL SELECT o.cell_idx, target, a, beta * e.value FROM {name}_own o JOIN {values} e ON e.cell_idx = o.cell_idx AND e.gene = b WHERE term_type <> 'tf'),
{name} AS (SELECT cell_idx, target, gene, sum(v) AS deriv FROM {name}_parts GROUP BY ALL)"""


def propagate(rounds: int, scope: str = "TRUE") -> str:
    """The rounds, one after another; the last is named final: cell_idx, gene, delta, simulated."""
    parts = [f"""base AS (SELECT d.cell_idx, d.gene, d.value AS g0, max(d.value) OVER (PARTITION BY d.gene) AS mx, CASE WHEN d.gene = 'G01' AND {scope} THEN -d.value ELSE 0 END AS din, d.gene = 'G01' AND {scope} AS wanted
  FROM dense d JOIN cells c ON c.cell_idx = d.cell_idx)""", kernel("rw0", "dense", threshold=1e-9), "s0 AS (SELECT cell_idx, gene, din AS d, g0 AS g1 FROM base)"]
    lr = "rw0"
    for k in range(1, rounds + 1):
        parts += [
            f"seen{k} AS (SELECT cell_idx, gene, CASE WHEN g1 > 1e-9 THEN g1 ELSE 0 END AS value FROM s{k - 1})",
            splash(f"slope{k}", f"seen{k}", lr, "rw0"),
            f"now{k} AS (SELECT cell_idx, gene, g0, mx, din, d, g0 + d AS value FROM base JOIN s{k - 1} USING (cell_idx, gene))",
            kernel(f"rw{k}", f"now{k}", threshold=1e-9),
            f"moved{k} AS (SELECT n.cell_idx, n.gene, n.d + coalesce(r.value - z.value, 0) - CASE WHEN r.gene IS NOT NULL THEN n.value - n.g0 ELSE 0 END AS d FROM now{k} n LEFT JOIN rw{k} r ON r.cell_idx = n.cell_idx AND r.gene = n.gene LEFT JOIN rw0 z ON z.cell_idx = n.cell_idx AND z.gene = n.gene)",
            f"dy{k} AS (SELECT s.cell_idx, s.target AS gene, sum(s.deriv * m.d) AS dy FROM slope{k} s JOIN moved{k} m ON m.cell_idx = s.cell_idx AND m.gene = s.gene GROUP BY ALL)",
            f"s{k} AS (SELECT n.cell_idx, n.gene, least(greatest(g0 + CASE WHEN din <> 0 THEN din ELSE coalesce(dy, 0) END, 0), mx) - g0 AS d, n.value AS g1 FROM now{k} n LEFT JOIN dy{k} y ON y.cell_idx = n.cell_idx AND y.gene = n.gene)",
        ]
        lr = f"rw{k}"
    return ",\n".join([*parts, f"final AS (SELECT cell_idx, gene, d AS delta, CASE WHEN wanted THEN 0.0 ELSE g0 + d END AS simulated FROM base JOIN s{rounds} USING (cell_idx, gene))"])


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


MODEL = (CELLS, GENES, EXPRESSION, DENSE, TERMS, BETAS)
KNN = """knn AS (SELECT i, j, rank, d2 FROM (SELECT a.cell_idx AS i, b.cell_idx AS j, (a.umap_x - b.umap_x) * (a.umap_x - b.umap_x) + (a.umap_y - b.umap_y) * (a.umap_y - b.umap_y) AS d2,
  row_number() OVER (PARTITION BY a.cell_idx ORDER BY d2, b.cell_idx) AS rank FROM cells a JOIN cells b ON a.cell_idx <> b.cell_idx) WHERE rank <= 15)"""
KNN6 = """knn6 AS (SELECT i, j FROM (SELECT a.cell_idx AS i, b.cell_idx AS j, row_number() OVER (PARTITION BY a.cell_idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_idx) AS rank
  FROM cells a JOIN cells b ON a.cell_idx <> b.cell_idx) WHERE rank <= 6),
sym AS (SELECT i, j FROM knn6 UNION SELECT j, i FROM knn6)"""
CORR = (CELLS, GENES, DENSE, KNN, """delta AS (SELECT cell_idx, gene, round(1000 * CASE WHEN gene = 'G12' THEN -value WHEN gene = 'G20' THEN 0.1 ELSE 0 END) / 1000 AS v FROM dense),
pairs AS (SELECT k.i, k.j, d.v AS x, b.value - a.value AS y FROM knn k JOIN dense a ON a.cell_idx = k.i JOIN dense b ON b.cell_idx = k.j AND b.gene = a.gene JOIN delta d ON d.cell_idx = k.i AND d.gene = a.gene),
centred AS (SELECT i, j, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM pairs WINDOW w AS (PARTITION BY i, j)),
sums AS (SELECT i, j, sum(x * y) AS cv, sum(x * x) AS vx, sum(y * y) AS vy FROM centred GROUP BY ALL),
corr AS (SELECT i, j, CASE WHEN vx <= 1e-18 OR vy <= 1e-18 THEN 1.0 ELSE greatest(least(cv / sqrt(vx * vy), 1.0), -1.0) END AS corr FROM sums)""")
PROBS = (*CORR, """soft AS (SELECT i, j, exp((corr - max(corr) OVER w) / 0.05) AS z FROM corr WINDOW w AS (PARTITION BY i)),
prob AS (SELECT i, j, z / sum(z) OVER w AS p, count(*) OVER w AS deg FROM soft WINDOW w AS (PARTITION BY i)),
kept AS (SELECT i, j, round(p, 12) - round(1.0::DOUBLE / deg, 12) AS p FROM prob WHERE round(p, 12) - round(1.0::DOUBLE / deg, 12) > 0),
trans AS (SELECT i, j, p / sum(p) OVER (PARTITION BY i) AS p FROM kept)""")
VECTORS = (*PROBS, """vec AS (SELECT c.cell_idx, c.umap_x, c.umap_y, coalesce(sum(p * (d.umap_x - c.umap_x)), 0) AS vx, coalesce(sum(p * (d.umap_y - c.umap_y)), 0) AS vy
  FROM cells c LEFT JOIN trans t ON t.i = c.cell_idx LEFT JOIN cells d ON d.cell_idx = t.j GROUP BY ALL)""")
DESIGN = (CELLS, GENES, EXPRESSION, DENSE, TERMS, RECEIVED, """design AS (SELECT target, d.cell_idx, term_type, a, b, value AS x FROM terms JOIN dense d ON d.gene = a WHERE term_type = 'tf'
  UNION ALL SELECT target, d.cell_idx, term_type, a, b, r.value * d.value FROM terms JOIN dense d ON d.gene = b JOIN received r ON r.cell_idx = d.cell_idx AND r.gene = a WHERE term_type <> 'tf')""")
PREDICTED = (*DESIGN, """placed AS (SELECT target, cell_idx, x, row_number() OVER (PARTITION BY target, cell_idx ORDER BY CASE term_type WHEN 'tf' THEN 0 WHEN 'lr' THEN 1 ELSE 2 END, a, coalesce(b, ''), x) AS k FROM design),
predicted AS (SELECT p.target, p.cell_idx, any_value(c.cluster) AS cluster, any_value(d.value) AS y, any_value(c.cluster) * 0.01::DOUBLE + sum(p.x * k * 0.001::DOUBLE) AS y_hat FROM placed p JOIN cells c ON c.cell_idx = p.cell_idx JOIN dense d ON d.cell_idx = p.cell_idx AND d.gene = p.target GROUP BY p.target, p.cell_idx)""")
GATE = """gate AS (SELECT gene, gene_idx AS i, i % 17 = 0 AS skip, i % 13 = 0 AS force, i * 7 % 200 AS min_cells, i % 9 <> 0 AS converged, (i * 11 % 40) / 100.0::DOUBLE AS mean_r2, i * 5 % 60 AS n_mods, (i * 5 % 60) / 2.0::DOUBLE AS n_spatial, (i * 3 % 20) / 100.0::DOUBLE + 0.001::DOUBLE AS p FROM genes),
decided AS (SELECT gene, CASE WHEN skip THEN 'skip list' WHEN force THEN 'allow list' WHEN min_cells < 50 THEN 'few cells' WHEN NOT converged THEN 'not converged' WHEN mean_r2 < 0.1 * (1.4 - 0.8 * 0.5) THEN 'low r2'
  WHEN n_mods > 40 AND p > 0.01 THEN 'many terms' WHEN n_mods <= 40 AND p > 0.05 THEN 'no pattern' ELSE 'pattern' END AS reason, -ln(CASE WHEN skip THEN 1.0 ELSE p END) + CASE WHEN n_mods > 0 THEN n_spatial / n_mods ELSE 0 END + mean_r2 AS score FROM gate)"""
PICK = """regs AS (SELECT target, source AS tf, min(edge_order) AS tf_order FROM network WHERE edge_type = 'grn' AND source <> target GROUP BY ALL),
lrp AS (SELECT source AS ligand, target AS receptor, min(edge_order) AS pair_order FROM network WHERE edge_type = 'lr' GROUP BY ALL),
best AS (SELECT target AS tf, source AS ligand, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, edge_order) AS rank FROM network WHERE edge_type = 'nichenet' AND weight > 0.2 AND source IN (SELECT ligand FROM lrp)) WHERE rank <= 5),
tfl AS (SELECT r.target, ligand, r.tf, weight, rank FROM regs r JOIN best b ON b.tf = r.tf WHERE ligand <> r.target)"""
ONE = """seen AS (SELECT c.cell_idx AS j, (c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) AS d2 FROM cells c, (SELECT x, y FROM cells WHERE cell_idx = 7) o WHERE c.cell_idx <> 7)"""
DELTAS = "SELECT cell_idx, gene, round(delta, 6) AS delta, round(simulated, 6) AS simulated FROM final"

SQL = {
    "received_ligands": with_(CELLS, GENES, EXPRESSION, RECEIVED) + "SELECT cell_idx, gene, round(value, 6) AS value FROM received",
    "received_multi_radius": with_(CELLS, GENES, EXPRESSION, kernel("received", "expression", "(50.0::DOUBLE + 25 * (l.gene_idx % 3))", 0.05)) + "SELECT cell_idx, gene, round(value, 6) AS value FROM received",
    "received_ligands_grid": with_(CELLS, GENES, EXPRESSION, """b AS (SELECT count(*) AS n, min(x) - 50 AS x0, min(y) - 50 AS y0, ceil((max(x) + 50 - (min(x) - 50)) / 50)::BIGINT + 1 AS nx, ceil((max(y) + 50 - (min(y) - 50)) / 50)::BIGINT + 1 AS ny FROM cells),
anchors AS (SELECT a, x0 + (a % nx) * 50.0 AS ax, y0 + (a // nx) * 50.0 AS ay FROM b, range(10000) r(a) WHERE a < nx * ny),
atv AS (SELECT a, gene, sum(exp(-((ax - x) * (ax - x) + (ay - y) * (ay - y)) / 20000.0) * value) / (SELECT n FROM b) AS v FROM anchors, expression e JOIN cells c ON c.cell_idx = e.cell_idx WHERE gene < 'G08' GROUP BY ALL),
pl AS (SELECT cell_idx, (x - x0) / 50.0 AS gx, (y - y0) / 50.0 AS gy, nx, ny FROM cells, b),
co AS (SELECT cell_idx, least(floor(gy)::BIGINT + dy, ny - 1) * nx + least(floor(gx)::BIGINT + dx, nx - 1) AS a, (CASE WHEN dx = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN dy = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS w FROM pl, range(2) p(dx), range(2) q(dy)),
grid AS (SELECT cell_idx, gene, sum(w * v) AS value FROM co JOIN atv USING (a) GROUP BY ALL)""", RECEIVED) + "SELECT cell_idx, gene, round(value, 6) AS value FROM grid WHERE (SELECT nx * ny < n FROM b) UNION ALL SELECT cell_idx, gene, round(value, 6) FROM received WHERE (SELECT nx * ny >= n FROM b)",
    "gene_expression": with_(GENES, DENSE) + "SELECT cell_idx, round(value, 6) AS value FROM dense WHERE gene = 'G05'",
    "expression_profiles": with_(GENES, EXPRESSION) + "SELECT cell_idx, gene, round(value, 6) AS value FROM expression WHERE cell_idx IN (1, 2, 3, 5, 8, 13) AND gene IN ('G01', 'G02', 'G03', 'G40', 'nope')",
    "genes_prefix": with_(GENES) + "SELECT gene_idx, gene FROM genes WHERE gene LIKE 'G1%' ORDER BY gene_idx LIMIT 5",
    "genes_substring": with_(GENES) + "SELECT gene FROM genes WHERE lower(gene) LIKE '%g2%' ORDER BY gene_idx LIMIT 100",
    "cluster_ids_cast": "SELECT vec_id AS cell_idx, coalesce(round(embedding[5]::DOUBLE * 100), 0)::BIGINT AS rounded, coalesce(trunc(embedding[5]::DOUBLE * 100), 0)::BIGINT AS truncated FROM embeddings",
    "cell_type_codes": with_(CELLS) + "SELECT cell_idx, (dense_rank() OVER (ORDER BY cell_type) - 1)::BIGINT AS code FROM cells",
    "label_clusters": with_(CELLS) + "SELECT cell_idx, CASE cluster WHEN 0 THEN 'T cells' WHEN 3 THEN 'B cells' ELSE 'Cluster ' || cluster END AS label FROM cells",
    "gene_means": with_(GENES, DENSE) + "SELECT gene, round(avg(value), 6) AS mean FROM dense GROUP BY gene",
    "selection_mean": with_(GENES, DENSE) + "SELECT gene, round(avg(value), 6) AS mean FROM dense WHERE cell_idx < 20 AND gene IN ('G03', 'G04') GROUP BY gene",
    "cluster_means": with_(CELLS, GENES, DENSE) + "SELECT cluster::BIGINT AS cluster, gene, round(avg(value), 6) AS mean, count(*) AS n FROM dense JOIN cells USING (cell_idx) WHERE gene IN ('G00', 'G07', 'G33') GROUP BY ALL UNION ALL SELECT cluster::BIGINT, 'absent', 0.0, count(*) FROM cells GROUP BY ALL",
    "label_counts": with_(CELLS) + "SELECT cell_type, count(*) AS n FROM cells WHERE trim(cell_type) <> '' GROUP BY ALL",
    "majority_label": with_(CELLS) + "SELECT cluster::BIGINT AS cluster, cell_type FROM (SELECT cluster, 't' || (cell_idx % 4) AS cell_type, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cell_type) AS r FROM (SELECT cluster, cell_idx FROM cells) GROUP BY cluster, 't' || (cell_idx % 4)) WHERE r = 1",
    "bounds": with_(CELLS) + "SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM cells",
    "distinct_clusters": with_(CELLS) + "SELECT count(DISTINCT cluster::VARCHAR) AS n FROM cells",
    "condition_groups": with_(CELLS, r"""l AS (SELECT CASE cell_idx % 5 WHEN 0 THEN 'batch A / drug+B' WHEN 1 THEN 'batch A _ drug B' WHEN 2 THEN ' ' WHEN 3 THEN '...' ELSE condition END AS c FROM cells),
g AS (SELECT CASE WHEN trim(c) = '' THEN '_na' ELSE trim(c) END AS condition, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT *, regexp_replace(regexp_replace(left(regexp_replace(regexp_replace(condition, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), 64), '^_+|_+$', '', 'g'), '^\.+|\.+$', '', 'g') AS b FROM g),
t AS (SELECT *, CASE WHEN b = '' THEN 'group' ELSE b END AS base FROM s)""") + "SELECT condition, base || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS directory, n FROM t WINDOW w AS (PARTITION BY base ORDER BY condition)",
    "regulators": with_(GENES, NETWORK, PICK) + "SELECT * FROM regs",
    "lr_pairs_top": with_(GENES, DENSE, NETWORK, PICK, "m AS (SELECT gene, round(avg(value), 9) AS mean FROM dense GROUP BY gene)") + "SELECT ligand, receptor, pair_order, round(round(0.5 * (l.mean + r.mean), 9), 6) AS score FROM lrp JOIN m l ON l.gene = ligand JOIN m r ON r.gene = receptor ORDER BY round(0.5 * (l.mean + r.mean), 9) DESC, pair_order LIMIT 25",
    "tfl_pairs": with_(GENES, NETWORK, PICK) + "SELECT target, ligand, tf, round(weight, 6) AS weight, rank FROM tfl",
    "modulator_terms": with_(GENES, NETWORK, PICK, "t AS (SELECT gene AS target FROM genes WHERE gene_idx % 8 = 0)") + "SELECT target, 'tf' AS term_type, tf AS a, NULL::VARCHAR AS b FROM regs JOIN t USING (target) UNION ALL SELECT target, 'lr', ligand, receptor FROM lrp, t WHERE ligand <> target AND receptor <> target UNION ALL SELECT target, 'tfl', ligand, tf FROM tfl JOIN t USING (target)",
    "modulator_genes": with_(GENES, TERMS) + "SELECT DISTINCT target, 'beta_' || g AS gene FROM (SELECT target, a AS g FROM terms UNION ALL SELECT target, b FROM terms WHERE b IS NOT NULL)",
    "priors_masks": with_(GENES, NETWORK, TERMS, """pr AS (SELECT DISTINCT source, target, 'type_' || (edge_order % 2) AS cell_type FROM network WHERE edge_type = 'grn' AND edge_order % 3 = 0 AND substr(target, 2)::INT % 16 = 0),
ct AS (SELECT c AS cluster, 'type_' || (c % 5) AS cell_type FROM range(10) r(c))""") + "SELECT t.target, t.a, cluster, NOT EXISTS (SELECT 1 FROM pr WHERE pr.target = t.target AND pr.cell_type = ct.cell_type) OR EXISTS (SELECT 1 FROM pr WHERE pr.target = t.target AND pr.cell_type = ct.cell_type AND pr.source = t.a) AS allowed FROM terms t, ct WHERE term_type = 'tf'",
    "decode_terms": with_(GENES, TERMS) + "SELECT target, 'beta_' || a || CASE term_type WHEN 'lr' THEN '$' || b WHEN 'tfl' THEN '#' || b ELSE '' END AS term, term_type AS kind, CASE term_type WHEN 'lr' THEN 'ligand-receptor' WHEN 'tfl' THEN 'ligand-tf' ELSE 'tf' END AS shown, a, coalesce(b, '') AS b FROM terms",
    "cell_beta_map": with_(*MODEL) + "SELECT cell_idx, cluster::VARCHAR AS row_id, round(coalesce((SELECT arg_max(beta, a) FROM betas b WHERE b.cluster = c.cluster AND target = 'G08' AND term_type = 'tf'), 0), 6) AS beta FROM cells c",
    "interactions": with_(*MODEL) + "SELECT target, term_type, a, coalesce(b, '') AS b, round(avg(beta), 6) AS mean, round(min(beta), 6) AS min, round(max(beta), 6) AS max, round(sum(beta), 6) AS sum, round(avg(beta) FILTER (beta > 0), 6) AS positive, round(avg(beta) FILTER (beta < 0), 6) AS negative FROM cells JOIN betas USING (cluster) GROUP BY target, term_type, a, b",
    "top_coefficients": with_(*MODEL, "s AS (SELECT cell_idx, cluster FROM cells WHERE cell_idx < 40 UNION ALL SELECT cell_idx, cluster FROM cells WHERE cell_idx < 5), t AS (SELECT a || CASE term_type WHEN 'lr' THEN '$' || b WHEN 'tfl' THEN '#' || b ELSE '' END AS term, round(avg(beta), 9) AS mean, round(avg(abs(beta)), 9) AS mean_abs FROM s JOIN betas USING (cluster) WHERE target = 'G16' GROUP BY 1)") + "SELECT term, round(mean, 6) AS mean, round(mean_abs, 6) AS mean_abs FROM t ORDER BY t.mean_abs DESC, term LIMIT 10",
    "splash": with_(*MODEL, RECEIVED, splash("slope", "dense", "received", "received")) + "SELECT cell_idx, target, gene, round(deriv, 6) AS deriv FROM slope",
    "splash_capped": with_(*MODEL, RECEIVED, splash("slope", "dense", "received", "received")) + "SELECT cell_idx, target, gene, round(greatest(least(deriv, 0.2), -0.2), 6) AS deriv FROM slope",
    "perturb_round1": with_(*MODEL, propagate(1)) + DELTAS,
    "perturb_round2": with_(*MODEL, propagate(2)) + DELTAS,
    "perturb_scoped": with_(*MODEL, propagate(1, "c.cell_type = 'type_1'")) + DELTAS,
    "perturb_summary": with_(*MODEL, propagate(1)) + "SELECT gene, round(avg(delta), 6) AS mean_delta, round(max(abs(delta)), 6) AS max_abs FROM final GROUP BY gene HAVING round(max(abs(delta)), 6) > 1e-12 ORDER BY max_abs DESC, gene LIMIT 50",
    "quick_delta": with_(GENES, DENSE) + "SELECT cell_idx, gene, round(CASE WHEN gene = 'G10' AND cell_idx % 2 = 0 THEN 0.5 - value ELSE 0 END, 6) AS delta FROM dense",
    "neighbor_counts": with_(CELLS) + "SELECT a.cell_idx, b.cluster::BIGINT AS cluster, count(*) AS n FROM cells a JOIN cells b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000 GROUP BY ALL",
    "knn_embedding": with_(CELLS, KNN) + "SELECT i, j, rank, round(d2, 6) AS d2 FROM knn",
    "knn_symmetric": with_(CELLS, KNN6) + "SELECT i, j FROM sym",
    "one_cell_knn": with_(CELLS, ONE) + "SELECT j, round(d2, 6) AS d2 FROM (SELECT * FROM seen ORDER BY d2, j LIMIT 12)",
    "one_cell_radius": with_(CELLS, ONE) + "SELECT j, round(d2, 6) AS d2 FROM (SELECT * FROM seen WHERE d2 <= 22500 ORDER BY d2, j LIMIT 500)",
    "cell_context": with_(CELLS, GENES, EXPRESSION, NETWORK, PICK, ONE, """near AS (SELECT j FROM seen ORDER BY d2, j LIMIT 10), own AS (SELECT gene, value FROM expression WHERE cell_idx = 7 AND value > 0.01),
f AS (SELECT j, ligand, receptor, o.value AS l, e.value AS r, row_number() OVER (PARTITION BY j ORDER BY pair_order) AS k FROM near JOIN expression e ON e.cell_idx = j AND e.value > 0.01 JOIN lrp ON receptor = e.gene JOIN own o ON o.gene = ligand),
t AS (SELECT source AS ligand, target AS tf, row_number() OVER (PARTITION BY source ORDER BY o.value DESC, target DESC) AS k FROM network JOIN own o ON o.gene = target WHERE edge_type = 'nichenet')""") + "SELECT j, f.ligand, receptor, round(sqrt(l * r), 6) AS score, coalesce(tf, '') AS tf FROM f LEFT JOIN t ON t.ligand = f.ligand AND t.k = 1 WHERE f.k <= 48",
    "moran_i": with_(CELLS, GENES, DENSE, KNN6, """z AS (SELECT gene, cell_idx, value - avg(value) OVER (PARTITION BY gene) AS z FROM dense),
n AS (SELECT gene, count(*) AS n, sum(z * z) AS zz FROM z GROUP BY gene), s AS (SELECT a.gene, count(*) AS s0, sum(a.z * b.z) AS c FROM sym JOIN z a ON a.cell_idx = i JOIN z b ON b.cell_idx = j AND b.gene = a.gene GROUP BY a.gene)""") + "SELECT gene, round(CASE WHEN zz > 0 THEN n::DOUBLE / s0 * c / zz ELSE 0 END, 6) AS moran_i FROM n JOIN s USING (gene)",
    "pearson_edges": with_(*CORR) + "SELECT i, j, round(corr, 6) AS corr FROM corr",
    "transition_probs": with_(*PROBS) + "SELECT i, j, round(p, 6) AS p FROM trans",
    "cell_vectors": with_(*VECTORS) + "SELECT cell_idx, round(vx, 6) AS vx, round(vy, 6) AS vy FROM vec",
    "grid_field": with_(*VECTORS, """st AS (SELECT greatest(avg((abs(b.umap_x - a.umap_x) + abs(b.umap_y - a.umap_y)) / 2), 1e-9) AS s FROM cells a JOIN cells b ON b.cell_idx = a.cell_idx + 1),
ax AS (SELECT min(umap_x) AS x0, greatest(max(umap_x) - min(umap_x), 1e-12) AS wx, min(umap_y) AS y0, greatest(max(umap_y) - min(umap_y), 1e-12) AS wy FROM cells),
cn AS (SELECT *, least(greatest(pow(floor(sqrt((wx + 1) * 10.0 / s)), 2), 4), 10000)::BIGINT AS nx, least(greatest(pow(floor(sqrt((wy + 1) * 10.0 / s)), 2), 4), 10000)::BIGINT AS ny FROM ax, st),
nd AS (SELECT ix, iy, x0 + ix * (wx / (nx - 1)) AS gx, y0 + iy * (wy / (ny - 1)) AS gy, wx / (nx - 1) / 2 AS tx, wy / (ny - 1) / 2 AS ty FROM cn, range(10000) a(ix), range(10000) b(iy) WHERE ix < nx AND iy < ny),
fd AS (SELECT ix, iy, any_value(gx) AS gx, any_value(gy) AS gy, coalesce(sum(vx), 0) AS u, coalesce(sum(vy), 0) AS v FROM nd LEFT JOIN vec ON abs(umap_x - gx) <= tx AND abs(umap_y - gy) <= ty GROUP BY ix, iy),
mm AS (SELECT CASE WHEN max(greatest(abs(u), abs(v))) > 1e-36 THEN 0.85 / max(greatest(abs(u), abs(v))) ELSE 1 END AS f FROM fd)""") + "SELECT ix, iy, round(gx, 6) AS gx, round(gy, 6) AS gy, round(u * f, 6) AS u, round(v * f, 6) AS v FROM fd, mm",
    "spatial_map_cells": with_(CELLS, "b AS (SELECT min(x) AS x0, max(y) AS y1, greatest(max(x) - min(x), 1e-6) / 8 AS w, greatest(max(y) - min(y), 1e-6) / 8 AS h FROM cells)") + "SELECT cell_idx, cluster::BIGINT AS cluster, i, j, round(1 / greatest(sqrt(pow(x - (x0 + (j + 0.5) * w), 2) + pow(y - (y1 - (i + 0.5) * h), 2)), 1e-6), 6) AS value FROM cells, b, range(8) p(i), range(8) q(j)",
    "design_matrix": with_(*DESIGN) + "SELECT target, cell_idx, term_type, a, coalesce(b, '') AS b, round(x, 6) AS x FROM design",
    "predict_lasso": with_(*PREDICTED) + "SELECT target, cell_idx, round(y, 6) AS y, round(y_hat, 6) AS y_hat FROM predicted",
    "fit_quality": with_(*PREDICTED) + "SELECT target, cluster::BIGINT AS cluster, count(*) AS n, round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(CASE WHEN var_pop(y) * count(*) > 1e-15 THEN 1 - sum((y - y_hat) * (y - y_hat)) / (var_pop(y) * count(*)) ELSE 0 END, 5) AS r2 FROM predicted GROUP BY target, cluster",
    "gate_decision": with_(GENES, GATE) + "SELECT gene, reason IN ('allow list', 'pattern') AS use, reason, round(score, 6) AS rank_score FROM decided",
    "rank_top_k": with_(GENES, GATE) + "SELECT gene, round(score, 6) AS rank_score FROM decided WHERE reason IN ('allow list', 'pattern') ORDER BY rank_score DESC, gene LIMIT 7",
    "scaled_by_cluster": with_(CELLS, GENES, DENSE) + "SELECT cell_idx, round(CASE WHEN lo = 0 AND hi = 0 THEN NULL WHEN hi - lo < 1e-12 THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT cell_idx, value, min(value) OVER (PARTITION BY cluster) AS lo, max(value) OVER (PARTITION BY cluster) AS hi FROM dense JOIN cells USING (cell_idx) WHERE gene = 'G05')",
    "quantile_range": with_(GENES, DENSE, "o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM dense WHERE gene = 'G05')") + "SELECT round(max(value) FILTER (k = floor(0.02 * (n - 1))), 6) AS low, round(max(value) FILTER (k = floor(0.5 * (n - 1))), 6) AS mid, round(max(value) FILTER (k = floor(0.98 * (n - 1))), 6) AS high FROM o",
    "pending_genes": with_(GENES) + "SELECT gene FROM genes WHERE gene_idx % 3 <> 0",
    "training_rollup": with_(GENES, "s AS (SELECT gene, ((gene_idx * 3 + c * 7) % 50) / 50.0::DOUBLE AS r2, (gene_idx + c) % 4 <> 0 AS ok FROM genes, range(10) r(c))") + "SELECT gene, count(*) AS clusters, round(avg(r2), 6) AS mean_r2, round(min(r2), 6) AS min_r2, round(max(r2), 6) AS max_r2, round(avg(ok::INT), 6) AS converged FROM s GROUP BY gene",
    "user_event_matrix": "SELECT user_id AS cell_idx, event_type AS gene, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "supplier_part_matrix": "SELECT l_suppkey AS cell_idx, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
}

MASKS = """pr AS (SELECT DISTINCT source, target, 'type_' || (edge_order % 2) AS cell_type FROM network WHERE edge_type = 'grn' AND edge_order % 3 = 0),
mk AS (SELECT DISTINCT t.target, t.a, c.c AS cluster FROM terms t, range(10) c(c) WHERE term_type = 'tf' AND EXISTS (SELECT 1 FROM pr WHERE pr.target = t.target AND pr.cell_type = 'type_' || (c.c % 5)) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.target = t.target AND pr.cell_type = 'type_' || (c.c % 5) AND pr.source = t.a))"""

SQL |= {
    "name_rules": r"""SELECT p_partkey, translate(p_type, '/\: ', '____') AS file, translate(printf('%.6f', p_retailprice - 1000), '-.', 'mp') AS value, round(p_retailprice * 10) / 10 AS rounded, format('{:,}', p_partkey * 1000) AS shown,
  CASE WHEN p_partkey % 3 = 2 THEN p_retailprice ELSE 0 END AS finite, CASE WHEN p_size > 10 THEN p_size::VARCHAR ELSE '' END AS label,
  list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(p_brand, ''), lambda x: ascii(x)::HUGEINT)), lambda h, c: (h * 33 + c) % 4294967296)::BIGINT AS hash FROM part""",
    "pair_names": """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (2, 3) THEN trim(p_brand) END AS first, CASE WHEN p_partkey % 4 IN (2, 3) THEN trim(p_type) END AS second, CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '') ELSE '' END AS gene FROM part""",
    "interaction_labels": with_(GENES, TERMS) + "SELECT target, a || CASE term_type WHEN 'lr' THEN ' – ' || b WHEN 'tfl' THEN ' → ' || b ELSE '' END AS label FROM terms",
    "value_ranges": with_(CELLS, "o AS (SELECT abs(y) AS v, row_number() OVER (ORDER BY abs(y)) - 1 AS k, count(*) OVER () AS n FROM cells), q AS (SELECT max(v) FILTER (k = floor(0.999 * (n - 1))) AS s FROM o)") + "SELECT round(min(x), 6) AS low, round(max(x), 6) AS high, round(-any_value(s), 6) AS left, round(any_value(s), 6) AS right FROM cells, q",
    "lasso_prox": """WITH e AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS w FROM embeddings), s AS (SELECT vec_id, k // 32 AS g, sign(w) * greatest(0, abs(w) - 0.05::DOUBLE) AS w FROM e),
n AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY vec_id, g)) AS size, CASE g WHEN 0 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS reg FROM s), z AS (SELECT vec_id, g, CASE WHEN size > 0 THEN w * greatest(0, 1 - reg / size) ELSE w END AS w FROM n)
SELECT vec_id, round(sum(w) FILTER (g = 0), 6) AS first, round(sum(abs(w)), 6) AS size, count(*) FILTER (w = 0) AS zeros FROM z GROUP BY vec_id""",
    "gated_fit": with_(*PREDICTED, """q AS (SELECT target, cluster, CASE WHEN var_pop(y) * count(*) > 1e-15 THEN 1 - sum((y - y_hat) * (y - y_hat)) / (var_pop(y) * count(*)) ELSE 0 END AS r FROM predicted GROUP BY target, cluster),
g AS (SELECT target, cluster, CASE WHEN cluster % 2 = 0 THEN abs(r) ELSE r END AS r2 FROM q)""") + "SELECT target, cluster::BIGINT AS cluster, round(CASE WHEN r2 < 0.1 THEN 0 ELSE r2 END, 5) AS r2, CASE WHEN r2 < 0.1 THEN 0.0 ELSE 0.5 END::DOUBLE AS intercept, CASE WHEN r2 < 0.1 THEN 0.0 ELSE 2.0 END::DOUBLE AS second FROM g",
    "expression_columns": with_(GENES, DENSE) + "SELECT cell_idx, round(max(value) FILTER (gene = 'G02'), 6) AS G02, round(max(value) FILTER (gene = 'G41'), 6) AS G41, 0.0::DOUBLE AS absent FROM dense GROUP BY cell_idx",
    "listed_targets": with_(GENES) + "SELECT gene_idx, gene FROM genes WHERE gene IN ('G40', 'G03', 'G21', 'G60') ORDER BY gene_idx LIMIT 3",
    "condition_cells": with_(CELLS) + "SELECT cell_idx, cell_id FROM cells WHERE condition = 'cond 1'",
    "highlighted_cells": with_(CELLS) + "SELECT cell_idx, cell_type IN ('type_1', 'type_3') AS keep FROM cells",
    "flat_map_rows": with_(CELLS, "b AS (SELECT min(x) AS x0, max(y) AS y1, greatest(max(x) - min(x), 1e-6) / 8 AS w, greatest(max(y) - min(y), 1e-6) / 8 AS h FROM cells)") + "SELECT cell_idx, (cluster * 64 + i * 8 + j)::BIGINT AS column, round(1 / greatest(sqrt(pow(x - (x0 + (j + 0.5) * w), 2) + pow(y - (y1 - (i + 0.5) * h), 2)), 1e-6), 6) AS value FROM cells, b, range(8) p(i), range(8) q(j)",
    "active_terms": with_(*MODEL) + "SELECT cluster::BIGINT AS cluster, target, term_type, a, coalesce(b, '') AS b, round(beta, 6) AS beta FROM betas x WHERE a >= 'G05' AND EXISTS (SELECT 1 FROM betas y WHERE y.target = x.target AND y.term_type = x.term_type AND y.a = x.a AND y.b IS NOT DISTINCT FROM x.b AND y.beta <> 0)",
    "signal_max": with_(GENES, EXPRESSION) + "SELECT cell_idx, gene, round(greatest(CASE WHEN gene < 'G04' THEN value ELSE 0 END, CASE WHEN gene >= 'G02' THEN value - 0.1::DOUBLE ELSE 0 END, 0), 6) AS value FROM expression WHERE gene <= 'G05'",
    "masked_design": with_(*DESIGN, NETWORK, MASKS) + "SELECT d.target, d.cell_idx, d.term_type, d.a, coalesce(d.b, '') AS b, round(CASE WHEN mk.a IS NULL THEN d.x ELSE 0 END, 6) AS x FROM design d JOIN cells c ON c.cell_idx = d.cell_idx LEFT JOIN mk ON d.term_type = 'tf' AND mk.target = d.target AND mk.a = d.a AND mk.cluster = c.cluster",
    "pair_terms_only": with_(GENES, NETWORK, PICK, "t AS (SELECT gene AS target FROM genes WHERE gene_idx % 8 = 0)") + "SELECT target, 'lr' AS term_type, ligand AS a, receptor AS b FROM lrp, t WHERE ligand <> target AND receptor <> target",
    "lr_pair_keys": with_(GENES, NETWORK) + "SELECT DISTINCT source || '$' || target AS pair FROM network WHERE edge_type = 'lr'",
    "context_gene_set": with_(GENES, TERMS) + "SELECT DISTINCT g AS gene FROM (SELECT a AS g FROM terms WHERE target = 'G16' UNION ALL SELECT b FROM terms WHERE target = 'G16' AND b IS NOT NULL UNION ALL SELECT 'G16')",
    "channel_mean": with_(GENES, DENSE) + "SELECT round(avg(value), 6) AS mean FROM dense WHERE gene = 'G09'",
}

STOPS = {
    "viridis": "[[68, 1, 84], [72, 40, 120], [62, 74, 137], [49, 104, 142], [38, 130, 142], [31, 158, 137], [53, 183, 121], [109, 205, 89], [183, 222, 39], [253, 231, 37]]",
    "magma": "[[0, 0, 4], [40, 11, 84], [101, 13, 99], [156, 37, 99], [205, 71, 93], [238, 116, 84], [251, 173, 81], [252, 229, 91], [252, 253, 191]]",
    "diverging": "[[49, 54, 149], [247, 247, 247], [165, 0, 38]]",
}


def colour(name: str, t: str) -> str:
    n = STOPS[name].count("],")
    k = f"least(floor({t} * {n}), {n - 1})::INT"
    return f"(SELECT array_to_string(list_transform([1, 2, 3], lambda c: floor(s[{k} + 1][c] + (s[{k} + 2][c] - s[{k} + 1][c]) * ({t} * {n} - {k}) + 0.5)::INT), ',') FROM (SELECT {STOPS[name]} AS s)) AS {name}"


PLACE = "greatest(0, least(1, (x + 40) / 100))"
SQL |= {
    "all_correlations": with_(CELLS, GENES, DENSE, "knn AS (SELECT a.cell_idx AS i, b.cell_idx AS j FROM cells a, cells b)", CORR[-1]) + "SELECT i, j, round(corr, 6) AS corr FROM corr",
    "cross_products": with_(*DESIGN) + """SELECT target, c.cluster::BIGINT AS cluster, 'beta_' || a || CASE term_type WHEN 'lr' THEN '$' || b WHEN 'tfl' THEN '#' || b ELSE '' END AS term, count(*) AS n,
  round(var_pop(design.x) * count(*), 5) AS xx, round(covar_pop(design.x, e.value) * count(*), 5) AS xy FROM design JOIN cells c USING (cell_idx) JOIN dense e ON e.cell_idx = design.cell_idx AND e.gene = target GROUP BY ALL""",
    "run_terms": with_(GENES, NETWORK, PICK, "pr AS (SELECT DISTINCT source, target FROM network WHERE edge_type = 'nichenet' AND edge_order % 7 = 0)") + """SELECT target, 'tf' AS term_type, tf AS a, '' AS b FROM regs WHERE target NOT IN (SELECT target FROM pr)
  UNION ALL SELECT target, 'tf', source, '' FROM pr UNION ALL SELECT gene, 'lr', ligand, receptor FROM lrp, genes WHERE ligand <> gene AND receptor <> gene
  UNION ALL SELECT target, 'tfl', ligand, tf FROM tfl WHERE target NOT IN (SELECT target FROM pr) OR EXISTS (SELECT 1 FROM pr WHERE pr.target = tfl.target AND pr.source = tfl.tf)""",
    "colours": with_(CELLS, f"h AS (SELECT cell_idx, cluster, {PLACE} AS t, greatest(0, least(1, (x + 60) / 120)) AS u, cluster * 0.618033988749895::DOUBLE % 1 * 12 AS a FROM cells)") + f"""SELECT cell_idx, {colour('viridis', 't')}, {colour('magma', 't')}, {colour('diverging', 'u')},
  array_to_string(list_transform([0, 8, 4], lambda o: floor((0.52 - 0.72 * 0.48 * greatest(-1, least((a + o) % 12 - 3, 9 - (a + o) % 12, 1))) * 255 + 0.5)::INT), ',') AS category, cluster <> 1 AS selectable FROM h""",
    "symmetric_by_cluster": with_(CELLS, "m AS (SELECT cell_idx, y, max(abs(y)) OVER (PARTITION BY cluster) AS m FROM cells)") + "SELECT cell_idx, round((y + m) / (2 * m), 6) AS scaled FROM m",
}
