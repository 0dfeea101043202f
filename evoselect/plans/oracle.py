"""DuckDB SQL oracles for the registered queries.

Plain relational SQL (long-form rows, joins, window functions).  Child nodes
are found by joining each row's root-feature bin back to its other features,
where the Spark plan slices arrays; the split search uses the same running
sums, tie rules and margin as the Spark side, so the independent check of
those is the plain-Python tree in the tests.  Randomness is the same md5 rule, so both engines draw
the same bits.  DuckDB list indexes are 1-based.
"""

from __future__ import annotations

from .queries import DOCS, EMB, LINEITEM, MANY, ORDERS, WIDE, Setup


def _hex8(expr: str) -> str:
    return f"CAST(('0x' || substr({expr}, 1, 8)) AS BIGINT)"


def _coin(*parts: str) -> str:
    return f"(CASE WHEN substr(md5(concat_ws('|', {', '.join(parts)})), 1, 1) >= '8' THEN 1 ELSE 0 END)"


def _holdout(seed: int, key: str) -> str:
    digest = "md5(concat_ws('|', " + str(seed) + ", 'holdout', " + key + "))"
    return f"({_hex8(digest)} % 5 < 1)"


_MATERIALIZE = {"ds", "lng", "sel", "said", "scores", "models"} | {f"{c}{k}" for c in "wg" for k in range(100)}


def _with(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZE else ''}(\n{sql}\n)"
                       for name, sql in ctes)
    return f"WITH {body}\n{final}"


# ------------------------------------------------------------------ datasets
def ds_embeddings(s: Setup) -> str:
    return f"""SELECT row_number() OVER (ORDER BY vec_id) AS rid,
       CAST(vec_id AS VARCHAR) AS row_key, label AS y, {_holdout(s.seed, 'vec_id')} AS is_test,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features
FROM embeddings"""


def ds_wide(s: Setup) -> str:
    pairs = "(SELECT list([i, j] ORDER BY i, j) FROM range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j)[1:760]"
    return f"""SELECT rid, row_key, y, is_test, list_transform(p, lambda k: coalesce(features[k[1]], 0) * coalesce(features[k[2]], 0)) AS features
FROM ({ds_embeddings(s)}), (SELECT {pairs} AS p)"""


def ds_lineitem(s: Setup, label: str = "l_returnflag") -> str:
    key = "concat_ws(':', l_orderkey, l_linenumber)"
    # no unique key: rows equal in every column are interchangeable here
    rid = ("row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
           "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)")
    return f"""SELECT {rid} AS rid, {key} AS row_key, {label} AS y, {_holdout(s.seed, key)} AS is_test,
       [CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE),
        CAST(l_tax AS DOUBLE), CAST(l_linenumber AS DOUBLE),
        CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE)] AS features
FROM lineitem"""


def _cnt(pattern: str) -> str:
    return f"(strlen(d.text) - strlen(regexp_replace(d.text, '{pattern}', '', 'g')))"


def ds_documents(s: Setup) -> str:
    return f"""SELECT row_number() OVER (ORDER BY d.doc_id) AS rid,
       CAST(d.doc_id AS VARCHAR) AS row_key, l.quality AS y, {_holdout(s.seed, 'd.doc_id')} AS is_test,
       [CAST(d.n_chars AS DOUBLE), CAST(strlen(d.text) AS DOUBLE),
        CAST(strlen(d.text) - strlen(replace(d.text, chr(10), '')) + 1 AS DOUBLE),
        CAST(strlen(d.text) - strlen(replace(d.text, ' ', '')) AS DOUBLE),
        CAST({_cnt('[0-9]')} AS DOUBLE), CAST({_cnt('[A-Z]')} AS DOUBLE),
        CAST({_cnt('[.,;:!?]')} AS DOUBLE)] AS features
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


def binned_ctes(ds_sql: str, s: Setup) -> list[tuple[str, str]]:
    nb = s.n_bins
    return [
        ("ds", ds_sql),
        ("vals", """SELECT rid, row_key, y, is_test, unnest(features) AS x,
       generate_subscripts(features, 1) - 1 AS f FROM ds"""),
        ("bounds", """SELECT f, min(x) AS lo, max(x) AS hi FROM vals
WHERE NOT is_test AND NOT isnan(x) AND NOT isinf(x) GROUP BY f"""),
        ("lng", f"""SELECT v.rid, v.row_key, v.y, v.is_test, v.f,
       CAST(CASE WHEN v.x IS NULL OR isnan(v.x) THEN {nb} WHEN NOT bd.hi > bd.lo THEN 0
                 WHEN v.x >= bd.hi THEN {nb - 1} WHEN v.x <= bd.lo THEN 0
                 ELSE least(floor((v.x - bd.lo) / (bd.hi - bd.lo) * {nb}), {nb - 1}) END AS INTEGER) AS b
FROM vals v JOIN bounds bd USING (f)"""),
    ]


def quantile_ctes(ds_sql: str, s: Setup) -> list[tuple[str, str]]:
    """``binned_ctes`` with borders at the training values of rank ceil(k n / n_bins)."""
    return [c for c in binned_ctes(ds_sql, s) if c[0] in ("ds", "vals")] + [
        ("cuts", f"""SELECT f, x AS cut FROM (
  SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS rn, count(*) OVER (PARTITION BY f) AS n
  FROM vals WHERE NOT is_test AND NOT isnan(x) AND NOT isinf(x)) JOIN range(1, {s.n_bins}) k(i)
  ON rn = CAST(ceil(i * n / CAST({s.n_bins} AS DOUBLE)) AS BIGINT)"""),
        ("lng", f"""SELECT v.rid, v.row_key, v.y, v.is_test, v.f,
       CAST(CASE WHEN any_value(v.x) IS NULL OR isnan(any_value(v.x)) THEN {s.n_bins} ELSE count(c.cut) END AS INTEGER) AS b
FROM vals v LEFT JOIN cuts c ON c.f = v.f AND c.cut < v.x GROUP BY ALL"""),
    ]


def stride_ctes(ds_sql: str, s: Setup) -> list[tuple[str, str]]:
    """``binned_ctes`` with the borders of pyspark.ml's tree: running counts of
    the distinct values; a value ends the next border when the count half-way
    through it is beyond the next multiple of rows / n_bins."""
    nb = s.n_bins
    return [c for c in binned_ctes(ds_sql, s) if c[0] in ("ds", "vals")] + [
        ("vc", """SELECT f, x, n, row_number() OVER w AS i, lag(x) OVER w AS px, sum(n) OVER w AS upto,
       sum(n) OVER (PARTITION BY f) AS total, count(*) OVER (PARTITION BY f) AS d
FROM (SELECT f, x, count(*) AS n FROM vals WHERE NOT is_test AND NOT isnan(x) AND NOT isinf(x) GROUP BY f, x)
WINDOW w AS (PARTITION BY f ORDER BY x)"""),
        ("tgt", f"""SELECT t.k, v.f, min(v.i) AS i FROM vc v JOIN range(1, 100) t(k)
  ON v.upto - v.n / 2.0 > t.k * (v.total / CAST({nb} AS DOUBLE)) WHERE v.i > 1 AND v.d > {nb} GROUP BY t.k, v.f"""),
        ("ends", "SELECT f, max(i - k) OVER (PARTITION BY f ORDER BY k) + k AS i FROM tgt"),
        ("cuts", f"""SELECT f, (px + x) / 2 AS cut FROM vc WHERE i > 1 AND d <= {nb}
UNION ALL SELECT f, (px + x) / 2 FROM vc JOIN ends USING (f, i)"""),
        next(c for c in quantile_ctes(ds_sql, s) if c[0] == "lng"),
    ]


def _counts_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys},
       sum(CASE WHEN is_test THEN 0 ELSE 1 END) AS n_train,
       sum(CASE WHEN is_test THEN 1 ELSE 0 END) AS n_test
FROM {src} GROUP BY {keys}"""


def split_ctes(prefix: str, hist: str) -> list[tuple[str, str]]:
    """Best useful threshold per (node, f) of histogram CTE ``hist``."""
    p = prefix
    return [
        (f"{p}_cells", f"""SELECT node, f, b, y, CAST(n_train AS HUGEINT) AS c,
       CAST(coalesce(sum(n_train) OVER (PARTITION BY node, f, y ORDER BY b
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS lb,
       CAST(sum(n_train) OVER (PARTITION BY node, f, y) AS HUGEINT) AS tot
FROM {hist} WHERE n_train > 0"""),
        (f"{p}_bins", f"""SELECT node, f, b, sum(c) AS c, sum(c * (2 * lb + c)) AS dl,
       sum(c * (c - 2 * (tot - lb))) AS dr,
       sum(CASE WHEN lb = 0 THEN tot * tot ELSE 0 END) AS sq
FROM {p}_cells GROUP BY node, f, b"""),
        (f"{p}_run", f"""SELECT node, f, b,
       sum(c) OVER w AS nl, sum(c) OVER (PARTITION BY node, f) AS nn,
       sum(dl) OVER w AS sl2,
       sum(sq) OVER (PARTITION BY node, f) + sum(dr) OVER w AS sr2,
       sum(sq) OVER (PARTITION BY node, f) AS sp2
FROM {p}_bins
WINDOW w AS (PARTITION BY node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
        (f"{p}_scored", f"""SELECT node, f, b, nl AS n_left, nn - nl AS n_right,
       CAST(sl2 AS DOUBLE) / CAST(nl AS DOUBLE) + CAST(sr2 AS DOUBLE) / CAST(nn - nl AS DOUBLE) AS score,
       CAST(sp2 AS DOUBLE) / CAST(nn AS DOUBLE) AS parent
FROM {p}_run WHERE nn - nl > 0"""),
        (f"{p}_cand", f"""SELECT sc.node, sc.f, th.t, sc.n_left, sc.n_right, sc.score
FROM {p}_scored sc JOIN thr th ON th.f = sc.f AND th.b = sc.b
WHERE sc.score - sc.parent > 1e-12 * sc.parent"""),
        (f"{p}_best", f"""SELECT node, f, t, n_left, n_right, score FROM {p}_cand
QUALIFY row_number() OVER (PARTITION BY node, f ORDER BY score DESC, t) = 1"""),
    ]


def root_ctes(ds_sql: str, s: Setup, borders: str = "widths") -> list[tuple[str, str]]:
    return {"widths": binned_ctes, "quantiles": quantile_ctes, "strides": stride_ctes}[borders](ds_sql, s) + [
        ("root_hist", "SELECT -1 AS node, * FROM (" + _counts_sql("lng", "f, b, y") + ")"),
        ("thr", """SELECT f, b, CAST(floor((b + lead(b) OVER (PARTITION BY f ORDER BY b)) / 2) AS INTEGER) AS t
FROM (SELECT DISTINCT f, b FROM root_hist WHERE n_train > 0)"""),
    ] + split_ctes("rs", "root_hist")


def population_cte(s: Setup, n_features: str, generation: int = 1) -> str:
    bit = _coin(str(s.seed), str(generation), "i", "pos")
    return f"""SELECT {generation} AS generation, CAST(i AS BIGINT) AS individual_id,
       list_transform(range(0, {n_features}), lambda pos: {bit}) AS genome
FROM range(0, {s.population}) t(i)"""


def fitness_ctes(s: Setup, pop: str, prefix: str) -> list[tuple[str, str]]:
    """Batched tree fitness of population CTE ``pop`` -> CTE ``{prefix}_fit``
    (individual_id, correct, n_blocks_used, fitness).  Needs root CTEs."""
    p, bs = prefix, s.block_size
    return [
        (f"{p}_genes", f"""SELECT individual_id, f, f // {bs} AS block FROM (
  SELECT individual_id, unnest(genome) AS bit, generate_subscripts(genome, 1) - 1 AS f FROM {pop})
WHERE bit = 1"""),
        (f"{p}_root", f"""SELECT g.individual_id, g.block, g.f AS r, rb.t AS t_r
FROM {p}_genes g JOIN rs_best rb ON rb.f = g.f
QUALIFY row_number() OVER (PARTITION BY g.individual_id, g.block ORDER BY rb.score DESC, g.f) = 1"""),
        (f"{p}_roots", f"SELECT DISTINCT r, t_r, block FROM {p}_root"),
        (f"{p}_rowside", f"""SELECT l.rid, rt.r, rt.block, CASE WHEN l.b <= rt.t_r THEN 0 ELSE 1 END AS s
FROM lng l JOIN {p}_roots rt ON l.f = rt.r"""),
        (f"{p}_chl", f"""SELECT 2 * rs.r + rs.s AS node, l.f, l.b, l.y, l.is_test
FROM {p}_rowside rs JOIN lng l ON l.rid = rs.rid AND l.f // {bs} = rs.block"""),
        (f"{p}_ch", _counts_sql(f"{p}_chl", "node, f, b, y")),
    ] + split_ctes(f"{p}_cs", f"{p}_ch") + [
        (f"{p}_sides", f"""SELECT individual_id, block, r, s, 2 * r + s AS node
FROM {p}_root, (VALUES (0), (1)) sv(s)"""),
        (f"{p}_chosen", f"""SELECT sd.individual_id, sd.block, sd.s, sd.node, cb.f, cb.t
FROM {p}_sides sd JOIN {p}_genes g ON g.individual_id = sd.individual_id AND g.block = sd.block
JOIN {p}_cs_best cb ON cb.node = sd.node AND cb.f = g.f
QUALIFY row_number() OVER (PARTITION BY sd.individual_id, sd.block, sd.s ORDER BY cb.score DESC, cb.f) = 1"""),
        (f"{p}_keys", f"""SELECT sd.individual_id, sd.block, sd.node, coalesce(c.f, -1) AS f, coalesce(c.t, -1) AS t
FROM {p}_sides sd LEFT JOIN {p}_chosen c
  ON c.individual_id = sd.individual_id AND c.block = sd.block AND c.s = sd.s
UNION ALL
SELECT DISTINCT g.individual_id, g.block, -1, -1, -1
FROM {p}_genes g WHERE NOT EXISTS (
  SELECT 1 FROM {p}_root r WHERE r.individual_id = g.individual_id AND r.block = g.block)"""),
        (f"{p}_split_cells", f"""SELECT h.node, h.f, sp.t, CASE WHEN h.b <= sp.t THEN 0 ELSE 1 END AS side, h.y,
       sum(h.n_train) AS n_train, sum(h.n_test) AS n_test
FROM {p}_ch h JOIN (SELECT DISTINCT node, f, t FROM {p}_chosen) sp ON sp.node = h.node AND sp.f = h.f
GROUP BY ALL"""),
        (f"{p}_node_cells", f"""SELECT node, y, sum(n_train) AS n_train, sum(n_test) AS n_test
FROM {p}_ch WHERE f = node // 2 GROUP BY node, y
UNION ALL
SELECT -1, y, sum(n_train), sum(n_test) FROM root_hist WHERE f = 0 GROUP BY y"""),
        (f"{p}_leaves", f"""SELECT node, f, t, sum(correct) AS correct FROM (
  SELECT node, f, t, side, n_test AS correct FROM {p}_split_cells
  QUALIFY row_number() OVER (PARTITION BY node, f, t, side ORDER BY n_train DESC, y) = 1)
GROUP BY node, f, t
UNION ALL
SELECT node, -1, -1, n_test FROM {p}_node_cells
QUALIFY row_number() OVER (PARTITION BY node ORDER BY n_train DESC, y) = 1"""),
        (f"{p}_ntest", "SELECT sum(n_test) AS n FROM root_hist WHERE f = 0"),
        (f"{p}_nblocks", f"SELECT CAST(ceil(count(DISTINCT f) / {bs}) AS BIGINT) AS nb FROM root_hist"),
        (f"{p}_per_ind", f"""SELECT k.individual_id, sum(lv.correct) AS correct, count(DISTINCT k.block) AS n_blocks_used
FROM {p}_keys k JOIN {p}_leaves lv ON lv.node = k.node AND lv.f = k.f AND lv.t = k.t
GROUP BY k.individual_id"""),
        (f"{p}_fit", f"""SELECT pp.individual_id, CAST(coalesce(pi.correct, 0) AS BIGINT) AS correct,
       CAST(coalesce(pi.n_blocks_used, 0) AS INTEGER) AS n_blocks_used,
       CAST(CASE WHEN pi.n_blocks_used = nb.nb AND nt.n > 0
                 THEN CAST(pi.correct AS DOUBLE) / CAST(nb.nb * nt.n AS DOUBLE) END AS DOUBLE) AS fitness
FROM {pop} pp LEFT JOIN {p}_per_ind pi ON pi.individual_id = pp.individual_id,
     {p}_ntest nt, {p}_nblocks nb"""),
    ]


def _genome_text(col: str) -> str:
    return f"(array_to_string({col}, '|') || '|')"


def _fitness_report(ds_sql: str, s: Setup, borders: str = "widths") -> str:
    ctes = root_ctes(ds_sql, s, borders) + [
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("pop", population_cte(s, "(SELECT n FROM nf)")),
    ] + fitness_ctes(s, "pop", "g1")
    bs = s.block_size
    blocks = (f"array_to_string(list_transform(range(0, CAST(ceil(len(p.genome) / {bs}) AS BIGINT)), "
              f"lambda k: list_sum(p.genome[k * {bs} + 1 : k * {bs} + {bs}])), ',')")
    final = f"""SELECT p.individual_id, {_genome_text('p.genome')} AS genome_text,
       CAST(list_sum(p.genome) AS INTEGER) AS n_selected, {blocks} AS block_counts,
       list_contains(p.genome, 1) AS nonempty, f.correct, f.n_blocks_used, f.fitness
FROM pop p JOIN g1_fit f USING (individual_id)"""
    return _with(ctes, final)


# ------------------------------------------------------------ GA operators
def _scored_ctes(s: Setup) -> list[tuple[str, str]]:
    return root_ctes(ds_embeddings(s), s) + [
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("pop", population_cte(s, "(SELECT n FROM nf)")),
    ] + fitness_ctes(s, "pop", "g1") + [
        ("scored", """SELECT p.generation, p.individual_id, p.genome, f.fitness
FROM pop p JOIN g1_fit f USING (individual_id)"""),
    ]


def evolve_ctes(s: Setup, src: str, gen: int | None, prefix: str, elitism: int = 1) -> list[tuple[str, str]]:
    """Generation ``gen`` (CTE ``src``) -> CTE ``{prefix}_next`` (generation gen+1).
    Without ``gen`` it is the one in ``src``'s column, and individuals without a
    fitness are replaced by random ones, as the search does."""
    p, n_parts, seed = prefix, s.n_parts, s.seed
    # what follows ``src`` carries its generation, what follows the children has theirs
    carry = "" if gen else "generation, "
    gen, made, nxt = (str(gen), str(gen + 1), str(gen + 1)) if gen else ("generation", "generation + 1", "generation")
    key = f"md5(concat_ws('|', {seed}, generation, individual_id))"
    x_coin = _coin(str(seed), gen, "'x'", "part_id", "k", "i - 1")
    m_draw = ("CAST(" + _hex8(f"md5(concat_ws('|', {seed}, {nxt}, individual_id, 'm', i - 1))")
              + " AS DOUBLE) / CAST(4294967296 AS DOUBLE)")
    if s.mutation_rate > 0:
        mutate = (f"CASE WHEN fitness IS NULL THEN list_transform(genome, lambda b, i: "
                  f"CASE WHEN {m_draw} < CAST({s.mutation_rate!r} AS DOUBLE) THEN 1 - b ELSE b END) ELSE genome END")
    else:
        mutate = "genome"
    born = _coin(str(seed), "generation", "individual_id", "pos")
    refill = "" if not carry else f"""
UNION ALL
SELECT generation, individual_id, list_transform(range(0, width), lambda pos: {born}), NULL
FROM (SELECT generation + 1 AS generation, len(genome) AS width,
        (SELECT count(*) FROM {src}) * {n_parts} + row_number() OVER (ORDER BY individual_id) - 1 AS individual_id
      FROM {src} WHERE fitness IS NULL)"""
    ctes = [
        (f"{p}_parted", f"""SELECT *, {_hex8('sk')} % {n_parts} AS part_id FROM (
  SELECT generation, individual_id, genome, fitness, {key} AS sk FROM {src} WHERE fitness IS NOT NULL)"""),
        (f"{p}_ord", f"""SELECT *, CAST(row_number() OVER (PARTITION BY part_id ORDER BY sk, individual_id) - 1 AS INTEGER) AS p,
       CAST(count(*) OVER (PARTITION BY part_id) AS INTEGER) AS n FROM {p}_parted"""),
        (f"{p}_ext", f"""SELECT {carry}part_id, n, p, individual_id, genome, fitness FROM (
  SELECT {carry}part_id, n, unnest(range(p, n + 5, n)) AS p, individual_id, genome, fitness FROM {p}_ord)"""),
        (f"{p}_win", f"""SELECT {carry}part_id, n, p, w.id AS winner_id, w.genome AS winner_genome, w.fitness AS winner_fitness
FROM (SELECT {carry}part_id, n, p,
        arg_max({{'id': individual_id, 'genome': genome, 'fitness': fitness}},
                (coalesce(CAST(fitness AS DOUBLE), -1.0), -(p % 5)))
          OVER (PARTITION BY part_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w
      FROM {p}_ext)
WHERE p >= 5"""),
        (f"{p}_lagged", f"""SELECT *, lag(winner_id) OVER (PARTITION BY part_id ORDER BY p) AS prev_id,
       lag(winner_genome) OVER (PARTITION BY part_id ORDER BY p) AS prev_genome,
       (p - 5) % 2 AS role FROM {p}_win"""),
        (f"{p}_pairs", f"""SELECT {carry}part_id, n, CAST((p - 5) // 2 AS INTEGER) AS k,
       CASE WHEN p % 2 = 0 THEN winner_id ELSE prev_id END AS p1_id,
       CASE WHEN p % 2 = 0 THEN winner_genome ELSE prev_genome END AS p1_genome,
       CASE WHEN p % 2 = 0 THEN prev_id ELSE winner_id END AS p2_id,
       CASE WHEN p % 2 = 0 THEN prev_genome ELSE winner_genome END AS p2_genome
FROM {p}_lagged WHERE role = 1
UNION ALL
SELECT {carry}part_id, n, CAST((p - 5) // 2 AS INTEGER), winner_id, winner_genome, NULL, NULL
FROM {p}_lagged WHERE role = 0 AND p = n + 4"""),
        (f"{p}_kids", f"""SELECT {carry}part_id, 2 * k AS c,
       CASE WHEN p2_genome IS NULL THEN p1_genome
            ELSE list_transform(p1_genome, lambda a, i: CASE WHEN {x_coin} = 1 THEN a ELSE p2_genome[i] END) END AS genome
FROM {p}_pairs
UNION ALL
SELECT {carry}part_id, 2 * k + 1,
       list_transform(p2_genome, lambda b, i: CASE WHEN {x_coin} = 1 THEN b ELSE p1_genome[i] END)
FROM {p}_pairs WHERE p2_genome IS NOT NULL"""),
        (f"{p}_off0", f"""SELECT {made} AS generation, CAST(c AS BIGINT) * {n_parts} + part_id AS individual_id,
       genome, CAST(NULL AS DOUBLE) AS fitness FROM {p}_kids"""),
        (f"{p}_off", f"""SELECT generation, individual_id, {mutate} AS genome, fitness FROM {p}_off0""" + refill),
    ]
    if elitism <= 0:
        ctes.append((f"{p}_next", f"SELECT * FROM {p}_off"))
        return ctes
    ctes += [
        (f"{p}_drop", f"""SELECT individual_id, row_number() OVER (ORDER BY k) AS rank FROM (
  SELECT individual_id, md5(concat_ws('|', {seed}, {nxt}, individual_id, 'elite')) AS k FROM {p}_off
  ORDER BY k LIMIT {elitism})"""),
        (f"{p}_elite", f"""SELECT {carry}genome, fitness, row_number() OVER (ORDER BY fitness DESC, individual_id) AS rank FROM (
  SELECT * FROM {src} WHERE fitness IS NOT NULL ORDER BY fitness DESC, individual_id LIMIT {elitism})"""),
        (f"{p}_next", f"""SELECT * FROM {p}_off WHERE individual_id NOT IN (SELECT individual_id FROM {p}_drop)
UNION ALL
SELECT {made}, d.individual_id, e.genome, e.fitness FROM {p}_elite e JOIN {p}_drop d USING (rank)"""),
    ]
    return ctes


def _elite_sql(src: str) -> str:
    return f"""SELECT generation, b.id AS best_id, b.genome AS best_genome, b.fitness AS best_fitness,
       CAST(list_sum(b.genome) AS INTEGER) AS n_features, n_scored
FROM (SELECT generation, arg_max({{'id': individual_id, 'genome': genome, 'fitness': fitness}},
                                 (fitness, -individual_id)) AS b, count(*) AS n_scored
      FROM {src} WHERE fitness IS NOT NULL GROUP BY generation)"""


# ---------------------------------------------------------------- logistic
def logistic_ctes(s: Setup, steps: int = 40) -> list[tuple[str, str]]:
    """The optimum of every (individual, block)'s logistic regression by plain
    gradient steps with Barzilai-Borwein lengths -> CTE ``w{steps}`` (m, c, w)."""
    bs, r = s.block_size, range(steps)
    ctes = [
        ("ds", ds_embeddings(s)),
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("pop", population_cte(s, "(SELECT n FROM nf)")),
        ("spread", """SELECT f, stddev_samp(x) AS sd FROM (SELECT unnest(features) AS x, generate_subscripts(features, 1) - 1 AS f
FROM ds WHERE NOT is_test) GROUP BY f"""),
        ("sds", "SELECT list(sd ORDER BY f) AS sd FROM spread"),
        ("models", f"""SELECT individual_id, k AS block, individual_id * 1000 + k AS m,
       list_filter(range(k * {bs} + 1, least((k + 1) * {bs}, len(genome)) + 1), lambda i: genome[i] = 1 AND sds.sd[i] > 0) AS chosen
FROM pop, sds, (SELECT unnest(range(0, CAST(ceil(n / {bs}) AS BIGINT))) AS k FROM nf)"""),
        ("sel", """SELECT ds.rid, ds.row_key, ds.y, ds.is_test, mo.m, list_transform(mo.chosen, lambda i: ds.features[i] / sds.sd[i]) AS xs
FROM ds, models mo, sds WHERE len(mo.chosen) > 0 AND ds.y IS NOT NULL"""),
        ("classes", "SELECT DISTINCT y AS c FROM ds WHERE NOT is_test AND y IS NOT NULL"),
        ("ntr", "SELECT count(*) AS n FROM ds WHERE NOT is_test AND y IS NOT NULL"),
        ("w0", """SELECT m, c, list_transform(chosen, lambda i: CAST(0 AS DOUBLE)) AS w, CAST(NULL AS DOUBLE[]) AS pw,
       CAST(NULL AS DOUBLE[]) AS pg FROM models, classes WHERE len(chosen) > 0"""),
    ]
    for k in r:
        ctes += [
            (f"p{k}", f"""SELECT m, c, xs, e / sum(e) OVER (PARTITION BY rid, m) - CAST(y = c AS INTEGER) AS d
FROM (SELECT sel.rid, sel.y, sel.m, sel.xs, w.c, exp(list_dot_product(sel.xs, w.w)) AS e
      FROM sel JOIN w{k} w USING (m) WHERE NOT sel.is_test)"""),
            (f"g{k}", f"""SELECT m, c, list(g ORDER BY f) AS g FROM (
  SELECT m, c, f, sum(d * xs[f]) / any_value(ntr.n) AS g FROM p{k}, range(1, {bs + 1}) t(f), ntr WHERE f <= len(xs) GROUP BY m, c, f)
GROUP BY m, c"""),
            (f"a{k}", f"""SELECT m, coalesce(CASE WHEN sum(list_dot_product(dw, dg)) > 0
       THEN sum(list_dot_product(dw, dw)) / sum(list_dot_product(dw, dg)) END, CASE WHEN count(dw) = 0 THEN 1 ELSE 0 END) AS a
FROM (SELECT m, list_transform(w.w, lambda x, i: x - w.pw[i]) AS dw, list_transform(g.g, lambda x, i: x - w.pg[i]) AS dg
      FROM w{k} w JOIN g{k} g USING (m, c)) GROUP BY m""" if k else "SELECT m, 1 AS a FROM models"),
            (f"w{k + 1}", f"""SELECT w.m, w.c, list_transform(w.w, lambda x, i: x - a.a * g.g[i]) AS w, w.w AS pw, g.g AS pg
FROM w{k} w JOIN g{k} g USING (m, c) JOIN a{k} a USING (m)"""),
        ]
    ctes += [
        ("scores", f"""SELECT sel.rid, sel.row_key, sel.y, sel.is_test, sel.m, w.c, list_dot_product(sel.xs, w.w) AS z
FROM sel JOIN w{steps} w USING (m)"""),
        ("said", """SELECT row_key, rid, m, y, arg_max(c, (z, -c)) AS predicted FROM scores WHERE is_test GROUP BY ALL"""),
    ]
    return ctes


def plateau_run(ds_sql: str, s: Setup, k: int) -> str:
    """A search to its plateau: the fitness of every genome there is, then
    generations by recursion until ``k`` equal bests."""
    evolve = evolve_ctes(s, "live", None, "e", elitism=1)
    step = [("live", f"SELECT generation, individual_id, genome, fitness FROM run WHERE streak < {k}"),
            ("past", "SELECT max(best) AS best, max(streak) AS streak FROM run")] + evolve + [
        ("scored", """SELECT n.generation, n.individual_id, n.genome, v.fitness, max(v.fitness) OVER () AS top
FROM e_next n LEFT JOIN known v ON v.genome = n.genome""")]
    return _with(root_ctes(ds_sql, s) + [
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("every", """SELECT 1 AS generation, i AS individual_id, list_transform(range(0, n), lambda pos: CAST((i >> pos) & 1 AS INTEGER)) AS genome
FROM nf, range(0, CAST(1 << n AS BIGINT)) t(i)"""),
    ] + fitness_ctes(s, "every", "g1") + [
        ("known", "SELECT genome, fitness FROM every JOIN g1_fit USING (individual_id)"),
        ("first", population_cte(s, "(SELECT n FROM nf)")),
        ("run", f"""SELECT CAST(f.generation AS BIGINT) AS generation, f.individual_id, f.genome, v.fitness,
       max(v.fitness) OVER () AS best, CAST(1 AS BIGINT) AS streak
FROM first f LEFT JOIN known v ON v.genome = f.genome
UNION ALL
SELECT * FROM ({_with(step, """SELECT s.generation, s.individual_id, s.genome, s.fitness, s.top,
       CASE WHEN s.top = p.best THEN p.streak + 1 ELSE 1 END FROM scored s, past p""")})"""),
        ("hist", _elite_sql("run")),
        ("ends", f"SELECT generation, max(streak) >= {k} AS plateau FROM run GROUP BY generation"),
    ], "SELECT CAST(generation AS INTEGER) AS generation, best_id, best_fitness, n_features, n_scored, plateau FROM hist JOIN ends USING (generation)") \
        .replace("WITH ", "WITH RECURSIVE ", 1)


# ------------------------------------------------------------------ queries
def oracle_queries() -> dict[str, str]:
    s = EMB
    q: dict[str, str] = {}
    q["feature_bins"] = _with(binned_ctes(ds_embeddings(s), s),
                              f"SELECT row_key, is_test, f, b AS bin, CAST(f // {s.block_size} AS INTEGER) AS block FROM lng")
    q["class_count"] = _with([("ds", ds_embeddings(s))], """SELECT count(DISTINCT y) AS n_classes, count(*) AS n_rows,
       sum(CASE WHEN NOT is_test THEN 1 ELSE 0 END) AS n_train,
       sum(CASE WHEN is_test THEN 1 ELSE 0 END) AS n_test FROM ds""")
    q["csv_label_attach"] = _with([("ds", ds_embeddings(s))], """SELECT is_test,
       CAST(row_number() OVER (PARTITION BY is_test ORDER BY row_key) - 1 AS BIGINT) AS row_idx,
       CAST(y AS DOUBLE) AS label, CAST(len(features) AS INTEGER) AS n_values,
       features[1] AS first_value, features[-1] AS last_value
FROM ds""")
    q["csv_rejects"] = """WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, vec_id, len(embedding) AS n, max(len(embedding)) OVER () AS width FROM embeddings),
t AS (SELECT *, n - CASE WHEN vec_id % 50 = 7 THEN 1 ELSE 0 END AS kept FROM e),
f AS (SELECT t.*, i FROM t, range(1, 4097) r(i) WHERE i <= kept)
SELECT row_idx, CAST(i AS INTEGER) AS field, 'number' AS reason, CASE WHEN (vec_id + i - 1) % 97 = 0 THEN 'n/a' ELSE '' END AS value
FROM f WHERE kept = width AND ((vec_id + i - 1) % 97 = 0 OR (vec_id + i - 1) % 89 = 0)
UNION ALL SELECT row_idx, NULL, 'fields', CAST(kept AS VARCHAR) FROM t WHERE kept <> width"""
    q["masked_projection"] = _with([
        ("ds", ds_embeddings(s)),
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("g0", f"""SELECT list_transform(range(0, (SELECT n FROM nf)), lambda pos: {_coin(str(s.seed), '1', '0', 'pos')}) AS genome"""),
        ("kept", "SELECT ds.row_key, list_filter(ds.features, lambda x, i: g0.genome[i] = 1) AS kept FROM ds, g0"),
    ], """SELECT row_key, CAST(len(kept) AS INTEGER) AS n_kept, unnest(kept) AS value,
       CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS pos FROM kept""")
    q["tree_fitness_quantile"] = _fitness_report(ds_embeddings(s), s, "quantiles")
    q["tree_fitness_raw"] = _fitness_report(ds_embeddings(s), s, "strides")
    q["tree_fitness_wide"] = _fitness_report(ds_wide(WIDE), WIDE)
    q["tree_fitness_many_classes"] = _fitness_report(ds_lineitem(MANY, "l_partkey"), MANY)
    odd = ds_embeddings(s).replace("list_transform(embedding, lambda x: CAST(x AS DOUBLE))", """list_transform(embedding,
       lambda x, i: CASE WHEN (vec_id + i - 1) % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN (vec_id + i - 1) % 89 = 0 THEN CAST('inf' AS DOUBLE)
            WHEN (vec_id + i - 1) % 83 = 0 THEN CAST('-inf' AS DOUBLE) WHEN (vec_id + i - 1) % 79 = 0 THEN NULL
            ELSE CAST(x AS DOUBLE) END)""")
    q["feature_bins_missing"] = _with(binned_ctes(odd, s), "SELECT row_key, is_test, f, b AS bin FROM lng")
    q["root_histogram"] = _with(root_ctes(ds_embeddings(s), s), "SELECT f, b, y, n_train, n_test FROM root_hist")
    q["root_splits"] = _with(root_ctes(ds_embeddings(s), s),
                             "SELECT f, t, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, score FROM rs_best")
    q["tree_fitness_embeddings"] = _fitness_report(ds_embeddings(s), s)
    q["tree_fitness_lineitem"] = _fitness_report(ds_lineitem(LINEITEM), LINEITEM)
    q["tree_fitness_documents"] = _fitness_report(ds_documents(DOCS), DOCS)

    sc = _scored_ctes(s)
    ev = evolve_ctes(s, "scored", 1, "e1", elitism=1)
    q["random_partition"] = _with(sc + ev, "SELECT individual_id, part_id, p, n, fitness FROM e1_ord")
    q["tournament_winners"] = _with(sc + ev, "SELECT part_id, n, p, winner_id, winner_fitness FROM e1_win")
    q["tournament_pairs"] = _with(sc + ev, "SELECT part_id, k, p1_id, p2_id FROM e1_pairs")
    q["tournament_ranges"] = _with([("pop", """SELECT 1 AS generation, o_orderkey AS individual_id, [1] AS genome,
       CAST(o_totalprice AS DOUBLE) AS fitness FROM orders""")] + evolve_ctes(ORDERS, "pop", 1, "e1", elitism=0),
        "SELECT part_id, n, k, p1_id, p2_id FROM e1_pairs")
    q["uniform_crossover"] = _with(sc + ev, f"SELECT part_id, c, {_genome_text('genome')} AS genome_text FROM e1_kids")
    q["bit_mutation"] = _with(sc + ev, f"""SELECT individual_id, {_genome_text('genome')} AS genome_text
FROM e1_off WHERE fitness IS NULL""")
    q["next_generation"] = _with(sc + ev, f"SELECT generation, individual_id, {_genome_text('genome')} AS genome_text, fitness FROM e1_next")
    q["elite_per_part"] = _with(sc + ev, """SELECT part_id, count(*) AS n_scored, b.id AS individual_id, b.fitness AS fitness
FROM (SELECT part_id, arg_max({'id': individual_id, 'fitness': fitness}, (fitness, -p)) OVER (PARTITION BY part_id) AS b
      FROM e1_ord WHERE fitness IS NOT NULL)
GROUP BY part_id, b.id, b.fitness""")
    q["elites_read_back"] = _with(sc + ev + [("elites", """SELECT generation, individual_id, genome, fitness FROM e1_ord
QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY fitness DESC, p) = 1"""), ("best", _elite_sql("elites"))],
        "SELECT generation, best_id, best_fitness, n_features, n_scored FROM best")
    q["genome_decode"] = _with(sc, """SELECT individual_id, CAST(list_sum(genome) AS INTEGER) AS n_selected, true AS same,
       array_to_string(genome, '') AS bits FROM scored""")
    q["unscored_filter"] = _with(sc + ev, "SELECT generation, individual_id FROM e1_next WHERE fitness IS NULL")
    q["valid_fitness"] = _with(sc, """SELECT individual_id, fitness, fitness >= 0 AND fitness < 1 AS legacy FROM scored
WHERE individual_id % 5 <> 0""")
    q["elite_global"] = _with(sc + [("best", _elite_sql("scored"))], f"""SELECT generation, best_id, best_fitness, n_features, n_scored,
       printf('Iteration = %d\nFinal Individual - %s\nAccuracy = %.9f', generation, {_genome_text('best_genome')},
              CAST(best_fitness AS DOUBLE)) AS report FROM best""")
    q["scored_filter"] = _with(sc, """SELECT individual_id, fitness FROM scored
WHERE fitness IS NOT NULL AND fitness <> 0 AND list_contains(genome, 1)""")
    g2 = fitness_ctes(s, "e1_todo", "g2")
    q["generation_plateau"] = _with(sc + ev + [("e1_todo", "SELECT * FROM e1_next WHERE fitness IS NULL")] + g2 + [
        ("scored2", """SELECT n.generation, n.individual_id, n.genome, coalesce(n.fitness, f.fitness) AS fitness
FROM e1_next n LEFT JOIN g2_fit f USING (individual_id)"""),
        ("hist", _elite_sql("scored") + "\nUNION ALL\n" + _elite_sql("scored2")),
    ], """SELECT generation, best_id, best_fitness, n_features,
       (count(*) OVER w = 2 AND max(best_fitness) OVER w = min(best_fitness) OVER w) AS plateau
FROM hist WINDOW w AS (ORDER BY generation ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
    g3 = evolve_ctes(s, "scored2", 2, "e2", elitism=1) + [
        ("e2_todo", "SELECT * FROM e2_next WHERE fitness IS NULL")] + fitness_ctes(s, "e2_todo", "g3")
    report = ("printf('Iteration = %d\nFinal Individual - %s\nAccuracy = %.9f', generation, "
              + _genome_text("best_genome") + ", CAST(best_fitness AS DOUBLE))")
    q["search_history"] = _with(sc + ev + [("e1_todo", "SELECT * FROM e1_next WHERE fitness IS NULL")] + g2 + [
        ("scored2", """SELECT n.generation, n.individual_id, n.genome, coalesce(n.fitness, f.fitness) AS fitness
FROM e1_next n LEFT JOIN g2_fit f USING (individual_id)"""),
    ] + g3 + [
        ("scored3", """SELECT n.generation, n.individual_id, n.genome, coalesce(n.fitness, f.fitness) AS fitness
FROM e2_next n LEFT JOIN g3_fit f USING (individual_id)"""),
        ("hist", _elite_sql("scored") + "\nUNION ALL\n" + _elite_sql("scored2") + "\nUNION ALL\n"
         + _elite_sql("scored3")),
    ], f"""SELECT generation, best_id, best_fitness, n_features, n_scored, {report} AS report FROM hist""")
    q["search_to_plateau"] = plateau_run(ds_documents(DOCS), DOCS, 4)
    ms = EMB
    q["tree_fitness_mllib"] = _with(root_ctes(ds_embeddings(ms), ms) + [
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("pop", population_cte(ms, "(SELECT n FROM nf)")),
    ] + fitness_ctes(ms, "pop", "g1"), "SELECT individual_id, correct, fitness FROM g1_fit")
    # the leaf that a row falls into: its side of the root, then of the child's split
    q["tree_predictions"] = _with(root_ctes(ds_embeddings(ms), ms) + [
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("pop", population_cte(ms, "(SELECT n FROM nf)")),
    ] + fitness_ctes(ms, "pop", "g1") + [
        ("split_class", """SELECT node, f, t, side, y FROM g1_split_cells
QUALIFY row_number() OVER (PARTITION BY node, f, t, side ORDER BY n_train DESC, y) = 1"""),
        ("node_class", "SELECT node, y FROM g1_node_cells QUALIFY row_number() OVER (PARTITION BY node ORDER BY n_train DESC, y) = 1"),
        ("trees", "SELECT DISTINCT individual_id, block FROM g1_genes"),
        ("routed", """SELECT l.rid, l.row_key, t.individual_id, t.block, CASE WHEN r.r IS NULL THEN -1
       WHEN l.b <= r.t_r THEN 2 * r.r ELSE 2 * r.r + 1 END AS node
FROM trees t LEFT JOIN g1_root r USING (individual_id, block)
JOIN lng l ON l.is_test AND l.f = coalesce(r.r, 0)"""),
        ("deep", """SELECT ro.*, c.f, c.t, CASE WHEN l.b <= c.t THEN 0 ELSE 1 END AS side
FROM routed ro LEFT JOIN g1_chosen c ON c.individual_id = ro.individual_id AND c.block = ro.block AND c.node = ro.node
LEFT JOIN lng l ON l.rid = ro.rid AND l.f = c.f"""),
    ], """SELECT d.row_key, d.individual_id, CAST(d.block AS INTEGER) AS block, CASE WHEN d.f IS NULL THEN n.y ELSE s.y END AS predicted
FROM deep d LEFT JOIN node_class n ON n.node = d.node
LEFT JOIN split_class s ON s.node = d.node AND s.f = d.f AND s.t = d.t AND s.side = d.side""")
    q["logistic_predictions"] = _with(logistic_ctes(ms), """SELECT row_key, CAST(m // 1000 AS BIGINT) AS individual_id,
       CAST(m % 1000 AS INTEGER) AS block, predicted FROM said""")
    q["logistic_fitness"] = _with(logistic_ctes(ms) + [
        ("hits", "SELECT m, sum(CAST(y = predicted AS INTEGER)) AS right_rows, count(*) AS n FROM said GROUP BY m"),
        ("losses", """SELECT m, avg(ln(total) - own) AS loss FROM (
  SELECT m, rid, sum(exp(z)) AS total, sum(CASE WHEN c = y THEN z END) AS own FROM scores WHERE NOT is_test GROUP BY m, rid)
GROUP BY m"""),
        ("each", """SELECT mo.individual_id, count(*) AS blocks, count(h.m) AS fitted, CAST(coalesce(sum(h.right_rows), 0) AS BIGINT) AS correct,
       any_value(h.n) AS n, avg(lo.loss) AS loss FROM models mo LEFT JOIN hits h USING (m) LEFT JOIN losses lo USING (m)
GROUP BY mo.individual_id"""),
    ], """SELECT individual_id, correct, CASE WHEN fitted = blocks THEN CAST(correct AS DOUBLE) / CAST(blocks * n AS DOUBLE) END AS fitness,
       round(CASE WHEN fitted = blocks THEN loss END, 9) AS train_loss FROM each""")
    q["naive_bayes_fitness"] = _with([
        ("ds", ds_embeddings(ms)),
        ("nf", "SELECT max(len(features)) AS n FROM ds"),
        ("pop", population_cte(ms, "(SELECT n FROM nf)")),
        ("lng", "SELECT rid, y, is_test, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS f FROM ds"),
        ("prior", "SELECT y AS c, count(*) / (SELECT count(*) FROM ds WHERE NOT is_test) AS p FROM ds WHERE NOT is_test GROUP BY y"),
        ("stats", "SELECT y AS c, f, avg(x) AS m, var_pop(x) + 1e-9 AS v FROM lng WHERE NOT is_test GROUP BY y, f"),
        ("dens", """SELECT l.rid, l.y, l.f, s.c, -0.5 * (ln(2 * pi() * s.v) + (l.x - s.m) * (l.x - s.m) / s.v) AS d
FROM lng l JOIN stats s USING (f) WHERE l.is_test"""),
        ("gn", f"""SELECT individual_id, f, f // {ms.block_size} AS block FROM (
  SELECT individual_id, unnest(genome) AS bit, generate_subscripts(genome, 1) - 1 AS f FROM pop) WHERE bit = 1"""),
        ("score", """SELECT g.individual_id, g.block, d.rid, d.y, d.c, sum(d.d) + ln(any_value(p.p)) AS z
FROM gn g JOIN dens d USING (f) JOIN prior p ON p.c = d.c GROUP BY ALL"""),
        ("said", "SELECT individual_id, block, rid, y, arg_max(c, (z, -c)) AS c FROM score GROUP BY ALL"),
        ("hit", "SELECT individual_id, sum(CAST(y = c AS INTEGER)) AS correct, count(DISTINCT block) AS used FROM said GROUP BY individual_id"),
        ("whole", f"""SELECT CAST(ceil(any_value(nf.n) / {ms.block_size}) AS BIGINT) AS blocks, count(*) AS n FROM ds, nf WHERE is_test"""),
    ], """SELECT p.individual_id, CAST(coalesce(h.correct, 0) AS BIGINT) AS correct,
       CASE WHEN h.used = w.blocks THEN CAST(h.correct AS DOUBLE) / CAST(w.blocks * w.n AS DOUBLE) END AS fitness
FROM pop p LEFT JOIN hit h USING (individual_id), whole w""")
    return q
