"""SQL building blocks that state each query's result for an independent engine."""

from __future__ import annotations

from panelloom.operators.isolation import SPARE
from panelloom.plans.fixtures import (
    ANOMALY_SCORES_SQL, BLOCK, IMAGE_FEATURES_SQL, PALETTE, PANEL_SQL, SIDE, TABLES)
from panelloom.spec import FEATURES, GRADES, INDICATORS, PILLARS

START = 1984
NAMES = {t: t for t in TABLES}
FE = list(FEATURES)
NUMBERS = ["population", "gdp", *FE]
DERIVED = ["co2_yoy_change", "co2_rolling5", "fossil_ratio", "renewable_proxy", "co2_intensity"]
W = "(PARTITION BY country ORDER BY year"


def rnd(expression: str, name: str | None = None, digits: int = 7) -> str:
    return f"round({expression}, {digits}) AS {name or expression}"


def dec(expression: str, digits: int) -> str:
    """Half-up rounding of the decimal digits, as Spark rounds doubles."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def cols(plain, rounded=(), digits: int = 7) -> str:
    return ", ".join([*plain, *[rnd(c, digits=digits) for c in rounded]])


def cleaned(start: int) -> str:
    known = " OR ".join(f"{c} IS NOT NULL" for c in FE)
    fill = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) OVER {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0E0) AS {c}"
        for c in FE)
    return (f"SELECT country, iso_code, year, population, gdp, {fill} FROM panel "
            f"WHERE length(iso_code) = 3 AND year >= {start} AND ({known})")


FEATURE_SELECT = f"""
SELECT *, 1.0E0 - fossil_ratio AS renewable_proxy FROM (
  SELECT *,
    coalesce((co2 - lag(co2) OVER {W})) / nullif(lag(co2) OVER {W}), 0) * 100, 0) AS co2_yoy_change,
    avg(co2) OVER {W} ROWS 4 PRECEDING) AS co2_rolling5,
    least(greatest((coalesce(coal_co2,0) + coalesce(oil_co2,0) + coalesce(gas_co2,0)) / (co2 + 1e-9), 0), 1) AS fossil_ratio,
    co2 / (gdp + 1e-9) AS co2_intensity
  FROM %s)"""


def bounds(columns) -> str:
    return ", ".join(f"quantile_cont({c}, 0.01) AS {c}_low, quantile_cont({c}, 0.99) AS {c}_high" for c in columns)


SCORED = [i for i in INDICATORS if i.column in FE or i.column == "fossil_ratio"]
_TOTAL = sum(i.weight for i in INDICATORS)


def norm(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c}_high IS NULL OR {c}_high = {c}_low THEN 0.5E0 "
            f"ELSE 1.0E0 - least(greatest(({c} - {c}_low) / ({c}_high - {c}_low), 0), 1) END")


def grade_case(x: str, position: int) -> str:
    whens = " ".join(f"WHEN {x} >= {g[0]} THEN '{g[position]}'" for g in GRADES if g[0] is not None)
    return f"CASE {whens} ELSE '{GRADES[-1][position]}' END"


def _pillar(p) -> str:
    parts = [c for c in p.columns if c in FE or c in DERIVED]
    norms = [f"(1.0E0 - least(greatest(({c} - {c}_low) / (CASE WHEN {c}_high = {c}_low THEN 1 ELSE {c}_high - {c}_low END), 0), 1))"
             for c in parts]
    # least/greatest skip nulls, so guard the null input.
    norms = [f"CASE WHEN {c} IS NULL THEN NULL ELSE {n} END" for c, n in zip(parts, norms)]
    total = " + ".join(f"coalesce({n}, 0)" for n in norms)
    count = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in parts)
    return f"coalesce(({total}) / nullif({count}, 0) * 100, 50.0E0)"


PILLAR_COLUMNS = [c for p in PILLARS for c in p.columns if c in FE or c in DERIVED]

CTES = {
    "panel": PANEL_SQL.format(**NAMES),
    "image_features": IMAGE_FEATURES_SQL.format(**NAMES),
    "anomaly_scores": ANOMALY_SCORES_SQL.format(**NAMES),
    "kept": cleaned(START),
    "feat": FEATURE_SELECT % "kept",
    "kept90": cleaned(1990),
    "feat90": FEATURE_SELECT % "kept90",
    "bounds": f"SELECT {bounds([i.column for i in SCORED])} FROM feat",
    "normed": "SELECT country, year, " + ", ".join(f"{norm(i.column)} AS norm_{i.column}" for i in SCORED)
              + " FROM feat, bounds",
    "based": "SELECT country, year, round(coalesce((" + " + ".join(
        f"coalesce(norm_{i.column} * {i.weight / _TOTAL!r}E0, 0)" for i in SCORED) + ") / nullif(" + " + ".join(
        f"(CASE WHEN norm_{i.column} IS NULL THEN 0 ELSE {i.weight / _TOTAL!r}E0 END)" for i in SCORED)
        + ", 0) * 100, 50), 2) AS base, " + ", ".join(
        f"round(norm_{i.column} * 100, 2) AS score_{i.column}" for i in SCORED) + " FROM normed",
    "scored": f"""
SELECT country, year, CAST(round(least(greatest(s + least(greatest(change, -5), 5) * CAST(0.3 AS DECIMAL(2,1)), 0), 100), 2) AS DOUBLE)
         AS sustainability_score, CAST(change AS DOUBLE) AS score_yoy_change
FROM (SELECT *, coalesce(s - lag(s) OVER {W}), 0) AS change
      FROM (SELECT country, year, CAST(base AS DECIMAL(10,2)) AS s FROM based))""",
    "latest": "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1",
    "board": f"""
SELECT row_number() OVER (ORDER BY sustainability_score DESC, country) AS rank, country, year, sustainability_score,
       {grade_case('sustainability_score', 1)} AS grade, {grade_case('sustainability_score', 2)} AS label FROM latest""",
    "kpis": f"""
SELECT {dec('avg(CAST(sustainability_score AS DECIMAL(10,2)))', 1)} AS global_avg_score,
       {dec('quantile_cont(sustainability_score, 0.5)', 1)} AS global_median_score,
       count(*) FILTER (sustainability_score >= 80) AS countries_excellent,
       count(*) FILTER (sustainability_score < 35) AS countries_critical,
       (SELECT country FROM latest ORDER BY sustainability_score DESC, country LIMIT 1) AS top_country,
       (SELECT country FROM latest ORDER BY sustainability_score, country LIMIT 1) AS bottom_country,
       {dec('max(sustainability_score)', 1)} AS top_score, {dec('min(sustainability_score)', 1)} AS bottom_score
FROM latest""",
    "pbounds": f"SELECT {bounds(PILLAR_COLUMNS)} FROM feat",
    "pillars": "SELECT country, year, " + ", ".join(
        f'{_pillar(p)} AS p{i}' for i, p in enumerate(PILLARS)) + " FROM feat, pbounds",
    "zscores": f"""
SELECT *, CASE WHEN n >= 2 THEN (co2 - m) / (CASE WHEN sd = 0 THEN 1e-9 ELSE sd END) END AS zscore
FROM (SELECT country, year, co2, avg(co2) OVER {W} ROWS 4 PRECEDING) AS m,
             stddev_samp(co2) OVER {W} ROWS 4 PRECEDING) AS sd, count(co2) OVER {W} ROWS 4 PRECEDING) AS n FROM feat)""",
    "known": "SELECT country, year, co2 AS v, row_number() OVER (PARTITION BY country ORDER BY year) AS i, "
             "row_number() OVER (PARTITION BY country ORDER BY year DESC) AS rev FROM feat WHERE co2 IS NOT NULL",
    "tails": """
SELECT country, CAST(max(year) AS INT) AS last_year, max(v) FILTER (rev = 1) AS last_value,
       avg(v) FILTER (rev <= 5) AS recent_mean,
       (max(v) FILTER (rev = 1) - max_by(v, rev) FILTER (rev <= 6)) / nullif(least(count(*), 6) - 1, 0) AS recent_trend
FROM known GROUP BY country""",
    "steps": "SELECT CAST(unnest(range(1, 11)) AS INT) AS step",
    "trend": "SELECT country, last_year + step AS year, recent_mean + recent_trend * step AS predicted FROM tails, steps",
    "smooth": """
SELECT a.country, CAST(2 AS BIGINT) AS i, a.v AS level, b.v - a.v AS trend
FROM known a JOIN known b ON a.country = b.country AND a.i = 1 AND b.i = 2
UNION ALL
SELECT h.country, k.i, 0.3E0 * k.v + 0.7E0 * (h.level + h.trend),
       0.1E0 * ((0.3E0 * k.v + 0.7E0 * (h.level + h.trend)) - h.level) + 0.9E0 * h.trend
FROM smooth h JOIN known k ON k.country = h.country AND k.i = h.i + 1""",
    "fitted": """
SELECT s.country, t.last_year, s.level, s.trend FROM smooth s JOIN tails t ON s.country = t.country
QUALIFY row_number() OVER (PARTITION BY s.country ORDER BY s.i DESC) = 1""",
    "ahead": "SELECT country, last_year + step AS year, level + step * trend AS predicted FROM fitted, steps",
    "yearly": "SELECT year, coalesce(sum(co2), 0) AS co2 FROM feat GROUP BY year",
    "gknown": "SELECT year, co2 AS v, row_number() OVER (ORDER BY year) AS i FROM yearly",
    "gsmooth": """
SELECT CAST(2 AS BIGINT) AS i, a.v AS level, b.v - a.v AS trend FROM gknown a JOIN gknown b ON a.i = 1 AND b.i = 2
UNION ALL
SELECT k.i, 0.3E0 * k.v + 0.7E0 * (h.level + h.trend),
       0.1E0 * ((0.3E0 * k.v + 0.7E0 * (h.level + h.trend)) - h.level) + 0.9E0 * h.trend
FROM gsmooth h JOIN gknown k ON k.i = h.i + 1""",
    "frames": "SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) "
              "AS frame_no, event_id FROM events",
    # Derived images: one row per palette block.
    "palette": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {b}.0E0, {g}.0E0, {r}.0E0)" for i, (b, g, r) in enumerate(PALETTE)) + ") t(idx, b, g, r)",
    "blocks": f"""
SELECT vec_id, k % {SIDE} AS x, k // {SIDE} AS y, b, g, r, greatest(b, g, r) AS mx, least(b, g, r) AS mn
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) e
JOIN palette p ON p.idx = CAST(floor((CAST(e.v AS DOUBLE) + 1) * 1000) AS BIGINT) % {len(PALETTE)}""",
    "hsv": """
SELECT *, floor((CASE WHEN mx = mn THEN 0 ELSE ((raw % 180) + 180) % 180 END) + 0.5) AS h,
       floor((CASE WHEN mx = 0 THEN 0 ELSE 255.0E0 * (mx - mn) / mx END) + 0.5) AS s, mx AS val,
       floor(0.114E0 * b + 0.587E0 * g + 0.299E0 * r + 0.5) AS gray
FROM (SELECT *, CASE WHEN mx = mn THEN 0 WHEN mx = r THEN 30 * (g - b) / (mx - mn)
                     WHEN mx = g THEN 60 + 30 * (b - r) / (mx - mn) ELSE 120 + 30 * (r - g) / (mx - mn) END AS raw FROM blocks)""",
    "masks": """
SELECT *, brown OR dark AS waste FROM (
  SELECT vec_id, x, y, gray, s <= 50 AND val >= 150 AS smoke,
         h BETWEEN 10 AND 20 AND s >= 50 AND val BETWEEN 50 AND 200 AS brown, val <= 80 AS dark,
         h BETWEEN 35 AND 85 AND s >= 40 AND val >= 40 AS green,
         h BETWEEN 5 AND 30 AND s BETWEEN 30 AND 200 AND val BETWEEN 80 AND 220 AS bare
  FROM hsv)""",
    "steps4": f"""
SELECT m.*, coalesce(lag(gray) OVER (PARTITION BY vec_id, y ORDER BY x) - gray, 0) AS dl,
       coalesce(lead(gray) OVER (PARTITION BY vec_id, y ORDER BY x) - gray, 0) AS dr,
       coalesce(lag(gray) OVER (PARTITION BY vec_id, x ORDER BY y) - gray, 0) AS du,
       coalesce(lead(gray) OVER (PARTITION BY vec_id, x ORDER BY y) - gray, 0) AS dd FROM masks m""",
    "pixelstats": f"""
SELECT CAST(vec_id AS VARCHAR) AS image_id, avg(CAST(smoke AS INT)) AS smoke_ratio, avg(CAST(brown AS INT)) AS brown_ratio,
       avg(CAST(dark AS INT)) AS dark_ratio, avg(CAST(waste AS INT)) AS waste_ratio, avg(CAST(green AS INT)) AS green_ratio,
       avg(CAST(bare AS INT)) AS bare_ratio, stddev_pop(gray) AS gray_std,
       sum({BLOCK - 2} * (dl*dl + dr*dr + du*du + dd*dd) + (dl+du)*(dl+du) + (dl+dd)*(dl+dd) + (dr+du)*(dr+du) + (dr+dd)*(dr+dd))
         / {SIDE * SIDE * BLOCK * BLOCK} - power(sum({BLOCK} * (dl + dr + du + dd)) / {SIDE * SIDE * BLOCK * BLOCK}, 2) AS laplacian_var
FROM steps4 GROUP BY vec_id""",
    "greys": f"SELECT vec_id, gray, count(*) / {SIDE * SIDE}.0E0 AS p FROM hsv GROUP BY 1, 2",
    "texture": """
SELECT CAST(vec_id AS VARCHAR) AS image_id, -sum(p * log2(p + 1e-9)) AS entropy FROM greys GROUP BY vec_id""",
    "cells3": """
SELECT vec_id, x, y, 'Smoke / Air Pollution' AS issue, 500 AS least_px FROM masks WHERE smoke
UNION ALL SELECT vec_id, x, y, 'Garbage / Illegal Dumping', 300 FROM masks WHERE waste
UNION ALL SELECT vec_id, x, y, 'Deforestation / Vegetation Loss', 500 FROM masks WHERE bare""",
    "reach": f"""
SELECT vec_id, issue, least_px, x AS fx, y AS fy, x, y FROM cells3
UNION
SELECT c.vec_id, c.issue, c.least_px, r.fx, r.fy, c.x, c.y FROM reach r JOIN cells3 c
  ON c.vec_id = r.vec_id AND c.issue = r.issue AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1""",
    "owned": f"SELECT vec_id, issue, least_px, fx, fy, min(y * {SIDE} + x) AS root FROM reach GROUP BY ALL",
    "boxes": f"""
SELECT CAST(vec_id AS VARCHAR) AS image_id, issue, CAST(min(fx) * {BLOCK} AS INT) AS x, CAST(min(fy) * {BLOCK} AS INT) AS y,
       CAST((max(fx) - min(fx) + 1) * {BLOCK} AS INT) AS w, CAST((max(fy) - min(fy) + 1) * {BLOCK} AS INT) AS h,
       CAST(count(*) * {BLOCK * BLOCK} AS INT) AS area
FROM owned GROUP BY vec_id, issue, least_px, root HAVING count(*) * {BLOCK * BLOCK} > least_px""",
}

# What each block reads, in the order they must appear.
NEEDS = {
    "kept": ["panel"], "feat": ["kept"], "kept90": ["panel"], "feat90": ["kept90"], "bounds": ["feat"],
    "normed": ["feat", "bounds"], "based": ["normed"], "scored": ["based"], "latest": ["scored"],
    "board": ["latest"], "kpis": ["latest"], "pbounds": ["feat"], "pillars": ["feat", "pbounds"],
    "zscores": ["feat"], "known": ["feat"], "tails": ["known"], "trend": ["tails", "steps"],
    "smooth": ["known"], "fitted": ["smooth", "tails"], "ahead": ["fitted", "steps"],
    "yearly": ["feat"], "gknown": ["yearly"], "gsmooth": ["gknown"],
    "blocks": ["palette"], "hsv": ["blocks"], "masks": ["hsv"], "steps4": ["masks"], "pixelstats": ["steps4"],
    "greys": ["hsv"], "texture": ["greys"], "cells3": ["masks"], "reach": ["cells3"], "owned": ["reach"],
    "boxes": ["owned"],
}


def sql(select: str, *blocks: str, **extra: str) -> str:
    """A statement over the named blocks (and whatever they need) plus ad-hoc ones."""
    order: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for b in blocks:
        add(b)
    parts = [f"{b} AS ({CTES[b].strip()})" for b in order] + [f"{n} AS MATERIALIZED ({t})" for n, t in extra.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + select


def forest_blocks(source: str, columns, trees: int, sample: int, seed: int) -> dict[str, str]:
    """Blocks that draw, grow and score an isolation forest level by level; scaling a feature doesn't change it."""
    xs = ", ".join(f"x{i}" for i in range(len(columns)))
    deep = (sample - 1).bit_length()
    mean = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329E0) - 2.0E0 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0E0 ELSE 0.0E0 END"
    pick = lambda kind: "CASE feature " + " ".join(f"WHEN {i} THEN {kind}{i}" for i in range(len(columns))) + " END"
    number = lambda at: f"CAST(concat('0x', substr(digits, {at}, 8)) AS BIGINT)"
    out = {
        "fx": "SELECT country, year, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS x{i}" for i, c in enumerate(columns)) + f" FROM {source}",
        "fn": f"SELECT least(1.0E0, {SPARE}E0 * {sample} / count(*)) AS share FROM fx",
        "fb": f"""SELECT list(CAST(floor(total * 4503599627370496.0E0) AS BIGINT) ORDER BY k) AS bounds FROM (
            SELECT k, sum(exp(lgamma({trees + 1}) - lgamma(k + 1) - lgamma({trees + 1} - k) + k * ln(share) + ({trees} - k) * ln(1 - share)))
                      OVER (ORDER BY k) AS total FROM range(0, {trees}) g(k), fn WHERE share < 1)""",
        "fp": f"""SELECT country, year, {trees + 1} - number AS j, CAST([] AS BIGINT[]) AS got FROM (
              SELECT country, year, CASE WHEN share < 1 THEN len(list_filter(bounds, lambda b: b <=
                CAST(concat('0x', substr(md5(concat_ws('|', country, year, {seed})), 1, 13)) AS BIGINT))) ELSE {trees} END AS number FROM fx, fn, fb)
            UNION ALL
            SELECT country, year, j + 1, list_append(got, CASE WHEN list_contains(got, t) THEN j ELSE t END)
            FROM (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', country, year, {seed}, 'enters', j)), 1, 8)) AS BIGINT) % j + 1 AS t
                  FROM fp WHERE j <= {trees})""",
        "fe": f"SELECT country, year, CAST(unnest(got) - 1 AS BIGINT) AS tree FROM fp WHERE j = {trees + 1}",
        "fs0": f"""SELECT tree, 1 AS node, {xs} FROM (SELECT fx.*, tree, row_number() OVER (PARTITION BY tree
            ORDER BY md5(concat_ws('|', fx.country, fx.year, {seed}, tree)), fx.country, fx.year) AS k
            FROM fx JOIN fe ON fx.country = fe.country AND fx.year = fe.year) WHERE k <= {sample}""",
        "fw0": f"SELECT country, year, tree, 1 AS node, {xs} FROM fx, range(0, {trees}) g(tree)"}
    nodes, paths = [], []
    for d in range(deep + 1):
        ends = ", ".join(f"min(x{i}) AS l{i}, max(x{i}) AS h{i}" for i in range(len(columns)))
        out[f"ft{d}"] = f"SELECT tree, node, count(*) AS n, {ends} FROM fs{d} GROUP BY tree, node"
        spread = "list_concat(" * (len(columns) - 1) + ", ".join(
            f"CASE WHEN h{i} > l{i} THEN [{i}] ELSE [] END" + (")" if i else "") for i in range(len(columns)))
        out[f"fc{d}"] = f"""SELECT *, {pick('l')} + ({number(9)} + 0.5E0) / 4294967296.0E0 * ({pick('h')} - {pick('l')}) AS cut FROM (
            SELECT *, spread[{number(1)} % len(spread) + 1] AS feature FROM (
              SELECT *, {spread} AS spread, md5(concat_ws('|', {seed}, tree, node)) AS digits FROM ft{d})
            WHERE n > 1 AND len(spread) > 0 AND {d} < {deep})"""
        nodes.append(f"SELECT t.tree, {d} AS depth, t.n, c.node IS NULL AS leaf FROM ft{d} t LEFT JOIN fc{d} c USING (tree, node)")
        paths.append(f"""SELECT w.country, w.year, {d} + {mean('t.n')} AS path FROM fw{d} w JOIN ft{d} t USING (tree, node)
            LEFT JOIN fc{d} c USING (tree, node) WHERE c.cut IS NULL""")
        if d < deep:
            below = f"2 * c.node + CASE WHEN {pick('x')} <= cut THEN 0 ELSE 1 END AS node"
            out[f"fs{d + 1}"] = f"SELECT a.tree, {below}, {xs} FROM fs{d} a JOIN fc{d} c ON a.tree = c.tree AND a.node = c.node"
            out[f"fw{d + 1}"] = f"SELECT country, year, a.tree, {below}, {xs} FROM fw{d} a JOIN fc{d} c ON a.tree = c.tree AND a.node = c.node"
    out["fnodes"] = " UNION ALL ".join(nodes)
    out["fscore"] = f"SELECT country, year, -pow(2.0E0, -avg(path) / ({mean(float(sample))})) AS if_score FROM ({' UNION ALL '.join(paths)}) GROUP BY country, year"
    out["fcut"] = "SELECT quantile_cont(if_score, 0.05) AS cut FROM fscore"
    return out


def regression_blocks(source: str, target: str, passive, trees: int, depth: int, seed: int, bins: int, units: int,
                      asked: str = "rbin") -> dict[str, str]:
    """Blocks that build lag rows, draw, grow level by level and predict a regression forest; rows are no more than a sample.

    `asked` names the rows to predict: the training rows, or `rnext`, the period after each key's last.
    """
    lag = lambda n: f"lag({target}, {n}) OVER {W})"
    mean = lambda n: f"avg({target}) OVER {W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    inputs = {**{f"{target}_lag{n}": lag(n) for n in (1, 2, 3, 5)}, f"{target}_diff1": f"{lag(1)} - {lag(2)}",
              f"{target}_rolling3": mean(3), f"{target}_rolling5": mean(5), "year": "year", **{c: c for c in passive}}
    names = list(inputs)
    xs = ", ".join(f"CAST({e} AS DOUBLE)" for e in inputs.values())
    width = len(names)
    ago = lambda n: f"coalesce(h[{n}], h[1])"
    recent = lambda n: f"list_avg(h[1:{n}])"
    following = [*map(ago, (1, 2, 3, 5)), f"h[1] - {ago(2)}", recent(3), recent(5), "year", *passive]
    out = {
        "rrow": f"""SELECT country, year, t, x FROM (SELECT country, year, {target} AS t, [{xs}] AS x FROM {source})
            WHERE t IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL)) = 0""",
        "rend": "SELECT min(t) AS low, max(t) AS high, count(*) AS n FROM rrow",
        "rcut": f"""SELECT list(cuts ORDER BY f) AS cuts FROM (SELECT f, list(DISTINCT v ORDER BY v) AS cuts FROM (
              SELECT f, x[f] AS v, row_number() OVER (PARTITION BY f ORDER BY x[f]) - 1 AS place FROM rrow, range(1, {width + 1}) a(f))
            WHERE place IN (SELECT CAST(floor(CAST(k AS DOUBLE) / {bins} * (n - 1)) AS BIGINT) FROM range(1, {bins}) b(k), rend) GROUP BY f)""",
        "rbin": f"""SELECT country, year, t, CASE WHEN high > low THEN CAST(floor((t - low) / (high - low) * {units}) AS BIGINT) ELSE 0 END AS y,
              list_transform(range(1, {width + 1}), lambda f: len(list_filter(cuts[f], lambda c: c < x[f]))) AS b FROM rrow, rend, rcut""",
        "rbound": f"""SELECT list(CAST(floor(total * 4503599627370496.0E0) AS BIGINT) ORDER BY k) AS bounds FROM (
              SELECT k, sum(exp(k * ln({trees}.0E0) - {trees} - lgamma(k + 1))) OVER (ORDER BY k) AS total FROM range(0, {3 * trees + 100}) a(k))""",
        "rdraw": f"""SELECT CAST(concat('0x', substr(md5(concat_ws('|', country, year, {seed}, 'draws', j // 4)), CAST(j % 4 * 8 + 1 AS INT), 8)) AS BIGINT)
              % {trees} AS tree, y, b FROM (
              SELECT *, unnest(range(0, len(list_filter(bounds, lambda c: c <= CAST(concat('0x', substr(md5(concat_ws('|', country, year, {seed})), 1, 13))
                AS BIGINT))))) AS j FROM rbin, rbound)""",
        "rs0": "SELECT tree, CAST(1 AS BIGINT) AS node, y, b FROM rdraw",
        "rlast": f"""SELECT country, max(year) + 1 AS year, list({target} ORDER BY year DESC) AS h FROM {source} WHERE {target} IS NOT NULL GROUP BY country""",
        "rstill": f"""SELECT country, {', '.join(f"coalesce(max_by({c}, year) FILTER ({c} IS NOT NULL), 0) AS {c}" for c in passive) or 'NULL AS none'}
            FROM {source} GROUP BY country""",
        "rnext": f"""SELECT country, year, list_transform(range(1, {width + 1}), lambda f: len(list_filter(cuts[f], lambda c: c < x[f]))) AS b FROM (
              SELECT country, year, [{', '.join(f"CAST({e} AS DOUBLE)" for e in following)}] AS x FROM rlast JOIN rstill USING (country)), rcut""",
        "rw0": f"SELECT country, year, tree, CAST(1 AS BIGINT) AS node, b FROM {asked}, range(0, {trees}) a(tree)"}
    nodes, paths = [], []
    for d in range(depth + 1):
        out[f"rt{d}"] = (f"SELECT tree, node, count(*) AS n, CAST(sum(y) AS BIGINT) AS total, CAST(sum(y) AS DOUBLE) AS s, min(y) AS l, max(y) AS h "
                         f"FROM rs{d} GROUP BY tree, node")
        out[f"rh{d}"] = f"""SELECT tree, node, f, bin, CAST(sum(m) OVER w AS DOUBLE) AS nl, CAST(sum(v) OVER w AS DOUBLE) AS sl FROM (
              SELECT tree, node, f, b[f] AS bin, count(*) AS m, sum(y) AS v FROM rs{d}, range(1, {width + 1}) a(f) GROUP BY ALL)
            WINDOW w AS (PARTITION BY tree, node, f ORDER BY bin)"""
        out[f"rc{d}"] = f"""SELECT tree, node, f, bin, score - s * s / n AS gain FROM (
              SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, bin) AS place FROM (
                SELECT tree, node, f, bin, n, s, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) AS score
                FROM rh{d} JOIN rt{d} USING (tree, node) WHERE nl < n AND l < h AND {d} < {depth})) WHERE place = 1 AND score > s * s / n"""
        nodes.append(f"SELECT t.tree, t.node, {d} AS depth, t.n, t.total, c.f, c.gain FROM rt{d} t LEFT JOIN rc{d} c USING (tree, node)")
        paths.append(f"""SELECT w.country, w.year, low + t.s / t.n / {units} * (high - low) AS value FROM rw{d} w JOIN rt{d} t USING (tree, node)
            LEFT JOIN rc{d} c USING (tree, node), rend WHERE c.f IS NULL""")
        if d < depth:
            below = "2 * c.node + CASE WHEN a.b[c.f] <= c.bin THEN 0 ELSE 1 END AS node"
            out[f"rs{d + 1}"] = f"SELECT a.tree, {below}, a.y, a.b FROM rs{d} a JOIN rc{d} c ON a.tree = c.tree AND a.node = c.node"
            out[f"rw{d + 1}"] = f"SELECT a.country, a.year, a.tree, {below}, a.b FROM rw{d} a JOIN rc{d} c ON a.tree = c.tree AND a.node = c.node"
    out["rnodes"] = " UNION ALL ".join(nodes)
    out["rpred"] = f"SELECT country, year, avg(value) AS p FROM ({' UNION ALL '.join(paths)}) GROUP BY country, year"
    out["rnames"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1)) + ") v(f, feature)"
    return out


def sequence_blocks(source: str, columns, length: int, latent: int, steps: int, seed: int, flat: float) -> dict[str, str]:
    """Blocks that scale rows, cut runs, take the power steps row by row, and reconstruct."""
    width = length * len(columns)
    rank = min(latent, width)
    scaled = ", ".join(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / (CASE WHEN stddev_pop(coalesce({c}, 0)) OVER () = 0 "
                       f"THEN 1 ELSE stddev_pop(coalesce({c}, 0)) OVER () END)" for c in columns)
    start = f"(CAST(concat('0x', substr(md5(concat_ws('|', {seed}, k, i)), 1, 8)) AS BIGINT) + 0.5E0) / 4294967296.0E0 - 0.5E0"
    return {
        "srow": f"SELECT country, year, [{scaled}] AS v FROM {source}",
        "srun": f"""SELECT country, year, flatten(vs) AS x FROM (SELECT country, year, list(v) OVER (
            PARTITION BY country ORDER BY year ROWS {length - 1} PRECEDING) AS vs FROM srow) WHERE len(vs) = {length}""",
        "smean": f"SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM srun, range(1, {width + 1}) g(i) GROUP BY i)",
        "sdev": "SELECT country, year, list_transform(list_zip(x, m), lambda z: z[1] - z[2]) AS x FROM srun, smean",
        "scov": f"""SELECT list(r ORDER BY i) AS c, sum(r[i]) AS total FROM (SELECT i, list(s ORDER BY j) AS r FROM (
            SELECT i, j, sum(x[i] * x[j]) AS s FROM sdev, range(1, {width + 1}) a(i), range(1, {width + 1}) b(j) GROUP BY i, j) GROUP BY i)""",
        "spow": f"""SELECT 0 AS step, list(q ORDER BY k) AS old, CAST([] AS DOUBLE[][]) AS new FROM (
              SELECT k, list({start} ORDER BY i) AS q FROM range(0, {rank}) a(k), range(0, {width}) b(i) GROUP BY k)
            UNION ALL
            SELECT step + 1, CASE WHEN len(new) = {rank - 1} THEN list_append(new, q) ELSE old END,
                   CASE WHEN len(new) = {rank - 1} THEN [] ELSE list_append(new, q) END
            FROM (SELECT *, CASE WHEN sqrt(list_dot_product(u, u)) > {flat!r} * total
                            THEN list_transform(u, lambda y: y / sqrt(list_dot_product(u, u))) ELSE list_transform(u, lambda y: 0.0E0) END AS q
                  FROM (SELECT step, old, new, total, list_reduce(list_prepend(list_transform(c, lambda r: list_dot_product(r, old[len(new) + 1])), new),
                               lambda a, b: list_transform(list_zip(a, b), lambda z: z[1] - list_dot_product(a, b) * z[2])) AS u
                        FROM spow, scov WHERE step < {steps * rank}))""",
        "sproj": f"""SELECT list_transform(range(1, {width + 1}), lambda i: list_transform(range(1, {width + 1}), lambda j:
            list_sum(list_transform(old, lambda q: q[i] * q[j])))) AS p FROM spow WHERE step = {steps * rank}""",
        "serr": """SELECT country, year, list_avg(list_transform(list_zip(x, list_transform(p, lambda r: list_dot_product(r, x))),
            lambda z: abs(z[1] - z[2]))) AS e FROM sdev, sproj""",
    }


def confidence_smoke() -> str:
    return ("round(CASE WHEN laplacian_var < 100 THEN 0.35E0 ELSE 0 END + CASE WHEN smoke_ratio > 0.3 THEN 0.40E0 ELSE 0 END"
            " + CASE WHEN gray_std < 38.25 THEN 0.25E0 ELSE 0 END, 6)")


def confidence_garbage() -> str:
    return ("round(CASE WHEN waste_ratio > 0.25 THEN 0.40E0 ELSE 0 END + CASE WHEN edge_density > 0.15 THEN 0.35E0 ELSE 0 END"
            " + CASE WHEN entropy > 6.5 THEN 0.25E0 ELSE 0 END, 6)")


def confidence_deforestation() -> str:
    return ("round(CASE WHEN green_ratio < 0.15 THEN 0.50E0 ELSE 0 END + CASE WHEN bare_ratio > 0.3 THEN 0.50E0 ELSE 0 END, 6)")


def severity_case(c: str) -> str:
    return f"CASE WHEN {c} >= 0.75 THEN 'critical' WHEN {c} >= 0.5 THEN 'high' WHEN {c} >= 0.25 THEN 'medium' ELSE 'low' END"


def detections(source: str) -> str:
    """(image_id, issue, confidence, severity, alert) from a statistics block."""
    def pct(x, digits):
        return f"printf('%.{digits}f%%', {dec(f'{x} * 100', digits)})"
    smoke = (f"concat('⚠️ Smoke/Pollution detected (', {pct('c', 0)}, ' confidence). Laplacian=', printf('%.1f', {dec('laplacian_var', 1)}), "
             f"', smoke_pixels=', {pct('smoke_ratio', 1)})")
    waste = (f"concat('🗑️ Garbage dumping detected (', {pct('c', 0)}, ' confidence). waste_pixels=', {pct('waste_ratio', 1)}, "
             f"', edge_density=', {pct('edge_density', 1)})")
    trees = (f"concat('🌲 Vegetation loss detected (', {pct('c', 0)}, ' confidence). green=', {pct('green_ratio', 1)}, "
             f"', bare=', {pct('bare_ratio', 1)})")
    rows = [("Smoke / Air Pollution", confidence_smoke(), smoke),
            ("Garbage / Illegal Dumping", confidence_garbage(), waste),
            ("Deforestation / Vegetation Loss", confidence_deforestation(), trees)]
    return " UNION ALL ".join(
        f"SELECT image_id, '{issue}' AS issue, c AS confidence, {severity_case('c')} AS severity, "
        f"CASE WHEN c > 0.1 THEN {alert} ELSE '' END AS alert FROM (SELECT *, {c} AS c FROM {source})"
        for issue, c, alert in rows)
