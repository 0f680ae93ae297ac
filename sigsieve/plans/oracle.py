"""DuckDB SQL for the correctness gate: the same computations written as
plain window/aggregate SQL over the pre-registered parquet views.

Every SQL here is an independent formulation (full-table windows are fine
for an oracle); the Spark side is the scalable one.  Floats are rounded with
round(x*1e6)/1e6 on both sides.
"""

from __future__ import annotations

from ..sources.tables import EVENTS_GAP_RULE, EVENTS_SPIKE_RULE, WIDE_FEATURES, WIDE_ORDER


def R6(e: str) -> str:
    return f"(round(({e}) * 1e6 + 1e-4) / 1e6 + 0.0)"


def qcols(keys) -> str:
    return "".join(f"{k}, " for k in keys)


def pby(keys, extra: str = "") -> str:
    parts = list(keys) + ([extra] if extra else [])
    return "PARTITION BY " + ", ".join(parts) if parts else ""


def events_sig(series: str | None = "event_type") -> str:
    """CTE ``sig``: the events signal (keys, event_id, pos, value)."""
    keys = [series] if series else []
    return f"""ev0 AS (
  SELECT {qcols(keys)}event_id, value,
         row_number() OVER ({pby(keys)} ORDER BY event_id) AS pos
  FROM events),
sig AS (
  SELECT {qcols(keys)}event_id, pos,
         CASE WHEN {EVENTS_GAP_RULE} THEN NULL
              WHEN {EVENTS_SPIKE_RULE} THEN value * 8 ELSE value END AS value
  FROM ev0)"""


def wide_sig(clean: bool = False) -> str:
    """CTE ``sig``: the lineitem signal per supplier (4 channels)."""
    order = ", ".join(WIDE_ORDER)
    if clean:
        body = "l_quantity, l_extendedprice, l_discount, l_tax"
    else:
        body = """CASE WHEN (l_orderkey * 7 + l_linenumber) % 29 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN (pos - 1) % 40 BETWEEN 10 AND 13 THEN NULL
              WHEN l_orderkey % 89 = 0 THEN l_extendedprice * 6 ELSE l_extendedprice END AS l_extendedprice,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_discount END AS l_discount,
         l_tax"""
    return f"""li0 AS (
  SELECT {order}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}) AS pos
  FROM lineitem),
sig AS (
  SELECT {order}, pos, l_returnflag,
         {body}
  FROM li0)"""


def long_of(src: str, keys, features, name: str = "lng") -> str:
    """CTE ``name``: unpivot (keys, pos, f, feature, x) from CTE ``src``."""
    parts = [f"SELECT {qcols(keys)}pos, {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {src}"
             for i, c in enumerate(features)]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def profile_ctes(keys, features, iqr_factor=1.5, mad_thresh=3.5) -> str:
    """CTEs computing the v2 profile into ``prof`` from long CTE ``lng``."""
    k = qcols(keys)
    kf = ", ".join(list(keys) + ["f"])
    jk = " AND ".join([f"a.{c} = b.{c}" for c in list(keys) + ["f"]])
    pk = pby(keys, "f")
    return f"""
seq AS (
  SELECT {k}f, feature, pos, x,
         max(CASE WHEN x IS NOT NULL THEN pos END) OVER ({pk} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp,
         last_value(x IGNORE NULLS) OVER ({pk} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pvv,
         count(x) OVER ({pk} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vr,
         sum(x) OVER ({pk} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ps,
         count(x) OVER ({pk}) AS m,
         avg(x) OVER ({pk}) AS mu
  FROM lng),
base AS (
  SELECT {k}f, any_value(feature) AS feature, count(*) AS n, count(x) AS m, avg(x) AS mean,
         stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx, count(DISTINCT x) AS nd,
         avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, avg(power(x - mu, 4)) AS m4,
         max(CASE WHEN x IS NOT NULL THEN pos - coalesce(pp, 0) - 1 END) AS gmax,
         count(CASE WHEN x IS NOT NULL AND pos - coalesce(pp, 0) - 1 > 0 THEN 1 END) AS gruns,
         max(CASE WHEN x IS NOT NULL THEN pos END) AS lastp,
         stddev_samp(CASE WHEN x IS NOT NULL THEN x - pvv END) AS dsd,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
  FROM seq GROUP BY {kf}),
madt AS (
  SELECT {", ".join("a." + c for c in list(keys) + ["f"])}, quantile_cont(abs(a.x - b.med), 0.5) AS mad
  FROM seq a JOIN base b ON {jk} WHERE a.x IS NOT NULL GROUP BY {", ".join("a." + c for c in list(keys) + ["f"])}),
st AS (
  SELECT b.*, d.mad FROM base b LEFT JOIN madt d ON {" AND ".join([f"b.{c} = d.{c}" for c in list(keys) + ["f"]])}),
rates AS (
  SELECT {", ".join("a." + c for c in list(keys) + ["f"])},
    count(CASE WHEN b.m >= 4 AND b.q3 - b.q1 > 0 AND (a.x < b.q1 - {iqr_factor} * (b.q3 - b.q1) OR a.x > b.q3 + {iqr_factor} * (b.q3 - b.q1)) THEN 1 END) AS iqr_n,
    count(CASE WHEN b.m >= 4 AND b.mad > 0 AND abs(0.6745 * (a.x - b.med) / b.mad) > {mad_thresh} THEN 1 END) AS mad_n
  FROM seq a JOIN st b ON {jk} GROUP BY {", ".join("a." + c for c in list(keys) + ["f"])}),
vv AS (
  SELECT {k}f, vr, ps, m, greatest(10, CAST(floor(m * 0.08) AS BIGINT)) AS w FROM seq WHERE x IS NOT NULL),
roll AS (
  SELECT {", ".join("a." + c for c in list(keys) + ["f"])},
    CASE WHEN a.vr >= a.w THEN (a.ps - coalesce(b.ps, 0.0)) / a.w
         WHEN a.vr >= greatest(5, a.w // 3) THEN a.ps / a.vr END AS rm
  FROM vv a LEFT JOIN vv b ON {jk} AND b.vr = a.vr - a.w),
drift AS (SELECT {kf}, max(rm) - min(rm) AS rrange FROM roll GROUP BY {kf}),
ebins AS (
  SELECT {kf}, m, mn, mx, least(30, greatest(5, CAST(floor(sqrt(m)) AS BIGINT))) AS bins FROM st
  WHERE m >= 10 AND nd > 1),
ecnt AS (
  SELECT {", ".join("a." + c for c in list(keys) + ["f"])},
    least(b.bins - 1, CAST(floor((a.x - b.mn) / (b.mx - b.mn) * b.bins) AS BIGINT)) AS bin, count(*) AS c, any_value(b.m) AS m
  FROM seq a JOIN ebins b ON {jk} WHERE a.x IS NOT NULL GROUP BY ALL),
ent AS (
  SELECT {kf}, CASE WHEN count(*) > 1 THEN -sum((c / m) * ln(c / m)) / ln(count(*)) ELSE 1.0 END AS ent
  FROM ecnt GROUP BY {kf}),
prof0 AS (
  SELECT s.*, r.iqr_n, r.mad_n, d.rrange, e.ent
  FROM st s
  LEFT JOIN rates r ON {" AND ".join([f"s.{c} = r.{c}" for c in list(keys) + ["f"]])}
  LEFT JOIN drift d ON {" AND ".join([f"s.{c} = d.{c}" for c in list(keys) + ["f"]])}
  LEFT JOIN ent e ON {" AND ".join([f"s.{c} = e.{c}" for c in list(keys) + ["f"]])})"""


def clamp(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


def safe(e: str) -> str:
    return f"coalesce(CASE WHEN isnan(CAST({e} AS DOUBLE)) OR isinf(CAST({e} AS DOUBLE)) THEN NULL ELSE CAST({e} AS DOUBLE) END, 0.0)"


def profile_select(keys, corr_expr: str = "0.0") -> str:
    """Select list turning ``prof0`` (+ corr) into the v2 profile record."""
    k = qcols(keys)
    tail = "CASE WHEN m > 0 THEN n - lastp ELSE n END"
    runs = f"(coalesce(gruns, 0) + CASE WHEN {tail} > 0 THEN 1 ELSE 0 END)"
    longest = f"greatest(coalesce(gmax, 0), {tail})"
    miss = "(n - m)"
    g1 = "CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) END"
    g2 = "CASE WHEN m2 > 0 THEN m4 / power(m2, 2) - 3 END"
    return f"""{k}feature, CAST(n AS BIGINT) AS n,
    {safe(f'{miss} * 100.0 / n')} AS missing_rate,
    CAST({longest} AS BIGINT) AS longest_missing_run,
    CASE WHEN {miss} = 0 THEN 0.0 ELSE {clamp(f'({miss} * 1.0 / {runs}) / greatest(1, n) * 8 + {longest} * 1.0 / greatest(1, {miss}) * 0.35')} END AS missing_burstiness,
    {safe('coalesce(iqr_n, 0) * 100.0 / n')} AS outlier_iqr_rate,
    {safe('coalesce(mad_n, 0) * 100.0 / n')} AS outlier_mad_rate,
    CASE WHEN m > 3 THEN {safe(g1)} ELSE 0.0 END AS skewness,
    CASE WHEN m > 3 THEN {safe(g2)} ELSE 0.0 END AS kurtosis_excess,
    (m < 2 OR coalesce(sd = 0, TRUE)) AS zero_variance,
    {safe('nd * 1.0 / greatest(1, n)')} AS unique_ratio,
    CASE WHEN m >= 30 AND sd > 0 THEN {clamp(safe('rrange / (4 * sd)'))} ELSE 0.0 END AS drift_score,
    CASE WHEN m >= 5 AND sd > 0 THEN {clamp(safe('dsd / (3 * sd)'))} ELSE 0.0 END AS volatility_score,
    CASE WHEN m >= 10 AND nd > 1 THEN {clamp(safe('ent'))} ELSE 0.0 END AS entropy_score,
    {safe(corr_expr)} AS corr_mean_abs"""


def quality_sql(weights=(0.24, 0.24, 0.16, 0.16, 0.12, 0.08), penalty: bool = True) -> tuple[str, dict]:
    """Sub-scores and QI over a CTE with profile columns; returns (qi_expr, subscores)."""
    sc = {
        "completeness": f"100 * (1 - {clamp('missing_rate / 45.0')})",
        "continuity": f"100 * (1 - {clamp('0.65 * missing_burstiness + 0.35 * (longest_missing_run * 1.0 / greatest(1, n) * 10)')})",
        "plausibility": f"100 * (1 - {clamp('greatest(outlier_iqr_rate, outlier_mad_rate) / 25.0')})",
        "distribution": f"100 * (1 - {clamp('(abs(skewness) / 3.0) * 0.65 + (greatest(0.0, kurtosis_excess) / 8.0) * 0.35')})",
        "stability": f"100 * (1 - {clamp('0.60 * drift_score + 0.40 * volatility_score')})",
        "correlation": f"100 * {clamp('0.45 + corr_mean_abs * 0.80')}",
    }
    dist = f"(CASE WHEN unique_ratio < 0.01 THEN ({sc['distribution']}) * 0.55 ELSE {sc['distribution']} END)" if penalty else sc["distribution"]
    stab = f"(CASE WHEN unique_ratio < 0.01 THEN ({sc['stability']}) * 0.75 ELSE {sc['stability']} END)" if penalty else sc["stability"]
    parts = [sc["completeness"], sc["continuity"], sc["plausibility"], dist, stab, sc["correlation"]]
    tot = sum(weights) or 1.0
    score = " + ".join(f"{w} * ({p})" for w, p in zip(weights, parts))
    qi = f"round_even({clamp(f'(({score}) / {tot}) / 100')} * 100 * 10, 0) / 10"
    return qi, sc


def label_sql(qi: str) -> str:
    return (f"CASE WHEN {qi} >= 80 THEN 'Good' WHEN {qi} >= 60 THEN 'Usable / inspect' "
            f"WHEN {qi} >= 40 THEN 'Risky' ELSE 'Critical' END")


def corr_ctes(keys, features, src: str = "sig") -> str:
    """CTE ``corr``: (keys, f, corr_mean_abs) from the wide CTE ``src``."""
    k = qcols(keys)
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    exprs = []
    for i, j in pairs:
        a, b = features[i], features[j]
        a2 = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
        b2 = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
        den = f"(stddev_pop({a2}) * stddev_pop({b2}))"
        exprs.append(f"CASE WHEN {den} = 0 OR {den} IS NULL THEN NULL ELSE covar_pop({a2}, {b2}) / {den} END AS r{i}_{j}")
    gb = f"GROUP BY {', '.join(keys)}" if keys else ""
    rows = []
    for i in range(len(features)):
        for j in range(len(features)):
            if i != j:
                rows.append(f"SELECT {k}{i} AS f, abs(r{min(i, j)}_{max(i, j)}) AS r FROM cw")
    return f"""cw AS (SELECT {k}{', '.join(exprs)} FROM {src} {gb}),
cl AS ({' UNION ALL '.join(rows)}),
corr AS (SELECT {k}f, coalesce(avg(CASE WHEN r IS NOT NULL AND NOT isnan(r) THEN r END), 0.0) AS corr_mean_abs
         FROM cl GROUP BY {', '.join(list(keys) + ['f'])})"""


def full_profile_sql(sig_cte: str, keys, features, with_corr: bool = True,
                     weights=(0.24, 0.24, 0.16, 0.16, 0.12, 0.08), src: str = "sig", extras: bool = False) -> str:
    long_src = src
    """WITH ... , profile AS (...): complete v2 profile rows incl. QI/label."""
    corr = corr_ctes(keys, features, src=src) if (with_corr and len(features) > 1) else None
    qi, _ = quality_sql(weights)
    if corr:
        join = " LEFT JOIN corr c ON " + " AND ".join([f"p.{c} = c.{c}" for c in list(keys) + ["f"]])
        cexpr = "c.corr_mean_abs"
        src = "prof0 p" + join
        sel = profile_select([f"p.{k}" for k in keys], cexpr).replace("feature,", "p.feature AS feature,", 1)
    else:
        src = "prof0 p"
        sel = profile_select([f"p.{k}" for k in keys], "0.0")
    if extras:
        sel += (", CASE WHEN p.m > 4 AND p.sd > 0 THEN " + safe("p.dsd / (p.sd + 1e-12)") + " ELSE 0.0 END AS jitter_proxy, "
                + safe("p.sd") + " AS std, " + safe("p.mn") + " AS min, " + safe("p.mx") + " AS max")
    return f"""WITH {sig_cte},
{long_of(long_src, keys, features)},
{profile_ctes(keys, features)},
{(corr + ',') if corr else ''}
prof1 AS (SELECT {sel} FROM {src}),
profile AS (SELECT *, {qi} AS quality_index FROM prof1)"""
