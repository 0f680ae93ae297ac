"""SQL oracle builders for transforms: a chain of CTEs over a wide table
(keys, pos, features).  Plain full-partition windows: fine for an oracle."""

from __future__ import annotations

from .oracle import R6


def kc(keys, pre: str = "") -> str:
    return "".join(f"{pre}{k}, " for k in keys)


def on(a: str, b: str, keys) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "TRUE"


def part(keys) -> str:
    return ("PARTITION BY " + ", ".join(keys)) if keys else ""


class Chain:
    def __init__(self, base: str, cur: str, keys, feats, prefix: str = ""):
        self.ctes = [base] if base else []
        self.prefix = prefix
        self.cur = cur
        self.keys = list(keys)
        self.feats = list(feats)
        self.n = 0

    def name(self, p="t") -> str:
        self.n += 1
        return f"{self.prefix}{p}{self.n}"

    def add(self, text: str):
        self.ctes.append(text)

    # -- building blocks ---------------------------------------------------
    def carry(self) -> str:
        nm = self.name("cy")
        p = part(self.keys)
        cols = []
        for i, f in enumerate(self.feats):
            fp = f"{p} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
            fn = f"{p} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
            cols += [f"max(CASE WHEN {f} IS NOT NULL THEN pos END) OVER ({fp}) AS pp_{i}",
                     f"last_value({f} IGNORE NULLS) OVER ({fp}) AS pv_{i}",
                     f"min(CASE WHEN {f} IS NOT NULL THEN pos END) OVER ({fn}) AS np_{i}",
                     f"first_value({f} IGNORE NULLS) OVER ({fn}) AS nv_{i}"]
        self.add(f"{nm} AS (SELECT *, {', '.join(cols)} FROM {self.cur})")
        return nm

    def stats(self, src: str, quantiles: dict | None = None, mad: bool = False, moments: bool = True) -> str:
        nm = self.name("st")
        cols = []
        for i, f in enumerate(self.feats):
            if moments:
                cols += [f"count({f}) AS _m__{i}", f"avg({f}) AS _mean__{i}", f"stddev_samp({f}) AS _sd__{i}",
                         f"stddev_pop({f}) AS _sdp__{i}", f"min({f}) AS _min__{i}", f"max({f}) AS _max__{i}"]
            for q, p in (quantiles or {}).items():
                cols.append(f"quantile_cont({f}, {p}) AS {q}__{i}")
            if mad and "_med" not in (quantiles or {}):
                cols.append(f"quantile_cont({f}, 0.5) AS _med__{i}")
        gb = f"GROUP BY {', '.join(self.keys)}" if self.keys else ""
        self.add(f"{nm} AS (SELECT {kc(self.keys)}{', '.join(cols)} FROM {src} {gb})")
        if not mad:
            return nm
        nm2 = self.name("md")
        mcols = [f"quantile_cont(abs(a.{f} - b._med__{i}), 0.5) AS _mad__{i}" for i, f in enumerate(self.feats)]
        gb2 = f"GROUP BY {', '.join('a.' + k for k in self.keys)}" if self.keys else ""
        self.add(f"{nm2}0 AS (SELECT {kc(self.keys, 'a.')}{', '.join(mcols)} FROM {src} a JOIN {nm} b ON "
                 f"{on('a', 'b', self.keys)} {gb2})")
        self.add(f"{nm2} AS (SELECT b.*, {', '.join(f'm._mad__{i}' for i in range(len(self.feats)))} "
                 f"FROM {nm} b LEFT JOIN {nm2}0 m ON {on('b', 'm', self.keys)})")
        return nm2

    def project(self, src: str, stats: str | None, exprs: dict[int, str]) -> str:
        nm = self.name("tx")
        sel = []
        for i, f in enumerate(self.feats):
            sel.append(f"{exprs[i]} AS {f}" if i in exprs else f"c.{f} AS {f}")
        j = f" LEFT JOIN {stats} s ON {on('c', 's', self.keys)}" if stats else ""
        self.add(f"{nm} AS (SELECT {kc(self.keys, 'c.')}c.pos, {', '.join(sel)} FROM {src} c{j})")
        self.cur = nm
        return nm

    # -- operators ---------------------------------------------------------
    def impute(self, method: str, variant: str = "v2"):
        if method == "None":
            return
        carry = method in ("LOCF", "Linear Interpolation")
        src = self.carry() if carry else self.cur
        need_mean = method == "Mean Imputation" or variant == "ev"
        need_med = method == "Linear Interpolation" and variant == "v2"
        st = None
        if need_mean or need_med:
            st = self.stats(self.cur, quantiles={"_med": 0.5} if need_med else None, moments=True)
        ex = {}
        for i, f in enumerate(self.feats):
            x = f"c.{f}"
            if method == "Mean Imputation":
                ex[i] = f"coalesce({x}, s._mean__{i})"
            elif method == "LOCF":
                if variant == "v1":
                    ex[i] = f"coalesce({x}, c.pv_{i})"
                elif variant == "ev":
                    ex[i] = f"coalesce({x}, c.pv_{i}, c.nv_{i}, s._mean__{i})"
                else:
                    ex[i] = f"coalesce({x}, c.pv_{i}, c.nv_{i})"
            else:
                lin = (f"CASE WHEN c.pv_{i} IS NOT NULL AND c.nv_{i} IS NOT NULL THEN c.pv_{i} + (c.nv_{i} - c.pv_{i}) "
                       f"* (c.pos - c.pp_{i}) / (c.np_{i} - c.pp_{i}) END")
                if variant == "v1":
                    ex[i] = f"coalesce({x}, {lin}, c.pv_{i})"
                elif variant == "ev":
                    ex[i] = f"coalesce({x}, {lin}, c.pv_{i}, c.nv_{i}, s._mean__{i})"
                else:
                    ex[i] = f"coalesce({x}, {lin}, c.pv_{i}, c.nv_{i}, s._med__{i}, 0.0)"
        self.project(src, st, ex)

    def outliers(self, method: str, z=3.0, iqr_factor=1.5, mad_thresh=3.5, winsor_q=0.02, variant="v2"):
        if method == "None":
            return
        q = {"_q1": 0.25, "_q3": 0.75} if method == "IQR" else (
            {"_wlo": winsor_q, "_whi": 1 - winsor_q} if method == "Winsorization" else None)
        st = self.stats(self.cur, quantiles=q, mad=(method == "MAD"))
        if variant == "v1" and method == "Z-Score":
            return self._zscore_filled(z)
        min_m = 5 if variant == "ev" else (0 if variant == "v1" or method not in ("IQR", "MAD") else 4)
        ex = {}
        for i, f in enumerate(self.feats):
            x = f"c.{f}"
            en = f"s._m__{i} >= {min_m}"
            if method == "Z-Score":
                sd = f"s._sd__{i}"
                bad = f"{en} AND {sd} > 0 AND abs(({x} - s._mean__{i}) / {sd}) > {z}"
            elif method == "IQR":
                iqr = f"(s._q3__{i} - s._q1__{i})"
                g = en if variant == "v1" else f"{en} AND {iqr} > 0"
                bad = f"{g} AND ({x} < s._q1__{i} - {iqr_factor} * {iqr} OR {x} > s._q3__{i} + {iqr_factor} * {iqr})"
            elif method == "MAD":
                if variant in ("v1", "ev"):
                    g = en if variant == "v1" else f"{en} AND s._mad__{i} > 0"
                    bad = f"{g} AND abs({x} - s._med__{i}) > 3 * s._mad__{i}"
                else:
                    bad = (f"{en} AND s._mad__{i} > 0 AND abs(0.6745 * ({x} - s._med__{i}) / s._mad__{i}) > "
                           f"{mad_thresh}")
            elif method == "Winsorization":
                ex[i] = (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < s._wlo__{i} THEN s._wlo__{i} "
                         f"WHEN {x} > s._whi__{i} THEN s._whi__{i} ELSE {x} END")
                continue
            ex[i] = f"CASE WHEN coalesce({bad}, FALSE) THEN NULL ELSE {x} END"
        self.project(self.cur, st, ex)

    def _zscore_filled(self, z):
        """First app: score every value against the mean-filled channel, blank it there and keep other gaps."""
        m = self.stats(self.cur)
        fl = self.name("fl")
        f2 = ", ".join(f"coalesce(c.{f}, s._mean__{i}) AS {f}" for i, f in enumerate(self.feats))
        self.add(f"{fl} AS (SELECT {kc(self.keys, 'c.')}c.pos, {f2} FROM {self.cur} c LEFT JOIN {m} s ON {on('c', 's', self.keys)})")
        st = self.stats(fl)
        self.project(self.cur, st, {i: f"CASE WHEN s._sdp__{i} > 0 AND abs(c.{f} - s._mean__{i}) > {z} * s._sdp__{i} "
                                       f"THEN NULL ELSE c.{f} END" for i, f in enumerate(self.feats)})

    def clip(self, lo, hi):
        ex = {i: f"CASE WHEN c.{f} IS NULL THEN NULL ELSE greatest({lo}, least({hi}, c.{f})) END"
              for i, f in enumerate(self.feats)}
        self.project(self.cur, None, ex)

    def scale(self, method: str, variant: str = "v2"):
        if method == "None":
            return
        if variant == "ev":
            st0 = self.stats(self.cur)
            fill = {i: f"coalesce(c.{f}, s._mean__{i}, 0.0)" for i, f in enumerate(self.feats)}
        else:
            st0 = self.stats(self.cur, quantiles={"_med": 0.5}, moments=False)
            fill = {i: f"coalesce(c.{f}, s._med__{i}, 0.0)" for i, f in enumerate(self.feats)}
        self.project(self.cur, st0, fill)
        q = {"_q1": 0.25, "_med": 0.5, "_q3": 0.75} if method == "RobustScaler" else None
        st = self.stats(self.cur, quantiles=q)
        ex = {}
        for i, f in enumerate(self.feats):
            x = f"c.{f}"
            if method == "StandardScaler":
                ex[i] = f"CASE WHEN s._sdp__{i} > 0 THEN ({x} - s._mean__{i}) / s._sdp__{i} ELSE {x} - s._mean__{i} END"
            elif method == "RobustScaler":
                iqr = f"(s._q3__{i} - s._q1__{i})"
                ex[i] = f"CASE WHEN {iqr} > 0 THEN ({x} - s._med__{i}) / {iqr} ELSE {x} - s._med__{i} END"
            else:
                rng = f"(s._max__{i} - s._min__{i})"
                ex[i] = f"CASE WHEN {rng} > 0 THEN ({x} - s._min__{i}) / {rng} ELSE {x} - s._min__{i} END"
        self.project(self.cur, st, ex)

    def close_gaps(self):
        src = self.carry()
        ex = {}
        for i, f in enumerate(self.feats):
            lin = (f"CASE WHEN c.pv_{i} IS NOT NULL AND c.nv_{i} IS NOT NULL THEN c.pv_{i} + (c.nv_{i} - c.pv_{i}) "
                   f"* (c.pos - c.pp_{i}) / (c.np_{i} - c.pp_{i}) END")
            ex[i] = f"coalesce(c.{f}, {lin}, c.pv_{i}, c.nv_{i})"
        self.project(src, None, ex)

    def fourier(self, ratio: float):
        """Low-pass as a plain sum over all places of a series, with the kernel summed bin by bin."""
        self.close_gaps()
        a, nm, k = self.name("fo"), self.name("fy"), kc(self.keys)
        gb = f"GROUP BY {', '.join(self.keys)}" if self.keys else ""
        xs = ", ".join(f"list({f} ORDER BY pos) AS x_{i}" for i, f in enumerate(self.feats))
        self.add(f"""{a}0 AS (SELECT {k}count(*) AS n, {xs} FROM {self.cur} {gb}),
{a}1 AS (SELECT *, len(list_filter(range(1, n // 2 + 1), lambda k: k * (CAST(1 AS DOUBLE) / n) <= {ratio})) AS bins FROM {a}0),
{a}2 AS (SELECT *, list_transform(range(0, n), lambda j:
    (1 + 2 * coalesce(list_sum(list_transform(range(1, bins + 1), lambda k: cos(2 * pi() * ((k * j) % n) / n))), 0)) / n) AS d FROM {a}1),
{a} AS (SELECT * EXCLUDE (d), list_concat(list_reverse(d[2:]), d) AS lags FROM {a}2)""")
        y = ", ".join(f"list_dot_product(s.x_{i}, s.lags[s.n - c.pos + 1:2 * s.n - c.pos]) AS {f}" for i, f in enumerate(self.feats))
        self.add(f"{nm} AS (SELECT {kc(self.keys, 'c.')}c.pos, {y} FROM {self.cur} c JOIN {a} s ON {on('c', 's', self.keys)})")
        self.cur = nm

    def out_sql(self, extra_cols: str = "") -> str:
        feats = ", ".join(f"{R6(f)} AS {f}" for f in self.feats)
        return "WITH " + ",\n".join(self.ctes) + f"\nSELECT {kc(self.keys)}pos, {feats}{extra_cols} FROM {self.cur}"


def refill(mv: str) -> str:
    return mv if mv != "None" else "Linear Interpolation"


def clean_chain(ch: Chain, mv: str, out: str, order: str = "mv_first"):
    if order == "out_first":
        ch.outliers(out)
        ch.impute(refill(mv))
    else:
        ch.impute(mv)
        ch.outliers(out)
        ch.impute(refill(mv))
