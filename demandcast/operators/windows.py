"""Lag, centred rolling and exponentially weighted features per series.

Every feature is a window expression over the same
``PARTITION BY keys ORDER BY date ASC NULLS LAST`` specification, so all of
them share one shuffle and one sort, and they run in the JVM. The work per
series is bounded by its length (one row per day), and the frames are
bounded (``lag k``, a few days, ``K`` rows for the EWM), so no task ever holds
more than one series' rows plus a small frame buffer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandcast.functions.noise import gaussian_noise

ROLL_OPS = {"sum": "sum", "mean": "avg", "std": "stddev_samp"}

# EWM weights below this share of the newest weight are dropped: far below
# double precision, so the truncated sum equals the infinite one.
EWM_TOLERANCE = 1e-18


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _partition(keys, within: str | None) -> list[str]:
    return [*keys, within] if within else list(keys)


def series_window(keys, date: str = "date", within: str | None = None):
    """The one window specification all features use."""
    return (Window.partitionBy(*_partition(keys, within))
                  .orderBy(F.col(date).asc_nulls_last()))


def lag_name(target: str, suffix: str, lag: int) -> str:
    return f"{target}_{suffix}_{lag}"


def roll_name(target: str, suffix: str, op: str, window: int) -> str:
    return f"{target}_{suffix}_{op}_{window}"


def ewm_name(target: str, suffix: str, alpha: float) -> str:
    return f"{target}_{suffix}_{str(alpha).replace('.', '')}"


# ---------------------------------------------------------------- W1, W7 --

def lag_columns(lags, keys, target: str = "sales", suffix: str = "lag",
                date: str = "date", within: str | None = None,
                noise_scale: float = 0.0, seed: int = 42) -> list[Column]:
    """``lag(target, k)`` by rows, ordered by date.

    W7: with ``noise_scale`` > 0 each lag gets N(0, noise_scale) noise drawn
    from a hash of (keys, date, lag, seed): repeatable, independent of
    partitioning, and with no count of the frame.
    """
    w = series_window(keys, date, within)
    cols = []
    for k in lags:
        c = F.lag(F.col(target), int(k)).over(w)
        if noise_scale:
            noise = gaussian_noise([*keys, date], seed=seed, stream=int(k))
            c = c.cast("double") + F.lit(float(noise_scale)) * noise
        cols.append(c.alias(lag_name(target, suffix, k)))
    return cols


def add_lags(df: DataFrame, lags=(1, 3, 5, 7), keys=("store", "item"),
             target: str = "sales", suffix: str = "lag", date: str = "date",
             within: str | None = None, noise_scale: float = 0.0,
             seed: int = 42) -> DataFrame:
    return df.select("*", *lag_columns(lags, keys, target, suffix, date, within,
                                       noise_scale, seed))


# ------------------------------------------------------------- W2 - W5 --

def rolling_column(op: str, window: int, keys, target: str = "sales",
                   date: str = "date", within: str | None = None,
                   frame: str = "range", trailing: bool = False) -> Column:
    """One rolling aggregate.

    ``frame="range"`` (W2-W4, the default): calendar days around the row,
    ``int(window / 2)`` before and after (``window`` + 1 days for even
    windows, as in the reference), written as an ``INTERVAL`` range frame on
    the DATE (D4: no daylight-saving drift). ``frame="rows"`` (W5): rows
    ``-(window // 2) .. (window - 1) // 2``, the pandas ``center=True`` frame.
    ``trailing=True`` looks back only (``window`` days or rows, not the
    current one), the frame to use for honest forecasting (D7).
    """
    fn = ROLL_OPS[op]
    if frame == "range":
        half = int(window / 2)
        bounds = (f"INTERVAL {int(window)} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING"
                  if trailing else
                  f"INTERVAL {half} DAYS PRECEDING AND INTERVAL {half} DAYS FOLLOWING")
        part = ", ".join(_q(c) for c in _partition(keys, within))
        return F.expr(f"{fn}({_q(target)}) OVER (PARTITION BY {part} "
                      f"ORDER BY {_q(date)} ASC NULLS LAST RANGE BETWEEN {bounds})")
    if frame == "rows":
        lo, hi = ((-int(window), -1) if trailing
                  else (-(int(window) // 2), (int(window) - 1) // 2))
        w = series_window(keys, date, within).rowsBetween(lo, hi)
        return F.expr(f"{fn}({_q(target)})").over(w)
    raise ValueError(f"frame must be 'range' or 'rows', got {frame!r}")


def rolling_columns(windows, keys, target: str = "sales", suffix: str = "roll",
                    ops=("sum", "mean", "std"), date: str = "date",
                    within: str | None = None, frame: str = "range",
                    trailing: bool = False) -> list[Column]:
    """All (op, window) combinations, operation-major like the reference."""
    return [rolling_column(op, w, keys, target, date, within, frame, trailing)
            .alias(roll_name(target, suffix, op, w))
            for op in ops for w in windows]


def add_rolling(df: DataFrame, windows=(3, 5, 7), keys=("store", "item"),
                target: str = "sales", suffix: str = "roll",
                ops=("sum", "mean", "std"), frame: str = "range",
                trailing: bool = False, date: str = "date",
                within: str | None = None) -> DataFrame:
    return df.select("*", *rolling_columns(windows, keys, target, suffix, ops,
                                           date, within, frame, trailing))


# -------------------------------------------------------------------- W6 --

def ewm_window_rows(alpha: float, tol: float = EWM_TOLERANCE) -> int:
    """K: rows back after which weights (1 - alpha)^i fall below ``tol``."""
    alpha = float(alpha)
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    if alpha == 1.0:
        return 0
    return int(math.ceil(math.log(tol) / math.log(1.0 - alpha)))


_RN = "__ewm_rn"


def _tmp(kind: str, alpha: float) -> str:
    return f"__ewm_{kind}_{str(alpha).replace('.', '')}"


def _over(keys, date: str, within: str | None, frame: str = "") -> str:
    """SQL text of the shared window specification, with an optional frame."""
    part = ", ".join(_q(c) for c in _partition(keys, within))
    return f"OVER (PARTITION BY {part} ORDER BY {_q(date)} ASC NULLS LAST {frame})"


def _dbl(v: float) -> str:
    return f"{float(v)!r}D"


def ewm_rank_column(keys, date: str = "date", within: str | None = None) -> Column:
    """W6, step 1: the 0-based row position in the series (shares the Window node
    of the lags and rolling frames)."""
    return F.expr(f"row_number() {_over(keys, date, within)} - 1").alias(_RN)


def ewm_sum_columns(alphas, keys, target: str = "sales", date: str = "date",
                    within: str | None = None) -> list[Column]:
    """W6, step 2: four sliding sums per alpha over the last K + 1 rows.

    The mean wants sum_i q^i x_{t-i} (q = 1 - alpha, i = 0..K, i counting
    rows); K is where q^i drops below 1e-18 (46 rows for 0.6, 22 for 0.85).
    Rows are cut into blocks of P = K + 1 positions and each value is scaled
    by q^-(its offset in its block), at most q^-P ~ 1e18, so nothing
    overflows for any alpha. A frame of K + 1 rows touches at most two
    consecutive blocks, one even and one odd, so separate sums over even and
    odd blocks recover each block's share exactly (step 3). Values and
    weights (1 for a non-null value) are summed the same way. The columns
    are SQL text: one expression object each, whatever K is.
    """
    x = f"CAST({_q(target)} AS DOUBLE)"
    cols = []
    for a in alphas:
        k = ewm_window_rows(a)
        q, p = 1.0 - float(a), k + 1
        offset = f"CAST({_RN} - floor({_RN} / {p}) * {p} AS DOUBLE)"
        scale = f"pow({_dbl(q)}, -{offset})"
        even = f"floor({_RN} / {p}) % 2 = 0"
        over = _over(keys, date, within, f"ROWS BETWEEN {k} PRECEDING AND CURRENT ROW")
        parts = {"n": f"coalesce({x}, 0D) * {scale}",
                 "d": f"CASE WHEN {x} IS NULL THEN 0D ELSE {scale} END"}
        for kind, val in parts.items():
            cols.append(F.expr(f"sum(CASE WHEN {even} THEN {val} ELSE 0D END) {over}")
                        .alias(_tmp(kind + "e", a)))
            cols.append(F.expr(f"sum(CASE WHEN {even} THEN 0D ELSE {val} END) {over}")
                        .alias(_tmp(kind + "o", a)))
    return cols


def ewm_mean_columns(alphas, target: str = "sales", suffix: str = "ewm") -> list[Column]:
    """W6, step 3: the weighted means from the step-2 sums (a codegen projection).

    y_t = sum_i q^i x_{t-i} / sum_i q^i over non-null x: pandas
    ``ewm(alpha).mean()`` with adjust=True, ignore_na=False. With o the
    offset of t in its block, the own block contributes q^o * S_own and the
    block before q^(o + P) * S_prev. Only rows with a value get one here:
    their own weight is 1, so the dropped terms are below 1e-18 of the sum.
    A row without a value equals the mean before it (step 4).
    """
    cols = []
    for a in alphas:
        k = ewm_window_rows(a)
        q, p = 1.0 - float(a), k + 1
        offset = f"CAST({_RN} - floor({_RN} / {p}) * {p} AS DOUBLE)"
        even = f"floor({_RN} / {p}) % 2 = 0"

        def combine(kind):
            e, o = _tmp(kind + "e", a), _tmp(kind + "o", a)
            return (f"(pow({_dbl(q)}, {offset}) * (CASE WHEN {even} THEN {e} ELSE {o} END"
                    f" + {_dbl(q ** p)} * CASE WHEN {even} THEN {o} ELSE {e} END))")

        cols.append(F.expr(f"CASE WHEN {_q(target)} IS NOT NULL "
                           f"THEN {combine('n')} / {combine('d')} END")
                    .alias(ewm_name(target, suffix, a)))
    return cols


def drop_ewm_temps(df: DataFrame) -> list[str]:
    """Columns of ``df`` without the EWM temporaries."""
    return [c for c in df.columns if not c.startswith("__ewm_")]


def ewm_carry_columns(names, keys, date: str = "date",
                      within: str | None = None) -> list[Column]:
    """W6, step 4: a row without a value takes the mean of the last row with one.

    With a null x the exact mean equals the previous one (all weights shrink
    by the same factor), so runs of nulls of any length are exact; leading
    nulls stay null.
    """
    over = _over(keys, date, within, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return [F.expr(f"coalesce({_q(n)}, last({_q(n)}, true) {over})").alias(n) for n in names]


def _block_groups(alphas) -> list[tuple[int, list[float]]]:
    """Alphas sharing one block length P: the longest K sets P = K + 1, and an
    alpha joins while (1 - alpha)^+-P stays far inside the double range."""
    pending = sorted(alphas, key=ewm_window_rows, reverse=True)
    groups = []
    while pending:
        p = ewm_window_rows(pending[0]) + 1
        fits = [pending[0]] + [a for a in pending[1:]
                               if a < 1.0 and p * -math.log(1.0 - a) < 650.0]
        groups.append((p, fits))
        pending = [a for a in pending if a not in fits]
    return groups


def ewm_blocks(df: DataFrame, alphas=(0.6, 0.85), keys=("store", "item"),
               target: str = "sales", suffix: str = "ewm", date: str = "date",
               within: str | None = None) -> DataFrame:
    """W6 with O(1) window work per row (``add_ewm(method="blocks")``).

    Rows are cut into blocks of P = K + 1 positions and scaled by
    q^-(offset in block), as in :func:`ewm_sum_columns`. Instead of sliding
    sums, each block gets a running (prefix) sum and a total, computed by a
    window partitioned by block. Row t then reads the previous block's total
    and its prefix at t's offset with one ``lag(P)``: the own block gives
    prefix(t), the previous block total - prefix(t - P). The cost is one more
    partition spec, so two extra local sorts (no exchange); it pays off on
    narrow rows, while the sliding form shares the sort of the other features.
    """
    part = ", ".join(_q(c) for c in _partition(keys, within))
    x = f"CAST({_q(target)} AS DOUBLE)"
    out = df.select("*", ewm_rank_column(keys, date, within))
    means = []
    for p, group in _block_groups(alphas):
        block = f"floor({_RN} / {p})"
        offset = f"CAST({_RN} - {block} * {p} AS DOUBLE)"
        in_block = (f"OVER (PARTITION BY {part}, {block} ORDER BY {_q(date)} ASC NULLS LAST "
                    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        whole_block = f"OVER (PARTITION BY {part}, {block})"
        sums, prev = [], []
        for a in group:
            q = 1.0 - float(a)
            vals = {"n": f"coalesce({x}, 0D) * pow({_dbl(q)}, -{offset})",
                    "d": f"CASE WHEN {x} IS NULL THEN 0D ELSE pow({_dbl(q)}, -{offset}) END"}
            for kind, v in vals.items():
                pre, tot = _tmp(f"p{kind}", a), _tmp(f"t{kind}", a)
                sums += [F.expr(f"sum({v}) {in_block}").alias(pre),
                         F.expr(f"sum({v}) {whole_block}").alias(tot)]
                prev += [F.expr(f"lag({pre}, {p}) {_over(keys, date, within)}")
                         .alias(_tmp(f"lp{kind}", a)),
                         F.expr(f"lag({tot}, {p}) {_over(keys, date, within)}")
                         .alias(_tmp(f"lt{kind}", a))]
        out = out.select("*", *sums).select("*", *prev)
        for a in group:
            qp = _dbl((1.0 - float(a)) ** p)

            def share(kind, a=a, qp=qp):
                return (f"({_tmp(f'p{kind}', a)} + {qp} * (coalesce({_tmp(f'lt{kind}', a)}, 0D)"
                        f" - coalesce({_tmp(f'lp{kind}', a)}, 0D)))")

            means.append(F.expr(f"CASE WHEN {_q(target)} IS NOT NULL "
                                f"THEN {share('n')} / {share('d')} END")
                         .alias(ewm_name(target, suffix, a)))
    names = [ewm_name(target, suffix, a) for a in alphas]
    out = out.select(*df.columns, *means)
    return out.select(*df.columns, *ewm_carry_columns(names, keys, date, within))


def add_ewm(df: DataFrame, alphas=(0.6, 0.85), keys=("store", "item"),
            target: str = "sales", suffix: str = "ewm", date: str = "date",
            within: str | None = None, method: str = "blocks") -> DataFrame:
    """W6. ``method``: "blocks" (O(1) window work per row for every alpha, two
    extra local sorts) or "window" (sliding sums over K + 1 rows, steps 1-4
    above, which share the sort of other features). Both are exact to double
    precision at any alpha; neither depends on the size of the data."""
    if method == "window":
        names = [ewm_name(target, suffix, a) for a in alphas]
        step = df.select("*", ewm_rank_column(keys, date, within))
        step = step.select("*", *ewm_sum_columns(alphas, keys, target, date, within))
        step = step.select(*df.columns, *ewm_mean_columns(alphas, target, suffix))
        return step.select(*df.columns, *ewm_carry_columns(names, keys, date, within))
    if method == "blocks":
        return ewm_blocks(df, alphas, keys, target, suffix, date, within)
    raise ValueError(f"unknown method {method!r}")
