"""The cluster bootstrap against plain resampling: whole clusters, ranks anew in each draw, single-row clusters kept."""

import numpy as np
import pandas as pd

from signalpanel.operators import inference as I


def ranks(v):
    return pd.Series(v).rank().to_numpy()


def all_splits(rows, neutral):
    ics = []
    for _, g in pd.DataFrame(rows, columns=["split", "date", "ticker", "industry", "y", "yhat"]).groupby("split"):
        if len(g) < 2:
            continue
        y, p = g["y"], g["yhat"]
        if neutral:
            y, p = (v - v.groupby(g["industry"]).transform("mean") for v in (y, p))
            y, p = (v.where(v.abs() > 1e-12, 0.0) for v in (y, p))
        a, b = ranks(y.round(9)), ranks(p.round(9))
        ics.append(np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else 0.0)
    return float(np.mean(ics)) if ics else 0.0


def test_bootstrap_resamples_rows(spark):
    rng = np.random.default_rng(7)
    unit = (1.0, 2**0.5)  # so that residuals of two industries tie at zero only
    rows = [(f"s{k % 3}", f"d{k // 3 if k > 4 else k}", f"t{k % 7}", "AB"[k % 2], float(unit[k % 2] * rng.integers(0, 6)), float(unit[k % 2] * rng.integers(0, 6))) for k in range(40)]
    rows += [("s9", "d99", "t99", "A", 1.0, 2.0)]  # one row: its date, ticker and split are clusters of one, and no split of two rows
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, split string, date string, ticker string, industry string, y double, yhat double")
    draws = 60
    got = {(r.estimand, r.method): r for r in I.bootstrap_rank_ic(df, ["model"], "split", {"split": "split", "event_date": "date", "ticker": "ticker"}, draws, 42, 25).collect()}
    assert len(got) == 6
    for e, estimand in enumerate(("plain", "industry_neutral")):
        for i, (method, col) in enumerate((("split", 0), ("event_date", 1), ("ticker", 2))):
            names = sorted({r[col] for r in rows})
            gen = np.random.default_rng(42 + 1009 * e + 101 * i)
            m = np.array([all_splits([r for c in gen.choice(names, size=len(names), replace=True) for r in rows if r[col] == c], bool(e)) for _ in range(draws)])
            g = got[estimand, method]
            assert (g.n_clusters, g.draws) == (len(names), draws)
            np.testing.assert_allclose(
                [g.point, g.low, g.high, g.se, g.p],
                [all_splits(rows, bool(e)), *np.quantile(m, [0.025, 0.975]), m.std(ddof=1), min(1.0, 2 * min((m <= 0).mean(), (m >= 0).mean()))], atol=1e-9,
            )
