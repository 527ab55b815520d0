"""Forward labels, scaled by trailing volatility known on the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyard import vocab
from panelyard.functions.numeric import ratio
from panelyard.functions.rolling import Trailing

T = Trailing()


def three_way(z: Column, threshold: float) -> Column:
    return F.when(z >= threshold, 2).when(z <= -threshold, 0).when(z.isNotNull(), 1)


def two_way(z: Column, threshold: float) -> Column:
    return F.when(z.isNotNull(), (F.abs(z) >= threshold).cast("int"))


def _scale(rows: DataFrame, lookback: int) -> Column:
    """Trailing volatility; the feature of the same length is reused where it is at hand."""
    return F.col(f"vol_{lookback}") if f"vol_{lookback}" in rows.columns else T.volatility("ret", lookback)


def add_labels(rows: DataFrame, horizons=vocab.HORIZONS, threshold: float = vocab.THRESHOLD_SIGMAS,
               lookback: int = vocab.VOL_LOOKBACK) -> DataFrame:
    """Seven label columns per horizon; NULL while the forward window is open.

    Needs (ticker, day, close, ret, sector, sector_seen, sector_ret): ``sector_seen`` is the
    same-day sector close before filling, ``sector`` the filled one.  Relative labels need at
    least ``lookback`` real sector observations over the ticker's history.
    """
    rows = rows.withColumns({
        "scale_base": _scale(rows, lookback),
        "rel_scale_base": T.volatility(F.col("ret") - F.col("sector_ret"), lookback),
        "sector_days": F.count("sector_seen").over(T.whole()),
        **{f"ahead_{h}": ratio(T.lead("close", h), "close") for h in horizons},
        **{f"sector_ahead_{h}": ratio(T.lead("sector", h), "sector") for h in horizons},
    })
    covered = F.col("sector_days") >= lookback
    out = {}
    for h in horizons:
        root = F.sqrt(F.lit(float(h)))
        move = F.col(f"ahead_{h}") - 1.0
        z = move / (F.col("scale_base") * root + vocab.EPS)
        rel = F.when(covered, F.col(f"ahead_{h}") - F.col(f"sector_ahead_{h}"))
        rel_z = rel / (F.col("rel_scale_base") * root + vocab.EPS)
        out.update({
            f"forward_return_{h}d": move, f"forward_z_{h}d": z,
            f"label_direction_{h}d": three_way(z, threshold), f"label_magnitude_{h}d": two_way(z, threshold),
            f"rel_forward_return_{h}d": rel, f"rel_forward_z_{h}d": rel_z,
            f"label_rel_direction_{h}d": three_way(rel_z, threshold),
        })
    return rows.withColumns(out).drop(
        "scale_base", "rel_scale_base", "sector_days", *[f"{p}ahead_{h}" for p in ("", "sector_") for h in horizons])


def label_names(horizons=vocab.HORIZONS) -> list[str]:
    kinds = ("forward_return", "forward_z", "label_direction", "label_magnitude", "label_rel_direction",
             "rel_forward_return", "rel_forward_z")
    return [f"{k}_{h}d" for h in horizons for k in kinds]


def label_scales(rows: DataFrame, lookback: int = vocab.VOL_LOOKBACK) -> DataFrame:
    """Scale of the absolute and of the relative move per bar, for one bar of horizon."""
    return rows.withColumns({
        "label_scale": _scale(rows, lookback),
        "rel_label_scale": F.when(F.count("sector_seen").over(T.whole()) >= lookback,
                                  T.volatility(F.col("ret") - F.col("sector_ret"), lookback)),
    })


TARGETS = [(f"{kind}_{h}d", kind, h, 2 if kind == "magnitude" else 3) for kind in vocab.KINDS for h in vocab.HORIZONS]
