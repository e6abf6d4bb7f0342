"""Thresholds, costs and decision value of warnings. All of it works on counts per (event, threshold), which are aggregated once from the signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Choices compare costs at this many digits, so that the last bit of an exponential decides nothing.
DIGITS = 9


def mitigated(lead: Column, most: Column | float = 0.8, scale: Column | float = 60.0) -> Column:
    """Share of a loss that a warning ``lead`` days ahead avoids."""
    return F.lit(most) * (1 - F.exp(-lead / F.lit(scale)))


def fired(df: DataFrame, grid: list[float], by: str = "event", score: str = "conf", strict: bool = False) -> DataFrame:
    """(event, theta, fired, tp, lead_tp, lead_all) of the signals at or (``strict``) over each threshold. Signals are counted per distinct score first, so the grid multiplies counts."""
    tp = F.col("is_tp").cast("int")
    c = df.groupBy(by, score).agg(F.count("*").alias("n"), F.sum(tp).alias("tp"), F.sum(F.col("lead") * tp).alias("lead_tp"), F.sum("lead").alias("lead_all"))
    over = lambda x: F.col(score) > x if strict else F.col(score) >= x
    t = c.select("*", F.explode(F.filter(F.array(*map(F.lit, grid)), over)).alias("theta"))
    return t.groupBy(by, "theta").agg(F.sum("n").alias("fired"), F.sum("tp").alias("tp"), F.sum("lead_tp").alias("lead_tp"), F.sum("lead_all").alias("lead_all"))


def cost(n_events: Column, n_fire: Column, n: Column, tp: Column, lead_tp: Column, c_fp: Column | float) -> Column:
    """Expected cost of pooled events: those that don't fire cost 1; those that do cost ``c_fp`` for a false alarm's share and the loss left over for a hit's. Nothing fired: 1."""
    p_hit, p_fire = tp / n, n_fire / n_events
    left = 1 - mitigated(F.coalesce(lead_tp / F.nullif(tp, F.lit(0)), F.lit(0.0)))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 1.0).otherwise(p_fire * ((1 - p_hit) * F.lit(c_fp) + p_hit * left) + (1 - p_fire))


def pooled(per: DataFrame, events: DataFrame, grid: list[float], by: str = "event") -> DataFrame:
    """(theta, n_events, n_fire, fired, tp, lead_tp) over all events, with a row for each threshold, those that nothing reaches too. ``events``: a row per event with signals."""
    base = events.agg(F.count("*").alias("n_events")).select("n_events", F.explode(F.array(*map(F.lit, grid))).alias("theta"))
    t = per.groupBy("theta").agg(F.count("*").alias("n_fire"), F.sum("fired").alias("fired"), F.sum("tp").alias("tp"), F.sum("lead_tp").alias("lead_tp"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_fire", "fired", "tp", "lead_tp")}
    return base.join(t, "theta", "left").withColumns(zero)


def costs(t: DataFrame, c_fp: float = 0.05) -> DataFrame:
    """``pooled`` rows with their cost."""
    return t.withColumn("cost", cost(F.col("n_events"), F.col("n_fire"), F.col("fired"), F.col("tp"), F.col("lead_tp"), c_fp))


def cheapest(t: DataFrame, *by: str) -> DataFrame:
    """The threshold of least cost, the lower one on ties."""
    return t.groupBy(*by).agg(F.min(F.struct(F.round("cost", DIGITS).alias("cost"), "theta")).alias("m")).select(*by, "m.theta", "m.cost")


def by_price(t: DataFrame, prices: list[float]) -> DataFrame:
    """Cheapest threshold at each price of a false alarm, with what it fires."""
    p = t.select("*", F.explode(F.array(*map(F.lit, prices))).alias("price"))
    p = p.withColumn("cost", cost(F.col("n_events"), F.col("n_fire"), F.col("fired"), F.col("tp"), F.col("lead_tp"), F.col("price")))
    return cheapest(p, "price").join(t.select("theta", "fired", "tp"), "theta")


def held_out_choice(per: DataFrame, events: DataFrame, grid: list[float], by: str = "event", c_fp: float = 0.05, least_rest: int = 3) -> DataFrame:
    """For each event the threshold that is cheapest on the others, and what it fires on the event itself: (event, theta, fired, tp, lead_tp). Sums over the others are
    the totals less the event's own, so no event meets another. With fewer than ``least_rest`` others there is no choice."""
    own = events.select(by).join(F.broadcast(pooled(per, events, grid, by)))  # a row per event and threshold
    own = own.join(per.select(by, "theta", *[F.col(c).alias(f"own_{c}") for c in ("fired", "tp", "lead_tp")]), [by, "theta"], "left").fillna(0, ["own_fired", "own_tp", "own_lead_tp"])
    less = lambda c: F.col(c) - F.col(f"own_{c}")
    rest = cost(F.col("n_events") - 1, F.col("n_fire") - (F.col("own_fired") > 0).cast("int"), less("fired"), less("tp"), less("lead_tp"), c_fp)
    best = cheapest(own.where(F.col("n_events") > least_rest).withColumn("cost", rest), by)
    return best.select(by, "theta").join(own.select(by, "theta", *[F.col(f"own_{c}").alias(c) for c in ("fired", "tp", "lead_tp")]), [by, "theta"])


def break_even(d_tp: Column, d_fp: Column) -> Column:
    """Price of a false alarm at which giving up ``-d_tp`` hits for ``-d_fp`` false alarms breaks even: infinite without a change in false alarms, zero without a loss of hits."""
    return F.when(d_fp == 0, F.lit(float("inf"))).when(d_tp >= 0, F.lit(0.0)).otherwise(-d_tp / -d_fp)


def loss_reduction(df: DataFrame, grid: list[float], m_max: Column | float = 0.8, scale: Column | float = 60.0, c_fp: Column | float = 0.05, by: str = "event", score: str = "score", deployable: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """Expected loss reduction at each threshold, averaged over events with signals. Fires over the threshold with the mean lead of all fired signals, or (``deployable``) at it or over
    with that of the hits among them. ``extra``: a small grid of parameters that the columns ``m_max``, ``scale`` and ``c_fp`` name, one result per row of it."""
    n = df.groupBy(by).agg(F.count("*").alias("n")).select(by, "n", F.explode(F.array(*map(F.lit, grid))).alias("theta"))
    t = n.join(fired(df, grid, by, score, strict=not deployable), [by, "theta"], "left").fillna(0, ["fired", "tp", "lead_tp", "lead_all"])
    keys = ["theta"]
    if extra is not None:
        t, keys = t.join(F.broadcast(extra)), keys + extra.columns
    lead = F.coalesce(F.col("lead_tp") / F.nullif("tp", F.lit(0)), F.lit(0.0)) if deployable else F.col("lead_all") / F.col("fired")
    p_hit, p_fire = F.col("tp") / F.col("fired"), F.col("fired") / F.col("n")
    c = F.when(F.col("fired") == 0, 1.0).otherwise(p_fire * ((1 - p_hit) * F.lit(c_fp) + p_hit * (1 - mitigated(lead, m_max, scale))) + (1 - p_fire))
    return t.groupBy(*keys).agg(F.count("*").alias("n_events"), F.sum("fired").alias("fired"), F.round(1 - F.avg(c), 6).alias("elr"))
