"""The advisor: from a profile of each series to ranked pipelines, as a plan over the profiles.

The candidates are a small fixed table of rules; it is joined to the profiles by its conditions, scored by expressions, and
ranked per series. Nothing is collected.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..operators.diagnostics import signal_flags, strongest_signal

# Weights of speed, accuracy and robustness by objective.
OBJECTIVES = {
    "balanced": (0.34, 0.33, 0.33),
    "speed": (0.60, 0.20, 0.20),
    "accuracy": (0.15, 0.65, 0.20),
    "robustness": (0.15, 0.25, 0.60),
}

# Condition, pipeline, speed, accuracy, robustness, family, supported signals, base evidence, nearest stand-in.
HUGE, MEDIUM, SMALL = "huge_n", "medium_n", "not huge_n and not medium_n"
OFFLINE = [
    (f"{HUGE} and autocorrelated", "offline:pelt:ar", 0.78, 0.82, 0.70, "strong", ("autocorrelated",), 0.82, False),
    (f"{HUGE} and heavy_tail", "offline:pelt:nig", 0.68, 0.82, 0.85, "strong", ("heavy_tail",), 0.82, False),
    (HUGE, "offline:fpop:l2", 0.92, 0.73, 0.55, "generic", ("change_dense",), 0.60, False),
    (f"{MEDIUM} and heavy_tail", "offline:binseg:l1_median", 0.38, 0.74, 0.93, "strong", ("heavy_tail",), 0.86, False),
    (f"{MEDIUM} and few_strong_changes and masking_risk", "offline:wbs:normal", 0.62, 0.84, 0.73, "strong", ("few_strong_changes", "masking_risk"), 0.80, False),
    (f"{MEDIUM} and few_strong_changes and not masking_risk", "offline:binseg:normal", 0.86, 0.70, 0.60, "strong", ("few_strong_changes",), 0.76, False),
    (f"{MEDIUM} and change_dense", "offline:fpop:l2", 0.92, 0.73, 0.55, "strong", ("change_dense",), 0.70, False),
    (f"{MEDIUM} and change_dense", "offline:wbs:l2", 0.66, 0.76, 0.58, "strong", ("change_dense",), 0.66, True),
    (SMALL, "offline:dynp:normal", 0.55, 0.88, 0.60, "strong", ("few_strong_changes",), 0.76, False),
    ("true", "offline:pelt:l2", 0.90, 0.72, 0.55, "fallback", ("low_signal",), 0.42, False),
]
ONLINE = [
    ("binary_like", "online:bocpd:bernoulli", 0.78, 0.84, 0.74, "strong", ("binary_like",), 0.78, False),
    ("count_like and not binary_like", "online:bocpd:poisson", 0.76, 0.84, 0.74, "strong", ("count_like",), 0.76, False),
    ("not count_like and not binary_like", "online:bocpd:gaussian", 0.74, 0.82, 0.72, "generic", ("autocorrelated",), 0.62, False),
]
ONLINE_BY_OBJECTIVE = {
    "speed": ("true", "online:cusum", 0.95, 0.58, 0.48, "generic", ("low_signal",), 0.55, False),
    "robustness": ("true", "online:page_hinkley", 0.88, 0.64, 0.62, "generic", ("low_signal",), 0.56, False),
}
#: Longest run that a recommended online detector follows.
MAX_RUN = 2000
# Base confidence by family of candidates.
FAMILY = {"strong": 0.74, "generic": 0.64, "fallback": 0.56}

# By calibration family the intercept, the slope, and for each feature lower, upper and weight.
FEATURES = ("nan_rate", "kurtosis_proxy", "outlier_rate_iqr", "mad_to_std_ratio", "lag1_autocorr", "change_density_score", "regime_change_proxy", "strength")
CALIBRATION = {
    "gaussian": (0.04, 0.90, (0.0, 0.08, 1.0), (1.8, 4.8, 1.0), (0.0, 0.04, 0.9), (0.85, 1.35, 0.7), (-0.20, 0.45, 0.8), (0.03, 0.38, 0.8), (0.05, 1.30, 0.7), (0.0, 0.35, 0.5)),
    "heavy_tailed": (0.03, 0.88, (0.0, 0.12, 1.0), (3.0, 12.0, 1.1), (0.01, 0.20, 1.0), (0.15, 0.95, 1.0), (-0.20, 0.50, 0.6), (0.02, 0.45, 0.7), (0.05, 1.80, 0.7), (0.0, 0.45, 0.5)),
    "autocorrelated": (0.04, 0.89, (0.0, 0.12, 1.0), (1.5, 6.5, 0.7), (0.0, 0.08, 0.7), (0.60, 1.30, 0.8), (0.35, 0.98, 1.2), (0.01, 0.42, 0.7), (0.05, 1.60, 0.7), (0.0, 0.65, 0.6)),
    "seasonal": (0.05, 0.86, (0.0, 0.10, 1.0), (1.5, 7.0, 0.8), (0.0, 0.08, 0.8), (0.55, 1.35, 0.8), (0.10, 0.95, 0.9), (0.01, 0.55, 0.6), (0.05, 1.80, 0.6), (0.25, 1.0, 1.4)),
    "multivariate": (0.06, 0.84, (0.0, 0.15, 1.0), (1.2, 9.0, 0.8), (0.0, 0.12, 0.8), (0.45, 1.45, 0.9), (-0.25, 0.90, 0.8), (0.01, 0.55, 0.8), (0.05, 2.00, 0.8), (0.0, 0.75, 0.7)),
    "binary": (0.04, 0.88, (0.0, 0.12, 1.0), (0.2, 30.0, 0.3), (0.0, 0.15, 0.4), (0.0, 1.6, 0.3), (-1.0, 1.0, 0.3), (0.0, 1.0, 0.8), (0.0, 3.0, 0.8), (0.0, 1.0, 0.4)),
    "count": (0.04, 0.87, (0.0, 0.12, 1.0), (0.5, 20.0, 0.5), (0.0, 0.25, 0.7), (0.0, 1.8, 0.4), (-1.0, 1.0, 0.4), (0.0, 1.0, 0.8), (0.0, 3.0, 0.8), (0.0, 1.0, 0.4)),
}


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def calibration_family(d: DataFrame) -> DataFrame:
    """Adds the family whose calibration applies."""
    c = F.col
    heavy = F.greatest(c("kurtosis_proxy") / 4.0, c("outlier_rate_iqr") / 0.02, F.when(c("mad_to_std_ratio") <= 0.80, 0.80 / F.greatest(c("mad_to_std_ratio"), F.lit(1e-12))).otherwise(F.lit(0.0)))
    auto = F.greatest(c("lag1_autocorr") / 0.55, c("lagk_autocorr") / 0.45, c("residual_lag1_autocorr") / 0.40)
    family = (
        F.when(c("dimensions") >= 4, "multivariate").when(c("binary_like"), "binary").when(c("count_like"), "count").when(c("strength") >= 0.40, "seasonal")
        .when(c("autocorrelated") & (heavy > auto + 0.25), "heavy_tailed").when(c("autocorrelated"), "autocorrelated").when(c("heavy_tail"), "heavy_tailed").otherwise("gaussian")
    )
    return d.withColumn("calibration", family)


def divergence(d: DataFrame) -> DataFrame:
    """Adds how far a profile lies outside its family's ranges (weighted mean, in widths), and intercept and slope."""
    names = [f"{k}{i}" for i in range(len(FEATURES)) for k in ("_low", "_high", "_w")]
    rows = [(k, v[0], v[1], *[float(x) for r in v[2:] for x in r]) for k, v in CALIBRATION.items()]
    table = d.sparkSession.createDataFrame(rows, "calibration string, intercept double, slope double, " + ", ".join(f"{n} double" for n in names))
    d = d.join(F.broadcast(table), "calibration")  # one row per family
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, name in enumerate(FEATURES):
        low, high, w = F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_w{i}")
        out = F.greatest(low - F.col(name), F.col(name) - high, F.lit(0.0)) / F.greatest(high - low, F.lit(1e-9))
        total, weight = total + w * F.least(out, F.lit(3.0)), weight + w
    block, long = F.col("pattern") == "block", F.col("longest") > 512
    total = total + F.when(block, 0.8).otherwise(0.0) + F.when(long, 0.8 * clamp((F.col("longest") - 512) / 512.0, 0.0, 3.0)).otherwise(0.0)
    weight = weight + F.when(block, 1.0).otherwise(0.0) + F.when(long, 0.8).otherwise(0.0)
    cover = F.col("valid_dimensions") / F.col("dimensions")  # columns with enough valid rows
    total = total + F.when(cover < 0.70, clamp((0.70 - cover) / 0.70, 0.0, 3.0)).otherwise(0.0)
    weight = weight + F.when(cover < 0.70, 1.0).otherwise(0.0)
    return d.withColumn("divergence", total / weight).drop(*names)


def recommend(profiles: DataFrame, objective: str = "balanced", online: bool = False, min_confidence: float = 0.2, allow_abstain: bool = True, top: int = 5) -> DataFrame:
    """Up to `top` pipelines per profile: series_id, place, pipeline, score, confidence, low, high, calibration, abstained.

    A pipeline names its detector, its cost or model, and how it is thinned: candidates at every row, or on very long series at
    every jump-th. Online detectors take one column: profiles of more are an error.
    """
    if objective not in OBJECTIVES:
        raise InvalidInput(f"unknown objective {objective!r}")
    if online:
        one = F.when(F.col("dimensions") == 1, F.col("series_id")).otherwise(F.raise_error(F.lit("online detectors take one column")))
        profiles = profiles.withColumn("series_id", one)
    d = divergence(calibration_family(strongest_signal(signal_flags(profiles))))
    d = d.withColumn("jump", F.when(F.col("huge_n"), F.least(F.greatest(F.expr("n div 25000"), F.lit(1)), F.lit(16))).otherwise(F.lit(1)))
    rules = ONLINE + ([ONLINE_BY_OBJECTIVE[objective]] if objective in ONLINE_BY_OBJECTIVE else []) if online else OFFLINE
    w = OBJECTIVES[objective]
    best_axis = {"speed": 0, "accuracy": 1, "robustness": 2}.get(objective)
    entries = []
    for condition, name, *axes, family, signals, evidence, stand_in in rules:
        pipeline = F.lit(name)
        if name.endswith(":normal"):  # columns that vary together, where there are few of them and the series is not very long
            pipeline = F.when(F.col("dimensions").between(2, 16) & ~F.col("huge_n"), F.lit(f"{name}_full_cov")).otherwise(pipeline)
        if name.startswith("offline:"):
            pipeline = F.concat(pipeline, F.lit(":jump="), F.col("jump").cast("string"))
        elif name.startswith("online:bocpd:"):
            pipeline = F.concat(pipeline, F.lit(f":max_run_length={MAX_RUN}"))
        fit = min(1.0, sum(a * b for a, b in zip(w, axes, strict=True)))
        on_axis = best_axis is not None and axes[best_axis] == max(axes)
        base = FAMILY[family] - (0.08 if stand_in else 0) + (0.05 if on_axis else 0)
        entries.append(F.when(F.expr(condition), F.struct(pipeline.alias("pipeline"), F.lit(fit).alias("fit"), F.lit(base).alias("base"), F.lit(evidence - (0.05 if stand_in else 0)).alias("evidence"), F.array(*map(F.lit, signals)).alias("signals"))))
    rows = d.select("*", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("c")).select("*", "c.*").drop("c")
    off = lambda flag, v: F.when(F.col(flag), F.lit(v)).otherwise(F.lit(0.0))
    raw = F.col("base") - off("used_subsampling", 0.05) - off("masking_risk", 0.07) - off("conflicting_signals", 0.15) + F.when(F.array_contains("signals", F.col("strongest")), 0.10).otherwise(0.0)
    raw = clamp(raw, 0.05, 0.95)
    ood = clamp(1 - F.exp(-0.9 * F.col("divergence")), 0.0, 0.8)
    rows = rows.withColumn("raw", raw).withColumn("ood", ood)
    rows = rows.withColumn("confidence", clamp(clamp(F.col("intercept") + F.col("slope") * F.col("raw"), 0.01, 0.99) * (1 - F.col("ood")), 0.01, 0.99))
    half = clamp(0.10 + 0.25 * (1 - F.col("confidence")) + off("conflicting_signals", 0.05) + 0.20 * F.col("ood"), 0.08, 0.45)
    support = clamp(F.col("evidence") - off("conflicting_signals", 0.10) - off("low_signal", 0.05), 0.0, 1.0)
    rows = rows.withColumn("score", 0.55 * F.col("fit") + 0.35 * F.col("confidence") + 0.10 * support)
    rows = rows.withColumn("low", F.greatest(F.col("confidence") - half, F.lit(0.0))).withColumn("high", F.least(F.col("confidence") + half, F.lit(1.0)))
    rows = rows.dropDuplicates(["series_id", "pipeline"]) if not online else rows
    by = W.partitionBy("series_id").orderBy(F.desc("score"), F.desc("confidence"), "pipeline")
    rows = rows.withColumn("place", F.row_number().over(by)).withColumn("_first", F.first("confidence").over(by))
    doubt = F.col("_first") < min_confidence
    safe = "online:bocpd:gaussian:" if online else "offline:pelt:l2:"
    keep = F.when(doubt & F.lit(allow_abstain), F.col("pipeline").startswith(safe)).otherwise(F.col("place") <= top)
    return rows.where(keep).select("series_id", "place", "pipeline", "score", "confidence", "low", "high", "calibration", "strongest", (doubt & F.lit(allow_abstain)).alias("abstained"))


# Time and memory of a pipeline's detector, and its scores from 0 to 1.
RESOURCES = {
    "pelt": ("O(n) avg / O(n^2) worst", "O(n)", 0.45, 0.40),
    "binseg": ("O(n log n)", "O(n)", 0.35, 0.35),
    "fpop": ("O(n) avg / O(n^2) worst", "O(n)", 0.38, 0.40),
    "wbs": ("O(M*n)", "O(n + M)", 0.65, 0.55),
    "dynp": ("O(k*n^2)", "O(k*n + n)", 0.92, 0.78),
    "bocpd": ("O(W) per step", "O(W*d)", 0.55, 0.60),
    "cusum": ("O(1) per step", "O(1)", 0.05, 0.05),
    "page_hinkley": ("O(1) per step", "O(1)", 0.05, 0.05),
}
# The same for the cost of absolute deviations, whatever the detector.
L1_RESOURCES = ("slow path: O(m) median per segment query (not O(1)); detector overhead applies", "O(n)", 0.88, 0.45)


def resource_estimate(pipeline: str) -> dict:
    time, memory, t, m = L1_RESOURCES if ":l1" in pipeline else RESOURCES[pipeline.split(":")[1]]
    return {"time": time, "memory": memory, "relative_time": t, "relative_memory": m}
