"""Statistics over scored rows, each a DataFrame by model, condition or pair.

Rows carry ``seq``, an order of arrival: where a question was answered more than once, the last row counts
in paired statistics, while accuracy counts all rows. Undefined statistics are null. Null flags are false.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.md5 import draws

#: Fields that have to be the same for all rows of a model; prompt_key may differ.
PROVENANCE = [
    "model_string", "served_model", "served_by", "served_provider", "quantization", "thinking_effort", "max_tokens", "temperature",
    "reasoning_format", "include_sampling_params", "max_tokens_field", "prompt_key", "cohort_id", "harness_version", "git_sha",
]


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def named(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("model_label", F.lit("")) != "")


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows with these values; null equals null."""
    for name, value in values.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def last_answers(rows: DataFrame, keys: Sequence[str] = ("model_label", "condition", "question_id")) -> DataFrame:
    """The last row of each question, by ``seq``. An aggregate, not a window, so that rows are combined before they move."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """n, n_valid, accuracy and invalid_rate by ``keys``; invalid answers are wrong ones."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flag("valid")).alias("n_valid"),
        (F.count_if(flag("correct")) / F.count(F.lit(1))).alias("accuracy"),
        (1 - F.count_if(flag("valid")) / F.count(F.lit(1))).alias("invalid_rate"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    return accuracy(rows.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))), "model_label", "condition", "category")


def accuracy_interval(rows: DataFrame, *keys: str, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """``accuracy`` with the bootstrap interval of its mean, over all rows in order of arrival."""
    per_row = rows.select(*keys, "seq", flag("correct").cast("double").alias("value"))
    return accuracy(rows, *keys).join(bootstrap(per_row.dropna(subset=list(keys)), list(keys), ["value"], "seq", n_boot=n_boot, seed=seed).select(*keys, "ci_low", "ci_high"), list(keys), "left")


def chance(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean of 1 / n_options over distinct questions, the last row's n_options each."""
    last = last_answers(rows.select(*keys, "question_id", "n_options", "seq"), [*keys, "question_id"])
    return last.where("n_options > 0").groupBy(*keys).agg(F.avg(1 / F.col("n_options")).alias("chance"))


def extraction(rows: DataFrame, *keys: str) -> DataFrame:
    """Share of each extraction method, to four places."""
    method = F.coalesce(F.nullif("extraction_method", F.lit("")), F.lit("unknown")).alias("method")
    counts = rows.groupBy(*keys, method).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 4))


def tokens(rows: DataFrame, *keys: str) -> DataFrame:
    """Token counts in the metric that the group has, and latency. Without any reported reasoning tokens, completion tokens stand for them.
    Both metrics are aggregated at once and one is chosen, so that no row waits for its group."""
    both = {"reasoning": "reasoning_tokens", "completion": "completion_tokens"}
    found = rows.groupBy(*keys).agg(
        F.coalesce(F.max(flag("reasoning_tokens_reported")), F.lit(False)).alias("reported"),
        (F.count_if(flag("reasoning_tokens_reported")) / F.count(F.lit(1))).alias("reasoning_reported_frac"),
        *[F.struct(F.avg(c).alias("mean"), F.percentile(c, F.array(F.lit(0.5), F.lit(0.95))).alias("at")).alias(n) for n, c in both.items()],
        F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("latency"),
    )
    own = lambda f: F.when(F.col("reported"), f("reasoning")).otherwise(f("completion"))
    return found.select(
        *keys,
        own(lambda n: F.lit(both[n])).alias("token_metric"),
        (~F.col("reported")).alias("is_proxy"),
        "reasoning_reported_frac",
        own(lambda n: F.col(f"{n}.mean")).alias("mean_tokens"),
        own(lambda n: F.col(f"{n}.at")[0]).alias("median_tokens"),
        own(lambda n: F.col(f"{n}.at")[1]).alias("p95_tokens"),
        F.col("latency")[0].alias("median_latency_ms"),
        F.col("latency")[1].alias("p95_latency_ms"),
    )


def cost(rows: DataFrame, *keys: str) -> DataFrame:
    """Cost of each group at the first pair of prices that it has, in order of arrival; groups without prices are left out."""
    both = F.col("usd_per_1m_input").isNotNull() & F.col("usd_per_1m_output").isNotNull()
    price = F.min_by(F.when(both, F.struct(F.col("usd_per_1m_input").alias("i"), F.col("usd_per_1m_output").alias("o"))), F.when(both, F.col("seq")))
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    out = rows.groupBy(*keys).agg(
        price.alias("price"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("output_tokens"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(flag("correct")).alias("n_correct"),
        names("price_quoted_on").alias("quoted"),
        names("served_by").alias("providers"),
    )
    total = F.col("input_tokens") / 1e6 * F.col("price.i") + F.col("output_tokens") / 1e6 * F.col("price.o")
    return out.where(F.col("price").isNotNull()).select(
        *keys,
        F.col("price.i").alias("usd_per_1m_input"),
        F.col("price.o").alias("usd_per_1m_output"),
        "input_tokens",
        "output_tokens",
        "n_correct",
        total.alias("total_usd"),
        (total / F.col("n")).alias("usd_per_call"),
        (total / F.nullif("n_correct", F.lit(0))).alias("usd_per_correct"),
        F.array_join("quoted", ",").alias("price_quoted_on"),
        F.array_join("providers", ",").alias("served_by"),
        (F.size("quoted") == 0).alias("price_unstamped"),
    )


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: the binomial tail at 1/2, doubled, summed in logarithms so that thousands of pairs neither overflow nor vanish early."""
    m = b + c
    start = F.struct((-m * F.lit(float(np.log(2)))).alias("term"), F.exp(-m * F.lit(float(np.log(2)))).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((m - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    least = F.least(b, c)
    tail = F.when(least > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(least, F.lit(1).cast("long"))), start, add)["total"]).otherwise(start["total"])
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def flags(rows: DataFrame) -> DataFrame:
    """(condition, question_id, model_label, correct) of the last rows: what all paired statistics read."""
    return last_answers(named(rows).select("model_label", "condition", "question_id", "seq", flag("correct").alias("correct"))).drop("seq")


def pairs(rows: DataFrame) -> DataFrame:
    """Counts for each pair of models within a condition over the questions that both answered, with the exact p.

    Models of a question are paired from one array of them, so rows move once, by question.
    """
    per_question = flags(rows).groupBy("condition", "question_id").agg(F.array_sort(F.collect_list(F.struct("model_label", "correct"))).alias("m"))
    both = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model_label"] > a["model_label"]), lambda b: F.struct(a["model_label"].alias("model_a"), b["model_label"].alias("model_b"), a["correct"].alias("x"), b["correct"].alias("y")))))
    counts = per_question.select("condition", F.inline(both)).groupBy("condition", "model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.count_if(F.col("x") & ~F.col("y")).alias("b"),
        F.count_if(~F.col("x") & F.col("y")).alias("c"),
        F.count_if("x").alias("n_a"),
        F.count_if("y").alias("n_b"),
    )
    return counts.select(
        "condition", "model_a", "model_b", F.concat("model_a", F.lit(" vs "), "model_b").alias("pair"), "n_shared", "b", "c",
        (F.col("n_a") / F.col("n_shared")).alias("accuracy_a"), (F.col("n_b") / F.col("n_shared")).alias("accuracy_b"),
        ((F.col("n_a") - F.col("n_b")) / F.col("n_shared")).alias("delta"), mcnemar(F.col("b"), F.col("c")).alias("p_raw"),
    )


def holm(df: DataFrame, family: Sequence[str], p: str = "p_raw", tie: str = "pair") -> DataFrame:
    """``df`` with p_adjusted: step-down, capped at 1, never falling along the order of p."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    rank = F.row_number().over(order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = df.withColumn("scaled", F.least(F.lit(1.0), F.col(p) * (size - rank + 1)))
    return scaled.withColumn("p_adjusted", F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled")


def comparisons(rows: DataFrame, primary: tuple[str, str] | None = None, alpha: float = 0.05) -> DataFrame:
    """``pairs`` with corrected p. A primary pair, in either order, stays out of the correction and is judged by its own p."""
    found = pairs(rows)
    is_primary = F.lit(False)
    if primary:
        is_primary = (F.col("model_a") == min(primary)) & (F.col("model_b") == max(primary))
    marked = found.withColumn("is_primary", is_primary)
    rest = holm(marked.where("not is_primary"), ["condition"])
    out = rest.unionByName(marked.where("is_primary").withColumn("p_adjusted", F.col("p_raw"))) if primary else rest
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def grounding(rows: DataFrame) -> DataFrame:
    """Accuracy with the image, with tags only and with neither, over questions that a model answered in all three, and the differences."""
    names = ["clean", "blind_tags", "blind_notags"]
    wide = flags(rows).where(F.col("condition").isin(names)).groupBy("model_label", "question_id").pivot("condition", names).agg(F.max(F.col("correct").cast("int")))
    both = wide.where(" and ".join(f"{n} is not null" for n in names)).groupBy("model_label")
    means = both.agg(F.count(F.lit(1)).alias("n_shared"), *[(F.sum(n) / F.count(F.lit(1))).alias(f"accuracy_{n}") for n in names], *[F.sum(n).alias(n) for n in names])
    gap = lambda a, b: (F.col(a) - F.col(b)) / F.col("n_shared")
    return means.withColumns({"grounding_gap": gap("clean", "blind_notags"), "tag_effect": gap("blind_tags", "blind_notags"), "image_effect": gap("clean", "blind_tags")}).drop(*names)


def common(rows: DataFrame) -> DataFrame:
    """Last answers to the questions that every model of a condition answered."""
    f = flags(rows)
    models = f.groupBy("condition").agg(F.count_distinct("model_label").alias("models"))
    whole = f.groupBy("condition", "question_id").agg(F.count_distinct("model_label").alias("k")).join(models, "condition").where("k = models")
    return f.join(whole.select("condition", "question_id"), ["condition", "question_id"], "left_semi")


def common_accuracy(rows: DataFrame) -> DataFrame:
    return common(rows).groupBy("condition", "model_label").agg(F.count(F.lit(1)).alias("n_shared"), (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"))


def robustness(rows: DataFrame, baseline: str = "clean", degraded: str = "corrupt") -> DataFrame:
    """Accuracy lost from ``baseline`` to ``degraded`` over the questions of both, its exact p, chance, rates of invalid answers, and what share of the margin over chance is left.

    The share is null where the baseline is not over chance. Whether it is so by more than noise is the bootstrap's
    to say, see ``with_retention``.
    """
    f = flags(rows).where(F.col("condition").isin(baseline, degraded))
    wide = f.groupBy("model_label", "question_id").pivot("condition", [baseline, degraded]).agg(F.max(F.col("correct").cast("int")))
    wide = wide.toDF("model_label", "question_id", "x", "y").where("x is not null and y is not null")
    head = wide.groupBy("model_label").agg(F.count(F.lit(1)).alias("n_shared"), F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.count_if(F.expr("x = 1 and y = 0")).alias("b"), F.count_if(F.expr("x = 0 and y = 1")).alias("c"))
    own = named(rows).where(F.col("condition").isin(baseline, degraded)).join(wide.select("model_label", "question_id"), ["model_label", "question_id"], "left_semi")
    invalid = own.groupBy("model_label").agg(*[(1 - F.count_if((F.col("condition") == c) & flag("valid")) / F.count_if(F.col("condition") == c)).alias(n) for c, n in ((baseline, "invalid_rate_baseline"), (degraded, "invalid_rate_degraded"))])
    luck = chance(own.where(F.col("condition") == baseline), "model_label")
    pooled = named(rows).where(F.col("condition") == degraded).groupBy("model_label").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("corruption", F.lit("")))), "+").alias("corruption"), F.max(F.coalesce("corruption_severity", F.lit(0))).alias("corruption_severity"), ((F.count_distinct(F.nullif("corruption", F.lit(""))) > 1) | (F.count_distinct(F.coalesce("corruption_severity", F.lit(0))) > 1)).alias("pooled"))
    out = head.join(invalid, "model_label").join(luck, "model_label").join(pooled, "model_label", "left")
    base, low = F.col("nx") / F.col("n_shared"), F.col("ny") / F.col("n_shared")
    return out.select(
        "model_label", "corruption", "corruption_severity", "pooled", "n_shared", base.alias("accuracy_baseline"), low.alias("accuracy_degraded"),
        ((F.col("nx") - F.col("ny")) / F.col("n_shared")).alias("delta"), mcnemar(F.col("b"), F.col("c")).alias("p_value"), "chance",
        F.when(base > F.col("chance"), (low - F.col("chance")) / (base - F.col("chance"))).alias("above_chance_retention"),
        "invalid_rate_baseline", "invalid_rate_degraded", (F.col("invalid_rate_degraded") - F.col("invalid_rate_baseline")).alias("invalid_rate_delta"),
    )


def with_retention(robust: DataFrame, intervals: DataFrame) -> DataFrame:
    """``robust`` with the share kept only where the baseline's interval (model_label, ci_low) lies over chance, and a note where it isn't."""
    joined = robust.join(intervals.select("model_label", "ci_low"), "model_label", "left")
    signal = F.col("accuracy_baseline") > F.col("chance")
    note = F.when(~signal, "baseline at or below chance").when(F.col("ci_low") <= F.col("chance"), "baseline not distinguishable from chance").otherwise("")
    kept = F.when(signal & ~F.coalesce(F.col("ci_low") <= F.col("chance"), F.lit(False)), F.col("above_chance_retention"))
    return joined.withColumns({"above_chance_retention": kept, "retention_note": note}).drop("ci_low")


def tau_b(points: DataFrame, label: str, x: str, y: str, *keys: str) -> DataFrame:
    """Kendall's tau-b of x and y over the points of each group, from all pairs of a group's array; null for fewer than two points or only ties."""
    g = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(label, F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"))
    both = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b[label] > a[label]), lambda b: F.struct(F.signum(a["x"] - b["x"]).alias("dx"), F.signum(a["y"] - b["y"]).alias("dy")))))
    g = g.withColumn("d", both)
    total = lambda f: F.aggregate("d", F.lit(0.0), lambda s, d: s + f(d))
    top, nx, ny = total(lambda d: d["dx"] * d["dy"]), total(lambda d: F.abs(d["dx"])), total(lambda d: F.abs(d["dy"]))
    return g.select(*keys, F.when((nx > 0) & (ny > 0), top / F.sqrt(nx * ny)).alias("kendall_tau_b"))


def ranking(rows: DataFrame, baseline: str = "clean", degraded: str = "corrupt") -> DataFrame:
    """Each model's accuracy and rank in both conditions, over questions that all models answered there; equal ones rank by name."""
    acc = common_accuracy(rows)
    side = lambda c, n: acc.where(F.col("condition") == c).select("model_label", F.col("accuracy").alias(f"accuracy_{n}"))
    both = side(baseline, "baseline").join(side(degraded, "degraded"), "model_label")
    for n in ("baseline", "degraded"):  # as many rows as models
        both = both.withColumn(f"rank_{n}", F.row_number().over(Window.orderBy(F.desc(f"accuracy_{n}"), "model_label")))
    return both


def inversions(rows: DataFrame, baseline: str = "clean", degraded: str = "corrupt", alpha: float = 0.05) -> DataFrame:
    """Pairs whose order turns from ``baseline`` to ``degraded``; supported if each order is significant by itself, uncorrected.

    Signs are over the questions of all models, p over those of the pair.
    """
    r = ranking(rows, baseline, degraded).select("model_label", "accuracy_baseline", "accuracy_degraded")
    a, b = r.toDF("model_a", "xa", "ya"), r.toDF("model_b", "xb", "yb")
    p = pairs(rows)
    side = lambda c, n: p.where(F.col("condition") == c).select("model_a", "model_b", F.col("p_raw").alias(n))
    turned = a.join(b, F.col("model_a") < F.col("model_b")).where(F.signum(F.col("xa") - F.col("xb")) * F.signum(F.col("ya") - F.col("yb")) < 0)
    out = turned.join(side(baseline, "p_baseline"), ["model_a", "model_b"], "left").join(side(degraded, "p_degraded"), ["model_a", "model_b"], "left")
    return out.select(
        F.concat("model_a", F.lit(" vs "), "model_b").alias("pair"),
        F.when(F.col("xa") > F.col("xb"), F.col("model_a")).otherwise(F.col("model_b")).alias("baseline_leader"),
        F.when(F.col("ya") > F.col("yb"), F.col("model_a")).otherwise(F.col("model_b")).alias("degraded_leader"),
        (F.col("xa") - F.col("xb")).alias("baseline_delta"), (F.col("ya") - F.col("yb")).alias("degraded_delta"), "p_baseline", "p_degraded",
        F.coalesce((F.col("p_baseline") < alpha) & (F.col("p_degraded") < alpha), F.lit(False)).alias("supported"),
    )


def pareto(points: DataFrame, label: str, cost_column: str, benefit: str, *keys: str) -> DataFrame:
    """Points that no other of their group is at least as good as on both axes and better on one. Points without both coordinates are left out; ties stay."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    usable = points.where(finite(cost_column) & finite(benefit))
    best = usable.groupBy(*keys, cost_column).agg(F.max(benefit).alias("best"))
    cheaper = Window.partitionBy(*keys).orderBy(cost_column).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("before", F.max("best").over(cheaper)).where(F.col("before").isNull() | (F.col("best") > F.col("before")))
    return usable.join(front.select(*keys, cost_column, F.col("best").alias(benefit)), [*keys, cost_column, benefit], "left_semi")


def efficiency(rows: DataFrame) -> DataFrame:
    """For each condition and model: accuracy, chance, tokens in one metric for all models of the condition, cost per correct answer, and whether it is on the frontier.

    Where one model has no reasoning tokens, completion tokens are the axis for all.
    """
    rows = named(rows)
    keys = ["condition", "model_label"]
    profile = tokens(rows, *keys).select(*keys, "token_metric", "reasoning_reported_frac")
    w = Window.partitionBy("condition")
    axis = profile.withColumn("uniform", F.min("token_metric").over(w) == F.max("token_metric").over(w)).withColumn("axis", F.when(F.min("token_metric").over(w) == "reasoning_tokens", "reasoning_tokens").otherwise("completion_tokens"))
    value = F.when(F.col("axis") == "reasoning_tokens", F.col("reasoning_tokens")).otherwise(F.col("completion_tokens"))
    counts = rows.join(axis.select(*keys, "axis"), keys).withColumn("value", value).groupBy(*keys).agg(F.avg("value").alias("mean_tokens"), F.percentile("value", F.lit(0.5)).alias("median_tokens"))
    points = accuracy(rows, *keys).select(*keys, "n", "accuracy").join(chance(rows, *keys), keys, "left").join(axis.select(*keys, F.col("axis").alias("token_metric"), "uniform", "reasoning_reported_frac"), keys).join(counts, keys).join(cost(rows, *keys).select(*keys, "usd_per_correct"), keys, "left")
    front = pareto(points, "model_label", "mean_tokens", "accuracy", "condition").select(*keys, F.lit(True).alias("on_frontier"))
    return points.join(front, keys, "left").withColumn("on_frontier", F.coalesce("on_frontier", F.lit(False)))


def provenance(rows: DataFrame, fields: Sequence[str] = PROVENANCE) -> DataFrame:
    """(model_label, field, n_values, field_values, inconsistent): distinct values as text, nulls and empty ones aside, sorted."""
    present = [f for f in fields if f in rows.columns]
    long = named(rows).select("model_label", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in present])).alias("x")).select("model_label", "x.*")
    found = long.groupBy("model_label", "field").agg(F.array_sort(F.collect_set(F.nullif("value", F.lit("")))).alias("v"))
    return found.select("model_label", "field", F.size("v").cast("long").alias("n_values"), F.array_join("v", "|").alias("field_values"), ((F.size("v") > 1) & (F.col("field") != "prompt_key")).alias("inconsistent"))


def warnings(rows: DataFrame, primary: tuple[str, str] | None = None) -> DataFrame:
    """(subject, rule) for all that a reader should know before quoting a number."""
    prov = provenance(rows)
    keys = ["model_label", "condition"]
    key = F.concat_ws("|", *keys)
    eff = efficiency(rows)
    size = pairs(rows).groupBy("condition").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    parts = [
        prov.where("inconsistent").select(F.col("model_label").alias("subject"), F.concat(F.lit("several values of "), "field").alias("rule")),
        prov.where("field = 'git_sha' and n_values = 0").select("model_label", F.lit("no git_sha")),
        tokens(rows, *keys).where("is_proxy").select(key, F.lit("completion tokens as a proxy")),
        cost(rows, *keys).where("price_unstamped").select(key, F.lit("price without a date")),
        accuracy(rows, *keys).where("invalid_rate > 0.10").select(key, F.lit("invalid rate over 10 %")),
        eff.where("not uniform").select("condition", F.lit("token metric not uniform")).distinct(),
        robustness(rows).where("pooled").select("model_label", F.lit("pooled degradations")),
    ]
    if primary is None:
        parts.append(size.select("condition", F.lit("no primary comparison")))
    else:
        # a primary pair that a condition lacks, in either order, leaves every comparison there secondary
        own = F.sort_array(F.array(F.lit(primary[0]), F.lit(primary[1])))
        there = pairs(rows).withColumn("own", F.sort_array(F.array("model_a", "model_b")) == own).groupBy("condition").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("k"))
        parts.append(there.where("not own").select("condition", F.concat(F.lit("primary comparison is missing; family of "), F.col("k").cast("string")).alias("rule")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def bootstrap(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0, chunk: int = 4_000_000) -> DataFrame:
    """(keys, n, mean, ci_low, ci_high) of a mean, or with two value columns of the difference of their means under one resampling.

    Draws are NumPy's PCG64, row by row of the resamples, so that results are those of any program with
    the same stream; resamples are drawn in chunks of ``chunk`` values. A group is one task's work: its n values and the chunk are all that is held.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = list(values)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        n = t.num_rows
        cols = [t.column(v).cast(pa.float64()).to_numpy() for v in names]
        rng = np.random.default_rng(seed)
        means, step = [], max(1, chunk // n)
        for at in range(0, n_boot, step):
            idx = rng.integers(0, n, size=(min(step, n_boot - at), n))
            m = [c[idx].mean(axis=1) for c in cols]
            means.append(m[0] if len(m) == 1 else m[0] - m[1])
        low, high = np.percentile(np.concatenate(means), [100 * alpha / 2, 100 * (1 - alpha / 2)])
        mean = float(cols[0].mean() - (cols[1].mean() if len(cols) > 1 else 0))
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "n": [n], "mean": [mean], "ci_low": [float(low)], "ci_high": [float(high)]})

    return df.groupBy(*keys).applyInArrow(run, f"{kinds}, n long, mean double, ci_low double, ci_high double")


def paired_interval(rows: DataFrame, minuend: str, subtrahend: str, also: Sequence[str] = (), n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """(model_label, n, mean, ci_low, ci_high) of the accuracy in one condition less that in another, over the questions that a model answered in both and in those of ``also``."""
    names = [minuend, subtrahend, *also]
    wide = flags(rows).where(F.col("condition").isin(names)).groupBy("model_label", "question_id").pivot("condition", names).agg(F.max(F.col("correct").cast("double")))
    wide = wide.toDF("model_label", "question_id", "x", "y", *[f"also_{i}" for i in range(len(also))]).dropna()
    return bootstrap(wide.select("model_label", "question_id", "x", "y"), ["model_label"], ["x", "y"], "question_id", n_boot=n_boot, seed=seed)


def grounding_interval(rows: DataFrame, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """(model_label, gap_ci_low, gap_ci_high): of the grounding gap, over the questions of ``grounding``."""
    return paired_interval(rows, "clean", "blind_notags", ["blind_tags"], n_boot, seed).select("model_label", F.col("ci_low").alias("gap_ci_low"), F.col("ci_high").alias("gap_ci_high"))


def robustness_interval(rows: DataFrame, baseline: str = "clean", degraded: str = "corrupt", n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """(model_label, delta_ci_low, delta_ci_high): of the delta of ``robustness``, over its questions."""
    return paired_interval(rows, baseline, degraded, (), n_boot, seed).select("model_label", F.col("ci_low").alias("delta_ci_low"), F.col("ci_high").alias("delta_ci_high"))


def paired_hash_interval(rows: DataFrame, minuend: str, subtrahend: str, also: Sequence[str] = ()) -> DataFrame:
    """As ``paired_interval``, by ``hash_bootstrap``: the mean of a question's difference is the difference of means under one draw."""
    names = [minuend, subtrahend, *also]
    wide = flags(rows).where(F.col("condition").isin(names)).groupBy("model_label", "question_id").pivot("condition", names).agg(F.max(F.col("correct").cast("double"))).dropna()
    return hash_bootstrap(wide.select("model_label", "question_id", (F.col(minuend) - F.col(subtrahend)).alias("v")), "model_label", "v", "question_id")


def hash_bootstrap(df: DataFrame, key: str, value: str, order: str, n_boot: int = 200, alpha: float = 0.05, seed: int = 0, block: int = 16_384, parts: int = 10) -> DataFrame:
    """As ``bootstrap`` for one key, with draws from MD5 in place of a generator: slower, and the same in any SQL engine.

    Values travel in blocks, once for each of ``parts`` ranges of resamples; no row is made for a draw. A range is one task's work, which holds the values of its key.
    """
    kind, step = df.schema[key].dataType.simpleString(), -(-n_boot // parts)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = df.where(F.col(key).isNotNull()).select(key, place.alias("i"), F.col(value).cast("double").alias("v"))
    blocks = numbered.groupBy(key, F.floor(F.col("i") / block).alias("at")).agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("v"))
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # a number of partitions of its own: small ones would be put together by their bytes, which say nothing of the draws
    dealt = dealt.repartition(8 * parts, key, "part")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        first = t.column("part")[0].as_py() * step
        v = pc.list_flatten(t.column("v")).combine_chunks()
        known = v.is_valid().to_numpy(zero_copy_only=False) if v.null_count else None
        v = v.fill_null(0.0).to_numpy(zero_copy_only=False)
        n, mine = len(v), range(first, min(first + step, n_boot))
        total, any_known = dict.fromkeys(mine, 0.0), dict.fromkeys(mine, known is None)
        for b, x in draws(seed, mine, n):
            x %= np.uint32(n)
            total[b] += v[x].sum()
            any_known[b] = any_known[b] or known[x].any()
        means = [float(total[b] / n) if any_known[b] else None for b in mine]
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(mine), t.schema.field(key).type), "m": pa.array(means, pa.float64())})

    means = dealt.groupBy(key, "part").applyInArrow(run, f"`{key}` {kind}, m double")
    return means.groupBy(key).agg(F.percentile("m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_high"))
