"""Evidence metrics, failure classes, costs, accuracy, agreement, quotas and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_metrics(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, recall, precision, wrong_doc from questions (qid, doc_ids, evidence array of (doc_id, page)) and retrieved rows (qid, doc_id, page, kind).

    Sets of pages; summaries don't count. recall is null without gold, precision and wrong_doc without retrieved pages.
    """
    gold = questions.select("qid", F.explode("evidence").alias("e")).select("qid", "e.doc_id", "e.page").distinct().withColumn("gold", F.lit(1))
    got = evidence.filter("kind <> 'summary'").select("qid", "doc_id", "page").distinct().withColumn("got", F.lit(1))
    both = gold.join(got, ["qid", "doc_id", "page"], "full")
    own = questions.select("qid", F.explode("doc_ids").alias("doc_id")).distinct().withColumn("own", F.lit(1))
    both = both.join(own, ["qid", "doc_id"], "left")
    counts = both.groupBy("qid").agg(F.count("gold").alias("g"), F.count("got").alias("r"), F.sum(F.when(F.col("gold").isNotNull() & F.col("got").isNotNull(), 1).otherwise(0)).alias("h"), F.count(F.when(F.col("got").isNotNull(), F.col("own"))).alias("o"))
    rows = questions.select("qid").join(counts, "qid", "left").fillna(0, ["g", "r", "h", "o"])
    return rows.select("qid", F.when(F.col("g") > 0, F.col("h") / F.col("g")).alias("recall"), F.when(F.col("r") > 0, F.col("h") / F.col("r")).alias("precision"), F.when(F.col("r") > 0, F.col("o") == 0).alias("wrong_doc"))


def failure_class(correct: Column, prior: Column, recall: Column, wrong_doc: Column, parse_failure: Column) -> Column:
    """Why a wrong answer is wrong; an earlier failure or a right answer keeps what it has."""
    return (
        F.when(~correct.eqNullSafe(F.lit(False)) | (F.coalesce(prior, F.lit("")) != ""), prior)
        .when(wrong_doc, F.lit("wrong_doc"))
        .when(parse_failure, F.lit("parse_failure"))
        .when(F.coalesce(recall, F.lit(0.0)) == 0, F.lit("wrong_page"))
        .otherwise(F.lit("right_evidence_wrong_answer"))
    )


def ledger(calls: DataFrame, prices: DataFrame, *by: str) -> DataFrame:
    """Totals of calls (model, input_tokens, output_tokens, latency_s, local, parallel_group) per `by`.

    sequential: calls of no group, and groups. gpu_s: latency of local calls, null if none. cost_usd:
    other calls' tokens by prices (model, input_per_m, output_per_m), null if none; a missing price raises.
    """
    priced = calls.join(F.broadcast(prices) if prices.limit(10_001).count() <= 10_000 else prices, "model", "left")
    api = ~F.col("local")
    cost = (F.col("input_tokens") * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m")) / F.lit(1e6)
    known = F.when(api, F.when(F.col("input_per_m").isNull(), F.raise_error(F.concat(F.lit("no price for "), "model")).cast("double")).otherwise(cost))
    return priced.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("latency_s").alias("latency_s"),
        (F.count_if(F.col("parallel_group").isNull()) + F.count_distinct("parallel_group")).alias("sequential"),
        F.sum(F.when(F.col("local"), F.col("latency_s"))).alias("gpu_s"), F.sum(known).alias("cost_usd"),
    )


def plus(a: Column, b: Column) -> Column:
    """a + b, where null is nothing unless both are."""
    return F.coalesce(a + b, a, b)


def amortised(rows: DataFrame, index: DataFrame, n_questions: int, *by: str) -> DataFrame:
    """rows with index costs shared by all questions: tokens floor-divided, seconds and money divided, missing ones left out."""
    out = rows.join(index.select(*by, F.col("input_tokens").alias("__i"), F.col("output_tokens").alias("__o"), F.col("gpu_s").alias("__g"), F.col("cost_usd").alias("__c")), list(by), "left")
    tokens = F.expr(f"(coalesce(__i, 0) + coalesce(__o, 0)) div {n_questions}")
    return out.withColumns({"tokens_index_amortised": tokens, "gpu_s": plus(F.col("gpu_s"), F.col("__g") / n_questions), "cost_usd": plus(F.col("cost_usd"), F.col("__c") / n_questions)}).drop("__i", "__o", "__g", "__c")


def accuracy(runs: DataFrame, *by: str) -> DataFrame:
    """Share of right answers among judged rows, their number, and rows in error."""
    return runs.groupBy(*by).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count("correct").alias("n"), F.count_if(F.col("failure") == "error").alias("errors"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two 0/1 columns over rows where both are given; no rows give null."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"))
    one = rows.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(pe == 1, F.when(F.col("po") == 1, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise((F.col("po") - pe) / (1 - pe))
    return one.select("n", F.col("po").alias("agreement"), kappa.alias("kappa"), ((kappa >= 0.7) & (F.col("n") >= 100)).alias("passes"))


def quota(questions: DataFrame, regimes: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """qtype by regime counts of different questions (pair_id else qid; the first by qid stays)."""
    key = F.coalesce("pair_id", "qid")
    one = questions.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("qid"))).filter("nth = 1")
    return one.filter(F.col("regime").isin(*regimes)).groupBy("qtype").pivot("regime", list(regimes)).count().fillna(0).withColumn("total", sum((F.col(r) for r in regimes), F.lit(0)))


def quota_failures(questions: DataFrame, test: int = 150, share: float = 0.1) -> DataFrame:
    """Per regime: n, n_test, unanswerable share, and whether both thresholds are met."""
    key = F.coalesce("pair_id", "qid")
    one = questions.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("qid"))).filter("nth = 1")
    out = one.groupBy("regime").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("n_test"), F.avg((F.col("qtype") == "unanswerable").cast("double")).alias("unanswerable"))
    return out.withColumn("passes", (F.col("n_test") >= test) & (F.col("unanswerable") >= share))


def bootstrap(scores: DataFrame, key: str, value: str, n: int = 1000, seed: int = 7) -> DataFrame:
    """sample, mean: means over n resamples in which each row has a Poisson(1) weight drawn from a hash of key and sample."""
    from ..functions.hashing import uniform

    u = uniform(seed, F.col("sample"), F.col(key))
    # the cumulative Poisson(1) probabilities up to 8, beyond which the remainder is below 1e-6
    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    rows = scores.select(key, value).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.withColumn("w", weight).groupBy("sample").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def clustered_bootstrap(rows: DataFrame, cluster: str, key: str, value: str, n: int = 10_000, seed: int = 7, size: int = 250) -> DataFrame:
    """One row: mean of value, n_clusters, n_rows, and the 2.5 and 97.5 percentiles of n means by two-level resampling.

    A draw gives each cluster a Poisson(1) weight, and each row one of its own within it, both from
    hashes, so reruns agree. A row counts in a draw with the product of the two, which needs nothing
    but the row itself, so rows are weighted where they are read, `size` draws at a time, and two
    sums a draw and task are all that is shuffled.
    """
    from ..functions.hashing import uniform

    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1

    def weight(u):
        out = F.when(u < steps[0], 0)
        for i, s in enumerate(steps[1:], 1):
            out = out.when(u < s, i)
        return out.otherwise(len(steps))

    base = rows.filter(F.col(value).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.col(key).alias("k"), F.col(value).cast("double").alias("x"))
    draws = rows.sparkSession.range(-(-n // size)).select((F.col("id") * size + 1).cast("int").alias("low"), F.least(F.lit(n), (F.col("id") + 1) * size).cast("int").alias("high"))
    # the chunks of draws are a few rows
    each = base.crossJoin(F.broadcast(draws)).withColumn("d", F.explode(F.sequence("low", "high")))
    outer = each.withColumn("u", uniform(seed, F.lit("cluster"), F.col("d"), F.col("c"))).filter(F.col("u") >= steps[0])
    both = outer.withColumn("t", uniform(seed, F.lit("row"), F.col("d"), F.col("k"))).filter(F.col("t") >= steps[0]).select("d", "x", (weight(F.col("u")) * weight(F.col("t"))).cast("double").alias("w"))
    means = both.groupBy("d").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    spread = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return base.agg(F.avg("x").alias("mean"), F.count_distinct("c").alias("n_clusters"), F.count("*").alias("n_rows")).crossJoin(spread)
