"""Texts cut off by field limits or in transfer.

Method: per source, lengths follow a log-normal law whose upper end is censored at the source's own limit. The law is fitted by maximum
likelihood to the length histogram of the whole source, with the texts at the limit as right-censored observations. Candidate limits are
lengths, in characters or in UTF-8 bytes, at which texts pile up. The censoring posterior of a length is the share of the texts there
that the law explains as longer texts cut down.

It is combined with evidence of the ending. How often cut and finished texts end in each way is estimated over all texts by
expectation-maximisation: at a limit a text is cut with the censoring posterior, elsewhere with a rate of cuts in transfer that is
estimated too. So a result that ends in a digit, a full stop after a number or a line without a stop is judged by where it stands: at a
limit it may be a cut, elsewhere it is not. Endings that settle the matter (see `endings.DECIDED`) are known labels in this estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .endings import BELIEF, DECIDED, ending
from .storage import checkpointed

#: A limit that is met at a word boundary shows as a pile of this width below it.
WIDTH = 24
#: A pile has at least this many texts and this many times what its surroundings suggest.
LEAST, EXCESS = 8, 4.0
#: What BELIEF of cut and of finished texts weighs, in texts, against the counts of endings.
WORTH = np.array([40.0, 1000.0])
#: What the censoring posterior of a limit weighs, in texts, against the endings seen there.
WORTH_OF_LIMIT = 50.0
#: What the rate of cuts in transfer of all sources weighs, in texts, against that of one source.
WORTH_OF_RATE = 20.0


def source_name(column: str = "source"):
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))), F.lit(""))


def text_endings(reasoning: DataFrame) -> DataFrame:
    """(reasoning_id, source, chars, bytes, kind): length and kind of ending of every text.

    Checkpointed, as both the fit of the limits and the scores read these short rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("reasoning").to_pylist()
            chars = pa.array([0 if t is None else len(t) for t in texts], pa.int32())
            size = pa.array([0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("reasoning_id"), batch.column("source"), chars, size, pa.array([ending(t) for t in texts], pa.string())],
                names=["reasoning_id", "source", "chars", "bytes", "kind"],
            )

    rows = reasoning.select(F.col("reasoning_id").cast("long").alias("reasoning_id"), source_name().alias("source"), F.col("reasoning").cast("string").alias("reasoning"))
    return checkpointed(rows.mapInArrow(run, "reasoning_id long, source string, chars int, bytes int, kind string"))


def censored_lognormal(lengths: np.ndarray, counts: np.ndarray, limit: float, censored: float) -> tuple[float, float]:
    """Maximum-likelihood (mu, sigma) of log-lengths with `censored` observations known to exceed limit (EM)."""
    x, n = np.log(lengths.astype(float)), counts.astype(float)
    total = n.sum() + censored
    mu = float((x * n).sum() / n.sum())
    sigma = max(math.sqrt(float(((x - mu) ** 2 * n).sum() / n.sum())), 1e-3)
    if not censored or not math.isfinite(limit):
        return mu, sigma
    top = math.log(limit)
    for _ in range(200):
        z = (top - mu) / sigma
        upper = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / upper
        first = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * (top + mu) * hazard
        new_mu = float(((x * n).sum() + censored * first) / total)
        new_sigma = math.sqrt(max(float(((x * x * n).sum() + censored * second) / total) - new_mu * new_mu, 1e-6))
        moved = abs(new_mu - mu) + abs(new_sigma - sigma)
        mu, sigma = new_mu, new_sigma
        if moved < 1e-9:
            break
    return mu, sigma


def _tail(x: float, mu: float, sigma: float) -> float:
    return 0.5 * math.erfc((math.log(max(x, 1e-9)) - mu) / sigma / math.sqrt(2))


def limits_of(histogram: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram (source, unit, length, texts, cut) -> its limits (source, unit, low, high, posterior, mu, sigma)."""
    source, rows = str(histogram["source"].iloc[0]), []
    for unit in ("bytes", "chars"):
        part = histogram[histogram["unit"] == unit].groupby("length", as_index=False)[["texts", "cut"]].sum().sort_values("length")
        length, texts, cut = (part[c].to_numpy(dtype=float) for c in ("length", "texts", "cut"))
        if not len(length):
            continue
        high, top = float(length[-1]), texts.sum()
        near = (length > high - WIDTH) & (length <= high)
        piles = [(high - 4, high, length > high - 4), (high - WIDTH, high, near)]
        peak = length[np.argmax(texts)]
        piles.append((peak - 1, peak, length == peak))
        for low, end, inside in piles:
            if inside.all() or texts[inside].sum() < LEAST:
                continue
            beyond = texts[length > end].sum()
            mu, sigma = censored_lognormal(length[~inside], texts[~inside], end, float(cut[inside].sum()))
            own = max(_tail(low + 1, mu, sigma) - _tail(end + 1, mu, sigma), 0) * top
            longer = max(_tail(end + 1, mu, sigma) * top - beyond, 0)
            if texts[inside].sum() > EXCESS * max(own, 1) and longer > 0:
                rows.append((source, unit, int(low), int(end), longer / (longer + own), mu, sigma))
                break
    return pd.DataFrame(rows, columns=["source", "unit", "low", "high", "posterior", "mu", "sigma"])


_LIMITS = "source string, unit string, low int, high int, posterior double, mu double, sigma double"


def source_limits(endings: DataFrame) -> DataFrame:
    """Limits of every source, from histograms over all texts; a partial count precedes the shuffle.

    A group holds one row per distinct length of a source, not its texts.
    """
    cut = F.when(F.col("kind").isin("bare", "item", *(k for k, is_cut in DECIDED.items() if is_cut)), 1).otherwise(0)
    counted = endings.where("kind <> 'nothing'").groupBy("source", "chars", "bytes").agg(F.count(F.lit(1)).alias("texts"), F.sum(cut).alias("cut"))
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    long = counted.select("source", "texts", "cut", units.alias("u")).select("source", "u.unit", "u.length", "texts", "cut")
    histogram = long.groupBy("source", "unit", "length").agg(F.sum("texts").alias("texts"), F.sum("cut").alias("cut"))
    return checkpointed(histogram.groupBy("source").applyInPandas(limits_of, _LIMITS))


def located(endings: DataFrame, limits: DataFrame) -> DataFrame:
    """endings that say something, with `prior`: the censoring posterior at a limit, null away from limits."""
    per = limits.groupBy("source").agg(*(F.max(F.when(F.col("unit") == u, F.col(c))).alias(f"{u}_{c}") for u in ("chars", "bytes") for c in ("low", "high", "posterior")))
    at = [F.when((F.col(u) > F.col(f"{u}_low")) & (F.col(u) <= F.col(f"{u}_high")), F.col(f"{u}_posterior")) for u in ("chars", "bytes")]
    prior = F.greatest(*at)
    joined = endings.where("kind <> 'nothing'").join(per, "source", "left")
    return joined.select("reasoning_id", "source", "kind", F.when(prior.isNotNull(), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(prior, 2)))).alias("prior"))


def ending_evidence(counts: pd.DataFrame) -> tuple[dict[str, float], dict[float, float], float]:
    """(log-likelihood ratio of each kind, share of cut texts by prior, rate of cuts away from limits) by expectation-maximisation.

    counts: (prior, kind, texts); a null prior means away from limits. Kinds of DECIDED are labels: their ratio is +99 or -99. The
    endings seen at limits correct the share that the fitted law expects there.
    """
    kinds = [*BELIEF, *DECIDED]
    believed = np.array([BELIEF.get(k, (0.0, 0.0)) for k in kinds])
    labels = np.array([np.nan if k in BELIEF else float(DECIDED[k]) for k in kinds])
    of = counts["kind"].map({k: i for i, k in enumerate(kinds)}).to_numpy(dtype=np.int64)
    texts, prior = counts["texts"].to_numpy(dtype=float), counts["prior"].to_numpy(dtype=float)
    away, known = np.isnan(prior), labels[of]
    levels, at = np.unique(prior[~away], return_inverse=True)
    share, rate, shares = believed + 1e-9, 0.02, levels.copy()
    for _ in range(500):
        p = np.full(len(prior), rate)
        p[~away] = shares[at]
        up, down = p * share[of, 0], (1 - p) * share[of, 1]
        cut = np.where(np.isnan(known), up / (up + down), known)
        sums = np.stack([np.bincount(of, weights=texts * w, minlength=len(kinds)) for w in (cut, 1 - cut)], axis=1) + WORTH * believed
        new = (sums + 1e-9) / (sums + 1e-9).sum(axis=0)
        new_rate = float(((texts * cut)[away].sum() + 0.4) / (texts[away].sum() + 20.0))
        held, cuts = (np.bincount(at, weights=x[~away], minlength=len(levels)) for x in (texts, texts * cut))
        new_shares = (cuts + WORTH_OF_LIMIT * levels) / (held + WORTH_OF_LIMIT)
        moved = np.abs(new - share).max() + abs(new_rate - rate) + np.abs(new_shares - shares).sum()
        share, rate, shares = new, new_rate, new_shares
        if moved < 1e-10:
            break
    ratio = np.where(np.isnan(labels), np.log(share[:, 0] / share[:, 1]), np.where(labels > 0, 99.0, -99.0))
    return dict(zip(kinds, ratio.tolist())), dict(zip(levels.tolist(), shares.tolist())), rate


def cut_scores(endings: DataFrame, limits: DataFrame) -> DataFrame:
    """(reasoning_id, source, kind, at_limit, score) of the texts that say something; score: posterior log-odds that a text is cut off.

    The counts that come to the driver have at most 100 priors and one row per kind of ending, whatever the table holds.
    """
    rows = located(endings, limits)
    counts = rows.groupBy("prior", "kind").agg(F.count(F.lit(1)).alias("texts")).toPandas()
    ratio, shares, rate = ending_evidence(counts)
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in ratio.items() for x in kv)), F.col("kind"))
    cut = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(math.log(rate / (1 - rate))) + weight)))
    own = rows.where("prior IS NULL").groupBy("source").agg(((F.sum(cut) + WORTH_OF_RATE * rate) / (F.count(F.lit(1)) + WORTH_OF_RATE)).alias("rate"))
    at_limit = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("prior")) if shares else F.lit(None).cast("double")
    prior = F.coalesce(at_limit, "rate", F.lit(rate))
    joined = rows.join(own, "source", "left")
    return joined.select("reasoning_id", "source", "kind", F.col("prior").isNotNull().alias("at_limit"), (F.log(prior / (1 - prior)) + weight).alias("score"))


def truncated(reasoning: DataFrame) -> DataFrame:
    """(reasoning_id): texts that are cut off. All rows count, also those that match no problem.

    Null, blank and placeholder texts are no case. A null source is a source of its own. Repeated texts are
    judged alike unless their lengths' priors differ. An empty table gives no rows; a null reasoning_id is left out.
    """
    endings = text_endings(reasoning)
    return cut_scores(endings, source_limits(endings)).where("score > 0 AND reasoning_id IS NOT NULL").select("reasoning_id").distinct()


def truncation_report(reasoning: DataFrame) -> DataFrame:
    """(source, texts, truncated, at_limit, share) of every source; texts that say nothing are not counted."""
    endings = text_endings(reasoning)
    scored = cut_scores(endings, source_limits(endings))
    out = scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("score") > 0).alias("truncated"), F.count_if((F.col("score") > 0) & F.col("at_limit")).alias("at_limit")
    )
    return out.withColumn("share", F.col("truncated") / F.col("texts"))
