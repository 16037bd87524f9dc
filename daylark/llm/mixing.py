"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). The cells' weights are raked in turn to
each margin's target shares until all margins fit; the ratio of raked to actual tokens, times the
token budget, is the sampling probability of the cell's documents. A cell can give no more than it
has: cells at probability 1 are held there and the others raked to what is left of the margins. A
value that asks for more tokens than it has gives all of them, and the others of its margin share
the rest in proportion to their targets; ``reached_margins`` shows asked and reached shares.
A document is sampled when a hash of its id falls below its probability, so repeated runs agree.

Targets are shares per value. A margin without given targets gets its own token shares raised to
``temperature`` and normalised, which lifts small values over large ones. Values that a given target
leaves out share what it leaves over in proportion to their tokens.

The table of cells is counted first. Up to ``CELLS`` of them (a few MB; the driver holds nothing else) are
raked as arrays in the driver, more by ``rake`` and its companions in Spark jobs; both give the same shares.

Defined cases: null source, language or topic count as the value "". A null text counts as empty: it
has 0 tokens. Documents of cells without tokens get the plain rate. Null ids are hashed by text.
Repeated rows are decided alike. An empty table gives an empty result. Extra columns pass through
``sample_mixture`` unchanged, whatever their names. Margins that contradict each other (cells that
don't exist) stop after ``most_sweeps``.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import BROADCAST_ROWS, small_side, stored

TEMPERATURE, BUDGET, SEED = 0.7, 0.6, 17
MOST_SWEEPS, TOLERANCE = 40, 1e-6
MARGINS = ("source", "lang", "topic")
#: Most cells that are raked as arrays.
CELLS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def genre(text: Column, n_tokens: Column) -> Column:
    """The topic where no topic column is given: the kind of text by layout and length."""
    text = F.coalesce(text, F.lit(""))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(5 * bars > n_tokens, F.lit("table"))
        .when(n_tokens < 100, F.lit("note"))
        .when(n_tokens < 600, F.lit("article"))
        .otherwise(F.lit("long"))
    )


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> DataFrame:
    """``row`` (the whole input row) with id, margins, token count and a uniform hash value."""
    text = F.col(f"row.{text_col}")
    key = F.when(F.col(f"row.{id_col}").isNull(), F.xxhash64(text, F.lit(SEED))).otherwise(
        F.xxhash64(F.col(f"row.{id_col}"), F.lit(SEED))
    )
    known = docs.select(F.struct("*").alias("row")).withColumn("n_tokens", word_count(text))
    topic = F.col(f"row.{topic_col}") if topic_col else genre(text, F.col("n_tokens"))
    return known.select(
        "row",
        F.col(f"row.{id_col}").alias("id"),
        F.coalesce(F.col(f"row.{source_col}").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"row.{lang_col}").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic.cast("string"), F.lit("")).alias("topic"),
        "n_tokens",
        (F.pmod(key, F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("u"),
    )


def target_shares(cells: DataFrame, margin: str, given: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(margin, share) for each value that occurs with tokens; shares sum to 1."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if given is None:
        raw = own.withColumn("raw", F.pow("tokens", F.lit(float(temperature))))
    else:
        fixed = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.lit(None).cast("map<string,double>")
        named = own.withColumn("fixed", fixed[F.col(margin)])
        rest = named.where("fixed is null").agg(F.sum("tokens")).first()[0]
        left = max(0.0, 1.0 - sum(given.values()))
        raw = named.withColumn("raw", F.coalesce("fixed", F.col("tokens") * F.lit(left / rest if rest else 0.0)))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return stored(raw.select(margin, (F.col("raw") / F.lit(total)).alias("share")), "targets")


def within_reach(cells: DataFrame, margin: str, target: DataFrame, budget: float) -> DataFrame:
    """(margin, share): ``target`` where a value has the tokens it asks for; else all it has, and the others share the rest."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).join(target, margin)
    total = own.agg(F.sum("tokens")).first()[0] or 1
    asked = stored(own.withColumn("ratio", F.col("share") * F.lit(float(total)) / F.col("tokens")), "asked")
    kept = F.least(F.lit(1.0), F.col("ratio") * F.lit(budget_factor(asked, budget)))
    return stored(asked.select(margin, (kept * F.col("tokens") / F.lit(budget * total)).alias("share")), "targets")


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], most_sweeps: int = MOST_SWEEPS, tolerance: float = TOLERANCE, budget: float | None = None
) -> DataFrame:
    """``cells`` (margins, tokens > 0) with ``share``, whose margins fit the targets.

    With a ``budget`` a cell gives at most its tokens: the margins of ``share`` or, if less, of all the
    cell has, fit the targets. In each step the full cells are held and the others fill the margin.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("share", F.lit(0.0))
    sides = {m: (small_side(t), t.count() <= BROADCAST_ROWS) for m, t in targets.items()}
    now = cells.withColumn("share", F.col("tokens") / F.lit(total))
    most = F.col("tokens") / F.lit(total * budget) if budget else F.lit(float("inf"))
    given, full = F.least("share", most), F.col("share") >= most
    for _ in range(most_sweeps):
        for margin, (target, small) in sides.items():
            sums = now.groupBy(margin).agg(
                F.sum(given).alias("sum"), F.sum(F.when(full, most).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("free")
            )
            plain = F.col("want") / F.nullif("sum", F.lit(0.0))
            filled = (F.col("want") - F.col("held")) / F.nullif("free", F.lit(0.0))
            # the margin is concave in its scale: filling never passes the goal, but from far above it may fall to nothing
            fit = F.when(F.col("free") <= 1e-12 * F.col("sum"), F.least(F.lit(1.0), plain)).when(filled >= plain / 2, filled).otherwise(plain)
            scale = sums.join(target.withColumnRenamed("share", "want"), margin).select(margin, fit.alias("scale"))
            now = now.join(F.broadcast(scale) if small else scale, margin)
            now = now.withColumn("share", F.col("share") * F.coalesce("scale", F.lit(0.0))).drop("scale")
        now = stored(now, "raked")
        gaps = [
            now.groupBy(m).agg(F.sum(given).alias("sum")).join(t.withColumnRenamed("share", "want"), m)
            .agg(F.max(F.abs(F.col("sum") - F.col("want"))).alias("gap"))
            for m, (t, _) in sides.items()
        ]
        gap = gaps[0].unionAll(gaps[1]).unionAll(gaps[2]) if len(gaps) == 3 else gaps[0]
        if (gap.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return now


def budget_factor(cells: DataFrame, budget: float, most_steps: int = 60) -> float:
    """The factor f with sum(tokens * min(1, f * ratio)) = budget * sum(tokens), by Newton steps from below."""
    total, asked, least = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("ratio")), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    if not total or not asked:
        return 1.0
    if budget >= 1:
        return 1 / least
    factor = budget * total / asked
    for _ in range(most_steps):
        full = F.col("ratio") * F.lit(factor) >= 1
        held, free = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("ratio")))).first()
        if not free or (budget * total - held) / free <= factor * (1 + 1e-12):
            break
        factor = (budget * total - held) / free
    return factor


def reached_margins(rows: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """(margin, value, asked, reached): shares of the tokens that ``mixture``'s rows keep in expectation."""
    kept = F.col("n_tokens") * F.col("probability")
    cells = stored(rows.groupBy(*MARGINS).agg(F.sum(kept).alias("kept")), "reached")
    total = cells.agg(F.sum("kept")).first()[0] or 1.0
    parts = [
        target.join(cells.groupBy(m).agg((F.sum("kept") / F.lit(total)).alias("reached")), m, "left")
        .select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col("share").alias("asked"), F.coalesce("reached", F.lit(0.0)).alias("reached"))
        for m, target in targets.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def small_rates(cells: pa.Table, targets: Mapping[str, Mapping[str, float]], temperature: float, budget: float) -> pa.Table:
    """(margins, weight, probability) of at most ``CELLS`` cells, by the same steps as ``large_rates``."""
    tokens = cells["tokens"].to_numpy().astype(np.float64)
    full = np.flatnonzero(tokens > 0)
    own, total = tokens[full], tokens.sum()
    codes, wants = [], []
    for m in MARGINS:
        values, code = np.unique(np.array(cells[m].to_pylist(), object)[full], return_inverse=True)
        have = np.bincount(code, own, len(values))
        given = targets.get(m)
        if given is None:
            asked = have**temperature
        else:
            fixed = np.array([given.get(v, np.nan) for v in values], np.float64)
            rest = have[np.isnan(fixed)].sum()
            asked = np.where(np.isnan(fixed), have * (max(0.0, 1.0 - sum(given.values())) / rest if rest else 0.0), fixed)
        ratio = asked / (asked.sum() or 1.0) * total / np.maximum(have, 1)
        codes.append(code)
        wants.append(np.minimum(1.0, ratio * array_factor(have, ratio, budget)) * have / (budget * total or 1.0))
    share, most = own / (total or 1.0), own / (total * budget or 1.0)
    for _ in range(MOST_SWEEPS if len(full) else 0):
        for code, want in zip(codes, wants):
            held = share >= most
            fixed = np.bincount(code, np.where(held, most, 0.0), len(want))
            free = np.bincount(code, np.where(held, 0.0, share), len(want))
            sums = fixed + free
            with np.errstate(divide="ignore", invalid="ignore"):
                plain, filled = want / sums, (want - fixed) / free
            fit = np.where(free <= 1e-12 * sums, np.minimum(1.0, plain), np.where(filled >= plain / 2, filled, plain))
            share = share * np.where(sums > 0, fit, 0.0)[code]
        given = np.minimum(share, most)
        if max(np.abs(np.bincount(c, given, len(w)) - w).max() for c, w in zip(codes, wants)) <= TOLERANCE:
            break
    ratio = np.ones(len(tokens))
    ratio[full] = share * total / own
    factor = array_factor(own, ratio[full], budget)
    made = [pa.array(np.minimum(ratio, 1.0 / budget)), pa.array(np.minimum(1.0, ratio * factor))]
    return pa.Table.from_arrays([*(cells[m] for m in MARGINS), *made], names=[*MARGINS, "weight", "probability"])


def array_factor(tokens: np.ndarray, ratio: np.ndarray, budget: float, most_steps: int = 60) -> float:
    """``budget_factor`` of arrays."""
    total, asked = tokens.sum(), (tokens * ratio).sum()
    if not total or not asked:
        return 1.0
    if budget >= 1:
        return 1 / ratio[ratio > 0].min()
    factor = budget * total / asked
    for _ in range(most_steps):
        full = ratio * factor >= 1
        held, free = tokens[full].sum(), (tokens * ratio)[~full].sum()
        if not free or (budget * total - held) / free <= factor * (1 + 1e-12):
            break
        factor = (budget * total - held) / free
    return factor


def large_rates(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], temperature: float, budget: float) -> DataFrame:
    """(margins, weight, probability) of any number of cells."""
    full = cells.where("tokens > 0")
    shares = {m: target_shares(full, m, targets.get(m), temperature) for m in MARGINS}
    raked = rake(full, {m: within_reach(full, m, t, budget) for m, t in shares.items()}, budget=budget)
    total = full.agg(F.sum("tokens")).first()[0] or 1
    ratio = F.when(F.col("tokens") > 0, F.col("share") * F.lit(float(total)) / F.col("tokens"))
    rated = stored(cells.join(raked.select(*MARGINS, "share"), list(MARGINS), "left").withColumn("ratio", F.coalesce(ratio, F.lit(1.0))), "rated")
    factor = budget_factor(rated.where("tokens > 0"), budget)
    return rated.select(
        *MARGINS, F.least(F.col("ratio"), F.lit(1.0 / budget)).alias("weight"), F.least(F.lit(1.0), F.col("ratio") * F.lit(factor)).alias("probability")
    )


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    budget: float = BUDGET,
) -> DataFrame:
    """Each row as ``row`` with its margins, tokens, ``weight``, ``probability`` and ``sampled``.

    ``weight`` is the target share of tokens of the row's cell over its actual share, at most 1 / ``budget``.
    """
    known = described(docs, id_col, text_col, source_col, lang_col, topic_col)
    cells = stored(known.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() <= CELLS:
        rates = F.broadcast(docs.sparkSession.createDataFrame(small_rates(cells.toArrow(), targets or {}, temperature, budget)))
    else:
        rates = small_side(large_rates(cells, targets or {}, temperature, budget))
    return known.join(rates, list(MARGINS)).withColumn("sampled", F.col("u") < F.col("probability"))


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    return mixture(docs, **options).where("sampled").select("row.*")
