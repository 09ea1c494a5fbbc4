"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells until each dimension's shares meet its
target, round by round, and gives each cell a weight for its tokens. A document is then kept with the probability
min(1, scale * weight), with the scale that makes the expected number of kept tokens a given share of all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.rules import WORD_GAP

#: Raking ends when no marginal share is further than TOLERANCE from its target, or after so many rounds.
ROUNDS, TOLERANCE = 200, 1e-9
#: Exponent on natural shares where no target is given: under 1 raises small categories and lowers large ones.
SMOOTHING = 0.7
#: Share of all tokens expected to be kept.
KEEP = 0.9
#: Cells up to which raking runs on the collected cell table; beyond that the same steps run as Spark jobs.
CELLS = 100_000


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_GAP), "")).cast("long")


def topic_of(text: Column) -> Column:
    """For tables without a topic: the text's form, by how dense its marks are. Null and empty texts are prose."""
    n = F.length(text)
    dense = lambda mark, times: times * (n - F.length(F.replace(text, F.lit(mark)))) > n
    return F.when(dense("|", 40), "table").when(dense("@", 400), "contact").when(dense("!", 100), "exclaimed").otherwise("prose")


def _targets(shares: pd.Series, given: dict | None, smoothing: float) -> pd.Series:
    """Target shares by category. Categories that ``given`` leaves out divide what it leaves in their natural proportion."""
    if given is None:
        t = shares**smoothing
        return t / t.sum()
    named = pd.Series([float(given.get(c, np.nan)) for c in shares.index], shares.index)
    open_, rest = named.isna(), max(0.0, 1.0 - named.sum())
    named[open_] = rest * shares[open_] / max(shares[open_].sum(), 1e-300)
    return named / named.sum()


def _scale(wanted: float, sums: Callable[[float | None], tuple[float, float, int]]) -> float:
    """The scale at which min(1, scale * weight) keeps the wanted tokens, by filling up the heaviest cells.

    ``sums`` gives, for a scale, the tokens of cells that it fills, the weighted tokens of the others, and how many are
    full. A cell that is full stays full as the scale rises, so a few steps settle which ones are.
    """
    full, rest, n = sums(None)
    while rest > 0:
        scale = (wanted - full) / rest
        full, rest, now = sums(scale)
        if now == n:
            return scale
        n = now
    return float("inf")


def _rake(cells: pd.DataFrame, dims: list[str], targets: dict, rounds: int, tolerance: float, smoothing: float, keep: float) -> pd.DataFrame:
    tokens = cells["tokens"].to_numpy(float)
    codes = {d: pd.factorize(cells[d], use_na_sentinel=False) for d in dims}
    natural = tokens / tokens.sum()
    w = natural.copy()
    goals = {d: _targets(pd.Series(np.bincount(code, natural), names), targets.get(d), smoothing).to_numpy() for d, (code, names) in codes.items()}
    for _ in range(rounds):
        error = 0.0
        for d, (code, names) in codes.items():
            now = np.bincount(code, w, len(names))
            error = max(error, float(np.abs(now - goals[d]).max()))
            w = w * np.divide(goals[d], now, out=np.zeros_like(now), where=now > 0)[code]
        if error <= tolerance:
            break
    weight = np.divide(w, natural, out=np.zeros_like(w), where=natural > 0)

    def sums(scale):
        full = weight * scale >= 1 if scale is not None else np.zeros(len(weight), dtype=bool)
        return tokens[full].sum(), (weight * tokens)[~full].sum(), int(full.sum())

    scale = _scale(keep * tokens.sum(), sums)
    probability = np.minimum(1.0, np.where(weight > 0, weight * min(scale, 1e300), 0.0))
    return cells.assign(weight=weight, probability=np.where(tokens == 0, 1.0, probability))


def _rake_in_spark(cells: DataFrame, dims: list[str], targets: dict, rounds: int, tolerance: float, smoothing: float, keep: float) -> DataFrame:
    """The same for cell tables of any size: each fit is a grouped sum joined back, written out once a round."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if total == 0:
        return cells.select(*dims, "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    cells = cells.withColumn("natural", F.col("tokens") / F.lit(total)).withColumn("w", F.col("natural"))
    goals = {}
    for d in dims:
        shares = cells.groupBy(d).agg(F.sum("natural").alias("share"))
        if targets.get(d) is None:
            goal = shares.select(d, F.pow("share", F.lit(smoothing)).alias("goal"))
        else:
            named = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], "k string, named double")
            both = materialize(shares.join(named, F.col(d).cast("string").eqNullSafe(F.col("k")), "left"))
            given, free = both.agg(F.coalesce(F.sum("named"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("share"))), F.lit(0.0))).first()
            goal = both.select(d, F.coalesce("named", F.col("share") * F.lit(max(0.0, 1.0 - given) / max(free, 1e-300))).alias("goal"))
        mass = goal.agg(F.sum("goal")).first()[0]
        goals[d] = materialize(goal.select(F.col(d).alias("_k"), (F.col("goal") / F.lit(mass)).alias("goal")))
    for _ in range(rounds):
        error = 0.0
        for d in dims:
            now = materialize(cells.groupBy(F.col(d).alias("_n")).agg(F.sum("w").alias("now")).join(goals[d], F.col("_n").eqNullSafe(F.col("_k"))).select("_n", "now", "goal"))
            error = max(error, now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0])
            by = now.select("_n", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("by"))
            cells = cells.join(by, F.col(d).eqNullSafe(F.col("_n"))).withColumn("w", F.col("w") * F.col("by")).drop("_n", "by")
        cells = materialize(cells)
        if error <= tolerance:
            break
    cells = materialize(cells.withColumn("weight", F.when(F.col("natural") > 0, F.col("w") / F.col("natural")).otherwise(0.0)))

    def sums(scale):
        full = F.col("weight") * F.lit(scale) >= 1 if scale is not None else F.lit(False)
        none = F.lit(0.0)
        return cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens").cast("double"))), none), F.coalesce(F.sum(F.when(~full, F.col("weight") * F.col("tokens"))), none), F.count_if(full)).first()

    scale = min(_scale(keep * total, sums), 1e300)
    probability = F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    return cells.select(*dims, "tokens", "weight", probability.alias("probability"))


def cell_probabilities(cells: DataFrame, dims: list[str], targets: dict | None = None, keep: float = KEEP, rounds: int = ROUNDS, tolerance: float = TOLERANCE, smoothing: float = SMOOTHING, max_cells: int = CELLS) -> DataFrame:
    """(dims, tokens, weight, probability) for each cell of (dims, tokens). Cells without tokens have weight 0 and are kept.

    ``targets``: for each dimension its shares by category, or none for smoothed natural shares; categories that are not
    named divide the rest in their natural proportion. A null category is one like any other. No cells give no rows.
    Targets that no weights can meet (a category whose cells hold no tokens) leave an error: see ``marginals``.
    """
    spark = cells.sparkSession
    written = materialize(cells.select(*dims, "tokens"))
    settings = (dims, targets or {}, rounds, tolerance, smoothing, keep)
    if written.limit(max_cells + 1).count() > max_cells:
        return materialize(_rake_in_spark(written, *settings))
    held = written.toPandas()
    held = _rake(held, *settings) if held["tokens"].sum() > 0 else held.assign(weight=0.0, probability=1.0)
    schema = written.schema.add("weight", "double").add("probability", "double")
    rows = held.astype(object).where(held.notna(), None).values.tolist()
    # max_cells bounds this table's size, so that documents need not be dealt out to meet it.
    return F.broadcast(spark.createDataFrame([tuple(int(v) if i == len(dims) else v for i, v in enumerate(r)) for r in rows], schema))


def marginals(cells: DataFrame, dims: list[str], targets: dict | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """(dim, category, natural, share, target) of raked cells: what weights make of each category, beside its target.

    ``target`` is null for categories that ``targets`` does not name; with no targets for a dimension it is the smoothed share.
    """
    total = cells.agg(F.sum("tokens").alias("_t"), F.sum(F.col("tokens") * F.col("weight")).alias("_m"))
    out = None
    for d in dims:
        by = cells.groupBy(F.col(d).cast("string").alias("category")).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("m")).crossJoin(total)
        by = by.select(F.lit(d).alias("dim"), "category", (F.col("t") / F.col("_t")).alias("natural"), (F.col("m") / F.col("_m")).alias("share"))
        given = (targets or {}).get(d)
        if given is None:
            mass = by.agg(F.sum(F.pow("natural", F.lit(smoothing))).alias("_s"))
            by = by.crossJoin(mass).withColumn("target", F.pow("natural", F.lit(smoothing)) / F.col("_s")).drop("_s")
        else:
            named = F.lit(None).cast("double")
            for k, v in given.items():
                named = F.when(F.col("category").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(named)
            by = by.withColumn("target", named)
        out = by if out is None else out.union(by)
    return out


def draw(id_col: Column, text: Column | None = None, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id alone: the same on every run, and for rows with equal ids. Rows without an id draw by
    their text, where it is given."""
    none = F.lit("null") if text is None else F.concat(F.lit("null:"), F.coalesce(F.md5(text), F.lit("")))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), none))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_cell(docs: DataFrame, topic: Column, source_col: str, lang_col: str) -> list[Column]:
    return [F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang"), topic.alias("_topic")]


DIMS = ["_source", "_lang", "_topic"]


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: str = "mix", **more) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, kept): one row for each row of docs.

    Null texts have no words; rows of a null source or language are a category of their own. Rows with equal ids are
    drawn alike where their cells' probabilities are; rows without an id by their text. An empty table gives no rows.
    """
    topic = topic if topic is not None else topic_of(F.col(text_col).cast("string"))
    number = draw(F.col(id_col), F.col(text_col).cast("string"), seed)
    rows = materialize(docs.select(F.col(id_col).alias("id"), *_with_cell(docs, topic, source_col, lang_col), n_words(F.col(text_col)).alias("n_tokens"), number.alias("drawn")))
    cells = cell_probabilities(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), DIMS, **more)
    named = cells.select(*[F.col(d).alias(f"c{d}") for d in DIMS], "weight", "probability")
    same = [rows[d].eqNullSafe(named[f"c{d}"]) for d in DIMS]
    joined = rows.join(named, same[0] & same[1] & same[2])
    return joined.select("id", *[F.col(d).alias(d[1:]) for d in DIMS], "n_tokens", "weight", "probability", (F.col("drawn") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: str = "mix", **more) -> DataFrame:
    """The rows of docs, all columns kept, that the draw keeps."""
    topic = topic if topic is not None else topic_of(F.col(text_col).cast("string"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_with_cell(docs, topic, source_col, lang_col), draw(F.col(id_col), F.col(text_col).cast("string"), seed).alias("_drawn"))
    counts = docs.select(*_with_cell(docs, topic, source_col, lang_col), n_words(F.col(text_col)).alias("n"))
    cells = cell_probabilities(counts.groupBy(*DIMS).agg(F.sum("n").alias("tokens")), DIMS, **more)
    named = cells.select(*[F.col(d).alias(f"c{d}") for d in DIMS], "probability")
    same = [keyed[d].eqNullSafe(named[f"c{d}"]) for d in DIMS]
    return keyed.join(named, same[0] & same[1] & same[2]).where(F.col("_drawn") < F.col("probability")).select("_row.*")
