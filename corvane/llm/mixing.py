"""Problem 7: mixing sources to target token shares by iterative proportional fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.exprs import clean_key, uniform
from corvane.llm.tokens import VOCABULARY, with_token_counts
from corvane.sources.durable import durable

#: Languages and topics told apart, those with the most documents; all else is 'other'.
LEVELS = 64
#: Documents of a source that are drawn from in one place, and offsets tried for a source.
STRATUM, OFFSETS = 100_000, 64


_ONE = 1 << 24  # sums of uses are kept in whole numbers of 2^-24, up to 2^29 uses a stratum


def _level(c, rest: str):
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(rest))


def _keys(topic: str):
    return {"lang": F.substring(_level("lang", "und"), 1, 2), "topic": _level(topic, "none")}


def levels(documents: DataFrame, topic: str = "doc_kind", most: int = LEVELS) -> dict[str, list[str]]:
    """The ``most`` languages and topics with the most documents: at most 2 x ``most`` values, whatever the corpus."""
    pairs = [F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in _keys(topic).items()]
    n = documents.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.kind", "p.value").count()
    first = Window.partitionBy("kind").orderBy(F.desc("count"), "value")
    rows = n.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).collect()
    return {k: sorted(r.value for r in rows if r.kind == k) for k in ("lang", "topic")}


def token_sizes(documents: DataFrame, topic: str = "doc_kind", vocabulary: str = VOCABULARY, most: int = LEVELS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): source is the clean key, lang the first two letters in lower case."""
    known = levels(documents, topic, most)
    keys = [F.when(c.isin(*known[k]), c).otherwise("other").alias(k) for k, c in _keys(topic).items()]
    return with_token_counts(documents.select("doc_id", clean_key("source").alias("source"), *keys, "text"), vocabulary=vocabulary)


def cells(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens and documents by (source, lang, topic). Sources that aren't mixed fall together in null,
    so there are at most (targets + 1) x 65 x 65 rows, whatever the corpus holds."""
    known = targets.select(F.col("source").alias("known"))
    s = sizes.join(F.broadcast(known), F.col("source") == F.col("known"), "left")
    return s.groupBy(F.col("known").alias("source"), "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def rake(table: pd.DataFrame, targets: pd.DataFrame, margins: dict[str, dict[str, float]] | None = None, rounds: int = 200, tol: float = 1e-9) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Expected uses by cell, and the plan by source.

    The mix has as many tokens as all rows of the corpus. Iterative proportional fitting brings the cells'
    tokens to each source's share of that, and to the shares of ``margins`` ({"lang": {value: share}, "topic":
    {...}}) among languages and topics; values not named share the rest as they do in the corpus. A cell's
    uses never exceed its source's max_uses, so a source may fall short of its share: that is read from the fitted
    tokens. The source margin is fitted last, so it holds up to ``tol`` wherever the caps allow it.
    """
    total = float(table.tokens.sum())
    plan = targets.sort_values("source").reset_index(drop=True)
    have = table.dropna(subset=["source"]).groupby("source").tokens.sum()
    plan["tokens"] = plan.source.map(have).fillna(0).astype("int64")
    plan["capacity"] = plan.tokens * plan.max_uses
    plan["wanted"] = plan.target_share * total
    c = table[table.source.isin(plan.source) & (table.tokens > 0)].reset_index(drop=True)
    cap = (c.tokens * c.source.map(plan.set_index("source").max_uses)).to_numpy(float)
    w = c.tokens.to_numpy(float)
    goals = {"source": dict(zip(plan.source, plan.wanted))}
    reach = float(np.minimum(plan.capacity, plan.wanted).sum())
    for k in ("lang", "topic"):
        g = table.groupby(k).tokens.sum().reindex(c[k].unique()).astype(float)
        named = pd.Series((margins or {}).get(k, {}), dtype=float)
        rest = g[~g.index.isin(named.index)]
        rest = rest / max(rest.sum(), 1e-300) * max(0.0, 1 - named.sum())
        goals[k] = dict(pd.concat([named[named.index.isin(g.index)], rest]) * reach)
    at = {k: {v: np.flatnonzero((c[k] == v).to_numpy()) for v in c[k].unique()} for k in goals}

    def fit(key: str) -> None:
        for value, i in at[key].items():
            goal = goals[key][value]
            for _ in range(50):  # scale what isn't at its cap
                now, free = w[i].sum(), i[w[i] < cap[i]]
                if abs(now - goal) <= tol * max(goal, 1) or (now < goal and not len(free)):
                    break
                part = free if now < goal else i
                own = w[part].sum()
                w[part] = np.minimum(w[part] * max(0.0, (goal - (now - own)) / max(own, 1e-300)), cap[part])

    for _ in range(rounds):
        before = w.copy()
        for key in ("lang", "topic", "source"):
            fit(key)
        if (np.abs(w - before) <= tol * np.maximum(before, 1)).all():
            break
    fitted = plan.source.map(pd.Series(w).groupby(c.source).sum()).fillna(0.0).astype(float)
    plan["fitted"] = fitted
    # what the fit leaves below the target by more than its tolerance is at its cap
    plan["short"] = (fitted < plan.wanted - tol * np.maximum(plan.wanted, 1)) & (plan.capacity < plan.wanted)
    return c.assign(uses=w / c.tokens.to_numpy(float)), plan


def _fitted(documents: DataFrame, targets: DataFrame, vocabulary: str, margins, keep: bool = False):
    targets = targets.where("source is not null").fillna({"target_share": 0.0, "max_uses": 0})
    sizes = token_sizes(documents, vocabulary=vocabulary)
    if keep:
        sizes = durable(sizes, "sizes")
    table = cells(sizes, targets).toPandas()  # bounded: see cells()
    return (sizes, *rake(table, targets.select("source", "target_share", "max_uses").toPandas(), margins))


def mix_uses(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, margins: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, tokens, uses), one row per row of documents that is used at least once.

    A row's expected uses u come from its cell. The rows of a source are drawn systematically from the longest to the
    shortest: with C the sum of u up to a row, it is used floor(C + r) - floor(C - u + r) times, so at most
    max_uses times, and the source's tokens are off by one long text at most. Of OFFSETS values of r, the same in
    every run, that one is taken which comes closest to the source's tokens. A source is cut by a hash of doc_id
    into strata of about STRATUM rows, so a hot one is no one task's work. Null or empty texts have no tokens
    and aren't used; rows of sources without a target aren't used; an empty table gives no rows.
    """
    spark = documents.sparkSession
    sizes, fit, plan = _fitted(documents, targets, vocabulary, margins, keep=True)
    fit["u"] = np.rint(fit.uses.to_numpy(float) * _ONE).astype("int64")
    strata = np.maximum(1, -(-fit.groupby("source").docs.sum() // STRATUM)).astype("int64")
    fit["strata"] = fit.source.map(strata).astype("int64")
    rows = spark.createDataFrame(fit[["source", "lang", "topic", "u", "strata"]], "source string, lang string, topic string, u long, strata long")
    s = sizes.where("tokens > 0").join(F.broadcast(rows), ["source", "lang", "topic"])
    s = s.withColumn("stratum", F.pmod(F.xxhash64("doc_id"), F.col("strata")))
    c = F.sum("u").over(Window.partitionBy("source", "stratum").orderBy(F.desc("tokens"), F.xxhash64("doc_id", F.lit(seed)), "doc_id", "lang", "topic").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("c", c)

    def uses(r):
        return F.floor((F.col("c") + r) / _ONE) - F.floor((F.col("c") - F.col("u") + r) / _ONE)

    tried = [int((k + 0.5) / OFFSETS * _ONE) for k in range(OFFSETS)]
    sums = s.groupBy("source").agg(*[F.sum(uses(F.lit(r)) * F.col("tokens")).alias(f"s{k}") for k, r in enumerate(tried)]).toPandas().set_index("source")
    goal = plan.set_index("source").fitted.reindex(sums.index).to_numpy(float)
    best = np.abs(sums.to_numpy(float) - goal[:, None]).argmin(axis=1) if len(sums) else []
    chosen = spark.createDataFrame([(k, tried[int(b)]) for k, b in zip(sums.index, best)], "source string, r long")
    return s.join(F.broadcast(chosen), "source").select("doc_id", "source", "tokens", uses(F.col("r")).alias("uses")).where("uses > 0")


def mix_plan(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, margins: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per source of ``targets``: tokens, capacity (tokens x max_uses), wanted, short (the fitted tokens miss
    the wanted ones), expected_tokens and expected_share after raking, max_expected_uses."""
    spark = documents.sparkSession
    _, fit, plan = _fitted(documents, targets, vocabulary, margins)
    plan = plan.rename(columns={"fitted": "expected_tokens"})
    plan["expected_share"] = plan.expected_tokens / max(plan.expected_tokens.sum(), 1e-300)
    plan["max_expected_uses"] = plan.source.map(fit.groupby("source").uses.max()).fillna(0.0).astype(float)
    cols = ["source", "target_share", "max_uses", "tokens", "capacity", "wanted", "short", "expected_tokens", "expected_share", "max_expected_uses"]
    schema = "source string, target_share double, max_uses int, tokens long, capacity long, wanted double, short boolean, expected_tokens double, expected_share double, max_expected_uses double"
    return spark.createDataFrame(plan[cols], schema)


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, margins: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, target_share, docs, uses, max_row_uses, tokens, share) of the mix as drawn."""
    used = mix_uses(documents, targets, seed, vocabulary, margins).groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("uses").alias("uses"), F.max("uses").alias("max_row_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens")
    )
    all_ = used.agg(F.sum("tokens").alias("all_tokens"))
    return (
        targets.select("source", "target_share").join(used, "source", "left").crossJoin(F.broadcast(all_))  # one row
        .select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "uses", "max_row_uses", "tokens")], (F.coalesce("tokens", F.lit(0)) / F.greatest("all_tokens", F.lit(1))).alias("share"))
    )
