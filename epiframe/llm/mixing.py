"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Tokens are summed by cell: source, language and topic. The targets of a dimension's values are weights that the caller
gives, as rows (dimension, value, weight), or else their tempered shares; either is scaled to the tokens to keep. A
value that is not among a dimension's given weights has the target 0. A value that has fewer tokens than its target gives all it has, and what it lacks goes to the
dimension's other values in the same proportions. Raking then scales the cells' weights, which are expected tokens, in
turn to the goals of sources, languages and topics, ``ROUNDS`` times or, with ``moved``, as often again while the
last round still moved more than that share of the tokens, ``MOST_ROUNDS`` times at most; no cell's weight exceeds its tokens. A document is sampled with
its cell's weight over its tokens as probability. Sampling compares a hash of the id with it, so that it repeats
exactly. ``margins`` reports target, goal and expectation of every value.

A topic is what the caller says it is: a column, for example that of ``clustered_topics``, clusters of hashed words;
by default it is the kind of text by its form.

The cells are few (sources times languages times topics) and independent of the number of documents. Up to
``ONE_TASK`` of them, counted first, are raked in one partition, where windows need no exchange; they are joined back by
broadcast if their number allows it. Everything runs as DataFrame functions.

Defined cases: null source or language is a value of its own; a null text has no tokens and the topic ``empty``; a
cell without tokens keeps its documents; a null doc_id hashes like 0; an empty table gives no rows; rows that repeat
share their fate; a text of any length is one row; weights that are negative or null are an error; extra columns stay, and columns with the names of results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_name, small_side
from .quality import words_of

TEMPER = 0.7
KEEP = 0.75
ROUNDS, MOST_ROUNDS = 16, 128
#: Documents on which clusters of topics are fitted, at most about so many, and the numbers that words are hashed to.
TOPIC_ROWS, TOPIC_FEATURES = 20_000, 1024
ONE_TASK = 1_000_000
DIMENSIONS = ("source", "lang", "topic")
RESULTS = ("topic", "n_tokens", "weight", "probability", "sampled")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A document's kind by its form: empty, tabular (cells between bars), marked (symbols), note, article or long."""
    bars = F.regexp_count(text, F.lit(r" \| "))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&<>{}\[\]=_\\]"))
    return (
        F.when(n_tokens == 0, "empty").when(bars * 10 >= n_tokens, "tabular").when(symbols * 5 >= n_tokens, "marked")
        .when(n_tokens < 100, "note").when(n_tokens < 1000, "article").otherwise("long")
    )


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from an id's digest, the same on any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id, F.lit(0)).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def goal_steps(temper: float = TEMPER, keep: float = KEEP, given: tuple[str, ...] = ()) -> list[str]:
    """SQL steps over cells(source, lang, topic, tokens), each reading the one before it as {cells}; they add goals of
    the three dimensions and a first weight. Dimensions in ``given`` have their cells' target weight in ``given_<name>``.

    A dimension's goals are the least of what a value has and a common factor times its tempered share. Values in order
    of what they have over their share are exhausted first: those before the first one for which the factor that its own
    place gives is within its means. A value's cells hold its share and its means in equal parts.
    """
    kept = ", ".join(["source, lang, topic, tokens, total", *(f"given_{d}" for d in given)])
    steps = [f"SELECT {kept.replace('total', 'CAST(SUM(tokens) OVER () AS DOUBLE) AS total')} FROM {{cells}}"]
    for d in DIMENSIONS:
        have = f"CAST(SUM(tokens) OVER (PARTITION BY {d}) AS DOUBLE)"
        share = f"given_{d}" if d in given else f"POW({have} / NULLIF(total, 0), {temper!r})"
        steps.append(f"SELECT {kept}, {have} AS have, {share} AS share, COUNT(*) OVER (PARTITION BY {d}) AS parts FROM {{cells}}")
        steps.append(f"SELECT *, ROW_NUMBER() OVER (ORDER BY have / NULLIF(share, 0) NULLS LAST, {d}, source, lang, topic) AS place FROM {{cells}}")
        used, rest = "SUM(have / parts) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "SUM(share / parts) OVER (ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        steps.append(f"SELECT *, ({keep!r} * total - COALESCE({used}, 0)) / NULLIF({rest}, 0) AS factor FROM {{cells}}")
        steps.append("SELECT *, MIN(CASE WHEN factor * share <= have THEN place END) OVER () AS cut FROM {cells}")
        steps.append(f"SELECT {kept}, LEAST(have, COALESCE(share * MAX(CASE WHEN place = cut THEN factor END) OVER (), have)) AS goal_{d} FROM {{cells}}")
        kept += f", goal_{d}"
    kept = ", ".join(["source, lang, topic, tokens, total", *(f"goal_{d}" for d in DIMENSIONS)])
    steps.append(f"SELECT {kept}, {keep!r} * tokens AS weight, 0.0E0 AS before FROM {{cells}}")
    return steps


def round_steps(rounds: int = ROUNDS) -> list[str]:
    """SQL steps of raking; ``before`` is the weight before the last round."""
    kept, steps = ", ".join(["source, lang, topic, tokens, total", *(f"goal_{d}" for d in DIMENSIONS)]), []
    for k in range(rounds):
        for d in DIMENSIONS:
            before = "weight AS before" if k == rounds - 1 and d == DIMENSIONS[0] else "before"
            steps.append(f"SELECT {kept}, LEAST(tokens, COALESCE(weight * goal_{d} / NULLIF(SUM(weight) OVER (PARTITION BY {d}), 0), 0)) AS weight, {before} FROM {{cells}}")
    return steps


#: Steps between two writes of the cells: longer plans take Spark longer to plan than to run.
STRIDE = 12


def _run(cells: DataFrame, steps: list[str], few: bool) -> DataFrame:
    for k in range(0, len(steps), STRIDE):
        cells = cells.coalesce(1) if few else cells
        for step in steps[k : k + STRIDE]:
            cells = cells.sparkSession.sql(step, cells=cells)
        cells = materialize(cells, "cells")
    return cells


def _weights(targets: DataFrame, d: str) -> DataFrame:
    """(value, given) of a dimension."""
    return targets.where(F.col("dimension") == d).groupBy(F.col("value").cast("string").alias("_value")).agg(F.sum(F.col("weight").cast("double")).alias(f"given_{d}"))


def _given(targets: DataFrame | None) -> tuple[str, ...]:
    """Dimensions that have targets."""
    if targets is None:
        return ()
    if not targets.where("weight IS NULL OR weight < 0 OR weight = double('NaN') OR dimension IS NULL").isEmpty():
        raise ValueError("targets need a dimension and a weight of at least 0")
    found = {r[0] for r in targets.select("dimension").distinct().limit(len(DIMENSIONS) + 1).collect()}
    if found - set(DIMENSIONS):
        raise ValueError(f"unknown dimension: {sorted(found - set(DIMENSIONS))}")
    return tuple(d for d in DIMENSIONS if d in found)


def rake(cells: DataFrame, temper: float = TEMPER, keep: float = KEEP, targets: DataFrame | None = None, moved: float | None = None) -> DataFrame:
    """cells with total, goals, weight and probability; ``targets`` has rows (dimension, value, weight). With ``moved``
    rounds go on until one moves at most that share of the tokens."""
    given, few = _given(targets), cells.count() <= ONE_TASK
    for d in given:
        side = materialize(_weights(targets, d), "targets")
        cells = cells.join(small_side(side), F.col(d).cast("string").eqNullSafe(F.col("_value")), "left").drop("_value").withColumn(f"given_{d}", F.coalesce(f"given_{d}", F.lit(0.0)))
    cells, done = _run(_run(cells, goal_steps(temper, keep, given), few), round_steps(), few), ROUNDS
    while moved is not None and done < MOST_ROUNDS:
        last = cells.agg(F.sum(F.abs(F.col("weight") - F.col("before"))) / F.nullif(F.max("total"), F.lit(0.0))).first()[0] or 0.0
        if last <= moved:
            break
        cells, done = _run(cells, round_steps(), few), done + ROUNDS
    return cells.drop("before").withColumn("probability", F.least(F.lit(1.0), F.coalesce(F.col("weight") / F.nullif(F.col("tokens"), F.lit(0)), F.lit(1.0))))


def margins(rated: DataFrame, temper: float = TEMPER, keep: float = KEEP, targets: DataFrame | None = None) -> DataFrame:
    """(dimension, value, tokens, target, goal, expected) of raked cells: target is the given weight, or else the tempered
    share, of the tokens to keep, goal what the value can give of it and of what others lack, expected the sum of its cells' weights."""
    parts, given = [], _given(targets)
    for d in DIMENSIONS:
        by = rated.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"goal_{d}").alias("goal"), F.sum("weight").alias("expected"), F.max("total").alias("total"))
        by = by.withColumn("share", F.pow(F.col("tokens") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(temper)))
        if d in given:
            side = small_side(materialize(_weights(targets, d), "targets"))
            by = by.join(side, F.col("value").cast("string").eqNullSafe(F.col("_value")), "left").withColumn("share", F.coalesce(f"given_{d}", F.lit(0.0)))
        shares = F.sum("share").over(Window.partitionBy("total"))  # one total: a row to each value of a dimension
        parts.append(by.select(F.lit(d).alias("dimension"), "value", "tokens", (F.lit(keep) * F.col("total") * F.col("share") / shares).alias("target"), "goal", "expected"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_topic(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with n_tokens and topic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.withColumn("n_tokens", F.size(words_of(text)).cast("long"))
    return counted.withColumn("topic", topic_of(text, F.col("n_tokens")) if topic is None else topic.cast("string"))


def clustered_topics(docs: DataFrame, k: int, rows: int = TOPIC_ROWS, features: int = TOPIC_FEATURES, seed: int = 0) -> DataFrame:
    """docs with topic: one of k clusters (``c0``, ``c1`` ..) of hashed words, weighted by how rare they are. Clusters are
    fitted on about ``rows`` documents at most, chosen by a hash of their text, and given to all; a document without
    words has the topic ``empty``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    names = [c for c in docs.columns if c.lower() != "topic"]
    own = {c: own_name(names, c) for c in ("words", "tf", "idf", "unit", "cluster")}
    df = docs.select(*names, words_of(F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias(own["words"]))
    share = min(1.0, rows / max(1, docs.count()))
    some = df.where((F.size(own["words"]) > 0) & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))))
    if some.isEmpty():
        return docs.select(*names).withColumn("topic", F.lit("empty"))
    stages = [HashingTF(numFeatures=features, inputCol=own["words"], outputCol=own["tf"]), IDF(inputCol=own["tf"], outputCol=own["idf"]), Normalizer(inputCol=own["idf"], outputCol=own["unit"]), KMeans(k=k, seed=seed, featuresCol=own["unit"], predictionCol=own["cluster"])]
    found = Pipeline(stages=stages).fit(materialize(some.select(own["words"]), "topic-sample")).transform(df)
    topic = F.when(F.size(own["words"]) > 0, F.concat(F.lit("c"), F.col(own["cluster"]).cast("string"))).otherwise("empty")
    return found.select(*names, topic.alias("topic"))


def cells_of(docs: DataFrame) -> DataFrame:
    """Tokens by cell of docs(source, lang, topic, n_tokens)."""
    return materialize(docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")


def mix(docs: DataFrame, temper: float = TEMPER, keep: float = KEEP, targets: DataFrame | None = None, topic: Column | None = None, moved: float | None = None) -> DataFrame:
    """docs with topic, n_tokens, the cell's raked weight, the probability and whether the document is sampled.

    ``targets`` has rows (dimension, value, weight) for some or all of source, lang and topic; ``topic`` is an expression
    of a document's topic."""
    names = [c for c in docs.columns if c not in RESULTS]
    df = with_topic(docs, topic).select(*names, "topic", "n_tokens")
    rated = rake(cells_of(df), temper, keep, targets, moved)
    keys = {d: own_name(names, d) for d in DIMENSIONS}
    side = rated.select(*(F.col(d).alias(k) for d, k in keys.items()), "weight", "probability")
    df = df.join(small_side(side), [F.col(d).eqNullSafe(F.col(k)) for d, k in keys.items()])
    return df.withColumn("sampled", uniform(F.col("doc_id")) < F.col("probability")).select(*names, *RESULTS)
