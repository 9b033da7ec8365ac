"""Quality classifier as a sparse rule ensemble over text statistics.

Boosted shallow trees on a bounded sample of labelled rows propose rules: every path
from a root is a conjunction of threshold tests on statistics of the whole text. A
logistic model with an L1 penalty keeps the few rules that matter, and the fitted
model is compiled into one Spark column, so scoring is JVM expressions without
shuffles. Labels, language, source and ids are never inputs.

Defined results: null and empty texts have all statistics 0 and a score like any
other; null labels are left out of fitting; with no labels, or labels of one kind,
the score is the constant share of label 1 (0.5 without labels); repeated labelled
rows count as often as they occur; repeated documents are scored alike; extra columns
of the input don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import settled

#: Labelled rows used for fitting at most, taken in order of a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3


def _counts(text: Column) -> dict[str, Column]:
    """What the statistics are made of: words and lines as arrays, and numbers of characters; all 0 or empty for an empty text."""
    text = F.coalesce(text, F.lit(""))

    def only(characters: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("double")

    def count(character: str) -> Column:
        return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))).cast("double")

    return {
        "n": F.length(text).cast("double"),
        "tokens": F.array_remove(F.split(text, r"\s+"), ""),
        "lines": F.split(text, "\n"),
        "upper": only("A-ZÀ-Þ"),
        "digits": only("0-9"),
        "symbols": only(r"#$%&*@^~<>=+_{}\[\]\\"),
        "bangs": count("!"),
        "bars": count("|"),
        "stops": count("."),
        "commas": count(","),
    }


def _sizes(of: dict[str, Column]) -> dict[str, Column]:
    """Numbers in place of the arrays."""
    arrays = {"many": of["tokens"], "distinct_words": F.array_distinct(of["tokens"]), "rows": of["lines"], "distinct_lines": F.array_distinct(of["lines"])}
    return {k: c for k, c in of.items() if k not in ("tokens", "lines")} | {k: F.size(c).cast("double") for k, c in arrays.items()}


def _shares(of: dict[str, Column]) -> dict[str, Column]:
    """Name to statistic, all doubles, finite, 0 for an empty text."""
    n, many, rows = of["n"], of["many"], F.when(of["n"] > 0, of["rows"]).otherwise(F.lit(0.0))

    def share(count: Column, of: Column) -> Column:
        return F.when(of > 0, count / of).otherwise(F.lit(0.0))

    return {
        "n_chars": n,
        "n_words": many,
        "word_length": share(n, many),
        **{k: share(of[k], n) for k in ("upper", "digits", "symbols")},
        **{k: share(of[k], many) for k in ("bangs", "bars", "stops", "commas", "distinct_words")},
        "distinct_lines": share(of["distinct_lines"], rows),
        "line_words": share(many, rows),
    }


NAMES = ("n_chars", "n_words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "distinct_words", "distinct_lines", "line_words")

#: A test is (index of the statistic, threshold, above); a rule is a tuple of tests that all hold.
Test = tuple[int, float, bool]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Test, ...], ...]
    weights: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "s_") -> Column:
        """The score over columns named as ``NAMES`` after ``prefix``."""

        def condition(rule) -> Column:
            return reduce(lambda a, b: a & b, [(F.col(f"{prefix}{NAMES[i]}") > t) if above else (F.col(f"{prefix}{NAMES[i]}") <= t) for i, t, above in rule])

        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(condition(rule), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, t, above in rule:
        out &= (x[:, i] > t) if above else (x[:, i] <= t)
    return out


def _cuts(x: np.ndarray, parts: int = 48) -> list[np.ndarray]:
    """Thresholds of each statistic, between observed values."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, parts + 1)[1:-1]))
        above = np.array([column[column > v].min(initial=np.inf) for v in q])
        q = np.where(np.isfinite(above), (q + above) / 2, q)
        out.append(q[np.isfinite(above)])
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3) -> set[tuple[Test, ...]]:
    """The paths of boosted trees that follow the logistic gradient."""
    cuts = _cuts(x)
    binned = np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)])
    z, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        step = np.zeros(len(y))

        def split(rows: np.ndarray, path: tuple[Test, ...], left: int) -> None:
            if path:
                found.add(tuple(sorted(path)))
            best = (1e-3, None, None)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            if left and len(rows) >= 20:
                for i, c in enumerate(cuts):
                    if not len(c):
                        continue
                    sg = np.bincount(binned[rows, i], g[rows], len(c) + 1).cumsum()[:-1]
                    sh = np.bincount(binned[rows, i], h[rows], len(c) + 1).cumsum()[:-1]
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    if gain.max() > best[0]:
                        best = (gain.max(), i, int(gain.argmax()))
            if best[1] is None:
                step[rows] = rate * total_g / (total_h + 1)
                return
            _, i, k = best
            low = binned[rows, i] <= k
            split(rows[low], (*path, (i, float(cuts[i][k]), False)), left - 1)
            split(rows[~low], (*path, (i, float(cuts[i][k]), True)), left - 1)

        split(np.arange(len(y)), (), depth)
        z += step
    return found


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept isn't penalised."""
    n, k = a.shape
    mean, scale = a.mean(0), np.maximum(a.std(0), 1e-3)
    s = (a - mean) / scale
    v = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(30):  # largest eigenvalue
        v = s.T @ (s @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(s @ v) ** 2 / n + 1) * 1.05)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    u, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(s @ u + c))) - y
        w2 = u - rate * (s.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2, t2 = c - rate * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b - (w / scale) @ mean), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """x: rows of statistics in the order of ``NAMES``; y: 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    rules = sorted(grow(x, y, trees, depth))
    on = np.column_stack([holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(on, axis=1, return_index=True)
    keep = [i for i in sorted(first) if 0 < on[:, i].mean() < 1]
    if not keep:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), (), ())
    b, w = lasso_logistic(on[:, keep], y, penalty)
    used = [i for i in range(len(keep)) if abs(w[i]) > 1e-6]
    return RuleModel(b, tuple(rules[keep[i]] for i in used), tuple(float(w[i]) for i in used))


def with_statistics(docs: DataFrame, *kept: str, prefix: str = "s_") -> DataFrame:
    """``kept`` columns and the statistics, passed through generators of one row: words are split once a text, and a filter on the statistics stays above and computes none again."""

    def named(found: dict[str, Column]) -> dict[str, Column]:
        return {f"{prefix}{k}": c for k, c in found.items()}

    counts = _counts(docs["text"])
    counted = settled(docs, list(kept), **named(counts))
    sizes = _sizes({k: F.col(f"{prefix}{k}") for k in counts})
    sized = settled(counted, list(kept), **named(sizes))
    return settled(sized, list(kept), **named(_shares({k: F.col(f"{prefix}{k}") for k in sizes})))


def unused(columns: list[str], prefix: str = "s_") -> str:
    """``prefix`` made longer until no column starts with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on the first ``sample_rows`` labelled rows, in hash order, that aren't held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).where("y in (0, 1)").where(~held_out(F.col("id")))
    chosen = marked.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("y", "text", F.xxhash64("id").alias("at"), "id", F.xxhash64("text").alias("digest"))
    # An id can have any number of rows: those learned from are bounded after the join.
    rows = with_statistics(texts, "y", "at", "id", "digest").orderBy("at", "id", "digest", "y").limit(sample_rows).drop("at", "id", "digest").toPandas()
    y = rows.pop("y").to_numpy(float)
    order = np.lexsort(rows.to_numpy(float).T) if len(rows) else np.arange(0)  # the same model however rows arrive
    return fit_rules(rows.to_numpy(float).reshape(len(y), len(NAMES))[order], y[order])


def scored(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    found = with_statistics(docs.select("doc_id", "text"), "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    prefix = unused(docs.columns)
    return with_statistics(docs, *docs.columns, prefix=prefix).where(model.column(prefix) >= threshold).select(*docs.columns)
