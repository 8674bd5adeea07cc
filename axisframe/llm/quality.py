"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows. Each path from a root to a node is a
conjunction of thresholds, a rule. A logistic model with an L1 penalty gives most rules the weight 0; the few that
are left are compiled to Spark column expressions, so scoring is one projection in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out

#: A rule: ((statistic, at_most, threshold), ...), all of which must hold.
Rule = tuple[tuple[str, bool, float], ...]


#: Characters whose shares are statistics.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    "digits": "0123456789",
    "bars": "|",
    "marks": "!?",
    "symbols": "#$%&*+<=>@[\\]^_`{}~/",
    "stops": ".,;:",
    "lines": "\n",
}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text counts as empty, and of an empty one every statistic is 0 but ``word_chars``, which is 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.array_remove(F.split(t, r"[ \n]"), "")
    count = F.greatest(F.size(words), F.lit(1))
    # one pass leaves the few characters that any class counts; Spark computes it once for all
    every = "".join(re.escape(c) for c in CLASSES.values())
    left = F.regexp_replace(t, F.lit(f"[^{every}]++"), F.lit(""))

    def share(chars: str) -> Column:
        return (F.length(left) - F.length(F.translate(left, chars, ""))) / n

    shares = {k: share(c) for k, c in CLASSES.items()}
    return {"log_chars": F.log1p(F.length(t)), "word_chars": n / count, "distinct_words": F.size(F.array_distinct(words)) / count, **shares}


NAMES = ["log_chars", "word_chars", "distinct_words", *CLASSES]


def grow(x: np.ndarray, target: np.ndarray, depth: int, least: int) -> list[tuple[tuple, float]]:
    """One regression tree: (path, mean) of every node but the root; a path is ((column, at_most, threshold), ...)."""
    nodes = []

    def split(rows: np.ndarray, path: tuple) -> None:
        if path:
            nodes.append((path, float(target[rows].mean())))
        if len(path) >= depth or len(rows) < 2 * least:
            return
        y, best = target[rows], (1e-9, None)
        whole = y.sum() ** 2 / len(y)
        for c in range(x.shape[1]):
            v = x[rows, c]
            order = np.argsort(v, kind="stable")
            run, s = np.cumsum(y[order]), v[order]
            k = np.flatnonzero(s[1:] > s[:-1]) + 1
            k = k[(k >= least) & (k <= len(s) - least)]
            if len(k):
                left = run[k - 1]
                gain = left**2 / k + (run[-1] - left) ** 2 / (len(s) - k) - whole
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), (c, float((s[k[b] - 1] + s[k[b]]) / 2)))
        if best[1]:
            c, t = best[1]
            low = x[rows, c] <= t
            split(rows[low], (*path, (c, True, t)))
            split(rows[~low], (*path, (c, False, t)))

    split(np.arange(len(x)), ())
    return nodes


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    got = np.ones(len(x), bool)
    for c, at_most, t in path:
        got &= x[:, c] <= t if at_most else x[:, c] > t
    return got


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, k = r.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1.0)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(r @ vw + vb, -35, 35))) - y
        nw = vw - step * (r.T @ err) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * err.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, text: Column) -> Column:
        """The model as one expression over ``text``; for clarity see :func:`score_documents`, which names the statistics first."""
        return self.over(statistics(text))

    def over(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, at_most, t in rule:
                test = test & (stats[name] <= F.lit(t) if at_most else stats[name] > F.lit(t))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.5, penalty: float = 2e-3) -> RuleModel:
    """Boosted trees -> rules -> lasso. With one class or no rows: no rules, the intercept of the class share.

    A node of a tree has a 500th of the rows, and one row, at least.
    """
    mean = float(y.mean()) if len(y) else 1.0
    base = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if not len(y) or y.min() == y.max():
        return RuleModel([], base)
    least = max(1, len(y) // 500)
    margin, paths = np.full(len(y), base), {}
    for _ in range(trees):
        nodes = grow(x, y - 1 / (1 + np.exp(-margin)), depth, least)
        if not nodes:
            break
        within = {p[:-1] for p, _ in nodes}
        for path, value in nodes:
            paths.setdefault(path, None)
            if path not in within:
                margin += rate * 4 * value * holds(x, path)
    rules = list(paths)
    r = np.stack([holds(x, p) for p in rules], axis=1).astype(float)
    w, b = lasso_logistic(r, y, penalty)
    kept = [(tuple((NAMES[c], at_most, t) for c, at_most, t in p), float(v)) for p, v in zip(rules, w, strict=True) if abs(v) > 1e-6]
    return RuleModel(kept, float(b))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """A model from about ``most`` labelled rows at most, outside the held-out third, half of each class where there are so many.

    ``most`` bounds the rows of statistics (not texts) that come to the driver. Rows are picked by a hash of the id. Of
    an id's several labels the commonest counts, the higher of ties; labels other than 0 and 1, null labels and null
    ids count for nothing. No label at all gives a model without rules that accepts everything.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    spread, keep = 1 << 30, F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("y") == value) & (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(spread)) < (spread if 2 * n <= most else int(spread * most / (2 * n)))))
    picked = known.where(keep)  # about ``most`` ids at most: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    got = rows.select("id", "y", *(c.cast("double").alias(k) for k, c in statistics(F.col("text")).items())).toPandas().sort_values(["id", *NAMES], kind="stable")
    return train(got[NAMES].to_numpy(float), got["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (higher: likelier good), ``predicted`` 1 if score >= 0.5 else 0.

    Only the whole text decides; null counts as empty, and empty texts get the score of an empty text's statistics.
    Equal texts get equal scores; repeated rows are each scored; other columns are ignored; an empty table gives an empty one.
    """
    named = docs.select(id_col, *(c.alias(f"_ {k}") for k, c in statistics(F.col(text_col)).items()))
    scored = named.select(id_col, held_out(F.col(id_col)).alias("held_out"), model.over({k: F.col(f"_ {k}") for k in NAMES}).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` the model predicts good, all their columns and no others, whatever these are called.

    Null and empty texts, equal texts, repeated rows and empty tables go by the rules of :func:`score_documents`.
    """
    names, score = {k: fresh(f"_ {k}", docs.columns) for k in NAMES}, fresh("_ score", docs.columns)
    with_stats = docs.withColumns({names[k]: c for k, c in statistics(F.col(text_col)).items()})
    # a condition on the score itself would be moved below the statistics, which would then be computed once for each
    # rule that asks for them; a generator stops it there
    scored = with_stats.select(*docs.columns, F.inline(F.array(F.struct(model.over({k: F.col(v) for k, v in names.items()}).alias(score)))))
    return scored.where(F.col(score) >= 0.5).select(*docs.columns)
