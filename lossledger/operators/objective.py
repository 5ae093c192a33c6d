"""Checks of a loss objective: is the ignored id a real class, and does every class occur as a target?"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T


def _f(id_: str, level: str, message: str, evidence: str) -> dict[str, str]:
    return {"id": id_, "level": level, "message": message, "evidence": evidence}


def check_ignore_index(num_classes: int, ignore_index: int | None) -> list[dict[str, str]]:
    if ignore_index is None:
        return []
    n, at = int(num_classes), int(ignore_index)
    if 0 <= at < n:
        return [_f("TP-OBJ-IGNORE-INDEX-COLLISION", "FAIL", "ignore_index is a class of the output layer: its targets never reach the loss", f"ignore_index={at} lies in 0..{n - 1}; take -100 or {n}")]
    if at == n:
        return [_f("TP-OBJ-IGNORE-INDEX-OK", "INFO", "ignore_index is one past the last class", f"ignore_index={at}, classes 0..{n - 1}")]
    return []


def coverage(targets: DataFrame, num_classes: int, ignore_index: int | None = None, target: str = "target", by: list[str] | None = None) -> DataFrame:
    """n_targets, out_of_range and the distinct classes seen (an array, num_classes long at most), for each group of `by`.

    Partial sets merge before the exchange, so that a batch costs its distinct classes, not its targets. Works on streams as well.
    """
    t = F.col(target).cast("long")
    kept = targets.where(t.isNotNull() & (F.lit(True) if ignore_index is None else t != int(ignore_index)))
    inside = (t >= 0) & (t < num_classes)
    return kept.groupBy(*(by or [])).agg(F.count("*").alias("n_targets"), F.count_if(~inside).alias("out_of_range"), F.array_sort(F.collect_set(F.when(inside, t))).alias("seen"))


def missing_classes(targets: DataFrame, num_classes: int, ignore_index: int | None = None, target: str = "target") -> DataFrame:
    """Classes that are never a target, by anti join."""
    t = F.col(target).cast("long")
    seen = targets.where(F.lit(True) if ignore_index is None else t != int(ignore_index)).select(t.alias("id")).distinct()
    return targets.sparkSession.range(num_classes).join(seen, "id", "left_anti").withColumnRenamed("id", "class")


def judge_coverage(cov: DataFrame, num_classes: int) -> DataFrame:
    """Adds n_seen, missing and the ids of the findings (a joined text)."""
    out = cov.withColumn("n_seen", F.size("seen").cast("long")).withColumn("missing", F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(num_classes - 1).cast("long")), F.col("seen")) if num_classes > 0 else F.array().cast("array<bigint>"))
    thin = F.col("n_seen") < T.DEAD_CLASS_MIN_COVERAGE * num_classes if num_classes else F.lit(True)
    dead = F.when(thin, "TP-OBJ-COVERAGE-INSUFFICIENT").when(F.size("missing").between(1, T.DEAD_CLASS_MAX_LISTED), "TP-OBJ-DEAD-CLASS").when(F.size("missing") == 0, "TP-OBJ-DEAD-CLASS-OK")
    return out.withColumn("ids", F.concat_ws(",", F.when(F.col("out_of_range") > 0, "TP-OBJ-TARGET-OUT-OF-RANGE"), dead))


def _flat(targets: Any) -> Iterable[int]:
    """Ints of a tensor, an array or nested sequences."""
    for step in ("detach", "cpu", "tolist"):
        targets = getattr(targets, step, lambda same=targets: same)()
    if isinstance(targets, (list, tuple)):
        for x in targets:
            yield from _flat(x)
    else:
        yield int(targets)


class TargetCoverage:
    """The same, fed batch by batch inside a training process; mergeable."""

    def __init__(self, num_classes: int, ignore_index: int | None = None) -> None:
        self.classes, self.ignored = int(num_classes), ignore_index
        self.seen: set[int] = set()
        self.n_targets = self.out_of_range = 0

    def observe(self, targets: Any) -> TargetCoverage:
        ids = [t for t in _flat(targets) if t != self.ignored]
        inside = [t for t in ids if 0 <= t < self.classes]
        self.n_targets += len(ids)
        self.out_of_range += len(ids) - len(inside)
        self.seen.update(inside)
        return self

    def merge(self, other: TargetCoverage) -> TargetCoverage:
        self.seen |= other.seen
        self.n_targets += other.n_targets
        self.out_of_range += other.out_of_range
        return self

    def result(self) -> list[dict[str, str]]:
        return coverage_findings(self.classes, self.n_targets, self.out_of_range, self.seen)


def coverage_findings(n: int, n_targets: int, out_of_range: int, seen: Iterable[int]) -> list[dict[str, str]]:
    seen = set(seen)
    missing = [c for c in range(n) if c not in seen]
    share = f"{len(seen)}/{n}"
    out = []
    if out_of_range:
        out.append(_f("TP-OBJ-TARGET-OUT-OF-RANGE", "FAIL", "targets that the output layer can't represent", f"{out_of_range} of {n_targets} targets outside 0..{n - 1}"))
    if not n or len(seen) / n < T.DEAD_CLASS_MIN_COVERAGE:
        out.append(_f("TP-OBJ-COVERAGE-INSUFFICIENT", "INFO", "too few classes observed to judge dead ones", f"{share} classes seen over {n_targets} targets"))
    elif not missing:
        out.append(_f("TP-OBJ-DEAD-CLASS-OK", "PASS", "every class occurs as a target", f"{n} classes over {n_targets} targets"))
    elif len(missing) <= T.DEAD_CLASS_MAX_LISTED:
        out.append(_f("TP-OBJ-DEAD-CLASS", "FAIL", "a class of the output layer is never a target and can't be learned", f"class(es) {missing} never targeted; {share} other classes seen over {n_targets} targets"))
    return out


def check_objective(num_classes: int, ignore_index: int | None = None, targets: Any = None) -> list[dict[str, str]]:
    """targets: one batch, an iterable of batches, or a DataFrame with a column `target` (nested arrays are flattened)."""
    out = check_ignore_index(num_classes, ignore_index)
    if isinstance(targets, DataFrame):
        kind = dict(targets.dtypes)["target"]
        col = F.col("target")
        for _ in range(kind.count("array<") - 1):
            col = F.flatten(col)
        rows = targets.select(F.explode(col).alias("target")) if kind.startswith("array") else targets
        r = coverage(rows, num_classes, ignore_index).first()
        out += coverage_findings(num_classes, *((r["n_targets"], r["out_of_range"], r["seen"]) if r else (0, 0, ())))
    elif targets is not None:
        out += TargetCoverage(num_classes, ignore_index).observe(targets).result()
    return out


def infer_objective(model: Any) -> tuple[int | None, int]:
    """(num_classes, ignore_index) of a model-like object: from its config, else from its last linear layer."""
    config = getattr(model, "config", None)
    n = next((getattr(config, k) for k in ("vocab_size", "num_labels", "n_classes") if isinstance(getattr(config, k, None), int)), None)
    if n is None and hasattr(model, "modules"):
        for layer in model.modules():
            n = getattr(layer, "out_features", n)
    ignore = getattr(config, "ignore_index", None)
    return n, -100 if ignore is None else int(ignore)


def labels_of(batch: Any) -> Any:
    """The targets in a training batch, None if there are none."""
    for key in ("labels", "label", "targets", "target"):
        if hasattr(batch, "get") and batch.get(key) is not None:
            return batch.get(key)
    return None
