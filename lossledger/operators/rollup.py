"""Roll-ups of reports: severity, exit code, triage order, fleet summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import SEVERITY, UNJUDGED_IDS


def normal_verdict(v: Column) -> Column:
    """An unknown or missing verdict is NOT-CHECKED."""
    return F.when(v.isin(*SEVERITY), v).otherwise("NOT-CHECKED")


def severity(v: Column) -> Column:
    v = normal_verdict(v)
    out = F.lit(SEVERITY["NOT-CHECKED"])
    for name, n in SEVERITY.items():
        out = F.when(v == name, n).otherwise(out)
    return out


def worst_verdict(reports: DataFrame) -> DataFrame:
    """One row: the worst verdict, PASS for no reports."""
    worst = F.coalesce(F.min(severity(F.col("verdict"))), F.lit(SEVERITY["PASS"]))
    return reports.agg(F.element_at(F.array(*[F.lit(v) for v in sorted(SEVERITY, key=SEVERITY.get)]), worst + 1).alias("worst_verdict"))


def exit_code(reports: DataFrame) -> DataFrame:
    """One row: 1 if any run failed, else 2 if any could not be judged, else 0."""
    v = normal_verdict(F.col("verdict"))
    unjudged = (v == "NOT-CHECKED") | F.exists("findings", lambda f: f["id"].isin(*UNJUDGED_IDS))
    return reports.agg(F.when(F.coalesce(F.bool_or(v == "FAIL"), F.lit(False)), 1).when(F.coalesce(F.bool_or(unjudged), F.lit(False)), 2).otherwise(0).alias("exit_code"))


def triage(reports: DataFrame, order: str = "run_id") -> DataFrame:
    """Worst first, then in the given order."""
    return reports.orderBy(severity(F.col("verdict")), order)


def place(verdict: Column, *order: str) -> Column:
    """Each report's place in that order, from 0. One task ranks all: for the reports of a triage list, a row for each run."""
    return F.row_number().over(Window.orderBy(severity(verdict), *order)).cast("long") - 1


def fleet_summary(reports: DataFrame, *dims: str) -> DataFrame:
    """Numbers of runs by verdict for every prefix of the dimensions."""
    return reports.rollup(*dims).agg(F.count("*").alias("runs"), *[F.count_if(F.col("verdict") == v).alias(v.lower().replace("-", "_")) for v in SEVERITY])
