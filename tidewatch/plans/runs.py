"""A suite's records logged, counted and adjusted, in the published fields."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.bootstrap import SKILL
from ..sources import ledger

#: The published names of the record's fields.
PUBLISHED = {
    "n": "n_rows", "n_eff": "effective_n", "nps": "nps_net_ann", "n_onsets": "lead_n_onsets", "n_missed": "lead_n_missed", "lead_median": "lead_median_lead_days", "lead_mean": "lead_mean_lead_days",
    "auc_diff": "auc_minus_persistence", "p_raw": "p_raw_vs_persistence",
}
_ADJUSTED = ("p_bonferroni", "skill_claimed", "n_valid")


def published(records: DataFrame) -> dict[str, dict]:
    """The records of a suite (one for each strategy) by name, in the published
    fields; what a rule has no value for is left out."""
    out = {}
    for r in records.orderBy("name").collect():  # a few strategies
        row = r.asDict(recursive=True)
        tested = row.get("p_raw") is not None
        kept = {PUBLISHED.get(k, k): v for k, v in row.items() if k not in _ADJUSTED and (tested or k not in ("auc_diff", "p_raw"))}
        for k in ("auc_minus_persistence", "p_raw_vs_persistence"):
            if k in kept:
                kept[k] = round(kept[k], 4)
        out[row["name"]] = kept
    return out


def logged(records: DataFrame, path: str, config: dict, *, seed: int, data_snapshot_hash: str, notes: str = "", sha: str = "unknown") -> dict[str, dict]:
    """Log every record of a suite in the ledger at ``path``, count all runs that
    it then holds, and adjust the models' p values for that number:
    ``run_count_M, p_bonferroni, skill_claimed`` beside the published fields.

    The count is of the ledger, so earlier runs weigh too, and of all runs of this
    suite; it is read after logging, so a suite never adjusts for fewer than itself.
    """
    spark, results = records.sparkSession, published(records)
    for name, row in results.items():
        ledger.log_run(spark, path, {**config, "strategy": name}, row, seed=seed, data_snapshot_hash=data_snapshot_hash, notes=notes or name, sha=sha)
    m = ledger.run_count(spark, path)
    for row in results.values():
        if "p_raw_vs_persistence" in row:
            p = min(1.0, row["p_raw_vs_persistence"] * m)
            row.update(run_count_M=m, p_bonferroni=round(p, 4), skill_claimed=p < SKILL)
    return results
