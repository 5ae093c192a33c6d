"""Canonical columns, their aliases, check groups and severities."""

from __future__ import annotations

#: Canonical name first, then what else it may be called.
_NAMES = """
loss train_loss training_loss
eval_loss val_loss validation_loss test_loss
lr learning_rate current_lr
step iter iteration global_step
grad_norm gnorm gradient_norm grad_l2
time timestamp elapsed
step_time seconds_per_step
loader_time data_time
gpu_util
"""
ALIASES: dict[str, list[str]] = {line.split()[0]: line.split() for line in _NAMES.strip().splitlines()}
METRICS = list(ALIASES)
RECORDS_DDL = "run_id string, rec_idx long, " + ", ".join(f"{m} double" for m in METRICS)

GROUPS = "zero-loss flat-loss divergence dead-run zero-grad grad-spike lr overfit step-time loader".split()
SEVERITY = {verdict: n for n, verdict in enumerate("FAIL WARN NOT-CHECKED PASS".split())}
UNJUDGED_IDS = "TP-NO-RECORDS TP-CMP-ERROR".split()
FINDING_DDL = "struct<id:string,level:string,message:string,evidence:string,source:string>"

RUN_META = "best_global_step best_metric best_model_checkpoint eval_steps logging_steps max_steps num_train_epochs save_steps train_batch_size".split()


def alias_map(overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Lower-case column name -> canonical name; overrides (canonical -> column) come first and don't disable aliases."""
    out = {a: canon for canon, names in ALIASES.items() for a in names}
    for canon, col in reversed(list((overrides or {}).items())):
        out[col.lower()] = canon
    return out
