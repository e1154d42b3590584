"""Plans and run-time measurements."""

from .report import diff_plans, physical, plan_summary, planned_start, run_metrics

__all__ = ["diff_plans", "physical", "plan_summary", "planned_start", "run_metrics"]
