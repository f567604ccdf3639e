"""Registered queries; importing the package registers them all."""

from . import alert_plans, anomaly_plans, data_plans, decision_sql, feature_sql, function_plans, report_plans, sampling_plans, selection_plans, window_plans, worked_sql  # noqa: F401
