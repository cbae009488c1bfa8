"""Expressions: functions from Columns to Columns."""
