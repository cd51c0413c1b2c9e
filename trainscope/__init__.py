"""Diagnostics for distributed training jobs as Spark DataFrame operators.

Four kinds of table are understood: rank log lines, process stack snapshots,
stored alert events and request records.  Every public function takes
DataFrames or Columns and returns a DataFrame or a Column; nothing runs until
the caller starts an action.
"""
