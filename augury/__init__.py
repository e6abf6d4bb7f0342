"""Auditing dated warning signals against ground truth, as composable Spark operators."""
