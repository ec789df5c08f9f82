"""Spark jobs that turn logs of recorded model responses, gold labels, rater
scores and call traces into validated outputs, quality metrics and a verdict."""
