"""Cohortis: a Spark-native analytics engine for multi-site cohort studies."""
