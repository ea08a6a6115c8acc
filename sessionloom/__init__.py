"""A PySpark-native engine for session logs: candidates, ranking, evaluation, experiments and drift."""
