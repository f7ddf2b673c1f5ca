"""Statistics, heavy keys, row assignment, workloads, verification, analytics."""
