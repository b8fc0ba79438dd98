"""The query catalogue: operators applied to tables, each with its oracle SQL."""
