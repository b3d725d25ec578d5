"""Event-time features on Spark: one declarative specification, evaluated as naive, replay, streaming and retrospective tables."""
