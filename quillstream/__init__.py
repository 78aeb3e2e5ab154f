"""Learning-activity and document analytics as composable Spark DataFrame transformations."""
