"""lociflow: interval, sequence and text analytics as composable Spark DataFrame functions."""
