"""Whole plans: the warehouse build, the trial pipeline, and the queries over the driver's tables."""
