"""Residential-property analytics on Spark: DataFrame in, DataFrame out."""
