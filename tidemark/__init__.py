"""Prevalence measurement on Spark: sampling, estimation, calibration, monitoring and text classification as DataFrame plans."""
