"""Whole analyses: bootstrap metrics, speed-ups, CPU utilization."""
