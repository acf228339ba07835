"""Windrow: time-window labelling, evaluation and explainable classification on Spark."""
