"""Plumbline: measured explanations for binary classifiers, on Spark DataFrames."""
