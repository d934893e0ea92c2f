"""Unsupervised word segmentation and vocabulary discovery on Spark DataFrames."""
