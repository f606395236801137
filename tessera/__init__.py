"""Tessera: labelled-dataset building, auditing and classifier evaluation on Spark DataFrames."""
