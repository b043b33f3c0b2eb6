"""Strataline: analytics over code-repository tables, built on Spark DataFrames."""
