"""Popularity analytics over tables of software projects, on PySpark."""
