"""Shoebox: DataFrame operators for organising and searching large media libraries on Spark."""
