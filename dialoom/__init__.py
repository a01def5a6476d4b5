"""Curating and scoring tool-calling dialogue corpora on Spark."""
