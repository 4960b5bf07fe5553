"""Conversation and corpus analytics on PySpark DataFrames."""
