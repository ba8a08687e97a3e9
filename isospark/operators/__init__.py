"""isospark.operators"""
