"""isospark.streaming"""
