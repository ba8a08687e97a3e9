"""isospark.sources"""
