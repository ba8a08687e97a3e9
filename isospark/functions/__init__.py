"""isospark.functions"""
