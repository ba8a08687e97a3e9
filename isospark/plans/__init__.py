"""isospark.plans"""
