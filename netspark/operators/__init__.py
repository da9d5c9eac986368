"""netspark.operators"""
