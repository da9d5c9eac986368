"""netspark.sources"""
