"""netspark.streaming"""
