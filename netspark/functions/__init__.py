"""netspark.functions"""
