"""netspark.plans"""
