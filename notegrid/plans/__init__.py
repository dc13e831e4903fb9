"""notegrid.plans"""
