"""notegrid.operators"""
