"""notegrid.streaming"""
