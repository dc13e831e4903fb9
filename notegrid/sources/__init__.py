"""notegrid.sources"""
