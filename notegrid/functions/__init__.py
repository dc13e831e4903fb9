"""notegrid.functions"""
