"""grainfold.sources"""
