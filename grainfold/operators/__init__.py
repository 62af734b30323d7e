"""grainfold.operators"""
