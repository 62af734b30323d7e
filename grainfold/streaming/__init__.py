"""grainfold.streaming"""
