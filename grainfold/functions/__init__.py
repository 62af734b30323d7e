"""grainfold.functions"""
